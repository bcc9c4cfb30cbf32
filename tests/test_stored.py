"""State after each event, assignment, stored tables, cascades, failing
sources, top facets, extractors and row generators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hirelake.operators import discovery as X
from hirelake.operators import extractors as E
from hirelake.operators import health as H
from hirelake.operators import search as R
from hirelake.operators import stored as K
from hirelake.operators import upsert as U


# ---------------------------------------------------------------- health after each event

def machine(events, healthy=True):
    """The state machine, event by event."""
    out, state = {}, {}
    for key, at, kind in sorted(events, key=lambda e: (str(e[0]), e[1])):
        s, f, h = state.get(key, (0, 0, healthy))
        if kind == "ok":
            s, f, h = s + 1, 0, True
        elif kind == "bad":
            f += 1
            h = h and f < 3
        else:
            continue
        state[key] = (s, f, h)
        out[(key, at)] = state[key]
    return out


@pytest.mark.parametrize("partitions,healthy", [(1, True), (7, True), (7, False)])
def test_timeline_against_the_machine(spark, partitions, healthy):
    rng = random.Random(partitions)
    events = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.choice(["ok", "bad", "bad", "bad", "view"])) for i in range(600)]
    events += [("late", 1000 + i, "bad") for i in range(40)] + [("won", 2000 + i, "ok") for i in range(40)]
    df = spark.createDataFrame(events, "k string, at long, kind string")
    got = H.health_timeline(df, "k", ["at"], F.col("kind") == "ok", F.col("kind") == "bad", healthy, partitions).collect()
    assert {(r.k, r["at"]): (r.success_count, r.fail_count, r.is_healthy) for r in got} == machine(events, healthy)
    assert len(got) == len(machine(events, healthy))


def test_timeline_spreads_a_hot_key(spark):
    """A key with most of the events, all in one hour: no window holds more than about a range's share."""
    df = spark.range(8000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                  F.col("id").alias("at"), (F.col("id") % 5 == 0).alias("ok"))
    out = H.health_timeline(df, "k", ["at"], F.col("ok"), ~F.col("ok"), partitions=16)
    assert out.count() == 8000
    final = H.health_fold(df, "k", ["at"], F.col("ok"), ~F.col("ok"), bucket=F.floor(F.col("at") / 100))
    last = out.groupBy("k").agg(F.max_by(F.struct("success_count", "fail_count", "is_healthy"), "at").alias("s")).select("k", "s.*")
    assert last.exceptAll(final).count() == 0 and final.exceptAll(last).count() == 0
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spread = H.health_timeline(df, "k", ["at"], F.col("ok"), ~F.col("ok"))
        tasks = spread.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in tasks) < 8000 / 3  # one task would hold two thirds of the rows


def test_assignment_follows_the_cursor(spark):
    pool = [("p0", True, 0), ("p1", False, 3), ("p2", False, 2), ("p3", True, 0), ("p4", False, 9)]
    p = spark.createDataFrame(pool, "name string, is_healthy boolean, fail_count int")
    q = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "at long, req string")
    got = {r.req: r.proxy for r in H.assign(q, p, [F.col("at")], [F.col("name")], "name", "proxy").collect()}
    cursor, want = 0, {}
    for i in range(10):
        while True:
            cursor = (cursor + 1) % len(pool)
            if pool[cursor][1] or pool[cursor][2] < 3:
                break
        want[f"r{i}"] = pool[cursor][0]
    assert got == want


def test_assignment_without_a_usable_member(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "at long, req string")
    schema = "name string, is_healthy boolean, fail_count int"
    for rows in ([], [("x", False, 3)]):
        p = spark.createDataFrame(rows, schema)
        got = H.assign(q, p, [F.col("at")], [F.col("name")], "name").collect()
        assert [(r.req, r.assigned) for r in sorted(got)] == [("a", None), ("b", None)]


# ---------------------------------------------------------------- stored tables

SCHEMA = "k string, v long, at long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(f"k{i}", i, 0) for i in range(200)], SCHEMA)
    first = K.upsert(base, path, 0, ["k"], ["at"], buckets=8)
    assert first == list(range(8))
    before = K._buckets(spark, path)
    part = spark.createDataFrame([("k3", -3, 5), ("k3", -4, 4), ("new", 7, 1), ("k5", 0, -1)], SCHEMA)
    touched = K.upsert(part, path, 1, ["k"], ["at"], buckets=8)
    assert 0 < len(touched) <= 3
    after = K._buckets(spark, path)
    assert {b for b in after if after[b] != before[b]} == set(map(str, touched))
    want = {f"k{i}": (i, 0) for i in range(200)} | {"k3": (-3, 5), "new": (7, 1)}
    got = K.read_upserted(spark, path, base.schema).collect()
    assert len(got) == 201 and {r.k: (r.v, r["at"]) for r in got} == want


def test_upsert_repeated_and_interrupted(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), (None, 9, 1)], SCHEMA)
    b = spark.createDataFrame([("x", 2, 2), ("z", 2, 2)], SCHEMA)
    K.upsert(a, path, 0, ["k"], ["at"], buckets=4)
    boom = b.withColumn("v", F.when(F.col("k") == "z", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        K.upsert(boom, path, 1, ["k"], ["at"], buckets=4)
    # a write that got as far as its files, but was not closed
    b.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/epoch=1")
    assert rows_of(K.read_upserted(spark, path, a.schema).na.fill("null")) == [("null", 9, 1), ("x", 1, 1), ("y", 1, 1)]
    assert K.upsert(b, path, 1, ["k"], ["at"], buckets=4)
    once = rows_of(K.read_upserted(spark, path, a.schema).na.fill("null"))
    assert once == [("null", 9, 1), ("x", 2, 2), ("y", 1, 1), ("z", 2, 2)]
    assert K.upsert(b, path, 1, ["k"], ["at"], buckets=4) == []  # the batch comes again
    assert rows_of(K.read_upserted(spark, path, a.schema).na.fill("null")) == once
    assert K.vacuum(spark, path) > 0
    assert rows_of(K.read_upserted(spark, path, a.schema).na.fill("null")) == once
    with pytest.raises(ValueError, match="buckets"):
        K.upsert(b, path, 2, ["k"], ["at"], buckets=5)
    assert K.upsert(b.limit(0), path, 2, ["k"], ["at"], buckets=4) == []
    assert rows_of(K.read_upserted(spark, path, a.schema).na.fill("null")) == once


def test_append_survives_a_death_half_way(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(f"k{i}", i, i % 3) for i in range(90)], SCHEMA).repartition(6)
    assert K.read_appended(spark, path, df.schema).count() == 0
    dies = df.withColumn("v", F.when(F.col("v") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        K.append_once(dies, path, "b-1", ("at",))
    assert K.read_appended(spark, path, df.schema).count() == 0
    df.limit(10).write.mode("overwrite").partitionBy("at").parquet(f"{path}/batch=b-1")  # killed before its marker
    assert K.read_appended(spark, path, df.schema).count() == 0
    assert K.append_once(df, path, "b-1", ("at",))
    assert not K.append_once(df, path, "b-1", ("at",))
    assert K.append_once(df.limit(5), path, "b-2", ("at",))
    got = K.read_appended(spark, path, df.schema)
    assert {r.batch: r["count"] for r in got.groupBy("batch").count().collect()} == {"b-1": 90, "b-2": 5}
    assert sorted(r.v for r in got.filter("batch = 'b-1'").collect()) == list(range(90))
    with pytest.raises(ValueError):
        K.append_once(df, path, "../x")


def test_exact_dedupe_over_epochs(spark, tmp_path):
    path = str(tmp_path / "t")
    kind = "k string, v int"
    for epoch, keys in enumerate([["a", "a", "b", None], ["b", "c", None, None], ["c", "a"], ["d"]]):
        df = spark.createDataFrame([(k, epoch) for k in keys], kind)
        assert K.append_new(df, path, epoch, "k")
        assert not K.append_new(df, path, epoch, "k")
    got = K.read_new(spark, path, df.schema).collect()
    assert sorted(((r.k, r.v) for r in got), key=str) == sorted([("a", 0), ("b", 0), (None, 0), ("c", 1), ("d", 3)], key=str)


def test_merged_epochs_hold_the_same_rows(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "k string, v int"
    want = {}
    for epoch in range(7):
        keys = [f"k{i % 11}" for i in range(epoch, epoch * 3 + 2)] + [None]
        df = spark.createDataFrame([(k, epoch) for k in keys], kind)
        assert K.append_new(df, path, epoch, "k")
        for k in keys:
            want.setdefault(k, epoch)
        if epoch in (1, 3, 5):
            assert K.merge_epochs(spark, path, df.schema) == epoch
            assert K.merge_epochs(spark, path, df.schema) == epoch  # nothing new to merge
            assert not K.append_new(df, path, epoch, "k")  # the batch comes again after the merge
        got = K.read_new(spark, path, df.schema).collect()
        assert len(got) == len(want) and {r.k: r.v for r in got} == want
    assert len(K._live(spark, path)[1]) == 2  # the merge of 0 to 5, and epoch 6
    # a merge that died before its marker does not count
    df.write.partitionBy("k").parquet(f"{path}/epoch=-7")
    assert K._live(spark, path)[0] == 5


# ---------------------------------------------------------------- cascades

def test_cascade_with_a_cycle_and_a_diamond(spark):
    edges = [("u", 1, "c", 1), ("u", 2, "c", 2), ("q", 1, "u", 1), ("q", 2, "u", 2), ("r", 1, "q", 1),
             ("r", 1, "u", 1), ("c", 1, "r", 1), ("q", 9, "q", 9)]
    e = spark.createDataFrame(edges, "kind string, key long, parent_kind string, parent_key long")
    d = spark.createDataFrame([("c", 1), ("c", 1)], "kind string, key long")
    assert rows_of(U.cascade_all(e, d)) == [("c", 1, 0), ("q", 1, 2), ("r", 1, 2), ("u", 1, 1)]
    assert rows_of(U.cascade_all(e, d, max_levels=1)) == [("c", 1, 0), ("u", 1, 1)]
    assert U.cascade_all(e, d.limit(0)).count() == 0


# ---------------------------------------------------------------- sources that fail

def test_failing_sources_are_left_out_and_named(spark, tmp_path):
    good = spark.createDataFrame([("n", "d"), ("m", "e")], "name string, domain string")
    readers = {
        "here": lambda: good,
        "absent": lambda: spark.read.parquet(str(tmp_path / "nothing")),
        "breaks": lambda: good.withColumn("name", F.when(F.col("name") == "m", F.raise_error(F.lit("row m"))).otherwise("x")),
        "empty": lambda: good.limit(0),
    }
    rows, status = X.dispatch_written(readers, ["here", "absent", "breaks", "empty"], str(tmp_path / "out"))
    assert rows_of(rows.select("source", "name")) == [("here", "m"), ("here", "n")]
    got = {r.source: r for r in status.collect()}
    assert {s: (r.status, r.rows) for s, r in got.items()} == {
        "here": ("ok", 2), "absent": ("failed", 0), "breaks": ("failed", 0), "empty": ("ok", 0)}
    assert got["here"].error is None and got["absent"].error and got["breaks"].error
    rows, status = X.dispatch_written(readers, ["breaks"], str(tmp_path / "out2"))
    assert rows.count() == 0 and status.first().status == "failed"
    with pytest.raises(ValueError, match="unknown source"):
        X.dispatch_written(readers, ["other"], str(tmp_path / "out3"))


def test_emails_of_a_domain_on_each_of_its_pages(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "page_id long, domain string")
    emails = spark.createDataFrame([("a", "y@a"), ("a", "x@a"), ("a", "x@a"), (None, "z")], "domain string, email string")
    got = {r.page_id: r.emails for r in X.attach_emails(pages, emails).collect()}
    assert got == {1: ["x@a", "y@a"], 2: ["x@a", "y@a"], 3: [], 4: []}


def test_a_hot_group_is_numbered_in_many_tasks(spark):
    from hirelake.operators import sequence as Q
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(
        (F.col("id") % 30).cast("string")).alias("g"), F.col("id"))
    out = Q.group_index(df, ["g"], [F.col("id")], "n")
    assert out.columns == ["g", "id", "n"] and out.count() == 6000
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        want.setdefault(r.g, []).append(r.id)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.n):
        got.setdefault(r.g, []).append(r.id)
        assert r.n == len(got[r.g]) - 1
    assert got == want


def test_seen_flags_and_null_keys(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    old = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted((r.v, r.seen) for r in U.mark_seen(new, old, "k").collect()) == [(1, True), (2, True), (3, False), (4, False)]


def test_the_index_stands_until_its_source_changes(spark, tmp_path):
    src, made = str(tmp_path / "docs"), []
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "doc_id long, text string")
    docs.write.parquet(src)

    def build():
        made.append(1)
        return R.build_index(spark.read.parquet(src), {"description": "text"})

    def hits():
        index = R.standing_index(spark, src, {"description": "text"}, build, str(tmp_path / "indexes"))
        return sorted(r.doc_id for r in R.search_hits(index, "fox").collect())

    assert hits() == [1, 2] and hits() == [1, 2] and len(made) == 1
    spark.createDataFrame([(3, "a fox")], "doc_id long, text string").write.mode("append").parquet(src)
    assert hits() == [1, 2, 3] and len(made) == 2


def test_index_and_words_are_read_by_folder_and_written_in_parts_by_size(spark, tmp_path, monkeypatch):
    from hirelake.sources import tables as T
    src, folder, fields = str(tmp_path / "docs"), str(tmp_path / "indexes"), {"description": "text"}
    rows = [(i, " ".join(f"{c}{i % 50}" for c in "abcdefgh")) for i in range(400)] + [(None, "thing a1"), (None, "thing a1"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(src)
    docs = spark.read.parquet(src)
    size, cores = T.input_bytes(docs), spark.sparkContext.defaultParallelism
    assert T.spread(docs, 1).rdd.getNumPartitions() == cores
    monkeypatch.setattr(T, "input_bytes", lambda df: 20 << 20)  # as if it had 20 MB
    assert T.spread(docs, 1).rdd.getNumPartitions() == 20

    seen, write = [], R.write_index
    monkeypatch.setattr(R, "write_index", lambda index, path: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or write(index, path))
    monkeypatch.setattr(R, "parts", lambda n, mb, least: T.parts(n * (20 << 20) // size, 1, least))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    index = R.standing_index(spark, src, fields, lambda: R.build_index(docs, fields), folder)
    assert seen[0] >= 20 and spark.conf.get("spark.sql.shuffle.partitions") == before

    words = R.standing_words(spark, index, src, fields, folder)
    plain = R.vocabulary(R.build_index(docs, fields))
    assert sorted(r.word for r in words.collect()) == sorted(r.word for r in plain.collect())
    assert all("-words/" in f for f in words.inputFiles())
    found = R.prefix_terms(words, ["a1", "thi", "zz"])
    assert rows_of(found) == rows_of(R.prefix_terms(plain, ["a1", "thi", "zz"]))
    assert "PartitionFilters: [prefix" in found._jdf.queryExecution().executedPlan().toString()
    fuzzy = R.fuzzy_terms(words, ["thng", "b11"], 1)
    assert rows_of(fuzzy) == rows_of(R.fuzzy_terms(plain, ["thng", "b11"], 1))
    hits = R.search_expanded(index, fuzzy.select("term", "word"))
    assert "PartitionFilters: [prefix" in hits._jdf.queryExecution().executedPlan().toString()
    want = R.search_expanded(R.build_index(docs, fields), fuzzy.select("term", "word"))
    assert sorted(map(str, hits.collect())) == sorted(map(str, want.collect())) and hits.count() > 8


# ---------------------------------------------------------------- top facets

@pytest.mark.parametrize("tracked", [16, 64, 4096])
def test_top_facets_are_exact(spark, tracked):
    """A small sketch loses track of rare values; the answer must not change."""
    rng = random.Random(4)
    rows = [(f"v{min(int(rng.expovariate(.05)), 400)}", [f"t{rng.randrange(3)}", f"x{i}"], None if i % 7 else "s")
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b array<string>, c string")
    want = []
    for name, values in (("a", [r[0] for r in rows]), ("b", [t for r in rows for t in r[1]]), ("c", [r[2] for r in rows if r[2]])):
        top = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:5]
        want += [(name, i + 1, v, n) for i, (v, n) in enumerate(top)]
    assert rows_of(R.facets_top(df, ["a", "b", "c"], 5, tracked)) == sorted(want)
    assert R.facets_top(df.limit(0), ["a"], 5).count() == 0


# ---------------------------------------------------------------- links

def test_links_are_filtered_as_rows_and_shuffled_once(spark):
    from hirelake.operators import html as HT
    html = "".join(f"<a href='/jobs/{i % 40}'>Opening {i}</a><a href='/about'>About us</a>" for i in range(100))
    pages = spark.createDataFrame([(k, "https://a.example/list", html) for k in range(6)], "page_id long, url string, html string")
    links = HT.job_links(HT.extract_pages(pages))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
    assert "lambda" not in plan and "array_position" not in plan  # nothing runs inside arrays
    got = links.collect()
    assert len(got) == 6 * 40 and {r.pos for r in got if r.page_id == 3} == {2 * i for i in range(40)}
    first = HT.numbered_job_links(HT.extract_pages(pages), 3).filter("page_id = 2").orderBy("pos").collect()
    assert [(r.pos, r.url, r.title) for r in first] == [(i, f"https://a.example/jobs/{i}", f"Opening {i}") for i in range(3)]


def test_links_no_url_can_be_made_of(spark):
    from hirelake.operators import html as HT
    assert HT.absolute("https://a.example/x/", "y?z#w") == "https://a.example/x/y?z#w"
    assert HT.absolute(None, "y") is None and HT.absolute("https://a.example", "http://[broken") == "http://[broken"


# ---------------------------------------------------------------- extractors and generators

PAGES = [(1, "https://a.example/x/", "<h1>Hi <b>you</b></h1><a href='y'>Y</a><a href='//b.example/z'>Z</a>"),
         (2, "https://a.example/", None), (3, None, "<a href='/q'>Q</a>")]


def test_extractors_in_one_pass(spark):
    name = "length_or_fail"
    if name not in E.registered():
        @E.extractor(name, "int")
        def length_or_fail(url, html):
            if not html:
                raise KeyError("no page")
            return len(html) if url else "text"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = E.extract(df, ["heading", "links", name])
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.page_id: r for r in out.collect()}
    assert got[1].heading == "Hi you" and got[1].links.asDict() == {"n": 2, "inside": 1, "hosts": ["b.example"]}
    assert got[1][name] == len(PAGES[0][2]) and got[1][f"{name}_error"] is None
    assert got[2].heading is None and got[2].heading_error is None and got[2].links.n == 0
    assert got[2][name] is None and got[2][f"{name}_error"].startswith("KeyError")
    assert got[3][name] is None and got[3][f"{name}_error"] and got[3].links.n == 1  # text is no int
    with pytest.raises(ValueError, match="no extractor"):
        E.extract(df, ["nobody"])
    with pytest.raises(ValueError, match="taken"):
        E.extractor("heading", "string")(lambda u, h: None)


def test_generators_from_sql(spark):
    E.register_generators(spark)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").fillna({"html": ""})
    got = spark.sql("SELECT p.page_id, a.* FROM {p} p, LATERAL page_anchors(p.url, p.html) a", p=df).collect()
    assert sorted(tuple(r) for r in got if r.page_id == 1) == [
        (1, 0, "y", "https://a.example/x/y", "Y"), (1, 1, "//b.example/z", "https://b.example/z", "Z")]
    ld = spark.createDataFrame([(1, '<script type="application/ld+json">{"@graph":[{"@type":"A"},{"@type":["B"],"title":"t"},3]}</script>'
                                    '<script type="application/ld+json">{broken</script>'
                                    '<script type="application/ld+json">{"@type":"C","title":4}</script>')], "id long, html string")
    got = spark.sql("SELECT a.pos, a.item_type, a.title FROM {p} p, LATERAL page_jsonld(p.html) a", p=ld).collect()
    assert sorted(tuple(r) for r in got) == [(0, "A", None), (1, None, "t"), (2, "C", None)]
