import random
import re
from collections import Counter

import numpy as np
import pytest

from hirelake.llm import rules as R
from hirelake.llm.queries import QUERIES
from tests.llm.util import SF, docs, folder

MEDIUM = "/root/testdata/sf0.01"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_against_the_plain_rules():
    rng = random.Random(8)
    texts = ["", " \n\t", "a", "a b c d e a b c d e", "x\n x\nx\n\nx", "é\x1c ü #* <b>|&$%", "\x85 a\x0bb\x0cc\r"]
    for _ in range(150):
        words = [rng.choice(["a", "b", "é", "##", "c" * 5, "\xa0"]) for _ in range(rng.randint(0, 40))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "  "]) for w in words))
    for t in texts:
        assert R.statistics(t) == slow(t), t


def test_codes_of_many_distinct_words_do_not_overflow():
    rng = random.Random(9)
    words = [str(rng.randrange(40_000)).encode() for _ in range(60_000)]
    words[50_000:50_007] = words[100:107]
    assert R.repeat_words(words) == 14


def test_slabs_hold_every_gram(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(0, 256, 1000, dtype=np.uint8))
    whole = np.concatenate([np.bincount(g, minlength=R.BUCKETS) for g in R._slabs(data)]).reshape(2, -1)
    monkeypatch.setattr(R, "SLAB", 33)
    parts = list(R._slabs(data))
    assert [sum(np.bincount(g, minlength=R.BUCKETS) for g in parts[k::2]).tolist() for k in (0, 1)] == whole.tolist()


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op7_rules"](spark, MEDIUM).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    sums = np.zeros((2, R.BUCKETS))
    for i, t in texts.items():
        data = t.encode()
        for order in R.ORDERS:
            for g in R.gram_buckets(data, order):
                sums[0, g] += 1
                sums[1, g] += good.get(i) == 1
    p = (sums + R.SMOOTH) / (sums + R.SMOOTH).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    for i, t in texts.items():
        s = slow(t)
        grams = np.concatenate([R.gram_buckets(t.encode(), k) for k in R.ORDERS])
        llr = ratio[grams].mean() if len(grams) else 0.0
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*s, failed)
        assert r.llr == pytest.approx(llr, abs=1e-9) and r.kept == (not failed and r.llr >= R.THRESHOLD)
    clean = [i for i, q in good.items() if q == 1 and not got[i].base_failed]
    junk = [i for i, q in good.items() if q == 0]
    assert np.mean([got[i].kept for i in clean]) == 1 and np.mean([got[i].kept for i in junk]) < 0.05


def test_every_trusted_document_counts(spark):
    """More labels than the 20,000 that once were all; the join counts as the broadcast does."""
    n = 21_000
    df = docs(spark, [f"t{i}" for i in range(n)] + ["raw", None, "nul"], [*range(n), n, n, None])
    labels = spark.createDataFrame([(i, 1) for i in range(n)] + [(0, 1), (None, 1), (n, 0), (-1, 1)], "doc_id long, quality int")
    want = np.zeros((2, R.BUCKETS), int)
    for t, k in [(f"t{i}", 2) for i in range(n)] + [("raw", 1), ("nul", 1)]:
        for order in R.ORDERS:
            np.add.at(want, (slice(0, k), R.gram_buckets(t.encode(), order)), 1)
    src = df.select("doc_id", "text")
    for sent in (R.SENT, 5):
        counts = R.count_grams(R.mark_trusted(src, R.trusted_ids(labels), sent)).collect()
        assert {(r.bucket, r.raw, r.target) for r in counts} == {(b, *want[:, b]) for b in np.flatnonzero(want[0])}
    some = df.where("doc_id < 50 or doc_id is null")
    a, b = (sorted(map(str, R.quality_rules(some, labels, sent=k).collect())) for k in (R.SENT, 5))
    assert a == b


def test_odd_rows(spark, tmp_path):
    df = docs(spark, [None, "", "w " * 12, "one two three four five six seven eight nine ten", None], [1, 2, 2, 3, None])
    df = df.selectExpr("*", "1 as raw", "2 as bucket", "true as kept")
    labels = spark.createDataFrame([(3, 1, 0, "x"), (3, 1, 0, "x"), (None, 1, 1, "y"), (9, None, None, "z")],
                                   "doc_id long, quality int, toxic int, text string")
    sf = folder(tmp_path, spark, documents=df, labels=labels)
    rows = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in QUERIES["op7_rules"](spark, sf).collect())
    assert rows == [("1", 0, True, False), ("2", 0, True, False), ("2", 12, True, False), ("3", 10, False, True),
                    ("None", 0, True, False)]
    none = labels.where("false")
    assert [r.llr for r in R.quality_rules(df, none).collect()] == [0.0] * 5
    assert R.quality_rules(docs(spark, []), none).count() == 0
