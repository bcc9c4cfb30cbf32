import hashlib
import random
import re

import numpy as np
import pytest

from hirelake.llm import decontaminate as D
from hirelake.llm.queries import QUERIES
from tests.llm.util import SF, docs, folder


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(texts, items, k=10):
    wins = {}
    for item, t in items:
        w = words(t)
        for g in ([tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []):
            wins.setdefault(g, set()).add(item)
    out = {}
    for d, t in texts:
        w, hit, own = words(t), set(), set()
        for n in {len(g) for g in wins}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in wins:
                    hit |= set(range(i, i + n))
                    own |= wins[g]
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit))
    return out


def test_wavelet_tree_ranks_and_access():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 500)
    tree = D.WaveletTree(seq, 6)
    c, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert tree.rank(c, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(c, at)]
    assert tree.access(np.arange(500)).tolist() == seq.tolist()


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    seq = np.concatenate((rng.integers(2, 5, 400), [1], np.tile([2, 3], 100), [1]))
    index = D.FMIndex(seq)
    phrases = np.array([rng.integers(2, 6, 4) for _ in range(60)] + [[2, 3, 2, 3]])
    lengths = np.array([int(x) for x in rng.integers(1, 5, 60)] + [4])
    for p, n in zip(phrases, lengths):
        lo, hi = index.search(p[None, :], np.array([n]))
        got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert got == [i for i in range(len(seq) - n + 1) if seq[i:i + n].tolist() == p[:n].tolist()]


def test_suffix_array_is_sorted():
    seq = np.concatenate((np.random.default_rng(3).integers(1, 3, 300), [0]))
    sa = D.suffix_array(seq)
    tails = [seq[i:].tolist() for i in sa]
    assert tails == sorted(tails)


def planted():
    rng = random.Random(7)
    vocab = ["a", "b", "c", "Dog", "é", "12"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 14])))) for i in range(8)]
    items += [(90, None), (91, "..."), (92, items[0][1].upper())]
    texts = [None, "", "!!"]
    for _ in range(60):
        t = [rng.choice(vocab + ["zz", "yy"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(t))
            t[at:at] = [(rng.choice(items)[1] or "").replace(" ", rng.choice([" ", "-", ", "]))]
        texts.append(rng.choice([" ", "\n", " . "]).join(t))
    return list(enumerate(texts)), items


def got(found):
    out = {}
    for r in found.collect():
        hits = sum(s["last"] - s["first"] + 1 for s in r["spans"])
        out[r.doc_id] = (r.n_words, hits, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), hits > 0)
    return out


@pytest.mark.parametrize("shard,block", [(2_000_000, 4_000_000), (13, 4_000_000), (2_000_000, 12)])
def test_against_brute_force(spark, shard, block):
    """Small shards cut documents into pieces; small blocks search in rounds."""
    texts, items = planted()
    found = D.find_contamination(docs(spark, [t for _, t in texts]), spark.createDataFrame(items, "item_id long, text string"),
                                 shard_words=shard, block_words=block)
    assert got(found) == slow(texts, items)


def test_query_against_brute_force(spark):
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_decontaminate"](spark, SF).collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows == slow(texts, items) and any(r[4] for r in rows.values())


def test_odd_rows(spark, tmp_path):
    empty_items = spark.createDataFrame([], "item_id long, text string")
    df = docs(spark, ["a b", None, "a b", "a b"], [1, 2, 1, None]).selectExpr("*", "1 as items", "2 as spans")
    assert [r.n_words for r in D.find_contamination(df, empty_items).collect()] == [2, 0, 2, 2]
    items = spark.createDataFrame([(5, "a b", 1), (None, "B", 2)], "item_id long, text string, doc_id int")
    for block in (4_000_000, 1):
        rows = D.find_contamination(df, items, block_words=block).collect()
        assert sorted(str((r.doc_id, len(r["items"]))) for r in rows) == ["(1, 2)", "(1, 2)", "(2, 0)", "(None, 2)"]
    assert D.find_contamination(docs(spark, []), items).count() == 0
    sf = folder(tmp_path, spark, documents=df, benchmark=items)
    assert QUERIES["op4_decontaminate"](spark, sf).count() == 4
