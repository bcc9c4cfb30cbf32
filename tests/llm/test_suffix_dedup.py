import hashlib
import random

import numpy as np
import pytest

from hirelake.llm import suffix_dedup as S
from hirelake.llm.queries import QUERIES
from tests.llm.util import docs

SMALL = "/root/testdata/sf0.01"


def slow(texts):
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for d in data:
        for i in range(len(d) - S.LENGTH + 1):
            k = d[i:i + S.LENGTH]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i:i + S.LENGTH]] > 1:
                gone[i] += 1
                gone[i + S.LENGTH] -= 1 if i + S.LENGTH < len(gone) else 0
        hit = np.cumsum(gone)[:len(d)] > 0
        runs = int((np.diff(np.concatenate(([0], hit.astype(np.int8)))) == 1).sum())
        left = bytes(b for b, h in zip(d, hit) if not h)
        out.append((len(d), int(hit.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.choice([60, 75, 85, 95, 130, 300])) for _ in range(8)]
    out = [None, "", "x", "y" * 399, "y" * 400, "y" * 401, "ab" * 300, "abc" * 500, prose(40)]
    for _ in range(60):
        parts = [rng.choice([prose(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:  # a small change inside
            p = rng.randrange(len(parts))
            at = rng.randint(0, len(parts[p]))
            parts[p] = parts[p][:at] + "#" + parts[p][at + 1:]
        out.append(rng.choice(["", " "]).join(parts))
    out += [out[-1], out[-2], out[-1]]
    return out


def got(df):
    return [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed,group,slab", [(1, 8000, 1 << 20), (2, 2, 1 << 20), (3, 8000, 1500)])
def test_against_brute_force(spark, monkeypatch, seed, group, slab):
    """group=2 sends every larger group through the rows that Spark sums; a
    small slab cuts documents into pieces (tasks see the default, so the
    sampling is compared here)."""
    t = texts(seed)
    data = [(x or "").encode() for x in t]
    whole = sorted((int(i), int(p), int(o), int(k)) for part in S._samples(data) for i, p, o, k in zip(*part))
    cut = sorted((int(i), int(p), int(o), int(k)) for part in S._samples(data, slab) for i, p, o, k in zip(*part))
    assert cut == whole
    df = docs(spark, t).repartition(3).selectExpr("*", "1 as own", "2 as block", "3 as spans")
    assert got(S.remove_repeats(df, block_rows=16, group=group)) == slow(t)


def test_every_string_has_a_sample():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 100, 5000, dtype=np.uint8)
    raw[2000:2600] = raw[100:700]
    x, own, _ = S.sample(raw, np.array([0]), np.array([5000]))
    for i in range(5000 - S.LENGTH + 1):
        assert ((x >= i) & (x + S.BLOCK <= i + S.LENGTH)).any()
    near = dict(zip(x.tolist(), own.tolist()))
    inner = [p for p in range(300, 300 + 1) if p in near]
    assert all(near.get(p + 1900) == near[p] for p in inner)


def test_query_against_brute_force(spark):
    rows = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)
    out = sorted(QUERIES["op3_suffix_dedup"](spark, SMALL).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in out] == [r.doc_id for r in rows]
    assert [tuple(r)[1:] for r in out] == slow([r.text for r in rows])


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 23) + chr(97 + i // 23 % 19) for i in range(300))
    df = docs(spark, [long, long, None, "", long], [1, 1, 2, None, None])
    rows = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in S.remove_repeats(df).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert rows == [("1", 600, 600, empty)] * 2 + [("2", 0, 0, empty), ("None", 0, 0, empty), ("None", 600, 600, empty)]
    assert S.remove_repeats(docs(spark, [])).count() == 0
