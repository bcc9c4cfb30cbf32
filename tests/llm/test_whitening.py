import math

import numpy as np
from pyspark.sql import types as T

from hirelake.llm import whitening as W
from hirelake.llm.queries import QUERIES
from tests.llm.util import SF

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("n", T.StringType()), T.StructField("x", T.StringType()),
                     T.StructField("block", T.StringType())])


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "n", "x", "b") for i, v in zip(ids, vectors)], ROWS)


def plain(vectors):
    """x, the fit list's n, sums and falling eigenvalues with their vectors."""
    x = np.array([[math.floor(float(c) * 64) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], v[:, ::-1]


def agrees(rows, vectors, k):
    x, n, s, e, v = plain(vectors)
    want = ((n * x - s) / n) @ v[:, :k] / np.sqrt(e[:k])
    got = np.array([r.whitened for r in rows])
    assert got.shape == want.shape
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-9
    assert [r.deviation for r in rows] == [int(d) for d in ((n * x - s) ** 2).sum(axis=1)]
    assert {r.n for r in rows} == {n} and all(r.identity_error < 1e-9 for r in rows)
    assert np.allclose(rows[0].explained, e[:k] / e.sum(), rtol=1e-9)


def test_query_against_numpy(spark):
    src = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    assert len(rows) == 16 * len(src) and {r.component for r in rows} == set(range(1, 17))
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    order = [r.vec_id for r in src]
    x, n, s, e, v = plain([r.embedding for r in src])
    want = ((n * x - s) / n) @ v[:, :16] / np.sqrt(e[:16])
    got = np.array([[by[i][k + 1].whitened for k in range(16)] for i in order])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    assert [by[i][1].deviation for i in order] == [int(d) for d in ((n * x - s) ** 2).sum(axis=1)]
    assert all(r.identity_error < 1e-9 and r.n == n for r in rows)
    assert np.allclose([by[order[0]][k + 1].explained for k in range(16)], (e / e.sum())[:16], rtol=1e-9)


def test_many_blocks_and_repeats(spark, monkeypatch):
    """Blocks of 16 rows, so that products cross a grid; a third of the rows repeat one vector."""
    monkeypatch.setattr(W, "ROWS", 16)
    monkeypatch.setattr(W, "MEET", 2)
    rng = np.random.default_rng(5)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.normal(3, 2, (400, 6)) * [9, 4, 3, 2, 1, .5]]
    vectors += [vectors[7]] * 200
    rows = W.whiten(table(spark, vectors).repartition(5), components=4).orderBy("vec_id").collect()
    agrees(rows, vectors, 4)


def test_far_offsets_stay_exact(spark):
    """Centred before multiplying: a common offset of 1e9 costs no digits."""
    rng = np.random.default_rng(6)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.integers(-400, 400, (60, 3)) + 2 ** 24]
    rows = W.whiten(table(spark, vectors), components=3).orderBy("vec_id").collect()
    agrees(rows, vectors, 3)


def test_odd_rows(spark):
    bad = [None, [1.0, None], [math.nan, 1.0], [math.inf, 0.0], [1e30, 0.0], [1.0, 2.0, 3.0], []]
    good = [[0.0, 1.0], [2.0, 5.0], [2.0, 5.0], [4.0, -1.0], [-0.001, 0.5]]
    df = table(spark, bad + good, [90, 91, 92, 93, 94, 95, 96, 1, 2, 2, None, 4])
    rows = sorted(W.whiten(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [r.vec_id for r in rows] == [1, 2, 2, 4, None]
    agrees(rows, [good[0], good[1], good[2], good[4], good[3]], 2)


def test_no_variance_no_components(spark):
    one = W.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.whitened, r.n, r.deviation) for r in one] == [([], 1, 0)] * 3
    line = W.whiten(table(spark, [[float(i), float(i)] for i in range(20)])).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in line)
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [None, []])).count() == 0
