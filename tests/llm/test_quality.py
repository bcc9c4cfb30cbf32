import zlib

import numpy as np
import pytest

from hirelake.llm import quality as Q
from hirelake.llm.queries import QUERIES
from tests.llm.util import docs, folder

MEDIUM = "/root/testdata/sf0.1"


def test_shallow_tree_fits_steps():
    g = np.array([1.0] * 5 + [-2.0] * 7 + [3.0] * 4)
    got = Q.shallow_tree(g, np.ones(16), ridge=0.0)
    assert np.allclose(got, g)


def test_quadrant_tree_finds_an_interaction():
    g = np.outer([1.0, 1, -1, -1], [1.0, -1, -1, -1])
    tree, gain = Q.quadrant_tree(g, np.ones((4, 4)), ridge=1e-9)
    assert np.allclose(tree, g) and gain > 0


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(Q.FEATURES)))
    x[:, 0], x[:, 1] = rng.random(4000), rng.random(4000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone = ((Q.fit(x, y, n_pairs=0).scores(x) > 0.5) == y).mean()
    pairs = ((Q.fit(x, y).scores(x) > 0.5) == y).mean()
    assert alone < 0.65 and pairs > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((500, len(Q.FEATURES)))
    m = Q.fit(x, (x[:, 3] + x[:, 4] > 1).astype(float), rounds=10)
    row, total = x[7], m.intercept
    place = [sum(e <= v for e in edges) for v, edges in zip(row, m.edges)]
    total += sum(t[p] for t, p in zip(m.tables, place))
    total += sum(t[ci[place[i]], cj[place[j]]] for i, j, ci, cj, t in m.pairs)
    assert m.scores(x)[7] == pytest.approx(1 / (1 + np.exp(-total)))


def test_query_on_held_out_labels(spark):
    rows = QUERIES["op2_quality"](spark, MEDIUM).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.98
    assert np.mean([r.predicted for r in test if truth[r.doc_id] == 1]) > 0.99


def test_training_never_sees_held_out_rows(spark, tmp_path):
    """Turning the labels of held-out rows changes no score."""
    from pyspark.sql import functions as F
    src = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    turned = src.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.classifier(d, src), Q.classifier(d, turned)
    assert a.intercept == b.intercept and all((s == t).all() for s, t in zip(a.tables, b.tables))
    assert len(Q.training_rows(d, src, most=50)[1]) == 50


def test_odd_rows(spark, tmp_path):
    df = docs(spark, [None, "", "some words", "some words", "x"], [1, 2, 3, 3, None])
    df = df.selectExpr("*", "0.5 as score", "'q' as predicted", "4 as y", "5 as i")
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (3, 0, "c"), (3, 0, "c"), (None, 1, "d"), (4, None, "e")],
                                   "doc_id long, quality int, text string")
    sf = folder(tmp_path, spark, documents=df, labels=labels)
    rows = QUERIES["op2_quality"](spark, sf).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "3", "None"]
    assert all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in Q.quality_scores(df, Q.classifier(df, none)).collect()} == {0.5}
    kept = Q.accepted(df, labels)
    assert kept.columns == df.columns and kept.count() <= 5
    every = Q.accepted(df, labels, cut=0.0).collect()
    assert len(every) == 5 and {(str(r.score), r.predicted, r.y, r.i) for r in every} == {("0.5", "q", 4, 5)}
    empty = docs(spark, [])
    assert Q.quality_scores(empty, Q.classifier(empty, labels)).count() == 0 and Q.accepted(empty, none).count() == 0
