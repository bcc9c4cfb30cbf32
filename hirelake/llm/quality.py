"""Quality classifier: a generalised additive model with pairwise terms.

Each text gives ``FEATURES`` numbers. Their quantile bins index lookup tables:
one per feature, and one per chosen pair of features on coarser bins. The
tables are learned by cyclic boosting on the log-loss: in each round every
feature in turn gets a shallow tree (two levels of cuts over its bins) fitted
to the current gradients, and its leaves, times the learning rate, are added
to the feature's table. Then the residuals choose the pairs with the largest
gain of a four-quadrant tree, and their tables are boosted the same way.
Scoring adds one table entry per term to the intercept: vectorised look-ups.

Plan: labelled rows for training are at most ``most`` (a parameter), those
with the smallest hash; their ids are joined to the documents by a broadcast
of that bounded size, and only their feature rows reach the driver, where the
tables (a few kilobytes) are fitted. Scoring is one scan of all whole texts
without a shuffle. Doc_id, language, source and labels are never features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import text_rows

MOST = 20_000
CUT = 0.7

FEATURES = [
    "log_words", "word_length", "unique_words", "same_as_before", "same_as_two_before", "top_word",
    "upper_letters", "first_upper_words", "all_upper_words", "digits", "symbols", "bangs", "bars", "commas", "stops",
    "tail_symbol_words", "bare_symbol_words", "blanks", "short_words", "long_words", "log_lines", "line_words",
    "dup_lines", "ended_lines", "empty_lines", "other_script_bytes", "byte_entropy", "log_bytes",
]

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 stop mark
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[list(b"#*$%&|<>!@^~=+_{}[]\\/")] = 4
_KIND[list(b".,;:?'\"()-")] = 5


def text_features(text: str) -> list[float]:
    """The numbers of one whole text; an empty text gives zeros."""
    data = text.encode()
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [float(np.log1p(size))]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by = np.bincount(_KIND, weights=counts, minlength=6)
    letters = max(1.0, by[1] + by[2])
    lengths = np.fromiter(map(len, words), np.int64, n)
    times: dict = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    joined = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    first, last = _KIND[joined[ends - lengths]], _KIND[joined[ends - 1]]
    low = np.add.reduceat((_KIND[joined] == 2).astype(np.int64), ends - lengths)
    up = np.add.reduceat((_KIND[joined] == 1).astype(np.int64), ends - lengths)
    marks = np.add.reduceat((_KIND[joined] == 4).astype(np.int64), ends - lengths)
    lines = [x.strip() for x in data.split(b"\n")]
    full = [x for x in lines if x]
    p = counts[counts > 0] / size
    return [
        float(np.log1p(n)), float(lengths.mean()), len(times) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(a == b for a, b in zip(words, words[2:])) / n,
        max(times.values()) / n,
        float(by[1] / letters), float((first == 1).mean()), float(((up > 0) & (low == 0)).mean()),
        float(by[3] / size), float(by[4] / size), float(counts[33] / n), float(counts[124] / n),
        float(counts[44] / n), float(counts[46] / n),
        float(((last == 4) & (marks < lengths)).mean()), float((marks == lengths).mean()),
        float((size - len(joined)) / size), float((lengths <= 2).mean()), float((lengths >= 12).mean()),
        float(np.log1p(len(full))), n / max(1, len(full)), 1 - len(set(full)) / max(1, len(full)),
        sum(x[-1:] in b".!?" for x in full) / max(1, len(full)), 1 - len(full) / len(lines),
        float(counts[128:].sum() / size), float(-(p * np.log2(p)).sum()), float(np.log1p(size)),
    ]


def feature_rows(texts: list) -> np.ndarray:
    return np.array([text_features(t or "") for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Intercept, bin edges, one table per feature, pairs with their tables."""

    intercept: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (i, j, coarse of i, coarse of j, table)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for f, e in enumerate(self.edges):
            out[:, f] = np.searchsorted(e, x[:, f], side="right")
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by adding bins."""
        total = np.full(len(x), self.intercept)
        if self.tables and len(x):
            b = self.bins(x)
            for f, t in enumerate(self.tables):
                total += t[b[:, f]]
            for i, j, ci, cj, t in self.pairs:
                total += t[ci[b[:, i]], cj[b[:, j]]]
        return 1.0 / (1.0 + np.exp(-total))


def _value(g, h, ridge):
    return g / (h + ridge)


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best place to cut a run of bins, 0 for none, and its gain."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(cg, ch, ridge) + _gain(g.sum() - cg, h.sum() - ch, ridge) - _gain(g.sum(), h.sum(), ridge)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-12 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Leaf value per bin of a tree with two levels of cuts."""
    out = np.zeros(len(g))
    _, top = _cut(g, h, ridge)
    for a, b in ((0, top), (top, len(g))):
        if a == b:
            continue
        _, k = _cut(g[a:b], h[a:b], ridge)
        for c, d in ((a, a + k), (a + k, b)):
            if c < d:
                out[c:d] = _value(g[c:d].sum(), h[c:d].sum(), ridge)
    return out


def quadrant_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best tree on a grid: one cut of the rows, one of the columns on
    each side. Returns the leaf values on the grid and the gain."""
    best, out = 0.0, np.zeros_like(g)
    for top in range(1, len(g)):
        gain, leaves = -_gain(g.sum(), h.sum(), ridge), []
        for part in (slice(0, top), slice(top, None)):
            pg, ph = g[part].sum(axis=0), h[part].sum(axis=0)
            more, k = _cut(pg, ph, ridge)
            gain += more + _gain(pg.sum(), ph.sum(), ridge)
            leaves += [(part, s, _value(pg[s].sum(), ph[s].sum(), ridge)) for s in (slice(0, k), slice(k, None))]
        if gain > best + 1e-12:
            best, out = gain, np.zeros_like(g)
            for part, s, v in leaves:
                out[part, s] = v
    return out, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 64, n_pairs: int = 6,
        grid: int = 8, ridge: float = 1.0) -> Model:
    """Cyclic boosting. Without both labels the model is the smoothed share of
    label 1 alone."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, s in enumerate(sizes):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b[:, f], g, s), np.bincount(b[:, f], h, s), ridge)
            model.tables[f] += step
            total += step[b[:, f]]
    coarse = [np.arange(s) * min(grid, s) // s for s in sizes]
    cb = [coarse[f][b[:, f]] for f in range(len(sizes))]

    def cell(i, j, w):
        return np.bincount(cb[i] * grid + cb[j], w, grid * grid).reshape(grid, grid)

    g, h = slopes()
    gains = sorted(((quadrant_tree(cell(i, j, g), cell(i, j, h), ridge)[1], i, j)
                    for i in range(len(sizes)) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((grid, grid))) for gain, i, j in gains if gain > 0]
    for _ in range(rounds // 2):
        for i, j, _, _, t in model.pairs:
            g, h = slopes()
            step = rate * quadrant_tree(cell(i, j, g), cell(i, j, h), ridge)[0]
            t += step
            total += step[cb[i], cb[j]]
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents that are not
    held out. An id with contradicting labels counts as the larger one."""
    text_rows(docs.sparkSession)
    one = (labels.where("doc_id is not null and quality is not null")
           .groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("quality").cast("int").alias("y")))
    ids = one.where(~held_out(F.col("i"))).orderBy(F.xxhash64("i"), "i").limit(most)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = src.join(F.broadcast(ids), F.col("doc_id") == F.col("i")).select("doc_id", "y", "text")  # at most `most` ids

    def run(batches):
        for b in batches:
            x = feature_rows(b.column(2).to_pylist())
            cells = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, x array<double>").dropDuplicates(["doc_id"]).collect()
    got.sort()
    return (np.array([r["x"] for r in got], np.float64).reshape(-1, len(FEATURES)),
            np.array([float(r["y"]) for r in got]))


def quality_scores(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``(doc_id, score, predicted)`` per row.

    Cases: null and empty texts are scored with zero features; repeated rows
    and null ids come back as they are; an empty table gives no rows; other
    columns are ignored.
    """
    text_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.scores(feature_rows(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, score double, predicted int")


def classifier(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    return fit(*training_rows(docs, labels, most))


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns, also
    ones named ``score`` or ``predicted``, come back as they are."""
    text_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(feature_rows(b.column(at).to_pylist())) >= cut))

    return docs.mapInArrow(run, docs.schema)
