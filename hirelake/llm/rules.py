"""Quality rules: text statistics with fixed limits, and a hashed n-gram
log-likelihood ratio between trusted texts and the raw corpus.

Byte n-grams of the orders ``ORDERS`` are hashed to ``BUCKETS`` buckets. The
raw multinomial counts every document; the target multinomial counts every
document whose id the labels trust. With add-
``SMOOTH`` smoothing, a document's score is the mean over its n-grams of
``log(target / raw)``; length does not enter. A document is kept if no fixed
rule failed and its score is at least ``threshold``, a constant.

Plan: pass one counts inside each task into two arrays and emits one row per
used bucket, summed in Spark; only the ``BUCKETS`` sums reach the driver. Pass
two scores each document with the table of ratios (fixed size, broadcast).
Up to ``SENT`` trusted ids are broadcast and texts are not shuffled; more mark
their documents in an equi-join on the id, which shuffles the texts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import keyed, stored, text_rows

ORDERS = (2, 4)
BUCKETS = 1 << 16
SMOOTH = 0.5
#: the most trusted ids sent to the tasks (about 70 MB as measured); both ways count the same
SENT = 1_000_000
#: nats per n-gram; a language that is a quarter rarer among the trusted texts costs about 0.3
THRESHOLD = -0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def repeat_words(words: list, window: int = 5) -> int:
    """Words inside windows that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    base, code, size = len(number), ids[:n], len(number)
    for k in range(1, window):
        if size * base >= 1 << 62:  # number the codes anew before they overflow
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max()) + 1
        code, size = code * base + ids[k:n + k], size * base
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    again = times[back] > 1
    diff = np.zeros(len(words) + 1, np.int64)
    diff[:n] += again
    diff[window:window + n] -= again
    return int((np.cumsum(diff)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)``."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return (len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def gram_buckets(data: bytes, order: int) -> np.ndarray:
    """The bucket of each n-gram of ``order`` bytes."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - order + 1
    if n < 1:
        return np.zeros(0, np.int64)
    code = np.full(n, order, np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | raw[k:n + k]
    code *= np.uint64(0x9E3779B97F4A7C15)  # golden-ratio hashing, high bits kept
    return (code >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


#: bytes of a text counted at once
SLAB = 4_000_000


def _slabs(data: bytes):
    for a in range(0, max(1, len(data)), SLAB):
        for order in ORDERS:
            yield gram_buckets(data[a:a + SLAB + order - 1], order)


def mark_trusted(docs: DataFrame, trusted: DataFrame, sent: int = SENT) -> DataFrame:
    """``(good, text)`` per row of ``docs``, ``(doc_id, text)``: whether its id
    is among ``trusted``, a table of distinct ids ``i``."""
    ids, hit = trusted.withColumn("hit", F.lit(True)), F.col("hit").isNotNull().alias("good")
    if trusted.count() <= sent:
        return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("i"), "left").select(hit, "text")
    named = docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("i"), "left").select(hit, "text")
    return named.unionByName(docs.where("doc_id is null").select(F.lit(False).alias("good"), "text"))


def count_grams(docs: DataFrame) -> DataFrame:
    """``(bucket, raw, target)`` summed over all documents. ``docs`` is
    ``(good, text)``; the good ones count for ``target`` too."""

    def run(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                for g in _slabs((text or "").encode()):
                    c = np.bincount(g, minlength=BUCKETS) if len(g) > BUCKETS else None
                    for row in (0, 1)[:1 + t]:
                        if c is None:
                            np.add.at(sums[row], g, 1)
                        else:
                            sums[row] += c
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[0][used]), pa.array(sums[1][used])],
                                         names=["bucket", "raw", "target"])

    made = docs.mapInArrow(run, "bucket int, raw long, target long")
    return made.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The table of ``log(target / raw)``; all zero without trusted texts."""
    sums = np.zeros((2, BUCKETS))
    for r in counts.collect():  # at most BUCKETS rows
        sums[:, r["bucket"]] = r["raw"], r["target"]
    if not sums[1].sum():
        return np.zeros(BUCKETS)
    p = (sums + SMOOTH) / (sums + SMOOTH).sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def text_score(data: bytes, ratios: np.ndarray) -> float:
    total, n = 0.0, 0
    for g in _slabs(data):
        total, n = total + float(ratios[g].sum()), n + len(g)
    return total / n if n else 0.0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids ``i`` labelled as good."""
    good = keyed(labels.where("quality = 1"), "doc_id").select(F.col("doc_id").cast("long").alias("i"))
    return stored(good.where("i is not null").distinct(), "trusted")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, sent: int = SENT) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr, kept)`` per document.

    Cases: a null or empty text has no words, fails the word rule and has
    score 0; without trusted texts every score is 0; repeated rows are counted
    and returned each; a null id is never trusted; an empty table gives no
    rows; other columns are ignored.
    """
    text_rows(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = mark_trusted(src, trusted_ids(labels), sent)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(count_grams(marked)))

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                s = statistics(text)
                bad = base_failed(s[0], s[4])
                llr = text_score(text.encode(), ratios.value)
                rows.append((*s, bad, llr, not bad and llr >= threshold))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    return src.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, base_failed boolean, llr double, kept boolean")
