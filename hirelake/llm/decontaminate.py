"""Benchmark decontamination with one FM-index per training shard.

The words of a shard's documents form one sequence; each distinct word that
the test phrases use has a symbol, every other word is a gap. A phrase has no
gap, so it can only stand inside a stretch without one; stretches of fewer
words than the shortest phrase are gaps too. What is left, with a separator in
each gap, is indexed whole: suffix array by prefix doubling over words,
Burrows-Wheeler transform, a wavelet tree for ranks, and the suffix array's
entries at every ``SAMPLE``-th text position.

All phrases of the shard are searched backward together, one word a step:
``lo = C[c] + rank(c, lo)``. The occurrences of phrases that are still there
are located by stepping with ``LF`` to a sampled position, mapped back to
their documents, and merged to removal spans of words.

Plan: the phrases (a stated query set) are broadcast in blocks of at most
``BLOCK_WORDS`` words; the documents are scanned once per block and never
shuffled; what leaves a shard is one row per document. Only for a second block
the rows are grouped by document. A shard is closed at ``SHARD_WORDS`` words,
which bounds the memory of a task; a longer document is cut into pieces that
overlap by one phrase less a word, so that no occurrence is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import alnum_words, stored, text_rows

WINDOW = 10
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 4_000_000
SAMPLE = 8


class WaveletTree:
    """Ranks over a sequence of symbols, one bit vector for each binary digit,
    the most significant first; each level is sorted by the digits above."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            seq = seq[np.argsort(bit, kind="stable")]

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            one = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            ones = self.ones[k]
            one = ones[at + 1] != ones[at]
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; the sequence ends with its only smallest symbol."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray):
        """``seq``: symbols of 2 and more, 1 as separator; 0 is put at the end."""
        seq = np.concatenate((seq, [0])).astype(np.int64)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        top = int(seq.max()) + 1
        self.n = len(seq)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top))))
        self.tree = WaveletTree(bwt, max(1, int(top - 1).bit_length()))
        marked = sa % SAMPLE == 0
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.sampled = sa[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array ranges ``[lo, hi)`` of the rows of ``phrases`` (symbols,
        left-aligned); a symbol of -1 is not in the shard."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero(lengths > 0)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[lengths[alive] >= back]
            open_ = alive[lo[alive] < hi[alive]]
            c = phrases[open_, lengths[open_] - back]
            known = (c >= 0) & (c < len(self.first) - 1)
            hi[open_[~known]] = lo[open_[~known]]
            open_, c = open_[known], c[known]
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((lo[open_], hi[open_])))
            lo[open_], hi[open_] = self.first[c] + both[:len(c)], self.first[c] + both[len(c):]
        hi[lengths == 0] = 0
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        out, steps, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            hit = self.marks[at + 1] != self.marks[at]
            done = open_[hit]
            out[done] = self.sampled[self.marks[at[hit]]] + steps[done]
            open_, at = open_[~hit], at[~hit]
            c = self.tree.access(at)
            rows[open_] = self.first[c] + self.tree.rank(c, at)
            steps[open_] += 1
        return out


class Phrases:
    """The test phrases: windows of the items' words. Windows that repeat are
    searched once; ``items`` lists whose they are."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.symbol, index, rows = {}, {}, []
        self.items = []
        for item_id, text in items:
            words = alnum_words((text or "").encode())
            syms = tuple(self.symbol.setdefault(w, len(self.symbol) + 2) for w in words)
            spans = [syms[i:i + window] for i in range(len(syms) - window + 1)] if len(syms) >= window else [syms] if syms else []
            for s in spans:
                at = index.setdefault(s, len(rows))
                if at == len(rows):
                    rows.append(s)
                    self.items.append(set())
                self.items[at].add(item_id)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.full((len(rows), window), -1, np.int64)
        for i, r in enumerate(rows):
            self.rows[i, :len(r)] = r
        self.shortest = int(self.lengths.min(initial=window))


def stretches(syms: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of non-zero symbols that are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], syms != 0, [0])).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    long_ = b - a >= shortest
    return a[long_], b[long_]


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[np.ndarray, set]]:
    """Per document (its symbols, 0 for a gap) the hit marks of its words and
    the items with occurring windows."""
    out = [(np.zeros(0, bool), set()) for _ in docs]
    seqs, where, of = [], [], []
    for d, syms in enumerate(docs):
        for a, b in zip(*(x.tolist() for x in stretches(syms, phrases.shortest))):
            seqs += [syms[a:b], np.ones(1, np.int64)]
            where.append(np.arange(a, b + 1))
            of.append(np.full(b + 1 - a, d))
    if not seqs or not len(phrases.lengths):
        return out
    where, of = np.concatenate(where), np.concatenate(of)
    index = FMIndex(np.concatenate(seqs))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return out
    n = (hi - lo)[found]
    which = np.repeat(found, n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[found], n)
    at = index.locate(rows)
    order = np.argsort(of[at], kind="stable")
    at, which = at[order], which[order]
    cuts = np.flatnonzero(np.diff(of[at])) + 1
    for p, w in zip(np.split(at, cuts), np.split(which, cuts)):
        d = int(of[p[0]])
        # removal spans: +1 where an occurrence begins, -1 after its end
        diff = np.zeros(len(docs[d]) + 1, np.int64)
        np.add.at(diff, where[p], 1)
        np.add.at(diff, where[p] + phrases.lengths[w], -1)
        out[d] = (np.cumsum(diff[:-1]) > 0, set().union(*(phrases.items[i] for i in np.unique(w))))
    return out


def _in_shards(pieces: list[np.ndarray], phrases: Phrases, shard_words: int):
    """``search_shard`` over shards of bounded size, in order."""
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end]) <= shard_words):
            size, end = size + len(pieces[end]), end + 1
        yield from search_shard(pieces[at:end], phrases)
        at = end


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


_OUT = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _scan(docs: DataFrame, block, window: int, shard_words: int, keep: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        ("items", pa.list_(pa.string()))] + ([("text", pa.string())] if keep else []))

    def run(batches):
        phrases = Phrases(block.value, window)
        get, rows, held = phrases.symbol.get, [], 0

        def flush():
            pieces, owner = [], []
            for i, r in enumerate(rows):
                # a long document goes in overlapping pieces, each a sequence of its own
                for a in range(0, max(1, len(r[1])), shard_words):
                    pieces.append(r[1][a:a + shard_words + window - 1])
                    owner.append((i, a))
            hits = [np.zeros(len(r[1]), bool) for r in rows]
            items = [set() for _ in rows]
            for (i, a), (hit, own) in zip(owner, _in_shards(pieces, phrases, shard_words)):
                hits[i][a:a + len(hit)] |= hit
                items[i] |= own
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                 pa.array([_spans(h) for h in hits], schema.field("spans").type),
                 pa.array([sorted(map(str, x)) for x in items], schema.field("items").type)]
                + ([pa.array([r[2] for r in rows], pa.string())] if keep else []), schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = alnum_words((text or "").encode())
                rows.append((doc_id, np.fromiter((get(w, 0) for w in words), np.int64, len(words)), text if keep else None))
                held += len(words)
                if held >= shard_words:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return docs.mapInArrow(run, _OUT + (", text string" if keep else ""))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS):
    """The items in blocks of bounded size, as lists of (id, text). Text that
    holds fewer words than its length allows is counted by its length."""
    block, size = [], 0
    for r in items.select(F.col(id_col), F.col(text_col)).toLocalIterator(prefetchPartitions=True):
        n = len(r[1] or "") // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` per document: merged spans of hit
    words (first and last word, from 0) and the ids of the items found, sorted
    as strings.

    Cases: null and empty texts have no words and no hits; an item without
    words finds nothing; an empty items table gives every document clean; rows
    that repeat come back as often (with more than one block of items, rows
    are told apart by a row key); other columns are ignored.
    """
    spark = docs.sparkSession
    text_rows(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for block in item_blocks(items, item_col, item_text, block_words):
        parts.append(spark.sparkContext.broadcast(block))
    if len(parts) <= 1:
        return _scan(src, parts[0] if parts else spark.sparkContext.broadcast([]), window, shard_words, "")
    found = None
    for p in parts:
        one = _scan(src, p, window, shard_words, "text")
        found = one if found is None else found.unionByName(one)
    # equal rows have equal results, so they may share a group: their number is divided out
    per = found.groupBy("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"), "n_words").agg(
        (F.count("*") / len(parts)).cast("int").alias("times"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return per.select("doc_id", "n_words", merged(F.col("spans")).alias("spans"), "items",
                      F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a window of an item. The rows keep
    all their columns; null and empty texts stay."""
    spark = docs.sparkSession
    text_rows(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, "item_id", "text")]
    out = docs
    for block in blocks:  # each block of items takes out what it finds
        out = _without_hits(out, block, window, shard_words)
    return out


def _without_hits(docs: DataFrame, block, window: int, shard_words: int) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches):
        phrases = Phrases(block.value, window)
        get = phrases.symbol.get
        for b in batches:
            pieces, owner, clean = [], [], np.ones(b.num_rows, bool)
            for i, text in enumerate(b.column(at).to_pylist()):
                words = alnum_words((text or "").encode())
                syms = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
                for a in range(0, max(1, len(syms)), shard_words):
                    pieces.append(syms[a:a + shard_words + window - 1])
                    owner.append(i)
            for i, (hit, _) in zip(owner, _in_shards(pieces, phrases, shard_words)):
                clean[i] &= not hit.any()
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def merged(spans):
    """Sorted spans with those that touch or overlap joined."""
    kind = "array<struct<first:long,last:long>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= s["first"] - 1),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["first"],
            F.greatest(F.try_element_at(acc, F.lit(-1))["last"], s["last"])).cast(kind[6:-1])))
    ).otherwise(F.concat(acc, F.array(s))))
