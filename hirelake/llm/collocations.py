"""Collocations by prefix-free parsing.

A document is a run of tokens: its words, and one mark where a piece ends. The
text itself says where chunks end: after each pair of tokens whose hash is 0
modulo ``EVERY``. A chunk starts with the last ``longest - 1`` tokens before
it, so that every phrase lies whole in the chunk in which it ends; only phrases
that end behind that overlap are counted there, each occurrence thus once.
Equal passages parse alike wherever they stand, so the dictionary of distinct
chunks holds copies once, with the frequency of the parse.

Phrases are counted inside the distinct chunks, weighted by that frequency, in
three passes: words, pairs, then three words and more. A phrase of ``f >= least``
has only parts that are as frequent, so a pass skips phrases with a part
outside the results before. Those results are asked through a Bloom filter of
fixed size (``BITS``): it never denies a frequent part, and what it lets through
by chance is counted like the rest and dropped by its count. Counts are exact
at any size; far beyond a tenth of ``BITS`` frequent phrases only the saving
fades.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import LOWER, byte_strings, stored, text_rows

#: mean tokens from one chunk's end to the next
EVERY = 24
#: the token between pieces; no word holds it
MARK = b"."
#: bits of the filter of frequent phrases: 8 MB, whatever the corpus
BITS = 1 << 26
#: bytes of chunks whose phrases a task counts at once
SLAB = 16 << 20
#: floor(2000000 * a / (l + r)) in decimals: the product may pass 64 bits
SCORE = ("cast((cast(a as decimal(20,0)) * 2000000) div "
         "(cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
_PIECES = re.compile(rb"[.,;:!?\n-\r][.,;:!?\n-\r \t]*")


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, ``MARK`` between pieces."""
    return _PIECES.sub(b" . ", (text or "").encode().translate(LOWER)).split()


def parse(toks: list[bytes], overlap: int) -> list[tuple[int, int, int]]:
    """Chunks ``(begin, new, end)`` of the tokens: what it shares with the chunk
    before reaches from ``begin`` to ``new``."""
    if not toks:
        return []
    h = np.fromiter(map(crc32, toks), np.uint64, len(toks))
    pair = h.copy()
    pair[1:] += h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ends = (np.flatnonzero((pair >> np.uint64(33)) % np.uint64(EVERY) == 0) + 1).tolist()
    if not ends or ends[-1] != len(toks):
        ends.append(len(toks))
    return [(max(0, a - overlap), a, b) for a, b in zip([0, *ends], ends)]


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4) -> DataFrame:
    """``(lang, chunk, seen, times)``: the distinct chunks, tokens joined by
    blanks, of which the first ``seen`` are overlap, and how often each occurs."""
    text_rows(docs.sparkSession)

    def run(batches):
        for b in batches:
            langs, chunks, seen = [], [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                toks = tokens(text)
                for begin, new, end in parse(toks, longest - 1):
                    langs.append(lang)
                    chunks.append(b" ".join(toks[begin:end]))
                    seen.append(new - begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(seen, pa.int32())],
                names=["lang", "chunk", "seen"])

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    found = docs.select(lang, F.col(text_col).alias("text")).mapInArrow(run, "lang string, chunk string, seen int")
    return found.groupBy("lang", "chunk", "seen").agg(F.count("*").alias("times"))


def _hashes(lang: str, words) -> np.ndarray:
    head = lang.encode() + b"\x00"
    return np.array([xxhash.xxh64_intdigest(head + w) for w in words], np.uint64)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last, and the last one's."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return h ^ (h >> np.uint64(29))


def frequent_filter(phrases: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bits of the given phrases, packed; ``bits / 8`` bytes."""
    def run(batches):
        for b in batches:
            at = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _hashes(lang, phrase.encode().split(b" "))
                for i in range(1, len(h)):
                    h[i:i + 1] = _longer(h[i - 1:i], h[i:i + 1])
                at.append(int(h[-1]) % bits)
            at = np.unique(np.array(at, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)),
                                              pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))],
                                             names=["slot", "bits"])

    slots = phrases.select("lang", "phrase").mapInArrow(run, "slot int, bits long")
    found = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words.view(np.uint8)


def _count(sizes: tuple[int, ...], known, slab: int):
    """A task that counts the phrases of the given sizes. ``known`` is the
    broadcast filter over the frequent words, and for three words and more
    over the frequent pairs too."""
    def emit(lang, rows):
        lists = pc.split_pattern(rows.column("chunk").combine_chunks(), " ")
        lengths = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        first = np.cumsum(lengths) - lengths
        idx = np.arange(len(ids))
        new = idx - np.repeat(first, lengths) >= np.repeat(rows.column("seen").to_numpy(), lengths)
        weight = np.repeat(rows.column("times").to_numpy(), lengths)
        stop = ids == words.index(MARK.decode()).as_py()
        if max(sizes) == 1:
            yield out(lang, words, [], ids[~stop], np.flatnonzero(~stop), new, weight)
            return
        h = of_word = _hashes(lang, byte_strings(words))
        stop |= ~_known(h)[ids]  # words that are not frequent end a run
        run = idx - np.maximum(np.maximum.accumulate(np.where(stop, idx, -1)), np.repeat(first, lengths) - 1)
        # of each distinct phrase of a size: the shorter phrase in front and the last word
        code, levels = ids, []
        for size in range(2, max(sizes) + 1):
            ends = np.flatnonzero(run >= size)
            distinct, which = np.unique(code[ends - 1] * len(words) + ids[ends], return_inverse=True)
            before, last = distinct // len(words), distinct % len(words)
            h = _longer(h[before], of_word[last])
            levels.append((before, last))
            code = np.full(len(ids), -1, np.int64)
            code[ends] = which
            if size in sizes:
                yield out(lang, words, levels, which, ends, new, weight)
            elif size == min(sizes) - 1:  # pairs that are not frequent end a run of pairs
                bad = np.zeros(len(ids), bool)
                bad[ends] = ~_known(h)[which]
                # the next run may begin with the second word of such a pair
                run = np.minimum(run, idx - np.maximum.accumulate(np.where(bad, idx, -1)) + 1)

    def out(lang, words, levels, which, ends, new, weight):
        counted = new[ends]
        at, w = which[counted], weight[ends[counted]]
        n = len(levels[-1][0]) if levels else len(words)
        if w.sum() < 1 << 53:  # sums of doubles are exact up to there
            sums = np.bincount(at, weights=w, minlength=n).astype(np.int64)
        else:
            sums = np.zeros(n, np.int64)
            np.add.at(sums, at, w)
        at = some = np.flatnonzero(sums)
        parts = []
        for before, last in levels[::-1]:
            parts.append(words.take(pa.array(last[at])))
            at = before[at]
        parts.append(words.take(pa.array(at)))
        phrase = pc.binary_join_element_wise(*parts[::-1], " ") if levels else parts[0]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(some)), phrase, pa.array(sums[some])],
                                          names=["lang", "phrase", "a"])

    def _known(h):
        at = h % np.uint64(8 * len(known.value))
        return (known.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(1))).as_py() or 0
            if size >= slab:
                yield from each_lang(held)
                held, size = [], 0
        if held:
            yield from each_lang(held)

    def each_lang(batches):
        rows = pa.Table.from_batches(batches)
        for lang in pc.unique(rows.column("lang")).to_pylist():
            yield from emit(lang, rows.filter(pc.equal(rows.column("lang"), lang)))

    return run


def phrase_counts(docs: DataFrame, least: int, longest: int = 4, text_col: str = "text",
                  lang_col: str = "lang", bits: int = BITS, slab: int = SLAB) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, a)`` of all phrases of 1 to ``longest`` words that occur
    ``least`` times in their lang, and ``(lang, n)``, all its words."""
    sc = docs.sparkSession.sparkContext
    chunks = stored(dictionary(docs, text_col, lang_col, longest), "phrase-chunks")

    def counted(sizes, known):
        found = chunks.mapInArrow(_count(sizes, known, slab), "lang string, phrase string, a long")
        return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))

    words = stored(counted((1,), None), "phrase-words")
    levels = [words.where(F.col("a") >= least)]
    for sizes in [(2,), tuple(range(3, longest + 1))][:max(0, longest - 1)]:
        asked = levels[0] if sizes == (2,) else levels[0].unionByName(levels[1])
        known = sc.broadcast(frequent_filter(asked, bits))
        levels.append(stored(counted(sizes, known).where(F.col("a") >= least), "phrases"))
        known.unpersist()
    all_levels = levels[0]
    for x in levels[1:]:
        all_levels = all_levels.unionByName(x)
    return all_levels, words.groupBy("lang").agg(F.sum("a").alias("n"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int | None = 2000,
                 text_col: str = "text", lang_col: str = "lang", bits: int = BITS, slab: int = SLAB) -> DataFrame:
    """``(lang, rank, phrase, cut, a, l, r, n, score)``: each lang's ``top``
    phrases of 2 to ``longest`` words that occur ``least`` times, cut where their
    parts bind least, ``score = floor(2000000 * a / (l + r))``; phrases that
    mostly stand inside a longer one are dropped.

    Cases: a null text is empty, a null lang is ``und`` (and joins rows whose
    lang is ``und``); repeated rows count each; ties go by count, then by the
    phrase's bytes; an empty table, or one without a phrase that frequent,
    gives no rows; other columns are ignored.
    """
    counts, totals = phrase_counts(docs, least, longest, text_col, lang_col, bits, slab)
    counts = stored(counts.withColumn("k", F.size(F.split("phrase", " "))), "phrase-counts")
    long_ones = counts.where("k >= 2")
    words = F.split("phrase", " ")

    def part(begin, size):
        return F.array_join(F.slice(words, begin, size), " ")

    # each cut of each phrase asks for the counts of its two parts
    asks = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.array(
        F.struct(c.alias("cut"), F.lit(0).alias("side"), part(F.lit(1), c).alias("part")),
        F.struct(c.alias("cut"), F.lit(1).alias("side"), part(c + 1, F.col("k") - c).alias("part")))))
    asked = long_ones.select("lang", "phrase", "a", F.explode(asks).alias("ask")).select("lang", "phrase", "a", "ask.*")
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    sides = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    weakest = sides.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.*")
    # the most frequent longer phrase around each shorter one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: part(at, size))))
    around = long_ones.where("k >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("outer"))
    around = around.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    hidden = F.col("outer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * 80
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.coalesce(~hidden, F.lit(True))).drop("outer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # first within shares of a lang, so that no lang meets in one task whole
        share = F.pmod(F.xxhash64("phrase"), F.lit(64))
        best = F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))
        kept = kept.withColumn("best", best).where(F.col("best") <= top).drop("best")
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        kept = kept.where(F.col("rank") <= top)
    else:
        kept = kept.withColumn("rank", F.lit(None).cast("long"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "cut", "a", "l", "r", "n", "score")
