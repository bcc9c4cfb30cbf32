"""SentencePiece encoding over a relational lattice, and decoding.

Words start at the blank's mark; they are cut further between characters that
stand side by side in no piece of the table, because no token can cross such a
place. Each distinct word part is encoded once for the whole table:

    explode   all substrings up to the longest piece that begins like them
    join      with the piece table on equality (a vocabulary: bounded, broadcast)
    group     the found edges by word part, in the order of their scores
    fold      with a Spark higher-order aggregate over the edges

What is folded depends on the model file. Scores of a unigram model are log
probabilities, and the fold is Viterbi's. Scores of a BPE model are merge
ranks, whose best-scoring path is not what the library returns; there the fold
walks the edges by rank and merges two neighbours wherever an edge's two parts
stand side by side. A part's borders are bits of a number, so one step is a
mask and a comparison. Each piece of such a table has one derivation, with
ranks that rise towards the piece (checked when the table is loaded); hence
one walk gives what a priority queue would.

Plan: one scan notes the distinct word parts of each block of rows; a join on
the parts carries their borders back to the blocks that use them, one file a
block in the shared folder; a second scan of the same rows cuts the words there
and looks the pieces up. Texts are never shuffled, and a task holds the parts
of one block. Parts over ``MAX_PART`` characters have no bit mask, and runs of
blanks have pieces of equal score; both are merged in the second scan by a
queue in the same order. A part that is a piece needs nothing, and characters
without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.blocks import by_block, of_block, placed, runs
from hirelake.llm.common import stored, text_rows
from hirelake.llm.encoders import _Memo

MARK = "▁"
MAX_PART = 60
BLOCK_ROWS = 2048
HEAD = 3
#: word parts whose borders every task holds
COMMON = 200_000
#: words held by a task before they are handed on or forgotten
HELD = 300_000

_WORDS = re.compile(f"{MARK}+[^{MARK}]*").findall


@dataclass
class PieceTable:
    """A model file's pieces: text -> (id, score); ``split`` is the length of
    the left half in a piece's derivation."""

    pieces: dict
    split: dict
    unigram: bool
    first_byte: int
    unknown: int
    texts: list  # id -> UTF-8, None for byte pieces and controls
    byte_of: dict

    def __post_init__(self):
        self.pairs = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.longest = max(map(len, self.pieces))
        self.raw = [t if t is not None else bytes([self.byte_of[i]]) if i in self.byte_of else b"" for i, t in enumerate(self.texts)]
        # the same pairs for whole arrays of characters: those that stand in a pair are numbered from 1
        chars = sorted({ord(c) for p in self.pairs for c in p if ord(c) < 0x10000})
        self.char_no = np.zeros(0x10001, np.int32)  # the last one stands for all beyond
        self.char_no[chars] = np.arange(1, len(chars) + 1)
        self.pair_ok = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.rare_pairs = set()
        for p in self.pairs:
            if max(map(ord, p)) < 0x10000:
                self.pair_ok[self.char_no[ord(p[0])], self.char_no[ord(p[1])]] = True
            else:
                self.rare_pairs.add(p)

    @classmethod
    def load(cls, path: str) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2 as proto
        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        kind = m.trainer_spec.model_type
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        pieces, byte_of, texts = {}, {}, []
        for i, p in enumerate(m.pieces):
            texts.append(p.piece.encode() if p.type in (1, 4) else None)
            if p.type in (1, 4):
                pieces[p.piece] = (i, p.score)
            elif p.type == 6:
                byte_of[i] = int(p.piece[3:5], 16)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has the blank's mark behind another character")
        first = min(byte_of) if byte_of else -1
        if kind == 1:
            return cls(pieces, {}, True, first, m.trainer_spec.unk_id, texts, byte_of)
        split = {}
        for p in pieces:
            if len(p) > 1:
                ends, steps = merge_queue(p, pieces)
                if len(ends) != 1 or steps != sorted(steps, reverse=True):
                    raise ValueError(f"piece {p!r} has no derivation with falling scores")
                split[p] = last_split(p, pieces)
        return cls(pieces, split, False, first, m.trainer_spec.unk_id, texts, byte_of)

    def bytes_of(self, ch: str) -> list[int]:
        return [self.first_byte + b for b in ch.encode()] if self.first_byte >= 0 else [self.unknown]

    def cuts(self, words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The words joined, the places where each begins (and the end), and
        the places where no piece can cross, word borders included."""
        text = "".join(words)
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=starts[1:])
        code = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x10000)
        no = self.char_no[code]
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self.pair_ok[no[:-1], no[1:]]
        if self.rare_pairs:
            for i in np.flatnonzero((code[:-1] == 0x10000) | (code[1:] == 0x10000)) + 1:
                cut[i] = text[i - 1:i + 1] not in self.rare_pairs
        cut[starts] = True
        return text, starts, np.flatnonzero(cut)

    def plain(self, part: str) -> bool:
        """True if a part of two characters or more goes through the lattice."""
        return len(part) <= MAX_PART and (self.unigram or part not in self.pieces and not part.startswith(MARK + MARK))

    def queued(self, part: str) -> list[str]:
        """The tokens of a part that does not."""
        if self.unigram:
            return best_path(part, self.pieces, self.longest)
        return [part] if part in self.pieces else merge_queue(part, self.pieces)[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as bytes (broken UTF-8
        becomes the replacement mark), the dummy blank in front removed."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return data.decode(errors="replace").replace(MARK, " ")[1:]


def merge_queue(word: str, pieces: dict) -> tuple[list[str], list[float]]:
    """Best score first, leftmost among equals. Returns the tokens and the
    scores in the order of the merges."""
    sym, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap, scores, n = [], [], len(word)

    def offer(a):
        b = right[a]
        if b < n and (p := pieces.get(sym[a] + sym[b])):
            heapq.heappush(heap, (-p[1], a, b, sym[a] + sym[b]))

    for a in range(n):
        offer(a)
    while heap:
        s, a, b, text = heapq.heappop(heap)
        if sym[a] is None or right[a] != b or sym[b] is None or sym[a] + sym[b] != text:
            continue
        scores.append(-s)
        sym[a], sym[b] = text, None
        right[a] = right[b]
        if right[a] < n:
            left[right[a]] = a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    return [x for x in sym if x is not None], scores


def best_path(word: str, pieces: dict, longest: int) -> list[str]:
    """Viterbi for one long word: the tokens with the largest sum of scores,
    a character without a piece below every other."""
    worst = min((s for _, s in pieces.values()), default=0.0) - 10.0
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        found = [(best[s][0] + pieces[word[s:e]][1], s) for s in range(max(0, e - longest), e) if word[s:e] in pieces]
        best.append(max(found, key=lambda x: (x[0], -x[1])) if found else (best[e - 1][0] + worst, e - 1))
    out, e = [], len(word)
    while e:
        out.append(word[best[e][1]:e])
        e = best[e][1]
    return out[::-1]


def last_split(piece: str, pieces: dict) -> int:
    """Length of the left half when the piece is merged at last."""
    without = {k: v for k, v in ((piece[i:j], pieces.get(piece[i:j])) for i in range(len(piece))
                                 for j in range(i + 2, len(piece) + 1)) if v and k != piece}
    return len(merge_queue(piece, without)[0][0])


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """One table per file and process."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable.load(path)
    return _TABLES[path]


def words_of(text: str) -> list[str]:
    """The words of a text. Each stands without its one mark in front, or with
    all of them if there are more."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [w if w[1:2] == MARK else w[1:] for w in _WORDS(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def marked(words: list[str]) -> list[str]:
    """The words with their marks."""
    return [w if w[:1] == MARK else MARK + w for w in words]


# ------------------------------------------------------------------ the lattice

def lattice(parts: DataFrame, table: PieceTable) -> DataFrame:
    """``(part, borders)`` for distinct word parts of 2 to ``MAX_PART``
    characters, all of them characters that have pieces. Bit ``i`` of
    ``borders`` is set if a token begins or ends before character ``i``."""
    spark = parts.sparkSession
    ranks = {p: k for k, p in enumerate(sorted(table.pieces, key=lambda p: -table.pieces[p][1]))}
    least = 1 if table.unigram else 2  # single characters are where merging starts
    rows = [(p, float(s), ranks[p], table.split.get(p, 0)) for p, (_, s) in table.pieces.items() if len(p) >= least]
    vocabulary = spark.createDataFrame(rows, "piece string, score double, rank long, split int")
    n = F.length("part")
    # how long a piece can be that begins with these characters: most begin none of more than two
    head: dict = {}
    for p in table.pieces:
        head[p[:HEAD]] = max(head.get(p[:HEAD], 0), len(p))
    heads = spark.createDataFrame([(h, k) for h, k in head.items() if len(h) == HEAD], "head string, most int")
    cut = parts.select("part", F.explode(F.sequence(F.lit(0), n - least)).alias("s"))
    cut = cut.withColumn("head", F.substr("part", F.col("s") + 1, F.lit(HEAD))).join(F.broadcast(heads), "head", "left")
    most = F.least(F.coalesce("most", F.lit(HEAD - 1)), n - F.col("s"))
    cut = cut.select("part", "s", F.explode(F.sequence(F.lit(least), most)).alias("k"))
    cut = cut.withColumn("piece", F.substr("part", F.col("s") + 1, F.col("k")))
    edges = cut.join(F.broadcast(vocabulary), "piece")  # the vocabulary file bounds both tables
    if table.unigram:
        edge = F.struct((F.col("s") + F.col("k")).alias("e"), "s", "score")
        grouped = edges.groupBy("part").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
        return grouped.select("part", viterbi(F.col("edges"), n).alias("borders"))
    # one number an edge: rank, begin, length, length of the left half
    edge = (F.shiftleft("rank", 18).bitwiseOR(F.shiftleft("s", 12).cast("long")).bitwiseOR(F.shiftleft("k", 6).cast("long"))
            .bitwiseOR(F.col("split").cast("long")))
    grouped = edges.groupBy("part").agg(F.collect_list(edge).alias("edges"))
    return grouped.select("part", merge_fold(F.sort_array("edges"), n).alias("borders"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def merge_fold(edges: Column, n: Column) -> Column:
    """Borders by a walk over the edges in the order of their ranks. All
    borders stand at first; an edge whose region shows just its ends and its
    middle loses the middle."""
    def step(b, x):
        s = F.shiftright(x, 12).bitwiseAND(63)
        k, left = F.shiftright(x, 6).bitwiseAND(63), x.bitwiseAND(63)
        region = F.call_function("shiftleft", _bit(k + 1) - 1, s.cast("int"))
        middle = _bit(s + left)
        return F.when(b.bitwiseAND(region) == _bit(s) + _bit(s + k) + middle, b - middle).otherwise(b)

    return F.aggregate(edges, _bit(n + 1) - 1, step)


def viterbi(edges: Column, n: Column) -> Column:
    """Borders of the path with the largest sum of scores; among equal sums
    the one whose last edges are longest. ``edges`` are sorted by end and
    start."""
    state = "array<struct<score:double,borders:bigint>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("borders"))).cast(state)

    def step(acc, e):
        def better(best, x):
            before = F.element_at(acc, x["s"] + 1)
            total = before["score"] + x["score"]
            return F.when(before["score"].isNotNull() & (best["score"].isNull() | (total > best["score"])), F.struct(
                total.alias("score"), before["borders"].bitwiseOR(_bit(x["e"])).alias("borders"))).otherwise(best)

        none = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("borders"))
        best = F.aggregate(F.filter(edges, lambda x: x["e"] == e), none, better)
        return F.concat(acc, F.array(best))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)["borders"]


# ------------------------------------------------------------------ documents

def block_parts(rows: DataFrame, path: str, common=None, held: int = HELD) -> DataFrame:
    """``(block, part)``: the word parts that need a lattice, distinct within a
    block but for repeats from a full buffer. ``common`` is a broadcast
    dictionary of parts whose borders are known already."""

    def run(batches):
        table, block, words = piece_table(path), None, set()
        known = common.value if common is not None else {}

        def out():
            some, parts = list(words), set()
            words.clear()
            while some:  # a few words at a time: the arrays are wide
                text, _, cuts = table.cuts(marked(some[-50_000:]))
                del some[-50_000:]
                a, b = cuts[:-1], cuts[1:]
                long_ = b - a > 1
                found = {text[x:y] for x, y in zip(a[long_].tolist(), b[long_].tolist())}
                parts.update(p for p in found if p not in known and table.plain(p))
            parts = list(parts)
            for x in range(0, len(parts), 50_000):
                some = parts[x:x + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.string())],
                                                 names=["block", "part"])

        for b in batches:
            for text, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != block or len(words) > held:
                    if words:
                        yield from out()
                    block = k
                words.update(words_of(text))
        if words:
            yield from out()

    return rows.mapInArrow(run, "block long, part string")


def common_parts(rows: DataFrame, path: str, table: PieceTable, most: int = COMMON, one_in: int = 16) -> dict:
    """The borders of at most ``most`` parts, those that stand in most blocks
    (two at least) if one row in ``one_in`` is looked at. They are broadcast,
    so that parts which most blocks share need not be joined for each of them;
    which parts these are changes no result."""
    seen = block_parts(rows.where(F.pmod(F.xxhash64("block", "row"), F.lit(one_in)) == 0), path)
    often = (seen.groupBy("part").agg(F.count_distinct("block").alias("n")).where("n > 1")
             .orderBy(F.desc("n"), "part").limit(most).select("part"))
    return {r["part"]: r["borders"] for r in lattice(often.repartition("part"), table).collect()}


#: what a Python worker has encoded, per piece table; it is the same in every block
_WORDS_KNOWN: dict[int, _Memo] = {}


class _BlockEncoder:
    """Encodes the texts of one block from the borders in its file."""

    def __init__(self, folder: str, block: int, table: PieceTable, common: dict):
        self.table, self.common = table, common
        self.words = _WORDS_KNOWN.setdefault(id(table), _Memo())
        t = of_block(folder, block, ["part", "borders"])
        self.borders = dict(zip(*(c.to_pylist() for c in t.columns))) if t is not None else {}

    def _learn(self) -> None:
        """Cut the words noted since the last call into pieces."""
        new = self.words.new
        if not new:
            return
        table, own, common = self.table, self.borders.get, self.common.get
        text, starts, cuts = table.cuts(marked(new))
        places, more = [cuts], []
        parts = [text[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        masks = np.fromiter((common(p) or own(p, 0) for p in parts), np.int64, len(parts))
        for i in np.flatnonzero((masks == 0) & (np.diff(cuts) > 1)).tolist():
            if table.plain(parts[i]):
                raise KeyError(f"no borders for {parts[i]!r}: the rows changed between two scans")
            at = int(cuts[i])
            for token in table.queued(parts[i])[:-1]:
                at += len(token)
                more.append(at)
        some = np.flatnonzero(masks)
        for k in range(1, MAX_PART):
            some = some[masks[some] >> k > 0]
            if not len(some):
                break
            places.append(cuts[some[(masks[some] >> k) & 1 == 1]] + k)
        ends = np.unique(np.concatenate([*places, np.array(more, np.int64)]))
        tokens = [text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        get = table.pieces.get
        found = [get(t) for t in tokens]
        owner = np.searchsorted(starts, ends[:-1], side="right") - 1
        if None in found:  # characters without a piece
            ids, of = [], []
            for t, f, w in zip(tokens, found, owner.tolist()):
                own = [f[0]] if f else table.bytes_of(t)
                ids += own
                of += [w] * len(own)
            owner = np.array(of, np.int64)
        else:
            ids = [f[0] for f in found]
        self.words.put(np.bincount(owner, minlength=len(new)), np.array(ids, np.uint32))

    def encode(self, texts: list) -> list[np.ndarray]:
        if len(self.words) > HELD or self.words.new:  # full, or left by a task that failed
            self.words = _WORDS_KNOWN[id(self.table)] = _Memo()
        at = []
        for t in texts:
            w = words_of(t or "")
            at.append(np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)))
        self._learn()
        return [self.words.take(a) for a in at]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_crc32, round_trip)`` per row: the ids that
    the library gives without begin and end, the CRC-32 of the ids as
    little-endian unsigned 32-bit integers, and whether decoding them gives
    the text again (a text with the mark U+2581 comes back with blanks there).

    Cases: null and empty texts have no ids; rows that repeat come back as
    often; null ids of documents are kept; an empty table gives no rows; other
    columns are ignored. The rows must not change while the job runs.
    """
    spark = docs.sparkSession
    text_rows(spark)
    table = piece_table(path)
    rows = placed(docs, id_col, text_col, block_rows)
    common = spark.sparkContext.broadcast(common_parts(rows, path, table))
    noted = stored(block_parts(rows, path, common), "piece-parts")
    known = lattice(noted.select("part").distinct(), table)
    alone = F.call_function("shiftleft", F.lit(1).cast("long"), F.length("part") + 1) - 1  # no edge: no merge
    answers = noted.join(known, "part", "left").select("block", "part", F.coalesce("borders", alone).alias("borders"))
    folder = by_block(answers, "piece-borders")

    def run(batches):
        own, now, enc = piece_table(path), None, None
        for b in batches:
            texts, blocks = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in runs(blocks):
                if enc is None or now != blocks[lo]:
                    now, enc = blocks[lo], _BlockEncoder(folder, blocks[lo], own, common.value)
                ids = enc.encode(texts[lo:hi])
                ends = np.cumsum([0, *map(len, ids)])
                cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                same = [own.decode(x.tolist()) == (t or "") if len(x) else not t for x, t in zip(ids, texts[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), cells, pa.array(np.diff(ends), pa.int64()),
                     pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)``: the texts of id arrays; null and empty arrays give
    an empty text."""

    def run(batches):
        table = piece_table(path)
        for b in batches:
            texts = [table.decode(x) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    src = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "doc_id long, text string")
