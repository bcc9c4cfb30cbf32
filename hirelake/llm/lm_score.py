"""Log-probabilities of texts under a weighted backoff automaton.

Tokens are blank-separated lower-cased words and one end. States are contexts
of up to ``order - 1`` tokens, the start of a text included; an arc reads a token
and leads to the longest context it completes, a failure arc leads to the
context without its first token and costs that context's backoff weight. The
weights are hierarchical Dirichlet smoothing: with ``c`` the count in the
training texts and P' the probability one context shorter,

    P(w | h) = (c(h w) + m P'(w | h)) / (c(h) + m),   P(w) = (c(w) + 0.1) / Z

with ``Z = N + 0.1 (V + 1)``, so the words not seen share one more word's
weight and every state's arcs and failure arc sum to one.

Texts are dealt evenly over blocks of about ``BLOCK`` bytes, bundled and
compressed, and shuffled once for both passes over them. A block sends each
distinct n-gram that it holds once, with its count in the block's training
texts, packed by ranges of the n-gram's 64-bit hash; a task of one range adds up
the counts of all blocks and sends every block the corpus counts of just what it
asked for. With them the block builds the part of the automaton that its texts
can reach, and one traversal from left to right carries the state and adds up
the weights. So the model is never in one place: it grows with the corpus and
stays spread over the ranges. Two n-grams with one hash would share a count (at a
million million distinct ones, a chance of a few per cent that any two do).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import byte_strings, text_rows

#: UTF-8 bytes of a block of texts, and of the texts behind one range of hashes
BLOCK = 8 << 20
#: UTF-8 bytes of the texts that travel as one compressed row
BUNDLE = 256 << 10
#: added to each count of a single token
ADDED = 0.1
#: weight of the shorter context against the counts of a longer one; of 1 to 256 the best
#: on the held-out texts of the given 10,000 documents, at orders 2 and 3
STRENGTH = 64.0
#: hashes of the end and of the start of a text; blanks are in no word
END, START = (np.uint64(xxhash.xxh64_intdigest(t)) for t in (b" end", b" start"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts) -> list[np.ndarray]:
    """The hashes of each text's tokens, the end included; ``texts`` is an Arrow
    column of strings, null ones empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(plain)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    none = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    if none.any():  # an empty text is split into one empty word
        keep = np.ones(len(flat), bool)
        keep[np.cumsum(sizes)[none] - 1] = False
        flat, sizes = flat.filter(pa.array(keep)), np.where(none, 0, sizes)
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) for w in byte_strings(coded.dictionary)], np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(flat) + len(sizes), END)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = names[coded.indices.to_numpy()]
    return np.split(out, ends[:-1] + 1) if len(sizes) else []


def longer(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its context and its last token."""
    h = (context ^ (context >> np.uint64(31))) * _MIX + token
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngrams(texts: list[np.ndarray], order: int) -> list[np.ndarray]:
    """For each length up to ``order`` the hash of the n-gram that ends at each
    place of all texts in a row, each with its start before it. Where no n-gram
    of that length fits into the text, the longest that does stands instead."""
    flat = np.concatenate([np.append(START, t) for t in texts]) if texts else np.empty(0, np.uint64)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
    at = np.arange(len(flat)) - np.repeat(first, [len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    grams = [flat]
    for size in range(2, order + 1):
        fits = np.flatnonzero(at >= size - 1)
        g = grams[-1].copy()
        g[fits] = longer(grams[-1][fits - 1], flat[fits])
        grams.append(g)
    return grams


def distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct n-grams, ascending, and for each length where in them the
    n-gram is that ends at a place; -1 where none of that length fits."""
    fits = [np.arange(len(grams[0]))] + [np.flatnonzero(g != shorter) for shorter, g in zip(grams, grams[1:])]
    keys, which = np.unique(np.concatenate([g[f] for g, f in zip(grams, fits)]), return_inverse=True)
    at, begin = [], 0
    for f in fits:
        x = np.full(len(grams[0]), -1, np.int64)
        x[f] = which[begin:begin + len(f)]
        begin += len(f)
        at.append(x)
    return keys, at


def pack(a: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes. The low planes of hash steps are noise
    and stay as they are; planes that compress are compressed on their own."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8).T
    width = max(1, 8 - int((planes.any(axis=1)[::-1].cumsum() == 0).sum()))
    sizes, parts = [], []
    for plane in planes[:width]:
        raw = plane.tobytes()
        small = zstandard.compress(raw, 1)
        sizes.append(len(small) if len(small) < len(raw) else 0)
        parts.append(small if sizes[-1] else raw)
    return struct.pack(f"<BI{width}I", width, len(a), *sizes) + b"".join(parts)


def unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    width, n = struct.unpack_from("<BI", data)
    raw, at = np.zeros((8, n), np.uint8), 5 + 4 * width
    for plane, size in zip(raw, struct.unpack_from(f"<{width}I", data, 5)):
        part = data[at:at + (size or n)]
        plane[:] = np.frombuffer(zstandard.decompress(part) if size else part, np.uint8)
        at += len(part)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of each ascending hash, ascending."""
    return np.searchsorted((np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64), keys, side="right")


def _bundles(parts: int):
    """Rows bundled, compressed, and dealt over the blocks by their place in
    the scan, so that equal rows part."""
    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(1)).to_numpy() + 100)
            cuts = np.flatnonzero(np.diff(size // BUNDLE, prepend=-1)).tolist()
            blocks, bundles = [], []
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.slice(lo, hi - lo))
                bundles.append(sink.getvalue().to_pybytes())
                blocks.append(xxhash.xxh64_intdigest(f"{task} {count}") % parts)
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(bundles, pa.binary())],
                                             names=["block", "bundle"])
    return run


def _unbundled(rows: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows.column("bundle")])


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal ranges."""
    at = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
    return list(zip(at, at[1:]))


def _steps(keys: np.ndarray) -> bytes:
    """Ascending hashes of one range: the first, then the steps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _asked(order: int, parts: int):
    """Of one block: a row for each range of hashes."""
    def run(rows: pa.Table) -> pa.Table:
        docs = _unbundled(rows)
        texts = token_hashes(docs.column("text"))
        keys, at = distinct(ngrams(texts, order))
        trained = np.repeat(docs.column("trained").to_numpy(), [len(t) + 1 for t in texts])
        n = sum(np.bincount(x[trained & (x >= 0)], minlength=len(keys)) for x in at)
        part = ranges(keys, parts)
        out = [(int(part[a]), _steps(keys[a:b]), pack(n[a:b])) for a, b in _cuts(part)]
        block = rows.column("block")[0].as_py()
        return pa.table({"part": pa.array([r[0] for r in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()),
                         "keys": pa.array([r[1] for r in out], pa.binary()), "n": pa.array([r[2] for r in out], pa.binary())})
    return run


def _answered(rows: pa.Table) -> pa.Table:
    """Of one range: the corpus counts of what each block asked for."""
    keys = [_keys(k) for k in rows.column("keys").to_pylist()]
    distinct_keys, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct_keys), np.int64)
    np.add.at(total, which, np.concatenate([unpack(n, np.int64) for n in rows.column("n").to_pylist()]))
    ends = np.cumsum([len(k) for k in keys])
    back = [pack(total[which[e - len(k):e]]) for k, e in zip(keys, ends.tolist())]
    return pa.table({"part": rows.column("part"), "block": rows.column("block"), "total": pa.array(back, pa.binary())})


class Automaton:
    """The states and arcs that one block's texts reach."""

    def __init__(self, at: list[np.ndarray], total: np.ndarray, z: float, strength: float):
        """``at`` as ``distinct`` gives it, ``total`` the corpus counts of the distinct n-grams."""
        self.order = len(at)
        # of the n-gram of each length that ends at a place; 0 where none of that length fits
        counts = [np.where(x >= 0, total[x], 0) for x in at]
        p = (counts[0] + ADDED) / z
        #: log10 weight of the arc of each length that reads the token at a place
        self.arcs = [np.log10(p)]
        #: whether the automaton has that arc
        self.has = [np.ones(len(p), bool)]
        #: log10 weight of the failure arc of the context of each length that ends before a place
        self.fail = [np.zeros(len(p))]
        for size in range(1, self.order):
            before = np.zeros(len(p))
            before[1:] = counts[size - 1][:-1]  # of the context of that length
            p = (counts[size] + strength * p) / (before + strength)
            self.arcs.append(np.log10(p))
            self.has.append(counts[size] > 0)
            self.fail.append(np.log10(strength / (before + strength)))
        #: contexts of each length that are states: seen in the training texts
        self.state = [np.ones(len(p), bool)] + [c > 0 for c in counts[:-1]]

    def traverse(self, begin: int, end: int) -> float:
        """One pass over the tokens at ``begin`` to ``end``; the start is before them."""
        arcs, has, fail, state = ([x[begin - 1:end].tolist() for x in xs] for xs in
                                  (self.arcs, self.has, self.fail, self.state))
        top, total = self.order - 1, 0.0
        here = min(top, 1) if top and state[1][0] else 0  # the context of the start, if any text was trained on
        for t in range(1, end - begin + 1):
            while not has[here][t]:
                total += fail[here][t]
                here -= 1
            total += arcs[here][t]
            here = min(here + 1, top)
            while not state[here][t]:  # a context not seen is no state
                here -= 1
        return total


def vocabulary(docs: DataFrame, parts: int = 8) -> tuple[int, int]:
    """``(N, V)``: all and distinct tokens of the training texts of ``(text, trained)``."""
    def seen(batches):
        n, keys = 0, np.empty(0, np.uint64)
        held = []
        for b in batches:
            texts = token_hashes(b.column(0))
            n += sum(map(len, texts))
            held.append(np.unique(np.concatenate(texts)))
            if sum(map(len, held)) > 1 << 20:
                keys, held = np.unique(np.concatenate([keys, *held])), []
        keys = np.unique(np.concatenate([keys, *held]))
        part = ranges(keys, parts)
        out = [(int(part[a]), _steps(keys[a:b])) for a, b in _cuts(part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()),
             pa.array([n] * len(out[:1]) + [0] * len(out[1:]), pa.int64())], names=["part", "keys", "n"])

    def together(rows: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([_keys(k) for k in rows.column("keys").to_pylist()]))
        return pa.table({"n": pa.array([pc.sum(rows.column("n")).as_py()], pa.int64()), "v": pa.array([len(keys)], pa.int64())})

    found = docs.where("trained").select("text").mapInArrow(seen, "part long, keys binary, n long")
    each = found.groupBy("part").applyInArrow(together, "n long, v long")
    r = each.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return r.n or 0, r.v or 0


def held_out(doc_id, modulus: int = 10):
    """Rows that the model does not learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == 0, F.lit(False))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3,
              strength: float = STRENGTH, modulus: int = 10, block: int = BLOCK) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per
    row, log10 throughout. The model learns from all rows that are not held out.

    Cases: a null or empty text is one end; a null doc_id is not held out;
    repeated rows are learnt and scored each; without any training text every
    token is unknown (``c = N = V = 0``); an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    text_rows(spark)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = plain.withColumn("trained", ~held_out(F.col("doc_id"), modulus))
    size = plain.agg(F.sum(F.octet_length("text") + 200)).first()[0] or 0
    parts = max(1, -(-int(size) // block))
    n_all, v_all = vocabulary(plain, max(1, parts // 8))
    z = n_all + ADDED * (v_all + 1)
    dealt = plain.mapInArrow(_bundles(parts), "block long, bundle binary").repartition(parts, "block")
    asked = dealt.groupBy("block").applyInArrow(_asked(order, parts), "part long, block long, keys binary, n binary")
    answers = asked.repartition(parts, "part").groupBy("part").applyInArrow(_answered, "part long, block long, total binary")

    def score(rows: pa.Table, totals: pa.Table) -> pa.Table:
        docs = _unbundled(rows)
        texts = token_hashes(docs.column("text"))
        _, at = distinct(ngrams(texts, order))
        in_order = np.argsort(totals.column("part").to_numpy())
        packed = totals.column("total").to_pylist()
        total = np.concatenate([unpack(packed[i], np.int64) for i in in_order])
        model = Automaton(at, total, z, strength)
        known = total[at[0]] > 0
        n, seen, base, full = [], [], [], []
        begin = 1
        for t in texts:
            end = begin + len(t)
            n.append(len(t))
            seen.append(int(known[begin:end].sum()))
            base.append(float(model.arcs[0][begin:end].sum()))
            full.append(model.traverse(begin, end))
            begin = end + 1
        return pa.table({"doc_id": docs.column("doc_id"), "trained": docs.column("trained"),
                         "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(seen, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(full, pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
