"""Removal of repeated byte strings through a difference cover and hash groups.

Every string of ``LENGTH`` bytes that also starts anywhere else, in the same
document or another, is removed. A difference cover is a set of sampled
positions such that two equal strings hold a sampled position at the same
offset. Here the cover is content-defined (a local minimum of the hash of
``BLOCK`` bytes among ``SPREAD`` neighbours), which keeps that property for
equal strings and samples one byte in a hundred. The cover of a fixed modulus
would have to sample about one in thirteen for strings of this length (an
estimate; no such attempt was measured). No suffixes are ordered: sorting of
triples, recursion on names and the merge of suffixes are replaced by hash
groups.

    sample   the minima; each sampled suffix is read as a triple of blocks:
             the block at the sample, the one before and the one after
    names    equal blocks get equal names (hashes); samples whose own block is
             alone are done: no string around them repeats
    triples  grouped by the hash of their names: samples with equal triples
             have equal surroundings, so every string around them repeats
    shifts   samples with equal blocks but other neighbours are compared once
             more, by the hashes of the strings of ``LENGTH`` bytes around
             them at every shift; this also decides the strings that start
             between samples

Plan: scan one emits one row per sample; samples whose block repeats are kept
(an aggregate and an equi-join on the block's name). Scan two fetches the
surroundings of one sample per triple, only in groups with more than one
triple; groups are compared in tasks of bounded memory, and groups of more
than ``GROUP`` triples as rows of (name, shift, string name) that Spark sums.
Scan three cuts the texts. What the joins find out reaches the scans in one
file a block of rows (``blocks``); texts are never shuffled, and exact copies
meet only as counts.

Names are 64-bit hashes of whole byte strings; in groups of two the bytes
themselves are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.blocks import by_block, of_block, placed, runs
from hirelake.llm.common import stored, text_rows

LENGTH = 400
BLOCK = 200
SPREAD = LENGTH - BLOCK + 1  # block starts inside one string
AROUND = LENGTH - BLOCK  # bytes before and after a sample's block that matter
#: triples of one group that a task compares; a row takes 2 KB
GROUP = 40_000
BLOCK_ROWS = 8192
#: bytes hashed at once
SLAB = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * _U(pow(base, k, 1 << 64))
        k += m
    return out


_UP, _DOWN = _powers(_BASE, 1024), _powers(pow(_BASE, -1, 1 << 64), 1024)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for buffers of ``n`` bytes."""
    global _UP, _DOWN
    if len(_UP) <= n:
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)
    return _UP, _DOWN


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _prefix(raw: np.ndarray) -> np.ndarray:
    up, _ = _tables(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(7)) * up[:len(raw)], out=out[1:])
    return out


def _name(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the strings ``[a, b)``; the length is part of the name."""
    return _mixed((prefix[b] - prefix[a]) * _DOWN[a] + (b - a).astype(np.uint64) * _U(0x94D049BB133111EB))


def _least(x: np.ndarray, n: int, pick) -> np.ndarray:
    """Least (or greatest) of each run of ``n`` neighbours, by doubling."""
    k = 1
    while k < n:
        m = min(k, n - k)
        x = pick(x[:-m], x[m:])
        k += m
    return x


def sample(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of the documents that lie at ``[starts, ends)`` of a
    buffer, with the names of their blocks and of their triples."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = _prefix(raw)
    n = len(raw) - BLOCK + 1
    at = np.arange(n)
    block = _mixed((prefix[BLOCK:] - prefix[:n]) * _DOWN[:n] + _U(BLOCK * 0x94D049BB133111EB & (1 << 64) - 1)) | _U(1)
    low = _least(block, SPREAD, np.minimum)  # of the string that starts here
    # a string must lie inside one document; others choose nothing
    inside = np.zeros(len(low) + 1, np.int64)
    long_ = ends - starts >= LENGTH
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - LENGTH + 1, -1)
    low = np.where(np.cumsum(inside)[:-1] > 0, low, _U(0))
    pad = np.zeros(SPREAD - 1, np.uint64)
    high = _least(np.concatenate((pad, low, pad)), SPREAD, np.maximum)  # over the strings that hold the block
    x = at[block == high]
    doc = np.searchsorted(starts, x, side="right") - 1
    a, b = np.maximum(starts[doc], x - AROUND), np.minimum(ends[doc], x + LENGTH)
    own = block[x]
    before, after = _name(prefix, a, x), _name(prefix, x + BLOCK, b)
    triple = _mixed(own ^ _mixed(before + _U(0x632BE59BD9B4E019))) + _mixed(after * _U(3) + own)
    return x, own, triple


def _samples(data: list[bytes], held: int = SLAB):
    """Per buffer: document numbers, positions, block names, triple names. A
    document of more than ``held`` bytes goes in overlapping pieces."""
    margin = 2 * LENGTH + BLOCK
    waiting, size = [], 0

    def out():
        raw = np.frombuffer(b"".join(p for _, _, p, _, _ in waiting), np.uint8)
        ends = np.cumsum([len(p) for _, _, p, _, _ in waiting])
        starts = ends - [len(p) for _, _, p, _, _ in waiting]
        x, own, triple = sample(raw, starts, ends)
        k = np.searchsorted(starts, x, side="right") - 1
        number, first, lo, hi = (np.array([w[i] for w in waiting], np.int64)[k] for i in (0, 1, 3, 4))
        pos = x - starts[k] + first
        mine = (pos >= lo) & (pos < hi)  # the margins belong to the neighbours
        return number[mine], pos[mine], own[mine], triple[mine]

    for i, d in enumerate(data):
        if len(d) < LENGTH:
            continue
        for a in range(0, len(d), held):
            first = max(0, a - margin)
            piece = d[first:a + held + margin]
            waiting.append((i, first, piece, a, a + held))
            size += len(piece)
            if size >= held:
                yield out()
                waiting, size = [], 0
    if waiting:
        yield out()


def sample_rows(rows: DataFrame) -> DataFrame:
    """``(own, triple, block, spot)`` of all samples; ``spot`` holds the row
    within the block and the position."""

    def run(batches):
        for b in batches:
            blocks, row = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            data = [(t or "").encode() for t in b.column(1).to_pylist()]
            for number, pos, own, triple in _samples(data):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(triple.view(np.int64)), pa.array(blocks[number]),
                     pa.array(row[number] << 40 | pos)], names=["own", "triple", "block", "spot"])

    return rows.mapInArrow(run, "own long, triple long, block long, spot long")


def _ranges(good: np.ndarray) -> list[dict]:
    """Runs of true shifts (bytes between a string's start and the sample)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], good, [0])).astype(np.int8)))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


def _strings(around: list[bytes], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings that start 0, 1, ... bytes before each sample,
    from its surroundings, and which of them lie inside the document. A few
    rows at a time, so that only the names are as many as the rows."""
    n, width = len(around), LENGTH + AROUND
    up, down = _tables(width + 1)
    shift = np.arange(AROUND + 1)
    a = AROUND - shift
    names = np.empty((n, AROUND + 1), np.uint64)
    size = np.fromiter(map(len, around), np.int64, n)
    for r in range(0, n, 1000):
        part = around[r:r + 1000]
        raw = np.zeros((len(part), width), np.uint8)
        for i, (x, l) in enumerate(zip(part, left[r:r + 1000].tolist())):
            raw[i, AROUND - l:AROUND - l + len(x)] = np.frombuffer(x, np.uint8)
        prefix = np.zeros((len(part), width + 1), np.uint64)
        np.cumsum((raw.astype(np.uint64) + _U(7)) * up[:width], axis=1, out=prefix[:, 1:])
        names[r:r + 1000] = _mixed((prefix[:, a + LENGTH] - prefix[:, a]) * down[a])
    valid = (shift <= left[:, None]) & (LENGTH - shift <= (size - left)[:, None])
    return names, valid


def _repeated(names: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Row by row, the shifts whose string some other row has too."""
    out = np.zeros(names.shape, bool)
    names[~valid] = np.arange(int((~valid).sum()), dtype=np.uint64)  # each unlike all others
    for c in range(0, names.shape[1], max(1, 2_000_000 // len(names))):  # some columns of a large group
        part = names[:, c:c + max(1, 2_000_000 // len(names))]
        order = np.argsort(part, axis=0, kind="stable")
        part = np.take_along_axis(part, order, 0)
        ok = np.take_along_axis(valid[:, c:c + part.shape[1]], order, 0)
        same = (part[1:] == part[:-1]) & ok[1:] & ok[:-1]
        hit = np.zeros(part.shape, bool)
        hit[1:] |= same
        hit[:-1] |= same
        np.put_along_axis(out[:, c:c + part.shape[1]], order, hit, 0)
    return out


def _pair_shifts(a: bytes, la: int, b: bytes, lb: int) -> tuple[int, int]:
    """Shifts with equal strings around two samples, as an inclusive range."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(la, lb)
    diff = np.flatnonzero(x[la - n:la][::-1] != y[lb - n:lb][::-1])
    left = int(diff[0]) if len(diff) else n
    n = min(len(a) - la, len(b) - lb)
    diff = np.flatnonzero(x[la:la + n] != y[lb:lb + n])
    right = int(diff[0]) if len(diff) else n
    return max(0, LENGTH - right), min(left, AROUND)


_SHIFTS = "own long, triple long, shifts array<struct<lo:int,hi:int>>"


def _compare(groups: DataFrame) -> DataFrame:
    """``(own, triple, shifts)`` from surroundings sorted by ``own``."""
    schema = pa.schema([("own", pa.int64()), ("triple", pa.int64()),
                        ("shifts", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])

    def emit(rows):
        own, triple, around, left = rows
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        out = []
        for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(own)])).tolist()):
            if b - a == 2:
                lo, hi = _pair_shifts(around[a], int(left[a]), around[a + 1], int(left[a + 1]))
                if lo <= hi:
                    out += [(own[i], triple[i], [{"lo": lo, "hi": hi}]) for i in (a, a + 1)]
            elif b - a > 2:
                hit = _repeated(*_strings(around[a:b], left[a:b]))
                out += [(own[i], triple[i], _ranges(h)) for i, h in zip(range(a, b), hit) if h.any()]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches):
        rest = None
        for b in batches:
            rows = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False),
                    b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False)]
            if rest is not None:
                rows = [x + y if isinstance(x, list) else np.concatenate((x, y)) for x, y in zip(rest, rows)]
            at = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if at:
                yield emit([x[:at] for x in rows])
            rest = [x[at:] for x in rows]
        if rest is not None and len(rest[0]):
            yield emit(rest)

    return groups.select("own", "triple", "around", "left").mapInArrow(run, _SHIFTS)


def _compare_large(groups: DataFrame) -> DataFrame:
    """The same for groups of any size: one row per string, summed by Spark."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                names, valid = _strings(part.column(2).to_pylist(), part.column(3).to_numpy(zero_copy_only=False))
                i, shift = np.nonzero(valid)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(shift, pa.int32()),
                     pa.array(names[i, shift].view(np.int64))], names=["own", "triple", "shift", "name"])

    strings = groups.select("own", "triple", "around", "left").mapInArrow(run, "own long, triple long, shift int, name long")
    again = strings.groupBy("own", "shift", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return (strings.join(again, ["own", "shift", "name"]).groupBy("own", "triple")
            .agg(F.collect_list(F.struct(F.col("shift").alias("lo"), F.col("shift").alias("hi"))).alias("shifts")))


def _surroundings(rows: DataFrame, folder: str) -> DataFrame:
    """Scan two: ``(own, triple, around, left, large)`` of the listed samples."""

    def run(batches):
        now, table = None, {}
        for b in batches:
            blocks, row = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in runs(blocks):
                if now != blocks[lo]:
                    now, table = blocks[lo], {}
                    t = of_block(folder, now, ["own", "triple", "spot", "large"])
                    for o, k, s, g in zip(*(c.to_pylist() for c in t.columns)) if t is not None else ():
                        table.setdefault(s >> 40, []).append((o, k, s & (1 << 40) - 1, g))
                if not table:
                    continue
                out = []
                for i in range(lo, hi):
                    if spots := table.get(row[i]):
                        data = b.column(1)[i].as_py().encode()
                        for o, k, x, g in spots:
                            a = max(0, x - AROUND)
                            out.append((o, k, data[a:x + LENGTH], x - a, g))
                for a in range(0, len(out), 2000):
                    o, k, d, n, g = zip(*out[a:a + 2000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(o, pa.int64()), pa.array(k, pa.int64()), pa.array(d, pa.binary()), pa.array(n, pa.int32()),
                         pa.array(g, pa.bool_())], names=["own", "triple", "around", "left", "large"])

    return rows.mapInArrow(run, "own long, triple long, around binary, left int, large boolean")


def repeated_samples(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """``(block, spot, shifts)``: the samples with repeated strings around
    them. ``rows`` is ``placed`` documents."""
    samples = stored(sample_rows(rows), "suffix-samples")
    # written: a join with an aggregate on its own key is not split at run time,
    # and a passage that many documents share is one key
    again = stored(samples.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-again")
    known = stored(samples.join(again, "own"), "suffix-repeats")
    triples = known.groupBy("own", "triple").agg(F.count("*").alias("n"), F.min(F.struct("block", "spot")).alias("one"))
    triples = stored(triples, "suffix-triples")
    # equal triples: every string around the samples repeats
    whole = triples.where("n > 1").select("own", "triple", F.array(F.struct(
        F.lit(0).alias("lo"), F.lit(AROUND).alias("hi"))).alias("shifts"))
    # other triples of the same block: compare further, one sample for each
    sizes = stored(triples.groupBy("own").agg(F.count("*").alias("ways")).where("ways > 1"), "suffix-ways")
    ones = triples.join(sizes, "own").select("own", "triple", "one.block", "one.spot", (F.col("ways") > group).alias("large"))
    around = stored(_surroundings(rows, by_block(ones, "suffix-ones")), "suffix-around")
    small = around.where("not large").repartition("own").sortWithinPartitions("own")
    part = _compare(small).unionByName(_compare_large(around.where("large")))
    part = part.join(whole.select("own", "triple"), ["own", "triple"], "left_anti")
    return known.join(whole.unionByName(part), ["own", "triple"]).select("block", "spot", "shifts")


def spans_of(size: int, spots: list[tuple[int, list]]) -> list[tuple[int, int]]:
    """Merged byte spans of a document from its samples and their shifts."""
    found = []
    for x, shifts in spots:
        for r in shifts:
            first, last = max(0, x - r["hi"]), min(x - r["lo"], size - LENGTH)
            if first <= last:
                found.append((first, last + LENGTH))
    out: list = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS,
                   group: int = GROUP) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256)`` per row: the byte
    spans (begin, end exclusive) covered by repeated strings, and the SHA-256
    of the bytes that are left, joined.

    Cases: null and empty texts have no bytes; texts shorter than ``LENGTH``
    lose nothing; rows that repeat are documents of their own and, if long
    enough, vanish whole; null ids are kept; an empty table gives no rows;
    other columns are ignored. The rows must not change while the job runs.
    """
    text_rows(docs.sparkSession)
    rows = placed(docs, id_col, text_col, block_rows)
    folder = by_block(repeated_samples(rows, group), "suffix-marks")

    def run(batches):
        now, table = None, {}
        for b in batches:
            blocks, row, texts = (b.column(k).to_pylist() for k in (2, 3, 1))
            size, removed, spans, sha = [], [], [], []
            for lo, hi in runs(blocks):
                if now != blocks[lo]:
                    now, table = blocks[lo], {}
                    t = of_block(folder, now, ["spot", "shifts"])
                    for s, shifts in zip(*(c.to_pylist() for c in t.columns)) if t is not None else ():
                        table.setdefault(s >> 40, []).append((s & (1 << 40) - 1, shifts))
                for i in range(lo, hi):
                    data = (texts[i] or "").encode()
                    cut = spans_of(len(data), table.get(row[i], []))
                    at, h = 0, hashlib.sha256()
                    for a, e in cut:
                        h.update(data[at:a])
                        at = e
                    h.update(data[at:])
                    size.append(len(data))
                    removed.append(sum(e - a for a, e in cut))
                    spans.append([{"first": a, "end": e} for a, e in cut])
                    sha.append(h.hexdigest())
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept_sha256 string")
