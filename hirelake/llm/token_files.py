"""Token-ID files: independent zstandard frames with a trailing seek table.

One file holds the documents of one range of ids, in ascending order:

    frame*      zstd frames; decompressed and joined they are all ids of the
                file as little-endian unsigned 32-bit integers
    directory   a skippable frame (magic 0x184D2A50): a zstd frame of the
                documents' ids (int64), null marks (uint8) and lengths (int64)
    seek table  a skippable frame (magic 0x184D2A5E) as in the public zstd
                seekable format: per frame its compressed size, decompressed
                size and the low 32 bits of the XXH64 of its decompressed
                bytes; then the number of frames, a flag byte, 0x8F92EAB1

Any zstd tool can decompress the file as a stream. A reader fetches the seek
table and the directory, then only the frames that hold the wanted documents,
and checks each frame it opens. Frames are cut by size, not by document, so a
huge document spans several and a reader never holds more than one.

Writing: ``repartitionByRange`` on the document id, sort inside a partition,
one file a partition, written under a temporary name and then renamed, so that
a task that runs twice leaves the same file. Only one row per file goes
through the driver, to add up where each file starts.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import fresh_path, stored, text_rows
from hirelake.llm.encoders import encoder

FRAME_IDS = 65_536
SKIP_DIRECTORY, SKIP_TABLE, TABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class FrameWriter:
    """Writes one file to a binary stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.waiting, self.n_waiting = [], 0
        self.table, self.doc_ids, self.nulls, self.sizes = [], [], bytearray(), []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids))
        self.waiting.append(ids.astype("<u4", copy=False))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_ids:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        stop = len(ids) if all_ else len(ids) - len(ids) % self.frame_ids
        for a in range(0, stop, self.frame_ids):
            raw = ids[a:min(stop, a + self.frame_ids)].tobytes()
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.n_waiting = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        raw = (np.array(self.doc_ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.sizes, "<i8").tobytes())
        packed = self.zstd.compress(raw)
        self.out.write(struct.pack("<II", SKIP_DIRECTORY, len(packed)) + packed)
        self.table.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        foot = struct.pack("<IBI", len(self.table), 0x80, TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(rows) + len(foot)) + rows + foot)


class FrameReader:
    """Reads one file from a seekable binary stream."""

    def __init__(self, src):
        self.src, self.zstd = src, zstandard.ZstdDecompressor()
        src.seek(0, 2)
        size = src.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != TABLE_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        at = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(at, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.places = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.bytes_read = 9 + 12 * n
        packed = self._at(int(self.places[-1]) + 8, int(self.table[-1, 0]) - 8)
        raw = self._checked(zstandard.ZstdDecompressor().decompress(packed), n - 1)
        docs = len(raw) // 17
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.nulls = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.frame_ids = np.cumsum(self.table[:-1, 1]) // 4  # ids up to the end of each frame

    def _at(self, place: int, n: int) -> bytes:
        self.src.seek(place)
        return self.src.read(n)

    def _checked(self, raw: bytes, frame: int) -> bytes:
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[frame, 2]:
            raise ValueError(f"frame {frame} does not match its checksum")
        return raw

    def frame(self, k: int) -> np.ndarray:
        packed = self._at(int(self.places[k]), int(self.table[k, 0]))
        self.bytes_read += len(packed)
        raw = self._checked(self.zstd.decompress(packed), k)
        if len(raw) != self.table[k, 1]:
            raise ValueError(f"frame {k} has another size than the seek table says")
        return np.frombuffer(raw, "<u4")

    def pieces(self, start: int, n: int, held: dict | None = None):
        """The ids ``[start, start + n)`` of the file, a frame at a time."""
        k = int(np.searchsorted(self.frame_ids, start, side="right"))
        while n > 0:
            if held is None:
                ids = self.frame(k)
            else:  # a scan opens each frame once
                if k not in held:
                    held.clear()
                    held[k] = self.frame(k)
                ids = held[k]
            at = start - (int(self.frame_ids[k - 1]) if k else 0)
            part = ids[at:at + n]
            yield part
            start, n, k = start + len(part), n - len(part), k + 1

    def document(self, i: int) -> np.ndarray:
        """All ids of the file's i-th document."""
        return np.concatenate([np.zeros(0, "<u4"), *self.pieces(int(self.starts[i]), int(self.sizes[i]))])


#: names that Spark gives to stores which Python's readers know under another
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "abfss": "abfs"}
_READ_HERE = {"file", "s3", "gs", "gcs", "hdfs", "abfs"}


def python_uri(uri: str) -> str:
    """A Spark path as Python's readers name it. ``dbfs:`` is read through its
    mount; a scheme that nothing here reads is an error."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return uri
    if scheme == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    scheme = SCHEMES.get(scheme, scheme)
    if scheme not in _READ_HERE:
        raise ValueError(f"no Python reader for {uri}: set spark.checkpoint.dir to one of {', '.join(sorted(_READ_HERE))} or dbfs")
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{scheme}:{rest}"


def _fs(path: str):
    return pafs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (pafs.LocalFileSystem(), path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path that tasks open for what Spark opens as ``path``: with its
    scheme, behind the mounts that only Spark's file systems know."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, rest = place.getFileSystem(spark._jsc.hadoopConfiguration()), []
    place = fs.makeQualified(place)
    while not fs.exists(place) and place.getParent() is not None:
        rest.append(place.getName())
        place = place.getParent()
    return python_uri("/".join([fs.resolvePath(place).toString().rstrip("/"), *rest[::-1]]))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id",
                      text_col: str = "text", files: int | None = None, frame_ids: int = FRAME_IDS,
                      folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write the files in ascending
    document id. Returns one row per file: ``(file, path, n_docs, n_tokens,
    start)``, ``start`` being the ids in all files before it.

    Cases: a null or empty text has the end id only; a null id comes first and
    is marked in the directory; rows that repeat are written each, equal ids
    in the order of their texts; an empty table gives no files. ``files``
    (default: the session's shuffle partitions) sets how many ranges are cut.
    """
    spark = docs.sparkSession
    text_rows(spark)
    folder = _qualified(spark, folder or fresh_path(spark, "token-files"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        fs, base = _fs(folder)
        enc, writer, out, tmp, n_tokens = encoder(tokenizer), None, None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                tmp = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(tmp)
                writer = FrameWriter(out, frame_ids)
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.ids([t or "" for t in b.column(1).to_pylist()])):
                ids = np.concatenate((ids, tail))
                n_tokens += len(ids)
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            out.close()
            path = f"{base}/ids-{part:06d}.zst"
            fs.move(tmp, path)  # the same bytes whichever attempt is last
            name = f"{folder}/{os.path.basename(path)}"
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.sizes)], pa.int64()),
                 pa.array([n_tokens], pa.int64())], names=["file", "path", "n_docs", "n_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = src.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    made = stored(ranged.mapInArrow(run, "file int, path string, n_docs long, n_tokens long"), "token-manifest")
    rows, start = [], 0
    for r in sorted(made.collect()):  # one row per file
        rows.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "file int, path string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files
    of ``manifest``, read back frame by frame with their checksums."""

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = _fs(path)
                with fs.open_input_file(name) as src:
                    r, held, crcs = FrameReader(src), {}, []
                    for start, n in zip(r.starts.tolist(), r.sizes.tolist()):
                        crc = 0
                        for ids in r.pieces(start, n, held):
                            crc = zlib.crc32(ids.tobytes(), crc)
                        crcs.append(crc)
                for a in range(0, len(crcs), 100_000):
                    s = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids[s], pa.int64(), mask=r.nulls[s]), pa.array(r.starts[s] + base, pa.int64()),
                         pa.array(r.sizes[s], pa.int64()), pa.array(crcs[s], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start")
    files = files.repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
