"""Token counts with overlap resynchronisation for huge documents.

A document of at most ``chunk`` characters is encoded whole. A longer one is
cut into chunks that overlap by ``overlap`` characters; each is encoded with
character offsets, and neighbours are spliced at a stable common boundary: a
blank between two characters that are not white space. None of the supported
tokenizers has a token across such a place, whatever stands further off:
word tokenizers drop the blank, byte-level ones start a word's piece with it,
and sentence pieces have the blank's mark at their front only. Besides, both
encodings must show the same tokens between the boundary and the next one on
either side; if the overlap holds no such boundary, it is doubled and the left
chunk encoded again, up to the end of the document. Memory is that of one
chunk, and the work grows with the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import text_rows
from hirelake.llm.encoders import encoder

CHUNK, OVERLAP = 32_768, 1_024

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def _part(ids, at, lo, hi):
    keep = (at >= lo) & (at < hi)
    return list(zip(at[keep].tolist(), ids[keep].tolist()))


def _splice(left, right, stops) -> int | None:
    """A boundary between two others around which both encodings agree."""
    for k in range(len(stops) // 2, len(stops) - 1):
        for j in {k, len(stops) - 1 - k} - {0}:
            a, x, b = stops[j - 1], stops[j], stops[j + 1]
            if _part(*left, a, b) == _part(*right, a, b) and a < x < b:
                return x
    return None


def resync_ids(enc, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int, int]:
    """``(ids, chunks, widenings)`` of one text, encoded chunk by chunk."""
    out, chunks, widened = [], 0, 0
    begin, lo = 0, 0  # where the chunk starts; tokens before lo are already out
    end = min(len(text), chunk)
    left = None
    while True:
        if left is None:
            ids, at = enc.offsets(text[begin:end])
            left, chunks = (ids, at + begin), chunks + 1
        if end >= len(text):
            out.append(left[0][left[1] >= lo] if lo else left[0])
            return np.concatenate(out), chunks, widened
        wide, cut = overlap, None
        while end < len(text):
            start = max(lo, end - wide)
            stop = min(len(text), start + max(chunk, 2 * wide))
            ids, at = enc.offsets(text[start:stop])
            right, chunks = (ids, at + start), chunks + 1
            # the outermost boundaries of the overlap still touch cut words
            stops = [start + m.start() for m in _BOUNDARY.finditer(text[start:end])]
            stops = [x for x in stops if x > lo]
            cut = _splice(left, right, stops[1:-1]) if len(stops) > 4 else None
            if cut is not None:
                break
            widened += 1
            wide *= 2
            end = min(len(text), end + wide)
            ids, at = enc.offsets(text[begin:end])
            left, chunks = (ids, at + begin), chunks + 1
        if cut is None:
            continue  # the left chunk now reaches the end of the text
        out.append(left[0][(left[1] < cut) & (left[1] >= lo)] if lo else left[0][left[1] < cut])
        begin, lo, end, left = start, cut, stop, right


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened)`` per row.

    Cases: a null or empty text has 0 bytes and 0 tokens; rows that repeat are
    counted each; a null doc_id is kept; an empty table gives no rows; other
    columns are ignored. Work is one scan without a shuffle.
    """
    text_rows(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            small = [i for i, t in enumerate(texts) if len(t) <= chunk]
            n, chunks, widened = [0] * len(texts), [1] * len(texts), [0] * len(texts)
            for i, k in zip(small, enc.counts([texts[i] for i in small])):
                n[i] = k
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    ids, chunks[i], widened[i] = resync_ids(enc, t, chunk, overlap)
                    n[i] = len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([k > limit for k in n], pa.bool_()), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int")
