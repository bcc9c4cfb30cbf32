"""Helpers shared by the training-data operators: the folder that all
executors see, tables written there to cut lineage, and ASCII word rules."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of one Arrow batch sent to a Python task; long texts make wide rows
ARROW_ROWS = 1000

_UPPER = bytes(range(65, 91))
#: A-Z to a-z, every other byte unchanged
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: as LOWER, and every ASCII byte that is neither letter nor digit becomes a blank
WORDS = bytes((b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32)
              for b in (LOWER[i] for i in range(256)))


def blank_words(data: bytes) -> list[bytes]:
    """Words between blanks (``[^\\x20\\x09-\\x0D]+``) of lower-cased UTF-8."""
    return data.translate(LOWER).split()


def alnum_words(data: bytes) -> list[bytes]:
    """Runs of lower-cased letters, digits and non-ASCII characters."""
    return data.translate(WORDS).split()


def byte_strings(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string of an Arrow column without nulls, much
    faster than a Python object for each first."""
    if not len(column):
        return []
    column = column.cast(pa.binary())  # also from strings with wide offsets
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def shared_base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session (tests)
    without that setting gets a folder of its own; a cluster without it is an
    error, because executors could not read each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs one read of these files, not the work before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch before a Python stage over texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, whatever else (clashing names included) the
    caller's table carries."""
    return df.select(*[F.col(c) for c in cols])
