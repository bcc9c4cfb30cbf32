"""Blocks of rows that two scans of the same files meet alike, and tables kept
for look-ups by block, so that a scan can pick up what a shuffle found out
about its rows without moving the rows themselves."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import fresh_path, stored
from hirelake.llm.token_files import _fs, _qualified

#: bytes of a row group of a look-up file
ROW_GROUP = 1 << 20


def placed(docs: DataFrame, id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """``(doc_id, text, block, row)``: ``block`` names a run of ``block_rows``
    rows of one file, ``row`` counts within it. Rows that are not a plain scan
    of files are written first."""
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    at = F.col("_metadata.row_index")
    place = [F.xxhash64("_metadata.file_path", F.floor(at / block_rows)).alias("block"), (at % block_rows).alias("row")]
    try:
        return docs.select(*cols, *place)
    except AnalysisException:
        return stored(docs.select(*cols), "input").select("doc_id", "text", *place)


def by_block(df: DataFrame, name: str, buckets: int | None = None) -> str:
    """Write ``df`` for look-ups by block; returns the folder for ``of_block``.
    Blocks are dealt over ``buckets`` files (default: the session's shuffle
    partitions) and sorted in them; row groups are small, so a look-up reads
    little more than its block. The number of files does not grow with the
    rows."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{fresh_path(df.sparkSession, name)}/buckets={n}"
    dealt = df.withColumn("bucket", F.pmod("block", F.lit(n)).cast("int")).repartition(n, "bucket")
    dealt.sortWithinPartitions("bucket", "block").write.option("parquet.block.size", str(ROW_GROUP)) \
        .partitionBy("bucket").parquet(folder)
    return _qualified(df.sparkSession, folder)


def of_block(folder: str, block: int, columns: list[str]) -> pa.Table | None:
    """The rows of one block, or None if it has none."""
    fs, base = _fs(folder)
    place = f"{base}/bucket={block % int(folder.rpartition('=')[2])}"
    if fs.get_file_info(place).type != pafs.FileType.Directory:
        return None
    parts = []
    for f in fs.get_file_info(pafs.FileSelector(place)):
        if f.base_name.endswith(".parquet") and f.base_name[0] not in "._":
            with fs.open_input_file(f.path) as src:
                file = pq.ParquetFile(src)
                at = file.schema_arrow.get_field_index("block")
                near = [g for g in range(file.num_row_groups)
                        if (s := file.metadata.row_group(g).column(at).statistics) is None or s.min <= block <= s.max]
                if near:
                    rows = file.read_row_groups(near, ["block", *columns], use_threads=False)
                    parts.append(rows.filter(pc.equal(rows.column("block"), block)).select(columns))
    found = pa.concat_tables(parts) if parts else None
    pa.default_memory_pool().release_unused()  # a worker looks up many blocks
    return found if found is not None and found.num_rows else None


def runs(blocks) -> list[tuple[int, int]]:
    """Begin and end of each run of equal blocks in a batch."""
    cuts = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]), len(blocks)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
