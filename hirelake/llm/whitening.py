"""Whitening of embeddings on MLlib's distributed block matrices.

Entries become whole numbers ``x = floor(64 * c) + 1000000``. The fit list (each
distinct vector once) and the table itself become row blocks of centred
doubles, ``(n*x - S) / n`` with the whole number ``n*x - S`` taken exactly. Then

* scatter: the fit list's transpose times the fit list, a ``BlockMatrix``
  product whose middle dimension is split, so that row blocks meet in many
  tasks and only d x d sums go on; ``numpy.linalg.eigh`` of the d x d result;
* projection: a ``BlockMatrix`` product with the whitening matrix. MLlib deals
  the blocks of a product over a grid, and a result one block wide would use
  only the square root of the tasks. So the row blocks are folded into a square
  grid, times a block-diagonal matrix that repeats the whitening matrix: every
  block still meets one small factor once;
* check: the same scatter product over the whitened fit list, less the identity.

What reaches the driver: d x d matrices, sums per dimension, one row count per
task, and the coordinates of blocks (one for each ``ROWS`` rows).
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.common import stored

#: rows of one block: 2,048 x 128 doubles are 2 MB
ROWS = 2048
#: row blocks that meet in one task of a scatter product
MEET = 16
#: entries beyond this are no vector entries: 64 * c would not fit a long
LARGEST = 2.0 ** 55
#: eigenvalues below this part of the largest are rounding, not variance
RANK = 1e-12


def quantised(df: DataFrame, vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``df`` with ``x``, its usable vectors as whole numbers. A null vector, or
    one with a null, non-finite or immense entry, is dropped."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))
    return df.where(v.isNotNull() & usable).withColumn("x", x)


def _placed(df: DataFrame, name: str, *cols: str) -> tuple[DataFrame, int]:
    """The rows written with their place ``(block, at)``, and the number of
    blocks. A task's rows fill blocks of their own, the last one in part."""
    rid = F.monotonically_increasing_id()
    rows = stored(df.select(*cols, rid.alias("rid")), name)
    task, pos = F.shiftright("rid", 33), F.col("rid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.task, r.n) for r in rows.groupBy(task.alias("task")).count().withColumnRenamed("count", "n").collect())
    before, total = [], 0
    for t, n in sizes:
        before.append((t, total))
        total += -(-n // ROWS)
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "task long, before long"))  # one row a task
    placed = rows.join(offsets, task == F.col("task"))
    return placed.select(*cols, (F.col("before") + F.floor(pos / ROWS)).alias("block"),
                         (pos % ROWS).cast("int").alias("at")), total


def _sums(df: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""
    def run(batches):
        n, s = 0, [0] * dims
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, dims)
            n += len(x)
            s = [a + int(c) for a, c in zip(s, _exact(x, len(x)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(dims)], pa.int32()), pa.array([Decimal(v) for v in [n, *s]], pa.decimal128(38, 0))],
            names=["dim", "s"])

    found = df.select("x").mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s"))
    got = {r.dim: int(r.s) for r in found.collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(dims)]


def _exact(x: np.ndarray, times: int) -> np.ndarray:
    """``x`` in a type in which ``times`` as much still is exact."""
    most = int(np.abs(x).max(initial=0))
    return x if most * max(times, 1) < 1 << 61 else x.astype(object)


def _distance(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """``n*x - S``, exact."""
    return _exact(x, 2 * n) * n - s


def _totals(s: list[int]) -> np.ndarray:
    """The sums as long integers where they fit."""
    return np.array(s, np.int64 if max(map(abs, s), default=0) < 1 << 61 else object)


def _blocks(placed: DataFrame, n: int, s: list[int]) -> DataFrame:
    """``(block, m)``: the centred row blocks as MLlib matrices."""
    dims, sums = len(s), _totals(s)

    def run(rows: pa.Table) -> pa.Table:
        full = np.zeros((ROWS, dims))
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        full[rows.column("at").to_numpy()] = (_distance(x, n, sums) / n).astype(np.float64)
        m = {"type": 1, "numRows": ROWS, "numCols": dims, "colPtrs": None, "rowIndices": None,
             "values": full.ravel(), "isTransposed": True}
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "m": pa.array([m], kind)})

    def many(item):
        return pa.list_(pa.field("element", item, False))

    kind = pa.struct([
        pa.field("type", pa.int8(), False), pa.field("numRows", pa.int32(), False), pa.field("numCols", pa.int32(), False),
        pa.field("colPtrs", many(pa.int32())), pa.field("rowIndices", many(pa.int32())),
        pa.field("values", many(pa.float64())), pa.field("isTransposed", pa.bool_(), False)])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("m", MatrixUDT())])
    return placed.select("block", "at", "x").groupBy("block").applyInArrow(run, schema)


def _matrix(blocks: DataFrame, row, col, size: tuple[int, int], grid: tuple[int, int]) -> BlockMatrix:
    """MLlib's matrix of ``(block, m)`` rows at the given grid places."""
    at = F.struct(row.cast("long").alias("blockRowIndex"), col.cast("long").alias("blockColIndex"))
    made = callMLlibFunc("createBlockMatrix", blocks.select(at.alias("at"), "m"), *size,
                         size[0] * grid[0], size[1] * grid[1])
    return BlockMatrix(made, *size)


def _scatter(blocks: DataFrame, count: int, width: int) -> np.ndarray:
    """Transpose times itself over all row blocks."""
    m = _matrix(blocks, F.col("block"), F.lit(0), (ROWS, width), (count, 1))
    java = m._java_matrix_wrapper
    product = m.transpose()._java_matrix_wrapper.call("multiply", java._java_model, -(-count // MEET))
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def _projected(blocks: DataFrame, count: int, w: np.ndarray) -> tuple[BlockMatrix, int]:
    """The row blocks times ``w``, folded into a grid of the given width."""
    spark, (dims, k) = blocks.sparkSession, w.shape
    side = max(1, int(np.ceil(np.sqrt(count))))
    m = _matrix(blocks, F.floor(F.col("block") / side), F.col("block") % side, (ROWS, dims), (-(-count // side), side))
    factor = DenseMatrix(dims, k, w.ravel(order="F"))
    diagonal = spark.sparkContext.range(side, numSlices=min(side, 64)).map(lambda i: ((i, i), factor))
    return m.multiply(BlockMatrix(diagonal, dims, k, dims * side, k * side)), side


def _unfolded(m: BlockMatrix, side: int) -> DataFrame:
    """``(block, m)`` of a folded product."""
    got = callMLlibFunc("getMatrixBlocks", m._java_matrix_wrapper._java_model).toDF("at", "m")
    place = F.col("at")[got.schema["at"].dataType.names[0]] * side + F.col("at")[got.schema["at"].dataType.names[1]]
    return got.select(place.cast("long").alias("block"), "m")


def whitening(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """``(w, explained)``: the columns of ``w`` are unit eigenvectors of the
    covariance over the root of their eigenvalue, by falling eigenvalue.
    Directions without variance have none."""
    cov = (scatter + scatter.T) / (2 * n)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > max(e[0], 0) * RANK).sum()))
    return v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """``(vec_id, n, deviation, whitened, explained, identity_error)`` for each
    usable row; ``whitened`` and ``explained`` are arrays over the components.

    Cases: rows that ``quantised`` drops are not returned, nor those whose
    length is not the table's commonest (of two, the larger); repeated vectors
    count once in the fit and come back as often as they came in, null ids
    included. With fewer directions of variance than ``components`` the arrays
    are shorter, down to empty for one distinct vector. ``deviation`` is null
    where it would not fit a long. Other columns are ignored, and an empty
    table gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    rows = quantised(df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = lengths.d if lengths else 0
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType())),
                           T.StructField("explained", T.ArrayType(T.DoubleType())),
                           T.StructField("identity_error", T.DoubleType())])
    if not dims:
        return spark.createDataFrame([], schema)
    table, count = _placed(rows.where(F.size("x") == dims), "whiten-rows", "vec_id", "x")
    fit, fitted = _placed(table.select("x").distinct(), "whiten-fit", "x")
    n, s = _sums(fit, dims)
    fit_blocks = _blocks(fit, n, s)
    w, explained = whitening(_scatter(fit_blocks, fitted, dims), n, components)
    k = w.shape[1]
    if not k:
        return table.select("vec_id", F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                            F.array().cast("array<double>").alias("whitened"),
                            F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    projected, side = _projected(fit_blocks, fitted, w)
    projected.persist(StorageLevel.MEMORY_AND_DISK)
    unit = _scatter(_unfolded(projected, side), fitted, k) / n
    projected._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = float(np.abs(unit - np.eye(k)).max())

    sums = _totals(s)

    def distances(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, dims)
            d = _distance(x, n, sums)
            d = d if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * dims < 1 << 62 else d.astype(object)
            far = [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("block"), b.column("at"),
                                              pa.array(far, pa.int64())], names=["vec_id", "block", "at", "deviation"])

    def numbers(left: pa.Table, right: pa.Table) -> pa.Table:
        m = right.column("m").combine_chunks()
        flat = m.field("values").flatten().to_numpy()
        rows_first = m.field("isTransposed")[0].as_py()
        grid = flat.reshape(ROWS, k) if rows_first else flat.reshape(k, ROWS).T
        picked = np.ascontiguousarray(grid[left.column("at").to_numpy()])
        ends = pa.array(np.arange(0, picked.size + 1, k, dtype=np.int32))
        return pa.table({"vec_id": left.column("vec_id"), "deviation": left.column("deviation"),
                         "whitened": pa.ListArray.from_arrays(ends, pa.array(picked.ravel()))})

    places = T.StructType([T.StructField("vec_id", kind), T.StructField("block", T.LongType()),
                           T.StructField("at", T.IntegerType()), T.StructField("deviation", T.LongType())])
    ids = table.mapInArrow(distances, places)
    all_projected, side = _projected(_blocks(table, n, s), count, w)
    out = T.StructType([schema["vec_id"], schema["deviation"], schema["whitened"]])
    found = ids.groupBy("block").cogroup(_unfolded(all_projected, side).groupBy("block")).applyInArrow(numbers, out)
    return found.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        F.array(*[F.lit(float(e)) for e in explained]).alias("explained"),
                        F.lit(error).alias("identity_error"))
