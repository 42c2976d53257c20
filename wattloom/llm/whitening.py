"""Whitening of embeddings with distributed block matrices.

Vectors become integers, and the fit list has each distinct one once. Rows are numbered, dealt into blocks of equal
size and centred; the scatter matrix is the product of the transposed block matrix with itself, its eigenvectors are
found on the driver (a matrix as wide as a vector), and a second block product projects all rows.

A block matrix holds at most ``panel_blocks`` blocks, since the driver lists the blocks of a product; more rows make
more panels. A tall block matrix would be multiplied by the square root of its tasks only: the scatter product is
split along its inner dimension instead, and for the projection blocks are laid out in a square and multiplied by a
block-diagonal matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wattloom.llm.common import shared_path, written
from wattloom.llm.vectors import decimals, exact, finite, matrix, scaled, sums

_MATRIX_SQL = "struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, values: array<double>, isTransposed: boolean>"
_MATRIX = pa.struct([
    ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_()),
])
#: bits that a task's rows take of a row's number, as in monotonically_increasing_id
_TASK_BITS = 33


def _dense(values: np.ndarray) -> dict:
    return {"type": 1, "numRows": values.shape[0], "numCols": values.shape[1], "values": values.ravel(order="F"), "isTransposed": False}


def _as_matrices(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """The frame as a written table whose columns of matrix parts are read as matrices."""
    types = [StructField(f.name, MatrixUDT()) if f.name in columns else f for f in df.schema]
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(StructType(types)).parquet(path)


def _block_matrix(df: DataFrame, rows: int, cols: int, all_rows: int, all_cols: int) -> BlockMatrix:
    """From (i, j, m): block row, block column and matrix."""
    index = F.struct(F.col("i").cast("long").alias("blockRowIndex"), F.col("j").cast("long").alias("blockColIndex"))
    made = callMLlibFunc("createBlockMatrix", df.select(index.alias("blockIndex"), F.col("m").alias("subMatrix")), rows, cols, all_rows, all_cols)
    return BlockMatrix(made, rows, cols)


def _multiplied(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a * b, its inner dimension dealt to ``splits`` groups of tasks."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def _numbered(rows: DataFrame, size: int) -> DataFrame:
    """Block and place of each row, from its number in its task; the first numbers of tasks follow from their counts.

    The window has one row a task that wrote the rows.
    """
    task = F.shiftright("at", _TASK_BITS)
    ends = rows.groupBy(task.alias("task")).agg((F.max("at") - F.shiftleft(F.max(task), _TASK_BITS) + 1).alias("n"))
    first = ends.select("task", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("task")) - F.col("n")).alias("first"))
    number = F.col("at") - F.shiftleft(task, _TASK_BITS) + F.col("first")
    placed = rows.join(F.broadcast(first), task == F.col("task")).withColumn("number", number)
    return placed.select("id", "x", "number", *_place(size))


def _place(size: int) -> tuple[Column, Column]:
    return F.expr(f"number div {size}").alias("block"), (F.col("number") % size).cast("int").alias("pos")


def _blocks(placed: DataFrame, firsts: DataFrame, size: int, width: int, n: int, total: list[int]) -> DataFrame:
    """(block, ids, pos, deviation, fit, all, fitted): centred rows as matrices of ``size`` rows, zeros where none is.

    ``fitted`` has only the rows of the fit list; null where that makes no difference.
    """
    id_type = placed.schema["id"].dataType.simpleString()
    whole = np.array(total, dtype=object)
    reach = max([1, *(abs(v) for v in total)])

    def build(rows: pa.Table, first: pa.Table) -> pa.Table:
        x, pos = matrix(rows.column("x"), width), rows.column("pos").to_numpy()
        x = exact(x, 2 * n)
        off = x * n - (whole.astype(np.int64) if x.dtype != object and reach < 1 << 62 else whole)
        top = max([1, *(abs(int(v)) for v in (off.max(), off.min()))])
        squares = off if top * top * width < 1 << 62 else off.astype(object)
        centred = np.zeros((size, width))
        centred[pos] = off.astype(np.float64) / n
        fits = np.zeros(size, dtype=bool)
        fits[first.column("pos").to_numpy()] = True
        own = centred if fits[pos].all() else centred * fits[:, None]
        return pa.Table.from_arrays(
            [
                pa.array([rows.column("block")[0].as_py()], pa.int64()),
                pa.array([rows.column("id").to_pylist()], pa.list_(rows.schema.field("id").type)),
                pa.array([pos.tolist()], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array([0, len(pos)], pa.int32()), decimals((squares * squares).sum(axis=1))),
                pa.array([fits[pos].tolist()], pa.list_(pa.bool_())),
                pa.array([_dense(centred)], _MATRIX),
                pa.array([None if own is centred else _dense(own)], _MATRIX),
            ],
            ["block", "ids", "pos", "deviation", "fit", "all", "fitted"],
        )

    schema = f"block long, ids array<{id_type}>, pos array<int>, deviation array<decimal(38,0)>, fit array<boolean>, all {_MATRIX_SQL}, fitted {_MATRIX_SQL}"
    return placed.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(build, schema)


def _scatter(blocks: DataFrame, panels: list[int], size: int, width: int, panel_blocks: int) -> np.ndarray:
    out = np.zeros((width, width))
    for p, count in enumerate(panels):
        tall = _panel(blocks, p, panel_blocks).select(F.col("b").alias("i"), F.lit(0).alias("j"), F.coalesce("fitted", "all").alias("m"))
        tall = _block_matrix(tall, size, width, count * size, width)
        out += _multiplied(tall.transpose(), tall, -(-count // 64)).toLocalMatrix().toArray()
    return out


def _panel(blocks: DataFrame, p: int, panel_blocks: int) -> DataFrame:
    first = p * panel_blocks
    return blocks.where((F.col("block") >= first) & (F.col("block") < first + panel_blocks)).withColumn("b", F.col("block") - first)


def _projected(blocks: DataFrame, panels: list[int], size: int, weights: np.ndarray, panel_blocks: int) -> DataFrame:
    """(block, w): the rows' projections as matrices."""
    spark, (width, k) = blocks.sparkSession, weights.shape

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0)
            yield pa.RecordBatch.from_arrays([at, at, pa.array([_dense(weights)] * len(at), _MATRIX)], ["i", "j", "m"])

    out = None
    for p, count in enumerate(panels):
        side = math.isqrt(count - 1) + 1
        grid = _panel(blocks, p, panel_blocks).select(F.expr(f"b div {side}").alias("i"), (F.col("b") % side).alias("j"), F.col("all").alias("m"))
        grid = _block_matrix(grid, size, width, -(-count // side) * size, side * width)
        square = _as_matrices(spark.range(side).mapInArrow(diagonal, f"i long, j long, m {_MATRIX_SQL}"), "weights", "m")
        square = _block_matrix(square, width, k, side * width, side * k)
        got = callMLlibFunc("getMatrixBlocks", _multiplied(grid, square)._java_matrix_wrapper._java_model).toDF("at", "w")
        at = F.col("at._1").cast("long") * side + F.col("at._2") + p * panel_blocks
        got = got.select(at.alias("block"), "w")
        out = got if out is None else out.unionByName(got)
    return out


def _rows(blocks: DataFrame, projected: DataFrame, k: int) -> DataFrame:
    """(id, deviation, fit, w): one row a vector again."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                m, pos = batch.column("w")[i], np.array(batch.column("pos")[i].as_py())
                values = m["values"].values.to_numpy()
                shape = (m["numRows"].as_py(), m["numCols"].as_py())
                w = values.reshape(shape) if m["isTransposed"].as_py() else values.reshape(shape, order="F")
                w = np.ascontiguousarray(w[pos])
                ends = pa.array(np.arange(0, w.size + 1, k), pa.int32())
                lists = [batch.column(c)[i].values for c in ("ids", "deviation", "fit")]
                yield pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["id", "deviation", "fit", "w"])

    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    joined = blocks.select("block", "ids", "pos", "deviation", "fit").join(projected, "block").select("ids", "pos", "deviation", "fit", "w")
    return joined.mapInArrow(unpack, f"id {id_type}, deviation decimal(38,0), fit boolean, w array<double>")


def _identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest distance of an entry of the whitened covariance from the identity, centred first; over the fit list."""
    fit = rows.where("fit")
    means = fit.agg(*[(F.sum(F.col("w")[i]) / n).alias(str(i)) for i in range(k)]).first()
    centred = fit.select(F.array(*[F.col("w")[i] - F.lit(means[i]) for i in range(k)]).alias("w"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = centred.agg(*[(F.sum(F.col("w")[i] * F.col("w")[j]) / n).alias(f"{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[x] - (i == j)) for x, (i, j) in enumerate(pairs))


def principal(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors of scatter / n, by falling eigenvalue, and the trace.

    Directions without variance (to double precision) are left out. An eigenvector's largest entry is positive.
    """
    cov = (scatter + scatter.T) / (2 * n)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    keep = min(components, int((e > len(e) * np.finfo(float).eps * max(e[0], 0)).sum()))
    v = v[:, :keep]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(keep)])
    return e[:keep], v * sign, float(np.trace(cov))


def whiten(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    components: int = 16,
    scale: float = 64.0,
    shift: int = 1_000_000,
    rows_per_block: int = 2048,
    panel_blocks: int = 32_768,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    x is ``floor(scale * c) + shift`` (products beyond 2^53 are held there). ``deviation`` is exact, as decimal(38,0):
    the sum over dimensions of (n * x - S)^2.

    Rows whose vector is null or empty or holds a null or non-finite entry are dropped; so are rows of another length
    than most (the longer one of a tie). Repeated rows and rows without an id are all returned; equal vectors count
    once in the fit. Directions without variance are no components: a table of one distinct vector, or an empty one,
    gives no row. Other columns are ignored. The driver holds a square matrix as wide as a vector.
    """
    good = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).where(finite("v"))
    rows = written(good.select("id", scaled("v", scale, shift).alias("x"), F.monotonically_increasing_id().alias("at")), "units")
    none = f"{vec_id} {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return df.sparkSession.createDataFrame([], none)
    width = common["width"]
    placed = _numbered(rows.where(F.size("x") == width), rows_per_block)

    firsts = written(placed.groupBy("x").agg(F.min("number").alias("number")), "fit_list")
    fit = sums(firsts, "x", width).first()
    n, total = fit["n"], [int(v) for v in fit["sums"]]
    blocks = _blocks(placed.drop("number"), firsts.select(*_place(rows_per_block)), rows_per_block, width, n, total)
    blocks = _as_matrices(blocks, "blocks", "all", "fitted")

    last = blocks.agg(F.max("block")).first()[0] + 1
    panels = [min(panel_blocks, last - p) for p in range(0, last, panel_blocks)]
    e, v, trace = principal(_scatter(blocks, panels, rows_per_block, width, panel_blocks), n, components)
    if not len(e):
        return df.sparkSession.createDataFrame([], none)
    out = written(_rows(blocks, _projected(blocks, panels, rows_per_block, v / np.sqrt(e), panel_blocks), len(e)), "whitened")
    shares = F.array(*[F.lit(float(x / trace)) for x in e])
    each = out.select(F.col("id").alias(vec_id), "deviation", F.posexplode("w").alias("_i", "whitened"))
    return each.select(
        vec_id,
        (F.col("_i") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("_i")].alias("explained"),
        F.lit(_identity_error(out, n, len(e))).alias("identity_error"),
    )
