"""Whitening of embeddings with MLlib's BlockMatrix.

Centred rows are indexed into row blocks of a distributed matrix, its transpose times itself is the scatter, the
small covariance is decomposed on the driver, and the block matrix times the whitening matrix projects every row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from cabledger.session import shared_dir

SCALE, SHIFT = 64, 1_000_000
#: Entries count as at most this large, so that all of them are exact as integers.
LARGEST = float(1 << 45)
COMPONENTS = 32
#: Rows of a block, blocks added up by one task of the scatter, and tasks of it at most.
BLOCK_ROWS, BLOCKS_A_TASK, MOST_TASKS = 1024, 16, 4096

RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _finite(rows: DataFrame) -> DataFrame:
    """Rows whose vector ``v`` is not null, not empty and has finite entries only, as doubles."""
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.withColumn("v", F.col("v").cast("array<double>")).filter((F.size("v") > 0) & ~odd)


def _grid(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> DataFrame:
    """(size, place, n, s, least, most) per length of vector and dimension, over the integer entries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = batch.column(0).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                at = (ends - sizes)[sizes == size]
                x = _grid(flat[at[:, None] + np.arange(size)])
                # Sums are kept as Python integers: exact at any size.
                new = [len(x), x.astype(object).sum(0) if np.abs(x).max() > 1 << 40 else x.sum(0).astype(object), x.min(0), x.max(0)]
                old = held.get(size)
                held[size] = new if old is None else [old[0] + new[0], old[1] + new[1], np.minimum(old[2], new[2]), np.maximum(old[3], new[3])]
        for size, (n, s, least, most) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
                 pa.array([str(v) for v in s], pa.string()), pa.array(least), pa.array(most)],
                ["size", "place", "n", "s", "least", "most"])
    return (rows.select("v").mapInArrow(add, "size int, place int, n bigint, s string, least bigint, most bigint")
            .groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"),
                                          F.min("least").alias("least"), F.max("most").alias("most")))


class _Centre:
    """Turns vectors into centred rows and their exact deviations."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        #: Whether n*x - S fits into 64 bits, whatever the row.
        self.fits = max(abs(s) for s in sums) + n * largest < 1 << 62

    def rows(self, values: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x - S/n as doubles, sum over dimensions of (n*x - S)**2 or None beyond 64 bits)."""
        x = _grid(values)
        if self.fits:
            apart = self.n * x - np.array(self.sums, np.int64)
            reach = int(np.abs(apart).max(initial=0))
            if reach * reach * len(self.sums) < 1 << 62:
                return apart / self.n, (apart * apart).sum(1).tolist()
            apart = apart.astype(object)
        else:
            apart = self.n * x.astype(object) - np.array(self.sums, object)
        squares = (apart * apart).sum(1)
        return (apart / self.n).astype(np.float64), [int(s) if s < 1 << 63 else None for s in squares]


def _blocks(rows: DataFrame, centre: _Centre) -> DataFrame:
    """(block, ids, deviations, m): the centred rows, up to ``BLOCK_ROWS`` of a partition to a block, blocks numbered from 0.

    The last block of a partition is filled up with zeros, which add nothing to a scatter.
    """
    size, kind = len(centre.sums), rows.schema["id"].dataType.simpleString()
    matrix = MatrixUDT.sqlType()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        ids, values, held = [], [], 0

        def out(count: int) -> pa.RecordBatch:
            nonlocal ids, values, held, at
            all_ids, all_values = pa.concat_arrays(ids), np.concatenate(values)
            centred, deviations = centre.rows(all_values[:count])
            block = np.zeros((BLOCK_ROWS, size))
            block[:count] = centred
            m = {"type": 1, "numRows": BLOCK_ROWS, "numCols": size, "colPtrs": None, "rowIndices": None,
                 "values": block.ravel(order="F"), "isTransposed": False}
            types = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                               ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])
            found = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), all_ids[:count]),
                 pa.array([deviations], pa.list_(pa.int64())), pa.array([m], types)], ["part", "at", "ids", "deviations", "m"])
            ids, values, held, at = [all_ids[count:]], [all_values[count:]], held - count, at + 1
            return found

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0))
                values.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                held += batch.num_rows
            while held >= BLOCK_ROWS:
                yield out(BLOCK_ROWS)
        if held:
            yield out(held)
    raw = rows.mapInArrow(cut, f"part int, at bigint, ids array<{kind}>, deviations array<bigint>, m {matrix.simpleString()}")
    path = f"{shared_dir(rows.sparkSession)}/blocks-{uuid.uuid4().hex}"
    raw.write.parquet(path)
    fields = [f for f in raw.schema if f.name != "m"] + [StructField("m", MatrixUDT())]
    read = rows.sparkSession.read.schema(StructType(fields)).parquet(path)
    first = (read.groupBy("part").count().withColumn("first", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count"))  # one row per partition
    return read.join(first, "part").select((F.col("first") + F.col("at")).alias("block"), "ids", "deviations", "m")


def _block_matrix(blocks: DataFrame, n_blocks: int, size: int) -> BlockMatrix:
    keyed = blocks.select(F.struct(F.col("block").alias("_1"), F.lit(0).cast("bigint").alias("_2")).alias("_1"), F.col("m").alias("_2"))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", keyed, BLOCK_ROWS, size, n_blocks * BLOCK_ROWS, size), BLOCK_ROWS, size)


def _java(matrix: BlockMatrix):
    return matrix._java_matrix_wrapper._java_model


def scatter(matrix: BlockMatrix, n_blocks: int) -> np.ndarray:
    """The transpose of ``matrix`` times itself. The product is split along its rows, so that no task sees all of them."""
    splits = max(1, min(MOST_TASKS, n_blocks // BLOCKS_A_TASK))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", _java(matrix), splits)
    return BlockMatrix(product, matrix.numCols(), matrix.numCols()).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(unit eigenvectors over the root of their eigenvalues as columns, shares of the trace), by falling eigenvalue.

    Eigenvalues that are zero up to rounding give columns of NaN.
    """
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    trace = float(np.trace(covariance))
    none = values <= max(values[0], 0.0) * len(covariance) * np.finfo(float).eps * 4
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(none, np.nan, vectors / np.sqrt(values))
        return scaled, np.where(trace > 0, values / trace, np.nan)


def _project(matrix: BlockMatrix, whitener: np.ndarray, n_blocks: int) -> DataFrame:
    """(block, values): the rows of ``matrix`` times ``whitener``, column by column."""
    spark = matrix.blocks.context
    size, k = whitener.shape
    one = DenseMatrix(size, k, np.nan_to_num(whitener).ravel(order="F"))
    projected = matrix.multiply(BlockMatrix(spark.parallelize([((0, 0), one)], 1), size, k))
    return callMLlibFunc("getMatrixBlocks", _java(projected)).select(F.col("_1._1").alias("block"), F.col("_2").alias("m"))


def _identity_error(projected: DataFrame, n: int, used: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the projected rows minus the identity, over the components in use."""
    k = len(used)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for m in batch.column("m"):
                rows = np.array(m["values"].values.to_numpy(zero_copy_only=False)).reshape(k, -1).T
                total[:k] += rows.T @ rows
                total[k] += rows.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["place", "s"])
    found = projected.mapInArrow(add, "place int, s double").groupBy("place").agg(F.sum("s").alias("s")).collect()  # k * (k + 1) rows
    total = np.zeros((k + 1) * k)
    for row in found:
        total[row["place"]] = row["s"]
    total = total.reshape(k + 1, k) / n
    apart = np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k))[np.ix_(used, used)]
    return float(apart.max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every remaining row and component.

    Rows whose vector is null or empty, or has null, NaN or infinite entries, are dropped; so are rows whose vector has another length
    than most rows have (of equally common lengths the greatest). Entries become ``floor(64 * c) + 1000000``; beyond 2**45 in size
    they count as that. ``deviation`` is exact and null beyond 64 bits. Components without variance have null ``whitened``;
    if there is no variance at all, ``explained`` is null too. Null ids and repeated rows are rows of their own. An empty
    table, or one without a remaining row, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = _finite(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")))
    kind = rows.schema["id"].dataType.simpleString()
    sums = _sums(rows).collect()  # one row per length of vector and dimension
    if not sums:
        return spark.createDataFrame([], f"id {kind}, {RESULT}")
    size = max((r["n"], r["size"]) for r in sums)[1]
    chosen = sorted((r for r in sums if r["size"] == size), key=lambda r: r["place"])
    n = chosen[0]["n"]
    centre = _Centre(n, [int(r["s"]) for r in chosen], max(max(abs(r["least"]), abs(r["most"])) for r in chosen))
    blocks = _blocks(rows.filter(F.size("v") == size), centre)
    n_blocks = blocks.count()
    matrix = _block_matrix(blocks, n_blocks, size)
    whitener, explained = whitening_matrix(scatter(matrix, n_blocks) / n, components)
    k, used = whitener.shape[1], ~np.isnan(whitener[0])
    projected = _project(matrix, whitener, n_blocks)
    error = _identity_error(projected, n, used)
    shares = [None if np.isnan(e) else float(e) for e in explained]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, deviations = batch.column("ids")[i].values, batch.column("deviations")[i].values
                values = batch.column("m")[i]["values"].values.to_numpy(zero_copy_only=False).reshape(k, -1)[:, :len(ids)]
                each, place = len(ids), np.repeat(np.arange(len(ids)), k)
                component = np.tile(np.arange(k), each)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(place)), pa.array(component + 1, pa.int32()), pa.array(np.full(each * k, n)),
                     deviations.take(pa.array(place)), pa.array(values.T.ravel(), mask=np.tile(~used, each)),
                     pa.array(shares, pa.float64()).take(pa.array(component)), pa.array(np.full(each * k, error))],
                    ["id", *(f.split()[0] for f in RESULT.split(", "))])
    joined = projected.join(blocks.select("block", "ids", "deviations"), "block").select("ids", "deviations", "m")
    return joined.mapInArrow(rows_of, f"id {kind}, {RESULT}")
