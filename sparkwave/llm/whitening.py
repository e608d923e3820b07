"""Embedding whitening with MLlib's BlockMatrix.

The distinct quantised vectors are the fit list.  Its centred rows are indexed into a distributed BlockMatrix; its transpose times
itself is the scatter matrix, one block of dimension x dimension, whose eigenvectors are found on the driver.  The BlockMatrix
times the whitening matrix projects all vectors; rows take the results of their vectors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

SCALE = 256
LIMIT = 2.0**62  # scaled entries of this size or more don't count as finite: they must fit in a long


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, x (array<long>) of the usable rows: x = floor(256 * entry).

    Rows go whose vector is null, empty, or holds a null, a NaN, an infinity or an entry of 2^54 or more.  Where vectors
    of several lengths remain, the commonest length (of equally common ones the largest) is kept and other rows go.
    """
    entries = F.transform(F.col("embedding"), lambda c: c.cast("double") * SCALE)
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)) & (F.size("embedding") > 0)
    kept = rows.select("vec_id", "embedding").where(F.col("embedding").isNotNull()).where(fine)
    lengths = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = kept.where(F.size("embedding") == (lengths["d"] if lengths else 0))
    return kept.select("vec_id", F.transform(entries, lambda c: F.floor(c)).alias("x"))


def numbered(fit: DataFrame) -> DataFrame:
    """`fit` (checkpointed, so with fixed partitions) with dense row numbers: a partition's place and its start, without a shuffle of rows."""
    fit = fit.withColumn("at", F.monotonically_increasing_id())
    sizes = fit.groupBy(F.shiftright("at", 33).alias("part")).count()  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    joined = fit.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    return joined.select((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("row"), "x")


def _sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, exact sums by dimension, and the largest absolute entry."""
    # One row a dimension on the driver.
    rows = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"), F.max(F.abs("v")).alias("most")).orderBy("i").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows], max(r["most"] for r in rows)) if rows else (0, [], 0)


def _deviation(n: int, sums: list[int], most: int) -> Column:
    """Sum over dimensions of (n*x - S)^2, exact; null where it doesn't fit in a long."""
    if len(sums) * (2 * n * most) ** 2 < 2**63:
        s = F.array(*(F.lit(v).cast("long") for v in sums))
        return F.aggregate(F.zip_with("x", s, lambda x, s: (n * x - s) * (n * x - s)), F.lit(0).cast("long"), lambda a, b: a + b)
    # Whole arithmetic of Python: the squares may need any number of digits.
    def exact(x):
        value = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        return value if value < 2**63 else None

    return F.udf(exact, "long")("x")


def _block_matrix(rows: DataFrame, n: int, d: int, rows_per_block: int):
    """A BlockMatrix of rows (row, y array<double>); made in the JVM."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.mllib.util import MLUtils

    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("y").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(rows_per_block, d)


def _local_block(spark, values: np.ndarray):
    from pyspark.mllib.linalg import Matrices
    from pyspark.mllib.linalg.distributed import BlockMatrix

    d, k = values.shape
    block = Matrices.dense(d, k, values.ravel(order="F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), d, k)


def _product(a, b, splits: int):
    """a times b; `splits` deals the blocks that meet in one result block over as many tasks, whose partial products are then added."""
    from pyspark.mllib.linalg.distributed import BlockMatrix

    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits), a.rowsPerBlock, b.colsPerBlock)


def _rows(matrix) -> DataFrame:
    """row, w (array<double>) of a BlockMatrix, without a Python worker."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.common import callMLlibFunc

    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("w"))


ROWS_PER_BLOCK = 4096
BLOCK_ENTRIES = 1 << 20  # of a block, at most: 8 MB


def whiten(rows: DataFrame, components: int = 4, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row of rows(vec_id, embedding).

    Rows that `quantised` drops have no result, repeated ids and vectors each have their own, null ids too; extra columns are not read.
    With fewer dimensions than `components` there are as many components as dimensions.  Where a component has no
    variance (eigenvalue at most 1e-12 of the first: equal vectors, one vector), whitened is null, and identity_error
    covers the others; it is null when there are none, as explained is when the trace is 0.
    """
    spark = rows.sparkSession
    usable = quantised(rows)
    fit = numbered(checkpointed(usable.select("x").distinct()))
    n, sums, most = _sums(fit)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], schema)
    d = len(sums)
    mean = F.array(*(F.lit(float(s) / n) for s in sums))
    centred = fit.select("row", F.zip_with("x", mean, lambda x, m: x.cast("double") - m).alias("y"))
    per_block = max(1, min(rows_per_block, BLOCK_ENTRIES // d))
    matrix = _block_matrix(centred, n, d, per_block)
    blocks = -(-n // per_block)
    splits = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scatter = _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    k = min(components, d)
    values, vectors, trace = values[::-1][:k], vectors[:, ::-1][:, :k], float(np.trace(scatter)) / n
    varied = values > max(values[0], 0.0) * 1e-12
    whitening = np.where(varied, vectors / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    projected = _rows(_product(matrix, _local_block(spark, whitening), 1))
    error = _identity_error(projected, [i for i in range(k) if varied[i]], n)
    one = lambda i: F.struct(F.lit(i + 1).alias("component"), (F.col("w")[i] if varied[i] else F.lit(None).cast("double")).alias("whitened"),
                             F.lit(float(values[i]) / trace if trace > 0 else None).cast("double").alias("explained"))
    vectors = fit.withColumn("deviation", _deviation(n, sums, most)).join(projected, "row").select("x", "deviation", "w")
    # A vector of very many rows is one key: both sides are joined as they come, so that AQE may split it.
    out = usable.join(vectors, "x").select("vec_id", "deviation", F.explode(F.array(*(one(i) for i in range(k)))).alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))


def _identity_error(projected: DataFrame, used: list[int], n: int) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance (divisor n, centred) minus the identity; measured on all of them."""
    if not used:
        return None
    pairs = [(i, j) for i in used for j in used if i <= j]
    row = projected.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    return max(math.fabs(v - (i == j)) for (i, j), v in zip(pairs, row, strict=True))
