"""Shared helpers: the shared folder, cuts of the lineage, ASCII lower-casing, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a local session (one machine) gets
    a fresh folder, and a cluster an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not where and current.isDefined():
        where = current.get()
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sparkwave-ckpt-")
    if not current.isDefined():
        sc.setCheckpointDir(where)
    return where


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the application's folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/sparkwave-llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> None:
    """Remove all that this application has written with `fresh_dir`; results that still read it are lost.  (Checkpoints are Spark's own, which
    it removes with spark.cleaner.referenceTracking.cleanCheckpoints.)"""
    root = fresh_dir(spark, "none").rpartition("/")[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of narrow rows: they are written to a folder of their own in the shared one and read from there.

    An eager checkpoint works its last stage out twice (a count, then the files) and is read by as many tasks as wrote it.  Here the stage
    runs once and many small files are read by one task, so the driver has far fewer tasks to keep.  Wide rows (arrays of a whole text)
    are `checkpointed`, as Spark reads columns of files some thousand rows at a time.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = "4m"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python some megabytes at a time, for jobs that run inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


GROUP_BYTES = 4_000_000  # of texts that a task turns into Python strings at a time; a longer text is a group of its own


def text_runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of rows with about GROUP_BYTES of text in all."""
    first = total = 0
    for k, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if k > first and total + size > GROUP_BYTES:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(texts):
        yield first, len(texts)


def text_groups(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, which may be ten thousand whole ones, in groups of bounded size."""
    for first, last in text_runs(texts):
        yield texts.slice(first, last - first).to_pylist()


def over_texts(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas on frames with a bounded size of their column `text`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.slice(first, last - first).to_pandas() for b in batches for first, last in text_runs(b.column("text")))
        for frame in fn(frames):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return df.mapInArrow(run, schema)


def spread(files: DataFrame, n_files: int, a_task: int = 8) -> DataFrame:
    """A narrow table of files dealt evenly over tasks, about `a_task` files each.

    The number of tasks is stated and the rows are dealt in turn: AQE would else fold these small rows, each of which
    stands for a large file, into one task, and a deal by name is left out after a join by name.
    """
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(least, -(-n_files // a_task)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.  Pure ASCII text takes Spark's faster lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty.  With the doc_id it names a row, where doc_ids may repeat."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


KEY_ROWS = 500_000  # of (doc_id, key) that are broadcast: 50 MB at most


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores if a column of `df` has it already."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _matching(docs: DataFrame, rows: DataFrame, key: Column, how: str) -> DataFrame:
    a, b = free_name(docs, "row_id"), free_name(docs, "row_key")
    small = rows.select(F.col("doc_id").alias(a), F.col("key").alias(b))
    small = F.broadcast(small) if rows.count() <= KEY_ROWS else small
    return docs.join(small, F.col("doc_id").eqNullSafe(F.col(a)) & (key == F.col(b)), how)


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """`docs` without the rows whose (doc_id, key) are in gone(doc_id, key); null ids are equal; columns stay as they are."""
    return _matching(docs, cut(gone.select("doc_id", "key").distinct()), key, "left_anti")


def once(docs: DataFrame, repeated: DataFrame, key: Column) -> DataFrame:
    """`docs` with one row for each (doc_id, key) that is in repeated(doc_id, key); the other rows stay as they are."""
    repeated = cut(repeated.select("doc_id", "key").distinct())
    if repeated.isEmpty():
        return docs
    name = free_name(docs, "key")
    some = _matching(docs, repeated, key, "left_semi").withColumn(name, key).dropDuplicates(["doc_id", name]).drop(name)
    return _matching(docs, repeated, key, "left_anti").unionByName(some)


def _either(one: tuple[str, str], two: tuple[str, str], df: DataFrame) -> DataFrame:
    """(a, b): two rows for each of `df`, of the columns `one` and of the columns `two`; a union would work `df` out twice."""
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return df.select(F.explode(F.array(pair(*one), pair(*two))).alias("r")).select("r.*")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds: every round is two aggregations with map-side
    combining and two joins that AQE may split, so that a hub with many neighbours needs no single task.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = _either(("a", "b"), ("b", "a"), edges)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(_either(("b", "m"), ("a", "m"), large.join(low, "a")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cut(_either(("a", "b"), ("b", "b"), edges).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
