"""Folders for tables that a job writes and reads again, and replays of tables as streams."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share; a local session may do without that setting."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _local_root()
    return f"{where.rstrip('/')}/sparkwave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sparkwave-")


def remove_work(spark: SparkSession) -> None:
    """Remove all folders that jobs of this application have made with `work_dir`; results that still read them are lost."""
    root = work_dir(spark, "none").rpartition("/")[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replay(rows: DataFrame, last: DataFrame | None = None, batches: int = 4) -> DataFrame:
    """`rows` as a stream of `batches` batches, and then those of `last` (which may move the watermark past all others).

    A batch has a file for each core, as one file is one task where rows are written without being split: with one file a batch, all
    that comes before a stream's shuffle would run on one core.
    """
    path = work_dir(rows.sparkSession, "replay")
    a_batch = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(batches * a_batch).write.parquet(path)
    if last is not None:
        time.sleep(0.1)  # files come in order of their times
        last.coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", a_batch).parquet(path)


#: The setting that streams with transformWithState need when they start.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that it has now, and give what it wrote."""
    path = work_dir(stream.sparkSession, "drained")
    with setting(stream.sparkSession, *STATE_STORE):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
