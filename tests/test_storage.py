"""Folders of jobs: one root an application, which can be removed."""

import os

from pyspark.sql import functions as F

from sparkwave.sources import storage


def test_work_folders_are_removed_together(spark):
    a, b = (storage.work_dir(spark, name).removeprefix("file:") for name in ("one", "two"))
    assert os.path.dirname(a) == os.path.dirname(b) and a != b
    spark.range(3).write.parquet(a)
    assert os.path.isdir(a)
    storage.remove_work(spark)
    assert not os.path.exists(os.path.dirname(a))
    assert spark.range(2).count() == 2


def test_settings_come_back(spark):
    name, value = storage.STATE_STORE
    before = spark.conf.get(name, None)
    with storage.setting(spark, name, value):
        assert spark.conf.get(name) == value
    assert spark.conf.get(name, None) == before


def test_a_batch_of_a_replay_is_read_by_all_cores(spark):
    """All rows come, `last` after the others, and no batch is one task."""
    rows, last = spark.range(1000), spark.range(1000, 1001)
    stream = storage.replay(rows, last).withColumn("task", F.spark_partition_id())
    got = storage.drain(stream).collect()
    assert sorted(r["id"] for r in got) == list(range(1001))
    assert {r["task"] for r in got} == set(range(spark.sparkContext.defaultParallelism))
