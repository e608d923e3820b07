"""Views of the given tables as signals, frames and cues, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.sources.signals import index_signal

RATE = 8000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per user: value/100 - 0.5 in order of time."""
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value") / 100 - 0.5)
    return index_signal(events, ["user_id"], ["ts", "event_id"], "value").select(
        F.col("user_id").alias("clip_id"), F.lit(0).alias("channel"), "idx", "x")


def sig_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per event type, numbered by days and then added up."""
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value") / 100 - 0.5)
    indexed = index_signal(events, ["event_type"], ["ts", "event_id"], "value", bucket=F.to_date("ts"))
    return indexed.select(F.col("event_type").alias("clip_id"), F.lit(0).alias("channel"), "idx", "x")


def sig_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel 0 is sig, channel 1 the sample before."""
    return stereo(sig(spark, sf_dir))


def stereo(one: DataFrame) -> DataFrame:
    """A second channel, one sample late."""
    last = one.groupBy("clip_id").agg(F.max("idx").alias("n"))
    two = one.join(last, "clip_id").where("idx < n").select("clip_id", F.lit(1).alias("channel"), (F.col("idx") + 1).alias("idx"), "x")
    first = last.select("clip_id", F.lit(1).alias("channel"), F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("x"))
    return one.unionByName(two).unionByName(first)


def frames64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per embedding, numbered within its label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), "vec_id", F.col("embedding").cast("array<double>").alias("data"))
    framed = index_signal(rows, ["clip_id"], ["vec_id"], "data")
    return framed.select("clip_id", F.lit(0).alias("channel"), F.col("idx").alias("frame_no"), (F.col("idx") * 64).alias("start_idx"), F.col("x").alias("data"))


def frames64_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as bytes, coarse; every fifth one twice."""
    code = lambda v: F.floor((F.floor(v * 10 + 0.5) / 10 + 1) * 127.5 + 0.5).bitwiseAND(F.lit(255)).cast("int")
    f = frames64(spark, sf_dir).select("clip_id", "frame_no", F.transform("data", code).alias("data"))
    twice = f.where("frame_no % 5 = 0").withColumn("frame_no", F.col("frame_no") + 1000000)
    return f.unionByName(twice)


def cue_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("file_id"), F.col("turn").cast("int").alias("cue_no"), "role", (F.col("turn") * 3.5).alias("start_s"),
                        (F.col("turn") * 3.5 + 2.25).alias("end_s"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


SIG = """sig AS (
  SELECT user_id AS clip_id, 0 AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / 100 - 0.5 AS x FROM events),
len AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY clip_id)"""
LONG = """sig AS (
  SELECT event_type AS clip_id, 0 AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value / 100 - 0.5 AS x FROM events),
len AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY clip_id)"""
LR = "lr AS (SELECT clip_id, idx, x AS l, lag(x, 1, 0.0) OVER (PARTITION BY clip_id ORDER BY idx) AS r FROM sig)"
STEREO = "st AS (SELECT clip_id, 0 AS channel, idx, l AS x FROM lr UNION ALL SELECT clip_id, 1, idx, r FROM lr)"
FRAMES = "fr AS (SELECT label AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, CAST(embedding AS DOUBLE[]) AS data FROM embeddings)"
U8 = FRAMES + """,
u0 AS (SELECT clip_id, frame_no, list_transform(data, lambda v: CAST(floor((floor(v * 10 + 0.5) / 10 + 1) * 127.5 + 0.5) AS INTEGER) & 255) AS data FROM fr),
u8 AS (SELECT * FROM u0 UNION ALL SELECT clip_id, frame_no + 1000000, data FROM u0 WHERE frame_no % 5 = 0)"""
CUES = """cue AS (SELECT conv_id AS file_id, CAST(turn AS INTEGER) AS cue_no, role, turn * 3.5 AS start_s, turn * 3.5 + 2.25 AS end_s,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)"""
