"""Signals as tables: samples(clip_id, channel, idx, x); positions, frames, channels, storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["clip_id", "channel"]
CHUNK = 65536


def index_signal(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 by `order`; gives keys, idx, x.

    `bucket` is an expression that grows with `order` (an hour of the time, say): rows are then numbered inside (keys,
    bucket) and shifted by the counts of earlier buckets, so that a key with very many rows is spread over tasks.
    """
    if bucket is None:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.select(*keys, number.cast("long").alias("idx"), F.col(value).alias("x"))
    df = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(*keys, "_b").count().select(*keys, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    number = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return df.withColumn("_n", number).join(shift, [*keys, "_b"]).select(*keys, (F.col("_n") + F.col("_o")).cast("long").alias("idx"), F.col(value).alias("x"))


def clip_lengths(df: DataFrame) -> DataFrame:
    """(keys, n): one small row per clip and channel, by partial aggregation."""
    return df.groupBy(*KEYS).agg((F.max("idx") + 1).alias("n"))


def with_length(df: DataFrame) -> DataFrame:
    return df.join(clip_lengths(df), KEYS)


def lagged(df: DataFrame, lags: dict[str, tuple[str, int, object]], chunk: int = CHUNK) -> DataFrame:
    """Add columns name -> (source column, offset, default); a negative offset looks ahead.

    Clips are cut into chunks of `chunk` positions; the rows that a neighbouring chunk needs are copied to it, so
    windows run within (clip, channel, chunk) and one long clip uses many tasks.  One shuffle.
    """
    back = max([0, *(k for _, k, _ in lags.values())])
    ahead = max([0, *(-k for _, k, _ in lags.values())])
    if max(back, ahead) > chunk:
        chunk = max(back, ahead)
    home, at = F.floor(F.col("idx") / chunk), F.col("idx") % chunk
    copies = F.array_compact(F.array(
        home, F.when(at >= chunk - back, home + 1) if back else F.lit(None).cast("long"),
        F.when((at < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("long"),
    ))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(*KEYS, "_chunk").orderBy("idx")
    out = {name: (F.lag(src, k, d) if k >= 0 else F.lead(src, -k, d)).over(w) for name, (src, k, d) in lags.items()}
    return spread.withColumns(out).where("_chunk = _home").drop("_chunk", "_home")


def gathered(df: DataFrame, places: dict[str, Callable[[Column], Column]], reach: int, chunk: int = CHUNK) -> DataFrame:
    """keys, idx, x and, for each name, the sample of the clip at a computed position (null where there is none).

    A place is a function of idx, from `reach` positions back to the row's own.  Chunks are arrays that begin with the `reach`
    samples before them, so that samples are taken by index inside an array: one shuffle, no join.
    """
    chunk = max(chunk, reach, 1)
    home = F.floor(F.col("idx") / chunk)
    copies = F.array_compact(F.array(home, F.when(F.col("idx") % chunk >= chunk - reach, home + 1)))
    spread = df.select(*KEYS, "idx", "x", F.explode(copies).alias("c"))
    rows = spread.groupBy(*KEYS, "c").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s")).where(F.element_at("s", -1)["idx"] >= F.col("c") * chunk)
    own = F.filter("s", lambda r: r["idx"] >= F.col("c") * chunk)
    rows = rows.withColumns({"own": own, "first": F.get("s", F.lit(0))["idx"]})
    names = list(places)
    at = lambda r, n: F.get("s", (r["p"][n] - F.col("first")).cast("int"))["x"]
    placed = F.transform("own", lambda r: F.struct(r["idx"].alias("idx"), r["x"].alias("x"), F.struct(*[places[n](r["idx"]).cast("long").alias(n) for n in names]).alias("p")))
    taken = F.transform(placed, lambda r: F.struct(r["idx"].alias("idx"), r["x"].alias("x"), *[F.when(r["p"][n] >= F.col("first"), at(r, n)).alias(n) for n in names]))
    return rows.select(*KEYS, F.inline(taken))


def to_frames(df: DataFrame, size: int, hop: int | None = None, tail: str = "drop") -> DataFrame:
    """Fixed frames (clip_id, channel, frame_no, start_idx, data); hop < size overlaps; tail drop, keep or pad (zeros)."""
    hop = hop or size
    if hop < size and size % hop == 0:
        return _overlapping(df, size, hop, tail)
    if hop == size:
        dealt = df.withColumn("frame_no", F.floor(F.col("idx") / size))
    else:
        first = F.greatest(F.lit(0), F.floor((F.col("idx") - size) / hop) + 1)
        dealt = df.withColumn("frame_no", F.explode(F.sequence(first, F.floor(F.col("idx") / hop))))
    frames = dealt.groupBy(*KEYS, "frame_no").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s")).select(
        *KEYS, F.col("frame_no").cast("long").alias("frame_no"), (F.col("frame_no") * hop).cast("long").alias("start_idx"), F.col("s.x").alias("data"))
    return _tailed(frames, size, tail)


def _tailed(frames: DataFrame, size: int, tail: str) -> DataFrame:
    if tail == "drop":
        return frames.where(F.size("data") == size)
    if tail == "pad":
        return frames.withColumn("data", F.slice(F.concat("data", F.array_repeat(F.lit(0.0), size)), 1, size))
    return frames


def _overlapping(df: DataFrame, size: int, hop: int, tail: str) -> DataFrame:
    """Frames from parts of `hop` samples: each is put together from its own part and the ones that follow, so samples aren't multiplied
    before the shuffle."""
    parts = df.groupBy(*KEYS, F.floor(F.col("idx") / hop).cast("long").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    parts = parts.select(*KEYS, "idx", F.struct("idx", F.col("s.x").alias("data")).alias("part"))
    after = range(1, size // hop)
    near = lagged(parts, {f"_{k}": ("part", -k, None) for k in after}, chunk=4096)
    none = F.array().cast("array<double>")
    follows = [F.when(F.col(f"_{k}.idx") == F.col("idx") + k, F.col(f"_{k}.data")) for k in after]
    # a part may be missing: the parts behind it then stand further to the left
    for k in after:
        for j in range(1, k):
            follows[k - 1] = F.coalesce(follows[k - 1], F.when(F.col(f"_{j}.idx") == F.col("idx") + k, F.col(f"_{j}.data")))
    data = F.concat("part.data", *[F.coalesce(f, none) for f in follows])
    frames = near.select(*KEYS, F.col("idx").alias("frame_no"), (F.col("idx") * hop).alias("start_idx"), data.alias("data"))
    return _tailed(frames, size, tail)


def from_frames(frames: DataFrame) -> DataFrame:
    return frames.select(*KEYS, "start_idx", F.posexplode("data").alias("pos", "x")).select(*KEYS, (F.col("start_idx") + F.col("pos")).alias("idx"), "x")


def pair_stereo(df: DataFrame) -> DataFrame:
    """(clip_id, idx, l, r)."""
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("x")))
    return df.groupBy("clip_id", "idx").agg(pick(0).alias("l"), pick(1).alias("r"))


def unpair_stereo(df: DataFrame) -> DataFrame:
    return df.select("clip_id", "idx", F.posexplode(F.array("l", "r")).alias("channel", "x")).select("clip_id", "channel", "idx", "x")


# The labels of eight-channel sound, and which are often ignored.
LAYOUT = [(0, "Front Left", False), (1, "Front Right", False), (2, "Center", False), (3, "LFE", True),
          (4, "Back Left", False), (5, "Back Right", False), (6, "Side Left", True), (7, "Side Right", True)]


def channel_layout(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAYOUT, "channel int, label string, often_ignored boolean")


def label_channels(df: DataFrame, drop_ignored: bool = False) -> DataFrame:
    """Attach the channel's label; the eight-row table is broadcast."""
    out = df.join(F.broadcast(channel_layout(df.sparkSession)), "channel", "left")
    return out.where(~F.coalesce("often_ignored", F.lit(False))) if drop_ignored else out


def write_signal(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 16) -> None:
    """Partitioned by a hash bucket of the clip, sorted by position inside files; a long clip may fill several files."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64("clip_id"), F.lit(buckets)))
    df.repartition("bucket", "clip_id", F.floor(F.col("idx") / (1 << 22))).sortWithinPartitions("bucket", *KEYS, "idx").write.partitionBy("bucket").format(fmt).option("header", "true").save(path)


def read_signal(spark: SparkSession, path: str, fmt: str = "parquet", keys: str = "clip_id long") -> DataFrame:
    return spark.read.schema(f"{keys}, channel int, idx long, x double").format(fmt).option("header", "true").load(path).select("clip_id", "channel", "idx", "x")
