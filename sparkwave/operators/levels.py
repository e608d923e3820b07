"""Levels, silence and frame dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwave.functions.shaping import half_up
from sparkwave.operators.effects import COLUMNS, put
from sparkwave.operators.scans import Texts, chunked, joined, settle
from sparkwave.sources.signals import CHUNK, KEYS, pair_stereo, unpair_stereo, with_length
from sparkwave.sources.storage import work_dir


def normalize(df: DataFrame, peak: float = 0.9) -> DataFrame:
    """Largest absolute value becomes `peak`; null and NaN count as 0; a silent clip stays as it is."""
    size = F.max(F.when(F.isnan("x"), F.lit(0.0)).otherwise(F.coalesce(F.abs("x"), F.lit(0.0))))
    return put(df.join(df.groupBy(*KEYS).agg(size.alias("m")), KEYS), F.when(F.col("m") == 0, F.col("x")).otherwise(F.col("x") * (peak / F.col("m"))))


def chunk_level(df: DataFrame, size: int = 512) -> DataFrame:
    """(keys, chunk, level): sum of |x| / (size/4) (1 if silent), averaged with a louder next chunk; a short last chunk
    and a missing or zero level count as 2."""
    chunks = df.groupBy(*KEYS, F.floor(F.col("idx") / size).alias("chunk")).agg(F.sum(F.abs("x")).alias("s"), F.count("x").alias("c"))
    raw = F.when(F.col("c") < size, F.lit(2.0)).when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s") / (size / 4))
    nxt = F.lead("raw").over(Window.partitionBy(*KEYS).orderBy("chunk"))
    level = F.when(nxt > F.col("raw"), (F.col("raw") + nxt) / 2).otherwise(F.col("raw"))
    return chunks.withColumn("raw", raw).select(*KEYS, "chunk", level.alias("level"))


def dynamic_normalize(df: DataFrame, size: int = 512) -> DataFrame:
    """Divide by the level interpolated between the chunk and the next one (2 where there is none)."""
    levels = chunk_level(df, size)
    after = levels.select(*KEYS, (F.col("chunk") - 1).alias("chunk"), F.col("level").alias("after"))
    both = df.withColumn("chunk", F.floor(F.col("idx") / size)).join(levels.join(after, [*KEYS, "chunk"], "left"), [*KEYS, "chunk"])
    t = (F.col("idx") % size) / size
    return put(both, F.col("x") / (F.col("level") + (F.coalesce("after", F.lit(2.0)) - F.col("level")) * t))


def _edges(df: DataFrame, near: bool, where: str, tol: float, values: list[str]) -> DataFrame:
    """(keys, a, b, n): first and last position whose values all leave (or all stay within) `tol` of the edge values."""
    keys = [k for k in KEYS if k in df.columns]
    n = df.groupBy(*keys).agg((F.max("idx") + 1).alias("n"))
    sized = df.join(n, keys)
    ends = sized.where("idx = 0 or idx = n - 1").groupBy(*keys).agg(
        *[F.max(F.when(F.col("idx") == 0, F.col(v))).alias(f"f_{v}") for v in values],
        *[F.max(F.when(F.col("idx") == F.col("n") - 1, F.col(v))).alias(f"l_{v}") for v in values])
    sized = sized.join(ends, keys)

    def hit(side: str):
        out = F.lit(True)
        for v in values:
            far = F.abs(F.col(v) - F.col(f"{side}_{v}")) > tol
            out = out & (~far if near else far)
        return out

    return sized.groupBy(*keys, "n").agg(F.min(F.when(hit("f"), F.col("idx"))).alias("a"), F.max(F.when(hit("l"), F.col("idx"))).alias("b"))


def _cut(df: DataFrame, near: bool, where: str, tol: float, values: list[str]) -> DataFrame:
    keys = [k for k in KEYS if k in df.columns]
    e = _edges(df, near, where, tol, values)
    n = F.col("n")
    start = F.coalesce("a", F.lit(0)) if where in ("start", "both") else F.lit(0)
    end = F.coalesce("b", F.lit(0)) if where in ("end", "both") else n - 1
    start = F.when(start > end, end).otherwise(start) if where == "both" else start
    e = e.select(*keys, start.cast("long").alias("s"), end.cast("long").alias("e"))
    return df.join(e, keys).where("idx between s and e").withColumn("idx", F.col("idx") - F.col("s")).drop("s", "e")


def trim_silence(df: DataFrame, where: str = "both", tol: float = 0.0) -> DataFrame:
    """Cut leading or trailing samples within `tol` of the edge value.  Without an audible sample `start` keeps all and
    `end` and `both` keep one.  `all` drops flat runs (see flat_runs)."""
    if where == "all":
        return flat_runs(df, tol, keep=False)
    return _cut(df, False, where, tol, ["x"]).select(*COLUMNS)


def keep_silence(df: DataFrame, where: str = "both", tol: float = 0.0) -> DataFrame:
    """Cut to the first or last sample within `tol` of the edge value; `all` keeps only the flat runs."""
    if where == "all":
        return flat_runs(df, tol, keep=True)
    return _cut(df, True, where, tol, ["x"]).select(*COLUMNS)


def trim_silence_stereo(df: DataFrame, where: str = "both", tol: float = 0.0, near: bool = False) -> DataFrame:
    if where == "all":
        return unpair_stereo(flat_runs(pair_stereo(df), tol, keep=near, values=("l", "r")))
    return unpair_stereo(_cut(pair_stereo(df), near, where, tol, ["l", "r"]))


FLAT = 128  # samples of a flat run that stay


def _flat(values: np.ndarray, tol: float, inverse: bool, state: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, int], bool]:
    """Which samples stay: a run within tol of its anchor keeps the anchor's side up to the 128th sample.

    From and to a state (anchor, count), where a count of FLAT cuts until the run ends; also tells whether the last sample
    has just ended a cut."""
    n = len(values)
    stay = np.ones(n, bool)
    anchor, count = state if state is not None else (values[0], 0)
    i, ended = 0, False
    while i < n:
        if count >= FLAT:
            first = i
            while i < n:  # jump over the run by blocks
                block = np.abs(anchor - values[i : i + 4096]) <= tol
                same = block.all(axis=1) != inverse
                stop = np.flatnonzero(~same)
                i += int(stop[0]) if len(stop) else len(same)
                if len(stop):
                    break
            stay[first:i] = False
            if i < n:
                anchor, count, ended = values[i], 0, i == n - 1
        elif bool((np.abs(anchor - values[i]) <= tol).all()) != inverse:
            count += 1
        else:
            anchor, count = values[i], 0
        i += 1
    return stay, (anchor, count), ended


def flat_runs(df: DataFrame, tol: float, keep: bool = False, values: tuple[str, ...] = ("x",), chunk: int = CHUNK) -> DataFrame:
    """Per clip, in order, by chunks of `chunk` positions, whose anchors and counts settle in rounds (see scans.settle).

    States mostly meet within a chunk, so that two or three rounds do; a clip on which they never meet takes a round for each
    chunk.  Kept samples are stored with their number in each chunk; places in the result are sums over narrow rows of chunks.
    """
    keys = [k for k in KEYS if k in df.columns]
    text, spark = Texts(df, keys), df.sparkSession

    def walked(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, tuple]]:
        for start, *data in zip(pdf["start"], *(pdf[v] for v in values), strict=True):
            rows = np.stack(data, axis=1).astype(float)
            yield rows, _flat(rows, tol, keep, None if start is None else (np.asarray(start[:-1], float), int(start[-1])))

    def ends(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.append(anchor, count) for _, (_, (anchor, count), _) in walked(pdf)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(rows[stay], ended) for rows, (stay, _, ended) in walked(pdf)]
            yield pdf[[*keys, "c"]].assign(n=[len(r) for r, _ in parts], ended=[e for _, e in parts], **{v: [r[:, j] for r, _ in parts] for j, v in enumerate(values)})

    chunks, states = settle(chunked(df, values, chunk, keys), values, ends, keys)
    path = work_dir(spark, "kept")
    text.map(joined(chunks, states, keys), cut, "c long, n long, ended boolean, " + ", ".join(f"{v} array<double>" for v in values)).write.parquet(path)
    kept = spark.read.parquet(path)
    before = Window.partitionBy(*keys).orderBy("c")
    places = kept.select(*keys, "c", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("c").over(before).isNull().alias("last"))
    out = joined(kept, places, keys).select(*keys, "n", "ended", "base", "last", F.posexplode(F.arrays_zip(*values)).alias("i", "v"))
    out = out.where(~(F.col("last") & F.col("ended") & (F.col("i") == F.col("n") - 1)))  # a lone sample after the last cut
    types = dict(df.select(*values).dtypes)
    return out.select(*keys, (F.col("base") + F.col("i")).cast(dict(df.dtypes)["idx"]).alias("idx"), *[F.col(f"v.{v}").cast(types[v]).alias(v) for v in values])


# -- frame dictionary ----------------------------------------------------------------------------------------


def frame_dedup(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dict_id, data) of distinct frames by first appearance, and (clip_id, frame_no, dict_id).

    Partial aggregation folds the commonest frame (silence) before the shuffle.  Ids are dense per prefix of clips:
    numbering runs inside clips over the distinct frames that first appear there, then clip counts are added up.
    """
    first = frames.groupBy("data").agg(F.min(F.struct("clip_id", "frame_no")).alias("at"))
    per = first.groupBy(F.col("at.clip_id").alias("clip_id")).count()
    before = Window.orderBy("clip_id").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row a clip
    shift = per.select("clip_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("o"))
    number = F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_no")) - 1
    table = first.select("data", "at.clip_id", "at.frame_no").withColumn("r", number).join(shift, "clip_id")
    table = table.select((F.col("r") + F.col("o")).cast("long").alias("dict_id"), "data")
    return table, frames.join(table, "data").select("clip_id", "frame_no", "dict_id")


def undictionary(refs: DataFrame, table: DataFrame) -> DataFrame:
    """Samples (clip_id, idx, x) from references; frames of one size."""
    return refs.join(table, "dict_id").select("clip_id", "frame_no", F.size("data").alias("z"), F.posexplode("data").alias("p", "x")).select(
        "clip_id", (F.col("frame_no") * F.col("z") + F.col("p")).alias("idx"), "x")


def fingerprint(frames: DataFrame) -> DataFrame:
    """h = h*31 + byte mod 2**32, as lower-case hex."""
    h = F.aggregate("data", F.lit(0).cast("long"), lambda acc, b: (acc * 31 + b) % 4294967296)
    return frames.withColumn("fingerprint", F.lower(F.hex(h)))


def dedup_stats(frames: DataFrame) -> DataFrame:
    """Bytes stored per clip: 16 + 64 per distinct frame + 2 per reference; ratio to the samples."""
    g = frames.groupBy("clip_id").agg(F.countDistinct("data").alias("n_unique"), F.count("*").alias("n_frames"))
    size = 16 + 64 * F.col("n_unique") + 2 * F.col("n_frames")
    return g.select("clip_id", "n_unique", "n_frames", size.alias("bytes"), (size / (64 * F.col("n_frames"))).alias("ratio"))


def group4_encode(df: DataFrame) -> DataFrame:
    """(keys, g, byte) per four codes u: quarter of the average, and two bits for the strictly largest gap; partial groups 0."""
    at = lambda k: F.max(F.when(F.col("idx") % 4 == k, F.col("u")))
    g = df.groupBy(*KEYS, F.floor(F.col("idx") / 4).alias("g")).agg(*[at(k).alias(f"u{k}") for k in range(4)])
    d = [F.abs(F.col(f"u{k}") - F.col(f"u{k + 1}")) for k in range(3)]
    flag = F.when((d[0] > d[1]) & (d[0] > d[2]), 64).when((d[1] > d[0]) & (d[1] > d[2]), 128).when((d[2] > d[0]) & (d[2] > d[1]), 192).otherwise(0)
    code = F.least(half_up((F.col("u0") + F.col("u1") + F.col("u2") + F.col("u3")) / 16), F.lit(63))
    return g.select(*KEYS, "g", F.coalesce(code + flag, F.lit(0)).cast("int").alias("byte"))


def group4_decode(df: DataFrame) -> DataFrame:
    flag, avg = F.floor(F.col("byte") / 64), (F.col("byte") % 64) * 4
    half = F.greatest(F.lit(4.0), avg * 0.1) / 2
    low = lambda k: F.when(flag == k, avg - half)
    high = lambda k: F.when(flag == k, avg + half)
    parts = [low(1), F.coalesce(high(1), low(2)), F.coalesce(high(2), low(3)), high(3)]
    codes = [F.least(F.lit(255), F.greatest(F.lit(0), half_up(F.coalesce(p, avg.cast("double"))))) for p in parts]
    return df.select(*KEYS, "g", F.posexplode(F.array(*codes)).alias("k", "u")).select(*KEYS, (F.col("g") * 4 + F.col("k")).alias("idx"), "u")
