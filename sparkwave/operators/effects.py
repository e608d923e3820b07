"""Effects that need one sample, its clip length, fixed neighbours, or a computed position of the same clip."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwave.functions import shaping as S
from sparkwave.sources.signals import KEYS, clip_lengths, gathered, lagged, pair_stereo, unpair_stereo, with_length


COLUMNS = [*KEYS, "idx", "x"]


def put(df: DataFrame, x: Column) -> DataFrame:
    return df.withColumn("x", x).select(*COLUMNS)


def gain(df: DataFrame, m: float) -> DataFrame:
    return put(df, F.col("x") * m)


def gain_clip(df: DataFrame, gain: float, **options) -> DataFrame:
    return put(df, S.gain_clip(F.col("x"), gain, **options))


def quantize(df: DataFrame, bits: int, how: str = "round") -> DataFrame:
    return put(df, S.quantize(F.col("x"), bits, how))


def quantize_half(df: DataFrame) -> DataFrame:
    """Nearest half-precision value: eleven significant bits, ties to even, steps of 2^-24 at least; from 65,520 on infinite."""
    x = F.col("x")
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.lit(-14.0), F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0))))) - 10)
    near = F.rint(size / step) * step
    infinite = F.lit(float("inf"))
    return put(df, F.when(F.isnan(x) | (size == infinite), x).otherwise(F.signum(x) * F.when(size >= 65520, infinite).otherwise(near)))


def quantize_mulaw(df: DataFrame, levels: int = 256, mu: float = 255.0) -> DataFrame:
    return put(df, S.quantize_mulaw(F.col("x"), levels, mu))


def distort(df: DataFrame, pct: float, how: str) -> DataFrame:
    if how == "slope_sign":
        return put(lagged(df, {"p": ("x", 1, 0.0)}), F.col("x") + (F.signum(F.col("x") - F.col("p")) - F.col("x")) * (pct / 100))
    return put(df, S.distort(F.col("x"), pct, how))


def fade(df: DataFrame, direction: str = "in", easing: str = "linear", lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Gain lo to hi ("in") or hi to lo ("out") over the clip."""
    start, end = (lo, hi) if direction == "in" else (hi, lo)
    return put(with_length(df), F.col("x") * (start + (end - start) * S.ease(F.col("idx") / F.col("n"), easing)))


def mid_side(df: DataFrame) -> DataFrame:
    l, r = F.col("l"), F.col("r")
    return unpair_stereo(pair_stereo(df).select("clip_id", "idx", ((l + r) / 2).alias("l"), ((l - r) / 2).alias("r")))


def mid_side_inverse(df: DataFrame) -> DataFrame:
    m, s = F.col("l"), F.col("r")
    return unpair_stereo(pair_stereo(df).select("clip_id", "idx", (m + s).alias("l"), (m - s).alias("r")))


def stereo_widen(df: DataFrame, g: float) -> DataFrame:
    m, s = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2 * g
    return unpair_stereo(pair_stereo(df).select("clip_id", "idx", (m + s).alias("l"), (m - s).alias("r")))


# -- position and gather ------------------------------------------------------------------------------------


def reverse(df: DataFrame) -> DataFrame:
    return with_length(df).select(*KEYS, (F.col("n") - 1 - F.col("idx")).alias("idx"), "x")


def repeat(df: DataFrame, times: float) -> DataFrame:
    """Whole copies and a part of one; times <= 0 is empty."""
    df = with_length(df)
    copies = F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(times)))))
    out = df.select("*", copies.alias("k")).select(*KEYS, (F.col("k") * F.col("n") + F.col("idx")).alias("idx"), "x", (F.col("n") * times).cast("long").alias("total"))
    return out.where("idx < total").select(*COLUMNS)


def pad_silence(df: DataFrame, secs: float, rate: int, at: str = "end") -> DataFrame:
    zeros = math.ceil(rate * secs)
    ends = clip_lengths(df).select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(zeros - 1))).alias("k"), "n") if zeros > 0 else None
    if ends is None:
        return df.select(*COLUMNS)
    place = F.col("k") if at == "start" else F.col("n") + F.col("k")
    moved = df.select(*KEYS, (F.col("idx") + zeros).alias("idx") if at == "start" else "idx", "x")
    return moved.unionByName(ends.select(*KEYS, place.cast("long").alias("idx"), F.lit(0.0).alias("x")))


def speed(df: DataFrame, s: float, smooth: bool = False, last: str = "zero") -> DataFrame:
    """out[j] = x at j*s; length round(n/s); whole speeds never interpolate; the last sample is 0 (or held)."""
    lengths = clip_lengths(df)
    if s == int(s):
        smooth = False
    if smooth:
        df = lagged(df, {"b": ("x", -1, None)})
    size = S.half_up(F.col("n") / s)
    # the output grid grows from the samples themselves: each position covers the outputs between it and the next
    first, end = F.ceil(F.col("idx") / s), F.ceil((F.col("idx") + 1) / s) - 1
    grid = df.join(lengths, KEYS).withColumn("m", size).where(first <= end)
    grid = grid.select(*KEYS, "n", "m", "idx", "x", *(["b"] if smooth else []), F.explode(F.sequence(first, end)).alias("j"))
    if smooth:
        part = F.col("j") * s - F.col("idx")
        grid = grid.withColumn("x", F.col("x") + (F.coalesce("b", "x") - F.col("x")) * part)
    out = grid.where("j < m")
    value = F.when((F.col("j") == F.col("m") - 1) & F.lit(last == "zero"), F.lit(0.0)).otherwise(F.col("x"))
    tail = lengths.withColumn("m", size).join(df.select(*KEYS, (F.col("idx") + 1).alias("n"), "x"), [*KEYS, "n"])
    covered = F.ceil(F.col("n") / s)
    tail = tail.where(covered < F.col("m")).select(*KEYS, F.explode(F.sequence(covered, F.col("m") - 1)).alias("j"), "m", "x")
    out = out.select(*KEYS, "j", "m", "x").unionByName(tail)
    return out.select(*KEYS, F.col("j").cast("long").alias("idx"), value.alias("x"))


def resample(df: DataFrame, clips: DataFrame, old: int, new: int, smooth: bool = False) -> tuple[DataFrame, DataFrame]:
    """Samples at the new rate, and clips with the new rate and lengths."""
    out = speed(df, old / new, smooth)
    sized = clips.withColumns({"sample_rate": F.lit(new), "n_samples": S.half_up(F.col("n_samples") * (new / old))})
    return out, sized


def hold(df: DataFrame, k: int) -> DataFrame:
    block = Window.partitionBy(*KEYS, F.floor(F.col("idx") / k)).orderBy("idx")
    return put(df, F.first("x").over(block))


def _anchored(df: DataFrame, k: int) -> DataFrame:
    """Each sample with the anchor before it (a, at the largest multiple of k) and after it (b, null past the end)."""
    anchors = df.where(F.col("idx") % k == 0).select(*KEYS, (F.col("idx") / k).cast("long").alias("g"), F.col("x").alias("a"))
    after = anchors.select(*KEYS, (F.col("g") - 1).alias("g"), F.col("a").alias("b"))
    return df.withColumn("g", F.floor(F.col("idx") / k)).join(anchors.join(after, [*KEYS, "g"], "left"), [*KEYS, "g"])


def smooth_linear(df: DataFrame, k: int) -> DataFrame:
    """Linear between anchors k apart; a missing right anchor counts as 0."""
    t = (F.col("idx") % k) / k
    return put(_anchored(df, k), F.col("a") + (F.coalesce("b", F.lit(0.0)) - F.col("a")) * t)


def smooth_ease(df: DataFrame, k: int) -> DataFrame:
    """Cosine easing between anchors; a missing right anchor is the clip's last sample."""
    last = with_length(df).where("idx = n - 1").select(*KEYS, F.col("x").alias("z"))
    t = (1 - F.cos((F.col("idx") % k) / k * math.pi)) / 2
    return put(_anchored(df, k).join(last, KEYS), F.col("a") + (F.coalesce("b", "z") - F.col("a")) * t)


def echo(df: DataFrame, volume: float, n: int, delay_s: float, decay: float, rate: int, near: int = 65536) -> DataFrame:
    """x[i] + sum of volume * decay**(k-1) * x[i - k*D]; delay 0 is the sum of the gains.  Up to `near` positions back the echoes
    are lags over chunks; farther ones are shifted copies that are added up by position."""
    d = int(math.floor(delay_s * rate + 0.5))
    if d == 0:
        return put(df, F.col("x") * (1 + sum(volume * decay ** (k - 1) for k in range(1, n + 1))))
    if n * d <= near:
        taps = lagged(df, {f"e{k}": ("x", k * d, 0.0) for k in range(1, n + 1)})
        return put(taps, F.col("x") + sum(volume * decay ** (k - 1) * F.col(f"e{k}") for k in range(1, n + 1)))
    shifted = with_length(df).select(*KEYS, "idx", "x", "n", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    share = F.when(F.col("k") == 0, F.col("x")).otherwise(F.col("x") * volume * F.pow(F.lit(float(decay)), F.col("k") - 1))
    return shifted.select(*KEYS, (F.col("idx") + F.col("k") * d).alias("idx"), share.alias("x"), "n").where("idx < n").groupBy(*KEYS, "idx").agg(F.sum("x").alias("x"))


def chorus(df: DataFrame, volume: float, lfo_hz: float, depth_s: float, rate: int, smooth: bool = True) -> DataFrame:
    """x + volume * x at a sine-swept delay; before the start there is silence."""
    delay = lambda i: (F.sin(math.pi / 2 + i * (2 * math.pi * lfo_hz / rate)) * 0.5 + 0.5) * (depth_s * rate)
    low = lambda i: F.floor(i - delay(i))
    taps = gathered(df, {"p": low, "q": lambda i: low(i) + 1}, math.ceil(abs(depth_s) * rate) + 1)
    place = F.col("idx") - delay(F.col("idx"))
    zero = F.lit(0.0)
    p = F.coalesce("p", zero)
    q = F.coalesce("q", "p", zero)
    wet = p + (q - p) * (place - F.floor(place)) if smooth else p
    return put(taps, F.col("x") + volume * F.when(place < 0, zero).otherwise(wet))


def difference(df: DataFrame, pct: float) -> DataFrame:
    """x - pct/100 of the sample before; the first is 0."""
    return put(lagged(df, {"p": ("x", 1, None)}), F.when(F.col("p").isNull(), F.lit(0.0)).otherwise(F.col("x") - F.col("p") * (pct / 100)))


def alternating_difference(df: DataFrame) -> DataFrame:
    """y[i] = x[i] - y[i-1], in closed form: a running sum with alternating signs, by chunks."""
    sign = F.when(F.col("idx") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    df = df.withColumns({"s": F.col("x") * sign, "c": F.floor(F.col("idx") / 65536)})
    before = Window.partitionBy(*KEYS).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offset = df.groupBy(*KEYS, "c").agg(F.sum("s").alias("t")).select(*KEYS, "c", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("o"))
    inside = Window.partitionBy(*KEYS, "c").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return put(df.withColumn("r", F.sum("s").over(inside)).join(offset, [*KEYS, "c"]), (F.col("r") + F.col("o")) * sign)


def asof_points(df: DataFrame, points: DataFrame, chunk: int = 65536) -> DataFrame:
    """clip_id, channel, idx, x, freq: linear between the points around each position, held outside.

    As-of join by union; each chunk also gets the last point before and the first point after it, from a window over chunks.
    """
    c = F.floor(F.col("pos") / chunk)
    p = points.select("clip_id", "pos", "freq", F.struct("pos", "freq").alias("p"), c.alias("c"))
    edges = p.groupBy("clip_id", "c").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    chunks = df.select("clip_id", F.floor(F.col("idx") / chunk).alias("c")).distinct().join(edges, ["clip_id", "c"], "full")
    order = Window.partitionBy("clip_id").orderBy("c")
    chunks = chunks.select("clip_id", "c", F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                           F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    rows = df.select("clip_id", "channel", F.col("idx").alias("pos"), "x", F.floor(F.col("idx") / chunk).alias("c"), F.lit(None).cast("struct<pos:bigint,freq:double>").alias("p"))
    channels = df.select(*KEYS).distinct()
    marks = p.join(channels, "clip_id").select("clip_id", "channel", F.col("pos").cast("long"), F.lit(None).cast("double").alias("x"), "c", F.col("p").cast("struct<pos:bigint,freq:double>"))
    both = rows.unionByName(marks)
    w = Window.partitionBy(*KEYS, "c").orderBy("pos")
    seen = both.select("*", F.last("p", True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("l"),
                       F.first("p", True).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("r")).where("p is null")
    seen = seen.join(chunks, ["clip_id", "c"]).select(*KEYS, F.col("pos").alias("idx"), "x", F.coalesce("l", "before").alias("l"), F.coalesce("r", "after").alias("r"))
    l, r = F.col("l"), F.col("r")
    between = l["freq"] + (r["freq"] - l["freq"]) * F.try_divide(F.col("idx") - l["pos"], r["pos"] - l["pos"])
    return seen.select(*COLUMNS, F.coalesce(F.when(l["pos"] == r["pos"], l["freq"]), between, l["freq"], r["freq"]).alias("freq"))


def local_peaks(df: DataFrame) -> DataFrame:
    """Positions 1 to n-3 whose value is above both neighbours."""
    near = lagged(with_length(df), {"p": ("x", 1, None), "q": ("x", -1, None)})
    return near.where("idx >= 1 and idx <= n - 3 and x > p and x > q").select(*COLUMNS)


# -- generators -------------------------------------------------------------------------------------------------


def add_tone(df: DataFrame, kind: str, note: float, vol: float, rate: int) -> DataFrame:
    """Sine, saw, triangle or square of a note number, added."""
    return put(df, F.col("x") + vol * S.oscillator(kind, F.col("idx"), S.note_hz(note), rate))


def add_noise(df: DataFrame, kind: str, vol: float, seed: int = 1, draws: str | None = None) -> DataFrame:
    """White, violet or blue noise: repeatable draws from a hash of the position, without a window, or from the column `draws`."""
    if draws:
        df = lagged(df.withColumn("_now", F.col(draws) - 0.5), {"_before": ("_now", 1, 0.0)})
        now, before = F.col("_now"), F.col("_before")
    else:
        u = lambda i: F.when(i >= 0, S.uniform(seed, *KEYS, i) - 0.5).otherwise(F.lit(0.0))
        now, before = u(F.col("idx")), u(F.col("idx") - 1)
    wave = {"white": now, "violet": (now - before) / 2, "blue": (2 * now - before) / 4}[kind]
    return put(df, F.col("x") + wave * (vol * 0.02))


def add_sample_hold(df: DataFrame, every: int, jitter: float, vol: float, seed: int = 1) -> DataFrame:
    held = S.uniform(seed, *KEYS, F.floor(F.col("idx") / every)) - 0.5
    return put(df, F.col("x") + vol * (held + jitter * (S.uniform(seed + 1, *KEYS, "idx") - 0.5)))


def add_gradient_noise(df: DataFrame, n1: float, n2: float, n3: float, vol: float, seed: int = 1) -> DataFrame:
    """One-dimensional gradient noise: 0.5, 0.3 and 0.2 of three periods 127 - n/2."""
    total = F.lit(0.0)
    for share, n in ((0.5, n1), (0.3, n2), (0.2, n3)):
        p = F.col("idx") / (127 - n / 2)
        cell, t = F.floor(p), p - F.floor(p)
        slope = lambda c: F.when(S.uniform(seed, c % 44100) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
        f = t * t * t * (t * (t * 6 - 15) + 10)
        a, b = slope(cell) * t, slope(cell + 1) * (t - 1)
        total = total + share * (a + (b - a) * f)
    return put(df, F.col("x") + vol * total)
