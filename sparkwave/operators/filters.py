"""Feedback filters and noise with memory: linear recurrences, counters and clamped walks as composed scans, others as settled scans."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwave.functions.shaping import half_up, uniform
from sparkwave.operators.effects import COLUMNS, asof_points, put
from sparkwave.sources.signals import KEYS, lagged, with_length
from sparkwave.operators.scans import CELLS, CHUNK, Texts, chunked, composed_scan, fold, joined, settled_scan

#: (state, inputs) -> (output, new state); state and inputs are lists of arrays over chunks; linear in state and first input.
Step = Callable[[list, list], tuple]


def linear_scan(df: DataFrame, step: Step, order: int, inputs: tuple[str, ...] = ("x",), first_state: Callable | None = None,
                keys: list[str] | None = None, chunk: int = CHUNK, constants: DataFrame | None = None) -> DataFrame:
    """keys, idx, y.  `idx` must be dense within keys; only inputs[0] is scaled, the others are coefficients, as are `constants` by clip.

    A composed scan: a chunk's numbers are its first input, its end from a zero state, and the matrix that its state before is
    multiplied by.
    """

    def at(d: np.ndarray, i: int, m: int) -> np.ndarray:
        return d[i, :m] if d.ndim == 2 else d[:m]

    def summary(data: list[np.ndarray], live: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = data[0].shape[1]
        scale = np.zeros((order + 1, 1))
        scale[0] = 1.0  # row 0: the input from a zero state; row j: no input, unit state j
        unit = [np.repeat((np.arange(order + 1) == j + 1).astype(float)[:, None], n, axis=1) for j in range(order)]

        def go(state: list, i: int, m: int) -> list:
            _, state = step(state, [scale * data[0][i, :m], *(at(d, i, m) for d in data[1:])])
            return [np.broadcast_to(s, (order + 1, m)) for s in state]

        end = np.stack(fold(go, unit, live))  # order x (order + 1) x chunks
        return np.concatenate([data[0][:1], end[:, 0], end[:, 1:].reshape(order * order, n)]).T

    def carry(state: np.ndarray, e: np.ndarray) -> np.ndarray:
        return e[1 + order :].reshape(order, order) @ state + e[1 : 1 + order]

    def finish(data: list[np.ndarray], live: np.ndarray, state: list[np.ndarray]) -> np.ndarray:
        y = np.empty(data[0].shape)
        for i, m in enumerate(live.tolist()):
            y[i, :m], state = step([s[:m] for s in state], [at(d, i, m) for d in data])
        return y

    return composed_scan(df, inputs, summary, lambda e: first_state(e[0]) if first_state else np.zeros(order), carry, finish, keys, chunk, constants)


def _out(scan: DataFrame) -> DataFrame:
    return scan.select(*KEYS, "idx", F.col("y").alias("x"))


def ema(df: DataFrame, pct: float, init: str = "first", chunk: int = CHUNK) -> DataFrame:
    """first: y = x + (y' - x)(1 - p), y0 = x0.  zero: y = y' + (x - y')p from 0."""
    p = pct / 100

    def step(s, x):
        y = x[0] * p + s[0] * (1 - p)
        return y, [y]

    return _out(linear_scan(df, step, 1, first_state=(lambda x0: [x0]) if init == "first" else None, chunk=chunk))


def comb(df: DataFrame, g: float, taps: int = 4, kind: str = "low", chunk: int = CHUNK) -> DataFrame:
    """y[i] = x[i] +- g*y[i-taps]: `taps` recurrences of order one, one for each remainder of the position."""
    sign = g if kind == "low" else -g
    dealt = df.select(*KEYS, (F.col("idx") % taps).alias("lane"), F.floor(F.col("idx") / taps).alias("idx"), "x")

    def step(s, x):
        y = x[0] + sign * s[0]
        return y, [y]

    out = linear_scan(dealt, step, 1, keys=[*KEYS, "lane"], chunk=chunk)
    return out.select(*KEYS, (F.col("idx") * taps + F.col("lane")).alias("idx"), F.col("y").alias("x"))


def echo_infinite(df: DataFrame, volume: float, delay_s: float, rate: int, chunk: int = CHUNK) -> DataFrame:
    d = int(math.floor(delay_s * rate + 0.5))
    return comb(df, volume, d, "low", chunk) if d else put(df, F.col("x") / (1 - volume))


def leaky_difference(df: DataFrame, pct: float, step_share: float, chunk: int = CHUNK) -> DataFrame:
    """x minus a leaky average of the samples before, blended by pct; the first is 0.  With pct -100 the average is of the
    outputs before, and the first sample stays."""
    p, t = step_share, pct / 100

    def own(s, x):
        acc = s[0] + (s[1] - s[0]) * p
        y = x[0] - acc
        return y, [acc, y]

    if pct == -100:
        return _out(linear_scan(df, own, 2, chunk=chunk))

    def step(s, x):
        acc = s[0] + (s[1] - s[0]) * p
        return x[0] - t * acc, [acc, x[0]]

    out = _out(linear_scan(df, step, 2, chunk=chunk))
    return put(out, F.when(F.col("idx") == 0, F.lit(0.0)).otherwise(F.col("x")))


def coefficients(kind: str, f: float, q: float, rate: int, gain_db: float = 0.0, pole_radius: float = 0.95) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2, normalized."""
    w = 2 * math.pi * f / rate
    c, s = math.cos(w), math.sin(w)
    al, a = s / (2 * q), 10 ** (gain_db / 40)
    root = 2 * math.sqrt(a) * al
    if kind in ("low", "high"):
        k = 1 - c if kind == "low" else 1 + c
        b, d = (k / 2, k if kind == "low" else -k, k / 2), (1 + al, -2 * c, 1 - al)
    elif kind == "bandpass":
        b, d = (al, 0.0, -al), (1 + al, -2 * c, 1 - al)
    elif kind == "peak":
        b, d = (1 + al * a, -2 * c, 1 - al * a), (1 + al / a, -2 * c, 1 - al / a)
    elif kind == "notch":
        b, d = (1.0, -2 * c, 1.0), (1.0, -2 * pole_radius * c, pole_radius**2)
    elif kind in ("lowshelf", "highshelf"):
        z = 1 if kind == "lowshelf" else -1
        b = (a * (a + 1 - z * (a - 1) * c + root), 2 * z * a * (a - 1 - z * (a + 1) * c), a * (a + 1 - z * (a - 1) * c - root))
        d = (a + 1 + z * (a - 1) * c + root, -2 * z * (a - 1 + z * (a + 1) * c), a + 1 + z * (a - 1) * c - root)
    elif kind == "allpass":
        b, d = (1 - al, -2 * c, 1 + al), (1 + al, -2 * c, 1 - al)
    elif kind in ("butter_low", "butter_high"):
        k = math.tan(w / 2)
        n = 1 / (1 + math.sqrt(2) * k + k * k)
        b = (k * k * n, 2 * k * k * n, k * k * n) if kind == "butter_low" else (n, -2 * n, n)
        d = (1.0, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n)
    else:
        raise ValueError(f"unknown filter {kind!r}")
    return tuple(x / d[0] for x in (*b, d[1], d[2]))


def _biquad_step(s, x):
    """Transposed direct form; all four direct forms have this transfer function.  Coefficients may vary by sample."""
    b0, b1, b2, a1, a2 = x[1:]
    y = b0 * x[0] + s[0]
    return y, [b1 * x[0] - a1 * y + s[1], b2 * x[0] - a2 * y]


BLEND = 32  # samples of a crossfade


def coefficients_by_clip(clips: DataFrame, kind: str, f: float, q: float, gain_db: float = 0.0, pole_radius: float = 0.95) -> DataFrame:
    """clip_id, k: the coefficients at each clip's sample_rate; columns f, q and gain_db of `clips` go before the given numbers."""
    own = [F.col(n).cast("double") if n in clips.columns else F.lit(float(v)) for n, v in (("f", f), ("q", q), ("gain_db", gain_db))]
    settings = clips.select("clip_id", F.col("sample_rate").cast("double").alias("rate"), *[c.alias(n) for c, n in zip(own, ("f", "q", "gain_db"), strict=True)])

    @F.pandas_udf("array<double>")
    def made(rate: pd.Series, f: pd.Series, q: pd.Series, gain_db: pd.Series) -> pd.Series:
        return pd.Series([list(coefficients(kind, b, c, a, d, pole_radius)) for a, b, c, d in zip(rate, f, q, gain_db, strict=True)])

    return settings.select("clip_id", made("rate", "f", "q", "gain_db").alias("k"))


def biquad(df: DataFrame, kind: str, f: float, q: float, rate: int | DataFrame, gain_db: float = 0.0, pole_radius: float = 0.95,
           form: str = "df1", crossfade: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Second-order filter; with crossfade the dry signal blends in over the first and out over the last 32 samples, and
    sample 0 is dry and not fed to the filter.  `rate` is one sample rate, or the clips' table (clip_id, sample_rate, and f, q or
    gain_db where these differ by clip too), one row a clip; clips that are not in it are left out."""
    by_clip = None if isinstance(rate, int | float) else coefficients_by_clip(rate, kind, f, q, gain_db, pole_radius)
    c = coefficients(kind, f, q, rate, gain_db, pole_radius) if by_clip is None else ()

    def step(s, x):
        return _biquad_step(s, [*x, *c])

    if not crossfade:
        return _out(linear_scan(df, step, 2, chunk=chunk, constants=by_clip))
    fed = put(df, F.when(F.col("idx") == 0, F.lit(0.0)).otherwise(F.col("x")))
    wet = linear_scan(fed, step, 2, chunk=chunk, constants=by_clip)
    both = with_length(df).join(wet, [*KEYS, "idx"])
    left = F.col("n") - 1 - F.col("idx")
    share = F.least(F.col("idx") / BLEND, left / BLEND, F.lit(1.0))
    return put(both, F.col("x") + (F.col("y") - F.col("x")) * share)


def biquad_mix(df: DataFrame, kind: str, f: float, q: float, rate: int, dry: float, wet: float, chunk: int = CHUNK) -> DataFrame:
    out = df.join(biquad(df, kind, f, q, rate, chunk=chunk).withColumnRenamed("x", "y"), [*KEYS, "idx"])
    return put(out, dry * F.col("x") + wet * F.col("y"))


def _varying(df: DataFrame, kind: str, f, q, rate: int, chunk: int) -> DataFrame:
    """y of a low, high or bandpass filter whose frequency and q are columns."""
    w = f * (2 * math.pi / rate)
    al, c = F.sin(w) / (2 * q), F.cos(w)
    k = {"low": 1 - c, "high": 1 + c}.get(kind)
    b = (al, F.lit(0.0), -al) if kind == "bandpass" else (k / 2, k if kind == "low" else -k, k / 2)
    a0 = 1 + al
    fed = df.select(*KEYS, "idx", "x", *[(v / a0).alias(n) for n, v in zip(("b0", "b1", "b2", "a1", "a2"), (*b, -2 * c, 1 - al), strict=True)])
    return linear_scan(fed, _biquad_step, 2, inputs=("x", "b0", "b1", "b2", "a1", "a2"), chunk=chunk)


def biquad_sweep(df: DataFrame, kind: str, f0: float, f1: float, q0: float, q1: float, dry0: float, dry1: float, wet0: float, wet1: float,
                 rate: int, chunk: int = CHUNK) -> DataFrame:
    """Frequency, q, dry and wet shares run linearly over the clip."""
    sized = with_length(df)
    t = F.col("idx") / F.col("n")
    y = _varying(sized, kind, f0 + (f1 - f0) * t, q0 + (q1 - q0) * t, rate, chunk)
    return put(sized.join(y, [*KEYS, "idx"]), (dry0 + (dry1 - dry0) * t) * F.col("x") + (wet0 + (wet1 - wet0) * t) * F.col("y"))


def biquad_automation(df: DataFrame, points: DataFrame, kind: str, q: float, rate: int, chunk: int = CHUNK) -> DataFrame:
    """The frequency follows automation points, interpolated at every sample."""
    return _out(_varying(asof_points(df, points), kind, F.col("freq"), F.lit(q), rate, chunk))


def delta_predict(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(keys, idx, byte): predictor p += 0.5*(x[i+2] - p); two bits from the change of the residual, six of the predictor."""
    ahead = lagged(df, {"x2": ("x", -2, 0.0)})

    def step(s, x):
        p = s[0] + 0.5 * (x[0] - s[0])
        return p, [p]

    p = linear_scan(ahead, step, 1, inputs=("x2",), chunk=chunk).withColumnRenamed("y", "p")
    both = lagged(ahead.join(p, [*KEYS, "idx"]), {"before": ("p", 1, 0.0)}).withColumn("diff", F.col("x") - F.col("before"))
    both = lagged(both, {"last": ("diff", 1, 0.0)})
    shift = F.greatest(F.lit(0), F.least(F.lit(3), 3 - half_up(F.abs(F.col("diff") - F.col("last")) * 3)))
    code = ((F.col("p") + 1) * 31).cast("long") * 4
    return both.select(*KEYS, "idx", shift.cast("long").bitwiseOR(code).bitwiseAND(F.lit(255).cast("long")).alias("byte"))


def pink_noise(df: DataFrame, vol: float, seed: int = 1, chunk: int = CHUNK, draws: str | None = None) -> DataFrame:
    """Six leaky sums of white noise and the white noise before; added to the signal."""
    # Decay and gain of each sum, share of this and of the last white sample.
    sums = [(0.99886, 0.0555179), (0.99332, 0.0750759), (0.969, 0.153852), (0.8665, 0.3104856), (0.55, 0.5329522), (-0.7616, -0.016898)]
    now, before = 0.5362, 0.115926
    white = df.withColumn("w", 2 * (F.col(draws) if draws else uniform(seed, *KEYS, "idx")) - 1)

    def step(s, x):
        b = [d * v + g * x[0] for (d, g), v in zip(sums, s, strict=False)]
        return sum(b) + s[6] + now * x[0], [*b, before * x[0]]

    pink = linear_scan(white, step, 7, inputs=("w",), chunk=chunk)
    return put(df.join(pink, [*KEYS, "idx"]), F.col("x") + F.col("y") * (vol * 0.11))


# -- nonlinear recurrences -----------------------------------------------------------------------------------------


def smooth_adaptive(df: DataFrame, pct: float, chunk: int = CHUNK) -> DataFrame:
    """Average with the output before, weighted by (1 - |difference|)**2."""
    p = pct / 100

    def step(y, x):
        d = y[0] - x
        w = 1 - np.abs(d)
        out = x + d * p * (w * w)
        return out, [out]

    return _out(settled_scan(df, step, lambda x: (x, [x]), chunk))


def delta_encode(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Difference to the rebuilt sample, limited to 8 bits."""

    def step(p, x):
        d = np.clip(np.floor(x * 127 + 0.5) - p[0], -128, 127)
        return d, [p[0] + d]

    out = settled_scan(df, step, lambda x: step([0.0], x), chunk)
    return out.select(*KEYS, "idx", F.col("y").cast("long").alias("code"))


def delta_1bit(df: DataFrame, stereo: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(keys, b, byte): an up/down counter against round((x+1)*8), eight bits a byte, bit j = 1 << j.  Two channels share one
    counter, left before right, and give one row of bytes (channel 0).

    A counter above all targets of a chunk goes up all the way, one not above any goes down; for those between, a chunk's numbers are a
    table of where each ends.
    """
    if stereo:
        df = df.select("clip_id", F.lit(0).alias("channel"), (F.col("idx") * 2 + F.col("channel")).alias("idx"), "x")
    df = df.withColumn("v", half_up((F.coalesce(F.nanvl("x", F.lit(0.0)), F.lit(0.0)) + 1) * 8))

    def moved(c: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.where(c > v, c + 1, c - 1)

    def summary(data: list[np.ndarray], live: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        out = []
        for j, n in enumerate(lengths.tolist()):
            v = data[0][:n, j]
            low, high = v.min(), v.max()
            out.append((n, low, high, np.arange(low + 1, high + 1)))
        width = max(len(t[3]) for t in out)
        together = max(1, CELLS // max(1, width))
        for a in range(0, len(out), together):
            part = out[a : a + together]
            starts = np.zeros((width, len(part)))
            for j, (_, _, _, entries) in enumerate(part):
                starts[: len(entries), j] = entries
            ends = fold(lambda s, i, m, a=a: [moved(s[0], data[0][i, a : a + m])], [starts], np.clip(live - a, 0, len(part)))[0]
            out[a : a + together] = [np.concatenate([[n, low, high], ends[: len(entries), j]]) for j, (n, low, high, entries) in enumerate(part)]
        return out

    def carry(state: np.ndarray, e: np.ndarray) -> np.ndarray:
        c, (n, low, high) = state[0], e[:3]
        return np.array([c + n if c > high else c - n if c <= low else e[3 + int(c - low) - 1]])

    def finish(data: list[np.ndarray], live: np.ndarray, state: list[np.ndarray]) -> np.ndarray:
        bits, c = np.zeros(data[0].shape), state[0]
        for i, m in enumerate(live.tolist()):
            c = c[:m]
            bits[i, :m] = c > data[0][i, :m]
            c = moved(c, data[0][i, :m])
        return bits

    bits = composed_scan(df, ("v",), summary, lambda e: np.zeros(1), carry, finish, chunk=chunk)
    return bits.groupBy(*KEYS, F.floor(F.col("idx") / 8).alias("b")).agg(F.sum(F.col("y").cast("long") * F.pow(F.lit(2), F.col("idx") % 8).cast("long")).alias("byte"))


# The code tables of three and seven bits, and what samples are scaled by.
CODES = {
    3: [0, 1, 2, 3, 6, 10, 15, 21],
    7: [
        0, 8, 16, 32, 48, 64, 80, 96, 112, 128, 144, 160, 176, 192, 208, 224, 240, 256, 272, 288, 304, 320, 336, 352, 368, 384, 400,
        416, 432, 448, 464, 480, 496, 512, 520, 528, 536, 544, 552, 560, 568, 576, 584, 592, 600, 608, 616, 624, 632, 640, 648, 656,
        664, 672, 680, 688, 696, 704, 712, 720, 728, 736, 744, 752, 760, 768, 776, 784, 792, 800, 808, 816, 824, 832, 840, 848, 856,
        864, 872, 880, 888, 896, 904, 912, 920, 928, 936, 944, 952, 960, 968, 976, 984, 992, 1000, 1008, 1016, 1024, 1088, 1152, 1216,
        1280, 1344, 1408, 1472, 1536, 1600, 1664, 1728, 1792, 1856, 1920, 1984, 2048, 2304, 2560, 2816, 3072, 3328, 3584, 3840, 4096,
        5120, 6144, 7168, 8192, 12288, 16384,
    ],
}
CODE_SCALE = {3: 127.0, 7: 32767.0}


def delta_codebook(df: DataFrame, bits: int = 3, scale: float | None = None, old: bool = False) -> DataFrame:
    """(keys, idx, code): index of the first table entry above |change to the sample before|, and the sign in the next bit
    (the old style inverts all bits instead)."""
    table, scale = CODES[bits], scale or CODE_SCALE[bits]
    top = len(table) - 1
    near = lagged(df.withColumn("v", (F.col("x") + 1) * scale), {"p": ("v", 1, 0.0)})
    d = F.col("v") - F.col("p")
    size = F.abs(d)
    index = F.lit(top)
    for k in range(top, -1, -1):
        index = F.when(size < table[k], F.lit(k)).otherwise(index)
    index = F.when(d == 0, F.lit(0)).otherwise(index)
    code = F.when(d < 0, (2 ** (bits + 1) - 1) - index if old else index + 2**bits).otherwise(index)
    return near.select(*KEYS, "idx", code.cast("long").alias("code"))


# -- noise with memory -------------------------------------------------------------------------------------------------

# Widths of steps of the clamped walks, the largest gap of chains, and twice the longest hold.
WALK = {"brown": 0.2, "pink_acc": 0.34, "orange": 0.06, "gray": 0.3}
GAP_FROM, GAP_TO = 0.05, {"green": 0.13, "yellow": 0.18}
HOLD = {"hold": 20, "hold_pink": 6, "hold_orange": 66}
# Fixed values of black noise: the limit of its slope, the least step and its fading a second, the step from which bursts add no more, what
# a burst adds at most, and the longest time between bursts in seconds.
SLOPE, LEAST, FADE, ENOUGH, BURST, QUIET = 0.005, 0.0006, 0.000579, 0.006, 0.003, 39


def walk_noise(df: DataFrame, kind: str, vol: float, seed: int = 1, rate: int = 8000, draws: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Noise with memory: brown, pink_acc, orange (clamped walks), gray, green, yellow (gaps by rejection), black (bursts),
    hold, hold_pink, hold_orange (random holds, longer for brown than for pink, longest for orange).

    Draws are uniform numbers from hashes of the position, or from the columns `draws` (one; gray takes two); proposals of chains and
    times of bursts are always hashes.  A hold's draw is the one at the position of its ordinal number.
    """
    number = iter(draws)
    u = lambda k: F.col(next(number)) if draws else uniform(seed + k, *KEYS, "idx")
    if kind in ("brown", "pink_acc", "orange"):
        y = saturating_walk(df.withColumn("_a", (u(0) - 0.5) * WALK[kind]), "_a", chunk).withColumn("y", F.col("y") / 2)
    elif kind == "gray":
        df = df.withColumns({"_a": (u(0) - 0.5) * WALK[kind], "_p": u(1) - 0.5})
        df = lagged(df, {"_before": ("_p", 1, 0.0)})
        y = saturating_walk(df, "_a", chunk).withColumnRenamed("y", "_w").join(df.select(*KEYS, "idx", "_p", "_before"), [*KEYS, "idx"])
        y = y.select(*KEYS, "idx", (0.25 * (F.col("_w") + 0.5 * (2 * F.col("_p") - F.col("_before")))).alias("y"))
    elif kind in GAP_TO:
        y = _chain(df.withColumn("_h", _hash(seed, "idx")), GAP_TO[kind], chunk)
    elif kind in HOLD:
        y = held(df.withColumn("_u", u(0)), "_u", HOLD[kind], chunk)
    elif kind == "black":
        y = _black(df.withColumn("_u", u(0)), seed, rate, chunk)
    else:
        raise ValueError(f"unknown noise {kind!r}")
    return put(df.select(*COLUMNS).join(y, [*KEYS, "idx"]), F.col("x") + vol * F.col("y"))


def saturating_walk(df: DataFrame, step: str, chunk: int = CHUNK) -> DataFrame:
    """keys, idx, y: sums of `step`, held within -1 and 1.  Such additions compose to one, x -> min(high, max(low, x + sum)): three
    numbers a chunk."""

    def moved(v, a):
        return np.clip(v + a, -1.0, 1.0)

    def summary(data: list[np.ndarray], live: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = data[0].shape[1]
        ends = fold(lambda s, i, m: [s[0] + data[0][i, :m], moved(s[1], data[0][i, :m]), moved(s[2], data[0][i, :m])], [np.zeros(n), np.full(n, -1.0), np.full(n, 1.0)], live)
        return np.stack(ends).T

    def carry(state: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.minimum(e[2], np.maximum(e[1], state + e[0]))

    def finish(data: list[np.ndarray], live: np.ndarray, state: list[np.ndarray]) -> np.ndarray:
        y, v = np.zeros(data[0].shape), state[0]
        for i, m in enumerate(live.tolist()):
            y[i, :m] = v = moved(v[:m], data[0][i, :m])
        return y

    return composed_scan(df, (step,), summary, lambda e: np.zeros(1), carry, finish, chunk=chunk)


def _hash(seed: int, *columns) -> Column:
    """53 bits, which a double holds."""
    return F.pmod(F.xxhash64(F.lit(seed), *KEYS, *columns), F.lit(1 << 53))


def proposal(h: np.ndarray, number: int) -> np.ndarray:
    """The number-th uniform draw of each hash, by the SplitMix64 generator."""
    with np.errstate(over="ignore"):
        # The published constants of SplitMix64.
        z = h.astype(np.uint64) + np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _chain(df: DataFrame, top: float, chunk: int) -> DataFrame:
    """keys, idx, y: each value is the first of its position's proposals at a distance of GAP_FROM to `top` from the last one.

    All chains see the same proposals, so chains from different starts soon take the same value and go on as one: chunks settle.
    """

    def step(p, h):
        v, todo, number = np.empty(len(h)), np.arange(len(h)), 1
        while len(todo):
            u = proposal(h[todo], number)
            gap = np.abs(p[0][todo] - u)
            fine = (gap >= GAP_FROM) & (gap <= top)
            v[todo[fine]] = u[fine]
            todo, number = todo[~fine], number + 1
        return v - 0.5, [v]

    return settled_scan(df, step, lambda h: step([proposal(h, 0)], h), chunk, ("_h",))


def held(df: DataFrame, draw: str, longest: int, chunk: int = CHUNK) -> DataFrame:
    """keys, idx, y: values draw - 0.5, each held for 1 + floor(|value| * longest) positions.

    The draw at a position is that of the hold with this ordinal number.  Where holds start is a sum of lengths, by chunks of ordinals and
    then over the narrow rows of chunks; holds that start within the clip are spread over their positions.
    """
    value = F.col(draw) - 0.5
    holds = df.select(*KEYS, "idx", value.alias("y"), (1 + F.floor(F.abs(value) * longest)).alias("size"), F.floor(F.col("idx") / chunk).alias("c"))
    inside = Window.partitionBy(*KEYS, "c").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*KEYS).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = holds.groupBy(*KEYS, "c").agg(F.sum("size").alias("total"), F.max("idx").alias("last"))
    chunks = chunks.withColumns({"base": F.coalesce(F.sum("total").over(before), F.lit(0)), "n": F.max("last").over(Window.partitionBy(*KEYS)) + 1}).where("base < n")
    starts = holds.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(chunks.select(*KEYS, "c", "base", "n"), [*KEYS, "c"])
    starts = starts.withColumn("start", F.col("start") + F.col("base")).where("start < n")
    end = F.least(F.col("start") + F.col("size"), F.col("n")) - 1
    return starts.select(*KEYS, F.explode(F.sequence("start", end)).alias("idx"), "y")


def bursts(h: float, rate: int, length: int) -> Iterator[tuple[int, float]]:
    """(position, step from there on) of black noise whenever a burst changes it, in order: a renewal sequence of hashed times."""
    when, step, at, number = 0.0, LEAST, 0, 0
    key, fade = np.array([h]), FADE / rate
    while True:
        when += float(proposal(key, 2 * number)[0]) * QUIET * rate
        hit = max(at, int(when) + 1)
        if hit >= length:
            return
        step = max(LEAST, step - fade * (hit - at))
        if step < ENOUGH:
            step += float(proposal(key, 2 * number + 1)[0]) * BURST
        at, number, step = hit + 1, number + 1, max(LEAST, step - fade)
        yield at, step


def _black(df: DataFrame, seed: int, rate: int, chunk: int) -> DataFrame:
    """keys, idx, y: a walk whose slope is a clamped walk too, turned back at -1 and 1; bursts raise the width of its steps, which fades.

    Bursts are few (one in 39 seconds or sooner); they are streamed along each clip and put into rows of chunks, from which each chunk
    makes its steps.  Slopes meet at their limits and levels at theirs, so chunks settle.
    """
    text = Texts(df, KEYS)
    clips = df.groupBy(*KEYS).agg((F.max("idx") + 1).alias("n")).withColumn("h", _hash(seed + 1).cast("double"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, n, h in zip(*(pdf[k] for k in KEYS), pdf["n"], pdf["h"], strict=True):
                n, at, step, coming = int(n), 0, LEAST, bursts(h, rate, int(n))
                following = next(coming, None)
                for first in range(0, n, 64 * chunk):
                    out = []
                    for c in range(first // chunk, min(first + 64 * chunk, n + chunk - 1) // chunk):
                        inside = []
                        begin = max(LEAST, step - FADE / rate * (c * chunk - at))
                        while following and following[0] < (c + 1) * chunk:
                            at, step = following
                            inside += [float(at - c * chunk), step]
                            following = next(coming, None)
                        out.append((*key, c, [begin, *inside]))
                    yield pd.DataFrame(out, columns=[*KEYS, "c", "b"])

    def widths(b: np.ndarray, n: int) -> np.ndarray:
        edges = [0, *b[1::2].astype(int).tolist(), n]
        parts = [np.maximum(LEAST, s - FADE / rate * np.arange(z - a)) for a, z, s in zip(edges[:-1], edges[1:], b[::2], strict=True)]
        return np.concatenate(parts)

    def wide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[*KEYS, "c", "_u"]].assign(_w=[widths(np.asarray(b), len(u)) for b, u in zip(pdf["b"], pdf["_u"], strict=True)])

    chunks = joined(chunked(df, ("_u",), chunk), text.map(clips, rows, "c long, b array<double>"), KEYS)
    chunks = text.map(chunks, wide, "c long, _u array<double>, _w array<double>")

    def step(state, u, width):
        slope = np.clip(state[0] + (u - 0.5) * width, -SLOPE, SLOPE)
        level = state[1] + slope
        over = np.abs(level) > 1
        level = np.where(over, np.sign(level), level)
        return level / 2, [np.where(over, 0.0, slope), level]

    return settled_scan(df, step, lambda u, w: step([0.0, 0.0], u, w), chunk, ("_u", "_w"), chunks)
