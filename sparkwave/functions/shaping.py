"""Column expressions on one sample: rounding, clipping, quantizing, shaping, easing, encoders, oscillators.

Rounding is floor(x + 0.5) throughout, unlike Spark's round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clip(x: Column, mode: str = "none", lo: float = -1.0, hi: float = 1.0) -> Column:
    """none, clamp (limit), wrap (floor modulo), bounce (triangle reflection); NaN stays NaN."""
    width = hi - lo
    if mode == "clamp":
        out = F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    elif mode == "wrap":
        out = x - F.floor((x - lo) / width) * width
        out = F.when((x >= lo) & (x < hi), x).otherwise(out)
    elif mode == "bounce":
        phase = (x - lo) - F.floor((x - lo) / (2 * width)) * (2 * width)
        out = F.when(x.between(lo, hi), x).otherwise(lo + F.least(phase, 2 * width - phase))
    elif mode == "none":
        return x
    else:
        raise ValueError(f"unknown clip mode {mode!r}")
    return F.when(F.isnan(x), x).otherwise(out)


def gain_clip(x: Column, gain: float, mode="none", lo=-1.0, hi=1.0, dc=0.0, dc_before=False, keep_nan=True) -> Column:
    """DC before, gain, clip, DC after, in this order; gain 0 gives 0 (NaN only if kept)."""
    if gain == 0:
        y = F.when(F.isnan(x) & F.lit(keep_nan), x).otherwise(F.lit(0.0))
        return y if dc_before else clip(y, mode, lo, hi) + dc
    y = clip((x + dc if dc_before else x) * gain, mode, lo, hi)
    y = y if dc_before else y + dc
    return y if keep_nan else F.when(F.isnan(y), F.lit(0.0)).otherwise(y)


def quantize(x: Column, bits: int, how: str = "round") -> Column:
    if bits >= 32:
        return x
    scale = float(2 ** (bits - 1))
    scaled = x * scale
    step = {"round": half_up, "floor": F.floor, "ceil": F.ceil, "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))}[how](scaled)
    return step.cast("double") / scale


def quantize_mulaw(x: Column, levels: int = 256, mu: float = 255.0) -> Column:
    """Compress, quantize to `levels`, expand."""
    pressed = F.signum(x) * F.log1p(mu * F.abs(x)) / math.log1p(mu)
    coded = half_up(pressed * (levels / 2)).cast("double") / (levels / 2)
    return F.signum(coded) * (F.pow(F.lit(1 + mu), F.abs(coded)) - 1) / mu


def distort(x: Column, pct: float, how: str) -> Column:
    """Sign-preserving shaping blended with the sample: x + (f(x) - x) * pct / 100."""
    size, sign = F.abs(x), F.signum(x)
    steps = F.floor(8 * size) / 8
    shape = {
        "sqrt": lambda: sign * F.sqrt(size),
        "cbrt": lambda: F.cbrt(x),
        "square": lambda: sign * size * size,
        "step8": lambda: F.when(x == 0, F.lit(0.0)).when(steps == 0, sign).otherwise(F.try_divide(x, steps)),
        "selfpow": lambda: F.when(x == 0, F.lit(0.0)).otherwise(sign * F.pow(size, size)),
        "sin": lambda: F.sin(x * (math.pi / 2)),
    }[how]()
    return x + (shape - x) * (pct / 100)


def ease(t: Column, easing: str) -> Column:
    """0 to 1 over t in 0 to 1: linear, ease_in, ease_out (quarter sines), cubic."""
    return {
        "linear": lambda: t,
        "ease_in": lambda: 1 - F.cos(t * (math.pi / 2)),
        "ease_out": lambda: F.sin(t * (math.pi / 2)),
        "cubic": lambda: t * t * (3 - 2 * t),
    }[easing]()


def to_u8(x: Column) -> Column:
    return ((x + 1) * 127.5).cast("long").bitwiseAND(F.lit(255))


def to_u8_round(x: Column) -> Column:
    return half_up((x + 1) * 127.5).bitwiseAND(F.lit(255))


def from_u8(u: Column) -> Column:
    return u / 127.5 - 1


def to_i16(x: Column) -> Column:
    return (x * 32767).cast("long")


def to_i12(x: Column) -> Column:
    return half_up(x * 2047)


def to_u12(x: Column) -> Column:
    return half_up((x + 1) * 2047.5)


def to_i24(x: Column) -> Column:
    return (x * 8388607).cast("long")


def to_i32(x: Column) -> Column:
    return half_up(x * 2147483647)


def _top_bit(x: Column, low: int, high: int) -> Column:
    """Place of the highest set bit, `low` at least and `high` at most."""
    out = F.lit(low)
    for k in range(low + 1, high + 1):
        out = F.when(x >= (1 << k), F.lit(k)).otherwise(out)
    return out


def to_mulaw_byte(x: Column) -> Column:
    """16-bit sample to sign, exponent, mantissa, inverted (bias 132, limit 32635)."""
    s = to_i16(x)
    size = F.least(F.abs(s), F.lit(32635)) + 132
    exponent = _top_bit(size, 7, 14) - 7
    mantissa = F.floor(size / F.pow(F.lit(2.0), exponent + 3)).bitwiseAND(F.lit(15))
    sign = F.when(s < 0, F.lit(128)).otherwise(F.lit(0))
    return F.lit(255) - (sign + exponent * 16 + mantissa).cast("long")


def to_alaw_byte(x: Column) -> Column:
    """12-bit magnitude, segment, step, XOR 0x55; input rounded to 1/65536."""
    s = F.floor(half_up(x * 65536) / 65536 * 4096 * 0.99975586)
    sign = F.when(s >= 0, F.lit(128)).otherwise(F.lit(0))
    size = F.least(F.abs(s), F.lit(4095))
    segment = F.lit(0)
    for k in range(7):
        segment = F.when(size >= (32 << k), F.lit(k + 1)).otherwise(segment)
    step = F.floor(size / F.pow(F.lit(2.0), F.greatest(segment, F.lit(1)))).bitwiseAND(F.lit(15))
    return (sign + segment * 16 + step).cast("long").bitwiseXOR(F.lit(0x55).cast("long"))


def to_alaw(x: Column, a: float = 87.6) -> Column:
    """Continuous A-law compander."""
    size, base = F.abs(x), 1 + math.log(a)
    return F.signum(x) * F.when(size < 1 / a, a * size / base).otherwise((1 + F.ln(F.greatest(a * size, F.lit(1.0)))) / base)


def note_hz(note: float) -> float:
    return 440.0 * 2 ** ((note - 69) / 12)


def oscillator(kind: str, idx: Column, hz: float, rate: int) -> Column:
    turn = idx * hz / rate
    part = turn - F.floor(turn)
    return {
        "sine": lambda: F.sin(turn * (2 * math.pi)),
        "saw": lambda: 2 * (part - 0.5),
        "triangle": lambda: F.abs(part - 0.5) * 4 - 1,
        "square": lambda: F.signum(part - 0.5),
    }[kind]()


def uniform(seed: int, *columns) -> Column:
    """Repeatable uniform numbers in [0, 1) from a hash of the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / float(1 << 53)
