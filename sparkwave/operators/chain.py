"""Chains of named effects: a registry, parameter coercion, and user effects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sparkwave.operators import effects, filters, levels, spectral, vocoder
from sparkwave.sources.signals import KEYS


def number(v) -> float:
    return float(v)


def percent(v) -> float:
    return float(str(v).rstrip("%")) / 100


def power_of_two(v) -> int:
    n = int(v)
    if n < 2 or n & (n - 1):
        raise ValueError(f"{v} is not a power of two")
    return n


def even(v) -> int:
    return int(v) - int(v) % 2


def complement(v) -> float:
    return 1 - float(v)


def framed(fn: Callable[..., DataFrame], tail: str = "drop") -> Callable[..., DataFrame]:
    """A function on frames as an effect on samples, with the frame size as a parameter."""
    return lambda df, size, **params: spectral.on_signal(df, size, lambda f: fn(f, **params), tail)


def reverb(df: DataFrame, secs: float, rate: int, decay: float, dry: float, wet: float, kind: str = "plain") -> DataFrame:
    return spectral.reverb(df, spectral.impulse(int(secs * rate), decay, kind), dry, wet)


@dataclass
class Effect:
    fn: Callable[..., DataFrame]
    coerce: dict[str, Callable] = field(default_factory=dict)
    channels: int = 1


EFFECTS: dict[str, Effect] = {
    "gain": Effect(effects.gain, {"m": number}),
    "clip": Effect(effects.gain_clip, {"gain": number}),
    "quantize": Effect(effects.quantize, {"bits": int}),
    "mulaw": Effect(effects.quantize_mulaw),
    "half": Effect(effects.quantize_half),
    "distort": Effect(effects.distort, {"pct": number}),
    "fade": Effect(effects.fade),
    "reverse": Effect(effects.reverse),
    "repeat": Effect(effects.repeat, {"times": number}),
    "silence": Effect(effects.pad_silence, {"secs": number, "rate": int}),
    "speed": Effect(effects.speed, {"s": number}),
    "hold": Effect(effects.hold, {"k": int}),
    "smooth_linear": Effect(effects.smooth_linear, {"k": int}),
    "smooth_ease": Effect(effects.smooth_ease, {"k": int}),
    "smooth": Effect(filters.ema, {"pct": number}),
    "smooth_adaptive": Effect(filters.smooth_adaptive, {"pct": number}),
    "echo": Effect(effects.echo, {"volume": number}),
    "echo_infinite": Effect(filters.echo_infinite, {"volume": number}),
    "chorus": Effect(effects.chorus),
    "difference": Effect(effects.difference, {"pct": number}),
    "comb": Effect(filters.comb, {"g": number, "taps": int}),
    "biquad": Effect(filters.biquad, {"f": number, "q": number}),
    "biquad_mix": Effect(filters.biquad_mix, {"f": number, "q": number}),
    "biquad_sweep": Effect(filters.biquad_sweep),
    "normalize": Effect(levels.normalize, {"peak": number}),
    "dynamic_normalize": Effect(levels.dynamic_normalize, {"size": int}),
    "trim": Effect(levels.trim_silence, {"tol": number}),
    "keep_silence": Effect(levels.keep_silence, {"tol": number}),
    "tone": Effect(effects.add_tone, {"note": number, "vol": number}),
    "noise": Effect(effects.add_noise, {"vol": number}),
    "walk_noise": Effect(filters.walk_noise, {"vol": number}),
    "pink_noise": Effect(filters.pink_noise, {"vol": number}),
    "sample_hold": Effect(effects.add_sample_hold),
    "gradient_noise": Effect(effects.add_gradient_noise),
    "biquad_automation": Effect(filters.biquad_automation, {"q": number}),
    "reverb": Effect(reverb, {"secs": number, "decay": number, "dry": number, "wet": number}),
    "fft_roundtrip": Effect(framed(spectral.fft_roundtrip), {"size": power_of_two}),
    "fft_morph": Effect(framed(spectral.fft_morph), {"size": power_of_two}),
    "fft_quantize_mag": Effect(framed(spectral.fft_quantize_mag), {"size": power_of_two, "steps": number}),
    "fft_quantize_phase": Effect(framed(spectral.fft_quantize_phase), {"size": power_of_two, "steps": number}),
    "fft_smear": Effect(framed(spectral.fft_smear), {"size": power_of_two, "radius": int}),
    "fft_saturate": Effect(framed(spectral.fft_saturate), {"size": power_of_two, "keep": complement}),
    "fft_as_raw": Effect(framed(spectral.fft_as_raw), {"size": power_of_two}),
    "fft_pitch_naive": Effect(framed(spectral.fft_pitch_naive, "pad"), {"size": power_of_two, "shift": number}),
    "dct_roundtrip": Effect(framed(spectral.dct_roundtrip, "keep"), {"size": even}),
    "dct_reverse": Effect(framed(spectral.dct_reverse, "keep"), {"size": even}),
    "vocoder": Effect(vocoder.vocoder_mono, {"shift": number}),
    "vocoder_stereo": Effect(vocoder.vocoder_stereo, {"shift": number}, channels=2),
    "mid_side": Effect(effects.mid_side, channels=2),
    "widen": Effect(effects.stereo_widen, {"g": number}, channels=2),
}


def register_effect(name: str, fn: Callable[..., DataFrame], coerce: dict[str, Callable] | None = None, channels: int = 1) -> None:
    """Add an effect of your own: any function from a samples table (and parameters) to a samples table."""
    if name in EFFECTS:
        raise ValueError(f"there is an effect named {name!r}")
    EFFECTS[name] = Effect(fn, coerce or {}, channels)


def coerce_params(name: str, raw: dict) -> dict:
    if name not in EFFECTS:
        raise KeyError(f"no effect named {name!r}")
    rules = EFFECTS[name].coerce
    return {k: rules[k](v) if k in rules else v for k, v in raw.items()}


def apply_chain(df: DataFrame, chain: list[tuple[str, dict]], channels: int = 1) -> DataFrame:
    """Effects in order; a two-channel effect needs a two-channel table."""
    for name, raw in chain:
        params = coerce_params(name, raw)
        if EFFECTS[name].channels > channels:
            raise ValueError(f"{name!r} needs {EFFECTS[name].channels} channels")
        df = EFFECTS[name].fn(df, **params).select(*KEYS, "idx", "x")
    return df
