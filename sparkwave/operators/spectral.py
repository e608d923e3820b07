"""Spectral work on frames (clip_id, channel, frame_no, start_idx, data): whole Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.operators.effects import COLUMNS, put
from sparkwave.operators.scans import Texts, chunked, exploded
from sparkwave.sources.signals import KEYS, from_frames, to_frames


def _power_of_two(size: int) -> None:
    if size < 2 or size & (size - 1):
        raise ValueError("frame sizes are powers of two")


def map_frames(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """fn on matrices of equal-length frames (frames x samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, same in pdf.groupby(pdf["data"].map(len)):
                yield same.assign(data=list(fn(np.stack(same["data"].to_numpy()).astype(float))))

    return frames.mapInPandas(run, frames.schema)


def spectrum(frames: DataFrame) -> DataFrame:
    """Adds re, im, mag and phase arrays."""
    fields = ("re", "im", "mag", "phase")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, same in pdf.groupby(pdf["data"].map(len)):
                z = np.fft.fft(np.stack(same["data"].to_numpy()).astype(float))
                yield same.assign(**dict(zip(fields, map(list, (z.real, z.imag, np.abs(z), np.angle(z))), strict=True)))

    types = ", ".join(f"{k} {t}" for k, t in frames.dtypes)
    return frames.mapInPandas(run, types + "".join(f", {f} array<double>" for f in fields))


def _by_spectrum(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.fft.ifft(fn(np.fft.fft(x))).real


def fft_roundtrip(frames: DataFrame) -> DataFrame:
    return map_frames(frames, _by_spectrum(lambda z: z))


def fft_quantize_mag(frames: DataFrame, steps: float) -> DataFrame:
    return map_frames(frames, _by_spectrum(lambda z: np.floor(np.abs(z) * steps + 0.5) / steps * np.exp(1j * np.angle(z))))


def fft_quantize_phase(frames: DataFrame, steps: float) -> DataFrame:
    unit = 2 * np.pi / steps
    return map_frames(frames, _by_spectrum(lambda z: np.abs(z) * np.exp(1j * np.floor(np.angle(z) / unit + 0.5) * unit)))


def fft_smear(frames: DataFrame, radius: int, hann: bool = False) -> DataFrame:
    """Magnitude averaged over radius bins to both sides, normalized at the edges; phases stay."""
    k = np.arange(-radius, radius + 1)
    weight = 0.5 + 0.5 * np.cos(np.pi * k / max(radius, 1)) if hann else np.ones(len(k))  # 0 at the ends

    def smear(z: np.ndarray) -> np.ndarray:
        n = z.shape[1]
        band = sum(np.diag(np.full(n - abs(int(d)), w), int(d)) for d, w in zip(k, weight, strict=True) if abs(int(d)) < n)
        return np.abs(z) @ (band / band.sum(axis=1, keepdims=True)).T * np.exp(1j * np.angle(z))

    return map_frames(frames, _by_spectrum(smear))


def fft_saturate(frames: DataFrame, keep: float, direction: str = "up") -> DataFrame:
    """Magnitude as a running average across bins from 0, upward or downward; zero bins are passed over."""

    def run(z: np.ndarray) -> np.ndarray:
        mag, out = np.abs(z), np.abs(z)
        order = range(z.shape[1]) if direction == "up" else range(z.shape[1] - 1, -1, -1)
        level = np.zeros(len(z))
        for k in order:
            live = mag[:, k] > 0
            level = np.where(live, level * keep + mag[:, k] * (1 - keep), level)
            out[:, k] = np.where(live, level, 0)
        return out * np.exp(1j * np.angle(z))

    return map_frames(frames, _by_spectrum(run))


def fft_as_raw(frames: DataFrame, mode: str = "copytwice") -> DataFrame:
    """Samples read as a spectrum, mirrored and inverted.  The copy modes take pairs of samples for the lower half's bins
    (copytwice also the first pair for the middle bin), the fill modes one sample a bin (filltwice as real and imaginary part)."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        half = n // 2
        z = np.zeros(x.shape, complex)
        if mode.startswith("copy"):
            z[:, :half] = x[:, 0::2] + 1j * x[:, 1::2]
            z[:, half] = z[:, 0] if mode == "copytwice" else 0
        else:
            z[:] = x + (1j * x if mode == "filltwice" else 0)
        z[:, half + 1 :] = np.conj(z[:, 1:half][:, ::-1])
        return np.fft.ifft(z).real

    return map_frames(frames, run)


def fft_pitch_naive(frames: DataFrame, shift: float, window: bool = True) -> DataFrame:
    """Bin k takes bin floor(k/shift) of the lower half, mirrored; Hann window in and out."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if window else np.ones(n)
        z = np.fft.fft(x * hann)
        source = np.floor(np.arange(n // 2 + 1) / shift).astype(int)
        out = np.zeros_like(z)
        ok = source <= n // 2
        out[:, : n // 2 + 1][:, ok] = z[:, source[ok]]
        out[:, n // 2 + 1 :] = np.conj(out[:, 1 : n // 2][:, ::-1])
        return np.fft.ifft(out).real * hann

    return map_frames(frames, run)


def fft_morph(frames: DataFrame) -> DataFrame:
    """Frame i blended from the clip's first to its last frame by i/L; linear, so the blend is done on samples."""
    ends = frames.groupBy(*KEYS).agg(F.min_by("data", "frame_no").alias("a"), F.max_by("data", "frame_no").alias("b"), F.count("*").alias("n"))
    t = F.col("frame_no") / F.col("n")
    return frames.drop("data").join(ends, KEYS).withColumn("data", F.zip_with("a", "b", lambda x, y: x + (y - x) * t)).select(*KEYS, "frame_no", "start_idx", "data")


def _cosine(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def dct_roundtrip(frames: DataFrame) -> DataFrame:
    return map_frames(frames, lambda x: x @ _cosine(x.shape[1]).T @ _cosine(x.shape[1]))


def dct_reverse(frames: DataFrame) -> DataFrame:
    """Orthonormal cosine coefficients in reverse order, inverted."""
    return map_frames(frames, lambda x: (x @ _cosine(x.shape[1]).T)[:, ::-1] @ _cosine(x.shape[1]))


def on_signal(df: DataFrame, size: int, fn: Callable[[DataFrame], DataFrame], tail: str = "drop") -> DataFrame:
    """A frame function on samples; tail: drop, keep (partial frames stay as they are) or pad."""
    _power_of_two(size) if tail != "keep" else None
    frames = to_frames(df, size, tail=tail)
    if tail != "keep":
        return from_frames(fn(frames)).select(*COLUMNS)
    whole = fn(frames.where(F.size("data") == size))
    return from_frames(whole.unionByName(frames.where(F.size("data") < size))).select(*COLUMNS)


def impulse(length: int, decay: float, kind: str = "plain", damp: float = 0.5, spike_at: int = 1000, seed: int = 1) -> np.ndarray:
    """Decaying noise: plain, damped, spikes or rapid; a few seconds of samples, built once on the driver."""
    rng = np.random.default_rng(seed)
    i = np.arange(length)
    noise = (rng.random(length) * 2 - 1) * (1 - i / length) ** decay
    if kind == "plain":
        return noise
    factor = damp * (1 - np.sqrt(i / length) if kind == "rapid" else 1 - i * 0.5 / length)
    out, last, used = np.empty(length), 0.0, damp
    for k in range(length):
        last += used * (noise[k] - last)
        used = factor[k]
        out[k] = last
    if kind == "spikes":
        at, end = spike_at, length * np.log(length) * np.log10(length * 2)
        while at < min(length, end):
            out[int(at)] += np.sign(out[int(at)]) * np.cbrt(abs(out[int(at)]))
            at += at * (rng.random() + 0.5) if at else 1
    return out


SALTS = 64  # copies of each block of an impulse, so that no block is one key for all chunks


def impulse_blocks(spark: SparkSession, h: np.ndarray | DataFrame, size: int) -> DataFrame:
    """b, salt, h: blocks of `size` values of an impulse, given as an array or as a table (k, h), as a table."""
    if isinstance(h, np.ndarray):
        rows = [(b, h[b * size : (b + 1) * size].astype(float).tolist()) for b in range(-(-len(h) // size))]
        blocks = spark.createDataFrame(rows, "b long, h array<double>")
    else:
        blocks = h.groupBy(F.floor(F.col("k") / size).alias("b")).agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("s")).select("b", F.col("s.h").alias("h"))
    return blocks.select("b", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def reverb(df: DataFrame, h: np.ndarray | DataFrame, dry: float, wet: float, size: int = 4096) -> DataFrame:
    """dry*x + wet*(x convolved with h), length kept; a partitioned convolution, so h may be longer than a chunk or a clip.

    Chunks of `size` samples meet blocks of `size` impulse values by an equi-join on (block, salt); the product of chunk c and
    block b falls on chunks c + b and c + b + 1, where the parts are added up.  `idx` must be dense from 0.
    """
    _power_of_two(size)
    blocks = impulse_blocks(df.sparkSession, h, size)
    last = blocks.agg(F.max("b")).first()[0]  # one number
    if last is None:
        return put(df, F.col("x") * dry)
    chunks = chunked(df, ("x",), size)
    text = Texts(chunks, KEYS)
    met = chunks.withColumns({"b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))), "salt": F.pmod(F.xxhash64(*KEYS, "c"), F.lit(SALTS)).cast("int")})
    met = met.join(blocks, ["b", "salt"]).select(*KEYS, "c", "b", "x", "h")

    def convolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, same in pdf.groupby("b"):
                spectrum = np.fft.rfft(np.asarray(same["h"].iloc[0], float), 2 * size) * wet
                out = [np.fft.irfft(np.fft.rfft(np.asarray(x, float), 2 * size) * spectrum, 2 * size) for x in same["x"]]
                for half in (0, 1):
                    yield same[KEYS].assign(c=same["c"] + b + half, own=0, x=[y[half * size : (half + 1) * size] for y in out])

    parts = text.map(met, convolve, "c long, own int, x array<double>")
    parts = parts.unionByName(chunks.select(*KEYS, "c", F.size("x").alias("own"), F.transform("x", lambda v: v * dry).alias("x")))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["own"].max())
        if not n:
            return pd.DataFrame(columns=[*KEYS, "c", "y"])  # behind the clip's end
        total = np.zeros(size)
        for x in pdf["x"]:
            total[: len(x)] += x
        return pdf[[*KEYS, "c"]].iloc[:1].assign(y=[total[:n]])

    types = ", ".join(f"{k} {t}" for k, t in chunks.select(*KEYS).dtypes)
    out = exploded(parts.groupBy(*KEYS, "c").applyInPandas(add, f"{types}, c long, y array<double>"), KEYS, size)
    return out.select(*KEYS, "idx", F.col("y").alias("x"))
