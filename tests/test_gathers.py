"""Gathers, overlapping frames, long impulses, filters by clip, half precision: against plain numpy, and the shape of plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.operators import effects, filters, spectral
from sparkwave.sources import signals

SCHEMA = "clip_id long, channel int, idx long, x double"


def table(spark, data):
    rows = [(c, 0, i, float(v)) for c, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(11)
    data = {1: rng.normal(0, 0.5, 700), 2: rng.normal(0, 0.3, 65), 3: np.array([0.4]), 2**60 + 1: rng.uniform(-1, 1, 300)}
    return data, table(spark, data)


def got(df, name="x"):
    out = {}
    for r in df.orderBy("clip_id", "idx").collect():
        out.setdefault(r["clip_id"], []).append(r[name])
    return {k: np.array(v, float) for k, v in out.items()}


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [5, 64, 1 << 16])
def test_gathered_at_computed_places(signal, chunk):
    data, df = signal
    places = {"a": lambda i: i - i % 7, "b": lambda i: i - 5, "c": lambda i: i}
    out = signals.gathered(df, places, 6, chunk)
    for name, place in (("a", lambda i: i - i % 7), ("b", lambda i: i - 5), ("c", lambda i: i)):
        for c, v in got(out.withColumn("x", F.coalesce(name, F.lit(-9.0)))).items():
            want = [data[c][place(i)] if place(i) >= 0 else -9.0 for i in range(len(data[c]))]
            np.testing.assert_allclose(v, want)


def test_chorus_shuffles_samples_once(signal):
    data, df = signal
    out = effects.chorus(df, 0.7, 40.0, 0.01, 8000)
    assert plan(out)[1].count("Exchange hashpartitioning") == 1 and "Join" not in plan(out)[0]
    for c, v in got(out).items():
        x = data[c]
        for i in range(len(x)):
            place = i - (math.sin(math.pi / 2 + i * (2 * math.pi * 40.0 / 8000)) * 0.5 + 0.5) * 80
            low = math.floor(place)
            p = x[low] if low >= 0 else 0.0
            q = x[low + 1] if 0 <= low + 1 < len(x) else p
            assert v[i] == pytest.approx(x[i] + (0.7 * (p + (q - p) * (place - low)) if place >= 0 else 0.0), abs=1e-9)


@pytest.mark.parametrize("tail", ["drop", "keep", "pad"])
def test_overlapping_frames_multiply_no_samples(spark, signal, tail):
    data, df = signal
    frames = signals.to_frames(df, 16, 4, tail)
    assert "Generate" not in plan(frames)[0].split("Aggregate")[-1]  # samples are put into parts as they are; only border parts are copied
    sizes = {"drop": lambda n: n == 16, "keep": lambda n: True, "pad": lambda n: True}[tail]
    want = {(c, at): x[at : at + 16].tolist() for c, x in data.items() for at in range(0, len(x), 4) if sizes(len(x[at : at + 16]))}
    rows = {(r["clip_id"], r["start_idx"]): r["data"] for r in frames.collect()}
    assert rows == {k: v + [0.0] * (16 - len(v)) if tail == "pad" else v for k, v in want.items()}
    holes = df.where("clip_id = 1 and not idx between 8 and 12 and not idx between 40 and 70")
    rows = {(r["clip_id"], r["start_idx"]): r["data"] for r in signals.to_frames(holes, 16, 4, "keep").collect()}
    kept = [i for i in range(700) if not 8 <= i <= 12 and not 40 <= i <= 70]
    assert all(v == [data[1][i] for i in kept if at <= i < at + 16] for (_, at), v in rows.items())


def test_impulses_longer_than_frames_and_clips(spark, signal):
    data, df = signal
    rng = np.random.default_rng(3)
    for n in (1, 16, 17, 100, 900):
        h = rng.normal(size=n)
        as_table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(h)], "k long, h double").repartition(2)
        for given in (h, as_table):
            for c, v in got(spectral.reverb(df, given, 0.5, 0.4, 16)).items():
                np.testing.assert_allclose(v, 0.5 * data[c] + 0.4 * np.convolve(data[c], h)[: len(data[c])], atol=1e-9)
    assert got(spectral.reverb(df, np.zeros(0), 0.5, 0.4, 16))[3][0] == pytest.approx(0.2)


@pytest.mark.parametrize("chunk", [7, 4096])
def test_filters_with_parameters_of_each_clip(spark, signal, chunk):
    data, df = signal
    rows = [(1, 44100, 700.0, 0.7, 0.0), (2, 48000, 300.0, 2.0, 3.0), (3, 8000, 700.0, 0.7, 0.0), (2**60 + 1, 8000, 1500.0, 0.5, -6.0)]
    clips = spark.createDataFrame(rows, "clip_id long, sample_rate int, f double, q double, gain_db double")
    for crossfade in (False, True):
        out = got(filters.biquad(df, "peak", 1.0, 1.0, clips, crossfade=crossfade, chunk=chunk))
        for clip, rate, f, q, gain in rows:
            alone = got(filters.biquad(df.where(F.col("clip_id") == clip), "peak", f, q, rate, gain, crossfade=crossfade, chunk=chunk))
            np.testing.assert_allclose(out[clip], alone[clip], atol=1e-10)


def test_half_precision(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(0, 1e-6, 1000), 2.0 ** np.arange(-30, 17), 3 * 2.0 ** np.arange(-30, 16), [0.0, -0.0, 65519.9, 65520.0, -1e9, math.inf, -math.inf, math.nan, 2049.0, 2051.0, 1e-8]])
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(float)
    np.testing.assert_array_equal(got(effects.quantize_half(table(spark, {1: x})))[1], want)
