"""Scans along clips against plain loops; chunks of any length give one result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.functions.shaping import uniform
from sparkwave.operators import filters, levels

SCHEMA = "clip_id long, channel int, idx long, x double"
CHUNKS = [1, 16, 4096]


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(7)
    data = {1: rng.normal(0, 0.5, 130), 2: rng.normal(0, 0.3, 37), 3: np.array([0.4]), 2**60 + 1: rng.uniform(-1, 1, 90)}
    rows = [(c, 0, i, float(v)) for c, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return data, df.withColumns({"u": uniform(5, "clip_id", "idx"), "u2": uniform(6, "clip_id", "idx")})


def got(df, name="x"):
    out = {}
    for r in df.orderBy("clip_id", "idx").collect():
        out.setdefault(r["clip_id"], []).append(r[name])
    return {k: np.array(v, float) for k, v in out.items()}


def walk(steps):
    v, out = 0.0, []
    for s in steps:
        v = min(1.0, max(-1.0, v + s))
        out.append(v)
    return np.array(out)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_walks(signal, chunk):
    data, df = signal
    u, u2 = got(df, "u"), got(df, "u2")
    for kind, width in (("brown", 0.2), ("pink_acc", 0.34), ("orange", 0.06), ("brown", 0.2)):
        out = got(filters.walk_noise(df, kind, 0.5, draws=("u",), chunk=chunk))
        for c, x in data.items():
            np.testing.assert_allclose(out[c], x + 0.25 * walk((u[c] - 0.5) * width), atol=1e-12)
    out = got(filters.walk_noise(df, "gray", 0.5, draws=("u", "u2"), chunk=chunk))
    for c, x in data.items():
        p = u2[c] - 0.5
        np.testing.assert_allclose(out[c], x + 0.125 * (walk((u[c] - 0.5) * 0.3) + 0.5 * (2 * p - np.concatenate([[0], p[:-1]]))), atol=1e-12)


def test_walks_that_meet_their_limits(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0.1, 0.8, 500)
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(a)], SCHEMA)
    for chunk in (1, 7, 600):
        np.testing.assert_allclose(got(filters.saturating_walk(df, "x", chunk), "y")[1], walk(a), atol=1e-12)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_holds(signal, chunk):
    data, df = signal
    u = got(df, "u")
    for kind, longest in (("hold", 20), ("hold_pink", 6), ("hold_orange", 66)):
        out = got(filters.walk_noise(df, kind, 1.0, draws=("u",), chunk=chunk))
        for c, x in data.items():
            want = [v - 0.5 for v in u[c] for _ in range(1 + int(abs(v - 0.5) * longest))][: len(x)]
            np.testing.assert_allclose(out[c], x + want, atol=1e-12)


@pytest.mark.parametrize("chunk", [16, 4096])
def test_chains_and_bursts(signal, chunk):
    data, df = signal
    h = got(df.withColumn("h", filters._hash(1, "idx").cast("double")), "h")
    for kind, top in (("green", 0.13), ("yellow", 0.18)):
        out = got(filters.walk_noise(df, kind, 1.0, chunk=chunk))
        for c, x in data.items():
            p, want = float(filters.proposal(h[c][:1], 0)[0]), []
            for v in h[c]:
                k = 1
                while not 0.05 <= abs(p - (q := float(filters.proposal(np.array([v]), k)[0]))) <= top:
                    k += 1
                p = q
                want.append(p - 0.5)
            np.testing.assert_allclose(out[c], x + want, atol=1e-12)
    rate, u = 2, got(df, "u")  # so that bursts are many
    clip = got(df.groupBy("clip_id", "channel").agg(F.lit(0).alias("idx")).withColumn("h", filters._hash(2).cast("double")), "h")
    out = got(filters.walk_noise(df, "black", 1.0, rate=rate, draws=("u",), chunk=chunk))
    for c, x in data.items():
        draw = lambda k, c=c: float(filters.proposal(clip[c], k)[0])
        level, slope, step, number, burst, want = 0.0, 0.0, 0.0006, 0, draw(0) * 39 * rate, []
        for i, v in enumerate(u[c]):
            slope = max(-0.005, min(0.005, slope + (v - 0.5) * step))
            level += slope
            if abs(level) > 1:
                level, slope = math.copysign(1.0, level), 0.0
            want.append(level / 2)
            if burst < i:
                if step < 0.006:
                    step += draw(2 * number + 1) * 0.003
                number += 1
                burst += draw(2 * number) * 39 * rate
            step = max(0.0006, step - 0.000579 / rate)
        np.testing.assert_allclose(out[c], x + want, atol=1e-9)


@pytest.mark.parametrize("chunk", [1, 64, 4096])
def test_one_bit_counter(spark, signal, chunk):
    data, df = signal
    wild = spark.createDataFrame([(9, 0, i, v) for i, v in enumerate([30.0, -20.0, 0.0, math.nan, 8.0, 0.1] * 20)], SCHEMA)
    for name, table in (("a", df.select("clip_id", "channel", "idx", "x")), ("b", wild)):
        out = {}
        for r in filters.delta_1bit(table, chunk=chunk).orderBy("clip_id", "b").collect():
            out.setdefault(r["clip_id"], []).append(r["byte"])
        for c, x in (data if name == "a" else {9: [30.0, -20.0, 0.0, 0.0, 8.0, 0.1] * 20}).items():
            counter, bits = 0, []
            for v in x:
                up = counter > math.floor((v + 1) * 8 + 0.5)
                counter += 1 if up else -1
                bits.append(int(up))
            assert out[c] == [sum(b << j for j, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8)]


@pytest.mark.parametrize("chunk", [16, 4096])
def test_filters_over_clips_of_unequal_length(signal, chunk):
    data, df = signal
    out = got(filters.ema(df, 30, init="zero", chunk=chunk))
    adaptive, coded = got(filters.smooth_adaptive(df, 60, chunk=chunk)), got(filters.delta_encode(df, chunk=chunk), "code")
    for c, x in data.items():
        y, z, p = 0.0, x[0], 0
        for i, v in enumerate(x):
            y += (v - y) * 0.3
            z = v if i == 0 else v + (z - v) * 0.6 * (1 - abs(z - v)) ** 2
            d = max(-128, min(127, math.floor(v * 127 + 0.5) - p))
            p += d
            assert out[c][i] == pytest.approx(y, abs=1e-12) and adaptive[c][i] == pytest.approx(z, abs=1e-12) and coded[c][i] == d


def test_flat_runs_need_no_driver(spark, monkeypatch):
    x = np.concatenate([np.linspace(0, 1, 50), np.full(700, 0.5), np.linspace(0.5, 0, 40), np.zeros(300)])
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], SCHEMA).repartition(4)
    stay, _, ended = levels._flat(x[:, None], 0.01, False)
    for chunk in (1 << 16, 256, 97):
        with monkeypatch.context() as m:
            m.setattr(type(df), "collect", lambda self: pytest.fail("rows on the driver"))
            out = levels.flat_runs(df, 0.01, chunk=chunk)
        np.testing.assert_allclose(got(out)[1], x[stay][: -1 if ended else None])
