import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.operators import chain, effects, filters, levels, spectral, vocoder
from sparkwave.sources import signals, wav

SCHEMA = "clip_id long, channel int, idx long, x double"


@pytest.fixture(scope="module")
def clips(spark):
    """Clips of 1, 37 and 700 samples, shuffled."""
    rng = np.random.default_rng(7)
    data = {c: rng.normal(0, 0.4, n) for c, n in ((1, 1), (2, 37), (3, 700))}
    rows = [(c, 0, i, float(v)) for c, x in data.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    return data, spark.createDataFrame([tuple([int(a), int(b), int(c), float(d)]) for a, b, c, d in rows], SCHEMA).repartition(5)


def got(df):
    out = {}
    for r in df.orderBy("clip_id", "idx").collect():
        out.setdefault(r["clip_id"], []).append(r["x"])
    return {k: np.array(v) for k, v in out.items()}


def same(df, expected):
    have = got(df)
    assert set(have) == {k for k, v in expected.items() if len(v)}
    for k, v in have.items():
        np.testing.assert_allclose(v, expected[k], atol=1e-9)


def loop_biquad(x, c):
    y = np.zeros(len(x))
    for i in range(len(x)):
        past = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: B023
        y[i] = c[0] * x[i] + c[1] * past(x, 1) + c[2] * past(x, 2) - c[3] * past(y, 1) - c[4] * past(y, 2)
    return y


@pytest.mark.parametrize("chunk", [8, 64, 4096])
def test_scans_do_not_depend_on_chunks(clips, chunk):
    data, df = clips
    c = filters.coefficients("peak", 900, 0.7, 8000, 4.0)
    same(filters.biquad(df, "peak", 900, 0.7, 8000, 4.0, chunk=chunk), {k: loop_biquad(x, c) for k, x in data.items()})

    def loop_comb(x):
        y = x.copy()
        for i in range(4, len(x)):
            y[i] += 0.5 * y[i - 4]
        return y

    same(filters.comb(df, 0.5, chunk=chunk), {k: loop_comb(x) for k, x in data.items()})


@pytest.mark.parametrize("chunk", [16, 4096])
def test_nonlinear_scans_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(3)
    data = {None: rng.uniform(-1, 1, 70), 5: np.repeat(rng.uniform(-1, 1, 9), 20), 2**60 + 1: np.full(50, 0.25), 7: np.array([1.0])}
    df = spark.createDataFrame([(c, 0, i, float(v)) for c, x in data.items() for i, v in enumerate(x)], SCHEMA).repartition(5)

    def adaptive(x):
        y = list(x)
        for i in range(1, len(y)):
            y[i] = x[i] + (y[i - 1] - x[i]) * 0.9 * (1 - abs(x[i] - y[i - 1])) ** 2
        return y

    def deltas(x):
        out, p = [], 0
        for v in x:
            out.append(max(-128, min(127, math.floor(v * 127 + 0.5) - p)))
            p += out[-1]
        return out

    same(filters.smooth_adaptive(df, 90, chunk), {k: adaptive(x) for k, x in data.items()})
    same(filters.delta_encode(df, chunk).withColumnRenamed("code", "x"), {k: deltas(x) for k, x in data.items()})
    assert filters.delta_encode(df.limit(0), chunk).count() == 0


def test_sweep_with_constant_parameters_is_the_plain_filter(clips):
    _, df = clips
    a = got(filters.biquad_sweep(df, "low", 500, 500, 0.8, 0.8, 0, 0, 1, 1, 8000, chunk=32))
    b = got(filters.biquad(df, "low", 500, 0.8, 8000))
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)


def test_positions(clips):
    data, df = clips
    same(effects.reverse(effects.reverse(df)), data)
    same(effects.repeat(df, 2.5), {k: np.concatenate([x, x, x])[: int(len(x) * 2.5)] for k, x in data.items()})
    assert effects.repeat(df, 0).count() == 0
    same(effects.pad_silence(df, 0.0005, 8000, "start"), {k: np.concatenate([np.zeros(4), x]) for k, x in data.items()})
    same(effects.hold(df, 5), {k: x[np.arange(len(x)) // 5 * 5] for k, x in data.items()})

    def speed(x, s):
        m = math.floor(len(x) / s + 0.5)
        at = np.minimum(len(x) - 1, np.floor(np.arange(m) * s).astype(int))
        return np.concatenate([x[at][:-1], [0.0]]) if m else np.zeros(0)

    for s in (0.6, 1.7, 3):
        same(effects.speed(df, s), {k: speed(x, s) for k, x in data.items()})


def test_lag_windows_over_chunk_borders(clips):
    data, df = clips
    out = signals.lagged(df, {"p": ("x", 3, 0.0), "q": ("x", -2, 0.0)}, chunk=16).orderBy("clip_id", "idx").collect()
    x = data[3]
    rows = [r for r in out if r["clip_id"] == 3]
    assert len(rows) == len(x)
    assert [r["p"] for r in rows] == [0.0] * 3 + list(x[:-3]) and [r["q"] for r in rows] == list(x[2:]) + [0.0] * 2


def test_echo_both_ways(clips):
    data, df = clips
    near = got(effects.echo(df, 0.5, 2, 0.001, 0.7, 8000))
    x = data[3]
    want = x.copy()
    for k in (1, 2):
        want[8 * k :] += 0.5 * 0.7 ** (k - 1) * x[: -8 * k]
    np.testing.assert_allclose(near[3], want)
    np.testing.assert_allclose(got(effects.echo(df, 0.5, 2, 0, 0.5, 8000))[3], x * 1.75)


def test_asof_points_hold_outside_and_cross_chunks(spark):
    df = spark.createDataFrame([(1, 0, i, 0.0) for i in range(100)], SCHEMA)
    points = spark.createDataFrame([(1, 20, 100.0), (1, 60, 300.0)], "clip_id long, pos long, freq double")
    freq = [r["freq"] for r in effects.asof_points(df, points, chunk=16).orderBy("idx").collect()]
    np.testing.assert_allclose(freq, np.interp(np.arange(100), [20, 60], [100, 300]))


def test_silence(spark):
    ramp = np.concatenate([np.linspace(0, 1, 50), np.full(300, 0.5), np.linspace(1, 0, 50)])
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(ramp)], SCHEMA)
    out = got(levels.trim_silence(df, "all", 0.001))[1]
    assert len(out) == 400 - (300 - 129)  # the anchor and 128 more stay
    flat = spark.createDataFrame([(1, 0, i, 0.0) for i in range(20)], SCHEMA)
    assert levels.trim_silence(flat, "start").count() == 20
    assert levels.trim_silence(flat, "end").count() == levels.trim_silence(flat, "both").count() == 1
    same(levels.normalize(flat), {1: np.zeros(20)})
    first = spark.createDataFrame([(1, 0, 0, -2.0), (1, 0, 1, 1.0), (1, 0, 2, math.nan)], SCHEMA)
    assert got(levels.normalize(first))[1][:2] == pytest.approx([-0.9, 0.45])


def test_flat_runs_by_chunks_equal_one_group(spark):
    rng = np.random.default_rng(8)
    walk = np.cumsum(rng.normal(size=3000)) * 0.002
    walk[500:1400], walk[2000:2300] = 0.25, np.nan
    data = {1: walk, 2: np.concatenate([np.full(1279, 0.5), [0.9]]), 3: np.full(900, 0.1), 4: walk[:40]}
    df = spark.createDataFrame([(c, 0, i, float(v)) for c, x in data.items() for i, v in enumerate(x)], SCHEMA).repartition(3)
    for keep in (False, True):
        whole, parts = (got(levels.flat_runs(df, 0.01, keep, chunk=n)) for n in (65536, 256))
        for c, x in data.items():
            stay, _, ended = levels._flat(x[:, None], 0.01, keep)
            stay[-1] &= not ended
            np.testing.assert_array_equal(whole[c].astype(float), x[stay])  # NaN comes back as null
            np.testing.assert_array_equal(parts[c].astype(float), x[stay])
        idx = levels.flat_runs(df, 0.01, keep, chunk=256).groupBy("clip_id").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.max("idx").alias("m")).collect()
        assert all(r["n"] == r["d"] == r["m"] + 1 for r in idx)


def test_frame_dictionary_round_trip(spark):
    frames = spark.createDataFrame([(c, f, [(c * f) % 3] * 64) for c in range(3) for f in range(5)], "clip_id long, frame_no long, data array<int>")
    table, refs = levels.frame_dedup(frames)
    assert sorted(r["dict_id"] for r in table.collect()) == [0, 1, 2]
    back = {(r["clip_id"], r["idx"]): r["x"] for r in levels.undictionary(refs, table).collect()}
    assert len(back) == 15 * 64 and all(v == (c * (i // 64)) % 3 for (c, i), v in back.items())


def test_spectra(spark, clips):
    data, df = clips
    x = data[3][:672].reshape(-1, 32)
    frames = signals.to_frames(df.where("clip_id = 3"), 32)
    rows = spectral.spectrum(frames).orderBy("frame_no").collect()
    np.testing.assert_allclose([r["re"] for r in rows], np.fft.fft(x).real[: len(rows)], atol=1e-9)
    same(spectral.on_signal(df.where("clip_id = 3"), 32, spectral.fft_roundtrip), {3: data[3][:672]})
    same(spectral.on_signal(df, 32, spectral.dct_roundtrip, "keep"), data)
    h = spectral.impulse(90, 2.0)
    wet = got(spectral.reverb(df, h, 0.5, 0.4, size=64))
    np.testing.assert_allclose(wet[3], 0.5 * data[3] + 0.4 * np.convolve(data[3], h)[:700], atol=1e-9)
    with pytest.raises(ValueError):
        spectral.on_signal(df, 33, spectral.fft_roundtrip)


def test_vocoder_keeps_a_tone(spark):
    t = np.arange(8192)
    df = spark.createDataFrame([(1, 0, int(i), float(v)) for i, v in enumerate(np.sin(2 * np.pi * 32 * t / 1024))], SCHEMA)
    for polished in (False, True):
        out = got(vocoder.vocoder_mono(df, 2.0, polished))[1][2048:6144]
        assert np.argmax(np.abs(np.fft.rfft(out * np.hanning(len(out))))) == pytest.approx(2 * 32 * 4, abs=3)


def test_wav(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, -0.5), (1, 0, 1, 1.0), (1, 1, 1, -1.0)], SCHEMA)
    clips = spark.createDataFrame([(1, 8000, 2, 2, {"INAM": "abc"})], "clip_id long, sample_rate int, n_samples long, n_channels int, metadata map<string,string>")
    data = bytes(wav.pack_wav(df, clips, "i16").first()["wav"])
    plan = wav.wav_size_plan(clips.withColumn("bits", F.lit(16))).first()
    assert data[:4] == b"RIFF" and struct.unpack("<I", data[4:8])[0] == len(data) - 8 == plan["riff_bytes"]
    assert struct.unpack("<4h", data[44:52]) == (16383, -16383, 32767, -32767) and b"INAM" in data


def test_noise_is_repeatable_and_bounded(clips):
    _, df = clips
    for kind in ("brown", "gray", "green", "black", "hold"):
        a = got(filters.walk_noise(df, kind, 0.5))
        b = got(filters.walk_noise(df.repartition(3), kind, 0.5))
        assert all((a[k] == b[k]).all() for k in a)


def test_chain_and_registry(clips):
    data, df = clips
    same(chain.apply_chain(df, [("gain", {"m": "2"}), ("reverse", {})]), {k: 2 * x[::-1] for k, x in data.items()})
    with pytest.raises(ValueError):
        chain.apply_chain(df, [("widen", {"g": 2})])
    with pytest.raises(KeyError):
        chain.apply_chain(df, [("nothing", {})])
    chain.register_effect("halve", lambda d: effects.gain(d, 0.5))
    same(chain.apply_chain(df, [("halve", {})]), {k: x / 2 for k, x in data.items()})
    with pytest.raises(ValueError):
        chain.register_effect("halve", lambda d: d)
    del chain.EFFECTS["halve"]
    with pytest.raises(ValueError):
        chain.power_of_two(12)
    assert chain.percent("35%") == 0.35 and chain.even(7) == 6


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for fn in (lambda d: filters.ema(d, 30), levels.normalize, lambda d: levels.trim_silence(d, "all"), effects.reverse, lambda d: effects.speed(d, 1.5)):
        assert fn(empty).count() == 0


def test_storage_round_trip(spark, clips, tmp_path):
    data, df = clips
    for fmt in ("parquet", "csv", "json"):
        signals.write_signal(df, str(tmp_path / fmt), fmt)
        same(signals.read_signal(spark, str(tmp_path / fmt), fmt), data)
