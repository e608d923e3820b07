import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.operators import filters, vocoder
from sparkwave.sources.storage import STATE_STORE, setting
from sparkwave.streaming import signals as streaming

SCHEMA = "clip_id long, channel int, idx long, ts timestamp, x double"


def feed(spark, tmp_path, batches):
    """A stream of one file a batch, and all rows."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "clip_id long, channel int, idx long, s double, x double").selectExpr(
            "clip_id", "channel", "idx", "timestamp_seconds(1700000000 + s) as ts", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))


def drain(df, name, tmp_path, mode="append"):
    with setting(df.sparkSession, *STATE_STORE):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_filters_carry_state_and_wait_for_gaps(spark, tmp_path):
    x = np.random.default_rng(3).normal(0, 0.3, 40)
    row = lambda c, i: (c, 0, i, float(i), float(x[i]))
    batches = [[row(1, i) for i in (0, 2, 1, 5)], [row(1, i) for i in (4, 3, 3, *range(6, 20))] + [row(2, i) for i in range(10)], [row(1, i) for i in range(20, 40)]]
    stream, rows = feed(spark, tmp_path, batches)
    whole = rows.dropDuplicates(["clip_id", "idx"]).select("clip_id", "channel", "idx", "x")
    c = filters.coefficients("low", 700, 0.8, 8000)
    for name, fresh, want in (
        ("biq", lambda: streaming.Biquad(*c), filters.biquad(whole, "low", 700, 0.8, 8000)),
        ("ema", lambda: streaming.Ema(30), filters.ema(whole, 30)),
        ("comb", lambda: streaming.Comb(0.5), filters.comb(whole, 0.5)),
        ("adapt", lambda: streaming.Adaptive(60), filters.smooth_adaptive(whole, 60)),
    ):
        out = {(r["clip_id"], r["idx"]): r["y"] for r in drain(streaming.stream_filter(stream, fresh), name, tmp_path).collect()}
        expected = {(r["clip_id"], r["idx"]): r["x"] for r in want.collect()}
        assert set(out) == set(expected) and all(out[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def test_levels_drop_late_rows(spark, tmp_path):
    batches = [[(1, 0, 0, 1.0, 0.5), (1, 0, 1, 2.0, -0.25)], [(1, 0, 2, 100.0, 1.0)], [(1, 0, 5, 101.0, 1.0)], [(1, 0, 3, 3.0, 9.0)], [(1, 0, 4, 200.0, 1.0)]]
    stream, _ = feed(spark, tmp_path, batches)
    out = drain(streaming.stream_levels(stream, "10 seconds", "5 seconds"), "levels", tmp_path).orderBy("w").collect()
    assert (out[0]["total"], out[0]["n"], out[0]["peak"]) == (0.75, 2, 0.5)  # the late 9.0 is not in it


def test_overlapping_frames_and_dedup(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [[(1, 0, i, float(i), float(i % 2)) for i in range(16)], [(1, 0, 16, 500.0, 0.0)]])
    frames = drain(streaming.stream_overlap_frames(stream, "8 seconds", "2 seconds", "1 second"), "frames", tmp_path)
    assert sorted(map(tuple, (r["data"] for r in frames.where(F.size("data") == 8).collect())))[0] == (0, 1, 0, 1, 0, 1, 0, 1)
    once = streaming.stream_dedup_frames(stream.select("ts", F.array("x").alias("data")))
    assert drain(once, "once", tmp_path).count() == 2


def test_vocoder_stream_equals_the_batch_one_late_by_a_frame(spark, tmp_path):
    t = np.arange(4096)
    x = np.sin(2 * np.pi * 32 * t / 1024)
    stream, _ = feed(spark, tmp_path, [[(1, 0, int(i), float(i), float(x[i])) for i in part] for part in np.array_split(t, 3)])
    y = [r["y"] for r in drain(streaming.stream_vocoder(stream, 1.3), "voc", tmp_path).orderBy("idx").collect()]
    np.testing.assert_allclose(y[1023:], vocoder.whole(vocoder.Mono(1.3), x)[: 4096 - 1023], atol=1e-9)


def test_vocoder_stream_starts_anew_where_the_shift_jumps(spark, tmp_path):
    """Against frames one by one; small changes retune without a new start, and batches don't matter."""
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(5000) / 7) + rng.normal(0, 0.05, 5000)
    shift = np.where(np.arange(5000) < 1500, 1.3, np.where(np.arange(5000) < 3000, 1.3005, 0.8))
    state, tuned, padded = vocoder.Mono(1.0).start(), 1.0, np.concatenate([np.zeros(1023), x])
    want = np.zeros(7000)
    for i in range(5000):
        if abs(shift[i] - tuned) > 0.001:
            tuned, state = shift[i], vocoder.Mono(1.0).start()
        if i % 256 == 255:
            voice = vocoder.Mono(shift[i])
            frame = np.vstack([np.zeros((2, 1024)), padded[i : i + 1024]])
            want[i : i + 1024] += voice.frames(frame, state, False)[0]
            state = voice.carry(state, voice.summary(frame, False))
    rows = [(1, 0, i, float(i), float(x[i])) for i in range(5000)]
    stream, _ = feed(spark, tmp_path, [rows[:700], rows[2000:5000], rows[700:2000]])
    stream = stream.withColumn("shift", F.when(F.col("idx") < 1500, 1.3).when(F.col("idx") < 3000, 1.3005).otherwise(0.8))
    y = [r["y"] for r in drain(streaming.stream_vocoder(stream), "retuned", tmp_path).orderBy("idx").collect()]
    np.testing.assert_allclose(y, want[:5000], atol=1e-9)


def test_held_rows_and_gaps_that_are_given_up(spark, tmp_path):
    row = lambda i, x: (1, 0, i, float(i), float(x))
    batches = [[row(0, 1), row(3, 7), row(6, 1)], [row(3, 10), row(1, 100), row(1, 1000), row(0, 5)], [row(7, 2), row(8, 3), row(9, 4)], [row(2, 50)]]
    stream, _ = feed(spark, tmp_path, batches)
    wanted = {"patient": {0: 1, 1: 1001, 2: 1051, 3: 1061}, "hasty": {0: 1, 1: 1001, 3: 1011, 6: 1012, 7: 1014, 8: 1017, 9: 1021}}
    # A comb of one tap adds all samples up, so order and every row count.
    for name, wait in (("patient", None), ("hasty", 4)):  # 3, 6, 7, 8 and 9 are held when the third batch comes
        out = drain(streaming.stream_filter(stream, lambda: streaming.Comb(1.0, 1), wait=wait), name, tmp_path).collect()
        got = {r["idx"]: r["y"] for r in out}
        assert len(out) == len(got)
        if name == "patient":
            assert got == wanted[name]
        else:
            assert got == {k: v for k, v in wanted[name].items() if k in got} and set(got) >= {0, 1, 3}
