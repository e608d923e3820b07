"""Queries and their SQL by rule, on rows that the given tables rarely have."""

import numpy as np
import pytest

from sparkwave.operators import filters


def test_crossfade_blends_over_32_samples(spark):
    x = np.random.default_rng(5).normal(0, 0.4, 100)
    b0, b1, b2, a1, a2 = filters.coefficients("low", 700.0, 0.8, 8000)
    fed, y = np.concatenate([[0.0], x[1:]]), np.zeros(100)
    for i in range(100):
        at = lambda v, k, i=i: v[i - k] if i >= k else 0.0
        y[i] = b0 * fed[i] + b1 * at(fed, 1) + b2 * at(fed, 2) - a1 * at(y, 1) - a2 * at(y, 2)
    share = np.minimum(np.minimum(np.arange(100) / 32, np.arange(100)[::-1] / 32), 1.0)
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], "clip_id long, channel int, idx long, x double")
    out = [r["x"] for r in filters.biquad(df, "low", 700.0, 0.8, 8000, crossfade=True, chunk=16).orderBy("idx").collect()]
    np.testing.assert_allclose(out, x + (y - x) * share, atol=1e-9)


def sql_rows(name, **tables):
    """A query's SQL over given tables, by DuckDB."""
    import duckdb
    import pandas as pd

    import __spark_entry__ as entry

    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(table, pd.DataFrame(rows))
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_a_mean_half_way_goes_away_from_zero(spark, tmp_path):
    """400 clips whose means of six digits lie half way, or are near it by what a sum leaves over."""
    import pandas as pd

    from sparkwave.plans import registry

    rng, rows = np.random.default_rng(2), []
    for clip in range(400):
        cents = rng.integers(0, 10000, 64).tolist()
        cents[0] = 11000  # reaches the limit, so that the level is 0.9
        total = sum(max(-900000, min(153 * (c - 5000), 900000)) for c in cents)  # millionths
        rows += [(clip, k, c / 100, total) for k, c in enumerate(cents)]
    df = pd.DataFrame(rows, columns=["user_id", "k", "value", "total"])
    df["event_id"], df["event_type"] = np.arange(len(df)), "a"
    df["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(df["k"], unit="s")
    spark.createDataFrame(df).repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    want = {c: np.sign(t) * ((2 * abs(int(t)) + 64) // 128) / 1e6 for c, t in df.groupby("user_id")["total"].first().items()}
    assert sum(int(t) % 64 == 32 for t in df.groupby("user_id")["total"].first()) > 2
    assert {r["clip_id"]: r["mean"] for r in registry.flagship(spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-9)
    assert {r[0]: r[2] for r in sql_rows("flagship_levels", events=df)} == pytest.approx(want, abs=1e-9)


def test_dedup_gives_a_row_for_each_frame_even_if_two_share_a_fingerprint(spark, tmp_path):
    import pandas as pd

    from sparkwave.plans import registry

    tenths = np.random.default_rng(0).integers(-4, 5, (300_000, 64))
    code, prints = np.floor((tenths / 10 + 1) * 127.5 + 0.5).astype(np.int64), np.zeros(300_000, np.int64)
    for column in code.T:
        prints = (prints * 31 + column) % 2**32
    _, first, n = np.unique(prints, return_index=True, return_counts=True)
    pair = np.flatnonzero(prints == prints[first[n == 2][0]])
    assert len(pair) == 2 and (tenths[pair[0]] != tenths[pair[1]]).any()
    some = np.concatenate([pair, pair[:1], np.arange(5)])  # one of them twice
    df = pd.DataFrame({"vec_id": np.arange(len(some)), "label": np.arange(len(some), dtype=np.int32) % 2, "embedding": [v.tolist() for v in (tenths[some] / 10).astype(np.float32)]})
    spark.createDataFrame(df, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    have = sorted(r["fingerprint"] for r in registry.Q["k5_stream_dedup_frames"](spark, str(tmp_path)).collect())
    assert len(have) == 7 and len(set(have)) == 6
    assert have == sorted(r[0] for r in sql_rows("k5_stream_dedup_frames", embeddings=df))
