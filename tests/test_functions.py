import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.functions import shaping as S


def values(spark, data, expr):
    return [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(data)], "i int, x double").orderBy("i").select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize("mode,pairs", [
    ("clamp", {1.5: 1, 9: 1, -0.2: -0.2, -4: -1}),
    ("wrap", {1: -1, 1.2: -0.8, 2: 0, -1.2: 0.8, -1.5: 0.5}),
    ("bounce", {1.2: 0.8, 1.5: 0.5, 1.8: 0.2, 2: 0, 2.5: -0.5}),
])
def test_clip_modes(spark, mode, pairs):
    assert values(spark, pairs, lambda x: S.clip(x, mode)) == pytest.approx(list(pairs.values()))


def test_nan_and_zero_gain(spark):
    out = values(spark, [math.nan, 0.5], lambda x: S.gain_clip(x, 2.0, "clamp"))
    assert math.isnan(out[0]) and out[1] == 1
    assert values(spark, [math.nan, 0.5], lambda x: S.gain_clip(x, 0, dc=0.25, keep_nan=False)) == [0.25, 0.25]


def test_rounding_is_half_up(spark):
    assert values(spark, [-0.5, 0.5, 1.5, -1.5], lambda x: S.half_up(x)) == [0, 1, 2, -1]
    assert values(spark, [0.6, -0.6], lambda x: S.quantize(x, 2)) == [0.5, -0.5]


def test_codes_stay_in_range(spark):
    x = np.linspace(-1, 1, 101)
    for fn, top in ((S.to_u8, 255), (S.to_mulaw_byte, 255), (S.to_alaw_byte, 255), (S.to_u12, 4095)):
        got = values(spark, x, fn)
        assert min(got) >= 0 and max(got) <= top and len(set(got)) > 50
    assert values(spark, [0.0], S.to_mulaw_byte) == [255]


def test_distort_and_ease_ends(spark):
    for how in ("sqrt", "cbrt", "square", "step8", "selfpow", "sin"):
        got = values(spark, [-0.3, 0.0, 0.3], lambda x, how=how: S.distort(x, 100, how))
        assert got[1] == 0 and got[0] == pytest.approx(-got[2])
    for easing in ("linear", "ease_in", "ease_out", "cubic"):
        assert values(spark, [0, 1], lambda x, e=easing: S.ease(x, e)) == pytest.approx([0, 1])
