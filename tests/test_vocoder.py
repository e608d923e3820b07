"""Vocoders against plain loops over frames and bins, whatever the stretches."""

import cmath
import math

import numpy as np
import pytest

from sparkwave.operators import vocoder

SCHEMA = "clip_id long, channel int, idx long, x double"
N, HOP, HALF = 1024, 256, 512
UNIT = 2 * math.pi / N


def nearest(v):
    return math.floor(v + 0.5)


def wrapped(v):
    """By the nearest whole turn; the real bins' steps are ties (half a turn), which must not hang on a sum's last digit."""
    return v - 2 * math.pi * nearest(round(v / (2 * math.pi), 9))


class Loop:
    """One frame at a time, one bin at a time."""

    def __init__(self, shift):
        self.shift = shift
        self.before, self.phase, self.freq = [0.0] * (HALF + 1), [0.0] * (HALF + 1), [0.0] * (HALF + 1)

    def mono(self, z, out, norm):
        for k in range(HALF + 1):
            mag, angle = abs(z[k]), cmath.phase(z[k])
            if mag < 1e-6:
                continue
            delta = wrapped(angle - self.before[k] - UNIT * k * HOP)
            self.before[k] = angle
            to = k * self.shift
            if to <= HALF:
                low = int(to)
                for bin_, part in ((low, 1 - (to - low)), (low + 1, to - low)):
                    if bin_ <= HALF:
                        self.phase[bin_] += (UNIT * k + delta / HOP) * HOP * self.shift
                        out[bin_] += mag * part * cmath.exp(1j * self.phase[bin_])

    def write(self, out, norm, k, mag, phases):
        to = k * self.shift
        low = int(to)
        for bin_, part, phase in zip((low, low + 1), (1 - (to - low), to - low), phases, strict=True):
            if bin_ <= HALF:
                out[bin_] += mag * part * cmath.exp(1j * phase)
                norm[bin_] += part

    def polished(self, z, out, norm):
        for k in range(HALF + 1):
            angle = cmath.phase(z[k])
            delta = wrapped(angle - self.before[k] - UNIT * k * HOP)
            self.before[k] = angle
            low = int(k * self.shift)
            if abs(z[k]) < 1e-8 or low > HALF:
                continue
            self.phase[low] += UNIT * k * HOP + delta
            self.write(out, norm, k, abs(z[k]), [self.phase[low]] * 2)

    def frequencies(self, z):
        for k in range(HALF + 1):
            angle = cmath.phase(z[k])
            expected = self.freq[k]
            self.freq[k] = expected + wrapped(angle - self.before[k] - expected) if abs(z[k]) >= 1e-8 else UNIT * k * HOP
            self.before[k] = angle

    def locked(self, z, out, norm):
        self.frequencies(z)
        mag = [abs(v) for v in z]
        owner, touched = {}, set()
        for p in range(1, HALF - 1):
            if mag[p] > mag[p - 1] and mag[p] > mag[p + 1]:
                target = min(nearest(p * self.shift), HALF)
                self.phase[target] += self.freq[p] * self.shift
                touched.add(target)
                for bin_ in range(max(0, p - 2), min(HALF, p + 2) + 1):
                    owner[bin_] = self.phase[target]
        for k in range(HALF + 1):
            if k not in touched:
                self.phase[k] *= 0.95
        for k in range(HALF + 1):
            if mag[k] < 1e-8 or int(k * self.shift) > HALF:
                continue
            if k not in owner:
                target = min(nearest(k * self.shift), HALF)
                self.phase[target] += self.freq[k] * self.shift
            self.write(out, norm, k, mag[k], [owner[k] if k in owner else self.phase[target]] * 2)

    def basic(self, z, out, norm):
        self.frequencies(z)
        live = [k for k in range(HALF + 1) if abs(z[k]) >= 1e-8 and int(k * self.shift) <= HALF]
        moved, weight = [0.0] * (HALF + 2), [0.0] * (HALF + 2)
        for k in live:
            low, part = int(k * self.shift), k * self.shift - int(k * self.shift)
            for bin_, w in ((low, 1 - part), (low + 1, part)):
                moved[bin_] += self.freq[k] * self.shift * w
                weight[bin_] += w
        for k in range(HALF + 1):
            if weight[k] > 0:
                self.phase[k] += moved[k] / weight[k]
        for k in live:
            low = int(k * self.shift)
            self.write(out, norm, k, abs(z[k]), [self.phase[low], self.phase[min(low + 1, HALF)]])

    def run(self, kind, x):
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N) / N)
        padded = np.concatenate([np.zeros(N - HOP), x, np.zeros(N)])
        total = np.zeros(len(padded))
        for at in range(0, len(padded) - N + 1, HOP):
            z = np.fft.rfft(padded[at : at + N] * window)
            out, norm = [0j] * (HALF + 1), [0.0] * (HALF + 1)
            getattr(self, kind)(z.tolist(), out, norm)
            total[at : at + N] += np.fft.irfft([v / n if n > 0 else v for v, n in zip(out, norm, strict=True)], N) * window
        return total[N - HOP :][: len(x)]


VOICES = {
    "mono": vocoder.Mono,
    "polished": vocoder.Polished,
    "locked": vocoder.Stereo,
    "basic": lambda shift: vocoder.Stereo(shift, peak_lock=False),
}


def clips():
    rng = np.random.default_rng(5)
    long = rng.normal(size=6001) * 0.1 + np.sin(np.arange(6001) / 9)
    long[1500:4100] = 0  # bins without a live angle over whole stretches
    return {1: long, 2: long[:700], 3: long[:1], 4: np.sin(2 * np.pi * 32 * np.arange(3000) / N)}


def got(df):
    out = {}
    for r in df.orderBy("clip_id", "idx").collect():
        out.setdefault(r["clip_id"], []).append(r["x"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("kind", list(VOICES))
def test_voices_equal_the_loops(kind):
    for shift in (0.7, 1.0, 1.2, 2.0):
        for x in clips().values():
            voice = VOICES[kind](shift)
            want = Loop(shift).run(kind, x) / (1.5 if kind in ("locked", "basic") else 1.0)
            np.testing.assert_allclose(vocoder.whole(voice, x), want, atol=1e-7)


@pytest.mark.parametrize(("kind", "chunk"), [(k, c) for k in VOICES for c in (1, 8)] + [("locked", 256)])
def test_stretches_equal_the_whole_clip(spark, kind, chunk):
    data = clips()
    df = spark.createDataFrame([(c, 0, i, float(v)) for c, x in data.items() for i, v in enumerate(x)], SCHEMA).repartition(3)
    for shift in (0.7, 1.2):
        out = got(vocoder.vocode(df, VOICES[kind](shift), chunk=chunk))
        for c, x in data.items():
            np.testing.assert_allclose(out[c], vocoder.whole(VOICES[kind](shift), x), atol=1e-7)


def test_stereo_puts_mid_and_side_together(spark):
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(2, 3000)) * 0.2
    df = spark.createDataFrame([(1, c, i, float(v)) for c, x in enumerate((left, right)) for i, v in enumerate(x)], SCHEMA)
    for lock in (True, False):
        mid, side = (Loop(1.2).run("locked" if lock else "basic", x) / 1.5 for x in ((left + right) / 2, (left - right) / 2))
        rows = vocoder.vocoder_stereo(df, 1.2, peak_lock=lock, chunk=8)
        np.testing.assert_allclose(got(rows.where("channel = 0"))[1], mid + side, atol=1e-7)
        np.testing.assert_allclose(got(rows.where("channel = 1"))[1], mid - side, atol=1e-7)


def test_a_stretch_costs_what_it_holds(spark):
    """Short clips make no group of their own in pandas, no rows that are carried, and no arrays of a whole stretch's length."""
    import contextlib
    import io

    from sparkwave.operators import effects

    rng = np.random.default_rng(8)
    data = {c: rng.normal(0, 0.3, n) for c, n in ((1, 1), (2, 300), (3, 1025), (4, 3000))}
    df = spark.createDataFrame([(c, 0, i, float(v)) for c, x in data.items() for i, v in enumerate(x)], SCHEMA)
    out = vocoder.vocode(df, vocoder.Mono(1.2), 4)
    for c, x in data.items():
        y = [r["x"] for r in out.where(f"clip_id = {c}").orderBy("idx").collect()]
        np.testing.assert_allclose(y, vocoder.whole(vocoder.Mono(1.2), x), atol=1e-9)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        vocoder.vocoder_stereo(df.unionByName(effects.gain(df.withColumn("channel", df.channel + 1), 0.5)), 1.2).explain()
    assert "InPandas" in plan.getvalue() and "FlatMap" not in plan.getvalue()
