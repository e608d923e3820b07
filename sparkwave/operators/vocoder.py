"""Phase vocoders: 1024-sample Hann frames every 256 samples, phases carried along the clip by stretches of frames.

A voice works on a stretch of frames as matrices of bins x frames.  `summary` gives what the state after the stretch needs, as a few
numbers a bin, without knowing the state before it; `carry` puts these in order; `frames` gives the output from the state before.
Frames overlap four times; the windows' squares add up to 1.5, by which only the stereo voice is divided, as in the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.operators.effects import COLUMNS
from sparkwave.operators.scans import Texts, joined
from sparkwave.sources.signals import KEYS

TURN = 2 * np.pi


def _wrap(v: np.ndarray) -> np.ndarray:
    """By the nearest whole turn, half a turn up.  The lowest and highest bins are real, so their steps are whole half turns: rounding keeps
    such ties from hanging on the last digit of a sum, and results from hanging on the stretches."""
    return v - TURN * np.floor(np.round(v / TURN, 9) + 0.5)


class _Segments:
    """Sums over runs of equal numbers in a non-decreasing list, along the first axis."""

    def __init__(self, numbers: np.ndarray, bins: int):
        self.starts = np.flatnonzero(np.diff(numbers, prepend=-1))
        self.numbers, self.of, self.bins = numbers, numbers[self.starts], bins
        self.sizes = np.diff(self.starts, append=len(numbers))

    def totals(self, values: np.ndarray, shift: int = 0) -> np.ndarray:
        """By number (+ shift), one row a bin."""
        out = np.zeros((self.bins, values.shape[1]), values.dtype)
        to = self.of + shift
        out[to[to < self.bins]] = np.add.reduceat(values, self.starts)[to < self.bins]
        return out

    def running(self, values: np.ndarray) -> np.ndarray:
        """Sums from the start of each run, up to and with each row."""
        sums = np.cumsum(values, axis=0)
        return sums - np.repeat(sums[self.starts] - values[self.starts], self.sizes, axis=0)


class Voice:
    size, hop, lead, gain, floor = 1024, 256, 2, 1.0, 1e-8
    names: tuple[str, ...] = ()

    def __init__(self, shift: float):
        self.shift, self.half = shift, self.size // 2
        k = np.arange(self.half + 1)
        self.window = 0.5 - 0.5 * np.cos(TURN * np.arange(self.size) / self.size)
        self.turn = TURN / self.size * k * self.hop
        target = k * shift
        to = np.floor(target).astype(np.int64)
        self.used = int(np.count_nonzero(self.reached(target)))
        self.to, self.frac = to[: self.used], (target - to)[: self.used, None]
        self.targets = _Segments(self.to, self.half + 1)

    def reached(self, target: np.ndarray) -> np.ndarray:
        return np.floor(target) <= self.half

    def start(self) -> tuple[np.ndarray, ...]:
        return tuple(np.zeros(self.half + 1) for _ in range(self.states))

    states = 1

    def analyse(self, x: np.ndarray, opening: bool) -> tuple[np.ndarray, np.ndarray]:
        """Magnitudes and angles, bins x frames with the leading ones; before a clip all angles are 0."""
        z = np.ascontiguousarray(np.fft.rfft(x * self.window).T)
        angle = np.angle(z)
        if opening:
            angle[:, : self.lead] = 0.0
        return np.abs(z), angle

    def spread(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of the used bins, in part to their target and in part to the bin above."""
        return self.targets.totals(low * (1 - self.frac)) + self.targets.totals(high * self.frac, 1)

    def normalised(self, value: np.ndarray, live: np.ndarray) -> np.ndarray:
        norm = self.spread(live[: self.used] * 1.0, live[: self.used] * 1.0)
        return np.divide(value, norm, out=value.copy(), where=norm > 0)

    def synthesis(self, out: np.ndarray) -> np.ndarray:
        return np.fft.irfft(out.T, self.size) * self.window


class Mono(Voice):
    """Every live bin moves the phases of its two targets in bin order and is written at the phases so far; silent bins keep their angle."""

    floor, states, names = 1e-6, 2, ("opening", "closing", "total")

    def reached(self, target: np.ndarray) -> np.ndarray:
        return target <= self.half

    def _local(self, x: np.ndarray, before: np.ndarray):
        mag, angle = (v[:, self.lead :] for v in self.analyse(x, False))
        live, n = mag >= self.floor, mag.shape[1]
        seen = np.maximum.accumulate(np.where(live, np.arange(n), -1), axis=1)
        last = np.concatenate([np.full((len(mag), 1), -1), seen[:, :-1]], axis=1)
        previous = np.where(last < 0, before[:, None], np.take_along_axis(angle, np.maximum(last, 0), axis=1))
        return mag, angle, live, last < 0, np.where(live, self._advance(angle, previous, self.turn[:, None]), 0.0)[: self.used]

    def _advance(self, angle: np.ndarray, before: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return (turn + _wrap(angle - before - turn)) * self.shift

    def _added(self, advance: np.ndarray) -> np.ndarray:
        return self.targets.totals(advance) + self.targets.totals(advance, 1)

    def summary(self, x: np.ndarray, opening: bool) -> tuple[np.ndarray, ...]:
        """The first and last live angle of each bin (NaN if none), and the phase added but for the first live frames, which
        need the angle before the stretch."""
        _, angle, live, first, advance = self._local(x, np.zeros(self.half + 1))
        some, bins = live.any(axis=1), np.arange(self.half + 1)
        begin = np.where(some, angle[bins, live.argmax(axis=1)], np.nan)
        end = np.where(some, angle[bins, live.shape[1] - 1 - live[:, ::-1].argmax(axis=1)], np.nan)
        return begin, end, self._added(np.where(first[: self.used], 0.0, advance)).sum(axis=1)

    def carry(self, state: tuple[np.ndarray, ...], stretch: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        before, phase = state
        begin, end, total = stretch
        first = np.where(np.isnan(begin), 0.0, self._advance(begin, before, self.turn))[: self.used, None]
        return np.where(np.isnan(end), before, end), phase + total + self._added(first)[:, 0]

    def frames(self, x: np.ndarray, state: tuple[np.ndarray, ...], opening: bool) -> np.ndarray:
        before, phase = state
        mag, _, live, _, advance = self._local(x, before)
        added, own = self._added(advance), self.targets.running(advance)
        base = phase[:, None] + np.cumsum(added, axis=1) - added
        below = self.targets.totals(advance, 1)
        size = np.where(live, mag, 0.0)[: self.used]
        above = np.minimum(self.to + 1, self.half)
        return self.synthesis(self.spread(size * np.exp(1j * (base[self.to] + below[self.to] + own)), size * np.exp(1j * (base[above] + own))))


class Polished(Voice):
    """One phase for each target: the sources of a target add to it in bin order, unshifted, and each is written at its own partial
    sum; bins are divided by their weights."""

    names = ("total",)

    def _local(self, x: np.ndarray, opening: bool):
        mag, angle = self.analyse(x, opening)
        mag, turn = mag[:, self.lead :], self.turn[:, None]
        live = mag >= self.floor
        advance = turn + _wrap(angle[:, self.lead :] - angle[:, self.lead - 1 : -1] - turn)
        return mag, live, np.where(live, advance, 0.0)[: self.used]

    def summary(self, x: np.ndarray, opening: bool) -> tuple[np.ndarray, ...]:
        return (self.targets.totals(self._local(x, opening)[2]).sum(axis=1),)

    def carry(self, state: tuple[np.ndarray, ...], stretch: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return (state[0] + stretch[0],)

    def frames(self, x: np.ndarray, state: tuple[np.ndarray, ...], opening: bool) -> np.ndarray:
        mag, live, advance = self._local(x, opening)
        added = self.targets.totals(advance)
        base = state[0][:, None] + np.cumsum(added, axis=1) - added
        value = np.where(live, mag, 0.0)[: self.used] * np.exp(1j * (base[self.to] + self.targets.running(advance)))
        return self.synthesis(self.normalised(self.spread(value, value), live))


class Stereo(Voice):
    """One of two channels (mid or side): frequencies are unwrapped from the last one; with peak_lock the bins within two of a
    peak take its phase (a later peak wins), phases that no peak moves fade by 0.95, and free bins move their own.

    The last frequency of a bin is known but for a multiple of a turn from the frames before (or lost where the bin was silent), and all
    that follows is linear in it: a stretch keeps, for each bin, the factor of the frequency before it in its own and in the
    phases' ends, and the factor of each phase before it.
    """

    gain, states = 1.5, 2
    names = ("kept", "freq", "factor", "total", "share", "share_above")

    def __init__(self, shift: float, peak_lock: bool = True):
        super().__init__(shift)
        self.peak_lock = peak_lock
        self.nearest = np.minimum(np.floor(np.arange(self.half + 1) * shift + 0.5), self.half).astype(np.int64)
        self.locked = _Segments(self.nearest, self.half + 1)

    def _local(self, x: np.ndarray, opening: bool):
        """Magnitudes, live bins, frequencies (times hop) from 0 before the stretch, and whether that start is still in them."""
        mag, angle = self.analyse(x, opening)
        live, turn = mag >= self.floor, self.turn[:, None]
        step = np.diff(angle, axis=1)[:, self.lead - 2 :]  # from the last leading frame on
        known = np.where(live[:, self.lead - 1 :], step, turn)
        if opening:
            known[:, 0] = 0.0
        mag, live = mag[:, self.lead :], live[:, self.lead :]
        sums = np.cumsum(np.where(live, _wrap(step[:, 1:] - known[:, :-1]), 0.0), axis=1)
        last = np.maximum.accumulate(np.where(live, -1, np.arange(live.shape[1])), axis=1)
        reset = np.take_along_axis(sums, np.maximum(last, 0), axis=1)
        return mag, live, np.where(last < 0, sums, turn + sums - reset), last < 0

    def _peaks(self, mag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Peaks, and for each bin the last peak within two bins (-1: none)."""
        peak = np.zeros(mag.shape, bool)
        inner = mag[1 : self.half - 1]
        peak[1 : self.half - 1] = (inner > mag[: self.half - 2]) & (inner > mag[2 : self.half])
        owner = np.full(mag.shape, -1)
        numbers = np.where(peak, np.arange(self.half + 1)[:, None], -1)
        for d in (-2, -1, 0, 1, 2):  # ascending peaks, each over the one before
            from_, to = slice(max(0, d), self.half + 1 + min(0, d)), slice(max(0, -d), self.half + 1 - max(0, d))
            owner[to] = np.maximum(owner[to], numbers[from_])
        return peak, owner

    def _moves(self, mag: np.ndarray, live: np.ndarray, freq: np.ndarray):
        """Factor and addition of each phase in each frame, and what the phases of bins are made of."""
        advance = freq * self.shift
        if not self.peak_lock:
            part = np.where(live, advance, 0.0)[: self.used]
            return np.ones(mag.shape), np.where(self._weights(live) > 0, self.normalised(self.spread(part, part), live), 0.0), None
        peak, owner = self._peaks(mag)
        lead = np.where(peak, advance, 0.0)
        free = (owner < 0) & live & (np.arange(self.half + 1) < self.used)[:, None]
        rest = np.where(free, advance, 0.0)
        moved = self.locked.totals(peak * 1.0) > 0
        by_peaks = self.locked.totals(lead)
        return np.where(moved, 1.0, 0.95), by_peaks + self.locked.totals(rest), (owner, self.locked.running(lead), by_peaks, self.locked.running(rest), peak | free)

    def _weights(self, live: np.ndarray) -> np.ndarray:
        return self.spread(live[: self.used] * 1.0, live[: self.used] * 1.0)

    def summary(self, x: np.ndarray, opening: bool) -> tuple[np.ndarray, ...]:
        mag, live, freq, unknown = self._local(x, opening)
        factor, added, made = self._moves(mag, live, freq)
        total, share, above = np.zeros(self.half + 1), np.zeros(self.half + 1), np.zeros(self.half + 1)
        if self.peak_lock:
            moves = np.where(unknown & made[4], self.shift, 0.0)
            for f in range(mag.shape[1]):
                total = factor[:, f] * total + added[:, f]
                share = factor[self.nearest, f] * share + moves[:, f]
        else:
            total = added.sum(axis=1)
            inverse = np.divide(1.0, self._weights(live), out=np.zeros(mag.shape), where=self._weights(live) > 0)
            open_ = np.where(unknown & live, self.shift, 0.0)[: self.used]
            share[: self.used] = (open_ * (1 - self.frac) * inverse[self.to]).sum(axis=1)
            over = self.to + 1 <= self.half
            above[: self.used][over] = (open_ * self.frac)[over].__mul__(inverse[self.to[over] + 1]).sum(axis=1)
        return unknown[:, -1] * 1.0, freq[:, -1], factor.prod(axis=1), total, share, above

    def carry(self, state: tuple[np.ndarray, ...], stretch: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        freq, phase = state
        kept, end, factor, total, share, above = stretch
        phase = factor * phase + total
        if self.peak_lock:
            phase = phase + np.bincount(self.nearest, share * freq, self.half + 1)
        else:
            u, over = self.used, self.to + 1 <= self.half
            phase = phase + np.bincount(self.to, (share * freq)[:u], self.half + 1) + np.bincount((self.to + 1)[over], (above * freq)[:u][over], self.half + 1)
        return end + kept * freq, phase

    def frames(self, x: np.ndarray, state: tuple[np.ndarray, ...], opening: bool) -> np.ndarray:
        before, phase = state
        mag, live, freq, unknown = self._local(x, opening)
        factor, added, made = self._moves(mag, live, freq + np.where(unknown, before[:, None], 0.0))
        base = np.empty(mag.shape)
        for f in range(mag.shape[1]):
            base[:, f] = phase
            phase = factor[:, f] * phase + added[:, f]
        size = np.where(live, mag, 0.0)[: self.used]
        if not self.peak_lock:
            after = base + added
            value, upper = size * np.exp(1j * after[self.to]), size * np.exp(1j * after[np.minimum(self.to + 1, self.half)])
            return self.synthesis(self.normalised(self.spread(value, upper), live))
        owner, lead, by_peaks, rest, _ = made
        own = np.maximum(owner, 0)
        locked = np.take_along_axis(base[self.nearest] + lead, own, axis=0)
        free = (factor * base + by_peaks)[self.nearest] + rest
        value = size * np.exp(1j * np.where(owner >= 0, locked, free)[: self.used])
        return self.synthesis(self.normalised(self.spread(value, value), live))


def whole(voice: Voice, x: np.ndarray) -> np.ndarray:
    """One clip in memory, delayed by no frame."""
    border, lead = voice.size - voice.hop, voice.lead * voice.hop
    n = -(-(len(x) + border) // voice.hop)
    padded = np.zeros(lead + border + n * voice.hop + voice.size)
    padded[lead + border :][: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, voice.size)[:: voice.hop][: voice.lead + n]
    out = np.zeros(len(padded))
    for f, frame in enumerate(voice.frames(frames, voice.start(), True)):
        out[f * voice.hop :][: voice.size] += frame
    return out[border:][: len(x)] / voice.gain


def vocode(df: DataFrame, voice: Voice, chunk: int = 256) -> DataFrame:
    """Every (clip, channel) through a voice, as `whole` does; `idx` must be dense from 0.

    A clip is cut into stretches of `chunk` frames.  A stretch has the samples of all frames which touch its own, and of the leading frames
    before them; samples near its ends are therefore in two stretches or more.  Each stretch gives one narrow row, a few numbers
    a bin; these rows are streamed in order of the clips to carry the state.
    """
    size, hop = voice.size, voice.hop
    border, home = size - hop, chunk * hop
    left = border + voice.lead * hop
    first, last = F.greatest(F.lit(0), F.floor((F.col("idx") - border) / home)), F.floor((F.col("idx") + left) / home)
    spread = df.select(*COLUMNS, F.explode(F.sequence(first, last)).alias("c"))
    text = Texts(df, KEYS)
    states = [f"state{i}" for i in range(voice.states)]
    rows = spread.groupBy(*KEYS, "c").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("x").cast("double").alias("x")))).alias("s"))
    stretches = rows.select(*KEYS, "c", F.col("s.idx").alias("idx"), F.col("s.x").alias("x"))
    end = F.element_at("idx", -1)

    def cut(c: int, idx: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place in the stretch (from the leading frames' start) of each row, and its first n frames, which overlap."""
        where = np.asarray(idx) - (c * home - left)
        x = np.zeros(max(int(where[-1]) + 1, (n - 1) * hop + size))
        x[where] = values
        return where, np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n]

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [voice.summary(cut(c, idx, x, voice.lead + chunk)[1], c == 0) for c, idx, x in zip(pdf["c"], pdf["idx"], pdf["x"], strict=True)]
            yield pdf[[*KEYS, "c"]].assign(**{k: [m[i] for m in made] for i, k in enumerate(voice.names)})

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of clips and stretches."""
        key, state = None, voice.start()
        for pdf in batches:
            out = []
            for at, *row in zip(zip(*(pdf[k] for k in KEYS), strict=True), *(pdf[k] for k in voice.names), strict=True):
                key, state = (key, state) if at == key else (at, voice.start())
                state = voice.carry(state, tuple(row))
                out.append(state)
            yield pdf[KEYS].assign(c=pdf["c"] + 1, **{k: [s[i] for s in out] for i, k in enumerate(states)})

    def finished(c: int, idx: np.ndarray, values: np.ndarray, before: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The stretch's own positions, and their outputs."""
        own = slice(*np.searchsorted(idx, [c * home, (c + 1) * home]))
        # Frames from the first that touches the stretch's own samples to the last: three more than its own, at its start.
        n = (int(idx[own][-1]) - c * home) // hop + 1 + border // hop
        where, x = cut(c, idx, values, voice.lead + n)
        frames = voice.frames(x, voice.start() if before[0] is None else before, c == 0)
        out = np.zeros((voice.lead + n) * hop + size)
        for f, frame in enumerate(frames):
            out[(voice.lead + f) * hop :][:size] += frame
        return idx[own], out[where[own]] / voice.gain

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [finished(c, idx, x, tuple(before)) for c, idx, x, *before in zip(pdf["c"], pdf["idx"], pdf["x"], *(pdf[k] for k in states), strict=True)]
            yield pdf[KEYS].assign(idx=[m[0] for m in made], x=[m[1] for m in made])

    # a clip's last stretch, or one of its leading samples alone, has none after it
    narrow = text.map(stretches.where(end >= (F.col("c") + 1) * home), summarize, "c long, " + ", ".join(f"{k} array<double>" for k in voice.names))
    carried = text.map(narrow.repartition(*KEYS).sortWithinPartitions(*KEYS, "c"), carry, "c long, " + ", ".join(f"{k} array<double>" for k in states))
    done = text.map(joined(stretches.where(end >= F.col("c") * home), carried, KEYS, "left"), finish, "idx array<long>, x array<double>")
    return done.select(*KEYS, F.inline(F.arrays_zip("idx", "x")))


def vocoder_mono(df: DataFrame, shift: float, polished: bool = False, chunk: int = 256) -> DataFrame:
    return vocode(df, Polished(shift) if polished else Mono(shift), chunk)


def vocoder_stereo(df: DataFrame, shift: float, peak_lock: bool = True, chunk: int = 256) -> DataFrame:
    """Mid and side go through the stereo voice as channels of their own, and are put together again."""
    from sparkwave.operators.effects import mid_side, mid_side_inverse

    return mid_side_inverse(vocode(mid_side(df), Stereo(shift, peak_lock), chunk))
