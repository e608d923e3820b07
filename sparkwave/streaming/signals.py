"""Signals as streams: windowed levels, overlapping frames, filters with carried state, frame dictionaries.

A stream has clip_id, channel, idx, ts, x.  Stateful filters keep, per (clip, channel), the filter state, the next
position and rows that came early; a gap is waited for until it is filled, or up to a limit of rows or time if one is given.
"""

from __future__ import annotations

import functools
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import StructType

from sparkwave.operators.vocoder import Mono
from sparkwave.sources.signals import KEYS


def stream_levels(stream: DataFrame, window: str, watermark: str) -> DataFrame:
    """Sum, count and peak of |x| per tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", watermark).groupBy(*KEYS, F.window("ts", window).alias("w")).agg(
        F.sum(F.abs("x")).alias("total"), F.count("x").alias("n"), F.max(F.abs("x")).alias("peak"))


def stream_overlap_frames(stream: DataFrame, size: str, hop: str, watermark: str) -> DataFrame:
    """Sliding windows of ordered samples."""
    g = stream.withWatermark("ts", watermark).groupBy(*KEYS, F.window("ts", size, hop).alias("w"))
    return g.agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s")).select(*KEYS, "w", F.col("s.x").alias("data"))


class Ema:
    def __init__(self, pct: float):
        self.p, self.y = pct / 100, None

    def run(self, x: np.ndarray) -> list[float]:
        y, out = self.y, []
        for v in x.tolist():
            y = v if y is None else y + (v - y) * self.p
            out.append(y)
        self.y = y
        return out


class Comb:
    def __init__(self, g: float, taps: int = 4):
        self.g, self.past = g, np.zeros(taps)

    def run(self, x: np.ndarray) -> np.ndarray:
        taps, y = len(self.past), np.concatenate([self.past, x])
        for at in range(taps, len(y), taps):  # as many samples at a time as there are taps
            part = y[at : at + taps]
            part += self.g * y[at - taps : at - taps + len(part)]
        self.past = y[len(y) - taps :]
        return y[taps:]


class Biquad:
    def __init__(self, *coefficients: float):
        self.c, self.s = coefficients, (0.0, 0.0)

    def run(self, x: np.ndarray) -> list[float]:
        b0, b1, b2, a1, a2 = self.c
        s0, s1 = self.s
        out = []
        for v in x.tolist():
            y = b0 * v + s0
            s0, s1 = b1 * v - a1 * y + s1, b2 * v - a2 * y
            out.append(y)
        self.s = s0, s1
        return out


class Adaptive:
    def __init__(self, pct: float):
        self.p, self.y = pct / 100, None

    def run(self, x: np.ndarray) -> list[float]:
        y, out = self.y, []
        for v in x.tolist():
            y = v if y is None else v + (y - v) * self.p * (1 - abs(v - y)) ** 2
            out.append(y)
        self.y = y
        return out


class Delta:
    def __init__(self) -> None:
        self.p = 0

    def run(self, x: np.ndarray) -> list[float]:
        out = []
        for v in np.floor(x * 127 + 0.5).astype(np.int64).tolist():
            d = max(-128, min(127, v - self.p))
            self.p += d
            out.append(float(d))
        return out


RUN = Row(*KEYS, "first", "y")
BLOCK = 256  # positions of early rows that the state holds as one entry


class _InOrder(StatefulProcessor):
    """Runs a filter over the samples of one (clip, channel) in order of idx.

    State: the next idx, how many rows are held and the filter; rows that came early are a map of blocks by idx, so a batch touches only the
    blocks that it adds to or releases, and rows in order touch none.  A timer, if asked for, gives up waiting for a gap.
    """

    def __init__(self, fresh, inputs: tuple[str, ...], timeout_ms: int | None, wait: int | None):
        self.fresh, self.inputs, self.timeout_ms, self.wait = fresh, inputs, timeout_ms, wait
        self.kind = np.dtype([("idx", np.int64), *((c, np.float64) for c in inputs)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "next long, held long, data binary")
        self.early = handle.getMapState("early", "block long", "rows binary")

    def _given(self) -> tuple[int, int, object]:
        given = self.position.get()
        if given is None:
            return 0, 0, self.fresh()
        at, held, data = given
        return at, held, pickle.loads(data)

    def _advance(self, key: tuple, at: int, held: int, op, new: np.ndarray, skip: bool) -> Iterator[Row]:
        """`new` has rows by idx, ascending and distinct, from `at` on."""
        waiting, stored = held > 0, held > 0
        blocks: dict[int, np.ndarray] = {}  # those of this call: as they will be stored
        none = new[:0]

        def block(k: int) -> np.ndarray:
            if k not in blocks:
                old = self.early.getValue((k,)) if stored else None
                blocks[k] = none if old is None else np.frombuffer(old[0], self.kind)
            return blocks[k]

        def run(rows: np.ndarray) -> Row:
            y = op.run(*(np.ascontiguousarray(rows[c]) for c in self.inputs))
            return RUN(*key, at, y if isinstance(y, list) else y.tolist())

        if not stored:
            n = int(np.searchsorted(new["idx"] - np.arange(len(new)), at, side="right"))  # rows up to the first gap
            if n:
                yield run(new[:n])
                at, new = at + n, new[n:]
        parts = np.flatnonzero(np.diff(new["idx"] // BLOCK, prepend=-1)).tolist()
        for a, z in itertools.pairwise([*parts, len(new)]):
            k = int(new["idx"][a]) // BLOCK
            old = block(k)
            kept = old[~np.isin(old["idx"], new["idx"][a:z])]  # of rows of one idx the one that came last counts
            both = np.concatenate([kept, new[a:z]])
            blocks[k] = both[np.argsort(both["idx"])]
            held += len(both) - len(old)
        changed = {int(k) for k in new["idx"][parts] // BLOCK}
        while held:
            k = at // BLOCK
            rows = block(k)
            n = int(np.searchsorted(rows["idx"] - np.arange(len(rows)), at, side="right"))
            if n:
                yield run(rows[:n])
                blocks[k] = rows[n:]
                changed.add(k)
                at, held = at + n, held - n
                continue
            if not (skip or (self.wait is not None and held > self.wait)):
                break
            known = {int(b[0]) for b in self.early.keys()} if stored else set()
            first = min(b for b in known | set(blocks) if len(block(b)))
            at = int(block(first)["idx"][0])
        for k in changed:
            if len(blocks[k]):
                self.early.updateValue((k,), (blocks[k].tobytes(),))
            elif stored:
                self.early.removeKey((k,))
        self.position.update((at, held, pickle.dumps(op)))
        self.now_waiting = held > 0 and not (waiting and not skip)

    def _rows(self, rows: Iterator[Row], at: int) -> np.ndarray:
        """Those from `at` on by idx; of rows of one idx the one that came last."""
        nan = float("nan")
        places = None

        def values() -> Iterator[tuple]:
            nonlocal places
            for row in rows:
                if places is None:
                    places = [row.__fields__.index(c) for c in ("idx", *self.inputs)]
                idx, *x = (row[k] for k in places)
                if idx is not None and idx >= at:
                    yield idx, *(nan if v is None else v for v in x)

        given = np.fromiter(values(), self.kind)
        given = given[np.argsort(given["idx"], kind="stable")]
        return given[np.diff(given["idx"], append=-1) != 0]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        at, held, op = self._given()
        yield from self._advance(key, at, held, op, self._rows(rows, at), False)
        self._wake(timerValues)

    def _wake(self, timerValues: TimerValues) -> None:
        if self.timeout_ms and self.now_waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        at, held, op = self._given()
        if held:
            yield from self._advance(key, at, held, op, np.zeros(0, self.kind), True)
            self._wake(timerValues)

    def close(self) -> None:
        pass


def stream_filter(stream: DataFrame, fresh, timeout_ms: int | None = None, wait: int | None = None, inputs: tuple[str, ...] = ("x",)) -> DataFrame:
    """keys, idx, y: `fresh()` makes a filter; its run(x, ...) gets each run of consecutive samples as arrays, one of each of `inputs`, in
    order of idx, with its state carried between batches.

    Rows already passed (late or repeated) are dropped, and of rows of one idx the one that came last counts.  A gap holds the rows
    behind it until it is filled, so results don't depend on batches; only if asked for, it is skipped with more than `wait`
    rows held, or `timeout_ms` after rows were first held.  (With a time limit Spark runs batches without end, as time alone may release
    rows.)  The query needs the RocksDB state store (sources.storage.STATE_STORE), as all with transformWithState.
    """
    kinds = dict(stream.dtypes)
    schema = f"clip_id {kinds['clip_id']}, channel {kinds['channel']}, first long, y array<double>"  # a row a run of samples
    rows = stream.select(*KEYS, "idx", *inputs).groupBy(*KEYS)
    runs = rows.transformWithState(_InOrder(fresh, inputs, timeout_ms, wait), StructType.fromDDL(schema), "Append", "ProcessingTime" if timeout_ms else "None")
    return runs.select(*KEYS, "first", F.posexplode("y").alias("at", "y")).select(*KEYS, (F.col("first") + F.col("at")).alias("idx"), "y")


@functools.lru_cache(maxsize=64)
def _mono(shift: float) -> Mono:
    """A voice has tables but no state, so clips share it."""
    return Mono(shift)


class StreamVocoder:
    """A phase vocoder one frame late: frames end every 256 samples and take the shift of their last sample; phases and angles start anew
    where the shift is more than 0.001 from the one of the last start."""

    def __init__(self, shift: float):
        self.voice = _mono(shift)
        self.tuned, self.state, self.n = shift, self.voice.start(), 0
        self.input, self.tail = np.zeros(self.voice.size - 1), np.zeros(self.voice.size)
        self.ready = np.zeros(self.voice.hop - 1)

    def __getstate__(self) -> tuple:
        """The voice by its shift, and arrays without the zeros that a new clip has: a short clip is a few bytes."""
        state = [s if s.any() else None for s in self.state]
        return self.voice.shift, self.tuned, state, self.n, np.trim_zeros(self.input, "f"), np.trim_zeros(self.tail, "b"), len(self.ready), np.trim_zeros(self.ready, "b")

    def __setstate__(self, given: tuple) -> None:
        shift, self.tuned, state, self.n, heard, tail, n, ready = given
        self.voice = _mono(shift)
        self.state = tuple(a if s is None else s for a, s in zip(self.voice.start(), state, strict=True))
        self.input = np.concatenate([np.zeros(self.voice.size - 1 - len(heard)), heard])
        self.tail = np.concatenate([tail, np.zeros(self.voice.size - len(tail))])
        self.ready = np.concatenate([ready, np.zeros(n - len(ready))])

    def _frames(self, x: np.ndarray, shift: float) -> np.ndarray:
        if shift != self.voice.shift:
            self.voice = _mono(shift)
        x = np.concatenate([np.zeros((self.voice.lead, self.voice.size)), x])
        out = self.voice.frames(x, self.state, False)
        self.state = self.voice.carry(self.state, self.voice.summary(x, False))
        return out

    def run(self, x: np.ndarray, shift: np.ndarray | None = None) -> np.ndarray:
        size, hop = self.voice.size, self.voice.hop
        samples = np.concatenate([self.input, x])
        ends = np.arange(hop - 1 - self.n % hop, len(x), hop)  # last samples of frames
        shift = np.full(len(x), self.voice.shift) if shift is None else shift
        frames = samples[ends[:, None] + np.arange(size)]
        changes = np.flatnonzero(np.diff(shift, prepend=np.nan) != 0).tolist()  # from the first sample on
        acc = np.concatenate([self.tail, np.zeros(len(ends) * hop)])
        for a, b in itertools.pairwise([*changes, len(x)]):
            value = float(shift[a])
            if abs(value - self.tuned) > 0.001:
                self.tuned, self.state = value, self.voice.start()
            first, last = np.searchsorted(ends, [a, b])
            for at in range(first, last, 256):
                for j, frame in enumerate(self._frames(frames[at : min(last, at + 256)], value), at + 1):
                    acc[j * hop :][:size] += frame
        out = np.concatenate([self.ready, acc[hop : (len(ends) + 1) * hop] / self.voice.gain])
        self.ready, self.tail = out[len(x) :], acc[len(ends) * hop :]
        self.input, self.n = samples[len(samples) - size + 1 :], self.n + len(x)
        return out[: len(x)]


def stream_vocoder(stream: DataFrame, shift: float | None = None, **options) -> DataFrame:
    """The mono vocoder on a stream; without `shift` each row says its own in a column of that name, which may change."""
    if shift is None:
        return stream_filter(stream, lambda: StreamVocoder(1.0), inputs=("x", "shift"), **options)
    return stream_filter(stream, lambda: StreamVocoder(shift), **options)


def stream_dedup_frames(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Frames whose data did not appear before (within the watermark, if given)."""
    if watermark:
        return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["data"])
    return stream.dropDuplicates(["data"])
