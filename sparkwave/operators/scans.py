"""Recurrences along clips, by chunks: composed scans and settled scans.

A recurrence whose steps compose into few numbers (linear steps; additions that saturate; counters with few states) is a composed scan:
a pass over the chunks gives these numbers, one narrow row a chunk; the rows are streamed in order of the clips to carry the state;
a second pass runs each chunk from its own state.  Other recurrences are settled scans: each chunk first runs as if it
began a clip, then again from the state in which the chunk before ended, until no such state changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwave.sources.signals import KEYS
from sparkwave.sources.storage import work_dir

CHUNK = 4096
CELLS = 1 << 21  # of a matrix of chunks, about


def chunked(df: DataFrame, inputs: tuple[str, ...], chunk: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, c and the inputs as arrays; `idx` must be dense within keys."""
    kept = df.select(*keys, "idx", *[F.col(c).cast("double").alias(c) for c in inputs])
    rows = kept.groupBy(*keys, F.floor(F.col("idx") / chunk).alias("c")).agg(F.array_sort(F.collect_list(F.struct("idx", *inputs))).alias("s"))
    return rows.select(*keys, "c", *[F.col(f"s.{c}").alias(c) for c in inputs])


def ragged(pdf: pd.DataFrame, inputs: tuple[str, ...]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Groups of chunks, the longest first: rows, a matrix of positions x chunks of each input (0 behind a chunk's end), how many
    chunks reach each position, and the chunks' lengths."""
    sizes = pdf[inputs[0]].map(len).to_numpy()
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // int(sizes[order[at]]))
        part, at = order[at : at + n], at + n
        rows, lengths = pdf.iloc[part], sizes[part]
        data = []
        for c in inputs:
            flat = np.zeros((len(part), int(lengths[0])))
            for line, values in zip(flat, rows[c], strict=True):
                line[: len(values)] = values
            data.append(np.ascontiguousarray(flat.T))
        yield rows, data, np.searchsorted(-lengths, -np.arange(int(lengths[0]))), lengths


def columns(y: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return [y[:n, j] for j, n in enumerate(lengths.tolist())]


def shrink(state: list[np.ndarray], done: list[np.ndarray] | None, n: int) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """The states of the first n chunks; what the others ended in is kept in `done`."""
    if done is None:
        done = [np.array(s) for s in state]
    for d, s in zip(done, state, strict=True):
        d[..., : s.shape[-1]] = s
    return [s[..., :n] for s in state], done


def fold(step: Callable[[list, int, int], list], state: list[np.ndarray], live: np.ndarray) -> list[np.ndarray]:
    """The state of each chunk at its end: step(state, position, chunks that reach it) over all positions."""
    done, n = None, state[0].shape[-1]
    for i, m in enumerate(live.tolist()):
        if m < n:
            state, done = shrink(state, done, m)
            n = m
        state = step(state, i, n)
    return shrink(state, done, 0)[1]


class Texts:
    """Keys go to pandas as text, which would make doubles of integers beside a null, and come back as they were."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.keys, self.types = keys, dict(df.select(*keys).dtypes)
        self.schema = ", ".join(f"{k} string" for k in keys)

    def map(self, rows: DataFrame, fn, schema: str) -> DataFrame:
        out = rows.withColumns({k: F.col(k).cast("string") for k in self.keys}).mapInPandas(fn, f"{self.schema}, {schema}")
        return out.withColumns({k: F.col(k).cast(self.types[k]) for k in self.keys})


def exploded(full: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    return full.select(*keys, "c", F.posexplode("y").alias("i", "y")).select(*keys, (F.col("c") * chunk + F.col("i")).alias("idx"), "y")


def composed_scan(df: DataFrame, inputs: tuple[str, ...], summary: Callable, start: Callable, carry: Callable, finish: Callable,
                  keys: list[str] | None = None, chunk: int = CHUNK, constants: DataFrame | None = None) -> DataFrame:
    """keys, idx, y (double).

    summary(matrices, live, lengths) gives a list of arrays of numbers, one a chunk; start(numbers) the state before a clip's first chunk, an
    array; carry(state, numbers) the state after a chunk; finish(matrices, live, states) the outputs, positions x chunks, from
    states as arrays over chunks.  The samples are shuffled once, into chunks.

    `constants` has clip_id and k (array<double>), numbers that differ by clip: they are joined to the chunks, once a chunk, and follow
    the matrices as arrays over chunks.
    """
    keys = keys or KEYS
    text = Texts(df, keys)
    chunks = chunked(df, inputs, chunk, keys)
    if constants is not None:  # a narrow table
        chunks = chunks.join(constants.select(F.col("clip_id").alias("_clip"), "k"), F.col("clip_id").eqNullSafe(F.col("_clip"))).drop("_clip")

    more = constants is not None

    def given(rows: pd.DataFrame, data: list[np.ndarray]) -> list[np.ndarray]:
        return [*data, *np.stack(rows["k"].to_numpy()).T] if more else data

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, data, live, lengths in ragged(pdf, inputs):
                yield rows[[*keys, "c"]].assign(e=[np.asarray(e, float) for e in summary(given(rows, data), live, lengths)])

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of clips and chunks."""
        key, state = None, None
        for pdf in batches:
            states = []
            for at, e in zip(zip(*(pdf[k] for k in keys), strict=True), pdf["e"], strict=True):
                if at != key:
                    key, state = at, np.asarray(start(e), float)
                states.append(state)
                state = carry(state, e)
            yield pdf[[*keys, "c"]].assign(s=states)

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, data, live, lengths in ragged(pdf, inputs):
                yield rows[[*keys, "c"]].assign(y=columns(finish(given(rows, data), live, list(np.stack(rows["s"].to_numpy()).T)), lengths))

    narrow = text.map(chunks, ends, "c long, e array<double>").repartition(*keys).sortWithinPartitions(*keys, "c")
    states = text.map(narrow, carried, "c long, s array<double>").select(*[F.col(k).alias(f"_{k}") for k in [*keys, "c"]], "s")
    on = F.lit(True)
    for k in [*keys, "c"]:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return exploded(text.map(chunks.join(states, on).drop(*[f"_{k}" for k in [*keys, "c"]]), finished, "c long, y array<double>"), keys, chunk)


def settle(chunks: DataFrame, inputs: tuple[str, ...], run: Callable, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(chunks, states): the chunks as stored, and keys, c, start (array<double>; null: as a clip begins) of each.

    run(pdf) gives the state at the end of each row's chunk, an array, from its `start` (None or an array).  Only chunks whose
    start changed run again; after r rounds the first r chunks of a clip are right whatever the values, and states that meet within
    a chunk settle in two.  Chunks are stored once, and a round writes one narrow row a chunk; nothing of them reaches the driver.
    """
    spark = chunks.sparkSession
    text = Texts(chunks, keys)
    path = work_dir(spark, "chunks")
    chunks.select(*keys, "c", *inputs).write.parquet(path)
    chunks = spark.read.parquet(path)

    def from_starts(starts: DataFrame | None) -> DataFrame:
        """The ends of the chunks of `starts`; None: all, each as if it began a clip."""
        rows = chunks.withColumn("start", F.lit(None).cast("array<double>")) if starts is None else joined(chunks, starts, keys)
        fresh = starts is None

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[[*keys, "c", "start"]].assign(fresh=fresh, end=[np.asarray(e, float) for e in run(pdf)])

        return text.map(rows, work, "c long, start array<double>, fresh boolean, end array<double>")

    def written(rows: DataFrame) -> DataFrame:
        at = work_dir(spark, "states")
        rows.write.parquet(at)
        return spark.read.parquet(at)

    if chunks.where("c > 0").isEmpty():
        return chunks, chunks.select(*keys, "c", F.lit(None).cast("array<double>").alias("start"))
    before = Window.partitionBy(*keys).orderBy("c")
    states = written(from_starts(None))
    while True:
        last = states.withColumns({"want": F.lag("end").over(before), "led": F.lag("c").over(before).isNotNull()})
        last = last.withColumn("moved", F.col("led") & (F.col("fresh") | ~F.col("start").eqNullSafe(F.col("want"))))
        moved = last.where("moved").select(*keys, "c", F.col("want").alias("start"))
        if moved.isEmpty():
            return chunks, states.select(*keys, "c", "start")
        states = written(last.where("not moved").select(*states.columns).unionByName(from_starts(moved)))


def joined(chunks: DataFrame, states: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Chunks with the other columns of their states; null keys are equal."""
    names = [*keys, "c"]
    on = F.lit(True)
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return chunks.join(states.withColumnsRenamed({k: f"_{k}" for k in names}), on, how).drop(*[f"_{k}" for k in names])


def settled_scan(df: DataFrame, step: Callable, first: Callable, chunk: int = CHUNK, inputs: tuple[str, ...] = ("x",), chunks: DataFrame | None = None) -> DataFrame:
    """keys, idx, y of a recurrence that does not compose: step(state, *inputs) -> (y, state), with state a list of arrays over chunks;
    first(*inputs) is the same for the first sample of a clip.  `chunks` has keys, c and inputs where they are made already."""
    text = Texts(df, KEYS)

    def steps(pdf: pd.DataFrame, whole: bool) -> tuple[list, pd.Index]:
        out, order = [], []
        for rows, data, live, lengths in ragged(pdf, inputs):
            x0 = [d[0] for d in data]
            y0, state = first(*x0)
            fresh = np.array([s is None for s in rows["start"]])
            y = np.empty(data[0].shape)
            if not fresh.all():
                given = [np.where(fresh, 0.0, v) for v in np.array([np.zeros(len(state)) if s is None else s for s in rows["start"]], float).T]
                y1, moved = step(given, *x0)
                y0, state = np.where(fresh, y0, y1), [np.where(fresh, a, b) for a, b in zip(state, moved, strict=True)]
            y[0] = y0

            def go(state, i, n, y=y, data=data):
                if i == 0:
                    return state
                y[i, :n], state = step(state, *(d[i, :n] for d in data))
                return state

            ends = fold(go, state, live)
            out += columns(y, lengths) if whole else list(np.stack(ends).T)
            order.append(rows.index)
        return out, order[0].append(order[1:])

    def ends(pdf: pd.DataFrame) -> list:
        out, order = steps(pdf, False)
        return pd.Series(out, index=order).reindex(pdf.index).tolist()

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, order = steps(pdf, True)
            yield pdf[[*KEYS, "c"]].assign(y=pd.Series(out, index=order))

    chunks, states = settle(chunked(df, inputs, chunk) if chunks is None else chunks, inputs, ends)
    return exploded(text.map(joined(chunks, states, KEYS), outputs, "c long, y array<double>"), KEYS, chunk)
