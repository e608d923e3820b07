"""Whitening against plain numpy over exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sparkwave.llm.whitening import whiten


def brute(rows, components=4):
    """{(position): (n, deviation, explained, |whitened| by component)} of usable rows."""
    def usable(v):
        return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)

    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if usable(v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(Fraction(n * x[k] - sums[k], n)) for k in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    place = {x: k for k, x in enumerate(fit)}
    deviation = {x: sum((n * x[k] - sums[k]) ** 2 for k in range(d)) for x in fit}
    return [(i, c + 1, n, deviation[x], white[place[x], c], values[c] / values.sum()) for i, x in kept for c in range(min(components, d))]


def compare(out, want):
    assert len(out) == len(want)
    key = lambda i, c, dev: (str(i), c, dev)
    out = sorted(out, key=lambda r: (key(r["vec_id"], r["component"], r["deviation"]), abs(r["whitened"])))
    want = sorted(want, key=lambda w: (key(w[0], w[1], w[3]), abs(w[4])))
    signs = {}
    for r, w in zip(out, want, strict=True):
        assert (r["vec_id"], r["component"], r["n"], r["deviation"]) == w[:4]
        assert abs(abs(r["whitened"]) - abs(w[4])) < 1e-8 and abs(r["explained"] - w[5]) < 1e-9 and 0 <= r["identity_error"] < 1e-8
        if abs(w[4]) > 1e-6:
            signs.setdefault(r["component"], set()).add(r["whitened"] * w[4] > 0)
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("block", [7, 4096])
def test_against_numpy(spark, block):
    rng = np.random.default_rng(4)
    data = rng.normal(0, 0.2, (60, 9)) * np.linspace(1, 3, 9)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(500, data[3].tolist())] * 3 + [(2**60 + 1, data[3].tolist()), (None, data[5].tolist())]
    odd = [(600, None), (601, [None] + [0.0] * 8), (602, [float("nan")] + [0.0] * 8), (603, [0.0] * 8 + [float("-inf")]), (604, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, row int, x string").repartition(5)
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    compare(whiten(df, rows_per_block=block).collect(), want)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(whiten(df).collect(), brute([(r["vec_id"], r["embedding"]) for r in df.collect()]))


def test_small_and_degenerate(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    line = whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [7.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 if r["component"] == 1 else r["whitened"] is None for r in line)
    big = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3.0, 5.0]), (4, [1e300, 0.0])]
    got = {r["vec_id"]: (r["n"], r["deviation"]) for r in whiten(spark.createDataFrame(big, schema)).collect()}
    n, xs = 3, {i: [math.floor(256 * c) for c in v] for i, v in big[:3]}
    total = [sum(x[k] for x in xs.values()) for k in range(2)]
    exact = {i: sum((n * x[k] - total[k]) ** 2 for k in range(2)) for i, x in xs.items()}
    assert got == {i: (3, v if v < 2**63 else None) for i, v in exact.items()}
