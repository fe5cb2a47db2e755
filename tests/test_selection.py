from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import selection
from trajlake.operators.metrics import describe

INF = float("inf")
EDGES = [0.0, -0.0, INF, -INF, 1e308, -1e308, 5e-324, -5e-324, 2.2250738585072014e-308, 1.0, -1.0, math.nextafter(1.0, 0), math.nextafter(-1.0, 0)]


def test_bits_are_in_the_order_of_the_doubles(spark):
    rng = np.random.default_rng(3)
    any_bits = rng.integers(0, 2**64, 2000, dtype=np.uint64).view(np.float64)
    x = [float(v) for v in any_bits if v == v] + EDGES
    got = spark.createDataFrame([(v,) for v in x], "v double").select("v", selection.ordered_bits("v").alias("u")).select("*", selection.from_ordered_bits("u").alias("w")).collect()
    assert all(r.v == r.w for r in got)
    by_bits = sorted(got, key=lambda r: r.u % 2**64)
    assert [r.v for r in by_bits] == sorted(x) and len({r.u for r in got}) == len(set(x))


def test_cells_never_fall(spark):
    rng = np.random.default_rng(4)
    near = [math.nextafter(2.0**e, d) for e in range(-1074, 1024, 7) for d in (0, INF)] + [2.0**e for e in range(-1074, 1024)]
    x = sorted({float(v) for v in rng.integers(0, 2**64, 3000, dtype=np.uint64).view(np.float64) if v == v} | {*EDGES, *near, *(-v for v in near)})
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, v double").orderBy("i").select(selection.cell(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) > 1000 and max(got) - min(got) < 1 << 16


@pytest.mark.parametrize("few", [3, 1 << 20])
def test_describe_of_groups(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(2)
    value = lambda: rng.choice([0.0, -0.0, 1.0, 1e9, rng.random(), -rng.random() * 1e-6, 1e308, None, float("nan")])
    rows = [(g, value(), float(i)) for g, n in (("a", 120), ("b", 90), (None, 130), ("d", 2)) for i in range(n)] + [("c", None, None), ("e", 7.0, 7.0), ("e", 7.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {(r["g"], r["column"]): r for r in describe(df, ["v", "w"], (0.1, 0.5, 0.99), by=["g"]).collect()}
    for g in ("a", "b", None, "d", "e"):
        for c, at in (("v", 1), ("w", 2)):
            x = np.array([r[at] for r in rows if r[0] == g and r[at] is not None and r[at] == r[at]])
            r = got[g, c]
            assert r["n"] == len(x) and (not len(x) or np.allclose([r["p10"], r["p50"], r["p99"]], np.percentile(x, [10, 50, 99]), rtol=1e-12))
    assert got["c", "v"]["n"] == 0 and got["c", "v"]["p50"] is None


@pytest.mark.parametrize("few", [2, 1 << 20])
def test_infinite_and_extreme_values(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)

    def told(values, *ps):
        return describe(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], ps).first()

    one = told([1.0, 2.0, 3.0, 4.0, 5.0, INF], 0.25, 0.5, 0.95, 1.0)
    assert (one.p25, one.p50, one.p95, one.p100, one.max, one.n) == (2.25, 3.5, INF, INF, INF, 6)
    both = told([-INF, INF, INF], 0.0, 0.25, 0.5, 1.0)
    assert (both.p0, both.p50, both.p100) == (-INF, INF, INF) and both.p25 != both.p25
    wide = told([-1e308, 1e308], 0.0, 0.25, 0.5, 1.0)
    assert (wide.p0, wide.p25, wide.p50, wide.p100) == (-1e308, -5e307, 0.0, 1e308)
    zero = told([-0.0, 0.0, -0.0], 0.5)
    assert zero.p50 == 0.0 and math.copysign(1, zero.p50) == 1
    same = told([INF, INF], 0.3)
    assert same.p30 == INF
    copies = told([2.5] * 500 + [1.0], 0.5, 0.001)
    assert copies.p50 == 2.5


def test_describe_of_an_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "n double, mean double, `_begin` string")
    assert sorted((r["column"], r["n"], r["p50"]) for r in describe(df, ["n", "mean"]).collect()) == [("mean", 0, None), ("n", 0, None)]
    assert describe(df, ["n"], by=["_begin"]).count() == 0
    full = spark.createDataFrame([(1.0, 2.0, "x"), (3.0, None, "x"), (5.0, None, None)], df.schema)
    got = {(r["_begin"], r["column"]): r.p50 for r in describe(full, ["n", "mean"], by=["_begin"]).collect()}
    assert got == {("x", "n"): 2.0, ("x", "mean"): 2.0, (None, "n"): 5.0, (None, "mean"): None}
