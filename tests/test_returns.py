from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import returns


def plain(rewards, gamma):
    g, out = 0.0, []
    for x in reversed(rewards):
        g = None if x is None or x != x or g is None else x + gamma * g
        out.append(g)
    return out[::-1]


def near(got, want):
    return len(got) == len(want) and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 * max(1, abs(b))) for a, b in zip(got, want))


@pytest.mark.parametrize("gamma", [0.95, 0.2, 1.0, 0.0])
def test_arrays(spark, gamma):
    rng = np.random.default_rng(1)
    rows = [[float(x) for x in rng.normal(size=n)] for n in (1, 2, 3, 7, 64, 1000)] + [[], None, [1.0, None, 2.0, 3.0], [None], [1.0, float("nan"), 5.0]]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, r array<double>").repartition(3).select("i", returns.mc_return(F.col("r"), gamma).alias("g")).collect()
    for r in got:
        want = None if rows[r.i] is None else plain(rows[r.i], gamma)
        assert (r.g is None and want is None) or near(r.g, want)


@pytest.mark.parametrize(("gamma", "parts"), [(0.95, 13), (1.0, 5), (0.5, 1)])
def test_rows_over_many_ranges(spark, gamma, parts, monkeypatch):
    monkeypatch.setattr(returns, "ranged", lambda df, order: ranged_to(df, order, parts))
    rng = np.random.default_rng(2)
    sizes = {"long": 900, "a": 1, "b": 30, None: 12, "": 3, "zz": 200}  # one lies in many ranges
    rows = [(k, i, None if k == "b" and i == 20 else float(rng.normal())) for k, n in sizes.items() for i in range(n)]
    if parts == 5:
        rows = [(k, i, None if k == "long" and i == 800 else r) for k, i, r in rows]  # nothing comes through a null
    df = spark.createDataFrame(rows, "traj string, _r int, reward double").repartition(4)
    got = {(r.traj, r.step): r.mc_return for r in returns.mc_return_rows(df, "traj", ["_r"], "reward", gamma).collect()}
    for k, n in sizes.items():
        want = plain([r for t, _, r in rows if t == k], gamma)
        assert near([got[k, i] for i in range(n)], want)
    assert len(got) == len(rows)


def ranged_to(df, order, parts):
    from trajlake.operators.order import pinned

    return pinned(df.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))


def test_a_long_trajectory_and_none(spark):
    df = spark.range(300_000).select(F.lit(1).alias("t"), "id", F.lit(1.0).alias("r"))
    got = returns.mc_return_rows(df, "t", ["id"], "r", 0.999).agg(F.max("mc_return"), F.min("mc_return"), F.max("step"), F.count("*")).first()
    assert abs(got[0] - 1000) < 1e-6 and got[1] == 1.0 and got[2] == 299_999 and got[3] == 300_000
    assert returns.mc_return_rows(df.filter("false"), "t", ["id"], "r").count() == 0
