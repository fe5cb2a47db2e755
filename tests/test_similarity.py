from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import similarity

SCHEMA = "id long, v array<double>"


def plain(rows, k, cutoff=None):
    x = np.array([v for _, v in rows])
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    s = np.round(unit @ unit.T, 9)
    out = set()
    for a, (i, _) in enumerate(rows):
        near = sorted((-s[a, b], j) for b, (j, _) in enumerate(rows) if i != j and (cutoff is None or s[a, b] > cutoff))[:k]
        out |= {(i, j, round(-x, 6) + 0.0) for x, j in near}
    return out


def told(df):
    return {(r.query_id, r.index_id, round(r.score, 6) + 0.0) for r in df.collect()}


def clustered(seed, n=400, centres=12, d=8, scale=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    size = rng.choice(centres, n, p=np.array([0.4] + [0.6 / (centres - 1)] * (centres - 1)))  # one holds most
    return [(int(i), (c[g] + rng.normal(scale=scale, size=d)).tolist()) for i, g in enumerate(size)]


@pytest.mark.parametrize(("cutoff", "k"), [(0.9, 4), (0.99, 3), (0.3, 2), (None, 3), (-0.5, 5)])
def test_equal_to_brute_force(spark, cutoff, k):
    rows = clustered(3)
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, [0.0] * 8)]  # copies and a zero vector
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(similarity.nearest_of_all(df, "id", "v", k, block_rows=30, cutoff=cutoff)) == plain(rows, k, cutoff)


def test_bounds_leave_out_pairs_of_cells(spark):
    rows = similarity._vectors(spark.createDataFrame(clustered(5, n=1200, scale=0.03), SCHEMA), "id", "v")
    cells = similarity.cells_of(rows, 40)
    assert cells.rows.sum() == 1200 and cells.blocks.max() > 1
    assert cells.compared(float(np.arccos(0.97))) < 0.4 and cells.compared(np.pi) == 1.0


def test_rows_that_match_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, None), (None, [1.0, 0.0]), (7, [1.0, None]), (8, []), (1, [1.0, 0.01])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(1, 2), (2, 1)}
    assert {(r.query_id, r.index_id) for r in similarity.nearest_of_all(df, "id", "v", 2).collect()} == want
    assert {(r.query_id, r.index_id) for r in similarity.top_k(df, df, "id", "v", 2, exclude_self=True).collect()} == want
    assert sorted((r.id for r in similarity.greedy_dedupe(df, "id", "v").select("id").collect()), key=str) == sorted([1, 1, 3, 4, 5, 6, 7, 8, None], key=str)
    empty = df.filter("false")
    assert similarity.nearest_of_all(empty, "id", "v", 2).count() == 0 and similarity.scores(df, empty, "id", "v", k=1).count() == 0 and similarity.scores(empty, df, "id", "v", k=1).count() == 0


def test_blocks_of_queries_give_what_one_block_gives(spark):
    df = spark.createDataFrame(clustered(7, n=120), SCHEMA)
    one, many = (similarity.top_k(df.filter("id % 2 = 0"), df, "id", "v", 3, block_rows=n) for n in (4096, 7))
    key = lambda x: {(r.query_id, r.index_id, r["rank"]) for r in x.collect()}
    assert key(one) == key(many) and len(key(one)) == 180
    assert similarity.scores(df, df, "id", "v", cutoff=0.9, block_rows=11).count() == similarity.scores(df, df, "id", "v", cutoff=0.9).count()


def test_ties_go_to_the_least_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)]
    got = similarity.nearest_of_all(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "v", 2, block_rows=6)
    assert {(r.query_id, r.index_id) for r in got.collect()} == {(i, j) for i in range(20) for j in [x for x in range(20) if x != i][:2]}
    assert got.filter(F.col("score") != 1.0).count() == 0
