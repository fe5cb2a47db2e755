"""All rows against all rows by packs: what is shuffled, and groups of copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.operators import similarity


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_vectors_are_shuffled_once(spark):
    v = np.random.default_rng(2).normal(size=(2000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)
    df = df.cache()
    df.count()
    before = shuffled(spark)
    similarity.nearest_of_all(df, "id", "v", 4, block_rows=40, cutoff=0.792).count()
    assert shuffled(spark) - before < 3 * v.nbytes


@pytest.mark.parametrize(("kind", "cutoff", "block_rows"), [("float", 0.792, 60), ("double", 0.9, 20), ("float", None, 500)])
def test_groups_of_copies(spark, kind, cutoff, block_rows):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 16))
    v[100:400] = v[7]  # copies
    v[400:600] = v[8] + rng.normal(scale=0.02, size=(200, 16))  # near copies
    v = v[rng.permutation(700)].astype("float32").astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3).select("id", F.col("v").cast(f"array<{kind}>").alias("v"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    want = {(i, j) for i in range(700) for j in sorted((j for j in range(700) if j != i), key=lambda j: (-s[i, j], j))[:4] if cutoff is None or s[i, j] > cutoff}
    got = similarity.nearest_of_all(df, "id", "v", 4, block_rows=block_rows, cutoff=cutoff).collect()
    assert {(r.query_id, r.index_id) for r in got} == want and len(got) == len(want)
    assert max(abs(r.score - s[r.query_id, r.index_id]) for r in got) < 2e-9


def test_first_of_equal_vectors_are_enough_for_any_query():
    ids = np.array([5, 3, 3, 3, 9, 7, 8, 3, 4])
    raw = np.array([[1.0, 2.0]] * 8 + [[0.0, 1.0]])
    for k in (1, 2, 3):
        first = similarity._first_of_equal(ids, raw, k)
        assert first[8]
        for left_out in {3, 5, 7, 99}:
            assert sorted(ids[:8][first[:8] & (ids[:8] != left_out)])[:k] == sorted(ids[:8][ids[:8] != left_out])[:k]
