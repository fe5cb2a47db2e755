"""Every query that has SQL, against DuckDB."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from trajlake.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def cell(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(cell, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = ordered(tuple(cell(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_dedupe_is_the_sequential_one(spark):
    import numpy as np

    from trajlake.operators.similarity import greedy_dedupe

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    vectors = centres[rng.integers(0, 12, 120)] + rng.normal(scale=0.25, size=(120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    dropped = set()
    for i in range(120):
        if i not in dropped:
            near = sorted(range(120), key=lambda j: (-round(s[i, j], 9), j))[:4]
            dropped |= {j for j in near if s[i, j] > 0.792}
    assert {r[0] for r in greedy_dedupe(df, "vec_id", "embedding", block_rows=50).select("vec_id").collect()} == set(range(120)) - dropped
