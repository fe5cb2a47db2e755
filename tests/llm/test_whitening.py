from __future__ import annotations

import numpy as np

from trajlake.llm.whitening import SCALE, SHIFT, Whitening, fitted, op12_svd_whitening, summary, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n string"


def saved(spark, folder, rows, parts=1):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def plain(vectors):
    x = np.floor(SCALE * vectors.astype(np.float32).astype(float)).astype(np.int64) + SHIFT
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(1), c @ v[:, ::-1], e[::-1]


def test_equal_to_a_plain_eigendecomposition_over_many_partitions(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(700, 12)) * np.linspace(3, 0.2, 12) + rng.normal(size=12)).astype(np.float32)
    got = op12_svd_whitening(spark, saved(spark, tmp_path, [(i, v.tolist(), 0, "x", "y") for i, v in enumerate(vectors)], parts=40)).toPandas()
    n, far, projected, e = plain(vectors)
    assert len(got) == 700 * 8 and set(got.component) == set(range(1, 9)) and set(got.n) == {n}
    one = got[got.component == 1].set_index("vec_id").deviation.sort_index()
    assert one.tolist() == far.tolist()
    table = got.pivot_table(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = projected[:, :8] / np.sqrt(e[:8])
    sign = np.sign((table * want).sum(0))
    assert np.allclose(table * sign, want, rtol=0, atol=1e-9)
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, e[:8] / e.sum(), rtol=1e-12, atol=0)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_merged_summaries_lose_no_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**6), 10**6, size=(90, 7))
    whole, parts = summary(x), [summary(p) for p in (x[:2], x[2:3], x[3:50], x[50:])]
    made = parts[0]
    for p in parts[1:]:
        made = made.merged(p)
    assert made.n == 90 and made.sums == whole.sums
    assert np.allclose(made.axes.T @ made.axes, whole.axes.T @ whole.axes, rtol=1e-12)
    assert Whitening.of(made).vectors.shape == (7, 7)


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [0.5, 4.0, 5.0]), (4, [-1.0, 0.0, 5.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [inf, 1.0, 2.0]), (10, [1.0, 2.0]), (11, [3e38, 1.0, 1.0])]
    got = op12_svd_whitening(spark, saved(spark, tmp_path, [(*r, 0, "x", "y") for r in good + bad], parts=3)).toPandas()
    assert sorted(got.vec_id.fillna(-1)) == sorted([1] * 6 + [-1] * 3 + [4] * 3)  # repeated rows and rows without an id stay
    n, far, _, e = plain(np.array([v for _, v in good]))
    assert sorted(got[got.component == 1].deviation) == sorted(far.tolist()) and set(got.n) == {4}
    third = got[got.component == 3]  # the last dimension is the same everywhere: no variance
    assert third.whitened.isna().all() and (third.explained == 0).all() and got.identity_error[0] < 1e-9
    assert np.isclose(got[got.component == 1].explained.iloc[0], e[0] / e.sum())


def test_equal_vectors_one_vector_and_none(spark, tmp_path):
    same = op12_svd_whitening(spark, saved(spark, tmp_path / "same", [(i, [1.5, 2.5], 0, "x", "y") for i in range(3)])).toPandas()
    assert len(same) == 6 and same.whitened.isna().all() and same.explained.isna().all() and same.identity_error.isna().all() and (same.deviation == 0).all()
    none = op12_svd_whitening(spark, saved(spark, tmp_path / "none", []))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert op12_svd_whitening(spark, saved(spark, tmp_path / "null", [(1, None, 0, "x", "y")])).count() == 0


def test_exact_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 3], [7, 7]])
    model = Whitening.of(summary(x))
    s = [int(v) for v in x.sum(0)]
    assert model.deviations(x) == [sum((3 * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]


def test_all_dimensions_on_request(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    got = np.array([r.whitened for r in whiten(df, fitted(df)).collect()])
    assert got.shape == (50, 5) and np.allclose(got.T @ got / 50, np.eye(5), atol=1e-9)
