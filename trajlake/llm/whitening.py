"""Whitening of embeddings by a hierarchy of merged singular value decompositions.

A summary of vectors is their number, their exact sums and all singular values and right vectors of the centred vectors: as many as
there are dimensions, so that nothing of the covariance is lost. Two summaries merge by the decomposition of both sets of
scaled right vectors with one row more, the difference of the means times sqrt(n1 n2 / (n1 + n2)). Partitions summarise
their rows batch by batch; summaries merge FAN at a time until one is left, so no task holds more than FAN of them and
the driver gets one, of d x d numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import table, written

FAN = 16
SCALE, SHIFT = 1024, 100_000
LOW = (1 << 26) - 1
STATE = "part long, n long, sums array<string>, axes array<double>"


@dataclass
class Summary:
    """n vectors: their sums as exact whole numbers, and axes, d rows of right singular vectors times singular values."""

    n: int
    sums: list[int]
    axes: np.ndarray

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # (m1 - m2) sqrt(n1 n2 / n), from whole numbers up to the last step
        gap = np.array([a * other.n - b * self.n for a, b in zip(self.sums, other.sums)], dtype=object)
        shift = np.array([float(g) for g in gap]) / np.sqrt(float(self.n) * float(other.n) * float(n))
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], _axes(np.vstack([self.axes, other.axes, shift[None, :]])))


def _axes(rows: np.ndarray) -> np.ndarray:
    """d rows with the same rows' products as the given ones: singular values times right vectors, the largest first."""
    d = rows.shape[1]
    _, s, v = np.linalg.svd(np.linalg.qr(rows, mode="r") if len(rows) > d else rows, full_matrices=False)
    out = np.zeros((d, d))
    out[: len(s)] = s[:, None] * v
    return out


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of whole numbers below 2^53, whatever their size together."""
    return [(int(a) << 26) + int(b) for a, b in zip((x >> 26).sum(0), (x & LOW).sum(0))]


def summary(x: np.ndarray) -> Summary:
    """Of the rows of a matrix of whole numbers."""
    sums, n = exact_sums(x), len(x)
    return Summary(n, sums, _axes(centred(x, n, sums)))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, where the whole parts are taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole) - np.array([float(s % n) / n for s in sums])


@dataclass
class Whitening:
    """What the fit learned of x-vectors: n and sums, eigenvalues (falling) and unit eigenvectors (rows) of their covariance.

    All dimensions are kept. Eigenvalues that are zero as far as doubles tell are zero.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(s: Summary) -> Whitening:
        _, sv, v = np.linalg.svd(s.axes)
        sv = np.where(sv > sv.max(initial=0.0) * len(sv) * np.finfo(float).eps, sv, 0.0)
        return Whitening(s.n, s.sums, sv**2 / s.n, v)

    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return self.values / total if total > 0 else np.full(len(self.values), np.nan)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """Projections of centred rows over the square roots of the eigenvalues; NaN where the eigenvalue is zero."""
        e = self.values[:components]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > 0, centred(x, self.n, self.sums) @ self.vectors[:components].T / np.sqrt(e), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 for each row, exact."""
        n, sums = self.n, self.sums
        far = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.max(0), x.min(0), sums)), default=0) if len(x) else 0
        if far * far * max(1, x.shape[1]) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
            gap = n * x - np.array(sums, dtype=np.int64)
            return (gap * gap).sum(1).tolist()
        gap = n * x.astype(object) - np.array(sums, dtype=object)
        return (gap * gap).sum(1).tolist()


def usable(vec: Column) -> Column:
    """Is the vector neither null nor empty, and are all of its entries finite and below 2^42?"""
    v = vec.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float(1 << 42)), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True))), F.lit(False))


def as_whole(vec: Column) -> Column:
    """Entries c as floor(1024 c) + 100000, long."""
    return F.transform(vec.cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))


def _usual_width(x: DataFrame, vec: str) -> int | None:
    """The number of entries that most vectors have (of equally many the least); null without a vector."""
    row = x.groupBy(F.size(vec).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return row[0] if row else None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _row(part: int, s: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), pa.array([[str(x) for x in s.sums]], pa.list_(pa.string())), pa.array([s.axes.ravel()], pa.list_(pa.float64()))], ["part", "n", "sums", "axes"])


def summarised(x: DataFrame, vec: str) -> Summary | None:
    """The summary of all vectors (arrays of long, of one width) of a table; null of an empty one.

    The first summaries, one for each partition, are written to the shared folder; a level of the hierarchy brings FAN
    of neighbouring partitions together.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                s = summary(_matrix(b.column(0).slice(a, 4096)))
                made = s if made is None else made.merged(s)
        if made is not None:
            yield _row(TaskContext.get().partitionId(), made)

    def merge(t: pa.Table) -> pa.Table:
        t, made = t.sort_by("part"), None
        for n, sums, axes in zip(*(t.column(c).to_pylist() for c in ("n", "sums", "axes"))):
            s = Summary(n, [int(v) for v in sums], np.array(axes).reshape(len(sums), -1))
            made = s if made is None else made.merged(s)
        return pa.Table.from_batches([_row(t.column("part")[0].as_py() // FAN, made)])

    level = written(x.select(vec).mapInArrow(first, STATE), "summaries")
    left = (level.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        level = level.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge, STATE)
        left = -(-left // FAN)
    row = level.first()
    return row and Summary(row["n"], [int(v) for v in row["sums"]], np.array(row["axes"]).reshape(len(row["sums"]), -1))


def fitted(vectors: DataFrame, vec: str = "embedding") -> Whitening | None:
    """The whitening of a table's usable vectors of the usual width, as whole numbers; null if there is none."""
    x = vectors.filter(usable(F.col(vec))).select(as_whole(F.col(vec)).alias("x"))
    width = _usual_width(x, "x")
    found = None if width is None else summarised(x.filter(F.size("x") == width), "x")
    return found and Whitening.of(found)


def whiten(vectors: DataFrame, model: Whitening | None, id_: str = "vec_id", vec: str = "embedding", components: int | None = None) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>): a row for each usable vector of the model's width.

    components: how many of the falling eigenvalues to take; all if null. A component without variance is NaN. A
    deviation of over 38 digits is null. Repeated rows and rows without an id each count; other columns are not read.
    """
    kind = dict(vectors.dtypes)[id_]
    schema = f"`{id_}` {kind}, deviation decimal(38,0), whitened array<double>"
    x = vectors.filter(usable(F.col(vec))).select(F.col(id_), as_whole(F.col(vec)).alias("x"))
    if model is None:
        return x.select(id_, F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")).filter("false")
    width = len(model.sums)
    take = width if components is None else min(components, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                w = model.whitened(m, take)
                far = pa.array([str(d) if d < 10**38 else None for d in model.deviations(m)], pa.string()).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), far, pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * take), pa.array(w.ravel()))], [id_, "deviation", "whitened"])

    return x.filter(F.size("x") == width).mapInArrow(run, schema)


GRID = 1 << 40  # whitened values are rounded to multiples of its reciprocal to be summed exactly


def identity_error(white: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of whitened rows minus the identity, over components that have variance."""
    live = int((model.values > 0).sum())
    whole = white.select(F.transform(F.slice("whitened", 1, live), lambda c: F.round(c * F.lit(float(GRID))).cast("long")).alias("w")).filter(F.size("w") > 0)
    found = summarised(whole, "w")
    if found is None:
        return None
    cov = found.axes.T @ found.axes / found.n / float(GRID) ** 2
    return float(np.abs(cov - np.eye(len(cov))).max())


def op12_svd_whitening(spark, sf_dir):
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable vector and component up to 8.

    Rows whose vector is null, empty, or holds null, non-finite or huge (2^42 or more) entries go, as do vectors of another
    width than the most frequent one. A component without variance has a null whitened and explained 0, null if nothing varies; identity_error is then
    over the others. A deviation beyond a long is null. Repeated rows each count.
    """
    vectors = table(spark, sf_dir, "embeddings")
    model, most = fitted(vectors), 8
    white = whiten(vectors, model, components=most)
    error = None if model is None else identity_error(white, model)
    share = [None if np.isnan(e) else float(e) for e in model.explained()[:most]] if model else []
    shares = F.array(*[F.lit(e).cast("double") for e in share]).cast("array<double>")
    n = F.lit(model.n if model else None).cast("long").alias("n")
    rows = white.select("vec_id", n, F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "w"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.nanvl("w", F.lit(None).cast("double")).alias("whitened"), shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
