"""Discounted returns by a segmented scan that composes affine maps.

A step is the map g -> r + gamma g of the return behind it to its own. Maps compose, so a run of steps is a map too, and a
trajectory may lie in many tasks: steps are dealt by ranges of (trajectory, order), each range tells its first steps'
map, the maps of the ranges, one row each, are composed from the last to the first, and each range then gets the return
that comes in from behind. Inside a range a scan by doubling works on whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.operators.order import ranged


def scanned(r: np.ndarray, starts: np.ndarray, gamma: float, behind: float = 0.0) -> np.ndarray:
    """Returns of segments that begin at starts (the first at 0); behind is what comes after the last one.

    A NaN reward makes the returns up to it NaN.
    """
    n = len(r)
    if not n:
        return r
    size = np.diff(np.append(starts, n))
    end = np.repeat(starts + size, size)
    missing = np.isnan(r)
    g = np.where(missing, 0.0, r)
    if np.isnan(behind):
        missing = np.append(missing, True)
        end = np.where(end == n, n + 1, end)
    else:
        g[-1] += gamma * behind
        missing = np.append(missing, False)
    at, s, weight = np.arange(n), 1, float(gamma)
    while s < size.max() and weight != 0.0:
        g[:-s] += np.where(at[:-s] + s < np.minimum(end[:-s], n), weight * g[s:], 0.0)
        s, weight = 2 * s, weight * weight
    nearest = np.minimum.accumulate(np.where(missing, np.arange(n + 1), n + 1)[::-1])[::-1][:n]
    g[nearest < end] = np.nan
    return g


def mc_return(rewards: Column, gamma: float = 0.95) -> Column:
    """array<double> of returns G_t = r_t + gamma * G_(t+1) of an array of rewards, for all arrays of a batch in one scan.

    A null or NaN reward makes the returns up to it null. A null array gives null, an empty one an empty one.
    """

    @F.arrow_udf("array<double>")
    def returns(rows: pa.Array) -> pa.Array:
        rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
        r = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        g = scanned(r, offsets[:-1][size > 0], gamma)
        values = pa.array(g, mask=np.isnan(g))
        null = rows.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)), values)

    return returns(rewards.cast("array<double>"))


class Range:
    """The sorted steps of one range: where its trajectories begin, and the rewards."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).combine_chunks()
        self.part, self.key = t.column(0)[0].as_py(), t.column(1).combine_chunks()
        code = pc.dictionary_encode(self.key, null_encoding="encode").indices.to_numpy()
        self.starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.r = t.column(2).to_numpy().astype(np.float64)

    def ends(self) -> tuple:
        """(first and last trajectory, steps of either, is there but one)."""
        cut = int(self.starts[1]) if len(self.starts) > 1 else len(self.r)
        return self.key[0].as_py(), self.key[-1].as_py(), cut, len(self.r) - int(self.starts[-1]), len(self.starts) == 1


def _range_of(batches: Iterator[pa.RecordBatch]) -> Range | None:
    held = [b for b in batches if b.num_rows]
    return Range(held) if held else None


def mc_return_rows(df: DataFrame, trajectory: str, order: list[str], reward: str, gamma: float = 0.95) -> DataFrame:
    """(trajectory, step from 0, mc_return): one row per step, its place and return.

    order has to tell a trajectory's steps apart for the places to repeat. A null or NaN reward makes the returns up to it
    null; a null trajectory is one like others. A task holds one range of steps, two numbers each, however long a
    trajectory is; the driver sees a row for each range.
    """
    own = df.select(F.col(trajectory).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(reward).cast("double").alias("_r"))
    places = [f"_o{i}" for i in range(len(order))]
    parts = ranged(own, ["_t", *places]).sortWithinPartitions("_t", *places).select("_part", "_t", F.coalesce("_r", F.lit(float("nan"))).alias("_r"))
    kind = dict(own.dtypes)["_t"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _range_of(batches)
        if x is not None:
            first, last, n_first, n_last, one = x.ends()
            g = scanned(x.r[:n_first], np.zeros(1, np.int64), gamma)[0]
            yield pa.RecordBatch.from_arrays([pa.array([x.part], pa.int32()), x.key.slice(0, 1), x.key.slice(len(x.key) - 1), pa.array([n_first], pa.int64()), pa.array([n_last], pa.int64()), pa.array([one]), pa.array([g])], ["part", "first", "last", "n_first", "n_last", "one", "g"])

    rows = sorted(parts.mapInArrow(told, f"part int, first {kind}, last {kind}, n_first long, n_last long, one boolean, g double").collect(), key=lambda r: r.part)
    behind, before = _carried(rows, gamma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _range_of(batches)
        if x is None:
            return
        g = scanned(x.r, x.starts, gamma, behind.get(x.part, 0.0))
        size = np.diff(np.append(x.starts, len(x.r)))
        step = np.arange(len(x.r)) - np.repeat(x.starts, size)
        step[: size[0]] += before.get(x.part, 0)
        out = pa.RecordBatch.from_arrays([x.key, pa.array(step), pa.array(g, mask=np.isnan(g))], ["_t", "step", "mc_return"])
        for a in range(0, out.num_rows, 1 << 16):
            yield out.slice(a, 1 << 16)

    return parts.mapInArrow(run, f"_t {kind}, step long, mc_return double").select(F.col("_t").alias(trajectory), F.col("step").cast("int").alias("step"), "mc_return")


def _carried(rows: list, gamma: float) -> tuple[dict[int, float], dict[int, int]]:
    """By range: the return that comes in behind its last step, and the steps of its first trajectory before it."""
    behind, before = {}, {}
    for x, y in zip(rows[-2::-1], rows[:0:-1]):  # y comes after x, the last pair first
        if x["last"] == y["first"]:
            come = behind.get(y["part"], 0.0) if y["one"] else 0.0
            behind[x["part"]] = y["g"] + gamma ** y["n_first"] * come
    for x, y in zip(rows, rows[1:]):
        if x["last"] == y["first"]:
            before[y["part"]] = x["n_last"] + (before.get(x["part"], 0) if x["one"] else 0)
    return behind, before
