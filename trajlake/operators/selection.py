"""Exact order statistics of many groups at once.

A first pass counts values in CELLS of their sign and logarithm, which tells the cell of each wanted rank wherever values lie,
infinite ones among them. What such a cell holds, if it isn't much, is sorted, its equal values counted together
first. Cells that hold more take radix selection: a double is mapped to a 64-bit number in the same order, a pass counts
16 bits of the numbers of those values whose higher bits are already known to be a wanted rank's, for all ranks of all
groups together, and the counts tell the next 16 bits. So at most five passes of partial counts find every value exactly,
however often values repeat, and a group of any size is at most 65,536 counts for each wanted rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from trajlake.operators.order import pinned

#: What is left of a group in the cell of a rank is sorted by one task if it is up to so many values.
FEW = 1 << 20
#: Cells for each doubling; there are 62,947 in all.
CELLS = 15
DIGIT = 16
TOP = np.int64(-(1 << 63))
#: Up to so many wanted ranks their beginnings are broadcast, some 100 bytes each; more are joined by a shuffle.
BROADCAST_RANKS = 100_000


@F.pandas_udf(LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """A double's bits as a long that, read without a sign, is in the order of the doubles; -0.0 is 0.0. Not null."""
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ TOP))


@F.pandas_udf(DoubleType())
def from_ordered_bits(u: pd.Series) -> pd.Series:
    """The double of ordered_bits."""
    bits = u.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ TOP, ~bits).view(np.float64))


def _wanted(ranks: DataFrame) -> DataFrame:
    """(_k, _begin, _want): for each key the ranks with what is left of them behind the values below _begin, here none."""
    return ranks.distinct().groupBy("_k").agg(F.collect_list(F.struct("_r", F.col("_r").cast("long").alias("_left"))).alias("_want")).select("_k", F.lit(0).cast("long").alias("_begin"), "_want")


def _found(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows of counts (by, order, _n, _want) in which a wanted rank lies; _want holds these ranks, less the values below."""
    below = F.sum("_n").over(Window.partitionBy(*by).orderBy(order)) - F.col("_n")
    here = F.filter("_want", lambda w: (w["_left"] >= F.col("_below")) & (w["_left"] < F.col("_below") + F.col("_n")))
    moved = F.transform(here, lambda w: F.struct(w["_r"].alias("_r"), (w["_left"] - F.col("_below")).alias("_left")))
    return counts.withColumn("_below", below).withColumn("_want", moved).filter(F.size("_want") > 0)


def cell(v: Column) -> Column:
    """The number of a double's cell, which never falls as the double rises: logarithms are monotonic as Java defines them."""
    size = F.abs(v)
    place = F.least(F.floor(F.log2(size) * CELLS), F.lit(1024 * CELLS + 1)) + 1074 * CELLS + 2
    return F.when(size == 0, 0).when(v < 0, -place).otherwise(place).cast("long")


def values_at_ranks(values: DataFrame, ranks: DataFrame, broadcast: bool = False) -> DataFrame:
    """(_k, _r, _v): the value at rank _r (from 0) of each key, from values (_k, _v: doubles, neither null nor NaN) and ranks (_k, _r).

    Ranks at or beyond the number of a key's values have no row; a repeated rank is told once. -0.0 is 0.0. broadcast: the
    ranks are known to be few.
    """
    few = F.broadcast if broadcast else (lambda df: df)
    rows = values.select("_k", (F.col("_v") + F.lit(0.0)).alias("_v"), cell(F.col("_v")).alias("_cell"))
    counts = rows.groupBy("_k", "_cell").agg(F.count("*").alias("_n")).join(few(_wanted(ranks).drop("_begin")), "_k")
    told = pinned(_found(counts, ["_k"], "_cell").select("_k", "_cell", "_n", "_want"))
    if (told.agg(F.max("_n")).first()[0] or 0) <= FEW:
        equal = rows.join(few(told.drop("_n")), ["_k", "_cell"]).groupBy("_k", "_cell", "_want", "_v").agg(F.count("*").alias("_n"))
        return _found(equal, ["_k", "_cell"], "_v").select("_k", F.explode("_want._r").alias("_r"), "_v")
    inside = rows.join(few(told.select("_k", "_cell")), ["_k", "_cell"]).select(F.struct("_k", "_cell").alias("_k"), "_v")
    left = told.select(F.struct("_k", "_cell").alias("_k"), F.explode("_want").alias("_w"))
    found = radix_values_at_ranks(inside, left.select("_k", F.col("_w._left").alias("_r")), broadcast)
    asked = left.select("_k", F.col("_w._left").alias("_r"), F.col("_w._r").alias("_rank"))
    return found.join(few(asked), ["_k", "_r"]).select("_k._k", F.col("_rank").alias("_r"), "_v")


def radix_values_at_ranks(values: DataFrame, ranks: DataFrame, broadcast: bool = False) -> DataFrame:
    """As values_at_ranks, by four passes over the values' bits."""
    few = F.broadcast if broadcast else (lambda df: df)
    rows = values.select("_k", ordered_bits("_v").alias("_u"))
    state = _wanted(ranks)  # one row for each beginning that is still wanted
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("_u", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("_digit")
        if shift + DIGIT == 64:  # all values count, and the ranks come to the counts
            counts = rows.groupBy("_k", digit).agg(F.count("*").alias("_n")).join(few(state), "_k")
        else:
            met = rows.withColumn("_begin", F.shiftrightunsigned("_u", shift + DIGIT)).join(few(state), ["_k", "_begin"])
            counts = met.groupBy("_k", "_begin", "_want", digit).agg(F.count("*").alias("_n"))
        state = _found(counts, ["_k", "_begin"], "_digit")
        state = state.select("_k", F.shiftleft("_begin", DIGIT).bitwiseOR(F.col("_digit")).alias("_begin"), "_want")
    return state.select("_k", F.explode("_want._r").alias("_r"), from_ordered_bits("_begin").alias("_v"))


def between(a: Column, b: Column, share: Column) -> Column:
    """The point between two order statistics, by linear interpolation; equal ones are that value, infinite or not."""
    gap = b - a
    return F.when((a == b) | (share == 0), a).when(F.abs(gap) < F.lit(float("inf")), a + gap * share).otherwise(a * (1 - share) + b * share)
