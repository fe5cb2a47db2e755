"""Connected components over a distributed edge list (alternating large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import remove, spread_join, written


def _stats(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links between longs -> (node, root), one row per node that has a link; root is the least node reached.

    Each round is two group-by-minimum steps and two equi-joins on distributed tables, written to the shared
    folder; nothing but a count and a checksum reaches the driver. A node with very many neighbours is a
    partially aggregated minimum on one side and a row sent to all tasks on the other.
    Null ends and self links carry no information and are ignored; an empty list gives an empty result.
    """
    e = edges.filter("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _stats(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        old = [e.folder]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = spread_join(large, low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(low.select("u", F.col("m").alias("v")).union(hung).distinct(), "cc")
        remove(e.sparkSession, [*old, large.folder])
        after = _stats(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
