"""Queries over loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import commits
from trajlake.plans.registry import query

@query("routing_skew", "WITH p AS (SELECT o_custkey % 5 AS server, sum(CAST(1 AS BIGINT)) AS load FROM orders GROUP BY 1) SELECT server, CAST(load AS BIGINT) AS load, (SELECT max(load) - min(load) FROM p) >= 4 AS rebalance FROM p")
def routing_skew(t):
    return commits.routing_skew(t.orders.select((F.col("o_custkey") % 5).alias("server"), F.lit(1).cast("long").alias("one")), "server", "one")
