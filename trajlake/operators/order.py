"""Order-dependent operators that stay distributed: global ranks, slices, shards, seeded shuffles."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pinned_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where none is set a temporary one is made in local mode, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="trajlake-"))
    return (where or sc.getCheckpointDir()).rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder."""
    pinned_folder(df.sparkSession)
    return df.checkpoint()


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _part, the number of its range in the order; pinned, as range bounds are sampled anew at each evaluation."""
    return pinned(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))


def global_index(df: DataFrame, order: list[str], out: str = "row_index") -> DataFrame:
    """df with 0-based ranks over all rows, which order must tell apart.

    Rows are dealt by ranges and numbered inside; the ranges' sizes, one row each, are summed and broadcast.
    """
    parts = ranged(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_i", inner).join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_i")).drop("_part", "_i", "_base")


def round_robin_shards(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """df with shard = rank mod shards."""
    return global_index(df, order).withColumn("shard", (F.col("row_index") % shards).cast("int"))


def row_slice(df: DataFrame, order: list[str], start: int, stop: int | None = None) -> DataFrame:
    """Rows with rank start <= i < stop; stop None or -1 is the end."""
    out = global_index(df, order).filter(F.col("row_index") >= start)
    return out if stop in (None, -1) else out.filter(F.col("row_index") < stop)


def shuffle_key(id_: Column, seed: int) -> Column:
    """Order by this for a repeatable shuffle that any engine can repeat: the md5 of seed and id as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def shuffled_slice(df: DataFrame, id_: str, start: int, k: int, seed: int = 42) -> DataFrame:
    return row_slice(df.withColumn("_key", shuffle_key(F.col(id_), seed)), ["_key", id_], start, start + k).drop("_key")


def seeded_sample(df: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of id: each task keeps n at most."""
    return df.orderBy(shuffle_key(F.col(id_), seed), id_).limit(n)


def sample_per_group(df: DataFrame, group: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(group).orderBy(shuffle_key(F.col(id_), seed), id_)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hash_split(df: DataFrame, id_: str, train_share: float, seed: int = 42) -> DataFrame:
    """df with split: the first train_share of the hash range trains. A row's split doesn't depend on the other rows."""
    u = F.conv(F.substring(shuffle_key(F.col(id_), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < train_share, "train").otherwise("test"))


def train_test_cut(df: DataFrame, id_: str, train_share: float, seed: int = 42) -> DataFrame:
    """df with split: a seeded shuffle cut by position, so that floor(train_share * n) rows train. Ids must differ."""
    n = df.agg(F.floor(F.count("*") * train_share).alias("_cut"))
    rows = global_index(df.withColumn("_key", shuffle_key(F.col(id_), seed)), ["_key", id_], "_at").crossJoin(F.broadcast(n))
    return rows.withColumn("split", F.when(F.col("_at") < F.col("_cut"), "train").otherwise("test")).drop("_key", "_at", "_cut")


def drop_to_multiple(df: DataFrame, order: list[str], r: int) -> DataFrame:
    """The first floor(n / r) * r rows in the order."""
    n = df.agg(F.count("*").alias("_all"))
    return global_index(df, order).crossJoin(F.broadcast(n)).filter(F.col("row_index") < F.col("_all") - F.col("_all") % r).drop("row_index", "_all")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
