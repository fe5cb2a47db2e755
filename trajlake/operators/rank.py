"""Selection and ranking inside groups. Every order ends in an ordinal or an id, so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.core import fold_sum


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def tts_select(df: DataFrame, instance: str, score: str, valid_runs: str, tie: list[str], reward: str) -> DataFrame:
    """Per instance the candidate with the greatest score.

    (instance, tie columns, score, reward, n_candidates, n_ties, k_effective, reason). reason: max_avg, tie_random (the
    first by the tie columns) or fallback_no_avg (no candidate has a score). A missing reward is 0.
    """
    w = Window.partitionBy(instance)
    best = F.max(score).over(w)
    facts = {
        "_best": best, "n_candidates": F.count("*").over(w), "k_effective": F.sum((F.coalesce(F.col(valid_runs), F.lit(0)) > 0).cast("long")).over(w),
    }
    df = df.withColumns(facts).withColumn("n_ties", F.sum((F.col(score) == F.col("_best")).cast("long")).over(w))
    picked = first_of(df, [instance], [F.desc_nulls_last(score), *[F.asc(t) for t in tie]])
    reason = F.when(F.col("_best").isNull(), "fallback_no_avg").when(F.col("n_ties") > 1, "tie_random").otherwise("max_avg")
    return picked.select(instance, *tie, score, F.coalesce(F.col(reward), F.lit(0)).alias(reward), "n_candidates", F.coalesce("n_ties", F.lit(0)).alias("n_ties"), "k_effective", reason.alias("reason"))


def tts_summary(selected: DataFrame, reward: str) -> DataFrame:
    return selected.agg(
        F.count("*").alias("instances"), F.sum((F.col(reward) == 1).cast("long")).alias("solved"), F.avg((F.col(reward) == 1).cast("double")).alias("ratio"), F.avg("k_effective").alias("avg_k"),
        F.min("k_effective").alias("min_k"), F.max("k_effective").alias("max_k"), F.count_if(F.col("reason") == "tie_random").alias("ties"), F.count_if(F.col("reason") == "fallback_no_avg").alias("no_score"))


def best_by(df: DataFrame, group: str, column: str, ordinal: str, largest: bool = True) -> DataFrame:
    """Argmax or argmin of a column in each group; the first row by ordinal of equals."""
    return first_of(df, [group], [F.desc_nulls_last(column) if largest else F.asc_nulls_last(column), F.asc(ordinal)])


def topk_then_max(df: DataFrame, group: str, first: str, k: int, second: str, ordinal: str) -> DataFrame:
    """Of the k rows with the greatest `first` the one with the greatest `second`."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(first), F.asc(ordinal))
    return best_by(df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k"), group, second, ordinal)


def topk_ties_then_max(df: DataFrame, group: str, first: str, k: int, second: str, ordinal: str, prefer: Column | None = None) -> DataFrame:
    """As topk_then_max, but all rows at least as great as the kth count. prefer: if any row of a group has it, the others don't count."""
    if prefer is not None:
        some = F.max(F.coalesce(prefer, F.lit(False)).cast("int")).over(Window.partitionBy(group))
        df = df.withColumn("_some", some).filter((F.col("_some") == 0) | F.coalesce(prefer, F.lit(False))).drop("_some")
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(first))
    return best_by(df.withColumn("_k", F.rank().over(w)).filter(F.col("_k") <= k).drop("_k"), group, second, ordinal)


def min_max_scaled(df: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """column scaled to 0..1 in its group; 0 where all are equal."""
    w = Window.partitionBy(group)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(0.0))


def correct_share(df: DataFrame, flag: str, n_total: int | None = None) -> DataFrame:
    """Rows with the flag over n_total, a fixed number of problems, or over the rows."""
    return df.agg(F.sum((F.col(flag) == 1).cast("long")).alias("correct"), (F.sum((F.col(flag) == 1).cast("long")) / (F.lit(n_total) if n_total else F.count("*"))).alias("share"))


def mixed_pairs(df: DataFrame, group: str, reward: str, order: list[Column]) -> DataFrame:
    """Of each group that has both rewards 1 and 0 the first row of each."""
    w = Window.partitionBy(group)
    both = df.filter(F.col(reward).isin(0, 1)).withColumn("_lo", F.min(reward).over(w)).withColumn("_hi", F.max(reward).over(w)).filter("_lo = 0 and _hi = 1").drop("_lo", "_hi")
    return first_of(both, [group, reward], order)


def priority_pairs(df: DataFrame, group: str, reward: str, exit_reason: str, ordinal: str, preferred: str = "agent", singles: int = 500) -> DataFrame:
    """mixed_pairs with preferred exits first, and up to `singles` first rows of all-positive and of all-negative groups each."""
    order = [(F.col(exit_reason) != preferred).asc(), F.asc(exit_reason), F.asc(ordinal)]
    w = Window.partitionBy(group)
    kinds = df.filter(F.col(reward).isin(0, 1)).withColumn("_lo", F.min(reward).over(w)).withColumn("_hi", F.max(reward).over(w))
    pairs = first_of(kinds.filter("_lo = 0 and _hi = 1"), [group, reward], order)
    alone = first_of(kinds.filter("_lo = _hi"), [group], order)
    parts = [alone.filter(F.col(reward) == r).orderBy(ordinal).limit(singles) for r in (1, 0)]
    return pairs.unionByName(parts[0]).unionByName(parts[1]).drop("_lo", "_hi")


def running(df: DataFrame, flag: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with the running count, sum and mean of a 0/1 flag in an order, within groups.

    Without groups the order is over all rows: a two-level sum keeps it distributed. Rows are ranged by the order, each
    range is summed, and a row adds the sums of the ranges before its own.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("n_so_far", F.count("*").over(w)).withColumn("solved_so_far", F.sum(flag).over(w)).withColumn("rate_so_far", F.avg(flag).over(w))
    from trajlake.operators.order import ranged

    parts = ranged(df, order)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(flag).alias("_s"))
    # one row for each range: this window is over as many rows as there are ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    out = parts.withColumn("_k", F.count("*").over(w)).withColumn("_t", F.sum(flag).over(w)).join(F.broadcast(base), "_part")
    out = out.withColumn("n_so_far", F.col("_n0") + F.col("_k")).withColumn("solved_so_far", F.col("_s0") + F.col("_t"))
    return out.withColumn("rate_so_far", F.col("solved_so_far") / F.col("n_so_far")).drop("_part", "_k", "_t", "_n0", "_s0")


def group_advantage(df: DataFrame, uid: str, reward: str, eps: float = 1e-6, scale: bool = True) -> DataFrame:
    """df with the group-relative advantage (r - mean) / (std + eps), by the published GRPO formula; scale=False leaves out the division."""
    w = Window.partitionBy(uid)
    centred = F.col(reward) - F.avg(reward).over(w)
    return df.withColumn("advantage", centred / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + eps) if scale else centred)


def leave_one_out_advantage(df: DataFrame, uid: str, reward: str) -> DataFrame:
    """df with r minus the mean of the group's others, by the published RLOO formula; a single rollout keeps its reward."""
    w = Window.partitionBy(uid)
    n, s = F.count(reward).over(w), F.sum(reward).over(w)
    return df.withColumn("advantage", F.when(n > 1, F.col(reward) - (s - F.col(reward)) / (n - 1)).otherwise(F.col(reward)))


def last_step_flags(df: DataFrame, trajectory: str, order: list[str]) -> DataFrame:
    """df with is_last_step and n_steps."""
    w = Window.partitionBy(trajectory)
    return df.withColumn("is_last_step", F.lead(F.lit(1)).over(w.orderBy(*order)).isNull()).withColumn("n_steps", F.count("*").over(w))


def broadcast_last(df: DataFrame, trajectory: str, order: list[str], value: str, out: str, per_step: bool = False) -> DataFrame:
    """df with the last step's value on every step of its trajectory, over the number of steps if per_step."""
    w = Window.partitionBy(trajectory).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.last(value).over(w)
    return df.withColumn(out, v / F.count("*").over(Window.partitionBy(trajectory)) if per_step else v)


def longest_run(df: DataFrame, trajectory: str, order: list[str], value: str) -> DataFrame:
    """(trajectory, longest_run): most consecutive steps with one non-null value; a null ends a run."""
    w = Window.partitionBy(trajectory).orderBy(*order)
    new = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(trajectory, "_run").agg(F.count(value).alias("n")).groupBy(trajectory).agg(F.max("n").alias("longest_run"))


def last_assistant(df: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """The last assistant turn of each conversation and the turns behind it."""
    at = F.max(F.when(F.col(role) == "assistant", F.col(turn))).over(Window.partitionBy(conv))
    return df.withColumn("_at", at).filter(F.col(turn) >= F.col("_at")).drop("_at")


def longest_tests(tests: Column, most: int = 15) -> Column:
    """The `most` tests with the longest inputs of an array<struct<input, ...>>, in that order; the earlier of equals first."""
    indexed = F.transform(tests, lambda t, i: F.struct((-F.length(t["input"])).alias("k"), i.alias("i"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(indexed), 1, most), lambda x: x["t"])


def discounted_sum(rewards: Column, gamma: float) -> Column:
    return fold_sum(F.transform(rewards, lambda r, i: r * F.pow(F.lit(gamma), i)))
