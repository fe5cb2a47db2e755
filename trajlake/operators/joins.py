"""Joins by meaning: regressions between test runs, recall of files, set relations, resume, commits to issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.core import let


def regression_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left join that keeps the left value where both have it (<value>_x and <value>_y stay)."""
    r = right.select(*keys, *[F.col(c).alias(f"{c}_y") if c in left.columns else F.col(c) for c in right.columns if c not in keys])
    out = left.withColumnsRenamed({c: f"{c}_x" for c in left.columns if c not in keys and c in right.columns}).join(r, keys, "left")
    return out.withColumn(value, F.col(f"{value}_x"))


def resume(todo: DataFrame, done: DataFrame, key: str, error: str | None = None) -> DataFrame:
    """Rows that are not done. With an error column, only outputs without an error count as done."""
    d = done if error is None else done.filter(F.col(error).isNull())
    return todo.join(d.select(key).distinct(), key, "left_anti")


def resume_unsolved(todo: DataFrame, outputs: DataFrame, key: str, reward: str = "reward") -> DataFrame:
    """Rows that no output, of whatever run, has solved (reward 1)."""
    return resume(todo, outputs.filter(F.col(reward) == 1), key)


def compare_status(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_status, new_status, change) for tests (keys, status) of two runs.

    change: F2P (FAILED or ERROR, then PASSED), P2P, P2F (PASSED, then anything else or gone), F2F, NEW.
    """
    both = old.select(*keys, F.col("status").alias("old_status")).join(new.select(*keys, F.col("status").alias("new_status")), keys, "full_outer")
    o, n = F.col("old_status"), F.col("new_status")
    change = F.when(o.isNull(), "NEW").when((o == "PASSED") & (n == "PASSED"), "P2P").when(o == "PASSED", "P2F").when(n == "PASSED", "F2P").otherwise("F2F")
    return both.withColumn("change", change)


def status_lists(compared: DataFrame, group: str, test: str) -> DataFrame:
    """(group, f2p, p2p): sorted lists of test names, as long as one run's tests."""
    pick = lambda c: F.sort_array(F.collect_list(F.when(F.col("change") == c, F.col(test))))
    return compared.groupBy(group).agg(pick("F2P").alias("f2p"), pick("P2P").alias("p2p"))


def run_outcome(old: Column, new: Column) -> Column:
    """struct<outcome, improved> of two status maps.

    FAIL_AT_TEST_RUN: their tests differ; NEW_COMMIT_WORSE: a passed test no longer passes, whatever else improves;
    NEW_COMMIT_BETTER: some test passes that did not; NEW_COMMIT_NOT_BETTER: none. improved: those tests' names without [parameters].
    """
    ko, kn = F.map_keys(old), F.map_keys(new)
    same = (F.size(ko) == F.size(kn)) & (F.size(F.array_except(ko, kn)) == 0)
    worse = F.exists(F.map_entries(old), lambda e: (e["value"] == "PASSED") & (F.coalesce(F.element_at(new, e["key"]), F.lit("")) != "PASSED"))
    better = F.transform(F.filter(F.map_entries(old), lambda e: (e["value"] != "PASSED") & (F.element_at(new, e["key"]) == "PASSED")), lambda e: F.regexp_replace(e["key"], r"\[.*\]$", ""))
    outcome = lambda b: F.when(~same, "FAIL_AT_TEST_RUN").when(worse, "NEW_COMMIT_WORSE").when(F.size(b) > 0, "NEW_COMMIT_BETTER").otherwise("NEW_COMMIT_NOT_BETTER")
    return let(F.array_distinct(better), lambda b: F.struct(outcome(b).alias("outcome"), F.sort_array(b).alias("improved")))


def maps_equal(expected: Column, got: Column) -> Column:
    """1 if both maps have as many entries and every non-empty key of `expected` has the same value in `got`, else 0."""
    agree = F.forall(F.map_entries(expected), lambda e: (e["key"] == "") | F.coalesce(F.element_at(got, e["key"]) == e["value"], F.lit(False)))
    return F.coalesce(((F.size(expected) == F.size(got)) & agree).cast("int"), F.lit(0))


def resolved(expected: DataFrame, status: DataFrame, group: str, test: str) -> DataFrame:
    """(group, resolved): all expected tests are PASSED."""
    return expected.join(status, [group, test], "left").groupBy(group).agg(F.bool_and(F.coalesce(F.col("status") == "PASSED", F.lit(False))).alias("resolved"))


def recall(predicted: Column, truth: Column) -> Column:
    """Share of the truth that is predicted; an empty truth is recalled."""
    hits = F.size(F.filter(truth, lambda x: F.array_contains(predicted, x)))
    return F.when(F.size(truth) > 0, hits / F.size(truth)).otherwise(F.lit(1.0))


def set_relation(predicted: Column, gold: Column) -> Column:
    """equal, subset, superset or other; subset and superset are strict."""
    more, less = F.size(F.array_except(predicted, gold)) > 0, F.size(F.array_except(gold, predicted)) > 0
    return F.when(~more & ~less, "equal").when(~more, "subset").when(~less, "superset").otherwise("other")


def reconcile(expected: Column, actual: Column) -> Column:
    """struct<missing, extra, consistent> of two arrays as sets."""
    m, e = F.array_except(expected, actual), F.array_except(actual, expected)
    return F.struct(F.sort_array(m).alias("missing"), F.sort_array(e).alias("extra"), ((F.size(m) == 0) & (F.size(e) == 0)).alias("consistent"))


def steps_of_kept(steps: DataFrame, kept_last: DataFrame, key: str) -> DataFrame:
    """The retained last steps, and the other steps of their trajectories."""
    others = steps.filter("not is_last_step").join(kept_last.select(key).distinct(), key, "left_semi")
    return kept_last.unionByName(others, allowMissingColumns=True)


def pull_request_of(message: Column) -> Column:
    """Number of the pull request that a commit message names: (#n) at a line's end, or a merge commit's."""
    n = F.coalesce(F.nullif(F.regexp_extract(message, r"\(#(\d+)\)", 1), F.lit("")), F.nullif(F.regexp_extract(message, r"(?i)merge pull request #(\d+)", 1), F.lit("")))
    return n.try_cast("long")


def closed_issues(body: Column) -> Column:
    """All issue numbers behind a closing keyword, each once, in order."""
    found = F.regexp_extract_all(body, F.lit(r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+#(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("long")))


def commit_issues(commits: DataFrame, pulls: DataFrame, issues: DataFrame) -> DataFrame:
    """(commit_hash, issue, title, body) of commits (commit_hash, message) by way of pulls (number, body) and issues (issue, title, body)."""
    named = commits.select("commit_hash", pull_request_of(F.col("message")).alias("number")).filter("number is not null").join(pulls.select("number", "body"), "number")
    return named.select("commit_hash", F.explode(closed_issues(F.col("body"))).alias("issue")).join(issues, "issue")


def dict_of_lists(df: DataFrame, group: str, row: str, ordinal: str) -> DataFrame:
    """(group, key, values): the values of each key of a map column, in the order of an ordinal."""
    pairs = df.select(group, ordinal, F.explode(row).alias("key", "value"))
    return pairs.groupBy(group, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "value"))), lambda x: x["value"]).alias("values"))


def name_lookup(df: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """Full names for short ones: an equal name first (lower case, trimmed), then the only name with that last part, else as it is.

    names: full (owner/name). Its lower-cased forms are joined; nothing is collected.
    """
    key = F.lower(F.trim(F.col(column)))
    full = names.select("full", F.lower(F.trim("full")).alias("k"))
    tails = full.groupBy(F.substring_index("k", "/", -1).alias("k")).agg(F.min("full").alias("by_tail"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    whole = full.groupBy("k").agg(F.min("full").alias("by_name"))
    out_df = df.withColumn("_k", key).join(whole.withColumnRenamed("k", "_k"), "_k", "left").join(tails.withColumnRenamed("k", "_k"), "_k", "left")
    return out_df.withColumn(out, F.coalesce("by_name", "by_tail", column)).drop("_k", "by_name", "by_tail")


def rank_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
