"""Metrics over rollouts: pass rates, group success, descriptions, classifier scores, rollups and reports.

Everything is a group-by with map-side combine; no operator brings rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.core import ratio
from trajlake.operators import selection
from trajlake.operators.order import pinned


def problem_key(row: Column) -> Column:
    """md5 of a map or struct as JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(F.from_json(F.to_json(row), "map<string,string>")))
    return F.md5(F.to_json(F.map_from_entries(entries)))


def pass_at_k(df: DataFrame, problem: str, reward: str) -> DataFrame:
    """One row: problems, samples, pass_at_1 (share of samples with a positive reward) and pass_at_k (share of problems with one)."""
    per = df.groupBy(problem).agg(F.count("*").alias("n"), F.sum(F.coalesce((F.col(reward) > 0).cast("long"), F.lit(0))).alias("c"))
    return per.agg(F.count("*").alias("problems"), F.sum("n").alias("samples"), ratio(F.sum("c"), F.sum("n")).alias("pass_at_1"), F.avg((F.col("c") > 0).cast("double")).alias("pass_at_k"))


def first_and_any_pass(df: DataFrame, problem: str, ordinal: list[str], score: str) -> DataFrame:
    """One row: pass_first (the first sample's score is positive) and pass_any, as shares of problems."""
    per = df.groupBy(problem).agg(F.min_by(F.col(score), F.struct(*ordinal)).alias("s"), F.max(score).alias("m"))
    return per.agg(F.count("*").alias("problems"), F.avg(F.coalesce(F.col("s") > 0, F.lit(False)).cast("double")).alias("pass_first"), F.avg(F.coalesce(F.col("m") > 0, F.lit(False)).cast("double")).alias("pass_any"))


def validation_by_source(df: DataFrame, source: str, uid: str, reward: str) -> DataFrame:
    """By source: mean of rewards cut to [0, 1], and the share of uids whose best reward is at least 1."""
    per = df.groupBy(source, uid).agg(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(reward)))).alias("s"), F.count(reward).alias("n"), F.max(reward).alias("m"))
    return per.groupBy(source).agg(ratio(F.sum("s"), F.sum("n")).alias("mean_reward"), F.avg((F.col("m") >= 1).cast("double")).alias("pass_at_k"), F.count("*").alias("uids"))


def solve_classes(df: DataFrame, uid: str, reward: str) -> DataFrame:
    """(uid, solve_class): none if all rewards are at most 0, all if all are at least 1, else partial."""
    per = df.groupBy(uid).agg(F.max(reward).alias("hi"), F.min(reward).alias("lo"))
    return per.select(uid, F.when(F.col("hi") <= 0, "none").when(F.col("lo") >= 1, "all").otherwise("partial").alias("solve_class"))


def solve_partition(df: DataFrame, uid: str, reward: str) -> DataFrame:
    return solve_classes(df, uid, reward).groupBy("solve_class").agg(F.count("*").alias("uids"))


def rejection_sample(df: DataFrame, uid: str, reward: str) -> DataFrame:
    """Rows of the uids that are solved in part."""
    return df.join(solve_classes(df, uid, reward).filter("solve_class = 'partial'").select(uid), uid, "left_semi")


def success_by_group(df: DataFrame, keys: list[str], reward: str) -> DataFrame:
    solved = F.sum((F.col(reward) == 1).cast("long"))
    return df.groupBy(*keys).agg(solved.alias("solved"), F.count("*").alias("total"), F.avg((F.col(reward) == 1).cast("double")).alias("success_rate"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows for each value, the most frequent first, then by value; top is the length of the report."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))
    return out.limit(top) if top else out


def describe(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), by: list[str] | None = None) -> DataFrame:
    """One row for each column (and group): n, mean, sample deviation, min, exact percentiles by linear interpolation, max.

    Nulls and NaN don't count; a column without a value has n 0 and nulls. Infinite values count as such: a percentile
    between -inf and inf is NaN. -0.0 is 0.0. Percentiles are found by rank
    (selection.values_at_ranks), so that no task holds a column's values.
    """
    by = by or []
    num = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    stats = [F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")) for c, x in num.items()]
    one = df.groupBy(*by).agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)])
    told = one.select(*by, F.inline(F.array(*[F.col(f"s{i}") for i in range(len(stats))])))
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")).cast("int")
    told = pinned(told.withColumn("_k", F.struct(*by, place.alias("_column")) if by else place))
    values = df.select(*by, F.inline(F.array(*[F.struct(F.lit(i + 1).alias("_column"), x.alias("_v")) for i, x in enumerate(num.values())]))).filter("_v is not null")
    values = values.select((F.struct(*by, "_column") if by else F.col("_column")).alias("_k"), "_v")
    at = [F.lit(p) * (F.col("n") - 1) for p in percentiles]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    few = 2 * len(percentiles) * (told.count() if by else len(columns)) <= selection.BROADCAST_RANKS
    found = selection.values_at_ranks(values, told.filter("n > 0").select("_k", F.explode(wanted).alias("_r")), few)
    found = found.join(told.select("_k", "n"), "_k")
    ends = [F.max(F.when(F.col("_r") == f(x), F.col("_v"))).alias(f"_{name}{i}") for i, x in enumerate(at) for name, f in (("a", F.floor), ("b", F.ceil))]
    found = found.groupBy("_k", "n").agg(*ends).select("_k", *[selection.between(F.col(f"_a{i}"), F.col(f"_b{i}"), x - F.floor(x)).alias(f"p{round(p * 100)}") for i, (p, x) in enumerate(zip(percentiles, at))])
    return told.join(found, "_k", "left").select(*by, "column", "n", "mean", "std", "min", *[f"p{round(p * 100)}" for p in percentiles], "max")


def classifier_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of binary classifier scores; 0/0 is 0; rows without truth or prediction don't count."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(*[F.count_if(x).cast("double").alias(k) for k, x in (("tp", t & p), ("tn", ~t & ~p), ("fp", ~t & p), ("fn", t & ~p))])
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    n, precision, recall, specificity = tp + tn + fp + fn, ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(
        *[F.col(k).cast("long").alias(k) for k in ("tp", "tn", "fp", "fn")], ratio(tp + tn, n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), ratio(tp + fn, n).alias("positive_rate"), ratio(tp + fp, n).alias("predicted_positive_rate"),
        ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fn, fn + tp).alias("false_negative_rate"),
    )


def multi_run_score(df: DataFrame, instance: str, run: str, score: str, valid: Column) -> DataFrame:
    """By instance with a valid run: mean score of valid runs, the last valid score, and run counts."""
    ok = valid & F.col(score).isNotNull()
    out = df.groupBy(instance).agg(F.avg(F.when(ok, F.col(score))).alias("avg_score"), F.max_by(F.when(ok, F.col(score)), F.when(ok, F.col(run))).alias("last_score"),
                                   F.count_if(ok).alias("valid_runs"), F.count_if(~ok).alias("bad_runs"), F.count("*").alias("total_runs"))
    return out.filter("valid_runs > 0")


def nonnegative_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean, min and max of each column over values that are neither null nor negative."""
    v = {c: F.when(F.col(c) >= 0, F.col(c).cast("double")) for c in columns}
    return df.agg(*[f(x).alias(f"{c}_{k}") for c, x in v.items() for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def rollup(df: DataFrame, keys: list[str], sums: dict[str, str], maxima: dict[str, str]) -> DataFrame:
    """Sums and maxima of columns by trajectory, with its number of steps."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxima.items()], F.count("*").alias("n_steps"))


def rate(df: DataFrame, condition: Column, name: str = "rate", scale: float = 1.0) -> DataFrame:
    """One row: the share of rows with the condition; a null condition is false."""
    return df.agg(F.count("*").alias("n"), (F.avg(F.coalesce(condition, F.lit(False)).cast("double")) * scale).alias(name))


def difficulty(scores: Column) -> Column:
    """Mean of the texts of an array that are numbers; null without one."""
    numbers = F.filter(F.transform(scores, lambda s: s.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def label_shares(df: DataFrame, label: str, known: tuple[str, ...] = ("Yes", "No")) -> DataFrame:
    """(label, n, percent); whatever isn't known is Error."""
    kind = F.when(F.col(label).isin(*known), F.col(label)).otherwise("Error").alias("label")
    counted = df.groupBy(kind).agg(F.count("*").alias("n"))  # a handful of rows
    return counted.select("label", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("percent"))


def search_hits(df: DataFrame, path: str, text: str, term: str, most: int = 100) -> DataFrame:
    """(path, lines): number of lines that hold the term, for files that have one; the `most` first by path of the report."""
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.contains(x, F.lit(term))))
    return df.select(path, lines.alias("lines")).filter("lines > 0").orderBy(path).limit(most)


def run_report(dataset: DataFrame, predictions: DataFrame, results: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, outcome) for each instance of the dataset.

    incomplete: no prediction; empty_patch: its patch is null or empty; resolved or unresolved by the result's resolved;
    error: no result. predictions: key, patch; results: key, resolved.
    """
    p = predictions.select(key, F.col("patch").alias("_patch"), F.lit(True).alias("_p"))
    r = results.select(key, F.col("resolved").alias("_resolved"))
    outcome = F.when(F.col("_p").isNull(), "incomplete").when(F.coalesce(F.col("_patch"), F.lit("")) == "", "empty_patch").when(F.col("_resolved").isNull(), "error").when(F.col("_resolved"), "resolved").otherwise("unresolved")
    return dataset.select(key).join(p, key, "left").join(r, key, "left").select(key, outcome.alias("outcome"))


def report_counts(report: DataFrame) -> DataFrame:
    """(outcome, n): the sizes of the report's lists; the lists themselves stay distributed in the report."""
    return report.groupBy("outcome").agg(F.count("*").alias("n"))


def success_matrix(df: DataFrame, problem: str, agent: str, reward: str, agents: list) -> DataFrame:
    """A row for each problem and a column for each agent: has any rollout succeeded? Null where there is none."""
    return df.groupBy(problem).pivot(agent, agents).agg(F.bool_or(F.col(reward) == 1))


def tests_passed(results: Column) -> Column:
    """struct<passed, all_passed> of an array of booleans; no result: not all passed."""
    got = F.coalesce(results, F.array().cast("array<boolean>"))
    return F.struct(F.size(F.filter(got, lambda x: x)).alias("passed"), ((F.size(got) > 0) & F.forall(got, lambda x: F.coalesce(x, F.lit(False)))).alias("all_passed"))


def elo(contests: DataFrame, contestants: DataFrame, problems: DataFrame, submissions: DataFrame, ratings: DataFrame, least: int = 200, pass_n: int | None = None) -> DataFrame:
    """(contest_id, score, penalty, rank, rating, percentile) of a solver in each contest with over `least` rated contestants.

    contests: contest_id. contestants: contest_id, handle, place, points, penalty, old_rating. problems: contest_id, index,
    points (null: counts 1, and 10 penalty points for each earlier try). submissions: problem_id ("<contest><index>"),
    passed array<boolean>, in order. ratings: rating, of everyone. rank: contestants that stand, by place and then handle, before the
    first with fewer points than the solver, or as many and a greater penalty; without one all of them. rating: the greatest
    whole number from 0 at which the expected seed is still not less than the rank, found by halving.

    Contestants are added up to a histogram of whole ratings for each contest, on which all searches run side by side
    as Columns; a task holds one contest's distinct ratings, however many contestants it has. The percentile's window is over
    as many rows as there are distinct ratings and contests.
    """
    tries = submissions.select(F.regexp_extract("problem_id", r"^(\d+)", 1).cast("long").alias("contest_id"), "problem_id", (F.slice("passed", 1, pass_n) if pass_n else F.col("passed")).alias("passed"))
    solved = problems.withColumn("problem_id", F.concat(F.col("contest_id").cast("string"), "index")).join(tries, ["contest_id", "problem_id"])
    at = F.array_position("passed", True) - 1
    hit = F.col("at") >= 0
    solved = solved.withColumn("at", at).groupBy("contest_id").agg(
        F.sum(F.when(hit, F.when(F.col("points").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("points") - 50.0 * F.col("at")))).otherwise(0.0)).alias("score"),
        F.sum(F.when(hit & F.col("points").isNull(), 10.0 * F.col("at")).otherwise(0.0)).alias("own_penalty"))
    solved = solved.join(contests.select("contest_id").distinct(), "contest_id", "left_semi")
    rows = contestants.filter("old_rating is not null").join(solved, "contest_id")
    stands = F.struct("place", "handle")
    below = (F.col("points") < F.col("score")) | ((F.col("points") == F.col("score")) & (F.col("penalty") > F.col("own_penalty")))
    first = rows.groupBy("contest_id", "score", "own_penalty").agg(F.count("*").alias("n"), F.max("old_rating").alias("top"), F.min(F.when(below, stands)).alias("first")).filter(F.col("n") > least)
    before = contestants.filter("old_rating is not null").select("contest_id", stands.alias("stands"), "old_rating").join(first.select("contest_id", "first"), "contest_id")
    counted = before.groupBy("contest_id", F.col("old_rating").cast("double").alias("r")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("first").isNull() | (F.col("stands") < F.col("first"))).alias("ahead"))
    histogram = counted.groupBy("contest_id").agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("h"), F.sum("ahead").alias("rank"))

    def halved(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        mid = F.floor((lo + hi) / 2)
        seed = F.aggregate("h", F.lit(1.0), lambda s, x: s + x["n"] / (1 + F.pow(F.lit(10.0), (mid - x["r"]) / 400)))
        low = seed < F.col("rank")
        return F.when(hi - lo > 1, F.struct(F.when(low, lo).otherwise(mid).alias("lo"), F.when(low, mid).otherwise(hi).alias("hi"))).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("lo"), (F.floor("top") + 100).cast("long").alias("hi"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(F.floor("top") + 100, F.lit(2)))).cast("int") + 1)
    found = first.join(histogram, "contest_id").withColumn("rating", F.aggregate(rounds, start, halved)["lo"])
    found = found.select("contest_id", "score", F.col("own_penalty").alias("penalty"), "rank", "rating")
    # ratings are whole numbers in a narrow range: their counts and the contests, a row each, are added up in one order
    known = ratings.groupBy("rating").agg(F.count("*").alias("n")).select("rating", "n", F.lit(None).cast("long").alias("contest_id"))
    line = known.unionByName(found.select("rating", F.lit(0).cast("long").alias("n"), "contest_id"))
    everyone = Window.partitionBy(F.lit(1))
    lower = F.sum("n").over(everyone.orderBy("rating").rangeBetween(Window.unboundedPreceding, -1))
    share = line.select("contest_id", F.round(100.0 * F.coalesce(lower, F.lit(0)) / F.sum("n").over(everyone), 1).alias("percentile")).filter("contest_id is not null")
    return found.join(share, "contest_id").select("contest_id", "score", "penalty", "rank", "rating", "percentile")


def garbled_ratio(df: DataFrame, file: str, text: str) -> DataFrame:
    """(file, seen, garbled, ratio): malformed rows (null text) count as garbled."""
    from trajlake.functions.garbled import is_garbled

    g = F.when(F.col(text).isNull(), True).otherwise(is_garbled(F.col(text)))
    out = df.select(file, g.cast("long").alias("g")).groupBy(file).agg(F.count("*").alias("seen"), F.sum("g").alias("garbled"))
    return out.withColumn("ratio", F.col("garbled") / F.greatest(F.lit(1), F.col("seen")))
