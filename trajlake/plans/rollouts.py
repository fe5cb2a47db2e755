"""Rollout queries: orders are rollouts of tasks (customers), lineitems their steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.operators import metrics, rank, returns
from trajlake.operators.order import drop_to_multiple, global_index, page, round_robin_shards, row_slice
from trajlake.plans.registry import Tables, query, rounded

# What the tables stand for, in SQL and as a DataFrame.
ROLLOUTS = """r AS (SELECT o_orderkey AS rollout, o_custkey AS task, CAST(o_orderstatus = 'F' AS INT) AS reward,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS score,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'agent' ELSE o_orderpriority END AS exit_reason FROM orders)"""
STEPS = """s AS (SELECT l_orderkey AS rollout, l_linenumber AS step, l_partkey, l_suppkey, l_quantity AS tokens, l_extendedprice AS seconds,
  l_discount AS reward, l_returnflag AS flag FROM lineitem)"""
STEP_ORDER = ["step", "l_partkey", "l_suppkey", "seconds", "tokens", "reward"]


def rollouts(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("rollout"), F.col("o_custkey").alias("task"), (F.col("o_orderstatus") == "F").cast("int").alias("reward"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"), F.when(F.col("o_orderpriority") == "1-URGENT", "agent").otherwise(F.col("o_orderpriority")).alias("exit_reason"))


def steps(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("rollout"), F.col("l_linenumber").alias("step"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("seconds"), F.col("l_discount").alias("reward"), F.col("l_returnflag").alias("flag"))


def sources(t: Tables) -> DataFrame:
    """Rollouts with their data source, a nation."""
    who = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("task"), F.col("n_name").alias("source"))
    return rollouts(t).join(who, "task")


SOURCES = ROLLOUTS + ", w AS (SELECT r.*, n_name AS source FROM r JOIN customer ON c_custkey = task JOIN nation ON c_nationkey = n_nationkey)"


@query("tts_select", f"""WITH {ROLLOUTS}, f AS (SELECT *, max(score) OVER p AS best, count(*) OVER p AS n_candidates,
  sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) OVER p AS k FROM r WINDOW p AS (PARTITION BY task)),
g AS (SELECT *, sum(CASE WHEN score = best THEN 1 ELSE 0 END) OVER (PARTITION BY task) AS ties,
  row_number() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST, rollout) AS rn FROM f)
SELECT task, rollout, score, reward, n_candidates, CAST(ties AS BIGINT) AS n_ties, CAST(k AS BIGINT) AS k_effective,
  CASE WHEN best IS NULL THEN 'fallback_no_avg' WHEN ties > 1 THEN 'tie_random' ELSE 'max_avg' END AS reason FROM g WHERE rn = 1""")
def tts_select(t):
    return rank.tts_select(rollouts(t).withColumn("valid", (F.col("score") > 0).cast("int")), "task", "score", "valid", ["rollout"], "reward")


@query("tts_summary", f"""WITH {ROLLOUTS}, f AS (SELECT *, max(score) OVER p AS best, sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) OVER p AS k FROM r WINDOW p AS (PARTITION BY task)),
g AS (SELECT *, sum(CASE WHEN score = best THEN 1 ELSE 0 END) OVER (PARTITION BY task) AS ties, row_number() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST, rollout) AS rn FROM f)
SELECT count(*) AS instances, CAST(sum(reward) AS BIGINT) AS solved, round(avg(reward), 6) AS ratio, round(avg(k), 6) AS avg_k, CAST(min(k) AS BIGINT) AS min_k, CAST(max(k) AS BIGINT) AS max_k,
  CAST(count_if(best IS NOT NULL AND ties > 1) AS BIGINT) AS ties, CAST(count_if(best IS NULL) AS BIGINT) AS no_score FROM g WHERE rn = 1""")
def tts_summary(t):
    return rounded(rank.tts_summary(tts_select(t), "reward"))


@query("pass_at_k", f"""WITH {ROLLOUTS}, p AS (SELECT task, count(*) AS n, sum(CAST(reward > 0 AS INT)) AS c FROM r GROUP BY task)
SELECT count(*) AS problems, CAST(sum(n) AS BIGINT) AS samples, round(sum(c) / sum(n), 6) AS pass_at_1, round(avg(CAST(c > 0 AS DOUBLE)), 6) AS pass_at_k FROM p""")
def pass_at_k(t):
    return rounded(metrics.pass_at_k(rollouts(t), "task", "reward"))


@query("pass_first_and_any", f"""WITH {ROLLOUTS}, p AS (SELECT task, arg_min(reward, rollout) AS f, max(reward) AS m FROM r GROUP BY task)
SELECT count(*) AS problems, round(avg(CAST(f > 0 AS DOUBLE)), 6) AS pass_first, round(avg(CAST(m > 0 AS DOUBLE)), 6) AS pass_any FROM p""")
def pass_first_and_any(t):
    return rounded(metrics.first_and_any_pass(rollouts(t), "task", ["rollout"], "reward"))


@query("pass_by_source", f"""WITH {SOURCES}, x AS (SELECT source, task, reward * 1.5 - 0.25 AS v FROM w),
p AS (SELECT source, task, sum(greatest(0.0, least(1.0, v))) AS s, count(v) AS n, max(v) AS m FROM x GROUP BY ALL)
SELECT source, round(CAST(sum(s) / sum(n) AS DOUBLE), 6) AS mean_reward, round(avg(CAST(m >= 1 AS DOUBLE)), 6) AS pass_at_k, count(*) AS uids FROM p GROUP BY source""")
def pass_by_source(t):
    return rounded(metrics.validation_by_source(sources(t).withColumn("v", F.col("reward") * 1.5 - 0.25), "source", "task", "v"))


@query("solve_partition", f"""WITH {ROLLOUTS}, p AS (SELECT task, max(reward) AS hi, min(reward) AS lo FROM r GROUP BY task)
SELECT CASE WHEN hi <= 0 THEN 'none' WHEN lo >= 1 THEN 'all' ELSE 'partial' END AS solve_class, count(*) AS uids FROM p GROUP BY 1""")
def solve_partition(t):
    return metrics.solve_partition(rollouts(t), "task", "reward")


@query("rejection_sample", f"""WITH {ROLLOUTS} SELECT * FROM r WHERE task IN (SELECT task FROM r GROUP BY task HAVING max(reward) > 0 AND min(reward) < 1)""")
def rejection_sample(t):
    return metrics.rejection_sample(rollouts(t), "task", "reward")


@query("success_by_group", f"""WITH {SOURCES} SELECT source, CAST(sum(CAST(reward = 1 AS INT)) AS BIGINT) AS solved, count(*) AS total, round(avg(CAST(reward = 1 AS DOUBLE)), 6) AS success_rate FROM w GROUP BY source""")
def success_by_group(t):
    return rounded(metrics.success_by_group(sources(t), ["source"], "reward"))


@query("exit_reason_counts", f"WITH {ROLLOUTS} SELECT exit_reason, count(*) AS n FROM r GROUP BY 1")
def exit_reason_counts(t):
    return metrics.value_counts(rollouts(t), "exit_reason")


@query("top_parts", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 5")
def top_parts(t):
    return metrics.value_counts(t.lineitem.select("l_partkey"), "l_partkey", top=5)


QUANT = ", ".join(f"quantile_cont({{c}}, {p}) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.99))
ROUND_Q = ", ".join(f"round(p{p}, 6) AS p{p}" for p in (25, 50, 75, 90, 99))


def _describe_sql(columns: dict[str, str], source: str, by: str = "") -> str:
    parts = [f"SELECT {by + ',' if by else ''} '{n}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, {QUANT.format(c=c)}, CAST(max({c}) AS DOUBLE) AS max FROM {source} {'GROUP BY ' + by if by else ''}" for n, c in columns.items()]
    return f"SELECT {by + ',' if by else ''} \"column\", n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, {ROUND_Q}, round(max, 6) AS max FROM ({' UNION ALL '.join(parts)})"


PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.99)


@query("step_describe", _describe_sql({"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount"}, "lineitem"))
def step_describe(t):
    return rounded(metrics.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], PERCENTILES))


@query("describe_by_kind", _describe_sql({"l_quantity": "l_quantity"}, "lineitem", by="l_returnflag"))
def describe_by_kind(t):
    return rounded(metrics.describe(t.lineitem, ["l_quantity"], PERCENTILES, by=["l_returnflag"]))


@query("token_usage_describe", f"""WITH {STEPS}, u AS (SELECT rollout, sum(tokens) AS sum_tokens, max(tokens) AS max_tokens FROM s GROUP BY rollout)
{_describe_sql({"sum_tokens": "sum_tokens", "max_tokens": "max_tokens"}, "u")}""")
def token_usage_describe(t):
    per = steps(t).groupBy("rollout").agg(F.sum("tokens").alias("sum_tokens"), F.max("tokens").alias("max_tokens"))
    return rounded(metrics.describe(per, ["sum_tokens", "max_tokens"], PERCENTILES))


@query("rollout_rollup", f"""WITH {STEPS} SELECT rollout, round(sum(tokens), 4) AS total_tokens, round(sum(seconds), 4) AS total_seconds, max(seconds) AS max_seconds, count(*) AS n_steps FROM s GROUP BY rollout""")
def rollout_rollup(t):
    return rounded(metrics.rollup(steps(t), ["rollout"], {"total_tokens": "tokens", "total_seconds": "seconds"}, {"max_seconds": "seconds"}), 4)


@query("nonnegative_stats", """WITH x AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer)
SELECT round(avg(v), 6) AS c_acctbal_mean, min(v) AS c_acctbal_min, max(v) AS c_acctbal_max FROM x""")
def nonnegative_stats(t):
    return rounded(metrics.nonnegative_stats(t.customer, ["c_acctbal"]))


@query("reward_sum", f"WITH {STEPS} SELECT rollout, round(sum(reward), 6) AS reward, count(*) AS n_steps FROM s GROUP BY rollout")
def reward_sum(t):
    return rounded(metrics.rollup(steps(t), ["rollout"], {"reward": "reward"}, {}))


@query("classifier_metrics", """WITH c AS (SELECT count_if(quality = 1 AND toxic = 1)::DOUBLE AS tp, count_if(quality = 0 AND toxic = 0)::DOUBLE AS tn,
  count_if(quality = 0 AND toxic = 1)::DOUBLE AS fp, count_if(quality = 1 AND toxic = 0)::DOUBLE AS fn FROM labels),
m AS (SELECT *, tp + tn + fp + fn AS n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS sp FROM c)
SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round((tp + tn) / n, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(sp, 6) AS specificity, round((r + sp) / 2, 6) AS balanced_accuracy,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc,
  round((tp + fn) / n, 6) AS positive_rate, round((tp + fp) / n, 6) AS predicted_positive_rate, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS false_positive_rate,
  round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS false_negative_rate FROM m""")
def classifier_metrics(t):
    return rounded(metrics.classifier_metrics(t.labels, "quality", "toxic"))


@query("multi_run_score", f"""WITH {ROLLOUTS} SELECT task, round(avg(score), 6) AS avg_score, arg_max(score, rollout) FILTER (WHERE score IS NOT NULL) AS last_score, count(score) AS valid_runs,
  count(*) - count(score) AS bad_runs, count(*) AS total_runs FROM r GROUP BY task HAVING count(score) > 0""")
def multi_run_score(t):
    return rounded(metrics.multi_run_score(rollouts(t), "task", "rollout", "score", F.lit(True)))


@query("rm_accuracy", f"""WITH {ROLLOUTS} SELECT count(*) AS n, round(avg(CAST(coalesce((coalesce(score, 0) / 400000 > 0.5) = (reward = 1), false) AS DOUBLE)), 6) AS accuracy FROM r""")
def rm_accuracy(t):
    return rounded(metrics.rate(rollouts(t), (F.coalesce("score", F.lit(0)) / 400000 > 0.5) == (F.col("reward") == 1), "accuracy"))


@query("bad_path_rate", "SELECT count(*) AS n, round(avg(CAST(l_returnflag = 'A' AS DOUBLE)) * 100, 6) AS percent FROM lineitem")
def bad_path_rate(t):
    return rounded(metrics.rate(t.lineitem, F.col("l_returnflag") == "A", "percent", 100.0))


@query("label_shares", """WITH l AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'Error' END AS label FROM orders)
SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM l), 6) AS percent FROM l GROUP BY label""")
def label_shares(t):
    lab = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No").otherwise("?")
    return rounded(metrics.label_shares(t.orders.select(lab.alias("label")), "label"))


@query("distinct_keys", "SELECT count(DISTINCT o_custkey) AS tasks, count(DISTINCT o_orderpriority) AS reasons FROM orders")
def distinct_keys(t):
    return t.orders.agg(F.countDistinct("o_custkey").alias("tasks"), F.countDistinct("o_orderpriority").alias("reasons"))


@query("success_matrix", f"""WITH {ROLLOUTS} SELECT task, bool_or(reward = 1) FILTER (WHERE exit_reason = 'agent') AS agent, bool_or(reward = 1) FILTER (WHERE exit_reason = '2-HIGH') AS "2-HIGH",
  bool_or(reward = 1) FILTER (WHERE exit_reason = '5-LOW') AS "5-LOW" FROM r GROUP BY task""")
def success_matrix(t):
    return metrics.success_matrix(rollouts(t), "task", "exit_reason", "reward", ["agent", "2-HIGH", "5-LOW"])


@query("run_report", """SELECT o_custkey AS instance_id, CASE WHEN p.c_custkey IS NULL THEN 'incomplete' WHEN p.patch = '' THEN 'empty_patch' WHEN q.resolved IS NULL THEN 'error' WHEN q.resolved THEN 'resolved' ELSE 'unresolved' END AS outcome
FROM (SELECT DISTINCT o_custkey FROM orders) d
LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS patch FROM customer WHERE c_nationkey < 20) p ON c_custkey = o_custkey
LEFT JOIN (SELECT doc_id, quality = 1 AS resolved FROM labels) q ON doc_id = o_custkey""")
def run_report(t):
    key = "instance_id"
    predictions = t.customer.filter("c_nationkey < 20").select(F.col("c_custkey").alias(key), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("patch"))
    results = t.labels.select(F.col("doc_id").alias(key), (F.col("quality") == 1).alias("resolved"))
    return metrics.run_report(t.orders.select(F.col("o_custkey").alias(key)).distinct(), predictions, results)


@query("run_report_counts", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p.c_custkey IS NULL THEN 'incomplete' WHEN p.patch = '' THEN 'empty_patch' WHEN q.resolved IS NULL THEN 'error' WHEN q.resolved THEN 'resolved' ELSE 'unresolved' END AS outcome
FROM (SELECT DISTINCT o_custkey FROM orders) d
LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS patch FROM customer WHERE c_nationkey < 20) p ON c_custkey = o_custkey
LEFT JOIN (SELECT doc_id, quality = 1 AS resolved FROM labels) q ON doc_id = o_custkey) GROUP BY outcome""")
def run_report_counts(t):
    return metrics.report_counts(run_report(t))


@query("tests_passed", """WITH g AS (SELECT o_custkey, list(o_orderstatus = 'F' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)
SELECT o_custkey AS task, CAST(len(list_filter(v, lambda x: x)) AS INT) AS passed, len(v) > 0 AND list_bool_and(v) AS all_passed FROM g""")
def tests_passed(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("task")).agg(F.collect_list(F.col("o_orderstatus") == "F").alias("v"))
    return g.select("task", metrics.tests_passed(F.col("v")).alias("r")).select("task", "r.*")


@query("difficulty_mean", """WITH g AS (SELECT o_custkey, list(CASE WHEN o_orderpriority = '1-URGENT' THEN 'error' WHEN o_orderpriority = '2-HIGH' THEN 'x' ELSE left(o_orderpriority, 1) END) AS v FROM orders GROUP BY 1)
SELECT o_custkey AS task, round(list_avg(list_transform(v, lambda x: TRY_CAST(x AS DOUBLE))), 6) AS difficulty FROM g""")
def difficulty_mean(t):
    v = F.when(F.col("o_orderpriority") == "1-URGENT", "error").when(F.col("o_orderpriority") == "2-HIGH", "x").otherwise(F.substring("o_orderpriority", 1, 1))
    return t.orders.groupBy(F.col("o_custkey").alias("task")).agg(F.collect_list(v).alias("v")).select("task", F.round(metrics.difficulty(F.col("v")), 6).alias("difficulty"))


def _best(kind: str, column: str, largest: bool) -> None:
    @query(f"best_by_{kind}", f"""WITH {ROLLOUTS}, {STEPS}, x AS (SELECT r.*, coalesce(n_steps, 0) AS n_steps, coalesce(size, 0) AS size FROM r LEFT JOIN (SELECT rollout, count(*) AS n_steps, count_if(flag = 'A') AS size FROM s GROUP BY 1) USING (rollout))
SELECT task, rollout, score, n_steps, size, reward FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {column} {'DESC' if largest else 'ASC'} NULLS LAST, rollout) AS rn FROM x) WHERE rn = 1""")
    def run(t):
        return rank.best_by(verified(t), "task", column, "rollout", largest).select("task", "rollout", "score", "n_steps", "size", "reward")


def verified(t: Tables) -> DataFrame:
    per = steps(t).groupBy("rollout").agg(F.count("*").alias("n_steps"), F.count_if(F.col("flag") == "A").alias("size"))
    return rollouts(t).join(per, "rollout", "left").fillna(0, ["n_steps", "size"])


for _kind, _column, _largest in (("score", "score", True), ("fewest_steps", "n_steps", False), ("most_steps", "n_steps", True), ("smallest_patch", "size", False)):
    _best(_kind, _column, _largest)

VERIFIED = f"{ROLLOUTS}, {STEPS}, x AS (SELECT r.*, coalesce(n_steps, 0) AS n_steps, coalesce(size, 0) AS size FROM r LEFT JOIN (SELECT rollout, count(*) AS n_steps, count_if(flag = 'A') AS size FROM s GROUP BY 1) USING (rollout))"


@query("topk_then_max", f"""WITH {VERIFIED}, k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST, rollout) AS k FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY size DESC NULLS LAST, rollout) AS rn FROM k WHERE k <= 3) SELECT task, rollout, size, reward FROM b WHERE rn = 1""")
def topk_then_max(t):
    return rank.topk_then_max(verified(t), "task", "score", 3, "size", "rollout").select("task", "rollout", "size", "reward")


@query("topk_then_max_share", f"""WITH {VERIFIED}, k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST, rollout) AS k FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY size DESC NULLS LAST, rollout) AS rn FROM k WHERE k <= 3)
SELECT CAST(sum(CAST(reward = 1 AS INT)) AS BIGINT) AS correct, round(sum(CAST(reward = 1 AS INT)) / 500, 6) AS share FROM b WHERE rn = 1""")
def topk_then_max_share(t):
    return rounded(rank.correct_share(topk_then_max(t), "reward", 500))


@query("topk_ties_then_max", f"""WITH {VERIFIED}, k AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY size DESC NULLS LAST) AS k FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST, rollout) AS rn FROM k WHERE k <= 2) SELECT task, rollout, score, reward FROM b WHERE rn = 1""")
def topk_ties_then_max(t):
    return rank.topk_ties_then_max(verified(t), "task", "size", 2, "score", "rollout").select("task", "rollout", "score", "reward")


@query("topk_ties_prefer_agent", f"""WITH {VERIFIED}, y AS (SELECT *, max(CAST(exit_reason = 'agent' AS INT)) OVER (PARTITION BY task) AS a FROM x),
k AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY size DESC NULLS LAST) AS k FROM y WHERE a = 0 OR exit_reason = 'agent'),
b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST, rollout) AS rn FROM k WHERE k <= 2) SELECT task, rollout, score, reward FROM b WHERE rn = 1""")
def topk_ties_prefer_agent(t):
    return rank.topk_ties_then_max(verified(t), "task", "size", 2, "score", "rollout", F.col("exit_reason") == "agent").select("task", "rollout", "score", "reward")


@query("scaled_steps", f"""WITH {VERIFIED}, y AS (SELECT task, rollout, n_steps, min(n_steps) OVER (PARTITION BY task) AS lo, max(n_steps) OVER (PARTITION BY task) AS hi FROM x)
SELECT task, rollout, round(CASE WHEN hi > lo THEN (n_steps - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM y""")
def scaled_steps(t):
    return rounded(rank.min_max_scaled(verified(t), "task", "n_steps", "scaled").select("task", "rollout", "scaled"))


@query("mixed_pairs", f"""WITH {ROLLOUTS}, b AS (SELECT *, min(reward) OVER (PARTITION BY task) AS lo, max(reward) OVER (PARTITION BY task) AS hi FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY task, reward ORDER BY rollout) AS rn FROM b WHERE lo = 0 AND hi = 1) SELECT task, rollout, reward FROM c WHERE rn = 1""")
def mixed_pairs(t):
    return rank.mixed_pairs(rollouts(t), "task", "reward", [F.asc("rollout")]).select("task", "rollout", "reward")


@query("priority_pairs", f"""WITH {ROLLOUTS}, b AS (SELECT *, min(reward) OVER (PARTITION BY task) AS lo, max(reward) OVER (PARTITION BY task) AS hi FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY task, reward ORDER BY exit_reason <> 'agent', exit_reason, rollout) AS rn FROM b WHERE lo = 0 AND hi = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY exit_reason <> 'agent', exit_reason, rollout) AS rn FROM b WHERE lo = hi),
e AS (SELECT *, row_number() OVER (PARTITION BY reward ORDER BY rollout) AS k FROM d WHERE rn = 1)
SELECT task, rollout, reward FROM c WHERE rn = 1 UNION ALL SELECT task, rollout, reward FROM e WHERE k <= 500""")
def priority_pairs(t):
    return rank.priority_pairs(rollouts(t), "task", "reward", "exit_reason", "rollout").select("task", "rollout", "reward")


@query("running_success", f"""WITH {ROLLOUTS} SELECT rollout, count(*) OVER w AS n_so_far, CAST(sum(reward) OVER w AS BIGINT) AS solved_so_far, round(avg(reward) OVER w, 6) AS rate_so_far FROM r
WINDOW w AS (ORDER BY rollout ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_success(t):
    return rounded(rank.running(rollouts(t).select("rollout", "reward"), "reward", ["rollout"]).select("rollout", "n_so_far", "solved_so_far", "rate_so_far"))


@query("success_by_steps", f"""WITH {VERIFIED} SELECT rollout, n_steps, count(*) OVER w AS n_so_far, CAST(sum(reward) OVER w AS BIGINT) AS solved_so_far, round(avg(reward) OVER w, 6) AS rate_so_far FROM x
WINDOW w AS (ORDER BY n_steps, rollout ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def success_by_steps(t):
    return rounded(rank.running(verified(t).select("rollout", "n_steps", "reward"), "reward", ["n_steps", "rollout"]).select("rollout", "n_steps", "n_so_far", "solved_so_far", "rate_so_far"))


ORDERED = f"{STEPS}, o AS (SELECT *, row_number() OVER (PARTITION BY rollout ORDER BY {', '.join(STEP_ORDER)}) - 1 AS i FROM s)"


@query("mc_return", f"""WITH {ORDERED} SELECT a.rollout, CAST(a.i AS INT) AS step, round(sum(b.reward * pow(0.2, b.i - a.i)), 6) AS mc_return FROM o a JOIN o b ON a.rollout = b.rollout AND b.i >= a.i GROUP BY a.rollout, a.i""")
def mc_return(t):
    return rounded(returns.mc_return_rows(steps(t), "rollout", STEP_ORDER[:-1], "reward", 0.2))


@query("group_advantage", f"""WITH {ROLLOUTS} SELECT rollout, task, round((reward - avg(reward) OVER p) / (coalesce(stddev_samp(reward) OVER p, 0) + 1e-6), 4) AS advantage FROM r WINDOW p AS (PARTITION BY task)""")
def group_advantage(t):
    return rounded(rank.group_advantage(rollouts(t), "task", "reward").select("rollout", "task", "advantage"), 4)


@query("leave_one_out_advantage", f"""WITH {ROLLOUTS} SELECT rollout, task, round(CASE WHEN count(*) OVER p > 1 THEN reward - (sum(reward) OVER p - reward) / (count(*) OVER p - 1) ELSE reward END, 6) AS advantage FROM r WINDOW p AS (PARTITION BY task)""")
def leave_one_out(t):
    return rounded(rank.leave_one_out_advantage(rollouts(t).withColumn("reward", F.col("reward").cast("double")), "task", "reward").select("rollout", "task", "advantage"))


@query("advantage_broadcast", f"""WITH {ORDERED}, l AS (SELECT *, count(*) OVER (PARTITION BY rollout) AS n, last_value(reward) OVER (PARTITION BY rollout ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM o)
SELECT rollout, step, l_partkey, l_suppkey, round(v / n, 6) AS last_reward FROM l""")
def advantage_broadcast(t):
    return rounded(rank.broadcast_last(steps(t), "rollout", STEP_ORDER, "reward", "last_reward", per_step=True).select("rollout", "step", "l_partkey", "l_suppkey", "last_reward"))


@query("last_steps", f"""WITH {ORDERED} SELECT rollout, step, l_partkey, l_suppkey, i + 1 = count(*) OVER (PARTITION BY rollout) AS is_last_step, count(*) OVER (PARTITION BY rollout) AS n_steps FROM o""")
def last_steps(t):
    return rank.last_step_flags(steps(t), "rollout", STEP_ORDER).select("rollout", "step", "l_partkey", "l_suppkey", "is_last_step", "n_steps")


@query("step_group_advantage", f"""WITH {STEPS}, g AS (SELECT rollout % 100 AS uid, step, reward, rollout, l_partkey, l_suppkey FROM s) SELECT rollout, step, l_partkey, l_suppkey, round(reward - avg(reward) OVER (PARTITION BY uid, step), 6) AS advantage FROM g""")
def step_group_advantage(t):
    df = steps(t).withColumn("uid_step", F.concat_ws("_step", F.col("rollout") % 100, "step"))
    return rounded(rank.group_advantage(df, "uid_step", "reward", scale=False).select("rollout", "step", "l_partkey", "l_suppkey", "advantage"))


@query("longest_view_run", """WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM events),
g AS (SELECT user_id, event_type, i - j AS g, count(*) AS n FROM o GROUP BY ALL) SELECT user_id, max(n) AS longest_run FROM g GROUP BY user_id""")
def longest_view_run(t):
    return rank.longest_run(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("round_robin_shards", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INT) AS shard FROM orders")
def shards(t):
    return round_robin_shards(t.orders.select("o_orderkey"), ["o_orderkey"], 7).select("o_orderkey", "shard")


@query("row_slice", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders QUALIFY row_index >= 100 AND row_index < 350")
def slice_rows(t):
    return row_slice(t.orders.select("o_orderkey"), ["o_orderkey"], 100, 350)


@query("drop_to_multiple", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) WHERE i <= n - n % 64")
def multiple(t):
    return drop_to_multiple(t.orders.select("o_orderkey"), ["o_orderkey"], 64)


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged(t):
    return page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query("batch_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_index FROM orders")
def batch_order(t):
    return global_index(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "row_index")


# Orders as results of contests: a customer's remainder is the contest, an order a contestant, the price its points.
CONTESTANT = {"contest_id": "o_custkey % 40", "handle": "o_orderkey", "points": "CAST(floor(o_totalprice / 1000) AS DOUBLE)", "penalty": "CAST(o_orderkey % 7 AS DOUBLE)", "old_rating": "CASE WHEN o_orderpriority <> '5-LOW' THEN 700 + (o_custkey * 37 + o_orderkey * 11) % 2300 END"}
OWN = {"A": (100.0, 2), "B": (None, 1), "C": (80.0, 0), "D": (500.0, None)}  # points and the first passing try, if any


def _contest_sql() -> str:
    columns = ", ".join(f"{v} AS {k}" for k, v in CONTESTANT.items())
    score = sum(0 if at is None else 1.0 if points is None else max(0.0, points - 50.0 * at) for points, at in OWN.values())
    penalty = sum(10.0 * at for points, at in OWN.values() if points is None and at is not None)
    return f"""WITH a AS (SELECT {columns} FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY points DESC, penalty, handle) AS place FROM a), r AS (SELECT * FROM c WHERE old_rating IS NOT NULL),
w AS (SELECT contest_id, count(*) AS n, max(old_rating) AS top, min(place) FILTER (WHERE points < {score} OR (points = {score} AND penalty > {penalty})) AS first FROM r GROUP BY 1 HAVING count(*) > 20),
k AS (SELECT contest_id, first(top) AS top, count_if(first IS NULL OR place < first) AS rank FROM r JOIN w USING (contest_id) GROUP BY 1),
h AS (SELECT contest_id, old_rating AS x, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT contest_id, rank, unnest(range(1, top + 100)) AS m FROM k),
s AS (SELECT contest_id, m.m, rank, 1 + sum(n / (1 + pow(10, (m.m - x) / 400))) AS seed FROM m JOIN h USING (contest_id) GROUP BY ALL),
f AS (SELECT contest_id, any_value(rank) AS rank, coalesce(max(m) FILTER (WHERE seed >= rank), 0) AS rating FROM s GROUP BY 1)
SELECT contest_id, {score}::DOUBLE AS score, {penalty}::DOUBLE AS penalty, CAST(rank AS BIGINT) AS rank, rating, round(100.0 * (SELECT count(*) FROM r WHERE old_rating < rating) / (SELECT count(*) FROM r), 1) AS percentile FROM f"""


@query("contest_ratings", _contest_sql())
def contest_ratings(t):
    from pyspark.sql import Window

    rows = t.orders.select(*[F.expr(v).alias(k) for k, v in CONTESTANT.items()])
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("contest_id").orderBy(F.desc("points"), "penalty", "handle")))
    contests = rows.select("contest_id").distinct()
    tried = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(p).cast("double").alias("points"), F.array(*[F.lit(at is not None and k >= at) for k in range(4)]).alias("passed")) for i, (p, at) in OWN.items()])
    problems = contests.select("contest_id", F.inline(tried))
    submissions = problems.select(F.concat(F.col("contest_id").cast("string"), "index").alias("problem_id"), "passed")
    ratings = rows.filter("old_rating is not null").select(F.col("old_rating").cast("long").alias("rating"))
    return metrics.elo(contests, rows, problems.drop("passed"), submissions, ratings, least=20)
