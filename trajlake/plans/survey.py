"""Queries for single rules over whole tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import chat, text
from trajlake.operators import commits, filters, joins, order, rank, shape
from trajlake.plans.registry import Tables, query, rounded
from trajlake.plans.texts import nested

NL = "chr(10)"


def _case(column: str, values: list[str], n: int | None = None) -> str:
    return f"CASE {column} % {n or len(values)} " + " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values)) + " END"


def _text(v: str) -> str:
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\x1b", "' || chr(27) || '") + "'"


def pick(column: str, values: list[str]):
    """One of the values by the column's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


# ---- filters ----


@query("language_filter", "SELECT doc_id FROM documents WHERE CASE lower(upper(lang)) WHEN 'de' THEN 'german' ELSE lower(lang) END IN ('german', 'fr')")
def language_filter(t):
    return t.documents.filter(filters.language_in(F.upper("lang"), ["German", "FR"], {"de": "german"})).select("doc_id")


@query("source_rows", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src7')")
def source_rows(t):
    return t.documents.filter(filters.from_sources(F.col("source"), ["src1", "src7"])).select("doc_id")


@query("context_rows", "SELECT event_id FROM events WHERE event_type = 'view'")
def context_rows(t):
    return t.events.filter(filters.context_type(F.col("event_type"), "view")).select("event_id")


@query("fits_context", "SELECT doc_id FROM documents WHERE length(text) > 0 AND length(text) < 2048 - 2")
def fits_context(t):
    return t.documents.filter(filters.fits_context(F.length("text"), 2048)).select("doc_id")


@query("usable_tests", "SELECT item_id FROM benchmark WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT contains(text, 'an')")
def usable_tests(t):
    return t.benchmark.filter(filters.usable_tests(F.col("text"), "an")).select("item_id")


@query("code_subset", """SELECT p_partkey FROM part WHERE p_brand IN ('Brand#13', 'Brand#22') AND p_size % 2 = 0 AND p_size < 18 AND p_retailprice / 2000 < 0.9 AND
(length(repeat('def f ', (p_partkey % 12)::INT)) - length(replace(repeat('def f ', (p_partkey % 12)::INT), 'def', ''))) / 3 >= 8""")
def code_subset(t):
    style = F.when(F.col("p_size") % 2 == 0, "instruct").otherwise("chat")
    rule = filters.kodcode_rule(F.col("p_brand"), style, F.col("p_size") / 2, F.col("p_retailprice") / 2000, F.repeat(F.lit("def f "), (F.col("p_partkey") % 12).cast("int")), ["Brand#13", "Brand#22"])
    return t.part.filter(rule).select("p_partkey")


ANSWERS = ["3", "x+y", "a+b+c", "x^{2}", "2^3^4", "sqrt(x)", "frac12", "x^12"]


@query("parseable_answers", f"""WITH a AS (SELECT p_partkey, {_case('p_partkey', ANSWERS)} AS x FROM part)
SELECT p_partkey FROM a WHERE len(list_distinct(regexp_extract_all(replace(replace(x, 'sqrt', ''), 'frac', ''), '\\p{{L}}'))) <= 2 AND NOT (contains(x, '^{{') OR contains(x, '^(') OR regexp_matches(x, '\\^[0-9]+\\^') OR regexp_matches(x, '\\^[0-9][0-9]+'))""")
def parseable_answers(t):
    return t.part.filter(filters.parseable_answer(pick("p_partkey", ANSWERS))).select("p_partkey")


@query("python_only", """WITH e AS (SELECT l_orderkey, list(DISTINCT CASE l_linenumber % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.py' ELSE CASE WHEN l_partkey % 3 = 0 THEN '.c' ELSE '.txt' END END) AS x FROM lineitem GROUP BY 1)
SELECT l_orderkey FROM e WHERE list_contains(x, '.py') AND NOT list_contains(x, '.c')""")
def python_only(t):
    k = F.col("l_linenumber") % 4
    e = F.when(k.isin(0, 2), ".py").when(k == 1, ".md").when(F.col("l_partkey") % 3 == 0, ".c").otherwise(".txt")
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(e).alias("x"))
    return g.filter(filters.only_python(F.col("x"), [".py", ".md", ".txt"])).select("l_orderkey")


@query("bug_edits", """WITH c AS (SELECT l_orderkey AS k, count_if(l_returnflag = 'R') AS d, count_if(l_returnflag = 'A') AS a, count_if(l_returnflag = 'N') AS e, count(*) AS s FROM lineitem GROUP BY 1) SELECT k FROM c WHERE d = 0 AND a <= 1 AND e <= 4 AND e > 0 AND s <= 6""")
def bug_edits(t):
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(n("R").alias("d"), n("A").alias("a"), n("N").alias("e"), F.count("*").alias("s"))
    return c.filter(filters.bug_edit_shape(F.col("a"), F.col("e"), F.col("d"), F.col("s"))).select("k")


@query("edited_test_entities", """WITH o AS (SELECT l_orderkey AS k, 'test_' || l_linenumber AS n, l_returnflag AS c FROM lineitem WHERE l_linenumber <= 2), w AS (SELECT l_orderkey AS k, 'test_' || l_linenumber AS n, l_linestatus AS c FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3)
SELECT DISTINCT w.k FROM w LEFT JOIN o ON o.k = w.k AND o.n = w.n WHERE (o.n IS NOT NULL AND o.c <> w.c) OR (o.n IS NULL AND w.k % 2 = 0 AND w.n = 'test_3')""")
def edited_test_entities(t):
    entity = lambda c: F.struct(F.concat(F.lit("test_"), F.col("l_linenumber").cast("string")).alias("name"), F.col(c).alias("content"))
    k = F.col("l_linenumber")
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(k <= 2, entity("l_returnflag"))).alias("o"), F.collect_set(F.when(k.between(2, 3), entity("l_linestatus"))).alias("w"))
    issue = F.when(F.col("k") % 2 == 0, "see test_3 here").otherwise("nothing")
    return g.filter(filters.test_entity_edited(F.col("o"), F.col("w"), issue)).select("k")


@query("invalid_simulations", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'SIM_ERROR' WHEN 2 THEN 'it failed to run here' ELSE o_comment END AS r, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE '1.0' END AS w FROM (SELECT *, 'fine ' || o_orderpriority AS o_comment FROM orders))
SELECT o_orderkey FROM x WHERE r = '' OR r = 'SIM_ERROR' OR contains(r, 'failed to run') OR TRY_CAST(w AS DOUBLE) IS NULL""")
def invalid_simulations(t):
    k = F.col("o_orderkey") % 4
    r = F.when(k == 0, "").when(k == 1, "SIM_ERROR").when(k == 2, "it failed to run here").otherwise(F.concat(F.lit("fine "), "o_orderpriority"))
    return t.orders.filter(filters.invalid_simulation(r, "SIM_ERROR", ["failed to run"], F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise("1.0"))).select("o_orderkey")


RUNS = ["ls -la", "pip install x", "git log", "curl http://x", "echo git", "sudo su"]


@query("command_replies", f"""WITH x AS (SELECT o_orderkey, {_case('o_orderkey', RUNS)} AS c FROM orders)
SELECT o_orderkey, CASE WHEN contains(c, 'pip install') THEN 'Successfully installed packages.' WHEN contains(c, 'git ') THEN 'This command git is not allowed. Please try other approaches.' WHEN contains(c, 'curl') THEN 'This command curl is not allowed. Please try other approaches.' END AS output FROM x""")
def command_replies(t):
    return t.orders.select("o_orderkey", filters.command_reply(pick("o_orderkey", RUNS), ["git"], ["curl"])["output"].alias("output"))


@query("forbidden_commands", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_case('o_orderkey', RUNS)} AS c FROM orders) WHERE contains(c, 'git ') OR contains(c, 'curl')")
def forbidden_commands(t):
    return t.orders.filter(filters.forbidden_command(pick("o_orderkey", RUNS), ["git"], ["curl"])).select("o_orderkey")


@query("patches_without", "SELECT l_orderkey, list_sort(list(p) FILTER (WHERE NOT contains(p, 'docs/') AND NOT contains(p, '7'))) AS files FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'docs/' ELSE 'src/' END || l_partkey AS p FROM lineitem) GROUP BY 1 HAVING count_if(NOT contains(p, 'docs/') AND NOT contains(p, '7')) > 0")
def patches_without(t):
    p = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "docs/").otherwise("src/"), F.col("l_partkey").cast("string"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(p)).alias("p"))
    return g.select("l_orderkey", filters.patches_without(F.col("p"), ["docs/", "7"]).alias("files")).filter(F.size("files") > 0)


@query("rows_excluded", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i NOT IN (0, 5, 17, 100000000)")
def rows_excluded(t):
    return filters.without_rows(t.orders.select("o_orderkey"), ["o_orderkey"], [0, 5, 17, 100_000_000])


SETS = "s AS (SELECT l_orderkey AS k, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber <= 3)), []) AS a, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber >= 2)), []) AS b FROM lineitem GROUP BY 1)"


@query("entity_sets", f"WITH {SETS} SELECT k, list_sort(list_distinct(list_concat(a, b))) AS \"both\", list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM s")
def entity_sets(t):
    n = F.col("l_linenumber")
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(n <= 3, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(n >= 2, F.col("l_partkey"))).alias("b"))
    return g.select("k", filters.entity_sets(F.col("a"), F.col("b")).alias("r")).select("k", "r.*")


# ---- joins ----


@query("resume_unsolved", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_unsolved(t):
    todo = t.orders.select("o_custkey").distinct()
    return joins.resume_unsolved(todo, t.orders.select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("reward")), "o_custkey")


@query("maps_equal", """WITH m AS (SELECT l_orderkey AS k, count(*) AS n, count_if(l_returnflag <> CASE WHEN l_linenumber = 1 THEN l_returnflag ELSE l_linestatus END) AS d FROM lineitem GROUP BY 1)
SELECT k, CAST(d = 0 AS INT) AS reward FROM m""")
def maps_equal(t):
    number = F.col("l_linenumber").cast("string")
    as_map = lambda v: F.map_from_entries(F.collect_list(F.struct(number, v)))
    unique = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    g = unique.groupBy(F.col("l_orderkey").alias("k")).agg(as_map(F.col("l_returnflag")).alias("a"), as_map(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))).alias("b"))
    return g.select("k", joins.maps_equal(F.col("a"), F.col("b")).alias("reward"))


@query("commit_issues", """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS pr FROM orders), p AS (SELECT c_custkey AS pr, c_nationkey AS a, c_custkey % 7 AS b FROM customer)
SELECT DISTINCT o_orderkey AS commit_hash, i.issue, n_name AS title FROM c JOIN p USING (pr), LATERAL (SELECT unnest([a, b]) AS issue) i JOIN nation ON n_nationkey = i.issue""")
def commit_issues(t):
    message = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Fix it (#"), F.col("o_custkey").cast("string"), F.lit(")"))).otherwise("no pull")
    body = F.concat(F.lit("This closes #"), F.col("c_nationkey").cast("string"), F.lit(" and Fixes: #"), (F.col("c_custkey") % 7).cast("string"))
    pulls = t.customer.select(F.col("c_custkey").alias("number"), body.alias("body"))
    issues = t.nation.select(F.col("n_nationkey").alias("issue"), F.col("n_name").alias("title"), F.lit("").alias("body"))
    return joins.commit_issues(t.orders.select(F.col("o_orderkey").alias("commit_hash"), message.alias("message")), pulls, issues).select("commit_hash", "issue", "title")


@query("issue_contents", """SELECT o_custkey AS commit_hash, CAST(count(*) AS INT) AS n, string_agg(n_name, ',' ORDER BY i) AS titles FROM (SELECT o_custkey, unnest([o_custkey % 40, 3, 99]) AS issue, unnest([0, 1, 2]) AS i FROM (SELECT DISTINCT o_custkey FROM orders)) JOIN nation ON n_nationkey = issue GROUP BY 1""")
def issue_contents(t):
    c = t.orders.select(F.col("o_custkey").alias("commit_hash")).distinct().withColumn("issues", F.array(F.col("commit_hash") % 40, F.lit(3).cast("long"), F.lit(99).cast("long")))
    issues = t.nation.select(F.col("n_nationkey").cast("long").alias("issue"), F.col("n_name").alias("title"), F.lit("").alias("body"))
    return commits.issue_contents(c, issues).select("commit_hash", F.size("contents").alias("n"), F.array_join(F.transform("contents", lambda x: x["title"]), ",").alias("titles"))


@query("dict_of_lists", "SELECT o_custkey, key, list(value ORDER BY o_orderkey) AS \"values\" FROM (SELECT o_custkey, o_orderkey, unnest(['status', 'priority']) AS key, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders) GROUP BY ALL")
def dict_of_lists(t):
    row = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return joins.dict_of_lists(t.orders.select("o_custkey", "o_orderkey", row.alias("row")), "o_custkey", "row", "o_orderkey")


# ---- reshaping ----


@query("local_dirs", "SELECT 'root/' || replace(r, '/', '__') AS path FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'org/' || n_name ELSE 'org/' || lower(n_name) END AS r, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE 'root/' || replace(r, '/', '__') IN (SELECT 'root/org__' || n_name FROM nation WHERE n_nationkey < 20)")
def local_dirs(t):
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    even = F.col("c_custkey") % 2 == 0
    df = c.select(F.when(even, F.concat(F.lit("org/"), "n_name")).otherwise("").alias("repo"), F.concat(F.lit("org/"), F.lower("n_name")).alias("repo_name"))
    return shape.local_dir(df, "root", t.nation.filter("n_nationkey < 20").select(F.concat(F.lit("root/org__"), "n_name").alias("path"))).select("path")


@query("rl_rows", "SELECT o_orderkey, o_orderpriority || ' Think.' AS prompt, o_orderstatus AS truth FROM orders")
def rl_rows(t):
    df = shape.wrapped(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("problem"), F.col("o_orderstatus").alias("answer")), "Think.")
    return df.select(F.get_json_object("extra_info", "$.o_orderkey").cast("long").alias("o_orderkey"), F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("truth"))


@query("task_rows", "SELECT doc_id, 'Solve: ' || text AS user_text, 'swe' AS ability FROM documents")
def task_rows(t):
    df = shape.task_row(t.documents.select("doc_id", F.col("text").alias("problem_statement")), "swe", "You are an agent.", "Solve: {problem_statement}")
    return df.select(F.get_json_object("extra_info", "$.doc_id").cast("long").alias("doc_id"), F.col("prompt")[1]["content"].alias("user_text"), "ability")


@query("hotpot_rows", "SELECT o_orderpriority AS question, o_orderstatus AS ground_truth, 'hotpotqa' AS data_source FROM orders")
def hotpot_rows(t):
    return shape.hotpot_row(t.orders.select(F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), "o_orderkey"))


@query("interleaved_batch", "SELECT n_nationkey, CAST(k AS INT) AS copy, (row_number() OVER (PARTITION BY k ORDER BY n_nationkey) - 1) * 3 + k AS at FROM nation, range(3) r(k)")
def interleaved_batch(t):
    return shape.repeated_batches(t.nation.select("n_nationkey"), ["n_nationkey"], 3)


@query("stacked_batch", "SELECT n_nationkey, CAST(k AS INT) AS copy, k * (SELECT count(*) FROM nation) + row_number() OVER (PARTITION BY k ORDER BY n_nationkey) - 1 AS at FROM nation, range(3) r(k)")
def stacked_batch(t):
    return shape.repeated_batches(t.nation.select("n_nationkey"), ["n_nationkey"], 3, interleave=False)


@query("zipped_codes", "WITH g AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS n, list(o_orderstatus ORDER BY o_orderkey) FILTER (WHERE o_totalprice > 1000) AS c FROM orders GROUP BY 1) SELECT o_custkey, len(n) <> len(coalesce(c, [])) AS mismatch, CAST(len(list_distinct(n[1:least(len(n), len(coalesce(c, [])))])) AS INT) AS names FROM g")
def zipped_codes(t):
    ordered = lambda c, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("o_orderkey", c)))), lambda x: x[c])
    g = t.orders.groupBy("o_custkey").agg(ordered("o_orderpriority", F.lit(True)).alias("n"), ordered("o_orderstatus", F.col("o_totalprice") > 1000).alias("c"))
    return g.select("o_custkey", shape.zipped_map(F.col("n"), F.col("c")).alias("z")).select("o_custkey", F.col("z.mismatch").alias("mismatch"), F.size("z.m").alias("names"))


@query("merged_tests", "SELECT p_size AS g, CAST(count(*) AS INT) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def merged_tests(t):
    test = F.struct(F.col("p_name").alias("input"), F.col("p_brand").alias("output"))
    public = F.col("p_partkey") % 3 == 0
    g = t.part.groupBy(F.col("p_size").alias("g")).agg(F.collect_list(F.when(public, test)).alias("a"), F.collect_list(F.when(~public, test)).alias("b"))
    return g.select("g", F.size(shape.merged_tests(F.col("a"), F.col("b"))).alias("n")).filter("n > 1")


@query("prompt_sections", "SELECT o_orderkey, '## Problem' || chr(10) || o_orderpriority || chr(10) || chr(10) || '## Patch' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '(not available)' ELSE o_orderstatus END AS prompt FROM orders")
def prompt_sections(t):
    return t.orders.select("o_orderkey", shape.prompt_sections([("Problem", F.col("o_orderpriority")), ("Patch", F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderstatus")))]).alias("prompt"))


@query("verifier_samples", "SELECT o_orderkey, '<judgement>' || CASE WHEN o_orderstatus = 'F' THEN 'YES' ELSE 'NO' END || '</judgement>' AS response, CASE WHEN o_orderstatus = 'F' THEN 'YES' ELSE 'NO' END AS label FROM orders")
def verifier_samples(t):
    v = shape.verifier_sample(F.col("o_orderpriority"), F.lit(None).cast("string"), (F.col("o_orderstatus") == "F").cast("int"))
    return t.orders.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.response", "v.label")


def _trajectories(t: Tables) -> DataFrame:
    """Orders as trajectories: a line is a step whose action reads, writes or makes a file of the testbed."""
    k = F.col("l_linenumber") % 4
    path = F.concat(F.lit("/testbed/p"), (F.col("l_partkey") % 10).cast("string"), F.when(F.col("l_partkey") % 3 == 0, "").when(F.col("l_partkey") % 3 == 1, ".py").otherwise(".md"))
    call = lambda fn, command: F.concat(F.lit(f"<function={fn}>\n<parameter=command>{command}</parameter>\n<parameter=path>"), path, F.lit("</parameter>\n</function>"))
    action = F.when(k == 0, call("file_viewer", "view")).when(k == 1, call("file_editor", "str_replace")).when(k == 2, call("file_editor", "create")).otherwise("<function=submit>\n</function>")
    step = F.struct(
        F.col("l_linenumber").alias("i"), "l_partkey", "l_suppkey", F.lit("think").alias("thought"), action.alias("action"), F.col("l_returnflag").alias("observation"), F.col("l_quantity").alias("token_usage_prompt"),
        F.lit(1).alias("token_usage_completion"), F.col("l_quantity").alias("token_usage_total"), F.col("l_discount").alias("llm_exec_time"), F.col("l_tax").alias("env_exec_time"), (F.col("l_linenumber") >= 5).alias("done"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(step)).alias("steps"))


STEP_PATHS = """p AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey, l_suppkey, 'p' || l_partkey % 10 || CASE l_partkey % 3 WHEN 1 THEN '.py' WHEN 2 THEN '.md' ELSE '' END AS f, l_linenumber % 4 AS kind, l_quantity AS q, l_tax AS e FROM lineitem)"""


@query("step_files", f"""WITH {STEP_PATHS} SELECT k, coalesce(list_sort(list(f) FILTER (WHERE kind = 2 AND contains(f, '.'))), []) AS created, coalesce(list_sort(list(f) FILTER (WHERE kind = 1 AND contains(f, '.'))), []) AS edited,
coalesce(list_sort(list('/testbed/' || f) FILTER (WHERE kind = 0 AND contains(f, '.'))), []) AS viewed FROM p GROUP BY k""")
def step_files(t):
    s = F.col("steps")
    return _trajectories(t).select("k", F.sort_array(shape.created_files(s)).alias("created"), F.sort_array(shape.edited_files(s)).alias("edited"), F.sort_array(shape.viewed_files(s)).alias("viewed"))


@query("trajectory_metrics", f"""WITH {STEP_PATHS} SELECT k AS docker_image, CAST(count(*) AS INT) AS step_count, CAST(count_if(kind = 2 AND contains(f, '.')) AS INT) AS num_created_files, 100 AS patch_num_lines, 1 AS p2p_rate, 5 AS patch_size,
CAST(count_if(kind = 3) AS INT) AS submits, round(sum(q), 4) AS total_tokens, round(sum(e), 6) AS env_time, coalesce(list_sort(list(DISTINCT split_part(f, '.', 2)) FILTER (WHERE kind = 1 AND contains(f, '.'))), []) AS edited_extensions FROM p GROUP BY k""")
def trajectory_metrics(t):
    rows = _trajectories(t).select(F.col("k").alias("image"), "steps", F.lit(1).alias("reward"), F.lit("patch").alias("patch"), F.lit(None).cast("string").alias("true"), F.lit(None).cast("int").alias("lines"), F.lit(None).cast("array<string>").alias("p2p"), F.lit(None).cast("map<string,string>").alias("regression"))
    out = shape.trajectory_metrics(rows, "steps", "image", "reward", "patch", "true", "lines", "p2p", "regression")
    return out.select("docker_image", "step_count", "num_created_files", "patch_num_lines", "p2p_rate", "patch_size", "submits", F.round("total_tokens", 4).alias("total_tokens"), F.round("env_time", 6).alias("env_time"), "edited_extensions")


@query("trace_texts", "SELECT l_orderkey AS k, string_agg('=== step ' || i || ' ===' || chr(10) || 'thought: think' || chr(10) || 'action: ' || chr(10) || 'observation: ' || l_returnflag, chr(10) || chr(10) ORDER BY i) AS trace FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem) GROUP BY 1")
def trace_texts(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("observation")))).alias("s"))
    steps = F.transform("s", lambda x: F.struct(F.lit("think").alias("thought"), F.lit(None).cast("string").alias("action"), x["observation"].alias("observation")))
    return s.select("k", shape.trace_text(steps).alias("trace"))


@query("last_step_sft", "SELECT conv_id, CAST(count(*) AS INT) AS n, max(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS top FROM conversations GROUP BY 1 HAVING count(*) >= 3")
def last_step_sft(t):
    """Conversations as trajectories of one step, whose reward is a sixth of the number of turns."""
    m = nested(t).withColumn("reward", F.col("n_turns") / 6)
    named = F.concat("messages", F.array(shape.message("id", F.col("conv_id").cast("string"))))
    out = shape.last_step_sft(m.withColumn("steps", F.array(F.struct(named.alias("chat_completions")))), "steps", "reward", 0.5)
    body = F.filter("messages", lambda x: x["role"] != "id")
    return out.select(F.element_at("messages", -1)["content"].cast("long").alias("conv_id"), F.size(body).alias("n"), F.array_max(F.transform(body, lambda x: x["content"])).alias("top"))


@query("task_types", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'math' WHEN p_partkey % 3 = 0 THEN 'code' WHEN p_partkey % 3 = 1 THEN 'search' ELSE 'unknown' END AS kind FROM part")
def task_types(t):
    meta = F.create_map(F.when(F.col("p_partkey") % 3 == 0, "tests").when(F.col("p_partkey") % 3 == 1, "question").otherwise("z"), F.lit("1"))
    return t.part.select("p_partkey", shape.task_type(F.col("p_brand"), meta, {"math": ["Brand#11", "Brand#12"]}, {"code": ["tests"], "search": ["question"]}).alias("kind"))


@query("repo_lists", "SELECT DISTINCT r AS repo FROM (SELECT unnest(['a/' || n_name, 'b/' || n_name]) AS r FROM nation)")
def repo_lists(t):
    from trajlake.sources.io import repo_list

    name = F.col("n_name")
    as_list = F.to_json(F.array(F.concat(F.lit("a/"), name), F.concat(F.lit("b/"), name)))
    as_object = F.to_json(F.create_map(F.lit("x"), F.array(F.concat(F.lit("a/"), name)), F.lit("y"), F.array(F.concat(F.lit("b/"), name))))
    return repo_list(t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, as_list).otherwise(as_object).alias("j")), "j").distinct()


@query("longest_tests", "SELECT p_size AS g, list(length(p_name) ORDER BY length(p_name) DESC, p_partkey)[1:15] AS lengths FROM part GROUP BY 1")
def longest_tests(t):
    g = t.part.groupBy(F.col("p_size").alias("g")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("input")))).alias("x"))
    return g.select("g", F.transform(rank.longest_tests(F.col("x")), lambda x: F.length(x["input"]).cast("long")).alias("lengths"))


# ---- chats and tokens ----


@query("message_masks", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS on_tokens FROM conversations GROUP BY 1")
def message_masks(t):
    m = nested(t)
    mask = chat.message_masks(F.transform("messages", lambda x: x["role"]), F.transform("messages", lambda x: F.length(x["content"])))
    return m.select("conv_id", F.size(mask).cast("long").alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("on_tokens"))


TOOLS = ['{"type": "function", "function": {"name": "submit"}}', '{"type": "function", "function": {"name": "execute_bash"}}']
TOOL_HEAD = _text(chat.TOOL_NOTES["qwen"][0] + "".join("\n" + x for x in TOOLS) + chat.TOOL_NOTES["qwen"][1])
TOOL_PIECES = f"""m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
s AS (SELECT conv_id, bool_or(i = 1 AND role = 'system') AS own FROM m GROUP BY 1),
p AS (SELECT conv_id, 0 AS i, 'head' AS role, '<|im_start|>system' || chr(10) || {_text(chat.TEMPLATES["qwen"]["default_system"])} || {TOOL_HEAD} || '<|im_end|>' || chr(10) AS t FROM s WHERE NOT own
UNION ALL SELECT conv_id, 2 * i, CASE WHEN role = 'assistant' THEN 'open' ELSE role END, CASE role WHEN 'assistant' THEN '<|im_start|>assistant' || chr(10) WHEN 'tool' THEN '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response><|im_end|>' || chr(10)
  ELSE '<|im_start|>' || role || chr(10) || text || CASE WHEN i = 1 AND role = 'system' THEN {TOOL_HEAD} ELSE '' END || '<|im_end|>' || chr(10) END FROM m
UNION ALL SELECT conv_id, 2 * i + 1, 'assistant', text || '<|im_end|>' || chr(10) FROM m WHERE role = 'assistant')"""


@query("tool_chat_render", f"WITH {TOOL_PIECES} SELECT conv_id, string_agg(t, '' ORDER BY i) AS rendered FROM p GROUP BY 1")
def tool_chat_render(t):
    return nested(t).select("conv_id", chat.render(F.col("messages"), "qwen", tools=TOOLS).alias("rendered"))


@query("tool_response_ranges", f"""WITH {TOOL_PIECES}, o AS (SELECT conv_id, role, length(t) AS n, sum(length(t)) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM p)
SELECT conv_id, CAST(e - n AS INT) AS start, CAST(e - 1 AS INT) AS "end" FROM o WHERE role = 'assistant'""")
def tool_response_ranges(t):
    """Characters stand for tokens."""
    pieces = nested(t).select("conv_id", chat.turn_texts(F.col("messages"), "qwen", tools=TOOLS).alias("p"))
    r = chat.response_ranges(F.transform("p", lambda x: x["role"]), F.transform("p", lambda x: F.length(x["text"])))
    return pieces.select("conv_id", F.inline(r))


ORDER_LIST = "SELECT o_custkey, list(o_orderkey % 97 ORDER BY o_orderkey) AS x FROM orders GROUP BY 1"


def _lists(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: (x % 97).cast("int")).alias("x"))


@query("padded_left", f"""SELECT o_custkey, list_concat(list_transform(range(12 - least(12, len(x))), lambda i: -1), x[1:12])::INT[] AS ids, list_transform(range(12), lambda i: CAST(greatest(0, i - (12 - least(12, len(x)))) AS INT)) AS positions FROM ({ORDER_LIST})""")
def padded_left(t):
    return _lists(t).select("o_custkey", chat.padded(F.col("x"), 12, -1, left=True).alias("p")).select("o_custkey", "p.ids", "p.positions")


@query("padded_right", f"""SELECT o_custkey, list_concat(x[1:12], list_transform(range(12 - least(12, len(x))), lambda i: -1))::INT[] AS ids, list_transform(range(12), lambda i: CAST(i < len(x) AS INT)) AS mask, list_transform(range(12), lambda i: CAST(least(i, least(12, len(x)) - 1) AS INT)) AS positions FROM ({ORDER_LIST})""")
def padded_right(t):
    return _lists(t).select("o_custkey", chat.padded(F.col("x"), 12, -1).alias("p")).select("o_custkey", "p.ids", "p.mask", "p.positions")


@query("rewards_at_last", f"SELECT o_custkey, list_transform(range(len(x) + 2), lambda i: CASE WHEN i + 1 = len(x) THEN 0.5 ELSE 0.0 END)::DOUBLE[] AS rewards FROM ({ORDER_LIST})")
def rewards_at_last(t):
    mask = F.concat(F.transform("x", lambda v: F.lit(1)), F.array(F.lit(0), F.lit(0)))
    return _lists(t).select("o_custkey", chat.reward_at_last(mask, F.lit(0.5)).alias("rewards"))


@query("within_budget", f"SELECT o_custkey, x[1:greatest(0, len(x) - greatest(0, 100 + len(x) - 110))]::INT[] AS kept FROM ({ORDER_LIST})")
def within_budget(t):
    return _lists(t).select("o_custkey", chat.within_budget(F.col("x"), F.lit(100), 110).alias("kept"))


@query("terminations", """SELECT o_orderkey, CASE WHEN o_custkey > 900 THEN 'PROMPT_TRUNCATION' WHEN o_orderkey % 11 = 0 THEN 'GARBLED_OUTPUT' WHEN o_orderkey % 13 = 0 THEN 'ENV_TIMEOUT' WHEN o_orderkey % 17 = 0 THEN 'ENCODE_ERROR' WHEN o_totalprice >= 200000 THEN 'TRUNCATION' WHEN o_custkey >= 800 THEN 'TRAJ_TIMEOUT'
WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'REWARD_TIMEOUT' WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'REPORT_JSON_LOAD_FAILED' WHEN o_orderstatus = 'F' THEN 'ENV_DONE' WHEN o_custkey % 50 >= 40 THEN 'MAX_STEPS' END AS reason FROM orders""")
def terminations(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reason = chat.termination(c, 900, k % 11 == 0, k % 13 == 0, k % 17 == 0, F.col("o_totalprice"), 200_000, c, 800, F.col("o_orderstatus") == "F", c % 50, 40, k % 5 == 0, k % 7 != 0)
    return t.orders.select("o_orderkey", reason.alias("reason"))


@query("exit_reasons", """SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'llm_query_error' WHEN o_orderstatus = 'F' THEN 'agent' WHEN o_totalprice >= 250000 THEN 'token_limit' WHEN o_custkey % 100 >= 95 THEN 'abs_step_limit' WHEN o_custkey >= 1400 THEN 'traj_time_limit' WHEN o_orderkey % 3 = 0 THEN 'agent_max_step_limit' WHEN o_custkey % 100 >= 50 THEN 'max_step_limit' ELSE 'agent' END AS reason FROM orders""")
def exit_reasons(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = chat.exit_reason(F.col("o_orderstatus") == "F", c % 100, F.lit(50), k % 3 == 0, k % 23 == 0, F.col("o_totalprice"), F.lit(250_000), F.lit(95), c, F.lit(1400))
    return t.orders.select("o_orderkey", r.alias("reason"))


# ---- texts ----


@query("view_lengths", "SELECT p_partkey, CASE WHEN p_size >= 10 THEN CAST(p_size - 10 + 1 AS INT) END AS lines FROM part")
def view_lengths(t):
    return t.part.select("p_partkey", text.line_range_length(F.concat(F.lit("[10, "), F.col("p_size").cast("string"), F.lit("]"))).alias("lines"))


@query("issue_statements", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS issue FROM documents")
def issue_statements(t):
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x [ISSUE]\n"), "text", F.lit("[/ISSUE] y"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", text.issue_statement(wrapped).alias("issue"))


@query("first_prompts", "SELECT conv_id, first(text ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY 1")
def first_prompts(t):
    return nested(t).select("conv_id", text.prompt_text(F.lit(None).cast("string"), F.col("messages")).alias("prompt"))


@query("replaced_once", "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS ok, CASE WHEN o_orderpriority = '1-URGENT' THEN '1-LATE' ELSE o_orderpriority END AS text FROM orders")
def replaced_once(t):
    return t.orders.select("o_orderkey", text.replaced_once(F.col("o_orderpriority"), F.lit("URGENT"), F.lit("LATE")).alias("r")).select("o_orderkey", "r.ok", "r.text")


@query("truncated_texts", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || ' [cut]' ELSE text END AS text FROM documents")
def truncated_texts(t):
    return t.documents.select("doc_id", text.truncated(F.col("text"), 100, " [cut]").alias("text"))


@query("first_steps_described", "SELECT l_linenumber, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, count(*) AS n FROM lineitem GROUP BY 1")
def first_steps_described(t):
    from trajlake.operators.metrics import describe

    return rounded(describe(t.lineitem, ["l_extendedprice"], (0.5,), by=["l_linenumber"]).select("l_linenumber", "p50", "n"))


@query("shuffled_slice", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i FROM documents) WHERE i >= 10 AND i < 40")
def shuffled_slice(t):
    return order.shuffled_slice(t.documents.select("doc_id"), "doc_id", 10, 30).select("doc_id")
