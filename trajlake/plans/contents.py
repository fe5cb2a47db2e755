"""Queries for rules on texts: inputs are made of the contents of given columns, by one expression that Spark and DuckDB both read, and
the SQL states the rule over that input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import chat, text
from trajlake.functions.lang import COMMANDS, INSTALLS, REPO_WORDS, detect_language, is_test_command
from trajlake.functions.udfs import patch_rows
from trajlake.operators import commits, joins, shape
from trajlake.operators.condense import condense
from trajlake.plans.registry import SQL, Tables, query
from trajlake.plans.survey import terminations

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
STEP = "l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice"


def stripped(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def made(t: Tables, table: str, key: list[str], x: str) -> DataFrame:
    return getattr(t, table).select(*key, F.expr(x).alias("x"))


def view(table: str, key: list[str], x: str) -> str:
    return f"v AS (SELECT {', '.join(key)}, {x} AS x FROM {table})"


def joined(t: Tables, line: str, head: str = "''") -> DataFrame:
    """(k, x): a text for each order, of a line for each of its lineitems."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.struct(*STEP.split(", "), F.expr(line).alias("line")).alias("s"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n")
    return rows.groupBy("k").agg(F.concat(F.expr(head), lines).alias("x"))


def joined_view(line: str, head: str = "''") -> str:
    return f"v AS (SELECT l_orderkey AS k, {head} || string_agg({line}, chr(10) ORDER BY {STEP}) AS x FROM lineitem GROUP BY 1)"


# ---- logs, actions, outputs ----

LOG_HEAD = "'seen PASSED a::b' || chr(10) || '== short test summary info ==' || chr(10)"
LOG_LINE = """CASE l_returnflag WHEN 'A' THEN 'PASSED t' || (l_partkey % 3) || '.py::C::m' || (l_linenumber % 3) WHEN 'N' THEN 'FAILED t.py::m' || (l_suppkey % 4) || ' - was ' || l_linestatus ELSE ' ERROR t.py::m' || (l_suppkey % 4) || ' - x::y' END"""


@query("log_status_map", f"""WITH {joined_view(LOG_LINE, LOG_HEAD)}, p AS (SELECT k, string_split(substr(x, strpos(x, 'short test summary info') + 23), chr(10)) AS ls FROM v),
l AS (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM p),
e AS (SELECT k, i, CASE WHEN contains(line, 'PASSED') THEN 'PASSED' WHEN contains(line, 'FAILED') THEN 'FAILED' WHEN contains(line, 'ERROR') THEN 'ERROR' END AS status, replace(substr(line, strpos(line, '::') + 2), '::', '.') AS n FROM l WHERE contains(line, '::')),
f AS (SELECT k, i, {stripped("CASE WHEN status = 'PASSED' THEN n ELSE string_split(n, ' - ')[1] END")} AS test, status FROM e WHERE status IS NOT NULL)
SELECT k, test, arg_max(status, i) AS status FROM f WHERE test <> '' GROUP BY k, test""")
def log_status_map(t):
    return joined(t, LOG_LINE, LOG_HEAD).select("k", F.explode(text.status_map(F.col("x"))).alias("test", "status"))


TURN = ["conv_id", "turn"]
CALL = """CASE WHEN turn % 2 = 0 THEN text || chr(10) || '<function= ' || role || ' >' || chr(10) || '<parameter=cmd> ' || upper(role) || ' </parameter><parameter= path >' || conv_id || '</parameter>' ||
CASE WHEN turn % 4 = 0 THEN '<parameter=cmd>' || chr(10) || turn || ' again</parameter>' ELSE '' END || chr(10) || '</function>' || role WHEN role = 'user' THEN text || ' <function=open' ELSE text END"""


@query("action_parse", f"""WITH {view('conversations', TURN, CALL)} SELECT conv_id, turn, {stripped("regexp_extract(x, '<function[ ]*=[ ]*([^>]+)>', 1)")} AS fn,
{stripped("coalesce(list_extract(regexp_extract_all(x, '(?s)<parameter[ ]*=[ ]*cmd[ ]*>(.*?)</parameter>', 1), -1), '')")} AS cmd, coalesce(list_extract(regexp_extract_all(x, '<parameter= path >(.*?)</parameter>', 1), -1), '') AS path FROM v""")
def action_parse(t):
    df = made(t, "conversations", TURN, CALL).select(*TURN, text.action_params(F.col("x")).alias("a"))
    return df.select(*TURN, F.col("a.fn").alias("fn"), F.coalesce(F.col("a.params")["cmd"], F.lit("")).alias("cmd"), F.coalesce(F.col("a.params")["path"], F.lit("")).alias("path"))


@query("response_split", f"""WITH {view('conversations', TURN, CALL)}, b AS (SELECT *, regexp_extract(x, '(?s)<function=.*?</function>') AS block FROM v)
SELECT conv_id, turn, {stripped("CASE WHEN block <> '' THEN substr(x, 1, strpos(x, '<function=') - 1) ELSE x END")} AS thought, {stripped('block')} AS action FROM b""")
def response_split(t):
    return made(t, "conversations", TURN, CALL).select(*TURN, text.thought_and_action(F.col("x")).alias("r")).select(*TURN, "r.*")


OUTPUT = """'[STDOUT] ' || o_orderpriority || CASE WHEN o_orderstatus <> 'O' THEN ' [STDERR]' || chr(10) || o_orderstatus || CASE WHEN o_orderpriority LIKE '%LOW' THEN '[STDERR] last ' ELSE '' END ELSE '[STDOUT] ' || o_custkey END"""


@query("marker_split", f"""WITH {view('orders', ['o_orderkey'], OUTPUT)}, s AS (SELECT o_orderkey, x, string_split(x, '[STDERR]') AS p FROM v),
w AS (SELECT o_orderkey, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], '[STDERR]') ELSE x END AS head, CASE WHEN len(p) > 1 THEN p[len(p)] ELSE '' END AS err FROM s)
SELECT o_orderkey, {stripped("list_extract(string_split(head, '[STDOUT]'), -1)")} AS stdout, {stripped('err')} AS stderr FROM w""")
def marker_split(t):
    return made(t, "orders", ["o_orderkey"], OUTPUT).select("o_orderkey", text.out_and_err(F.col("x")).alias("r")).select("o_orderkey", "r.*")


FENCED = """CASE WHEN source = 'src3' THEN text ELSE text || chr(10) || '```' || lang || chr(10) || source || ' = ' || n_chars || chr(10) || '```' || CASE source WHEN 'src1' THEN chr(10) || '```' || chr(10) || ' ' || lang || chr(10) || '```' WHEN 'src2' THEN '``' ELSE '' END END"""


@query("fenced_code", f"""WITH {view('documents', ['doc_id'], FENCED)} SELECT doc_id, {stripped("list_extract(regexp_extract_all(x, '(?s)```(?:[a-zA-Z0-9_]+)?' || chr(10) || '(.*?)```', 1), -1)")} AS code FROM v""")
def fenced_code(t):
    return made(t, "documents", ["doc_id"], FENCED).select("doc_id", text.last_code_block(F.col("x")).alias("code"))


# ---- patches and commits ----

HEADERS = """'--- ' || CASE WHEN l_returnflag = 'N' THEN '/dev/null' ELSE 'a/p' || (l_partkey % 10) || '.py' END || chr(10) || '+++ ' || CASE WHEN l_returnflag = 'R' THEN '/dev/null' ELSE 'b/q/p' || (l_partkey % 10) || '.py' || chr(9) || '2024' END || chr(10) || '@@ -1 +1 @@'"""


@query("patch_files", f"""WITH {joined_view(HEADERS)}, l AS (SELECT k, unnest(string_split(x, chr(10))) AS line FROM v),
f AS (SELECT DISTINCT k, string_split(substr(line, 7), chr(9))[1] AS f FROM l WHERE starts_with(line, '--- a/') OR starts_with(line, '+++ b/'))
SELECT k, coalesce(list_sort(list(f) FILTER (WHERE f IS NOT NULL)), []) AS files FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) LEFT JOIN f USING (k) GROUP BY k""")
def patch_files(t):
    return joined(t, HEADERS).select("k", F.sort_array(text.patch_files(F.col("x"))).alias("files"))


MESSAGE = """CASE lang WHEN 'de' THEN 'Merge Pull request #' || n_chars || ' from x' || chr(10) WHEN 'fr' THEN source || ' Add ' WHEN 'es' THEN source || ' REFACTOR ' ELSE '' END || text || CASE WHEN n_chars > 1000 THEN ' (#' || doc_id || ')' ELSE '' END"""


@query("commit_kind", f"""WITH {view('documents', ['doc_id'], MESSAGE)}, w AS (SELECT doc_id, x, lower(x) AS m FROM v) SELECT doc_id, CASE WHEN contains(m, 'fix') OR contains(m, 'bug') THEN 'bug' WHEN contains(m, 'feature') OR contains(m, 'add') THEN 'feature' WHEN contains(m, 'refactor') THEN 'refactor' ELSE 'other' END AS kind,
TRY_CAST(coalesce(nullif(regexp_extract(x, '\\(#(\\d+)\\)', 1), ''), nullif(regexp_extract(x, '(?i)merge pull request #(\\d+)', 1), '')) AS BIGINT) AS pull FROM w""")
def commit_kind(t):
    return made(t, "documents", ["doc_id"], MESSAGE).select("doc_id", text.commit_kind(F.col("x")).alias("kind"), joins.pull_request_of(F.col("x")).alias("pull"))


COMMAND = """CASE WHEN value < 20 THEN 'execute_bash git ' || event_type WHEN value < 40 THEN ' execute_bash pytest ' || event_type WHEN value < 60 THEN 'execute_bash Pip install x && python ' || event_type WHEN value < 80 THEN event_type || ' python ' WHEN value < 100 THEN 'execute_bash mypytests ' || event_type ELSE 'execute_bash python3 ' || event_type || ' ' || user_id END"""
LISTS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("execution_command", f"""WITH {view('events', ['event_id'], COMMAND)}, c AS (SELECT event_id, {stripped('x')} AS c FROM v)
SELECT event_id, starts_with(c, 'execute_bash') AND NOT contains(c, 'git ') AND NOT list_bool_or(list_transform({LISTS(INSTALLS['python'])}, lambda w: contains(lower(c), w))) AND (contains(c, 'python ') OR contains(c, 'python3 ') OR regexp_matches(c, '{COMMANDS['python']}')) AS runs FROM c""")
def execution_command(t):
    return made(t, "events", ["event_id"], COMMAND).select("event_id", is_test_command(F.col("x")).alias("runs"))


REPO = """CASE WHEN s_acctbal < 1000 THEN 'X/' || s_name WHEN s_acctbal < 3000 THEN s_name || '/Tokio-' || s_nationkey WHEN s_acctbal < 5000 THEN 'my-gin-' || s_name ELSE s_name END"""
RUN = """CASE s_nationkey % 5 WHEN 0 THEN ' npm  run test ' WHEN 1 THEN 'cargo test ' || s_name WHEN 2 THEN 'cd x && go test' WHEN 3 THEN 'python3 ' || s_name ELSE 'ls ' || s_name END"""
BY_REPO = " ".join(f"WHEN list_bool_or(list_transform({LISTS(words)}, lambda w: contains(lower(repo), w))) THEN '{lang}'" for lang, words in REPO_WORDS.items())
BY_COMMAND = " ".join(f"WHEN regexp_matches(trim(run), '{pattern}') THEN '{lang}'" for lang, pattern in COMMANDS.items())


@query("language_of_repo", f"SELECT s_suppkey, CASE {BY_REPO} {BY_COMMAND} ELSE 'python' END AS language FROM (SELECT s_suppkey, {REPO} AS repo, {RUN} AS run FROM supplier)")
def language_of_repo(t):
    return t.supplier.select("s_suppkey", detect_language(F.expr(REPO), F.expr(RUN)).alias("language"))


PATH = """CASE WHEN l_linenumber % 3 = 0 THEN 'tests/check_' || l_partkey || '.py' ELSE 'src/m' || l_partkey || CASE WHEN l_linestatus = 'O' THEN '.txt' ELSE '.py' END END"""
PATCH = f"""CASE WHEN l_returnflag = 'N' THEN '--- /dev/null' || chr(10) || '+++ b/' || {PATH} || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+only ' || l_linestatus
ELSE '--- a/' || {PATH} || chr(10) || '+++ b/' || {PATH} || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' same' || chr(10) || '-old ' || l_returnflag || chr(10) || '+new' || CASE WHEN l_quantity > 25 THEN chr(10) || '@@ -9 +9,2 @@' || chr(10) || ' x' || chr(10) || '+y' ELSE '' END END"""


@query("commit_counters", f"""WITH {joined_view(PATCH)}, f AS (SELECT k, unnest(string_split(x, '--- ')[2:]) AS f FROM v),
g AS (SELECT k, regexp_extract(f, '\\+\\+\\+ b/([^\\n]+)', 1) AS path, string_split(f, chr(10))[3:] AS ls FROM f),
h AS (SELECT k, path, len(list_filter(ls, lambda l: starts_with(l, '@@ '))) AS hunks, len(list_filter(ls, lambda l: starts_with(l, '+'))) AS added, len(list_filter(ls, lambda l: starts_with(l, '-'))) AS deleted,
  list_bool_or(list_transform(string_split(path, '/'), lambda p: p IN ('tests', 'Tests', 'test', 'Test'))) OR ends_with(path, '_test.py') OR starts_with(path, 'test_') OR starts_with(string_split(path, '/')[-1], 'test_') AS test FROM g)
SELECT k, count(DISTINCT path) AS files, count(DISTINCT CASE WHEN test THEN path END) AS test_files, sum(hunks)::BIGINT AS hunks, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, sum(added + deleted)::BIGINT AS edited_lines,
  coalesce(sum(added + deleted) FILTER (WHERE NOT test), 0)::BIGINT AS other_edited_lines, list_sort(list(DISTINCT regexp_extract(string_split(path, '/')[-1], '[^.](\\.[^.]+)$', 1))) AS extensions FROM h GROUP BY k""")
def commit_counters(t):
    return commits.commit_counters(patch_rows(joined(t, PATCH), "k", "x"), "k")


@query("patch_round_trip", f"WITH {joined_view(PATCH)} SELECT k, x || chr(10) AS patch FROM v")
def patch_round_trip(t):
    return commits.rebuilt(patch_rows(joined(t, PATCH), "k", "x"), "k")


ACTION = """'<function=file_editor><parameter=command>' || CASE l_returnflag WHEN 'A' THEN 'create' WHEN 'N' THEN 'view' ELSE CASE WHEN l_linestatus = 'F' THEN 'insert' ELSE 'str_replace' END END || '</parameter><parameter=path>/p' || (l_partkey % 5) || '.py</parameter></function>'"""


@query("touched_files", f"""WITH s AS (SELECT l_orderkey AS k, {ACTION} AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY {STEP}) AS i FROM lineitem),
a AS (SELECT k, i, regexp_extract(x, '<parameter=command>(.*?)</parameter>', 1) AS c, regexp_extract(x, '<parameter=path>(.*?)</parameter>', 1) AS p FROM s),
d AS (SELECT k, CASE WHEN c = 'create' THEN 0 WHEN c = 'view' THEN 2 WHEN c IN ('str_replace', 'insert', 'edit') THEN 1 END AS g, p, min(i) AS i FROM a GROUP BY ALL)
SELECT k, coalesce(list(p ORDER BY i) FILTER (WHERE g = 0), []) AS created, coalesce(list(p ORDER BY i) FILTER (WHERE g = 1), []) AS edited, coalesce(list(p ORDER BY i) FILTER (WHERE g = 2), []) AS viewed FROM d GROUP BY k""")
def touched_files(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.struct(*STEP.split(", "), F.expr(ACTION).alias("x")).alias("s")).groupBy("k").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select("k", commits.touched_files(F.transform("s", lambda s: text.action_params(s["x"]))).alias("r")).select("k", "r.*")


# ---- single values, made of parts ----

PART = ["p_partkey"]
TAGS = """p_brand || CASE p_size % 3 WHEN 0 THEN ' *x' WHEN 1 THEN ' *' || p_size || ' *' || p_partkey ELSE ' *x *' || (100 * p_size) END"""


@query("tag_ratings", f"WITH {view('part', PART, TAGS)} SELECT p_partkey, coalesce(CAST(substr(list_filter(string_split(x, ' '), lambda t: regexp_full_match(t, '\\*\\d+'))[1], 2) AS INT), 0) AS rating FROM v")
def tag_ratings(t):
    return made(t, "part", PART, TAGS).select("p_partkey", text.rating_of_tags(F.split("x", " ")).alias("rating"))


LEVEL = "CASE p_size % 3 WHEN 0 THEN p_name ELSE p_brand || '  ' || p_size || CASE p_size % 3 WHEN 1 THEN '.5 ' ELSE '' END END"


@query("level_numbers", f"WITH {view('part', PART, LEVEL)} SELECT p_partkey, coalesce(TRY_CAST(list_extract(string_split_regex(trim(x), '\\s+'), -1) AS DOUBLE), 0.0) AS level FROM v")
def level_numbers(t):
    return made(t, "part", PART, LEVEL).select("p_partkey", shape.level_number(F.col("x")).alias("level"))


IMPORTS = "'import x' || chr(10) || CASE WHEN p_size % 4 = 0 THEN 'import solution' ELSE 'from solution import ' || replace(p_name, ' ', ', ') || chr(10) || 'from  solution import  p' || p_size || ',' || split_part(p_name, ' ', 1) || ', ' END"


@query("starter_code", f"""WITH {view('part', PART, IMPORTS)}, n AS (SELECT p_partkey, list_filter(list_transform(flatten(list_transform(regexp_extract_all(x, '(?m)^from[ ]+solution[ ]+import[ ]+(.+)$', 1), lambda y: string_split(y, ','))), lambda y: trim(y)), lambda y: y <> '') AS n FROM v),
d AS (SELECT p_partkey, list_filter(n, lambda y, i: list_position(n, y) = i) AS n FROM n) SELECT p_partkey, coalesce(array_to_string(list_transform(n, lambda y: 'def ' || y || '(*args, **kwargs):' || chr(10) || '    pass'), chr(10) || chr(10)), '') AS code FROM d""")
def starter_code(t):
    return made(t, "part", PART, IMPORTS).select("p_partkey", shape.starter_code(F.col("x")).alias("code"))


IMAGE = "CASE WHEN p_brand LIKE 'Brand#1%' THEN 'ghcr.io/epoch-research/' || p_name WHEN p_size < 10 THEN 'xingyaoww/' || p_brand || '.swebench' WHEN p_size < 20 THEN p_name || '/swebench' WHEN p_size < 30 THEN 'swerebench/' || p_name ELSE p_brand END"
FAMILY = "CASE " + " ".join(f"WHEN contains(x, '{k}') THEN '{v}'" for k, v in shape.IMAGE_FAMILIES) + " ELSE 'others' END"


@query("spec_paths", f"WITH {view('part', PART + ['p_brand'], IMAGE)} SELECT p_partkey, 'specs/' || {FAMILY} || '/' || p_brand || '.json' AS path FROM v")
def spec_paths(t):
    return made(t, "part", [*PART, "p_brand"], IMAGE).select("p_partkey", shape.spec_path("specs/", F.col("x"), F.col("p_brand")).alias("path"))


@query("terminal_rewards", f"""SELECT DISTINCT reason, CASE WHEN reason = 'GARBLED_OUTPUT' THEN -0.5 WHEN reason IN ('MAX_STEPS', 'TRAJ_TIMEOUT', 'TRUNCATION') THEN 0 ELSE 1 END::DOUBLE AS reward,
reason IN ('PROMPT_TRUNCATION', 'ENV_TIMEOUT', 'ENCODE_ERROR', 'REWARD_TIMEOUT', 'REPORT_JSON_LOAD_FAILED') AS masked FROM ({SQL['terminations']}) WHERE reason IS NOT NULL""")
def terminal_rewards(t):
    return terminations(t).select("reason").filter("reason is not null").distinct().select("reason", chat.terminal_reward(F.col("reason"), F.lit(1.0)).alias("reward"), chat.masked_out(F.col("reason")).alias("masked"))


COLOURED = "chr(27) || '[' || p_size || 'm' || p_name || chr(27) || '[0;1m ' || p_brand || chr(27) || '[m' || CASE WHEN p_size % 2 = 0 THEN chr(27) || '[x' || p_size || 'm' ELSE '' END"


@query("strip_ansi", f"WITH {view('part', PART, COLOURED)} SELECT p_partkey, regexp_replace(x, chr(27) || '\\[[0-9;]*m', '', 'g') AS name FROM v")
def strip_ansi(t):
    return made(t, "part", PART, COLOURED).select("p_partkey", text.strip_ansi(F.col("x")).alias("name"))


REPORT = """p_name || chr(10) || CASE WHEN p_size % 2 = 0 THEN '== ' || p_brand || ' ==' || chr(10) ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'Traceback ' ELSE 'tail ' END || p_size || CASE WHEN p_size % 7 = 0 THEN chr(10) || 'x=' || p_size || chr(10) || 'end' ELSE '' END"""


@query("report_tails", f"""WITH {view('part', PART, REPORT)}, l AS (SELECT p_partkey, x, string_split(x, chr(10)) AS ls FROM v),
m AS (SELECT *, list_max(list_transform(ls, lambda y, i: CASE WHEN contains(y, '=') THEN i ELSE 0 END)) AS last FROM l)
SELECT p_partkey, CASE WHEN last = 0 OR contains(array_to_string(ls[last + 1:], chr(10)), 'Traceback') THEN x ELSE array_to_string(ls[1:last], chr(10)) END AS report FROM m""")
def report_tails(t):
    return made(t, "part", PART, REPORT).select("p_partkey", text.report_tail_cut(F.col("x")).alias("report"))


THOUGHT = """CASE p_size % 3 WHEN 0 THEN '<think>{"reward": 9}' || p_name || '</think> ' ELSE '' END || CASE p_size % 4 WHEN 0 THEN p_name ELSE '{"a": 1, "reward": ' || p_size || '.5}' END"""


@query("simulated_rewards", f"""WITH {view('part', PART, THOUGHT)}, a AS (SELECT p_partkey, {stripped("list_extract(string_split(x, '</think>'), -1)")} AS y FROM v) SELECT p_partkey, coalesce(TRY_CAST(CASE WHEN json_valid(y) THEN json_extract_string(y, '$.reward') END AS DOUBLE), {float(text.REWARD_FAILED)})::DOUBLE AS reward FROM a""")
def simulated_rewards(t):
    return made(t, "part", PART, THOUGHT).select("p_partkey", text.simulated_reward(F.col("x")).alias("reward"))


LISTED = """CASE p_size % 4 WHEN 0 THEN ' ["' || replace(p_name, ' ', '", "') || '"]' WHEN 1 THEN p_name WHEN 2 THEN '  ' || chr(10) ELSE '[' || p_name END"""


@query("robust_lists", f"""WITH {view('part', PART, LISTED)} SELECT p_partkey, CASE WHEN {stripped('x')} = '' THEN []::VARCHAR[] WHEN starts_with({stripped('x')}, '[') AND json_valid(x) THEN json_extract_string(x, '$[*]') ELSE [x] END AS items FROM v""")
def robust_lists(t):
    return made(t, "part", PART, LISTED).select("p_partkey", text.robust_list(F.col("x")).alias("items"))


TAGGED = """CASE p_size % 3 WHEN 0 THEN '<sim_reasoning> ' || p_name || ' <sim_reasoning>' || p_brand || ' </sim_reasoning> c</sim_reasoning> d' WHEN 1 THEN p_name || ' ' ELSE '</sim_reasoning>' || p_name || '<sim_reasoning>' END"""


@query("reasoning_texts", f"""WITH {view('part', PART, TAGGED)}, a AS (SELECT p_partkey, x, CASE WHEN contains(x, '<sim_reasoning>') THEN string_split(substr(x, strpos(x, '<sim_reasoning>') + 15), '</sim_reasoning>') ELSE [x] END AS p FROM v)
SELECT p_partkey, {stripped("CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], '</sim_reasoning>') ELSE x END")} AS reasoning FROM a""")
def reasoning_texts(t):
    return made(t, "part", PART, TAGGED).select("p_partkey", text.reasoning_text(F.col("x")).alias("reasoning"))


FILE = "replace(p_name, ' ', '/') || CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.d/' || p_brand WHEN 2 THEN '/.' || p_brand ELSE '.tar.g' || p_size END"


@query("file_extensions", f"WITH {view('part', PART, FILE)} SELECT p_partkey, regexp_extract(list_extract(string_split(x, '/'), -1), '[^.](\\.[^.]+)$', 1) AS extension FROM v")
def file_extensions(t):
    return made(t, "part", PART, FILE).select("p_partkey", text.file_extension(F.col("x")).alias("extension"))


OBSERVED = "p_name || CASE p_size % 4 WHEN 0 THEN ' Error: failed ' || chr(10) || chr(9) WHEN 1 THEN 'Error: failed. Not so' WHEN 2 THEN ' Error: failed' ELSE '' END"


@query("error_steps", f"WITH {view('part', PART, OBSERVED)} SELECT p_partkey, ends_with(rtrim(x, {BLANKS}), 'Error: failed') AS failed FROM v")
def error_steps(t):
    return made(t, "part", PART, OBSERVED).select("p_partkey", text.ends_with_error(F.col("x"), "Error: failed").alias("failed"))


FIRST = "' ' || p_size || '.0 2' || chr(10) || p_name || chr(10) || p_brand || ' 1'"
SECOND = "p_size || '  2.00 ' || chr(10) || CASE p_size % 4 WHEN 0 THEN p_name || ' ' WHEN 1 THEN p_name || 'x' ELSE p_name END || chr(10) || p_brand || CASE p_size % 4 WHEN 2 THEN ' 1.0' ELSE ' 1' END || CASE p_size % 5 WHEN 0 THEN chr(10) || '3' ELSE chr(10) END"
SAME_LINE = "z[1] = z[2] OR (len(string_split_regex(z[1], '\\s+')) = len(string_split_regex(z[2], '\\s+')) AND list_bool_and(list_transform(list_zip(string_split_regex(z[1], '\\s+'), string_split_regex(z[2], '\\s+')), lambda w: coalesce(TRY_CAST(w[1] AS DECIMAL(38, 12)) = TRY_CAST(w[2] AS DECIMAL(38, 12)), false))))"


@query("same_outputs", f"""WITH v AS (SELECT p_partkey, list_transform(string_split({stripped(FIRST)}, chr(10)), lambda l: {stripped('l')}) AS a, list_transform(string_split({stripped(SECOND)}, chr(10)), lambda l: {stripped('l')}) AS b FROM part)
SELECT p_partkey, len(a) = len(b) AND list_bool_and(list_transform(list_zip(a, b), lambda z: {SAME_LINE})) AS same FROM v""")
def same_outputs(t):
    return t.part.select("p_partkey", text.same_stdout(F.expr(FIRST), F.expr(SECOND)).alias("same"))


HEADER = "CASE p_size % 4 WHEN 0 THEN 'src/test_' || p_brand WHEN 1 THEN 'x/tests/' || p_name WHEN 2 THEN p_name || '_test.py' ELSE 'src/' || p_name || '/test.py' END"


@query("header_test_paths", f"WITH {view('part', PART, HEADER)} SELECT p_partkey, contains(x, 'test_') OR contains(x, 'tests/') OR ends_with(x, '_test.py') AS is_test FROM v")
def header_test_paths(t):
    return made(t, "part", PART, HEADER).select("p_partkey", text.header_test_path(F.col("x")).alias("is_test"))


# Answers that the first rules of the cascade find; its later rules have tests of their own.
ANSWER = """CASE p_size % 6 WHEN 0 THEN '<think>**no**</think> so boxed{a {' || p_name || '} c} on 1/2/2020' WHEN 1 THEN 'it is **' || p_name || '** of 1999' WHEN 2 THEN 'on ' || (1 + p_size % 12) || '/05/2020 ' || p_name WHEN 3 THEN p_name || ' in ' || (1900 + p_size) || ' or 1850'
WHEN 4 THEN 'when Marie ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2, 2) || ' spoke' ELSE p_name || ' about ' || p_size || ',200 votes of 3' END"""


@query("answers_found", f"""WITH {view('part', PART, ANSWER)}, s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(x, '(?s)<think>.*?</think>', '', 'g'), '\\s+', ' ', 'g')) AS x FROM v)
SELECT p_partkey, coalesce(nullif(regexp_extract(x, 'boxed\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 1), ''), nullif(regexp_extract(x, '\\*\\*([^*]+)\\*\\*', 1), ''), nullif(regexp_extract(x, '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}\\b'), ''), nullif(regexp_extract(x, '\\b\\d{{4}}\\b'), ''),
nullif(regexp_extract(x, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'), ''), nullif(regexp_extract(x, '\\b(\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)\\s*(?:votes?)\\b', 1), '')) AS answer FROM s""")
def answers_found(t):
    return made(t, "part", PART, ANSWER).select("p_partkey", text.answer_cascade(F.col("x")).alias("answer"))


# Pairs of expressions with numbers of parts: a product or quotient, and its parts multiplied out, one of them wrong for some rows.
NUMBERS = "p_size % 5 + 1 AS a, p_partkey % 7 + 1 AS b, p_size % 3 + 1 AS c, CAST(p_partkey % 11 - 5 AS INT) AS d, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS off, p_partkey % 3 AS kind"
GIVEN = "CASE kind WHEN 0 THEN '(' || a || 'x+' || b || ')(x-' || c || ')' WHEN 1 THEN chr(92) || 'frac{' || a || '}{x}+' || chr(92) || 'frac{' || b || '}{x+' || c || '}' ELSE '(x+' || a || 'y)^2-(' || d || ')xy' END"
TRUTH = """CASE kind WHEN 0 THEN a || 'x^2+(' || (b - a * c + off) || ')x-' || (b * c) WHEN 1 THEN '(' || (a + b) || 'x+' || (a * c + off) || ')/(x^2+' || c || 'x)' ELSE 'x^2+(' || (2 * a - d - off) || ')xy+' || (a * a) || 'y^2' END"""


@query("expression_pairs", f"""WITH n AS (SELECT p_partkey, {NUMBERS} FROM part),
c AS (SELECT p_partkey, kind, CASE kind WHEN 0 THEN [a, b - a * c, -b * c] WHEN 1 THEN [0, a + b, a * c] ELSE [1, 2 * a - d, a * a] END AS given, CASE kind WHEN 0 THEN [a, b - a * c + off, -b * c] WHEN 1 THEN [0, a + b, a * c + off] ELSE [1, 2 * a - d - off, a * a] END AS truth FROM n)
SELECT p_partkey, given = truth AS same FROM c""")
def expression_pairs(t):
    """Polynomials and quotients are equal if their coefficients over one denominator are."""
    from trajlake.functions.udfs import math_equal_udf

    df = t.part.selectExpr("p_partkey", *NUMBERS.split(", ")[:3], "CAST(p_partkey % 11 - 5 AS INT) AS d", *NUMBERS.split(", ")[4:])
    return df.select("p_partkey", math_equal_udf(F.expr(GIVEN), F.expr(TRUTH)).alias("same"))


@query("condensed_chats", """WITH a AS (SELECT conv_id, turn, role, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, min(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id) AS first FROM a),
c AS (SELECT *, CASE WHEN role = 'user' AND i <> first THEN 0 WHEN role <> 'user' AND n > 9 THEN 1 END AS turn_of FROM b WHERE text <> '(omitted)'),
d AS (SELECT *, total - coalesce(sum(n - 9) OVER (PARTITION BY conv_id ORDER BY turn_of, CASE turn_of WHEN 0 THEN i ELSE -n END, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains FROM c WHERE turn_of IS NOT NULL),
e AS (SELECT conv_id, i, min(remains) OVER (PARTITION BY conv_id ORDER BY turn_of, CASE turn_of WHEN 0 THEN i ELSE -n END, i ROWS UNBOUNDED PRECEDING) > 600 AS gone FROM d)
SELECT a.conv_id, a.turn, CASE WHEN coalesce(gone, false) THEN '(omitted)' ELSE text END AS condensed FROM a LEFT JOIN e ON a.conv_id = e.conv_id AND a.i = e.i""")
def condensed_chats(t):
    return condense(t.conversations, "conv_id", ["turn", "role", "text"], "role", "text", 600).select("conv_id", "turn", "condensed")
