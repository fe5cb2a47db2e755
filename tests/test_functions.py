"""Quirks of the rules, on rows made for them."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from trajlake.functions import chat, garbled, text, udfs
from trajlake.operators import filters, joins, metrics, rank, returns, shape

LOG = """collected 6 items
=========================== short test summary info ============================
PASSED tests/test_a.py::TestA::test_one
PASSED tests/test_a.py::test_two[x-1]
FAILED tests/test_a.py::TestA::test_three - AssertionError: no
ERROR tests/test_b.py::test_four - ValueError
FAILED tests/test_a.py::test_two[x-1] - flaky
== 2 failed, 1 passed in 0.1s =="""


def one(spark, value, *columns, ddl="x string"):
    return spark.createDataFrame([value if isinstance(value, tuple) else (value,)], ddl).select(*columns).first()


def test_log_and_status_maps(spark):
    m = one(spark, LOG, text.status_map(F.col("x")).alias("m"))["m"]
    assert m == {"TestA.test_one": "PASSED", "test_two[x-1]": "FAILED", "TestA.test_three": "FAILED", "test_four": "ERROR"}
    assert one(spark, "nothing here", text.status_map(F.col("x")).alias("m"))["m"] == {}
    got = one(spark, ({"a - b": "PASSED", "\u001b[31mc\u001b[0m": "FAILED", "": "PASSED"},), text.clean_status_map(F.col("m")).alias("m"), ddl="m map<string,string>")["m"]
    assert got == {"a": "PASSED", "c": "FAILED"}


def test_markers_and_tags(spark):
    assert tuple(one(spark, "[STDOUT] a [STDERR] b [STDERR] c", text.out_and_err(F.col("x")).alias("r"))["r"]) == ("a [STDERR] b", "c")
    r = one(spark, 'a</think>b</think>{"reward":1}', text.after_thinking(F.col("x")).alias("a"), text.simulated_reward(F.col("x")).alias("b"))
    assert r["a"] == '{"reward":1}' and r["b"] == 1.0
    assert one(spark, "no json", text.simulated_reward(F.col("x")).alias("b"))["b"] == text.REWARD_FAILED
    assert one(spark, "x <sim_reasoning> a </sim_reasoning> b </sim_reasoning> y", text.reasoning_text(F.col("x")).alias("r"))["r"] == "a </sim_reasoning> b"
    assert one(spark, "t [ISSUE] the issue [/ISSUE] u", text.issue_statement(F.col("x")).alias("r"))["r"] == "the issue"


def test_code_lists_and_ranges(spark):
    assert one(spark, "```\na\n```\n```py\nb\n```", text.last_code_block(F.col("x")).alias("r"))["r"] == "b"
    assert one(spark, "none", text.last_code_block(F.col("x")).alias("r"))["r"] is None
    for value, want in (('["a"]', ["a"]), ("abc", ["abc"]), ("", []), (None, [])):
        assert one(spark, (value,), text.robust_list(F.col("x")).alias("r"))["r"] == want
    assert one(spark, "[3, 10]", text.line_range_length(F.col("x")).alias("r"))["r"] == 8
    assert one(spark, "[3, -1]", text.line_range_length(F.col("x")).alias("r"))["r"] is None
    r = one(spark, "\tab ab", text.exact_once_replace(F.col("x"), "ab", "c").alias("r"), text.exact_once_replace(F.col("x"), "\tab", "c").alias("s"))
    assert (r["r"]["ok"], r["r"]["n"]) == (False, 2) and r["s"]["text"] == "c ab"


def test_answers(spark):
    f1 = lambda a, b: one(spark, (a, b), text.token_f1(F.col("a"), F.col("b")).alias("r"), ddl="a string, b string")["r"]["f1"]
    assert f1("yes", "no") == 0 and f1("the Cat", "cat") == 1 and f1("a b c d", "b c x") == pytest.approx(2 * (2 / 3) * (2 / 3) / (4 / 3), abs=1e-9)
    r = one(spark, ("the Cat", ["dog", "cat"]), text.best_f1(F.col("a"), F.col("b")).alias("r"), ddl="a string, b array<string>")["r"]
    assert r["exact"] and r["reward"] == 1.0
    same = lambda a, b: one(spark, (a, b), text.same_stdout(F.col("a"), F.col("b")).alias("r"), ddl="a string, b string")["r"]
    assert same("1.0 2\nx", "1 2.00\nx \n") and not same("1\n2", "1") and not same("a", "b")
    assert one(spark, r"so \boxed{7}", text.answer_cascade(F.col("x")).alias("r"))["r"] == "7"


def test_passes_and_metrics(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "t int, p int")
    r = metrics.classifier_metrics(df, "t", "p").first()
    assert (r["precision"], r["f1"], r["mcc"], r["recall"]) == (0, 0, 0, 0)
    assert one(spark, (["3.0", "x", "error"],), metrics.difficulty(F.col("s")).alias("r"), ddl="s array<string>")["r"] == 3.0
    assert one(spark, (["x"],), metrics.difficulty(F.col("s")).alias("r"), ddl="s array<string>")["r"] is None
    assert one(spark, ([0.0, 0.0, 1.0],), returns.mc_return(F.col("r"), 0.2).alias("g"), ddl="r array<double>")["g"] == pytest.approx([0.04, 0.2, 1.0])
    ties = spark.createDataFrame([(1, i, s, 0) for i, s in enumerate((5, 4, 4, 3))], "g int, id int, s int, z int")
    w = rank.topk_ties_then_max(ties, "g", "s", 2, "id", "id").first()
    assert w["id"] == 2  # three rows count, the greatest id of them wins
    key = lambda v: one(spark, (v,), metrics.problem_key(F.col("m")).alias("k"), ddl="m map<string,string>")["k"]
    assert key({"a": "1", "b": "2"}) == key({"b": "2", "a": "1"}) != key({"a": "2"})


def test_elo(spark):
    place = [(7, f"h{i}", i, 100.0 - i / 10, 0.0, 1000 + i) for i in range(300)]
    args = [
        spark.createDataFrame([(7,), (8,)], "contest_id long"), spark.createDataFrame(place + [(8, "x", 0, 1.0, 0.0, 1500)], "contest_id long, handle string, place int, points double, penalty double, old_rating long"),
        spark.createDataFrame([(7, "A", 100.0), (7, "B", None), (8, "A", 1.0)], "contest_id long, index string, points double"),
        spark.createDataFrame([("7A", [False, True]), ("7B", [False, False, True]), ("8A", [True])], "problem_id string, passed array<boolean>"), spark.createDataFrame([(1000 + i,) for i in range(300)], "rating long"),
    ]
    (r,) = metrics.elo(*args).collect()
    assert (r["contest_id"], r["score"], r["penalty"]) == (7, 51.0, 20.0) and r["rank"] == 300
    seed = lambda x: 1 + sum(1 / (1 + 10 ** ((x - 1000 - i) / 400)) for i in range(300))
    assert seed(r["rating"]) >= 300 or r["rating"] == 0
    assert r["percentile"] == 0.0


def test_outcomes_and_recall(spark):
    out = lambda a, b: one(spark, (a, b), joins.run_outcome(F.col("a"), F.col("b")).alias("r"), ddl="a map<string,string>, b map<string,string>")["r"]
    assert out({"x": "PASSED"}, {"y": "PASSED"})["outcome"] == "FAIL_AT_TEST_RUN"
    assert out({"x": "PASSED", "y": "FAILED"}, {"x": "FAILED", "y": "PASSED"})["outcome"] == "NEW_COMMIT_WORSE"
    assert tuple(out({"x[1]": "FAILED"}, {"x[1]": "PASSED"})) == ("NEW_COMMIT_BETTER", ["x"])
    assert out({"x": "FAILED"}, {"x": "FAILED"})["outcome"] == "NEW_COMMIT_NOT_BETTER"
    assert one(spark, ([], ["a"]), joins.recall(F.col("b"), F.col("a")).alias("r"), ddl="a array<string>, b array<string>")["r"] == 1.0
    equal = lambda a, b: one(spark, (a, b), joins.maps_equal(F.col("a"), F.col("b")).alias("r"), ddl="a map<string,string>, b map<string,string>")["r"]
    assert equal({"a": "P"}, {"a": "P"}) == 1 and equal({"a": "P"}, {"a": "F"}) == 0 and equal({"a": "P", "": "x"}, {"a": "P", "": "y"}) == 1
    assert one(spark, "Fixes #3 and closes: #4, see #9", joins.closed_issues(F.col("x")).alias("r"))["r"] == [3, 4]


def transcript(*roles_and_texts):
    return [{"role": r, "content": c} for r, c in roles_and_texts]


def test_transcript_filter(spark):
    ddl = "input array<struct<role:string,content:string>>, token_usage_total long, step_count int, reward int"
    good = transcript(("user", "q"), ("assistant", "<function=submit></function>"), ("tool", "ok"))
    broken = transcript(("user", "q"), ("assistant", "<function=>\n </function>"), ("tool", "?"), ("assistant", "z"), ("tool", "y"))
    rows = [(good, 81919, 5, 1), (good, 81920, 5, 1), (good, 1, 100, 1), (good[:2] + transcript(("user", "bye")), 1, 5, 1), (good, 1, 5, 0), (broken, 1, 5, 1)]
    kept, counts = filters.sft_filter(spark.createDataFrame(rows, ddl))
    got = [[m["content"] for m in r["input"]] for r in kept.collect()]
    assert got == [["q", "<function=submit></function>"]]
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"max_token_limit": 1, "max_step_limit": 1, "final_role_not_tool": 1, "submit_with_paras": 1}


def test_shapes(spark):
    r = one(spark, (["a", "b", "a"], ["1", "2"]), shape.zipped_map(F.col("n"), F.col("c")).alias("r"), ddl="n array<string>, c array<string>")["r"]
    assert r["m"] == {"a": "1", "b": "2"} and r["mismatch"]
    r = one(spark, (["i", "j"], ["o"]), shape.io_tests(F.col("a"), F.col("b")).alias("r"), ddl="a array<string>, b array<string>")["r"]
    assert [tuple(x) for x in r] == [("i", "o"), ("j", "o")]
    assert one(spark, '"[1, 2]"', F.to_json(shape.parsed_json(F.col("x"))).alias("r"))["r"] == "[1,2]"
    assert one(spark, (["x", "*1500", "*2"],), text.rating_of_tags(F.col("t")).alias("r"), ddl="t array<string>")["r"] == 1500
    assert one(spark, "from solution import f, g", shape.starter_code(F.col("x")).alias("r"))["r"].count("def ") == 2


def test_chat(spark):
    m = transcript(("user", "hi"), ("assistant", "yo"), ("user", "and"), ("assistant", "so"))
    ddl = "m array<struct<role:string,content:string>>"
    for name in chat.TEMPLATES:
        whole = one(spark, (m,), chat.render(F.col("m"), name).alias("r"), ddl=ddl)["r"]
        parts = [one(spark, (m[i : i + 1],), chat.render(F.col("m"), name, first=i == 0).alias("r"), ddl=ddl)["r"] for i in range(4)]
        assert whole == "".join(parts)
    r = one(spark, (["user", "assistant", "user", "assistant"], [3, 2, 1, 2]), chat.response_ranges(F.col("a"), F.col("b")).alias("r"), ddl="a array<string>, b array<int>")["r"]
    assert [tuple(x) for x in r] == [(3, 4), (6, 7)]
    mask = one(spark, ([(3, 4), (6, 7)], 8), chat.loss_mask(F.col("r"), F.col("n")).alias("m"), ddl="r array<struct<start:int,end:int>>, n int")["m"]
    assert mask == [0, 0, 1, 1, 0, 1, 1, 0]
    calls = one(spark, '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>bad</tool_call>', chat.tool_calls(F.col("x")).alias("r"))["r"]
    assert [tuple(c) for c in calls] == [("f", '{"a":1}')]
    p = one(spark, ([5, 6],), chat.padded(F.col("t"), 4, 0, left=True).alias("p"), ddl="t array<int>")["p"]
    assert (p["ids"], p["mask"], p["positions"]) == ([0, 0, 5, 6], [0, 0, 1, 1], [0, 0, 0, 1])


def test_garbled(spark):
    for value, want in (("plain english text here", False), ("ok �� 中文字符中文字 кириллица abcdefg", True), ("short", False), ("{{{}}}((()))<<<>>>||| a", True)):
        assert one(spark, value, garbled.is_garbled(F.col("x")).alias("g"))["g"] is want, value


def test_udfs(spark):
    assert udfs.boxed(r"a \boxed{1} b \boxed{\frac{1}{2}}") == r"\frac{1}{2}" and udfs.boxed("x") is None
    assert udfs.math_equal(r"\frac{1}{2}", "1/2") and udfs.math_equal("1,000", "1000") and udfs.math_equal("0.5", "1/2") and not udfs.math_equal("2/4", "1/2") and udfs.math_equal("(1,2)", "(1, 2)") and not udfs.math_equal("2+2", "4")
    assert udfs.math_reward("no tag \\boxed{1}", ["1"]) == (0.0, False, True) and udfs.math_reward("</think> \\boxed{1}", ["2", "1"])[0] == 1.0
    ok, why, report = udfs.test_report("x\n" + "=" * 29 + " test session starts " + "=" * 30 + "\na\n>>>>> End Test Output\n", "python")
    assert ok and report.endswith("a\n") and udfs.test_report(udfs.TIMEOUT, "go") == (False, "timeout", "")
    assert udfs.test_report("running 2 tests\ntest a ... ok\ntest result: ok\nrest", "rust")[2].endswith("test result: ok\n")
    old, new = "a\nb\nc\n", "a\nB\nc\nd\n"
    rows = list(udfs.diff_lines(udfs.unified(old, new, "f.py")))
    assert "".join(r[5] + "\n" for r in rows if r[4] != "added") == old and "".join(r[5] + "\n" for r in rows if r[4] != "deleted") == new
    with pytest.raises(ValueError):
        list(udfs.diff_lines("diff --git a/x b/y\nrename from x\nrename to y\n"))
    assert udfs.without_main("a\nif __name__ == '__main__':\n    run()\n\nb") == "a\nb"
    assert udfs.inline_code("python -c 'x'") and udfs.inline_code("cat <<EOF\nEOF") and not udfs.inline_code("python a.py")
    assert udfs.setup_and_test("set -e\ncat <<'E'\nx\nE\npytest -q\nrm x") == (["set -e", "cat <<'E'\nx\nE"], "pytest -q")
    assert [t for _, t in udfs.condensed([("user", "keep"), ("assistant", "a" * 30), ("user", "b" * 30)], 60)] == ["keep", "a" * 30, "(omitted)"]
    df = spark.createDataFrame([("def f():\n    'doc'\n    return 1", "def f():\n    return 1"), ("a = 1", "a = 2")], "a string, b string")
    assert [r[0] for r in df.select(udfs.changes_code("a", "b")).collect()] == [False, True]
    assert udfs.patch_rows(spark.createDataFrame([(1, udfs.unified(old, new, "f.py"))], "id int, patch string"), "id", "patch").filter("kind = 'added'").count() == 2
    r = spark.createDataFrame([(LOG, "python")], "log string, lang string").select(udfs.test_report_udf("log", "lang").alias("r")).first()["r"]
    assert r["ok"] is False


def test_transcripts_of_steps(spark):
    ddl = "trajectory_steps array<struct<thought:string,action:string,observation:string,token_usage_total:int,step_count:int>>, problem_statement string, working_dir string, reward double"
    df = spark.createDataFrame([([("t", "a", "o", 5, 1), ("u", "b", "p", 9, 2)], "fix it", "/w", 1.0)], ddl)
    r = shape.trajectories_to_sft(df, "S", "FN", "Do {problem_statement} in {working_dir}").first()
    assert [m["content"] for m in r["input"]] == ["S", "FN", "Do fix it in /w", "t\n\na", "o", "u\n\nb", "p"] and (r["token_usage_total"], r["step_count"]) == (9, 2)


@pytest.mark.parametrize("given,truth,same", [
    (r"\frac{\frac{1}{2}}{3}", "1/6", True), (r"2\sqrt{\frac{1}{4}}", "1.0", False), (r"\sqrt{\frac{1}{4}}", "0.5", True), (r"1\frac{2}{3}", "1 2/3", True), (r"\sqrt[3]{8}", "x", False),
    ("x+y", "y+x", True), ("(x+1)(x-1)", "x^2-1", True), ("2xy", "yx*2", True), (r"\frac{x^2-1}{x-1}", "x+1", True), ("x+1", "x+2", False), ("a+b+c", "c+b+a", False), (r"2\pi r", r"r\cdot 2\pi", True),
    (r"\sin(x)^2+\cos(x)^2", "x/x", True), ("x^{10}", "x^10", True), ("x^{10}x", "x^{11}", False), ("log(x)", "log(y)", False), ("sqrt(0-1-x^2)", "sqrt(0-2-x^2)", False), (r"\left(1, \frac{3}{2}\right)", "(1,3/2)", True),
])
def test_expressions(given, truth, same):
    assert udfs.math_equal(given, truth) is same


def test_failure_blocks_and_token_cuts(spark, tmp_path):
    log = "=== FAILURES ===\n____ test_a ____\nline 1\n\nE  assert\n____ TestB.test_c[x] ____\nother\n=== short test summary info ===\nFAILED test_a"
    assert one(spark, log, udfs.failure_blocks("x").alias("m"))["m"] == {"test_a": "line 1\n\nE  assert", "TestB.test_c[x]": "other"}
    assert one(spark, "fine", udfs.failure_blocks("x").alias("m"))["m"] == {}
    import public_tokenizers
    from tokenizers import Tokenizer

    path = next(public_tokenizers.path(n) for n in sorted(os.listdir(os.path.dirname(public_tokenizers.__file__))) if n.endswith(".json"))
    t, long = Tokenizer.from_file(path), "some words that are cut somewhere, and more of them"
    got = [r["r"] for r in spark.createDataFrame([(long,), ("short",), (None,)], "x string").select(udfs.truncate_tokens_udf(path, 5)("x").alias("r")).collect()]
    assert got == [t.decode(t.encode(long, add_special_tokens=False).ids[:5]), "short", None]


def test_rows_for_training(spark):
    tests = F.array(F.struct(F.lit("1").alias("input"), F.lit("2").alias("output")))
    meta = lambda name: F.struct(F.lit(name).cast("string").alias("func_name"))
    made = one(spark, "x", shape.tests_with_metadata(tests, meta("f")).alias("t"))["t"]
    assert json.loads(made) == [{"input": "1", "output": "2", "metadata": {"func_name": "f"}}]
    with pytest.raises(Exception, match="func_name"):
        one(spark, "x", shape.tests_with_metadata(tests, meta(None)).alias("t"))
    grid = shape.synthetic_grid(spark, 50, 7).collect()
    assert grid == shape.synthetic_grid(spark, 50, 7).collect() and len(grid) == 50 and all(2 <= r["size"] < 10 and 0.6 <= r["p"] < 0.85 for r in grid)


def test_replies_and_tools(spark):
    reply = lambda c: one(spark, c, filters.command_reply(F.col("x"), ["git"], ["wget"]).alias("r"))["r"]
    assert tuple(reply("pip install git x")) == ("Successfully installed packages.", 0) and "git is not" in reply("cd a; git log")["output"] and reply("legit") is None and "wget" in reply("wget")["output"]
    with pytest.raises(ValueError, match="no place for tools"):
        chat.render(F.col("x"), "llama", tools=["{}"])


@pytest.mark.parametrize("template", ["qwen", "deepseek", "llama"])
def test_a_chat_is_its_messages_one_by_one(spark, template):
    """The rendering of a chat equals that of its messages side by side, with the start text in front of the first only."""
    chats = [[("system", "s"), ("user", "u 1"), ("assistant", "a"), ("tool", "t"), ("assistant", "b\n")], [("user", "only")], [("user", "x"), ("assistant", "")]]
    df = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in m]) for i, m in enumerate(chats)], "i int, m array<struct<role:string,content:string>>")
    whole = {r["i"]: r["t"] for r in df.select("i", chat.render(F.col("m"), template).alias("t")).collect()}
    each = df.select("i", F.posexplode("m").alias("k", "x")).select("i", "k", F.array("x").alias("m"))
    parts = each.select("i", "k", F.when(F.col("k") == 0, chat.render(F.col("m"), template)).otherwise(chat.render(F.col("m"), template, first=False)).alias("t")).collect()
    assert whole == {i: "".join(r["t"] for r in sorted(parts, key=lambda r: r["k"]) if r["i"] == i) for i in whole}
    opened = {r["i"]: r["t"] for r in df.select("i", chat.render(F.col("m"), template, add_generation_prompt=True).alias("t")).collect()}
    assert all(opened[i] == whole[i] + chat.TEMPLATES[template]["open"] for i in whole)
