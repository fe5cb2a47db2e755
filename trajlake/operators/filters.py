"""Filter rules as named Columns, a funnel over an ordered list of them, and the transcript format filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.core import let
from trajlake.functions.text import strip

# Limits and phrases of the transcript format.
STEP_LIMITS = (100, 120, 150)
TOKEN_LIMIT = 81920
EMPTY_FINISH, FINISH = "<function=>", "<function=submit>"
EMPTY_BLOCK, SUBMIT_BLOCK, SUBMIT_LINES = "<function=></function>", "<function=submit></function>", "<function=submit>\n</function>"
HINT = "You forgot to use a function call in your response. "


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, i, kept): rows that pass the stages up to each, in one pass. A null condition doesn't pass."""
    held, cumulative = F.lit(True), []
    for name, condition in stages:
        held = held & F.coalesce(condition, F.lit(False))
        cumulative.append((name, held))
    one = df.agg(F.count("*").alias("c0"), *[F.count_if(c).alias(f"c{i + 1}") for i, (_, c) in enumerate(cumulative)])
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(i).alias("i"), F.col(f"c{i}").alias("kept")) for i, n in enumerate(["all", *[n for n, _ in cumulative]])])
    return one.select(F.inline(rows))


def cascade(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    for _, condition in stages:
        df = df.filter(condition)
    return df


def reasons(stages: list[tuple[str, Column]]) -> Column:
    """array<string> of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in stages]))


def repaired_messages(messages: Column) -> Column:
    """If the fourth message from the end, white space removed, holds an empty finish block, it becomes a submit there and
    the last two messages go."""
    n = F.size(messages)
    fourth = F.when(n >= 4, F.get(messages, n - 4)["content"])
    broken = F.coalesce(F.contains(F.regexp_replace(fourth, r"[\n ]", ""), F.lit(EMPTY_BLOCK)), F.lit(False))
    mended = F.transform(F.slice(messages, 1, F.greatest(n - 2, F.lit(0))), lambda m, i: F.when(i == n - 4, m.withField("content", F.replace(m["content"], F.lit(EMPTY_FINISH), F.lit(FINISH)))).otherwise(m))
    return F.when(broken, mended).otherwise(messages)


def sft_reject_reasons(messages: Column, step_count: Column, tokens: Column, hint: str = HINT, step_limits: tuple[int, ...] = STEP_LIMITS, token_limit: int = TOKEN_LIMIT) -> Column:
    """All reasons for which a repaired transcript is rejected; none: it is kept."""
    n = F.size(messages)
    body = F.array_join(F.transform(F.slice(messages, 1, F.greatest(n - 1, F.lit(0))), lambda m: m["content"]), "\n")
    before_last = F.when(n >= 2, F.get(messages, n - 2)["content"])
    # The names of reasons, in the order in which they are told.
    return reasons([
        ("have_hint_content", F.contains(body, F.lit(hint))),
        ("max_step_limit", step_count.isin(*step_limits)),
        ("max_token_limit", tokens >= token_limit),
        ("so_less_turn", n < 2),
        ("final_rool_not_submit", ~F.coalesce(F.contains(before_last, F.lit(FINISH)), F.lit(False))),
        ("submit_with_paras", ~F.coalesce(F.contains(before_last, F.lit(SUBMIT_LINES)) | F.contains(before_last, F.lit(SUBMIT_BLOCK)), F.lit(False))),
        ("final_role_not_tool", ~F.coalesce(F.get(messages, n - 1)["role"] == "tool", F.lit(False))),
    ])


def sft_filter(df: DataFrame, messages: str = "input", step_count: str = "step_count", tokens: str = "token_usage_total", reward: str = "reward") -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows with reward 1 and no reason, less their last message; and (reason, n), where a row may count twice."""
    fixed = df.filter(F.col(reward) == 1).withColumn(messages, repaired_messages(F.col(messages)))
    judged = fixed.withColumn("reject_reasons", sft_reject_reasons(F.col(messages), F.col(step_count), F.col(tokens)))
    kept = judged.filter(F.size("reject_reasons") == 0).withColumn(messages, F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))).drop("reject_reasons")
    return kept, judged.select(F.explode("reject_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def training_path(path: Column) -> Column:
    """Not a path of verified test instances, unless it names smith ones too."""
    return ~(F.contains(F.lower(path), F.lit("verified")) & ~F.contains(F.lower(path), F.lit("smith")))


def kodcode_rule(subset: Column, style: Column, pass_trial: Column, similarity: Column, test: Column, subsets: list[str]) -> Column:
    return subset.isin(*subsets) & (style == "instruct") & (pass_trial < 9) & (similarity < 0.9) & (F.regexp_count(test, F.lit("def")) >= 8)


def date_window(ts: Column, start: str, stop: str) -> Column:
    """start <= ts < stop: plain comparisons, which reach the scan."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(stop).cast("timestamp_ntz"))


def difficulty_band(d: Column) -> Column:
    return d.between(2, 5) | (d >= 10)


def usable_tests(tests: Column, broken: str = "_poly") -> Column:
    return F.coalesce(strip(tests) != "", F.lit(False)) & ~F.contains(tests, F.lit(broken))


def parseable_answer(answer: Column) -> Column:
    """A normalised answer that may be evaluated: at most two different letters outside sqrt and frac, no risky powers."""
    bare = F.replace(F.replace(answer, F.lit("sqrt"), F.lit("")), F.lit("frac"), F.lit(""))
    letters = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}]", ""), ""), lambda c: c != "")))
    risky = F.contains(answer, F.lit("^{")) | F.contains(answer, F.lit("^(")) | answer.rlike(r"\^[0-9]+\^") | answer.rlike(r"\^[0-9][0-9]+")
    return (letters <= 2) & ~risky


def language_in(lang: Column, wanted: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Case-insensitive membership, with aliases mapped to their language."""
    low = F.lower(lang)
    for alias, name in (aliases or {}).items():
        low = F.when(low == alias, name).otherwise(low)
    return low.isin(*[w.lower() for w in wanted])


def small_commit(files: Column, hunks: Column, lines: Column, patch_chars: Column) -> Column:
    return (files > 0) & (files < 5) & (hunks > 0) & (lines > 0) & (lines < 200) & (patch_chars < 10000)


def only_python(extensions: Column, allowed: list[str]) -> Column:
    return (F.size(F.array_except(extensions, F.array(*[F.lit(a) for a in allowed]))) == 0) & F.array_contains(extensions, ".py")


def bug_edit_shape(added: Column, edited: Column, deleted: Column, statements: Column) -> Column:
    return (deleted == 0) & (added <= 1) & (edited <= 4) & (edited > 0) & (statements <= 6)


def test_entity_edited(old: Column, new: Column, issue_text: Column) -> Column:
    """A changed test entity, or a new one that the issue names. old, new: array<struct<name, content>> of tests."""
    names = lambda es: F.transform(es, lambda e: e["name"])
    changed = F.exists(new, lambda e: F.exists(old, lambda o: (o["name"] == e["name"]) & (o["content"] != e["content"])))
    named = F.exists(F.array_except(names(new), names(old)), lambda n: F.contains(n, F.lit("issue")) | F.contains(issue_text, n))
    return changed | named


def invalid_simulation(response: Column, sentinel: str, phrases: list[str], reward: Column) -> Column:
    """Empty, the error sentinel, a phrase of failure, or a reward that is no number."""
    bad = F.coalesce(strip(response), F.lit("")) == ""
    bad = bad | (response == sentinel)
    for p in phrases:
        bad = bad | F.contains(response, F.lit(p))
    return F.coalesce(bad, F.lit(True)) | reward.try_cast("double").isNull()


def fits_context(prompt_len: Column, max_len: int) -> Column:
    return F.coalesce((prompt_len > 0) & (prompt_len < max_len - 2), F.lit(False))


def reward_class(reward: Column, kind: str) -> Column:
    return {"all": F.lit(True), "zero": reward == 0, "positive": reward > 0, "one": reward == 1}[kind]


def forbidden_command(command: Column, tokens: list[str], substrings: list[str]) -> Column:
    """One of the tokens with a blank behind it, or one of the substrings."""
    hit = F.exists(F.array(*[F.lit(t + " ") for t in tokens], *[F.lit(s) for s in substrings]), lambda x: F.contains(command, x))
    return F.coalesce(hit, F.lit(False))


def patches_without(files: Column, skip: list[str]) -> Column:
    """Paths that hold none of the tokens."""
    return F.filter(files, lambda p: ~F.exists(F.array(*[F.lit(s) for s in skip]), lambda s: F.contains(p, s)))


def repeated_window_share(words: Column, n: int) -> Column:
    """Share of n-word windows that a text has more than once."""
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return let(grams, lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g))


# The reply to commands that install packages.
INSTALL, INSTALLED = "pip install", "Successfully installed packages."


def command_reply(command: Column, tokens: list[str], substrings: list[str]) -> Column:
    """struct<output, exit_code> that stands for running a command: installs succeed at once, forbidden commands are refused by
    name; null: the command is to be run. A token needs a blank behind it, and the first that fits is named."""
    reply = F.when(F.contains(command, F.lit(INSTALL)), INSTALLED)
    for word, needle in [*((t, t + " ") for t in tokens), *((x, x) for x in substrings)]:
        reply = reply.when(F.contains(command, F.lit(needle)), f"This command {word} is not allowed. Please try other approaches.")
    return let(reply, lambda r: F.when(r.isNotNull(), F.struct(r.alias("output"), F.lit(0).alias("exit_code"))))


def from_sources(source: Column, names: list[str]) -> Column:
    """Rows of these data sources, by their exact names."""
    return F.coalesce(source.isin(*names), F.lit(False))


def context_type(context: Column, kind: str = "reward_calculation") -> Column:
    """Rows of one type of context."""
    return F.coalesce(context == kind, F.lit(False))


def without_rows(df: DataFrame, order: list[str], excluded: list[int]) -> DataFrame:
    """df less the rows at these places (from 0) in the order; the list is a parameter of bounded size."""
    from trajlake.operators.order import global_index

    return global_index(df, order).filter(~F.col("row_index").isin(*excluded) if excluded else F.lit(True)).drop("row_index")


def entity_sets(old: Column, new: Column) -> Column:
    """struct<both, added, removed> of two arrays of entity names, each sorted and without repeats."""
    return F.struct(F.sort_array(F.array_union(old, new)).alias("both"), F.sort_array(F.array_except(new, old)).alias("added"), F.sort_array(F.array_except(old, new)).alias("removed"))
