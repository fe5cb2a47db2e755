"""Text rules as Columns: logs, markers, actions, answers, JSON fields, code blocks. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.core import as_map, first_wins, last_wins, let

# The marker lines and tags of the log and transcript formats.
SUMMARY_MARKER = "short test summary info"
STDOUT, STDERR = "[STDOUT]", "[STDERR]"
REWARD_FAILED = -10086
NO_ANSWER = ("yes", "no", "noanswer")


def after_first(s: Column, marker: str) -> Column:
    """Text behind the first marker; null if there is none."""
    at = F.locate(marker, s)
    return F.when(at > 0, F.substring(s, at + len(marker), F.length(s)))


def after_last(s: Column, marker: str) -> Column:
    """Text behind the last marker; the whole text if there is none."""
    return F.substring_index(s, marker, -1)


def before_last(s: Column, marker: str) -> Column:
    """Text before the last marker; null if there is none."""
    return F.when(F.contains(s, F.lit(marker)), F.substring(s, F.lit(1), F.length(s) - F.length(after_last(s, marker)) - len(marker)))


def strip(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def strip_ansi(s: Column) -> Column:
    """Without terminal colour codes."""
    return F.regexp_replace(s, "\u001b\\[[0-9;]*m", "")


def status_entries(log: Column) -> Column:
    """array<struct<name, status, i>> of the lines behind the first short-summary marker, in order.

    A line's status is the first of PASSED, FAILED, ERROR that it contains. Its name is what stands behind the first "::",
    with "." for the rest of them; of FAILED and ERROR lines the part from " - " on is cut. Lines without "::" name no test.
    """
    lines = F.split(after_first(log, SUMMARY_MARKER), "\n")

    def entry(line: Column, i: Column) -> Column:
        status = F.when(F.contains(line, F.lit("PASSED")), "PASSED").when(F.contains(line, F.lit("FAILED")), "FAILED").when(F.contains(line, F.lit("ERROR")), "ERROR")
        parts = F.split(line, "::")
        name = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ".")
        name = F.when(status == "PASSED", name).otherwise(F.substring_index(name, " - ", 1))
        return F.struct(strip(name).alias("name"), F.when(F.size(parts) > 1, status).alias("status"), i.alias("i"))

    return F.filter(F.coalesce(F.transform(lines, entry), F.array().cast("array<struct<name:string,status:string,i:int>>")), lambda e: e["status"].isNotNull() & (e["name"] != ""))


def status_map(log: Column) -> Column:
    """map test name -> status; of repeated names the last line counts."""
    entries = F.transform(status_entries(log), lambda e: F.struct(e["name"].alias("k"), e["i"].alias("i"), e["status"].alias("v")))
    return as_map(last_wins(entries))


def clean_status_map(m: Column) -> Column:
    """Keys without colour codes and without the part from " - " on; empty keys go, of keys that become equal the first counts."""
    entries = F.transform(F.map_entries(m), lambda e, i: F.struct(F.substring_index(strip_ansi(e["key"]), " - ", 1).alias("k"), i.alias("i"), e["value"].alias("v")))
    return as_map(first_wins(F.filter(entries, lambda e: e["k"] != "")))


def out_and_err(s: Column) -> Column:
    """struct<stdout, stderr>: the text is split at the last [STDERR]; stdout is what stands behind the last [STDOUT]
    before it. Without [STDERR] all belongs to stdout. Both are trimmed."""
    head = F.coalesce(before_last(s, STDERR), s)
    err = F.when(F.contains(s, F.lit(STDERR)), after_last(s, STDERR)).otherwise("")
    return F.struct(strip(after_last(head, STDOUT)).alias("stdout"), strip(err).alias("stderr"))


def action_params(s: Column) -> Column:
    """struct<fn, params map<string,string>> of pseudo-XML: keys and values are trimmed, the last of repeated keys counts."""
    fn = F.regexp_extract(s, r"(?s)<function\s*=\s*([^>]+)>", 1)
    keys = F.transform(F.regexp_extract_all(s, F.lit(r"(?s)<parameter\s*=\s*([^>]+)>(.*?)</parameter>"), F.lit(1)), strip)
    values = F.transform(F.regexp_extract_all(s, F.lit(r"(?s)<parameter\s*=\s*([^>]+)>(.*?)</parameter>"), F.lit(2)), strip)
    pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    return F.struct(strip(fn).alias("fn"), as_map(last_wins(pairs)).alias("params"))


def thought_and_action(s: Column) -> Column:
    """struct<thought, action>: action is the first <function=...>...</function> block; without one all is thought."""
    block = F.regexp_extract(s, r"(?s)<function=.*?</function>", 0)
    return F.struct(strip(F.when(block != "", F.substring(s, F.lit(1), F.locate("<function=", s) - 1)).otherwise(s)).alias("thought"), strip(block).alias("action"))


def after_thinking(s: Column) -> Column:
    """Text behind the last </think>, trimmed; all of it without one."""
    return strip(after_last(s, "</think>"))


def simulated_reward(s: Column) -> Column:
    """The reward field of the JSON behind the last </think>, or REWARD_FAILED."""
    return F.coalesce(F.get_json_object(after_thinking(s), "$.reward").try_cast("double"), F.lit(float(REWARD_FAILED)))


def last_code_block(s: Column) -> Column:
    """The last fenced code block, trimmed; null without one."""
    blocks = F.regexp_extract_all(s, F.lit("(?s)```(?:\\w+)?\\n(.*?)```"), F.lit(1))
    return strip(F.when(F.size(blocks) > 0, F.element_at(blocks, -1)))


def patch_files(s: Column) -> Column:
    """Files that a patch names in its --- a/ and +++ b/ lines, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?m)^(?:--- a/|\+\+\+ b/)([^\t\n]+)"), F.lit(1)))


def commit_kind(message: Column) -> Column:
    """bug, feature, refactor or other, by the first kind whose words the message holds."""
    low = F.lower(message)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return F.when(has("fix", "bug"), "bug").when(has("feature", "add"), "feature").when(has("refactor"), "refactor").otherwise("other")


def is_test_path(path: Column) -> Column:
    """A file that is named as a test, or lies in a folder tests, Tests, test or Test."""
    parts = F.split(path, "/")
    folders = F.exists(parts, lambda p: p.isin("tests", "Tests", "test", "Test"))
    return folders | F.endswith(path, F.lit("_test.py")) | F.startswith(path, F.lit("test_")) | F.startswith(F.element_at(parts, -1), F.lit("test_"))


def normalise_answer(s: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; in this order."""
    s = F.regexp_replace(F.lower(s), r"[\p{Punct}]", "")
    return strip(F.regexp_replace(F.regexp_replace(s, r"\b(a|an|the)\b", " "), r"\s+", " "))


def token_f1(prediction: Column, truth: Column) -> Column:
    """struct<f1, precision, recall> of bags of words of normalised answers; a differing yes, no or noanswer gives 0."""
    p, t = normalise_answer(prediction), normalise_answer(truth)

    def scored(pt: Column) -> Column:
        a, b = F.filter(F.split(pt["p"], " "), lambda x: x != ""), F.filter(F.split(pt["t"], " "), lambda x: x != "")
        counts = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
        same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(counts(a, w), counts(b, w)))
        zero = ((pt["p"].isin(*NO_ANSWER) | pt["t"].isin(*NO_ANSWER)) & (pt["p"] != pt["t"])) | (same == 0)
        pr, re = same / F.size(a), same / F.size(b)
        z = F.lit(0.0)
        return F.struct(F.when(zero, z).otherwise(2 * pr * re / (pr + re)).alias("f1"), F.when(zero, z).otherwise(pr).alias("precision"), F.when(zero, z).otherwise(re).alias("recall"))

    return let(F.struct(p.alias("p"), t.alias("t")), scored)


def best_f1(prediction: Column, truths: Column, threshold: float = 0.3) -> Column:
    """struct<f1, exact, correct, reward> against the best of several truths; an exact match counts as 1."""
    exact = F.exists(truths, lambda t: normalise_answer(prediction) == normalise_answer(t))
    f1 = F.when(exact, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(truths, lambda t: token_f1(prediction, t)["f1"])), F.lit(0.0)))
    return let(F.struct(f1.alias("f1"), exact.alias("exact")), lambda x: F.struct(x["f1"].alias("f1"), x["exact"].alias("exact"), (x["f1"] >= threshold).alias("correct"), F.when(x["f1"] >= threshold, x["f1"]).otherwise(0.0).alias("reward")))


def line_range_length(s: Column) -> Column:
    """Lines of a "[a, b]" view range, read as two integers; an end of -1 has no length (null)."""
    a, b = (F.regexp_extract(s, r"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]", i).try_cast("int") for i in (1, 2))
    return F.when(b >= a, b - a + 1)


def robust_list(s: Column) -> Column:
    """array<string> of a JSON list in a string, or the string itself as the one element; empty or null: no elements."""
    parsed = F.from_json(s, "array<string>", {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(strip(s), F.lit("")) == "", none).when(strip(s).startswith("["), F.coalesce(parsed, F.array(s))).otherwise(F.array(s))


def last_verdict(s: Column, letters: str = r"\p{L}\p{N}_") -> Column:
    """Whichever of the words yes and no comes last in the final 200 characters, as written; "" without one.

    A word ends where none of the letters stands. They are stated, as what \\b takes for one differs between engines and Java versions.
    """
    return F.regexp_extract(F.substring(s, -200, 200), rf"(?is).*(?<![{letters}])(yes|no)(?![{letters}])", 1)


def judge_label(s: Column) -> Column:
    """Yes, No or Error: boxed, then bracketed, then whichever word comes last in the final 200 characters."""
    boxed = F.regexp_extract(s, r"(?is)(?:\\boxed|\x08oxed)\s*\{\s*(yes|no)", 1)
    loose = F.regexp_extract(s, r"(?i)(?:\[\[|\*\*|\[)\s*(yes|no)\s*(?:\]\]|\*\*|\])", 1)
    found = F.coalesce(F.nullif(boxed, F.lit("")), F.nullif(loose, F.lit("")), F.nullif(last_verdict(s), F.lit("")))
    return F.coalesce(F.initcap(found), F.lit("Error"))


def reasoning_text(s: Column, tag: str = "sim_reasoning") -> Column:
    """Text between the first start tag and the last end tag, trimmed; all of the text if a tag is missing or misplaced."""
    inner = before_last(after_first(s, f"<{tag}>"), f"</{tag}>")
    return strip(F.coalesce(inner, s))


def issue_statement(s: Column) -> Column:
    """Text between [ISSUE] and [/ISSUE], trimmed; null without both."""
    return strip(F.substring_index(F.when(F.contains(after_first(s, "[ISSUE]"), F.lit("[/ISSUE]")), after_first(s, "[ISSUE]")), "[/ISSUE]", 1))


def normalise_for_dedup(s: Column) -> Column:
    return F.lower(strip(F.regexp_replace(s, r"\s+", " ")))


def exact_once_replace(s: Column, old: str, new: str) -> Column:
    """struct<ok, n, text>: replaced if old occurs exactly once after tabs are expanded; else the text as it is."""
    s, old, new = F.regexp_replace(s, "\t", "        "), old.expandtabs(), new.expandtabs()
    n = ((F.length(s) - F.length(F.replace(s, F.lit(old), F.lit("")))) / len(old)).cast("int")
    return F.struct((n == 1).alias("ok"), n.alias("n"), F.when(n == 1, F.replace(s, F.lit(old), F.lit(new))).otherwise(s).alias("text"))


def truncated(s: Column, most: int, notice: str) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit(notice))).otherwise(s)


def file_extension(path: Column) -> Column:
    """Extension with its dot in the last path part; "" without one."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"[^.](\.[^.]+)$", 1)


def ends_with_error(observation: Column, phrase: str) -> Column:
    return F.endswith(F.regexp_replace(observation, r"\s+$", ""), F.lit(phrase))


def same_stdout(a: Column, b: Column) -> Column:
    """Whether two outputs agree: trimmed, as many lines, and each trimmed line equal or equal token by token as decimals."""
    lines = lambda s: F.transform(F.split(strip(s), "\n"), strip)

    def line_equal(x: Column, y: Column) -> Column:
        tokens = lambda t: F.split(t, r"\s+")
        as_numbers = F.transform(F.arrays_zip(tokens(x).alias("l"), tokens(y).alias("r")), lambda p: F.coalesce(p["l"].try_cast("decimal(38,12)") == p["r"].try_cast("decimal(38,12)"), F.lit(False)))
        return (x == y) | ((F.size(tokens(x)) == F.size(tokens(y))) & F.forall(as_numbers, lambda v: v))

    la, lb = lines(a), lines(b)
    return (F.size(la) == F.size(lb)) & F.forall(F.zip_with(la, lb, lambda x, y: F.coalesce(line_equal(x, y), F.lit(False))), lambda v: v)


def report_tail_cut(s: Column) -> Column:
    """The report up to its last line with "="; the tail stays if it has a Traceback, or if no line has one."""
    def cut(lines: Column) -> Column:
        last = F.array_max(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("=")), i + 1).otherwise(0)))
        tail = F.array_join(F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0))), "\n")
        return F.when((last == 0) | F.contains(tail, F.lit("Traceback")), F.array_join(lines, "\n")).otherwise(F.array_join(F.slice(lines, 1, F.greatest(last, F.lit(1))), "\n"))

    return let(F.split(s, "\n"), cut)


def rating_of_tags(tags: Column) -> Column:
    """The number of the first *NNNN tag, else 0."""
    numbers = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"^\*(\d+)$", 1).try_cast("int")), lambda x: x.isNotNull())
    return F.coalesce(F.get(numbers, F.lit(0)), F.lit(0))


# Patterns that tell an answer in free text, in the order in which they are tried, and phrases that are no names.
BOLD = [r"\*\*([^*]+)\*\*", r"\*([^*]+)\*"]
DATES = [
    r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b",
    r"(?i)\b(?:March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b",
    r"\b\d{4}\b",
]
NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
NO_NAMES = ["United States", "New York", "Los Angeles", "Great Britain", "Middle East", "South Africa"]
NUMBERS = [r"\b(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:votes?|dollars?|years?|months?|days?|people|million|billion|percent|%)\b", r"\b(\d+(?:,\d{3})*(?:\.\d+)?)\b"]
PHRASES = [
    r"(?im)(?:the\s+)?(?:correct\s+)?answer\s+is\s*:?\s*([^.!?]+)",
    r"(?im)(?:therefore|thus|so|hence)\s*,?\s*([^.!?]+)",
    r"(?im)(?:in\s+conclusion|to\s+summarize|in\s+summary)\s*,?\s*([^.!?]+)",
    r"(?im)(?:^|\.\s+)([A-Z][^.!?]*(?:was|is|are|were)\s+[^.!?]+)",
    r"(?im)(?:the\s+answer\s+would\s+be|it\s+(?:is|was))\s*:?\s*([^.!?]+)",
]


def boxed_content(s: Column) -> Column:
    """Text of the first boxed{...}, with braces inside it up to three deep; null without one or if its braces don't close."""
    inner = r"[^{}]"
    for _ in range(3):
        inner = rf"(?:[^{{}}]|\{{{inner}*\}})"
    rest = after_first(s, "boxed{")
    return F.when(rest.rlike(rf"(?s)^{inner}*\}}"), strip(F.regexp_extract(rest, rf"(?s)^({inner}*)\}}", 1)))


def sentence_score(s: Column) -> Column:
    """How much a sentence tells: 3 for a year, 2 for a name, 1 for a plain statement, 1 for under 15 words."""
    points = [(3, s.rlike(r"\b\d{4}\b")), (2, s.rlike(NAMES)), (1, s.rlike(r"(?i)\b(?:was|is|are|were)\b")), (1, F.size(F.split(s, " ")) < 15)]
    return sum(F.when(c, n).otherwise(0) for n, c in points)


def answer_cascade(response: Column) -> Column:
    """An answer to a question from free text, by the first rule that finds one.

    Thinking is cut and white space made single. Then: boxed text, bold text, a date, a name, a number, what follows an answering
    phrase, the sentence that tells most, the first sentence, the first 100 characters. An empty response gives "".
    """
    text = strip(F.regexp_replace(F.regexp_replace(strip(F.coalesce(response, F.lit(""))), r"(?s)<think>.*?</think>", ""), r"\s+", " "))

    def found(s: Column) -> Column:
        every = lambda p, g: F.regexp_extract_all(s, F.lit(p), F.lit(g))
        first = lambda xs: F.get(xs, F.lit(0))
        bold = [first(F.filter(F.transform(every(p, 1), strip), lambda x: (F.length(x) > 2) & x.rlike(r"\w"))) for p in BOLD]
        names = F.filter(every(NAMES, 0), lambda x: ~x.isin(*NO_NAMES) & (F.size(F.split(x, r"\s+")) <= 4))
        phrases = [F.nullif(F.regexp_replace(strip(F.regexp_extract(s, p, 1)), r"^\W+|\W+$", ""), F.lit("")) for p in PHRASES]
        sentences = F.transform(F.split(s, r"[.!?]+"), strip)
        scored = F.transform(F.filter(sentences, lambda x: F.length(x) > 10), lambda x, i: F.struct((-sentence_score(x)).alias("least"), i.alias("i"), x.alias("x")))
        best = let(F.array_min(scored), lambda b: F.when(b["least"] < 0, b["x"]))
        return F.coalesce(
            boxed_content(s), *bold, *[first(every(p, 0)) for p in DATES], first(names), *[first(every(p, 1)) for p in NUMBERS], *[F.when(F.length(x) > 3, x) for x in phrases],
            best, first(F.filter(sentences, lambda x: F.length(x) > 5)), strip(F.substring(s, 1, 100)),
        )

    return let(text, found)


def prompt_text(s: Column, messages: Column) -> Column:
    """The prompt for deduplication: the text itself, or the first message's content if the prompt is a chat; "" for an empty chat."""
    return F.coalesce(s, F.get(messages, F.lit(0))["content"], F.lit(""))


def header_test_path(path: Column) -> Column:
    """A file that a patch header names as a test: test_ or tests/ in the path, or an end _test.py."""
    return F.contains(path, F.lit("test_")) | F.contains(path, F.lit("tests/")) | F.endswith(path, F.lit("_test.py"))


def replaced_once(s: Column, old: Column, new: Column) -> Column:
    """exact_once_replace for an old and a new text in columns; an empty old text is no match."""
    tabs = lambda x: F.regexp_replace(x, "\t", "        ")

    def made(x: Column) -> Column:
        n = F.when(F.length(x["o"]) > 0, (F.length(x["s"]) - F.length(F.replace(x["s"], x["o"], F.lit("")))) / F.length(x["o"])).otherwise(0).cast("int")
        return F.struct((n == 1).alias("ok"), n.alias("n"), F.when(n == 1, F.replace(x["s"], x["o"], x["w"])).otherwise(x["s"]).alias("text"))

    return let(F.struct(tabs(s).alias("s"), tabs(old).alias("o"), tabs(new).alias("w")), made)
