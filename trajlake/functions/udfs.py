"""Arrow UDFs and a UDTF for rules that need nesting, state or a parser. A batch of texts at a time, never a row."""

from __future__ import annotations

import ast
import difflib
import math
import re
import shlex
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.functions import polynomials

TEXTS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# ---- reports of test runs ----

TIMEOUT = "The command took too long to execute"
# Fixed values, by runner: patterns that open a report; a second chance and by how many lines it looks back; patterns that
# close it, the first kind found from the end, and by how many lines they step back; whether the last line closes it too.
REPORTS = {
    "python": dict(open="============================= test session starts ==============================", again=None, close=[(r">>>>> End Test Output", 1), (r"\+ git checkout ", 1), (r"====", 0)], rest=False),
    "javascript": dict(open=r"^\s*(PASS|FAIL)\s+\S", again=(r"Test Suites:|Tests:\s+\d+", 2), close=[(r"^\s*Time:\s+[\d.]+\s*s", 0), (r"^\s*Tests:\s+", 0), (r"^\s*Test Suites:\s+", 0)], rest=False),
    "rust": dict(open=r"^\s*running \d+ tests?", again=None, close=[(r"test result:", 0)], rest=True),
    "go": dict(open=r"^\s*(=== RUN|--- (PASS|FAIL):)", again=(r"^(ok|FAIL)\s+\S+", 0), close=[(r"^(ok|FAIL)\s+\S+", 0)], rest=True),
    "java": dict(open=r"T E S T S|Running \S+Test", again=(r"\d+ tests? completed", 5), close=[(r"BUILD (SUCCESS|FAILURE)|tests? completed", 0)], rest=True),
}
REPORTS["typescript"] = REPORTS["javascript"]


def test_report(log: str | None, lang: str | None) -> tuple[bool, str, str]:
    """(ok, reason, report)."""
    rule, log = REPORTS.get((lang or "python").lower(), REPORTS["python"]), log or ""
    if TIMEOUT in log:
        return False, "timeout", ""
    lines = log.splitlines(keepends=True)
    find = lambda p, order: next((i for i in order if re.search(p, lines[i])), None)
    start = find(rule["open"], range(len(lines)))
    if start is None and rule["again"]:
        at = find(rule["again"][0], range(len(lines)))
        start = None if at is None else max(0, at - rule["again"][1])
    if start is None:
        return False, "no start", ""
    stop = None
    for pattern, back in rule["close"]:
        at = find(pattern, range(len(lines) - 1, start - 1 + back, -1))
        if at is not None:
            stop = at - back
            break
    if stop is None and rule["rest"]:
        stop = len(lines) - 1
    return (False, "no end", "") if stop is None else (True, "", "".join(lines[start : stop + 1]))


def _structs(rows: Iterator[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=names)


@F.pandas_udf(_struct(ok=T.BooleanType(), reason=T.StringType(), report=T.StringType()))
def test_report_udf(log: pd.Series, lang: pd.Series) -> pd.DataFrame:
    return _structs((test_report(a, b) for a, b in zip(log, lang)), ["ok", "reason", "report"])


# ---- boxed answers and mathematics ----


def boxed(text: str | None, search: bool = False) -> str | None:
    """Inside of the last \\boxed{} (or \\fbox{}) with balanced braces; with search, of the first."""
    if not text:
        return None
    starts = [m.end() for m in re.finditer(r"\\boxed\s*\{", text)] or [m.end() for m in re.finditer(r"\\fbox\s*\{", text)]
    for at in starts[:1] if search else starts[-1:]:
        depth = 1
        for i in range(at, len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                return text[at:i]
    return None


# Units that an answer may carry.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard"]
# Substitutions that make forms of an answer alike (pattern, replacement), in the order in which they apply.
SUBSTITUTIONS = [
    (r"^\\text\{(.+?)\}", r"\1"),
    (r"\\?[%$]", ""),
    (r" (or|and) ", " , "),
    (r"million", "*10^6"),
    (r"billion", "*10^9"),
    (r"trillion", "*10^12"),
    *[(rf"{unit}(es)?s? *(\^\d+)?", "") for unit in UNITS],
    (r"\^ *\\circ", ""),
    (r"^\{(.*)\}$", r"\1"),
    (r",\\! *", ""),
]
# LaTeX commands that stand for a sign or a word; any other command stands for its name.
COMMANDS = {"cdot": "*", "times": "*", "div": "/", "pi": "pi", "left": "", "right": "", "displaystyle": "", ",": "", ";": "", "!": "", " ": " ", "{": "{", "}": "}"}
COMMAND = re.compile(r"\\([a-zA-Z]+|.)", re.DOTALL)
FRACTION = re.compile(r"^-?\d+/-?\d+$")
INTEGER = re.compile(r"^-?\d+$")
MATH_WORDS = ("sqrt", "sin", "cos", "tan", "log", "ln", "exp", "pi")
MATH_TOKEN = re.compile("|".join(MATH_WORDS) + r"|[a-z]|\d+\.?\d*|\.\d+|\S")


def latex_plain(text: str) -> str:
    """LaTeX as plain arithmetic: fractions, roots, powers, products and names, however deep they stand in each other.

    A fraction of whole numbers behind a whole number is the rest of a mixed number.
    """

    def part(i: int) -> tuple[str, int]:
        """The argument at place i (a group in braces, a command or one sign) and the place behind it."""
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] == "{":
            depth = 0
            for j in range(i, len(text)):
                depth += (text[j] == "{") - (text[j] == "}")
                if not depth:
                    return latex_plain(text[i + 1 : j]), j + 1
            return latex_plain(text[i + 1 :]), len(text)
        if m := COMMAND.match(text, i):
            return latex_plain(m[0]), m.end()
        return text[i : i + 1], i + 1

    out, i = "", 0
    while i < len(text):
        m = COMMAND.match(text, i)
        if m and m[1] in ("frac", "dfrac", "tfrac"):
            above, i = part(m.end())
            below, i = part(i)
            whole = INTEGER.match(above) and INTEGER.match(below)
            mixed = "+" if whole and re.search(r"\d *$", out) else ""
            out = out.rstrip() + mixed if mixed else out
            out += f"{above}/{below}" if whole else f"({above})/({below})"
        elif m and m[1] == "sqrt":
            i, root = m.end(), None
            if text[i : i + 1] == "[" and "]" in text[i:]:
                root, i = latex_plain(text[i + 1 : text.index("]", i)]), text.index("]", i) + 1
            inner, i = part(i)
            out += f"sqrt({inner})" if root is None else f"({inner})^(1/({root}))"
        elif m:
            out, i = out + COMMANDS.get(m[1], m[1]), m.end()
        elif text[i] == "^":
            power, i = part(i + 1)
            out += f"^{power}" if len(power) < 2 or power.isdigit() else f"^({power})"
        else:
            out, i = out + text[i], i + 1
    return out


def math_normal(text: str | None) -> str | None:
    """A canonical form of an answer: no units, signs of money or per cent, LaTeX, thousands' commas or blanks."""
    if text is None:
        return None
    t = text.strip()
    for pattern, replacement in SUBSTITUTIONS:
        t = re.sub(pattern, replacement, t)
    t = latex_plain(t)
    t = re.sub(r"\((-?\d+)\)/\((-?\d+)\)", r"\1/\2", t)
    t = re.sub(r"- +", "-", t)
    t = re.sub(r"(\d) +(\d+/\d+)", r"\1+\2", t)
    t = t.replace(" ", "").replace("{", "").replace("}", "").lower()
    if re.fullmatch(r"-?\d{1,3}(,\d{3})+(\.0*)?|-?\d+\.0*", t):
        t = t.replace(",", "").split(".")[0]
    return t


def _products(text: str) -> str:
    """An expression with the multiplication signs that are left out where factors stand side by side."""
    out, before = "", ""
    for token in MATH_TOKEN.findall(text):
        factor = before == ")" or before == "pi" or before[-1:].isdigit() or (len(before) == 1 and before.isalpha())
        if factor and (token == "(" or token[0].isalnum() or token[0] == "."):
            out += "*"
        out, before = out + token, token
    return out


def _value(text: str, at: dict[str, float] | None = None) -> float | None:
    """Value of an arithmetic expression over numbers and the variables `at`, read as a syntax tree; null if it is more than that."""
    known = at or {}
    functions = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "ln": math.log, "exp": math.exp}

    def walk(n: ast.AST) -> float:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return float(n.value)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            if isinstance(n.op, ast.Pow):
                if abs(b) > 64 or abs(a) > 1e9:
                    raise ValueError
                return a**b
            return {ast.Add: a.__add__, ast.Sub: a.__sub__, ast.Mult: a.__mul__, ast.Div: a.__truediv__}[type(n.op)](b)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in functions and len(n.args) == 1:
            return functions[n.func.id](walk(n.args[0]))
        if isinstance(n, ast.Name):
            return math.pi if n.id == "pi" else known[n.id]
        raise ValueError

    try:
        v = walk(ast.parse(_products(text).replace("^", "**"), mode="eval").body)
        return float(v) if isinstance(v, (int, float)) and math.isfinite(v) else None
    except (ValueError, SyntaxError, KeyError, ZeroDivisionError, OverflowError, TypeError, RecursionError, MemoryError):
        return None


def same_expression(a: str, b: str, points: int = 8) -> bool:
    """Whether two expressions in at most two variables are equal: rational ones by their normal form (polynomials.equal), exactly.

    Others, which hold functions or roots, are judged by their values at points without a pattern; those without a
    value at half of the points count as different. Expressions with stacked or long powers aren't evaluated.
    """
    if any(re.search(p, x) for x in (a, b) for p in (r"\^\(", r"\^\d+\^", r"\^\d\d+")):
        return False
    names = sorted({t for x in (a, b) for t in MATH_TOKEN.findall(x) if len(t) == 1 and t.isalpha()})
    if len(names) > 2:
        return False
    exact = polynomials.equal(*(_products(x).replace("^", "**") for x in (a, b)), frozenset(names))
    if exact is not None:
        return exact
    hits = 0
    for k in range(points if names else 1):
        at = {n: 0.3719 + 0.6137 * k + 0.2841 * i + 0.0173 * k * i for i, n in enumerate(names)}
        x, y = _value(a, at), _value(b, at)
        if x is None or y is None:
            continue
        if abs(x - y) > 1e-9 * max(1.0, abs(x), abs(y)):
            return False
        hits += 1
    return hits >= (points / 2 if names else 1)


def _elements(t: str) -> list[str]:
    return t[1:-1].split(",") if len(t) > 2 and t[0] in "([" and t[-1] in ")]" and "," in t else [t]


def math_equal(given: str | None, truth: str | None) -> bool:
    """Equal forms, or tuples equal by element: fractions as written, integers as written, the rest as expressions."""
    g, t = math_normal(given), math_normal(truth)
    if t is None or not g:
        return False
    if g == t:
        return True
    ge, te = _elements(g), _elements(t)
    if len(ge) != len(te) or (len(te) > 1 and (g[0] != t[0] or g[-1] != t[-1])):
        return False
    for a, b in zip(ge, te):
        if FRACTION.match(a) and FRACTION.match(b):
            same = a == b
        elif bool(INTEGER.match(a)) != bool(INTEGER.match(b)):
            same = False
        else:
            same = a == b or same_expression(a, b)
        if not same:
            return False
    return True


def math_reward(response: str | None, truths: list[str], think: bool = True, tool_bonus: bool = False, used_tool: bool = False) -> tuple[float, bool, bool]:
    """(reward, correct, format error) of an answer behind the first </think>."""
    text = response or ""
    if think and "</think>" not in text:
        return 0.0, False, True
    answer = boxed(text.split("</think>", 1)[-1])
    if answer is None:
        return 0.0, False, True
    ok = any(math_equal(answer, boxed(t) if "\\boxed" in t else t) for t in truths)
    return (1.0 + 0.5 * (tool_bonus and used_tool) if ok else 0.0), ok, False


@F.pandas_udf(T.StringType())
def boxed_udf(text: pd.Series) -> pd.Series:
    return text.map(boxed)


@F.pandas_udf(T.StringType())
def math_normal_udf(text: pd.Series) -> pd.Series:
    return text.map(math_normal)


@F.pandas_udf(T.BooleanType())
def math_equal_udf(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([math_equal(a, b) for a, b in zip(given, truth)])


@F.pandas_udf(_struct(reward=T.DoubleType(), correct=T.BooleanType(), format_error=T.BooleanType()))
def math_reward_udf(response: pd.Series, truths: pd.Series) -> pd.DataFrame:
    return _structs((math_reward(a, list(b) if b is not None else []) for a, b in zip(response, truths)), ["reward", "correct", "format_error"])


# ---- code ----


def without_main(code: str | None) -> str | None:
    """Code without its `if __name__ == "__main__":` block: the line and all deeper or blank lines behind it."""
    if code is None:
        return None
    kept, depth = [], None
    for line in code.split("\n"):
        indent = len(line) - len(line.lstrip())
        if depth is not None and (not line.strip() or indent > depth):
            continue
        depth = indent if re.match(r"\s*if\s+__name__\s*==\s*['\"]__main__['\"]\s*:", line) else None
        if depth is None:
            kept.append(line)
    return "\n".join(kept)


def code_without_docs(code: str | None) -> str | None:
    """A dump of the syntax tree without doc strings; null if the code doesn't parse."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return None
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
            n.body = n.body[1:] or [ast.Pass()]
    return ast.dump(tree)


@F.pandas_udf(T.BooleanType())
def changes_code(old: pd.Series, new: pd.Series) -> pd.Series:
    """Whether more than comments, layout and doc strings differ; false if either doesn't parse."""
    def one(a, b):
        x, y = code_without_docs(a), code_without_docs(b)
        return x is not None and y is not None and x != y

    return pd.Series([one(a, b) for a, b in zip(old, new)])


@F.pandas_udf(T.StringType())
def without_main_udf(code: pd.Series) -> pd.Series:
    return code.map(without_main)


def inline_code(command: str | None) -> bool:
    """Does a command carry its program: python -c, or a here-document?"""
    try:
        words = shlex.split(command or "", comments=False)
    except ValueError:
        words = (command or "").split()
    runs = any(re.fullmatch(r"(.*/)?python[\d.]*", a) and b == "-c" for a, b in zip(words, words[1:]))
    return runs or bool(re.search(r"<<-?\s*['\"]?\w+", command or ""))


@F.pandas_udf(T.BooleanType())
def inline_code_udf(command: pd.Series) -> pd.Series:
    return command.map(inline_code)


# ---- patches ----

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)")


def diff_lines(patch: str | None) -> Iterator[tuple]:
    """(path, file_no, hunk_no, line_no, kind, text, old_line, new_line) of a unified diff; kind is added, deleted or context.

    A rename, or a line in a hunk that is none of these, is an error.
    """
    file_no, hunk_no, line_no, path, left, right, old, new = -1, -1, 0, None, 0, 0, 0, 0
    named = False  # the file has begun with a "diff --git" line
    for line in (patch or "").split("\n"):
        if left <= 0 and right <= 0:
            if line.startswith("diff --git"):
                file_no, hunk_no, path, named = file_no + 1, -1, line.split(" b/", 1)[-1], True
            elif line.startswith(("rename from", "rename to")):
                raise ValueError("renames are not parsed")
            elif line.startswith("--- "):
                if not named:
                    file_no, hunk_no = file_no + 1, -1
                named = False
                if not line.startswith("--- /dev/null"):
                    path = line[4:].split("\t")[0].removeprefix("a/")
            elif line.startswith("+++ ") and not line.startswith("+++ /dev/null"):
                path = line[4:].split("\t")[0].removeprefix("b/")
            elif m := HUNK.match(line):
                hunk_no, line_no = hunk_no + 1, 0
                old, new = int(m[1]), int(m[3])
                left, right = int(m[2] or 1), int(m[4] or 1)
            continue
        if line.startswith("\\"):
            continue
        kind = {"+": "added", "-": "deleted", " ": "context", "": "context"}.get(line[:1])
        if kind is None:
            raise ValueError(f"not a line of a hunk: {line[:40]!r}")
        yield path, file_no, hunk_no, line_no, kind, line[1:], old if kind != "added" else None, new if kind != "deleted" else None
        line_no += 1
        old, left = old + (kind != "added"), left - (kind != "added")
        new, right = new + (kind != "deleted"), right - (kind != "deleted")


@F.udtf(returnType=_struct(path=T.StringType(), file_no=T.IntegerType(), hunk_no=T.IntegerType(), line_no=T.IntegerType(), kind=T.StringType(), text=T.StringType(), old_line=T.IntegerType(), new_line=T.IntegerType()))
class ParseDiff:
    """Rows of a patch, for lateral joins."""

    def eval(self, patch: str):
        yield from diff_lines(patch)


def patch_rows(df, id_: str, patch: str):
    """(id, path, file_no, hunk_no, line_no, kind, text, old_line, new_line) of every patch of a table, batch by batch."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_, "path", "file_no", "hunk_no", "line_no", "kind", "text", "old_line", "new_line"]
        for f in frames:
            out = pd.DataFrame([(i, *x) for i, p in zip(f[id_], f[patch]) for x in diff_lines(p)], columns=names)
            yield out.astype({"old_line": "Int32", "new_line": "Int32"})

    return df.select(id_, patch).mapInPandas(run, f"{id_} {dict(df.dtypes)[id_]}, path string, file_no int, hunk_no int, line_no int, kind string, text string, old_line int, new_line int")


def unified(old: str | None, new: str | None, path: str) -> str:
    """Unified diff of two contents; null stands for no file."""
    a, b = (f"a/{path}" if old is not None else "/dev/null"), (f"b/{path}" if new is not None else "/dev/null")
    return "".join(x if x.endswith("\n") else x + "\n" for x in difflib.unified_diff((old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True), a, b))


@F.pandas_udf(T.StringType())
def unified_udf(old: pd.Series, new: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([unified(a, b, p) for a, b, p in zip(old, new, path)])


# ---- contexts ----


def condensed(blocks: list[tuple[str, str]], budget: int, size: Callable[[str], int] = len, placeholder: str = "(omitted)") -> list[tuple[str, str]]:
    """Blocks (role, text) cut to a budget: the oldest user text but the first goes, else the longest of the others."""
    out, mark = [tuple(b) for b in blocks], size(placeholder)
    sizes = [size(t) for _, t in out]
    total = sum(sizes)
    first_user = next((i for i, (r, _) in enumerate(out) if r == "user"), -1)
    users = [i for i, (r, t) in enumerate(out) if r == "user" and i != first_user and t != placeholder]
    others = sorted((i for i, (r, t) in enumerate(out) if r != "user" and t != placeholder and sizes[i] > mark), key=lambda i: (-sizes[i], i))
    for i in [*users, *others]:  # the order in which they go, so that one pass does
        if total <= budget:
            break
        total += mark - sizes[i]
        out[i] = (out[i][0], placeholder)
    return out


def condense_udf(budget: int):
    @F.pandas_udf(T.ArrayType(_struct(role=T.StringType(), content=T.StringType())))
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: [{"role": r, "content": t} for r, t in condensed([(x["role"], x["content"]) for x in m], budget)] if m is not None else None)

    return run


def truncate_tokens_udf(encode_path: str, most: int):
    """Texts cut to `most` tokens of a vocabulary file of the tokenizers library that the executors have."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(encode_path)
        t.encode_special_tokens = True
        got = t.encode_batch([x or "" for x in text], add_special_tokens=False)
        return pd.Series([x if x is None or len(e.ids) <= most else t.decode(e.ids[:most], skip_special_tokens=False) for x, e in zip(text, got)])

    return run


TEST_LINE = re.compile(r"^\s*(?:[A-Z_]+=\S+\s+)*(pytest|python3? -m (?:pytest|unittest)|npm (?:run )?test|yarn test|cargo test|go test|mvn |gradle |\./gradlew|tox|make test|ctest)\b")


def setup_and_test(script: str | None) -> tuple[list[str], str | None]:
    """(setup commands, test command) of a script; here-documents stay whole, the first line that tests ends the search."""
    setup, held, end = [], None, None
    for line in (script or "").split("\n"):
        if held is not None:
            held.append(line)
            if line.strip() == end:
                setup.append("\n".join(held))
                held = None
            continue
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if TEST_LINE.match(line):
            return setup, line.strip()
        if m := re.search(r"<<-?\s*['\"]?(\w+)['\"]?", line):
            held, end = [line], m[1]
        else:
            setup.append(line.strip())
    return setup, None


@F.pandas_udf(_struct(setup=TEXTS, test=T.StringType()))
def setup_and_test_udf(script: pd.Series) -> pd.DataFrame:
    return _structs(map(setup_and_test, script), ["setup", "test"])


FAILURE = re.compile(r"^_{3,} (.+?) _{3,}$")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def failure_blocks(log: pd.Series) -> pd.Series:
    """Texts of a pytest log's failures by test name."""

    def one(text):
        out, name = {}, None
        for line in (text or "").split("\n"):
            if m := FAILURE.match(line):
                name = m[1]
                out[name] = []
            elif re.match(r"^=+ .* =+$", line):
                name = None
            elif name is not None:
                out[name].append(line)
        return {k: "\n".join(v).strip("\n") for k, v in out.items()}

    return log.map(one)
