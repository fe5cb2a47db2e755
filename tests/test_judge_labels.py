"""Judge labels of odd texts, against the query's SQL in DuckDB and against the reference's rule."""

from __future__ import annotations

import re

import duckdb
from pyspark.sql import functions as F

from trajlake.functions import text
from trajlake.plans import QUERIES, SQL

TEXTS = [
    "que noítaga la", "ciónes yesócoción", "osí, ñno", "é no é", "noé yes_ no1", "Noël. YES!", "nо", "yes\nno\r\nx", "Kno", "İno", "noİ", "Nȯ", "nó yeś",
    "[[Yes]] but no", "\\boxed{no} yes", "**no** x", "yes " + "x" * 197, "yes " + "x" * 196, "éyes " + "ñ" * 196, "a\U0001f600no " + "\U0001f600" * 197, "nope, yesterday", "", None, "no-yes", "yes​no", "NO ", "_no_",
]


def test_query_is_its_sql_on_odd_texts(spark, tmp_path):
    rows = [(i, turn, "user", x) for i, x in enumerate(TEXTS) for turn in (3, 7, -1, 0, 1, 2, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: (r[0], str(r[1]), r[2])
    got = sorted((tuple(r) for r in QUERIES["judge_labels"](spark, str(tmp_path)).select("conv_id", "turn", "label").collect()), key=key)
    assert got == sorted(c.execute(SQL["judge_labels"]).fetchall(), key=key)
    assert {r[2] for r in got if r[1] == 3} == {"Yes", "No", "Error"}


def plain(s):
    for pattern in (r"(?:\\boxed|\x08oxed)\s*\{\s*(Yes|No)", r"(?:\[\[|\*\*|\[)\s*(Yes|No)\s*(?:\]\]|\*\*|\])"):
        if m := re.search(pattern, s or "", re.I | re.S):
            return m[1].title()
    found = re.findall(r"\b(yes|no)\b", (s or "")[-200:], re.I)
    return found[-1].title() if found else "Error"


def test_operator_takes_words_of_all_scripts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    assert {r.i: r.label for r in df.select("i", text.judge_label(F.col("x")).alias("label")).collect()} == {i: plain(x) for i, x in enumerate(TEXTS)}
