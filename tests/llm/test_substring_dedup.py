from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

import trajlake.llm.substring_dedup as sd
from trajlake.llm.substring_dedup import OP13_SQL, Words, op13_prefix_suffix_trees, substring_dedup


def plain(rows, length):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - length + 1) if i is not None else ():
            k = tuple(w[a : a + length])
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for a in range(len(w) - length + 1) if i is not None else ():
            if least[tuple(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        spans = sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone))
        out.append((i, len(w), sum(gone), spans, hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "GROUPS", (1 << 14, 20, 3)[seed])  # the fewer groups, the more prefixes are made longer
    rng = random.Random(seed)
    passages = [[rng.choice(["a", "b", "ccc", "ü", "x" * 40]) for _ in range(rng.randint(3, 40))] for _ in range(4)]
    rows = []
    for i in range(60):
        w = [w for _ in range(rng.randint(0, 4)) for w in ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] + rng.choice(passages))]
        rows.append((rng.choice([i, i, i, 7, None]), "".join(x + rng.choice([" ", "  ", "\n", "\t"]) for x in w) if i % 9 else None))
    rows += [rows[3], rows[5], (1000, rows[8][1]), (-5, rows[11][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for length in (13, 4):
        assert rows_of(substring_dedup(df, length, block_bytes=400)) == plain(rows, length)


def test_groups_of_copies_and_long_words(spark):
    text, long = " ".join(f"w{i}" for i in range(30)), " ".join(["y" * 3000, *(f"v{i}" for i in range(20))])
    rows = [(i, text) for i in range(300)] + [(i, f"own{i} " + text) for i in range(300, 330)] + [(400, long), (401, "z " + long), (402, long.replace("y", "q")), (403, "q" * 2_000_000), (404, "n " * 200_000), (405, "n " * 200_000 + "m"), (406, ""), (407, " \n ")]
    got = rows_of(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), block_bytes=2000))
    assert got == plain(rows, 13)
    assert sum(r[2] == r[1] == 30 for r in got) == 299


def test_spaces_and_control_characters(spark):
    rows = [(1, "a\x00b c d e f\x0bg\x0ch\ri\x1fj " * 5), (2, "a\x00b  c d\ne f g h i\x1fj " * 5), (3, "a b " * 20)]
    assert rows_of(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows, 13)


def test_other_columns_pass_and_the_empty_table(spark):
    schema = "doc_id long, text string, block string, told map<string,int>, n_words struct<a:int>, rest string"
    rows = [(1, "one two three four five", "b", {"k": 1}, (1,), "r1"), (2, "zero one two three four", "c", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    named = df.select("doc_id", "text", *[df[c].alias(f"_{c}") for c in df.columns[2:]])
    got = {r.doc_id: r for r in substring_dedup(named, 3, rest=("_block", "_told", "_n_words", "_rest"), texts=True).collect()}
    assert got[1].kept == rows[0][1] and got[1]._told == {"k": 1} and got[1]._n_words.a == 1 and got[2]._rest is None
    assert got[2].kept == "zero" and (got[2].n_removed, got[2].n_spans) == (4, 1)
    assert rows_of(substring_dedup(df.filter("false"))) == []
    assert rows_of(substring_dedup(spark.createDataFrame([(None, None)], "doc_id long, text string"))) == plain([(None, None)], 13)


def test_hashes_tell_words_from_their_neighbours():
    x = Words([1, 2], [12, 7], b"aa b aa  b cab aa b")
    assert len(set(x.hashes(x.windows(2), 2).tolist())) == 4 and x.n_words.tolist() == [5, 3]
    one, back = x.distinct(x.windows(2), 2)
    assert len(one) == 4 and back.tolist().count(back[0]) == 3


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(3)
    text = [" ".join(rng.choice("abcd") for _ in range(60)) for _ in range(6)]
    rows = [(i, text[i % 6][: rng.randint(0, 120)] if i % 7 else None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(op13_prefix_suffix_trees(spark, str(tmp_path))) == sorted(db.execute(OP13_SQL).fetchall(), key=str) == plain(rows, 13)
