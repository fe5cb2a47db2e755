from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from trajlake.llm.collocations import OP11_SQL, Coded, collocations, op11_pair_naming

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, least, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[a : a + k]) for k in range(1, longest + 1) for a in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (lang, p), a in candidates.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= share * a and inside(p, q) for (x, q), b in candidates.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), len(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


def corpus(seed, words="abcdeé", size=60):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\x0b", "?!"]) for _ in range(rng.randint(0, 60)))
    rows = [(text().upper() if i % 5 == 0 else text(), rng.choice(["en", "en", "de", "und", None])) for i in range(size)]
    return [*rows, rows[0], rows[1], (None, "en"), ("", "fr"), (" .\t", None), ("New York City " * 30 + "; new york. " * 20, "xx")]


@pytest.mark.parametrize(("longest", "least", "share"), [(3, 10, 50), (2, 3, 50), (5, 4, 80)])
def test_equal_to_brute_force(spark, longest, least, share):
    rows = corpus(longest)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collocations(df, longest, least, share, block_bytes=300)
    assert sorted(map(tuple, got.collect())) == plain(rows, longest, least, share)


def test_the_query_ranks_and_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(corpus(9, size=200), "text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, op11_pair_naming(spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(OP11_SQL).fetchall()) and len(got) > 100
    for lang in {r[0] for r in got}:
        mine = sorted((r for r in got if r[0] == lang), key=lambda r: r[1])
        assert [r[1] for r in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda r: (-r[7], -r[3], r[2].encode()))


def test_a_phrase_goes_for_a_longer_one_with_half_its_occurrences(spark):
    df = spark.createDataFrame([("new york city " * 1 + ". ", "en")] * 30 + [("new york. ", "en")] * 31, "text string, lang string")
    got = {r.phrase: r for r in collocations(df).collect()}
    assert set(got) == {"new york", "new york city"}  # 30 of 61 is under half; york city only occurs in the longer one
    assert (got["new york city"].l, got["new york city"].r, got["new york city"].score) == (61, 30, 10**6 * 900 // (61 * 30))


def test_control_characters_other_columns_and_empty_tables(spark):
    rows = [("a\x00b c\x1cd e f " * 12, "en", "x"), ("Ä ä " * 12, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, bucket string")
    got = sorted(map(tuple, collocations(df).collect()))
    assert got == plain([r[:2] for r in rows], 3, 10, 50)
    assert collocations(df.filter("false")).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    n = 100_000  # 10^6 a^2 is beyond a long
    df = spark.createDataFrame([("q z " * n * 32 + "q", "en")], "text string, lang string")
    r = {x.phrase: x for x in collocations(df, longest=2).collect()}["q z"]
    a = 32 * n
    assert (r.a, r.l, r.r, r.score) == (a, a + 1, a, 10**6 * a * a // ((a + 1) * a))


def test_numbers_of_words():
    x = Coded(["de", "en", "de"], [3, 5, 1], b"a.aA b a" + b"B")
    assert x.keys == [b"de\xffa", b"de\xffb", b"en\xffa", b"en\xffb"]
    assert [x.keys[c] if c >= 0 else None for c in x.codes] == [b"de\xffa", None, b"de\xffa", None, b"de\xffb", None, b"en\xffa", b"en\xffb", b"en\xffa", None]
