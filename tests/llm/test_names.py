"""Tables with columns of the names that stages use inside, of types that can't be compared, and with colliding hashes."""

from __future__ import annotations

import numpy as np
import corpus_pipeline
from pyspark.sql import functions as F
import pytest

from trajlake.llm import language_id, near_text

SF = "/root/testdata/sf0.001"
NAMES = ["_t", "_d", "_t_", "_t2", "_one", "_k", "t", "t2", "d", "one", "node", "base", "more", "root", "klass", "best", "p", "p_low", "n_tokens", "copies", "rate", "copy", "rest", "kept", "told", "block", "bucket", "data", "item_id", "_r0", "_m0", "n_removed"]
PROSE = "The cat sat on the mat, and that was the end of it for the day. " * 6


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, name):
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES) + ", tags map<string,int>, nest struct<doc_id:int,text:string>"
    of = lambda i, t: (i, t, "en", len(t), *[f"{n} of {i}" for n in NAMES], {"k": i or 0, "l": 2}, (i, "x"))
    rows = [of(1, PROSE + "one"), of(2, PROSE + "one"), of(3, "Other words are here, and they are not the same as the ones that were there. " * 5), of(3, "Other words are here, and they are not the same as the ones that were there. " * 5), of(None, "Nothing of this has an id, but it is a text of its own, as all may see. " * 6)]
    df = spark.createDataFrame(rows, schema)
    out = dict(corpus_pipeline.STAGES)[name](spark, df, SF)
    assert out.columns[: len(df.columns)] == df.columns
    assert set(out.columns[len(df.columns) :]) == ({"_rate", "_copy"} if name == "mixing" else set())
    for r in out.collect():
        assert all(r[n] == f"{n} of {r.doc_id}" for n in NAMES) and r.tags == {"k": r.doc_id or 0, "l": 2} and r.nest.doc_id == r.doc_id
    if name == "near_duplicates":
        assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]


def test_sets_that_share_a_hash_are_told_apart(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(40)) + (" tail" if i % 3 else "")) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in near_text.near_texts(df).collect()}
    assert set(want.values()) == {i - i % 3 for i in range(30)}
    real = near_text.node_of
    found = {real(near_text.shingles(t.encode())) for _, t in rows}
    few = {x: k % 4 for k, x in enumerate(sorted(found))}  # 20 sets share four numbers
    monkeypatch.setattr(near_text, "node_of", lambda hashes: few[int(np.uint64(near_text.xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))])
    assert {r.doc_id: r.component_id for r in near_text.near_texts(df).collect()} == want
    assert {r.doc_id for r in near_text.one_of_each(df).collect()} == set(want.values())


def test_bitmaps_grow_with_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BITS", 1 << 15)
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = near_text.bits_of(hashes, "h")
    assert 8 * len(bits.value) >= 16 * 5000
    there = near_text.in_bits(bits, hashes.toArrow().column(0).combine_chunks())
    other = near_text.in_bits(bits, spark.range(5000, 10000).select(F.xxhash64("id").alias("h")).toArrow().column(0).combine_chunks())
    assert there.all() and other.mean() < 0.1


def test_languages_are_bounded(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of it "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("tag"), F.col("id").cast("string"))).otherwise(F.when(F.col("id") % 2 == 0, "en").otherwise("de")).alias("lang"))
    got = language_id.dictionaries(df, F.lit(True), languages=5, total_bytes=4000)
    assert list(got)[:2] == ["de", "en"] and len(got) == 5 and sum(map(len, got.values())) <= 4000
    assert len(language_id.dictionaries(df, F.lit(True))) == 128
