"""Chunks of long texts as rows."""

from __future__ import annotations

import random

import public_tokenizers
import sentencepiece

from trajlake.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(4)
    words = ["the", "running", "Überraschung", "x" * 30, "naïve", "1234567", "\u2581", "<s>", "日本語", "\n", "\t", "a"]
    out = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "", "   "]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    return out + ["a" * 5000, " " * 3000, "ab" * 2500, "", "x", "word " * 900 + "y" * 2000 + " end", "é" * 700 + " " * 90 + "z"]


def test_chunks_as_rows_count_as_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[0], rows[40], rows[40], (None, rows[40][1]), (99, None), (40, rows[42][1])]
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for chunk in (7, 64, 1000):  # at 7 the maps of one text take three levels
        assert sorted((tuple(r) for r in token_counts.token_counts(df, PATH, chunk).collect()), key=str) == want


def test_maps_joined_are_maps_of_the_whole(spark):
    t = token_counts.transducer(PATH)
    for text in filter(None, texts()):
        s = token_counts.BAR + text.replace(" ", token_counts.BAR)
        maps = [t.chunk_map(s[i : i + 11], s[max(0, i - 1) : i], s[max(0, i - 64) : i]) for i in range(0, len(s), 11)]
        left = maps[0]
        for m in maps[1:]:
            left = t.joined_map(left, m)
        while len(maps) > 1:  # another order of composition
            maps = [t.joined_map(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        assert t.apply(left, token_counts.START)[1] == t.apply(maps[0], token_counts.START)[1] == t.count(text)
        kept = token_counts.map_columns([left])[3][0].as_py()
        assert left.exit == (None if kept is None else token_counts.state_of(kept))


def test_no_long_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, token_counts.token_counts(df, PATH).collect())) == [(1, 3, 2), (2, 0, 0)]
    assert token_counts.token_counts(df.filter("false"), PATH).count() == 0
