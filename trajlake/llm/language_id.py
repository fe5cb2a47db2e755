"""Language identification by compression: the language whose raw-content dictionary makes the text smallest.

A text is coded in blocks, each with the dictionary afresh, so that long texts lean on it as much as short ones.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import crc_split, utf8

OTHER = re.compile(r"[\W\d_]+")
NUMBERS = {c: " " for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha()}  # what \w has beside letters
TO_BLANK = str.maketrans(NUMBERS)
BLOCK = 1024
LEVEL = 6


def letters(text: bytes) -> bytes:
    """What of a text tells its language: lower-case letters, a blank for all between them."""
    t = text.decode("utf-8", "replace").lower()
    if not t.isascii() and not NUMBERS.keys().isdisjoint(t):
        t = t.translate(TO_BLANK)
    return OTHER.sub(" ", t).encode()


def dictionaries(docs: DataFrame, keep: Column, texts: int = 128, usual_bytes: int = 1 << 15, content_bytes: int = 1 << 20, languages: int = 128, total_bytes: int = 32 << 20) -> dict[str, bytes]:
    """Raw dictionary content for each language: whole texts of a sample of at most `texts` of its documents.

    keep: condition on doc_id that lets a row be learned from; rows with a null doc_id, lang or text are never learned from.
    A hash of doc_id deals a language's documents to `texts` classes, and of each class the document with the least hash is
    taken, one of at most usual_bytes if there is any. That is a minimum that tasks work out beforehand, so a language
    that holds most rows sends no more than the others, and a repeated id counts once: of its rows the one with the
    least hash of its text is taken. Texts are added whole in the order of their hashes as long as content_bytes, or the
    language's share of total_bytes, is not exceeded; the first always is. Only the `languages` with most rows, then by name,
    are learned, so that what goes through the driver is bounded however many values lang has. They stand in that order.
    """
    h = F.xxhash64(F.col("doc_id").cast("long"))
    over = F.when(F.octet_length("text") > usual_bytes, F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    known = docs.filter(keep & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    content_bytes = min(content_bytes, total_bytes // max(1, len(most)))
    known = known.filter(F.col("lang").isin([r["lang"] for r in most])).select("lang", "text", F.pmod(h, F.lit(texts)).alias("k"), (F.shiftrightunsigned(h, 2) + over).alias("h"))
    least = known.groupBy("lang", "k").agg(F.min("h").alias("h")).collect()
    chosen = docs.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in least], "lang string, h long")
    got = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text")).alias("row"))
    out: dict[str, bytes] = {r["lang"]: b"" for r in most}
    for r in sorted(got.select("lang", "h", utf8(F.col("row.text")).alias("t")).collect(), key=lambda r: (r["lang"], r["h"])):
        more = letters(bytes(r["t"])) + b" "
        if not out[r["lang"]].strip() or len(out[r["lang"]]) + len(more) <= content_bytes:
            out[r["lang"]] += more
    return {k: v for k, v in out.items() if v.strip()}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.coders = []
        for x in self.langs:
            d = zstandard.ZstdCompressionDict(content[x] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: bytes) -> tuple[str, float]:
        """(language, margin): margin is by how much of the second smallest size the smallest is smaller."""
        text = letters(text)
        if not self.langs or not text.strip():
            return "und", 0.0
        s = self.sizes(text)
        best = int(np.argmin(s))
        rest = [x for i, x in enumerate(s) if i != best]
        return self.langs[best], (min(rest) - s[best]) / min(rest) if rest else 1.0


def identified(docs: DataFrame, content: dict[str, bytes], min_margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every whole text.

    lang_pred is the language of the smallest code (of several, the one with most documents), score its margin, rejected
    whether that is under min_margin. Null texts and texts without a letter are und with score 0 and rejected. Repeated
    rows each count; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(content)
        for b in batches:
            lang, score = zip(*map(c.predict, b.column(1).to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.withColumn("rejected", (F.col("score") < min_margin) | (F.col("lang_pred") == "und"))


def op9_language_id_compression(spark, sf_dir):
    """doc_id, held_out, lang_pred, score and rejected of every document; learned from ids whose crc32 mod 5 is not 0."""
    from trajlake.llm.common import table

    docs = table(spark, sf_dir, "documents")
    content = dictionaries(docs, crc_split(F.col("doc_id"), 5) != 0)
    return identified(docs, content).select("doc_id", (crc_split(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
