"""A training corpus from raw documents, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.common import remove, scratch, table, written
from trajlake.llm.decontaminate import decontaminated
from trajlake.llm.mixing import mixed
from trajlake.llm.near_text import one_of_each
from trajlake.llm.quality_rules import quality
from trajlake.llm.suffix_dedup import suffix_dedup


#: What mixing makes of the tokens that each domain still has; the rest is clean text, scaled so that the corpus keeps its size.
FACTORS = {"low": 0.5, "clean": 1.0, "toxic": 0.5}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and short texts go; repeated rows are judged alike."""
    return docs.filter(quality(F.col("text"), F.col("lang"))["kept"])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by at least 80 % of common five-word shingles the document with the least id.

    Rows without an id are judged too and give way to rows with one; of repeated rows (equal ids and texts) one stays. All
    columns are kept as they are, whatever their names and types.
    """
    return one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long passages that earlier ones have; what is emptied goes; n_chars is counted anew.

    A null text is empty and stays as an empty one; rows with equal ids don't remove from each other, rows without an id neither
    remove nor lose. Other columns are kept as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_r{i}" for i, c in enumerate(others)}  # names of their own, whatever the table's are
    out = suffix_dedup(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()]), rest=tuple(names.values()), texts=True)
    out = out.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.col("n_kept")} | {c: F.col(n) for c, n in names.items() if c != "n_chars"}
    return out.select(*[new[c].alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, whether they have an id or not."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, with rate and copy (from 1); a table with columns of these names gets _rate and _copy.

    Targets follow from what the stages before have kept: a domain's tokens times its factor, scaled to the size of the
    corpus. No rate exceeds mixing.BOUND; a rate below one is the chance to stay, by a hash of the id, so that rows with equal ids
    go or stay alike. All columns of the table are kept as they are.
    """
    others = {c: f"_m{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}  # names of their own, whatever the table's are
    out = mixed(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in others.items()]), table(spark, sf_dir, "labels"), FACTORS, relative=True).filter("copies > 0")
    new = []
    for name in ("rate", "copy"):
        while name in docs.columns:
            name = "_" + name
        new.append(name)
    return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns], F.col("rate").alias(new[0]), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(new[1]))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed_to_targets),
]

#: SQL has no SimHash over seeded XXH64, no removal of byte spans and no fitted classifier; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages write on the way is removed from the shared folder."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        remove(spark, [before.folder] if hasattr(before, "folder") else [])
        before = docs
    return docs
