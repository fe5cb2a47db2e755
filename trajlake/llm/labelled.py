"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bounds: dict[int, int], columns: tuple[str, ...] = ("text",)) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, columns, y) of at most bounds[value] labelled documents for each label value, and the values' weights.

    keep: condition on doc_id that lets a row be learned from. The sample takes the first ids in the order of a hash of the
    id, so that it's the same at every run and spread over the corpus. Weights (true count over sampled count) undo the
    bounds. Ids that are null, unlabelled or labelled both ways are not learned from. Of rows with equal ids, however
    many, the one with the least hash of its text is taken, so that the sample holds no more rows than ids. Only the ids
    of the sample, whose number is bounded by the parameter, are broadcast. Empty tables give an empty sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(keep & F.col("doc_id").isNotNull() & F.col("y").isin(*bounds))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows, weights = [], {}
    for y, most in bounds.items():
        got = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        rows += [(r["doc_id"], y) for r in got]
        weights[y] = total.get(y, 0) / max(1, len(got))
    ids = docs.sparkSession.createDataFrame(rows, "doc_id long, y int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64("text").alias("_hash"), *[F.col(c) for c in columns]).alias("row")).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min("row").alias("row"))
    return one.select("doc_id", *[F.col("row")[c].alias(c) for c in columns], "y"), weights
