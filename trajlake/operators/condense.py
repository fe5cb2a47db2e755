"""Transcripts cut to a budget, by running sums over their texts in the order in which they may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condense(df: DataFrame, key: str, order: list[str], role: str, text: str, budget: int, placeholder: str = "(omitted)", size=F.char_length, out: str = "condensed") -> DataFrame:
    """df with `out`: the text, or the placeholder where it has to go for its transcript to fit into the budget.

    As long as the sizes of a transcript's texts sum to more than the budget, the oldest user text but the first goes, and when there
    is none left, the longest of the others that is longer than the placeholder, of equals the first. order must tell a
    transcript's rows apart. A null text has no size and stays; a null role is no user. One shuffle by key; a
    transcript's rows are read as a sorted stream, however many there are.
    """
    mine = Window.partitionBy(key)
    places = {"_i": F.row_number().over(mine.orderBy(*order)), "_n": F.coalesce(size(F.col(text)).cast("long"), F.lit(0)), "_user": F.coalesce(F.col(role) == "user", F.lit(False))}
    rows = df.withColumns(places).withColumns({"_total": F.sum("_n").over(mine), "_first": F.min(F.when(F.col("_user"), F.col("_i"))).over(mine)})
    mark = size(F.lit(placeholder)).cast("long")
    other = F.col(text) != placeholder
    turn: Column = F.when(F.col("_user") & (F.col("_i") != F.col("_first")) & other, 0).when(~F.col("_user") & other & (F.col("_n") > mark), 1)
    rows = rows.withColumn("_turn", turn)
    going = mine.orderBy(F.asc_nulls_last("_turn"), F.when(F.col("_turn") == 0, F.col("_i")).otherwise(-F.col("_n")), "_i")
    gain = F.when(F.col("_turn").isNotNull(), F.col("_n") - mark).otherwise(0)
    before = F.col("_total") - F.coalesce(F.sum(gain).over(going.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_left", before)
    # a text goes if the budget is passed before its turn and has been before all turns ahead of it
    gone = F.col("_turn").isNotNull() & (F.min("_left").over(going.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > budget)
    return rows.withColumn(out, F.when(gone, placeholder).otherwise(F.col(text))).drop("_i", "_n", "_user", "_total", "_first", "_turn", "_left")
