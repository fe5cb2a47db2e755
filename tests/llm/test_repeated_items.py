from __future__ import annotations

from trajlake.llm import decontaminate

FIRST = "the quick brown fox jumps over the lazy dog near the old river bank"
OTHER = "seven wise owls counted every silver star above the frozen northern lake"


def test_every_text_of_an_item_is_found(spark):
    docs = spark.createDataFrame([(1, f"x {FIRST} y"), (2, f"x {OTHER} y"), (3, f"{OTHER[:-1]} and {FIRST}"), (4, "nothing of either")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, FIRST), (5, OTHER), (5, FIRST), (6, OTHER)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(1, 5, 0), (2, 5, 0), (2, 6, 0), (3, 5, 0), (3, 6, 1)]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()] == [4]
