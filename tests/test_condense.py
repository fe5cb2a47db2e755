from __future__ import annotations

import random

import pytest

from trajlake.functions.udfs import condensed
from trajlake.operators.condense import condense

SCHEMA = "k int, i int, role string, text string"


def step_by_step(blocks, budget, placeholder="(omitted)"):
    """The rule as it is told: one text goes at a time."""
    out = [tuple(b) for b in blocks]
    first_user = next((i for i, (r, _) in enumerate(out) if r == "user"), -1)
    while sum(len(t) for _, t in out) > budget:
        users = [i for i, (r, t) in enumerate(out) if r == "user" and i != first_user and t != placeholder]
        others = [i for i, (r, t) in enumerate(out) if r != "user" and t != placeholder and len(t) > len(placeholder)]
        if not users and not others:
            break
        at = users[0] if users else min(others, key=lambda i: (-len(out[i][1]), i))
        out[at] = (out[at][0], placeholder)
    return out


def chats(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["(omitted)", "", "x" * rng.randint(1, 40), "é" * rng.randint(5, 20), "same length!"])
    return [[(rng.choice(["user", "assistant", "tool", "user"]), text()) for _ in range(rng.randint(0, 12))] for _ in range(60)]


@pytest.mark.parametrize("budget", [0, 15, 60, 150])
def test_equal_to_one_text_at_a_time(spark, budget):
    every = chats(budget)
    assert all(condensed(c, budget) == step_by_step(c, budget) for c in every)
    df = spark.createDataFrame([(k, i, r, t) for k, c in enumerate(every) for i, (r, t) in enumerate(c)], SCHEMA).repartition(4)
    got = {(r.k, r.i): r.condensed for r in condense(df, "k", ["i"], "role", "text", budget).collect()}
    assert got == {(k, i): t for k, c in enumerate(every) for i, (_, t) in enumerate(step_by_step(c, budget))}


def test_nulls_and_the_empty_table(spark):
    rows = [(1, 0, "user", "first"), (1, 1, None, "y" * 30), (1, 2, "user", None), (1, 3, "user", "gone"), (None, 0, "user", "z" * 99)]
    got = {(r.k, r.i): r.condensed for r in condense(spark.createDataFrame(rows, SCHEMA), "k", ["i"], "role", "text", 20).collect()}
    assert got == {(1, 0): "first", (1, 1): "(omitted)", (1, 2): None, (1, 3): "(omitted)", (None, 0): "z" * 99}
    assert condense(spark.createDataFrame([], SCHEMA), "k", ["i"], "role", "text", 20).count() == 0
