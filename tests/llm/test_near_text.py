from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_operators import slow_spans
from trajlake.llm import decontaminate, mixing, near_text

SF = "/root/testdata/sf0.001"


def slow_classes(docs, percent=80, shingle=5):
    """Least id of each id's class, by comparing all pairs of sets of strings."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and root[a] != root[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return root


def test_near_texts_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([60, 200, 5000]))]
        for copy in range(6):
            new = list(text)
            for _ in range(int(len(text) * rng.choice([0, 0.01, 0.018, 0.022, 0.03]))):
                new[rng.randrange(len(new))] = rng.choice(words)
            docs.append((len(docs), " ".join(new)))
    docs += [(100, None), (101, ""), (102, " \n"), (103, "a b"), (104, "A  b"), (105, "a c")]
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == slow_classes(docs)
    assert got[104] == 103 and got[105] == 105 and got[102] == 100 and len(set(got.values())) < len(got)


def test_common_counts_and_the_threshold():
    a, b, c = np.arange(0, 90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64), np.arange(11, 101, dtype=np.uint64)
    assert np.triu(near_text.common_counts([a, b, c]), 1).tolist() == [[0, 80, 79], [0, 0, 89], [0, 0, 0]]
    nodes = np.array([5, -7, 3])
    u, v = near_text.similar_links(nodes, nodes, [a, b, c], 80)
    assert sorted(zip(u.tolist(), v.tolist())) == [(3, -7), (5, -7)]  # 80 of 100 and 89 of 91, but not 79 of 101


def test_every_pair_in_the_radius_of_a_piece_meets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        bits = rng.choice(near_text.WIDTH, near_text.RADIUS, replace=False)
        assert any(not any(int(m) >> int(b) & 1 for b in bits) for m in near_text.MASKS)


def test_spread_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (3, 2), dtype=np.uint64)[rng.integers(0, 3, 120)]
    flips = np.array([[np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 6, dtype=np.uint64)) for _ in range(2)] for _ in range(120)])
    a, b = (base ^ flips).T.copy()
    u, v = (np.concatenate(x) for x in near_text.spread(a, b, 20))
    root = {int(x): int(x) for x in a}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(u.tolist(), v.tolist()):
        root[find(x)] = find(y)
    for i in range(120):
        for j in range(120):
            if int(a[i] ^ a[j]).bit_count() + int(b[i] ^ b[j]).bit_count() <= 20:
                assert find(int(a[i])) == find(int(a[j]))
    assert len({find(int(x)) for x in a}) >= 3


def test_large_canopies_part_by_part(spark, monkeypatch):
    """Variants of one text that all resemble the text and hardly each other, and some that resemble none."""
    monkeypatch.setattr(near_text, "PART_SETS", 8)
    rng = random.Random(6)
    base = [f"v{rng.randint(0, 9000)}" for _ in range(200)]
    docs = [(1000, " ".join(base))]
    for i in range(90):
        new = list(base)
        for _ in range(rng.choice([3, 4, 5, 7, 8])):
            new[rng.randrange(200)] = f"x{rng.randint(0, 9000)}"
        docs.append((i, " ".join(new)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = near_text.written(near_text.numbered(near_text.shingle_sets(df), None), "sets")
    nodes = sets.select("node", "base", "more", "n", "t", near_text.first_word(F.col("w")).alias("a"), F.lit(1).cast("long").alias("root"))
    members = near_text.written(nodes.crossJoin(nodes.groupBy().agg(near_text._parts().alias("parts"))), "members")
    used = near_text.written(near_text.sets_of(df, members), "used")
    links = near_text._links_in(members, used, 80)
    id_of = {r["node"]: r["doc_id"] for r in sets.collect()}
    root = {i: i for i, _ in docs}
    for r in links.collect():
        a, b = root[id_of[r["u"]]], root[id_of[r["v"]]]
        root = {k: min(a, b) if x in (a, b) else x for k, x in root.items()}
    assert root == slow_classes(docs) and len(set(root.values())) > 3


def test_one_of_each_judges_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, "b"), (None, text, "c"), (3, text + " z", "a"), (9, "other words", "d"), (9, "other words", "e"), (None, "alone here", "f"), (None, "alone here", "f"), (8, None, "g"), (None, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = [tuple(r) for r in near_text.one_of_each(df).collect()]
    assert sorted((r for r in got if r[0] != 9), key=str) == sorted([(3, text + " z", "a"), (8, None, "g"), (None, "alone here", "f")], key=str)
    assert len([r for r in got if r[0] == 9]) == 1


def test_stage_drops_near_copies_that_fingerprints_tell_apart(spark):
    by_name = dict(corpus_pipeline.STAGES)
    one = by_name["quality_rules"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    root = slow_classes([(r["doc_id"], r["text"]) for r in one.collect()])
    assert root[177] == 1  # similarity 0.83, nine bits apart
    assert {r["doc_id"] for r in by_name["near_duplicates"](spark, one, SF).collect()} == {i for i in root if root[i] == i}


def test_stages_after_near_duplicates(spark):
    by_name = dict(corpus_pipeline.STAGES)
    one = by_name["quality_rules"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    two = by_name["near_duplicates"](spark, one, SF)
    rows = two.collect()
    three = by_name["repeats"](spark, two, SF)
    want = {i: (n, gone) for i, n, gone, _, _ in slow_spans([(r["doc_id"], r["text"].encode()) for r in rows], 50)}
    for r in three.collect():
        n, gone = want[r["doc_id"]]
        assert 0 <= len(r["text"].encode()) - (n - gone) <= 3 * (gone > 0) * n and r["n_chars"] == len(r["text"])
    four = by_name["decontamination"](spark, three, SF)
    m = decontaminate.Matcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 0.08)
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect() if not m.search(r["text"])}
    five = by_name["mixing"](spark, four, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rates = {r["doc_id"]: r["copies"] for r in mixing.mixed(four, labels, corpus_pipeline.FACTORS, relative=True).collect()}
    counted = {r["doc_id"]: r["n"] for r in five.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {i: c for i, c in rates.items() if c}
