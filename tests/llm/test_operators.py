from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import common, components, decontaminate, language_id, mixing, quality_fm, quality_rules, simhash, suffix_dedup, token_counts, toxicity, warc
from trajlake.llm.common import fresh_path, whole_keys
from trajlake.llm.queries import ORACLES, QUERIES
from trajlake.llm.run_index import END, RunLengthIndex

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, score string, kept string, y int, p string, t string, rest string"


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the names that operators use."""
    extra = ("fp", "key", "score", "kept", 1, "p", "t", "rest")
    long = "word and more words\n" * 5_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, long, "en", "s", len(long)), (5, "Le chat est là. " * 40, "fr", "s", 600),
            (6, "The cat sat on the mat, and that was the end of it.", "en", None, 50), (6, "The cat sat on the mat, and that was the end of it.", "en", None, 50), (None, "The cat sat on the mat, and that was the end of it.", "en", "s", 50), (7, "1234 %%% ###", "de", "s", 12)]
    return spark.createDataFrame([(*r, *extra) for r in rows], ODD)


def empty_docs(spark):
    return spark.createDataFrame([], ODD)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- SimHash ----


def slow_simhash(text):
    w = (text or "").encode().lower().split()
    import xxhash

    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50, 2000):
        t = " ".join(rng.choice(["a", "B", "Äh", "x\ty", "z"]) for _ in range(n))
        assert simhash.simhash64(t.encode()) == slow_simhash(t)


def test_cover_has_every_pair_in_the_radius():
    rng = random.Random(2)
    masks = [int(m) for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_large_bucket_links_like_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3).astype(np.uint64)
    flips = np.array([sum(1 << int(i) for i in rng.choice(40, rng.integers(0, 5), replace=False)) for _ in range(1500)], dtype=np.uint64)
    fps = np.unique(base[rng.integers(0, 3, 1500)] ^ flips)
    u, v = simhash.link_bucket(fps, 4)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    nodes = range(len(fps))
    assert classes(zip(np.searchsorted(fps, u), np.searchsorted(fps, v)), nodes) == classes(near.tolist(), nodes)
    assert len(u) < len(fps)  # a forest, not all pairs


def test_keys_stay_whole_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    key = np.sort(rng.integers(0, 12, 400))
    value = rng.integers(0, 99, 400)
    cuts = np.sort(rng.integers(0, 401, 60))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(value[a:b])], ["k", "v"]) for a, b in zip([0, *cuts], [*cuts, 400])]
    parts = list(whole_keys(iter(batches), [np.int64, np.uint64]))
    assert np.concatenate([p[0] for p in parts]).tolist() == key.tolist() and np.concatenate([p[1] for p in parts]).tolist() == value.tolist()
    ends = [set(p[0].tolist()) for p in parts]
    assert all(not a & b for i, a in enumerate(ends) for b in ends[i + 1 :]) and len(parts) > 3
    assert list(whole_keys(iter([]), [np.int64])) == []


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    fp = {r[0]: slow_simhash(r[1]) for r in rows}
    ids = sorted(fp)
    want = classes([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert {k: v["component_id"] for k, v in got.items()} == want
    assert {k: v["fp"] % 2**64 for k, v in got.items()} == fp


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    big = spark.createDataFrame([(k, bytes([k]), i) for k, n in ((1, 40), (2, 30), (3, 20), (4, 3)) for i in range(n)], "k long, b binary, i int").union(spark.createDataFrame([(None, None, 0)], "k long, b binary, i int"))
    small = spark.createDataFrame([(k, bytes([k]), f"v{k}") for k in (1, 3, 4, 5)], "k long, b binary, v string")
    for on, drop in (("k", "b"), ("b", "k")):
        got, want = common.spread_join(big.drop(drop), small.drop(drop), on), big.drop(drop).join(small.drop(drop), on)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 63


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


# ---- long repeats ----


def slow_spans(docs, length):
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,block,hot", [(50, 1 << 22, 4096), (50, 3000, 5), (30, 2000, 0), (30, 1 << 22, 8)])
def test_repeats_against_brute_force(spark, length, block, hot):
    rng = random.Random(length + block)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 40))) for _ in range(8)]
    docs = [(None, passages[0]), (500, None), (501, ""), (502, "é" * 300)]
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 4))]
        text = " ".join(parts)
        docs.append((rng.randint(0, 90), text))
        if rng.random() < 0.3:
            docs.append((200 + i, text[: rng.randint(0, 200)] + rng.choice(["x", ""]) + text[rng.randint(0, 100) :]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(df, length, block, hot=hot).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=str) == sorted(slow_spans([(i, (t or "").encode()) for i, t in docs], length), key=str), key


def test_kept_text_has_whole_characters(spark):
    text = "ü" * 60
    df = spark.createDataFrame([(1, "a" + text), (2, text + "z")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(df, texts=True).collect()}
    assert rows[1]["kept"] == "a" + text and rows[2]["kept"] == "z" and rows[2]["n_kept"] == 1


def slow_statistics(rows, queries, most):
    texts = [bytes(r) for r in rows]
    out = []
    for x in map(bytes, queries):
        row = []
        for s in range(len(x)):
            e = s
            while e < len(x) and e - s < most and any(x[s : e + 1] in t for t in texts):
                e += 1
            row.append(e - s)
        out.append(row)
    return np.array(out)


def test_matching_statistics_from_run_ends():
    rng = np.random.default_rng(5)
    for _ in range(25):
        m = int(rng.integers(1, 60))
        rows = rng.integers(97, 97 + int(rng.integers(1, 5)), (3, 30)).astype(np.uint8)[rng.integers(0, 3, m)]
        rows[np.arange(m), rng.integers(0, 30, m)] = 100
        queries = rows[rng.integers(0, m, 10)].copy()
        queries[np.arange(10), rng.integers(0, 30, 10)] = 101 + rng.integers(0, 2, 10)
        index = RunLengthIndex(rows)
        assert m < 20 or len(index.run_start) < index.total / 2
        for most in (30, 12):
            assert (index.matching_statistics(queries, most) == slow_statistics(rows, queries, most)).all()


@pytest.mark.parametrize("length", [30, 50])
def test_contexts_against_all_windows(length, monkeypatch):
    asked = []
    plain = RunLengthIndex.matching_statistics
    monkeypatch.setattr(RunLengthIndex, "matching_statistics", lambda self, q, *a, **k: asked.append(len(q)) or plain(self, q, *a, **k))
    rng = np.random.default_rng(length)
    left, width = length - suffix_dedup.GRAM, 2 * length - suffix_dedup.GRAM
    for _ in range(40):
        n, k = int(rng.integers(1, 200)), int(rng.choice([3, 40]))
        middle = rng.integers(97, 122, (4, suffix_dedup.GRAM)).astype(np.uint8)[rng.integers(0, 4, n)]
        sides = rng.integers(97, 99, (2, k, left)).astype(np.uint8)
        rows = np.concatenate([sides[0][rng.integers(0, k, n)], middle, sides[1][rng.integers(0, k, n)]], axis=1)
        for r in rows:
            if rng.random() < 0.3:
                r[: rng.integers(0, left)] = END
            if rng.random() < 0.3:
                r[width - rng.integers(0, left) :] = END
        least = rng.integers(0, int(rng.choice([5, 1000])), n).astype(np.int64)
        label, seen = {}, {}
        for r, x in zip(map(bytes, rows), least):
            label[r] = min(x, label.get(r, x))
        for r, x in label.items():
            for s in range(left + 1):
                if END not in (r[s], r[s + length - 1]):
                    seen[s, r[s : s + length]] = min(x, seen.get((s, r[s : s + length]), x))
        low, mask = suffix_dedup.compare(rows, least, length)
        assert low.tolist() == [label[bytes(r)] for r in rows]
        assert mask.tolist() == [sum(1 << s for s in range(left + 1) if seen.get((s, bytes(r)[s : s + length]), 1 << 62) < label[bytes(r)]) for r in rows]
    assert len(asked) > 40  # the windows are found by the index


# ---- decontamination ----


def slow_distance(pattern, text):
    col = list(range(len(pattern) + 1))
    best = col[-1]
    for c in text:
        prev, col[0] = col[0], 0
        for i, p in enumerate(pattern, 1):
            prev, col[i] = col[i], min(col[i] + 1, col[i - 1] + 1, prev + (p != c))
        best = min(best, col[-1])
    return best


def test_myers_against_table():
    rng = random.Random(4)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 80), (0, 120)))
        assert decontaminate.myers(p, t)[0] == slow_distance(p, t)


def test_every_match_in_the_budget_is_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 30)))) for i in range(12)] + [(90, None), (91, ""), (None, "a b c")]
    docs = []
    for d in range(60):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, len(t) // 8)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = [rng.choice("abcdefgh")]
        docs.append((d, " ".join(word() for _ in range(30)) + " " + "".join(t) + " " + " ".join(word() for _ in range(30))))
    df = spark.createDataFrame(docs + [(99, None), (98, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, x in items[:12]:
            n = decontaminate.normalise(x)
            e = slow_distance(n, decontaminate.normalise(t))
            if e <= int(0.08 * len(n)):
                want.add((d, i, e))
    for block in (32 << 20, 200):
        got = decontaminate.matches(df, bench, block_bytes=block).collect()
        assert {tuple(r)[:3] for r in got} == want and len(got) == len(want)
        for r in got:
            t, n = decontaminate.normalise(dict(docs)[r["doc_id"]]), decontaminate.normalise(dict(items)[r["item_id"]])
            assert slow_distance(n, t[r["start"] : r["end"]]) == r["distance"]
    assert {r[0] for r in decontaminate.decontaminated(df, bench).select("doc_id").collect()} == {d for d, _ in docs} - {d for d, _, _ in want} | {98, 99}


def test_short_items_need_whole_words():
    m = decontaminate.Matcher([(1, "art of war"), (2, "a")], 0.08, 8)
    assert [x[0] for x in m.search("the Art, of WAR!")] == [1] and not m.search("part of war") and not m.search("art of warning")
    assert [x[0] for x in m.search("part of war and art of war")] == [1] and not m.search("a banana")
    assert [x[0] for x in decontaminate.Matcher([(2, "a")], 0.08).search("a banana")] == [2]


def test_several_blocks_of_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(decontaminate.matches(docs, bench, block_bytes=500)) == key(decontaminate.matches(docs, bench))
    assert key(decontaminate.decontaminated(docs, bench, block_bytes=500)) == key(decontaminate.decontaminated(docs, bench))


# ---- tokens ----


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.transducer(path)
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\r", "\t", "a", "the", "ing", "(", ");", "é", "ß", "中", "😀", "▁", "1", "<s>", "</s>", "\x00", "\xa0", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    assert [t.count(x) for x in texts] == [len(sp.encode(x)) for x in texts]
    whole, token_counts.CHUNK = token_counts.CHUNK, 3
    try:
        assert [t.count(x) for x in texts[:1500]] == [len(sp.encode(x)) for x in texts[:1500]]
    finally:
        token_counts.CHUNK = whole
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()}
    assert got == {r["doc_id"]: (len(r["text"].encode()), len(sp.encode(r["text"]))) for r in docs.collect()}


def test_state_maps_compose_associatively():
    import public_tokenizers

    t = token_counts.transducer(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    for _ in range(300):
        s = "▁" + "".join(rng.choice(["▁", "▁▁", "ab", "the", "x", "="]) for _ in range(12))
        cut = [0, *sorted(rng.sample(range(len(s) + 1), 2)), len(s)]
        a, b, c = (t.chunk_map(s[i:j], s[max(0, i - 1) : i], s[max(0, i - 3) : i]) for i, j in zip(cut, cut[1:]))
        left, right = t.compose(t.compose(a, b), c), t.compose(a, t.compose(b, c))
        assert t.apply(left, token_counts.START) == t.apply(right, token_counts.START) == t.run(s)
        other = t.run(rng.choice(["th", "▁", "a", "=="]))[0]  # a state that nothing foresaw
        assert t.apply(left, other) == t.apply(right, other)


def test_kept_states_are_bounded(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Transducer(token_counts.load_pieces(path))
    for name, value in (("KEPT_STATES", 40), ("KEPT_HOPS", 90), ("KEPT_WORDS", 5), ("CHUNK", 500)):
        monkeypatch.setattr(token_counts, name, value)
    rng = random.Random(9)
    for parts in (["a", "the", "ing", "é", "==", "x"], ["a", "the", " ", "  ", "ing"], ["a"]):
        text = "".join(rng.choice(parts) for _ in range(3000))
        assert t.count(text) == len(sp.encode(text)) and len(t.states) <= 42 and len(t.words) <= 5


@pytest.mark.parametrize("kind", ["blanks", "none", "same"])
def test_very_long_texts_take_linear_memory(kind):
    import subprocess
    import sys

    code = f"""
import random, resource, public_tokenizers, sys
sys.path.insert(0, {sys.path[0]!r})
sys.path.insert(0, '.')
from trajlake.llm import token_counts
t = token_counts.transducer(public_tokenizers.path('piece_bpe_32k.model'))
rng, n = random.Random(1), 16_000_000
piece = ''.join(rng.choice('abcdeinorst' + ('   ' if {kind!r} == 'blanks' else '')) for _ in range(40_000))
text = 'a' * n if {kind!r} == 'same' else piece * (n // len(piece))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = t.count(text)
print(found, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    found, extra = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert found > 1_000_000 and extra < 200


# ---- classifiers ----


def split(rows, mod, out):
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % mod != out], [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % mod == out]


def test_quality_machine_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from trajlake.llm.quality_fm import op3_quality_factorisation_machine as op3

    got = op3(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 40 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.93
    assert docs.count() == op3(spark, "/root/testdata/sf0.01").count()


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    fm = quality_fm.FactorisationMachine(6, 3)
    fm.w[:], fm.v[:] = rng.normal(size=6), rng.normal(size=(6, 3))
    x = rng.normal(size=(4, 6)).astype(np.float32)
    plain = [fm.b[0] + r @ fm.w + sum(fm.v[i] @ fm.v[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(fm.logit(x), plain, atol=1e-4)


def test_machine_gradients_by_finite_differences():
    rng = np.random.default_rng(3)
    fm = quality_fm.FactorisationMachine(5, 2)
    fm.b, fm.w, fm.v = rng.normal(size=1), rng.normal(size=5), rng.normal(size=(5, 2))
    x, y, sw = rng.normal(size=(7, 5)), rng.integers(0, 2, 7).astype(float), rng.random(7)

    def loss():
        z = fm.logit(x)
        return float(((np.logaddexp(0, z) - y * z) * sw).mean()) + 0.05 * float((fm.w**2).sum() + (fm.v**2).sum())

    for p, g in zip((fm.b, fm.w, fm.v), fm.gradients(x, y, sw, 0.1)):
        for i in np.ndindex(p.shape):
            p[i] += 1e-6
            up = loss()
            p[i] -= 2e-6
            down = loss()
            p[i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_domain_gradients_by_finite_differences():
    rng = np.random.default_rng(6)
    params = [rng.normal(size=(6, 3)), rng.normal(size=(2, 3)), rng.normal(size=3)]
    at, stats, hot, sw = [rng.choice(6, rng.integers(0, 4), replace=False) for _ in range(8)], rng.normal(size=(8, 2)), np.eye(3)[rng.integers(0, 3, 8)], rng.random((8, 1))
    for p, g in zip(params, mixing.classifier_gradients(params, at, stats, hot, sw, 0.2)[1]):
        for i in np.ndindex(p.shape):
            p[i] += 1e-6
            up = mixing.classifier_gradients(params, at, stats, hot, sw, 0.2)[0]
            p[i] -= 2e-6
            down = mixing.classifier_gradients(params, at, stats, hot, sw, 0.2)[0]
            p[i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def pairs_of(changes, place):
    cells = [(i, place[f], sign) for i, (gained, lost) in enumerate(changes) for fs, sign in ((gained, 1.0), (lost, -1.0)) for f in fs]
    return toxicity.Pairs(*(np.array(x) for x in zip(*cells)), np.array(list(changes.values()), float))


def test_counterfactual_penalty_lowers_the_score_of_naming_a_group():
    rng = random.Random(9)
    bad, good = ["idiot", "scum"], ["lovely", "thanks"]
    texts, y = [], []
    for i in range(400):
        toxic = i % 2
        words = [rng.choice(bad if toxic else good), f"w{rng.randint(0, 50)}"]
        if rng.random() < (0.5 if toxic else 0.05):
            words.append("muslims")
        texts.append(" ".join(words) + ". Another sentence")
        y.append(toxic)
    sets = [toxicity.features(toxicity.words_of(t)) for t in texts]
    changes = sum((toxicity.differences(t, toxicity.IDENTITY_TERMS) for t in texts), Counter())
    chosen = sorted(set().union(*sets, *(set(x) for d in changes for x in d)))
    place = {f: i for i, f in enumerate(chosen)}
    rows = toxicity.Texts([np.array(sorted(place[f] for f in s)) for s in sets], np.array(y, float), np.ones(400))
    pairs = pairs_of(changes, place)
    models = [toxicity.fit(rows, pairs, len(chosen), strength, ridge=1e-2) for strength in (0.0, 5.0)]
    score = lambda m, t: 1 / (1 + np.exp(-m[0] - sum(m[1][place[f]] for f in toxicity.features(toxicity.words_of(t)) if f in place)))
    plain, tied = (abs(score(m, "muslims live here") - score(m, "people live here")) for m in models)
    assert tied < plain / 2
    assert score(models[1], "idiot") > 0.7 > 0.3 > score(models[1], "lovely")


def test_loss_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    texts = toxicity.Texts([np.sort(rng.choice(9, rng.integers(0, 5), replace=False)) for _ in range(12)], rng.integers(0, 2, 12).astype(float), rng.random(12))
    pairs = toxicity.Pairs(np.array([0, 0, 1, 2]), np.array([1, 2, 3, 8]), np.array([1.0, -1.0, 1.0, -1.0]), np.array([3.0, 1.0, 2.0]))
    p = rng.normal(size=10)
    loss = lambda p: toxicity.loss_gradient(p[:-1], p[-1], texts, pairs, 0.7, 0.1)[0]
    _, g, gb = toxicity.loss_gradient(p[:-1], p[-1], texts, pairs, 0.7, 0.1)
    e = np.eye(10) * 1e-6
    assert np.allclose([*g, gb], [(loss(p + d) - loss(p - d)) / 2e-6 for d in e], atol=1e-6)


def test_swaps_inside_sentences():
    groups = [["people", "women", "men"]]
    f = lambda *w: toxicity.features(w)
    pair = lambda a, b: (tuple(sorted(f(*b) - f(*a))), tuple(sorted(f(*a) - f(*b))))
    assert toxicity.differences("We like women. Men and dogs", groups) == Counter([pair(["women"], ["men"]), pair(["women"], ["men"]), pair(["women"], ["people"]), pair(["men"], ["women"]), pair(["men"], ["women"]), pair(["men"], ["people"])])
    slot = toxicity.differences("one two", groups)  # names no group: the neutral word against a term in one place
    assert len(slot) == 1 and next(iter(slot)) in (pair(["people"], ["women"]), pair(["people"], ["men"]))
    assert not toxicity.differences(None, groups) and not toxicity.differences(" .. ", groups)


def test_toxicity_fit_is_repeatable_and_reports_its_swaps(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = (toxicity.train(d, labels, F.lit(True)) for d in (docs, docs.repartition(5)))
    assert a == b and a.pairs > 100 and a.change_with < a.change_without / 10
    twice = toxicity.train(docs.union(docs), labels, F.lit(True))
    assert twice == a  # a repeated row is learned from once


def test_toxicity_on_held_out_rows(spark):
    from trajlake.llm.toxicity import op4_toxicity_counterfactual as op4

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op4(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").collect()
    found, clean = [r["predicted"] for r in got if r["toxic"] == 1], [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(found) / len(found) > 0.75 and sum(clean) / len(clean) < 0.01


def test_language_on_held_out_rows(spark):
    from trajlake.llm.language_id import op9_language_id_compression as op9

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op9(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_letters_and_ties():
    c = language_id.Classifier({"en": b"the cat sat ", "fr": b"the cat sat "})
    for text in ("", "½ ② ²", "12 34 _ --", "Ⅷ ٣", "€ 😀"):
        assert c.predict(text.encode()) == ("und", 0.0)
    assert c.predict("the cat".encode())[0] == "en" and c.predict("三".encode())[0] == "en"  # equal sizes: the first


def test_language_against_plain_sizes(spark):
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    content = language_id.dictionaries(docs, F.lit(True), texts=8)
    assert language_id.dictionaries(docs.union(docs).repartition(3), F.lit(True), texts=8) == content
    plain = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
    for lang, made in content.items():
        known = [plain(t) for _, t, x in rows if x == lang and t]
        assert sum(plain(made.decode()).count(t) > 0 for t in known if t) >= 4  # whole texts, not beginnings
    got = {r["doc_id"]: r for r in language_id.identified(docs, content).collect()}
    for i, t, _ in rows:
        text = re.sub(r"[\W\d_]+", " ", (t or "").lower()).encode()
        if not text.strip():
            assert got[i]["lang_pred"] == "und"
            continue
        sizes = []
        for d in content.values():
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(text[k : k + 1024])) for k in range(0, len(text), 1024)))
        assert got[i]["lang_pred"] == list(content)[int(np.argmin(sizes))]
        second = sorted(sizes)[1]
        assert got[i]["score"] == pytest.approx((second - min(sizes)) / second)


def test_dictionaries_of_many_copies_of_one_row(spark):
    docs = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    assert language_id.dictionaries(docs, F.lit(True)) == {"en": b"the same words again "}
    long = spark.createDataFrame([(i, "mot " * 20_000, "fr") for i in range(40)], "doc_id long, text string, lang string")
    made = language_id.dictionaries(long, F.lit(True), content_bytes=200_000)
    assert len(made["fr"]) == 160_002  # whole texts as far as they fit


def test_mixing_reaches_its_targets(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mixed(docs, labels, {"low": 0.1, "clean": 0.8, "toxic": 0.1}).collect()
    n = sum(r["n_tokens"] for r in rows)
    for d, share in (("low", 0.1), ("clean", 0.8), ("toxic", 0.1)):
        assert abs(sum(r["n_tokens"] * r[f"p_{d}"] * r["rate"] for r in rows) / n - share) < 0.01
    assert min(r["rate"] for r in rows) >= 0 and all(abs(r["copies"] - r["rate"]) < 1 for r in rows)


def test_rates_are_the_least_squares_fit_where_targets_are_out_of_reach(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 60)
    n = rng.integers(1, 100, 60)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    for targets in ({"low": 0.99, "clean": 0.01, "toxic": 0.0}, {"low": 0.02, "clean": 0.9, "toxic": 0.08}):
        steps, reached, wanted, converged = mixing.fit_rates(df, targets, rounds=200, bound=3.0)
        x = mixing.rates_of(p, steps, 3.0)
        assert (x >= 0).all() and (x <= 3).all() and np.allclose((n * x) @ p, reached) and not converged
        slope = p @ (reached - wanted) / wanted.sum()  # optimal: no slope where the rate is free, none that leads into the box at its walls
        inside = (x > 1e-6) & (x < 3 - 1e-6)
        assert np.abs(slope[inside]).max(initial=0) < 0.01 and slope[x <= 1e-6].min(initial=0) > -0.01 and slope[x >= 3 - 1e-6].max(initial=0) < 0.01


def test_missed_targets_are_told(spark):
    docs = spark.createDataFrame([(i, f"plain words here {i}") for i in range(8)], "doc_id long, text string")
    with pytest.warns(UserWarning, match="miss the targets"):
        out = mixing.mixed(docs, labels_of(spark, [(0, 1, 0), (1, 1, 0)]), {"toxic": 1.0}, total=50.0).collect()
    assert len(out) == 8 and max(r["rate"] for r in out) <= mixing.BOUND


def test_one_row_of_a_repeated_id_is_learned_from(spark):
    from trajlake.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(1, f"t{i}", i) for i in range(500)] + [(2, "b", 0), (None, "c", 0)], "doc_id long, text string, n_chars long")
    sample, weights = labelled_sample(docs, labels_of(spark, [(1, 1, 0), (2, 0, 0), (None, 1, 1)]), "quality", F.lit(True), {0: 1, 1: 1})
    rows = [tuple(r) for r in sample.collect()]
    again = [tuple(r) for r in labelled_sample(docs.repartition(7), labels_of(spark, [(1, 1, 0), (2, 0, 0)]), "quality", F.lit(True), {0: 1, 1: 1})[0].collect()]
    assert len(rows) == 2 and sorted(rows) == sorted(again) and weights == {0: 1.0, 1: 1.0}


# ---- rules ----


def test_quality_rules_measures(spark):
    rng = random.Random(11)
    texts = ["", None, " \n ", "a a a a a", "x y z x y z", "a\nb\na\n\n a\nb", "\x0ba\x0cb\x1fc", "# * $ % & | < > é"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 300))) + "\n" * rng.randint(0, 3) for _ in range(40)]
    got = quality_rules.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_texts_without_common_words_and_in_other_languages_go(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1"), "doc_id").collect()]
    docs = [d for d in docs if len(d[1].split()) >= 120]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = lambda rows: quality_rules.judge(frame(rows)).filter("kept or base_failed").count() / len(rows)
    assert kept(docs) > 0.98
    none = [(i, " ".join(w for w in t.split() if w.lower().strip(".,") not in quality_rules.COMMON), x) for i, t, x in docs]
    assert kept(none) < 0.02
    for a, b, most in (("en", "de", 0.02), ("de", "en", 0.05), ("en", "fr", 0.02), ("fr", "en", 0.1), ("fr", "es", 0.5), ("es", "fr", 0.5)):
        assert kept([(i, t, b) for i, t, x in docs if x == a]) <= most, (a, b)


def test_js_distance_bounds(spark):
    row = spark.range(1).select(*[quality_rules.js_distance(F.array(*map(F.lit, map(float, a))), F.array(*map(F.lit, map(float, b)))).alias(n) for n, a, b in (("same", (2, 2), (0.5, 0.5)), ("far", (5, 0), (0, 1)), ("none", (0, 0), (0.5, 0.5)))]).first()
    assert row["same"] == pytest.approx(0) and row["far"] == pytest.approx(1) and row["none"] is None


# ---- WARC ----


def test_warc_round_trip_is_exact_and_repeatable(spark):
    rng = random.Random(12)
    rows = [(i, f"http://x/{i}", "<p>" + "".join(rng.choice("abc é") for _ in range(rng.randint(0, 3000)))) for i in range(200)]
    rows += [(300, None, None), (301, "http://y\r\nEvil: 1", ""), (302, "u", rows[5][2]), (303, "u", rows[5][2]), (302, "u", rows[5][2]), (None, "n", "null id"), (5, rows[5][1], rows[5][2]), (2**62, "far", "far"), (-(2**62), "near", "near")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    names, read = [], []
    for order in (rows, rows[::-1]):
        path = fresh_path(spark, "warc-test")
        manifest = warc.write_warcs(spark.createDataFrame(order, df.schema).repartition(5), path, shard_bytes=40_000, roll_bytes=9_000)
        names.append(sorted((r["name"], r["sha256"], r["records"]) for r in manifest.collect()))
        read.append(sorted((tuple(r)[:5] for r in warc.read_warcs(spark, path, manifest).collect()), key=str))
    assert names[0] == names[1] and len(names[0]) > 5 and read[0] == read[1]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want, seen = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b, m = (h or "").encode(), first.get(h or "")
        again = i is not None and (i != m or (i, h) in seen)
        seen.add((i, h))
        want.append((i, len(b), warc.sha1_base32(b), "revisit" if again else "response", m if again else None))
    assert read[0] == sorted(want, key=str)


def test_shard_bounds_divide_clustered_ids(spark):
    ids = list(range(1000)) + [10**15 + i for i in range(1000)] + [-(2**62), 2**62]
    df = spark.createDataFrame([(i, 10) for i in ids], "id long, bytes long")
    bounds = warc.shard_bounds(df, 500)
    sizes = np.diff([0, *np.searchsorted(sorted(ids), bounds), len(ids)]) * 10
    assert max(sizes) <= 500 and len(bounds) < 80


def test_pages_without_an_id_are_dealt_to_shards(spark):
    rows = [(None, f"u{i}", f"{i:04d}" * 50) for i in range(300)] + [(i, "u", "x" * 100) for i in range(20)]
    path = fresh_path(spark, "warc-test")
    manifest = warc.write_warcs(spark.createDataFrame(rows, "page_id long, url string, html string"), path, shard_bytes=20_000)
    files = manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert len(files) > 8 and max(r["n"] for r in files) < 100
    read = warc.read_warcs(spark, path, manifest).collect()
    assert len(read) == 320 and sum(r["record_type"] == "response" for r in read) == 301


# ---- every operator on odd and empty tables ----


def test_odd_and_empty_tables(spark):
    import public_tokenizers

    labels = labels_of(spark, [(4, 1, 0), (5, 1, 0), (6, 0, 1), (7, 0, 0), (8, None, None), (None, 1, 1), (6, 0, 1)])
    none = labels_of(spark, [])
    bench = spark.createDataFrame([(1, "The cat sat on the mat"), (2, None)], "item_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    for docs, n in ((odd_docs(spark), 9), (empty_docs(spark), 0)):
        assert simhash.near_duplicates(docs).count() == n
        assert suffix_dedup.suffix_dedup(docs, rest=("lang", "kept"), texts=True).count() == n
        assert token_counts.token_counts(docs, path).count() == n
        assert quality_rules.judge(docs).count() == n
        assert decontaminate.decontaminated(docs, bench).count() == (n and n - 3)  # the row without an id too
        assert decontaminate.matches(docs, bench.limit(0)).count() == 0
        for lab in (labels, none):
            keep = F.lit(True)
            assert quality_fm.scored(docs, quality_fm.train(docs, lab, keep)).filter("score between 0 and 1").count() == n
            assert toxicity.scored(docs, toxicity.train(docs, lab, keep)).filter("score between 0 and 1").count() == n
            assert mixing.mixed(docs, lab).filter("rate >= 0").count() == n
        found = {r["doc_id"]: r for r in language_id.identified(docs, language_id.dictionaries(docs, F.lit(True))).collect()}
        if n:
            assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[7]["lang_pred"] == "und" and found[5]["lang_pred"] == "fr"
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-empty")
    assert warc.read_warcs(spark, path, warc.write_warcs(pages, path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())
