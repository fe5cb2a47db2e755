"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words present and their stems. In labelled sentences that name a group, the group's terms are swapped
for others of their kind and for a neutral one; in a text that names none, one word of one sentence gives its place to a term
and to the neutral word of its kind. A difference between the scores of a sentence and its copy is penalised, so that
naming a group doesn't move the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import crc_split, written
from trajlake.llm.labelled import labelled_sample

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
STEM = "^"
KEPT_WORDS, KEPT_CHARS = 400_000, 32
# Terms for groups of people by kind; the first of a row is neutral.
IDENTITY_TERMS = [
    ["people", "women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["person", "woman", "man", "girl", "boy"],
    ["people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["religious", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["people", "gays", "lesbians", "bisexuals", "heterosexuals"],
    ["any", "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"],
    ["any", "black", "white", "asian", "african", "latino", "arab", "european"],
    ["people", "immigrants", "refugees", "foreigners", "natives"],
    ["any", "disabled", "deaf", "blind", "elderly", "young"],
    ["leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwule", "lesben"],
    ["gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "homosexuels", "lesbiennes"],
    ["gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "homosexuales", "lesbianas"],
]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> tuple[int, ...]:
    """Numbers of a word and of its first four to six letters, which stand for words that were never seen."""
    return zlib.crc32(word.encode("utf-8", "replace")), *(zlib.crc32((STEM + word[:k]).encode("utf-8", "replace")) for k in (4, 5, 6) if len(word) > k)


def features(words: Iterable[str]) -> set[int]:
    return set().union(*map(features_of, words))


def swaps(groups: list[list[str]]) -> list[dict[str, str]]:
    """Three ways to swap: each term for the next of its kind, for the one before, and for the neutral one."""
    forward, back, neutral = {}, {}, {}
    for kind in groups:
        terms = kind[1:]
        for i, t in enumerate(terms):
            forward.setdefault(t, terms[(i + 1) % len(terms)])
            back.setdefault(t, terms[i - 1])
            neutral.setdefault(t, kind[0])
    return [forward, back, neutral]


def differences(text: str | None, groups: list[list[str]]) -> Counter:
    """(features gained, features lost) by each swap in a text's sentences, each a sorted tuple, with how often it occurs.

    A swap that changes no feature of its sentence isn't counted.
    """
    terms = {t for kind in groups for t in kind}
    sentences = [w for w in (WORD.findall(x) for x in SENTENCE.split((text or "").lower())) if w]
    named = [set(w) for w in sentences if not terms.isdisjoint(w)]
    pairs = [(s, {how.get(w, w) for w in s}) for s in named for how in swaps(groups)]
    if sentences and not named and groups:
        pick = zlib.crc32((text or "").encode("utf-8", "replace"))
        words, kind = sentences[pick % len(sentences)], groups[(pick >> 8) % len(groups)]
        at, term = (pick >> 16) % len(words), kind[1 + (pick >> 4) % (len(kind) - 1)]
        pairs = [({*words[:at], kind[0], *words[at + 1 :]}, {*words[:at], term, *words[at + 1 :]})]
    found: Counter = Counter()
    for before, after in pairs:
        a, b = features(before), features(after)
        if a != b:
            found[tuple(sorted(b - a)), tuple(sorted(a - b))] += 1
    return found


class Texts(NamedTuple):
    """Labelled texts as places in a vocabulary (one array each), their labels and weights."""

    places: list[np.ndarray]
    y: np.ndarray
    weight: np.ndarray


class Pairs(NamedTuple):
    """Swaps as rows of a sparse matrix of what a swap changes: (row, place, +1 or -1), and how often each occurs."""

    row: np.ndarray
    place: np.ndarray
    sign: np.ndarray
    count: np.ndarray

    def change(self, w: np.ndarray) -> np.ndarray:
        """By how much each swap moves the logit."""
        return np.bincount(self.row, weights=w[self.place] * self.sign, minlength=len(self.count))


class Model(NamedTuple):
    """Intercept, weight of each feature number, and what is known of the swaps: how many, mean change of the score by
    one without and with the penalty."""

    intercept: float
    weights: dict[int, float]
    pairs: int = 0
    change_without: float = 0.0
    change_with: float = 0.0


def loss_gradient(w: np.ndarray, b: float, texts: Texts, pairs: Pairs, strength: float, ridge: float) -> tuple[float, np.ndarray, float]:
    """(loss, its gradient by w, by b): weighed mean log loss + ridge / 2 |w|^2 + strength * mean squared change by a swap."""
    n = len(texts.y)
    row, col = np.repeat(np.arange(n), [len(p) for p in texts.places]), np.concatenate([*texts.places, np.empty(0, np.int64)]).astype(np.int64)
    z = b + np.bincount(row, weights=w[col], minlength=n)
    share = texts.weight / max(1e-300, texts.weight.sum())
    loss = float(share @ (np.logaddexp(0, z) - texts.y * z)) + ridge / 2 * float(w @ w)
    e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - texts.y) * share
    g = np.bincount(col, weights=e[row], minlength=len(w)) + ridge * w
    if len(pairs.count):
        of = pairs.count / pairs.count.sum()
        d = pairs.change(w)
        loss += strength * float(of @ (d * d))
        g += np.bincount(pairs.place, weights=(2 * strength * of * d)[pairs.row] * pairs.sign, minlength=len(w))
    return loss, g, float(e.sum())


def fit(texts: Texts, pairs: Pairs, size: int, strength: float = 1.0, ridge: float = 3e-5, epochs: int = 40, batch: int = 512, rate: float = 0.1, seed: int = 7) -> tuple[float, np.ndarray]:
    """(intercept, weights) by mini-batches in a fixed order; the swaps all take part in every step."""
    p, m, q, step = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(texts.y))
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            _, g, gb = loss_gradient(p[:-1], p[-1], Texts([texts.places[j] for j in k], texts.y[k], texts.weight[k]), pairs, strength, ridge)
            g, step = np.append(g, gb), step + 1
            m += 0.1 * (g - m)
            q += 0.001 * (g * g - q)
            p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-9)
    return float(p[-1]), p[:-1]


def vocabulary(rows: DataFrame, n0: int, n1: int, most: int, least_df: int, least_z: float) -> list[int]:
    """The features whose presence differs most surely between the labels (z of the smoothed log odds ratio), sorted.

    rows: (y, f), f the feature numbers of a text as bytes. Tasks count first; the driver gets but what is chosen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy()
            ids = [np.frombuffer(x, dtype="<u4") for x in b.column(1).to_pylist()]
            for label in (0, 1):
                f, n = np.unique(np.concatenate([np.empty(0, "<u4"), *(x for x, v in zip(ids, y) if v == label)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(n * (label == 0), pa.int64()), pa.array(n * (label == 1), pa.int64())], ["f", "n0", "n1"])

    counted = rows.select("y", "f").mapInArrow(run, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    tilt = n0 / max(1, n1)
    a, c = F.col("n1") + 0.5, F.col("n0") + 0.5 * tilt
    b, d = F.lit(n1 + 1.0) - a, F.lit(n0 + tilt) - c
    z = F.abs(F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    kept = counted.filter((F.col("n0") + F.col("n1") >= least_df) & (b > 0) & (d > 0)).withColumn("z", z).filter(F.col("z") >= least_z)
    return sorted(r["f"] for r in kept.orderBy(F.desc("z"), "f").limit(most).select("f").collect())


def train(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = 8000, groups: list[list[str]] = IDENTITY_TERMS, most: int = 4000, least_df: int = 4, least_z: float = 3.0, strength: float = 1.0, **options) -> Model:
    """Fit on at most bound clean and bound / 2 toxic labelled documents, weighted back to their true shares.

    Of rows with equal ids one is learned from (labelled_sample). The driver gets the sampled documents' features as far as
    they are among the `most` chosen, and the different changes that swaps make, which are few however often they occur. With
    no labelled row the model says 0.5 throughout. All sums are in a fixed order, so a fit comes out alike every time.
    """
    sample, weights = labelled_sample(docs, labels, "toxic", keep, {0: bound, 1: bound // 2})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            f = [np.sort(np.fromiter(features(words_of(t)), dtype="<u4")).tobytes() for t in texts]
            found = [differences(t, groups) for t in texts]
            pack = lambda d: [np.array(x, dtype="<u4").tobytes() for x in d]
            swapped = [[{"gained": g, "lost": x, "n": n} for (g, x), n in zip(map(pack, d), d.values())] for d in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.binary()), pa.array(swapped, pa.list_(pa.struct([("gained", pa.binary()), ("lost", pa.binary()), ("n", pa.int64())])))], ["doc_id", "y", "f", "swaps"])

    rows = written(sample.select("doc_id", F.col("text").cast("string"), "y").mapInArrow(run, "doc_id long, y int, f binary, swaps array<struct<gained: binary, lost: binary, n: bigint>>"), "toxicity")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model(0.0, {})
    swapped = rows.select(F.explode("swaps").alias("s")).select("s.*").groupBy("gained", "lost").agg(F.sum("n").alias("n")).collect()
    changes = sorted((np.frombuffer(r["gained"], "<u4").tolist(), np.frombuffer(r["lost"], "<u4").tolist(), r["n"]) for r in swapped)
    moved = {x for gained, lost, _ in changes for x in (*gained, *lost)}
    chosen = np.array(sorted({*vocabulary(rows, n.get(0, 0), n.get(1, 0), most, least_df, least_z), *moved}), dtype=np.int64)
    place = {int(f): i for i, f in enumerate(chosen)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [np.flatnonzero(np.isin(chosen, np.frombuffer(x, "<u4"))).astype("<i4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.binary())], ["doc_id", "y", "p"])

    got = rows.select("doc_id", "y", "f").mapInArrow(known, "doc_id long, y int, p binary").toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(float)
    texts = Texts([np.frombuffer(x, "<i4").astype(np.int64) for x in got.column("p").to_pylist()], y, np.where(y > 0, weights[1], weights[0]))
    cells = [(i, place[f], s) for i, (gained, lost, _) in enumerate(changes) for fs, s in ((gained, 1.0), (lost, -1.0)) for f in fs]
    row, at, sign = (np.array(x) for x in zip(*cells)) if cells else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    pairs = Pairs(row, at, sign, np.array([c[2] for c in changes], dtype=float))
    plain, tied = (fit(texts, pairs, len(chosen), s, **options) for s in (0.0, strength))
    score = lambda z: 1 / (1 + np.exp(-z))
    change = [float(pairs.count @ np.abs(score(b + pairs.change(w)) - score(b)) / max(1.0, pairs.count.sum())) for b, w in (plain, tied)]
    return Model(tied[0], {int(f): float(v) for f, v in zip(chosen, tied[1]) if v}, int(pairs.count.sum()), *change)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability that the whole text is toxic. A null or empty text gets the score of no words.

    Repeated rows each count; other columns are not read.
    """
    intercept, weights = model.intercept, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                got = tuple(f for f in features_of(word) if f in weights)
                if len(word) <= KEPT_CHARS:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    self[word] = got
                return got

        known = Known()
        for b in batches:
            z = [intercept + math.fsum(map(weights.__getitem__, set().union(*map(known.__getitem__, words_of(t))))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op4_toxicity_counterfactual(spark, sf_dir, threshold: float = 0.7):
    """doc_id, held_out, score and predicted of every document; learned from ids whose crc32 mod 3 is not 1."""
    from trajlake.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_split(F.col("doc_id"), 3) != 1)
    return scored(docs, model).select("doc_id", (crc_split(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
