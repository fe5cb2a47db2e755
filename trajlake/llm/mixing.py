"""Soft-membership mixing: document rates whose expected domain token totals match targets.

A classifier learned from the labels table gives each document a posterior over domains. With n_d tokens, posterior
p_d and rate x_d, the expected total of domain c is sum_d n_d p_dc x_d. Projected gradient descent fits the rates by
least squares inside the box from zero to a bound. Documents step by -p_d.g and are cut at the box, in the metric in which a token weighs the same in every
document; g needs but the totals, so that an iteration is one distributed sum of as many numbers as there are domains.
The state of a document is a function of its posterior and the few vectors g so far and is computed anew, not stored.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.llm.common import utf8, written
from trajlake.llm.labelled import labelled_sample
from trajlake.llm.quality_fm import BLANKS, DIGITS, HIGH, MARKS, SYMBOLS, UPPER

WORD_SLOTS, STEM_SLOTS = 1 << 20, 1 << 18
TO_BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
DOMAINS = ("low", "clean", "toxic")
TARGETS = {"low": 0.03, "clean": 0.96, "toxic": 0.01}
BOUND = 4.0  # no document is repeated more often


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): place in DOMAINS; low quality comes before toxicity; a null label is no label."""
    domain = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when((F.col("quality") == 1) & (F.col("toxic") == 1), 2)
    return labels.select("doc_id", domain.alias("domain"))


def tokens_of(text: bytes) -> np.ndarray:
    """Hashed ids of the distinct words of a whole text and of their first four letters."""
    words = set(text.lower().translate(TO_BLANK).split())
    stems = {w[:4] for w in words if len(w) > 4}
    ids = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint32, count=len(words)) % WORD_SLOTS
    more = np.fromiter((zlib.crc32(w) for w in stems), dtype=np.uint32, count=len(stems)) % STEM_SLOTS
    return np.unique(np.concatenate([ids, more + WORD_SLOTS])).astype(np.uint32)


def structure_of(text: bytes) -> np.ndarray:
    """Shares of character kinds and of repeated words and lines in a whole text."""
    size = max(1, len(text))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    return np.array([
        share(UPPER), 4 * share(DIGITS), 4 * share(MARKS), 4 * share(SYMBOLS), share(BLANKS), share(HIGH), 8 * share(b"|"), 8 * share(b"!"),
        min(1.0, size / max(1, len(words)) / 20), len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words)) / 10,
    ], dtype=np.float32)


class Classifier(NamedTuple):
    """Multinomial logistic model: a row of weights for each known token id (sorted), for each share, and intercepts."""

    ids: np.ndarray
    weights: np.ndarray
    shares: np.ndarray
    intercept: np.ndarray

    def posterior(self, text: bytes) -> np.ndarray:
        t = tokens_of(text)
        at = np.searchsorted(self.ids, t)
        at = at[(at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == t)] if len(self.ids) else at[:0]
        z = self.intercept + self.weights[at].sum(0) + structure_of(text) @ self.shares
        z = np.exp(z - z.max())
        return z / z.sum()


def classifier_gradients(params: list[np.ndarray], at: list[np.ndarray], stats: np.ndarray, hot: np.ndarray, sw: np.ndarray, ridge: float) -> tuple[float, list[np.ndarray]]:
    """(loss, gradients by the token, share and intercept weights): weighed mean log loss + ridge / 2 of the squared first two."""
    row, cols = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at)
    classes = hot.shape[1]
    z = params[2] + stats @ params[1]
    for c in range(classes):
        z[:, c] += np.bincount(row, weights=params[0][cols, c], minlength=len(at))
    z -= z.max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    e = (np.exp(log_p) - hot) * sw / len(at)
    g0 = np.stack([np.bincount(cols, weights=e[row, c], minlength=len(params[0])) for c in range(classes)], axis=1)
    loss = -float((hot * log_p * sw).sum()) / len(at) + ridge / 2 * float((params[0] ** 2).sum() + (params[1] ** 2).sum())
    return loss, [g0 + ridge * params[0], stats.T @ e + ridge * params[1], e.sum(0)]


def fit_classifier(tokens: list[np.ndarray], stats: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, classes: int, epochs: int = 20, batch: int = 256, rate: float = 0.03, ridge: float = 3e-5, least_df: int = 4, seed: int = 7) -> Classifier:
    """Multinomial logistic regression by mini-batches in a fixed order, for texts' token ids, shares and class places."""
    ids, df = np.unique(np.concatenate(tokens), return_counts=True)
    ids = ids[df >= least_df]
    at = [np.searchsorted(ids, t) for t in tokens]
    at = [a[k] for a, k in zip(at, ((a < len(ids)) & (ids[np.minimum(a, len(ids) - 1)] == t) if len(ids) else np.zeros(len(t), bool) for a, t in zip(at, tokens)))]
    params = [np.zeros((len(ids), classes), np.float32), np.zeros((stats.shape[1], classes), np.float32), np.zeros(classes, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    hot, sw = np.eye(classes, dtype=np.float32)[y], (sample_weight / sample_weight.mean()).astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            k = order[i : i + batch]
            step += 1
            for p, g, m, q in zip(params, classifier_gradients(params, [at[j] for j in k], stats[k], hot[k], sw[k], ridge)[1], first, second):
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-7)
    return Classifier(ids, *params)


def train(docs: DataFrame, labels: DataFrame, bound: int = 2000) -> Classifier:
    """Fit on at most 2 * bound clean documents and bound of each other domain; with no labelled row all domains are as likely.

    The driver gets the sampled documents' token ids; of rows with equal ids one is learned from (labelled_sample).
    """
    sample, weights = labelled_sample(docs, domain_labels(labels), "domain", F.lit(True), {0: bound, 1: 2 * bound, 2: bound})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens_of(t).tobytes() for t in texts], pa.binary()), pa.array([structure_of(t).tobytes() for t in texts], pa.binary()), b.column(2)], ["doc_id", "x", "s", "y"])

    got = sample.select("doc_id", utf8(F.col("text")).alias("t"), "y").mapInArrow(run, "doc_id long, x binary, s binary, y int").toArrow().sort_by("doc_id")
    width = len(structure_of(b""))
    if not got.num_rows:
        return Classifier(np.empty(0, np.uint32), np.empty((0, len(DOMAINS)), np.float32), np.zeros((width, len(DOMAINS)), np.float32), np.zeros(len(DOMAINS), np.float32))
    tokens = [np.frombuffer(x, dtype=np.uint32) for x in got.column("x").to_pylist()]
    stats = np.stack([np.frombuffer(x, dtype=np.float32) for x in got.column("s").to_pylist()])
    y = got.column("y").to_numpy()
    return fit_classifier(tokens, stats, y, np.array([weights[k] for k in y]), len(DOMAINS))


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with n_tokens (words of the whole text) and p (array of the domains' posteriors)."""
    names, parts = docs.columns, tuple(model)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Classifier(*parts)
        for r in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in r.column(at).to_pylist()]
            p = np.array([m.posterior(t) for t in texts], dtype=np.float64).reshape(-1, len(DOMAINS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(DOMAINS), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array([len(t.split()) for t in texts], pa.int64()), lists], [*names, "n_tokens", "p"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]))


def rates_of(p: np.ndarray, steps: list[list[float]], bound: float = np.inf) -> np.ndarray:
    x = np.ones(len(p))
    for g in steps:
        x = np.clip(x - p @ np.array(g), 0.0, bound)
    return x


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Fit(NamedTuple):
    """Steps that give the rates, the domains' expected totals with them, what was wanted, and whether these agree."""

    steps: list[list[float]]
    reached: np.ndarray
    wanted: np.ndarray
    converged: bool


def _totals(slim: DataFrame, steps: list[list[float]], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected totals of the domains after the steps, and the second moment of the posteriors of rates inside the box."""
    width = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = np.zeros(width), np.zeros((width, width))
        for b in batches:
            p, n = _lists(b.column(1), width), b.column(0).to_numpy()
            x = rates_of(p, steps, bound)
            s += (n * x) @ p
            free = (x > 0) & (x < bound)
            m += (p[free] * n[free, None]).T @ p[free]
        yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (*s, *m.ravel())], names)

    names = [f"s{i}" for i in range(width + width * width)]
    row = slim.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()
    got = np.array([v or 0.0 for v in row])
    return got[:width], got[width:].reshape(width, width)


def fit_rates(table: DataFrame, targets: dict[str, float], total: float = 1.0, bound: float = BOUND, rounds: int = 25, tolerance: float = 1e-4, relative: bool = False) -> Fit:
    """Rates in [0, bound] for a table with n_tokens and p; total is the wanted size as a share of all tokens.

    targets are shares of the wanted size or, if relative, factors on what each domain has, which are then scaled to that size.
    The sum of squared residuals, in tokens, is minimised. A step is the projected gradient with the length that is best while
    no further rate meets a bound; as long as it halves the residual, the gradient is scaled by the inverse of the
    posteriors' second moment inside the box. Targets beyond what rates in the box give end at the least-squares fit and
    converged is false. One step is one distributed sum of a dozen numbers. An empty table has no steps.
    """
    width = len(DOMAINS)
    slim = table.select("n_tokens", "p")
    start, moment = _totals(slim, [], bound)
    n = start.sum()
    if not n:
        return Fit([], np.zeros(width), np.zeros(width), True)
    wanted = np.array([targets.get(d, 1.0 if relative else 0.0) for d in DOMAINS])
    if relative:
        wanted = wanted * start / (wanted * start).sum()
    wanted = wanted * n * total
    cost = lambda gap: float(gap @ gap)
    steps, reached, free, newton = [], start, moment, True
    for _ in range(rounds):
        gap = reached - wanted
        if np.abs(gap).max() <= tolerance * wanted.sum():
            break
        if not free.any():
            free = moment
        moved = free @ gap
        slope = gap * (gap @ moved) / max(1e-300, moved @ moved)
        g = np.linalg.pinv(free, rcond=1e-9) @ gap if newton else slope
        while True:
            now, inside = _totals(slim, [*steps, g.tolist()], bound)
            if cost(now - wanted) < cost(gap) or np.abs(g).max() < 1e-9:
                break
            g, newton = (slope, False) if newton else (g / 2, False)
        if cost(now - wanted) >= cost(gap) * (1 - 1e-9):
            break
        newton = newton and cost(now - wanted) < cost(gap) / 4
        steps, reached, free = [*steps, g.tolist()], now, inside
    return Fit(steps, reached, wanted, bool(np.abs(reached - wanted).max() <= tolerance * wanted.sum()))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float = 1.0, bound: float = BOUND, relative: bool = False, gap: float = 0.01) -> DataFrame:
    """docs with n_tokens, p_<domain>, rate (0 to bound) and copies.

    targets, total, relative: as of fit_rates. Where expected totals miss the targets by more than gap of the wanted size, a
    warning tells by how much. copies is the rate rounded up or down by a hash of doc_id, with the fraction as the chance. A
    null or empty text has no tokens and weighs nothing, but gets a rate; rows with equal ids round alike; an empty
    table gives an empty result. Columns of docs with the names of the new ones are replaced.
    """
    new = ["n_tokens", "p", "rate", "copies", *(f"p_{d}" for d in DOMAINS)]
    docs = docs.drop(*new)
    table = written(with_posteriors(docs, train(docs, labels)), "posteriors")
    fit = fit_rates(table, targets or TARGETS, total, bound, relative=relative)
    missed = np.abs(fit.reached - fit.wanted).max() / max(1.0, fit.wanted.sum())
    if missed > gap:
        warnings.warn(f"rates up to {bound} miss the targets by {missed:.1%}: reached {dict(zip(DOMAINS, fit.reached.round().tolist()))}, wanted {dict(zip(DOMAINS, fit.wanted.round().tolist()))}")
    x = F.lit(1.0)
    if fit.steps:
        g = F.array(*[F.array(*[F.lit(v) for v in s]) for s in fit.steps])
        x = F.aggregate(g, x, lambda x, s: F.least(F.lit(float(bound)), F.greatest(F.lit(0.0), x - F.aggregate(F.zip_with(F.col("p"), s, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = table.withColumn("rate", x)
    out = out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    return out.withColumns({f"p_{d}": F.col("p")[i] for i, d in enumerate(DOMAINS)}).drop("p")


def op6_mixing_soft_membership(spark, sf_dir):
    """doc_id, n_tokens, the posteriors, rate and copies of every document, fitted to TARGETS."""
    from trajlake.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixed(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies")
