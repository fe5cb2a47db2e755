"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + <w, x> + sum over factors f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2): all pairwise
interactions, in time linear in the features present.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import crc_split, utf8
from trajlake.llm.labelled import labelled_sample

BUCKETS = 2048
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS, SYMBOLS = b".,;:!?'\"()-", b"#*$%&|<>@^~=+{}[]\\/_"
BLANKS, HIGH = b" \t\n\r\x0b\x0c", bytes(range(128, 256))
N_STATS = 18


def features(text: bytes, n_chars: int | None) -> np.ndarray:
    """Dense vector of a whole text: word buckets (log counts, length one), then structure statistics and metadata."""
    x = np.zeros(BUCKETS + N_STATS, dtype=np.float32)
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    if n:
        at = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=n) % BUCKETS
        c = np.log1p(np.bincount(at, minlength=BUCKETS))
        x[:BUCKETS] = c / np.linalg.norm(c)
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [y for y in text.split(b"\n") if y.strip()]
    common = Counter(words).most_common(1)[0][1] if n else 0
    ends = text.lower().translate(None, b".,")
    x[BUCKETS:] = (
        share(UPPER), share(DIGITS) * 4, share(MARKS) * 4, share(SYMBOLS) * 4, share(BLANKS), share(HIGH), share(b"|") * 8,
        share(b"!") * 8, share(b"\n") * 8, math.log1p(n) / 10, math.log1p(len(text)) / 12, min(1.0, size / max(1, n) / 20),
        len(set(words)) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), common / max(1, n), (size - len(ends)) / size * 4,
        math.log1p(max(0, n_chars or 0)) / 12, 1.0 if n_chars is None else 0.0,
    )
    return x


class FactorisationMachine:
    def __init__(self, d: int, factors: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w = np.zeros(1, np.float32), np.zeros(d, np.float32)
        self.v = rng.normal(0, 0.05, (d, factors)).astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.b + x @ self.w + 0.5 * ((s * s) - (x * x) @ (self.v * self.v)).sum(1)

    def gradients(self, x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, decay: float) -> list[np.ndarray]:
        """Gradients by b, w and v of the weighed mean log loss + decay / 2 (|w|^2 + |v|^2)."""
        e = ((1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30))) - y) * sample_weight / len(y)).astype(x.dtype)
        s = x @ self.v
        return [e.sum(keepdims=True), x.T @ e + decay * self.w, x.T @ (e[:, None] * s) - ((x * x).T @ e)[:, None] * self.v + decay * self.v]

    def fit(self, x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> "FactorisationMachine":
        rng = np.random.default_rng(seed)
        params = [self.b, self.w, self.v]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                k = order[i : i + batch]
                t += 1
                for p, g, m, q in zip(params, self.gradients(x[k], y[k], sample_weight[k], decay), first, second):
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -30, 30)))


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    meta = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("t"), meta.alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = 6000) -> FactorisationMachine:
    """Fit on at most bound labelled documents of each quality. With no labelled row the machine gives 0.5 throughout.

    Ids are learned from as labelled_sample says: one row of each, none that is null or labelled both ways. Features of the sample are made on the executors; bound * (BUCKETS + N_STATS) half floats per label at most
    reach the driver.
    """
    columns = ("text", "n_chars") if "n_chars" in docs.columns else ("text",)
    sample, weights = labelled_sample(docs, labels, "quality", keep, {0: bound // 2, 1: bound}, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [zlib.compress(features(t, n).astype(np.float16).tobytes(), 1) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(3)], ["doc_id", "x", "y"])

    rows = _inputs(sample, F.col("y")).mapInArrow(run, "doc_id long, x binary, y int").toArrow().sort_by("doc_id")
    fm = FactorisationMachine(BUCKETS + N_STATS)
    if rows.num_rows:
        x = np.empty((rows.num_rows, BUCKETS + N_STATS), dtype=np.float32)
        for i, z in enumerate(rows.column("x").to_pylist()):
            x[i] = np.frombuffer(zlib.decompress(z), dtype=np.float16)
        y = rows.column("y").to_numpy().astype(np.float32)
        sw = np.where(y > 0, weights[1], weights[0])
        return fm.fit(x, y, (sw / sw.mean()).astype(np.float32))
    fm.v[:] = 0
    return fm


def scored(docs: DataFrame, fm: FactorisationMachine) -> DataFrame:
    """(doc_id, score): the machine's probability of good quality for every whole text.

    Null and empty texts are scored on what is left, their structure; repeated rows each count; a null n_chars is a feature of
    its own; other columns are not read.
    """
    parts = fm.b, fm.w, fm.v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine(1)
        m.b, m.w, m.v = parts
        for b in batches:
            texts, meta, out = b.column(1).to_pylist(), b.column(2).to_pylist(), []
            for i in range(0, len(texts), 512):
                out.append(m.score(np.stack([features(t, n) for t, n in zip(texts[i : i + 512], meta[i : i + 512])])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out or [np.empty(0)]))], ["doc_id", "score"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double")


def op3_quality_factorisation_machine(spark, sf_dir, threshold: float = 0.3):
    """doc_id, held_out, score and predicted of every document; learned from ids whose crc32 mod 5 is not 0."""
    from trajlake.llm.common import table

    docs = table(spark, sf_dir, "documents")
    fm = train(docs, table(spark, sf_dir, "labels"), crc_split(F.col("doc_id"), 5) != 0)
    return scored(docs, fm).select("doc_id", (crc_split(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
