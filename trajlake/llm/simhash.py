"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit i of the fingerprint gets a vector m(i) in {0,1}^(r+1). For each of the 2^(r+1)-1 nonzero vectors v, table
v hashes a fingerprint by the bits with <m(i), v> odd. If two fingerprints differ in at most r bits, the vectors of
those bits span at most r of r+1 dimensions, so some v is orthogonal to all of them: in table v the pair collides.
No pair inside the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import spread_join, utf8, whole_keys, written
from trajlake.llm.components import connected_components

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PAIRWISE = 512


def simhash64(text: bytes, shingle: int = 4) -> int:
    """Fingerprint of a UTF-8 text: bit set where over half of the shingle hashes have it; no words give 0."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=n)
    by = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) > 600:
        counts = np.concatenate([np.bincount(by[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    else:
        counts = np.unpackbits(by, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per document, fp the 64-bit SimHash of the whole text as a signed long.

    A null text counts as empty; repeated rows are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash64(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("t")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, turn: int = 0, width: int = 64) -> np.ndarray:
    """2^(radius+1)-1 masks of width bits; turn deals the vectors m(i) to the bits in another order."""
    size = 2 ** (radius + 1)
    order = np.random.default_rng(turn).permutation(width) if turn else np.arange(width)
    m = 1 + order % (size - 1)
    odd = [[bin(int(x) & v).count("1") & 1 for x in m] for v in range(1, size)]
    return np.array([sum(1 << i for i, o in enumerate(row) if o) for row in odd], dtype=np.uint64)


def _forest(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that join what the pairs (a, b) of indexes into nodes join: (node, least node of its class)."""
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def link_bucket(fps: np.ndarray, radius: int, turn: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same classes as all pairs of distinct fps within the radius.

    Up to PAIRWISE values are compared directly. A larger bucket is covered again by masks dealt in another order, which
    is as lossless as the first cover and fixes about half of the remaining bits at each turn, so that after a few
    turns a bucket can hold but a few hundred different values.
    """
    fps = np.unique(fps)
    if len(fps) <= PAIRWISE:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        a, b = np.nonzero(np.triu(near, 1))
        return _forest(a, b, fps)
    us, vs = [], []
    for mask in covering_masks(radius, turn):
        key = fps & mask
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cut):
            if len(part) > 1:
                u, v = link_bucket(fps[part], radius, turn + 1)
                us.append(u)
                vs.append(v)
    u, v = np.concatenate(us or [fps[:0]]), np.concatenate(vs or [fps[:0]])
    return _forest(np.searchsorted(fps, u), np.searchsorted(fps, v), fps)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints that give the classes of "within radius bits", not all pairs.

    Each fingerprint goes to one bucket per mask. A bucket is the run of rows with one key in a sorted partition and is
    read as a stream; its links are reduced to a spanning forest before they leave the task. Different fingerprints of a
    bucket agree in the bits of its mask, so its size is bounded by the free bits and not by copies of documents,
    which share one row.
    """
    masks = [int(np.int64(np.uint64(m))) for m in covering_masks(radius).view(np.int64)]
    keyed = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            us, vs = [], []
            two = starts[sizes == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            us.append(fp[two][near])
            vs.append(fp[two + 1][near])
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                u, v = link_bucket(fp[s : s + n], radius)
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            nodes = np.unique(np.concatenate([u, v]))
            u, v = _forest(np.searchsorted(nodes, u), np.searchsorted(nodes, v), nodes)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for cols in whole_keys(batches, [np.int64, np.uint64]):
            yield linked(*cols)

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the least doc_id that links of at most radius bits reach.

    Copies share one fingerprint row before any bucket is made. Empty and null texts have fingerprint zero and link like
    any other. A null doc_id gets the least other id of its class, or null if there is none.
    """
    by_doc = written(fingerprints(docs, shingle), "fp")
    distinct = by_doc.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    star = written(connected_components(links(distinct.select("fp"), radius)), "star").withColumnRenamed("node", "fp")
    linked = written(distinct.join(star, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    known = spread_join(linked, least, "root").select("fp", "least").withColumn("joined", F.lit(True))
    known = distinct.join(known, "fp", "left").select("fp", F.when(F.col("joined"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    return spread_join(by_doc, written(known, "known"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash_covering_lsh(spark, sf_dir):
    """doc_id, fingerprint and component_id of every document, for four-word shingles and a radius of 4 bits.

    A null text has fingerprint zero, as any text without words; repeated rows each have a row; a row without an id is in
    its class but names none.
    """
    from trajlake.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
