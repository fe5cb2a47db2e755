"""Near-duplicates by covering hash tables over wide SimHash fingerprints, verified by exact Jaccard similarity.

A text's fingerprint has PIECES pieces of WIDTH bits, made of its word shingles. Each piece goes into the covering tables
of RADIUS, so that every pair that differs in at most RADIUS bits of some piece meets in a bucket; by the pigeonhole
principle these are all pairs with at most PIECES * (RADIUS + 1) - 1 differing bits, and most with more. What meets and
is near in 128 bits makes canopies. In a canopy every pair of texts that isn't joined yet is compared shingle by
shingle, so that no pair below the threshold is ever linked and none inside a canopy is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import scratch, spread_join, utf8, whole_keys, written
from trajlake.llm.components import connected_components
from trajlake.llm.simhash import _forest, covering_masks

PIECES, WIDTH, RADIUS = 16, 40, 3
WORDS = -(-PIECES * WIDTH // 64)
SEEDS = np.random.default_rng(42).integers(0, 2**64, WORDS, dtype=np.uint64)
MASKS = covering_masks(RADIUS, width=WIDTH)
TABLES = np.arange(1, PIECES * len(MASKS) + 1, dtype=np.uint64).reshape(PIECES, -1) * np.uint64(0x9E3779B97F4A7C15)
CANOPY = 34  # of 128 bits: a pair at 0.8 differs in 19 on average and in more than this once in 5,000
SHIFTS = 8  # runs up to this length are compared by shifts of the whole batch
PART_HASHES, PART_SETS = 1 << 15, 128  # of texts compared in one place
BITS, MOST_BITS, BITMAP = 1 << 25, 1 << 31, 4096  # least and greatest size of a bitmap (4 and 256 MB), bytes of one of Spark's bitmaps


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text; fewer words than one shingle count as one."""
    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8"))


def node_of(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def more_of(hashes: np.ndarray) -> int:
    """Another one: sets are known by both, 128 bits."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 11)).view(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """PIECES * WIDTH bits, packed: a bit is set where over half of the shingles' mixed hashes have it."""
    counts = np.zeros(WORDS * 64, dtype=np.int64)
    for i in range(0, len(hashes), 4080):
        bits = np.unpackbits(_mixed(hashes[i : i + 4080, None] ^ SEEDS).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):  # sums that fit a byte
            counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts[: PIECES * WIDTH] > len(hashes))


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, t, t2, base, more, n, w): t and t2 are hashes of the text, base and more of its whole set, so that copies share them; n
    its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more, n, w = [], [], [], []
            for t in b.column(3).to_pylist():
                s = shingles(t, shingle)
                base.append(node_of(s))
                more.append(more_of(s))
                n.append(len(s))
                w.append(wide_simhash(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(base, pa.int64()), pa.array(more, pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.binary())], ["doc_id", "t", "t2", "base", "more", "n", "w"])

    text = utf8(F.col("text"))
    return docs.select(F.col("doc_id").cast("long"), *text_hashes(F.col("text")), text.alias("b")).mapInArrow(run, "doc_id long, t long, t2 long, base long, more long, n long, w binary")


def text_hashes(text: F.Column) -> tuple[F.Column, F.Column]:
    """128 bits that a text is known by, t and t2; null is the empty text."""
    return F.xxhash64(utf8(text)).alias("t"), F.xxhash64(utf8(text), F.lit(1)).alias("t2")


def numbered(sets: DataFrame, clash: DataFrame | None) -> DataFrame:
    """sets with node, a number of each (base, more): base, or where different sets share it a hash of both."""
    if clash is None:
        return sets.withColumn("node", F.col("base"))
    return sets.join(clash.withColumn("_clash", F.lit(True)), "base", "left").withColumn("node", F.when(F.col("_clash"), F.xxhash64("base", "more")).otherwise(F.col("base"))).drop("_clash")


def first_word(w) -> F.Column:
    """The first 64 bits of a fingerprint as a long."""
    return F.conv(F.hex(F.substring(w, 1, 8)), 16, -10).cast("long")


def spread(a: np.ndarray, b: np.ndarray, most: int = CANOPY) -> tuple[list, list]:
    """Links of a spanning forest of "at most `most` of 128 bits differ" over one bucket, by growing one tree after another.

    A node that a tree has reached is compared with none that the tree already holds, so that a large group of near copies takes
    time in proportion to its size.
    """
    left, us, vs = np.arange(len(a)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(a[left] ^ a[i]) + np.bitwise_count(b[left] ^ b[i]) <= most
            got = left[near]
            us.append(np.full(len(got), a[i]))
            vs.append(a[got])
            todo.extend(got)
            left = left[~near]
    return us, vs


def canopy_links(nodes: DataFrame, most: int = CANOPY) -> DataFrame:
    """Links (u, v) between the first words of fingerprints w that share a bucket and are near in their first 128 bits.

    They join what all such pairs would, not every pair. Buckets are runs of one key in a sorted partition, read as a stream.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                w = np.frombuffer(b"".join(b.column(0)[i : i + 4096].to_pylist()), dtype=np.uint8).reshape(-1, PIECES * WIDTH // 8)
                piece = np.zeros((len(w), PIECES, 8), dtype=np.uint8)
                piece[:, :, : WIDTH // 8] = w.reshape(len(w), PIECES, WIDTH // 8)
                piece = piece.view("<u8")  # (n, PIECES, 1)
                keys = _mixed((piece & MASKS) ^ TABLES).reshape(len(w), -1)
                ends = w[:, :16].copy().view(">i8").astype(np.int64)
                times = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ends[:, 0], times)), pa.array(np.repeat(ends[:, 1], times))], ["key", "a", "b"])

    def linked(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        us, vs = [a[:0]], [a[:0]]
        for s in range(1, SHIFTS):
            i = np.flatnonzero(key[s:] == key[:-s])
            if not len(i):
                break
            i = i[np.bitwise_count(a[i] ^ a[i + s]) + np.bitwise_count(b[i] ^ b[i + s]) <= most]
            us.append(a[i])
            vs.append(a[i + s])
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        for s, n in zip(starts[sizes > SHIFTS], sizes[sizes > SHIFTS]):
            more = spread(a[s : s + n], b[s : s + n], most)
            us += more[0]
            vs += more[1]
        u, v = np.concatenate(us), np.concatenate(vs)
        ends = np.unique(np.concatenate([u, v]))
        u, v = _forest(np.searchsorted(ends, u), np.searchsorted(ends, v), ends)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_keys(batches, [np.int64, np.uint64, np.uint64]):
            yield linked(*cols)

    rows = nodes.select("w").mapInArrow(keyed, "key long, a long, b long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def bits_of(hashes: DataFrame, name: str):
    """A broadcast bitmap in which the column's hashes have set their bits: a hash without its bit isn't among them.

    It has some sixteen bits for each hash, BITS at least and MOST_BITS at most; beyond that more hashes pass by chance.
    """
    size = min(MOST_BITS, max(BITS, 1 << (16 * hashes.count()).bit_length()))
    at = F.pmod(F.col(name), F.lit(size).cast("long")) + 1
    bits = hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    whole = bytearray(size // 8)
    for k, m in bits.toLocalIterator():
        whole[(k - 1) * BITMAP : (k - 1) * BITMAP + len(m)] = m
    return hashes.sparkSession.sparkContext.broadcast(bytes(whole))


def in_bits(bits, hashes: pa.Array) -> np.ndarray:
    there = np.frombuffer(bits.value, dtype=np.uint8)
    i = hashes.to_numpy() % (8 * len(there))
    return (there[i >> 3] >> (i & 7) & 1).astype(bool)


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = 5) -> DataFrame:
    """(node, hashes) of the wanted (node, base, more, t), one row per node, made again from the texts.

    A bitmap tells which texts are surely not wanted, so that they are neither split nor shuffled; what it lets through
    by chance falls out in the join.
    """
    sent = bits_of(wanted, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column(1).filter(pa.array(in_bits(sent, b.column(0))))
            seen: dict[bytes, None] = dict.fromkeys(some.to_pylist())  # of copies in a batch one
            sets = [shingles(t, shingle) for t in seen]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(node_of, sets)), pa.int64()), pa.array(list(map(more_of, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["base", "more", "hashes"])

    text = utf8(F.col("text"))
    found = docs.select(F.xxhash64(text).alias("t"), text.alias("b")).mapInArrow(run, "base long, more long, hashes binary")
    return found.groupBy("base", "more").agg(F.first("hashes").alias("hashes")).join(wanted.select("base", "more", "node"), ["base", "more"]).select("node", "hashes")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two different ones of the sorted sets share; the diagonal says nothing."""
    m = len(sets)
    ids, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = times > 1
    keep = shared[at]
    row, col = row[keep], (np.cumsum(shared) - 1)[at[keep]]
    out = np.zeros((m, m), dtype=np.int64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(64, (1 << 21) // max(1, m))
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [a, a + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def similar_links(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of different roots whose Jaccard similarity is at least percent / 100, in whole numbers."""
    if len(sets) < 2:
        return nodes[:0], nodes[:0]
    both, size = common_counts(sets), np.array([len(s) for s in sets], dtype=np.int64)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    a, b = np.nonzero(np.triu(near, 1) & (roots[:, None] != roots[None, :]))
    order = np.argsort(nodes)
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    return _forest(place[a], place[b], nodes[order])


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of rows (place, node, r, hashes): in each place all pairs of different r are compared."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, first = np.unique(t.column(1).to_numpy(), return_index=True)
        sets = [np.frombuffer(t.column(3)[int(i)].as_py(), dtype="<u8") for i in first]
        u, v = similar_links(node, t.column(2).to_numpy()[first], sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for a, e in zip(cut, cut[1:]):
                if e > a:
                    if held and now != keys[a]:
                        yield links(held)
                        held = []
                    now = keys[a]
                    held.append(b.slice(a, e - a))
        if held:
            yield links(held)

    dealt = rows.select("place", "node", "r", "hashes").repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _parts() -> F.Column:
    return F.greatest(F.ceil(F.sum("n") / PART_HASHES), F.ceil(F.count("*") / PART_SETS)).cast("int")


def _place(*of) -> F.Column:
    return F.xxhash64(*of)


def _part(parts: str) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(3)), F.col(parts)).cast("int")


def _centres(large: DataFrame) -> DataFrame:
    """(root, centre): of each canopy the node that is nearest to the majority of the fingerprints' bits."""
    ones = [F.sum(F.shiftrightunsigned("a", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    sums = large.groupBy("root").agg(F.count("*").alias("k"), *ones)
    word = F.lit(0).cast("long")
    for i in range(64):
        word = word.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("k"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    near = spread_join(large.select("root", "node", "a"), sums.select("root", word.alias("m")), "root")
    return near.groupBy("root").agg(F.min_by("node", F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("m"))), F.col("node"))).alias("centre"))


def _links_in(members: DataFrame, used: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join what all similar pairs inside the canopies would join, from (root, node, n, a, parts).

    A small canopy is compared in one place. A large one is dealt to parts, each compared in itself and with the
    canopy's centre; what this leaves unjoined is then compared with all else, part by part.
    """
    rows = members.join(used, "node")
    large = members.filter("parts > 1")
    at = rows.select(_place("root", _part("parts")).alias("place"), "node", F.col("node").alias("r"), "hashes")
    if large.isEmpty():
        return written(compared(at, percent), "links")
    centres = written(_centres(large), "centres")
    sent = centres.join(large.select("root", "parts").distinct(), "root").select(F.col("centre").alias("node"), "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    sent = sent.join(used, "node").select(_place("root", "p").alias("place"), "node", F.col("node").alias("r"), "hashes")
    first = written(compared(at.union(sent), percent), "links")
    star = written(connected_components(first), "star").withColumnRenamed("root", "r")
    now = written(large.select("root", "node", "n").join(star, "node", "left").withColumn("r", F.coalesce("r", "node")), "now")
    sizes = now.groupBy("root", "r").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    most = sizes.groupBy("root").agg(F.max_by("r", F.struct("n", "r")).alias("main"), F.count("*").alias("classes")).filter("classes > 1").select("root", "main")
    now = spread_join(now, most, "root").withColumn("apart", F.col("r") != F.col("main"))
    parts = now.groupBy("root", "apart").agg(_parts().alias("parts"))
    parts = parts.groupBy("root").agg(F.max(F.when(F.col("apart"), F.col("parts"))).alias("lp"), F.max(F.when(~F.col("apart"), F.col("parts"))).alias("mp"))
    now = written(spread_join(now, parts, "root"), "apart")
    to = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("j")
    left = now.filter("apart")
    c, j = _part("lp"), F.col("j")
    among = left.select("root", "node", "r", c.alias("c"), to("lp")).select(_place(F.col("root"), F.lit(1), F.least("c", j), F.greatest("c", j)).alias("place"), "node", "r")
    against = left.select("root", "node", "r", c.alias("c"), to("mp")).select(_place(F.col("root"), F.lit(2), F.col("c"), j).alias("place"), "node", "r")
    main = now.filter("not apart").select("root", "node", "r", _part("mp").alias("c"), to("lp")).select(_place(F.col("root"), F.lit(2), j, F.col("c")).alias("place"), "node", "r")
    again = among.union(against).union(main).join(used, "node")
    return written(first.union(compared(again, percent)), "links")


def near_texts(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, component_id (the least doc_id that links of similar enough texts reach), t and t2 (hashes of
    the text) and klass (a number of the class).

    Copies share one node before any bucket is made. Null and empty texts are one node. Repeated rows each count. A null
    doc_id gets the least other id of its class, or null. An empty table gives an empty result; other columns aren't read.
    """
    sets = written(shingle_sets(docs, shingle), "sets")
    nodes = sets.groupBy("base", "more").agg(F.first("n").alias("n"), F.first("w").alias("w"), F.min("t").alias("t"), F.min("doc_id").alias("rep"))
    nodes = written(nodes.withColumn("a", first_word(F.col("w"))), "nodes")
    clash = nodes.groupBy("base").agg(F.count("*").alias("k")).filter("k > 1").select("base")
    clash = None if clash.isEmpty() else written(clash, "clash")
    nodes, sets = numbered(nodes, clash), numbered(sets, clash)
    canopy = written(connected_components(written(canopy_links(nodes), "canopies")), "canopy").withColumnsRenamed({"node": "a"})
    near = nodes.select("node", "base", "more", "n", "t", "a").join(canopy, "a", "left").withColumn("root", F.coalesce("root", "a"))
    sizes = near.groupBy("root").agg(F.count("*").alias("k"), _parts().alias("parts")).filter("k > 1").select("root", "parts")
    members = written(spread_join(written(near, "near"), sizes, "root"), "members")
    used = written(sets_of(docs, members.select("node", "base", "more", "t"), shingle), "used")
    star = written(connected_components(_links_in(members.drop("base", "more"), used, percent)), "star")
    rep = nodes.select("node", "rep")
    linked = written(rep.join(star, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    known = spread_join(linked, least, "root").select("node", "least", F.col("root").alias("klass"))
    known = rep.join(known, "node", "left").select("node", F.when(F.col("klass").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component_id"), F.coalesce("klass", "node").alias("klass"))
    return spread_join(sets.select("doc_id", "node", "t", "t2"), written(known, "known"), "node").select("doc_id", "component_id", "t", "t2", "klass")


def one_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of docs with one of each class of near_texts: the least doc_id, an id before none, then the least text hashes.

    Of repeated rows (equal ids and texts) one stays, whatever their other columns are. Rows are known by id and 128 bits of
    the text, so that rows without an id are judged too. Columns of any name and type pass.
    """
    with scratch(docs.sparkSession) as kept:
        found = written(near_texts(docs, percent, shingle), "found")
        kept.append(found)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "t2")
    best = found.groupBy("klass").agg(F.min(order).alias("best"))
    judged = spread_join(found, written(best, "best"), "klass")
    here = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("t") == F.col("best.t")) & (F.col("t2") == F.col("best.t2"))
    # names of their own, longer than any of the table's
    d, t, t2, one = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("d", "t", "t2", "one"))
    named = {"doc_id": d, "t": t, "t2": t2}
    lost = written(judged.filter(~here).select(*named).distinct().withColumnsRenamed(named), "lost")
    again = judged.filter(here).groupBy(*named).agg(F.count("*").alias("k")).filter("k > 1").select(*named).withColumnsRenamed(named)
    again = written(again, "again")
    mine = text_hashes(F.col("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (mine[0] == F.col(t)) & (mine[1] == F.col(t2))
    sent, schema = bits_of(lost, t), docs.schema

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                here = in_bits(sent, b.column(b.num_columns - 1))
                yield b.select(list(range(b.num_columns - 1))).filter(pa.array(here == inside))

        return docs.select("*", mine[0].alias(t)).mapInArrow(run, schema)

    # texts whose bit isn't set are surely kept; only the others meet the list, so that few texts are shuffled
    kept = part(False).unionByName(part(True).join(lost.hint("merge"), same, "left_anti"))
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = kept.join(again, same, "left_semi").groupBy(F.col("doc_id").cast("long").alias(d), mine[0].alias(t), mine[1].alias(t2))
    single = repeated.agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(one)).select(f"{one}.*")
    return kept.join(again, same, "left_anti").unionByName(single)
