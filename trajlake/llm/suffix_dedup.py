"""Removal of long repeated byte strings with run-length compressed indexes.

Every 50-byte window holds the 24-byte string whose hash is least in it, its anchor; equal windows have equal anchors at
equal places. So windows can only be equal inside the neighbourhoods (contexts, 76 bytes) of equal anchors, and the
corpus falls into small repetitive collections by anchor. Documents are kept in blocks, in a table bucketed by block, so
that texts never cross the network; what crosses it is

1. the distinct anchor hashes of a block, and back a bit for each: has another block this anchor?
2. the distinct contexts of shared anchors with the least doc_id of the block that holds them, and back for each the least
   doc_id of all and a mask of the windows that occur in other contexts with a smaller one.

An anchor that occurs very often could gather any number of different contexts in one place. The first answer also tells
these hot anchors. Their windows are asked for one by one, dealt by the windows' own hashes, so that what meets
in a place is equal windows, one of each block; they are compared byte by byte, and a minimum answers them.

For step 2 a bucket of the other anchors builds run-length Burrows-Wheeler indexes with sampled run ends of contexts that share an
anchor and are not equal, and streams the matching statistics of those with greater labels through them. Of copies a block sends one, so a passage or a text that a third of all documents
hold costs a row for each block and not for each document.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import small_batches, utf8, work_path
from trajlake.llm.run_index import END, RunLengthIndex

GRAM = 24
SLAB = 1 << 15
INDEX_BYTES = 3 << 17
NO_DOC = np.iinfo(np.int64).max
MOST_TASKS = 100_000
HOT = 4096  # occurrences from which an anchor is hot
TAG = 4  # bytes, of base 240
OUTSIDE = (0xFE, 0xFD)
WINDOWS = 1 << 24  # what tells answers about windows from those about contexts


def anchors(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of `length` bytes that lie inside one document.

    buf holds documents one behind the other, ends their ends.
    """
    n, w = len(buf), length - GRAM + 1
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    if n < length:
        return places[0], hashes[0]
    raw = buf.tobytes()
    begins = np.maximum(np.concatenate([[0], ends[:-1]]), ends - length + 1)  # windows from here to the end cross it
    for a in range(0, n - length + 1, SLAB):
        b = min(a + SLAB, n - length + 1)
        m = b - a + w - 1
        h = np.zeros(m, np.uint64)
        for j in range(0, GRAM, 8):
            h ^= np.ndarray((m,), dtype="<u8", buffer=raw, offset=a + j, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 23) - 1)
        least, span = (h & ~low) | np.arange(m, dtype=np.uint64), 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: b - a], least[w - span : w - span + b - a])
        first, last = np.searchsorted(ends, [a, b + length], side="left")
        crossing = np.zeros(b - a + 1, np.int32)
        lo, hi = np.clip(begins[first : last + 1] - a, 0, b - a), np.clip(ends[first : last + 1] - a, 0, b - a)
        np.add.at(crossing, lo, 1)
        np.add.at(crossing, hi, -1)
        p = (least & low).astype(np.int64)[np.cumsum(crossing[:-1]) == 0]
        if len(p):
            p = p[np.concatenate([[True], p[1:] != p[:-1]])]
            places.append(p + a)
            hashes.append(h[p])
    p, h = np.concatenate(places), np.concatenate(hashes)
    for _ in range(2):  # least hashes are small numbers; mixed again, one to one, they fall evenly into buckets
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    keep = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.empty(0, bool)
    return p[keep], h[keep]


def contexts(buf: np.ndarray, ends: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The bytes around anchors, as far as a window with the anchor reaches; END stands for what is outside the document."""
    left, width = length - GRAM, 2 * length - GRAM
    padded = np.concatenate([np.full(width, END, np.uint8), buf, np.full(width, END, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[place - left + width]
    starts = np.concatenate([[0], ends[:-1]])
    cut = np.flatnonzero((place - left < starts[doc]) | (place + length > ends[doc]))
    at = place[cut, None] - left + np.arange(width)
    out[cut] = np.where((at < starts[doc[cut], None]) | (at >= ends[doc[cut], None]), END, out[cut])
    return out


def row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a byte matrix whose width is a multiple of four."""
    words = np.ascontiguousarray(rows).view("<u4")
    h = np.zeros(len(rows), np.uint64)
    for j in range(words.shape[1]):
        h ^= words[:, j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, back) as of numpy's unique: a row of each class of equal rows, and the class of every row.

    Rows are sorted by hash and neighbours compared byte by byte; if different rows share a hash, by their bytes.
    """
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = row_hash(rows)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    a, b = order[1:][same], order[:-1][same]
    if any((rows[a[i : i + 65536]] != rows[b[i : i + 65536]]).any() for i in range(0, len(a), 65536)):
        _, first, back = np.unique(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return first, back
    new = np.concatenate([[True], ~same])
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


class Block:
    """A block's documents in the order of their ids, and its anchors. Documents without an id take no part.

    All that it derives depends on the block alone, so that it comes out alike whenever the block is read.
    """

    def __init__(self, ids: list[int | None], lens: list[int], data: bytes, length: int):
        self.ids, self.length = ids, length
        self.buf, self.ends = np.frombuffer(data, dtype=np.uint8), np.cumsum(np.array(lens, dtype=np.int64))
        self.id_of = np.array([NO_DOC if i is None else i for i in ids], dtype=np.int64)
        p, h = anchors(self.buf, self.ends, length)
        d = np.searchsorted(self.ends, p, side="right")
        named = np.array([i is not None for i in ids], dtype=bool)[d] if len(d) else np.empty(0, bool)
        self.place, self.hash, self.doc = p[named], h[named], d[named]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors' hashes, sorted, each once, and how often they occur (65535: at least)."""
        x = np.sort(self.hash)
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
        return x[first], np.minimum(np.diff(np.append(first, len(x))), 65535).astype("<u2")

    def narrow(self, shared: dict[int, bytes], bits: int) -> None:
        """Keep the anchors that another document of the block has or that were answered to be in another block.

        Afterwards they are sorted by hash.
        """
        order = np.argsort(self.hash)
        h, ids = self.hash[order], self.id_of[self.doc[order]]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        first = np.flatnonzero(new)
        keep = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.empty(0, bool)
        hot = np.zeros(len(first), dtype=bool)
        for bucket, (a, b) in spans(h[first], bits):
            told = np.frombuffer(shared[bucket], dtype=np.uint8)
            keep[a:b] |= np.unpackbits(told[: len(told) // 2], count=b - a).astype(bool)
            hot[a:b] = np.unpackbits(told[len(told) // 2 :], count=b - a).astype(bool)
        size = np.diff(np.append(first, len(h)))
        chosen = np.repeat(keep, size)
        order, self.hot = order[chosen], np.repeat(hot, size)[chosen]
        self.place, self.hash, self.doc = self.place[order], self.hash[order], self.doc[order]

    def gather(self) -> None:
        """The distinct contexts in the order of their hashes, with the least id of each."""
        c = contexts(self.buf, self.ends, self.doc, self.place, self.length)
        first, back = equal_rows(c)
        rank = np.empty(len(first), np.int64)
        by_hash = np.argsort(first, kind="stable")
        rank[by_hash] = np.arange(len(first))
        self.back, first = rank[back], first[by_hash]
        self.rows, self.row_hash, self.row_hot = c[first], self.hash[first], self.hot[first]
        self.row_least = np.full(len(first), NO_DOC)
        np.minimum.at(self.row_least, self.back, self.id_of[self.doc])

    def hot_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, hashes, least, at): the distinct windows of hot contexts in the order of their hashes, bytes padded to a multiple
        of four, the least id of each, and the place in keys of each window of each hot context, -1 where it leaves the document."""
        rows, least = self.rows[self.row_hot], self.row_least[self.row_hot]
        windows = self.rows.shape[1] - self.length + 1
        at = np.full((len(rows), windows), -1, dtype=np.int64)
        padded = -(-self.length // 4) * 4
        parts, where = [np.empty((0, padded), np.uint8)], [np.empty((2, 0), np.int64)]
        for s in range(windows):
            w = rows[:, s : s + self.length]
            ok = np.flatnonzero((w[:, 0] != END) & (w[:, -1] != END))
            part = np.zeros((len(ok), padded), np.uint8)
            part[:, : self.length] = w[ok]
            parts.append(part)
            where.append(np.stack([ok, np.full(len(ok), s)]))
        keys, where = np.concatenate(parts), np.concatenate(where, axis=1)
        first, back = equal_rows(keys)
        hashes = row_hash(keys[first])
        by_hash = np.argsort(hashes, kind="stable")
        rank = np.empty(len(first), np.int64)
        rank[by_hash] = np.arange(len(first))
        at[where[0], where[1]] = rank[back]
        low = np.full(len(first), NO_DOC)
        np.minimum.at(low, rank[back], least[where[0]])
        return keys[first[by_hash]], hashes[by_hash], low, at


def spans(sorted_hashes: np.ndarray, bits: int) -> list[tuple[int, tuple[int, int]]]:
    """(bucket, (from, to)) of the buckets that sorted hashes fall into by their first bits."""
    if not len(sorted_hashes):
        return []
    bucket = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    return [(int(bucket[a]), (int(a), int(b))) for a, b in zip(cut, cut[1:])]


def compare(rows: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (equal ones may repeat) the least label of equal ones, and the mask of windows that occur in another
    context with a smaller label.

    Contexts of one anchor are put in the order of their labels and halved again and again: at each level the second halves
    are streamed through an index of the first ones. In place of the anchor, which every window holds, stands a number of
    the halved group, so that nothing matches but what belongs together. Contexts with an anchor of their own, or all
    equal for an anchor, need no index.
    """
    left, windows = length - GRAM, length - GRAM + 1
    first, back = equal_rows(rows)
    label = np.full(len(first), NO_DOC)
    np.minimum.at(label, back, least)
    mask = np.zeros(len(first), dtype=np.uint32)
    _, group = equal_rows(np.ascontiguousarray(rows[first][:, left : left + GRAM]))
    order = np.lexsort((label, group))
    g, x = group[order], label[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
    place = np.cumsum(new | np.concatenate([[True], x[1:] != x[:-1]])) if len(g) else np.empty(0, np.int64)  # of the label among all
    rank = np.empty(len(first), np.int64)
    rank[order] = place - place[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))] if len(g) else place
    deepest = int(rank.max(initial=0)).bit_length()
    for level in range(deepest - 1, -1, -1):
        half = rank >> level
        key = group * (1 + (int(rank.max()) >> level)) + (half >> 1)
        second = (half & 1).astype(bool)
        _, tag = np.unique(key, return_inverse=True)
        split = np.zeros(tag.max() + 1, bool)
        split[tag[second]] = True  # the first halves always have something
        asked = np.flatnonzero(second & (mask != np.uint32((1 << windows) - 1)))
        held = np.flatnonzero(~second & split[tag])
        held = held[np.argsort(tag[held], kind="stable")]
        asked = asked[np.argsort(tag[asked], kind="stable")]
        per = max(1, INDEX_BYTES // rows.shape[1])
        cut = [0, *(np.flatnonzero(np.diff(tag[held])) + 1), len(held)]
        a = 0
        while a < len(held):
            at = int(np.searchsorted(cut, a + per, side="right")) - 1
            b = cut[at] if cut[at] > a else cut[at + 1]  # all of a group are in one index
            lo, hi = np.searchsorted(tag[asked], [tag[held[a]], tag[held[b - 1]] + 1])
            if hi > lo:
                some = asked[lo:hi]
                index = RunLengthIndex(_tagged(rows[first[held[a:b]]], tag[held[a:b]], length, 0))
                found = index.matching_statistics(_tagged(rows[first[some]], tag[some], length, 1), left + TAG, pivot=left + TAG - 1)
                mask[some] |= (found[:, :windows] >= left + TAG) @ (np.uint32(1) << np.arange(windows, dtype=np.uint32))
            a = b
    return label[back], mask[back]


def _tagged(rows: np.ndarray, tag: np.ndarray, length: int, side: int) -> np.ndarray:
    """Contexts with the number tag in TAG bytes in place of their anchor, and with bytes that match nothing of the other side where
    they leave their documents. None of these bytes is one of UTF-8 or END, but for those of numbers, which stand alone."""
    left = length - GRAM
    before, behind = rows[:, :left].copy(), rows[:, left + GRAM :].copy()
    before[before == END], behind[behind == END] = OUTSIDE[side], OUTSIDE[side]
    digits = np.stack([tag // 240**i % 240 for i in range(TAG)], axis=1).astype(np.uint8)
    return np.concatenate([before, digits, behind], axis=1)


def suffix_dedup(docs: DataFrame, length: int = 50, block_bytes: int = 4 << 20, rest: tuple[str, ...] = (), texts: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts, kept (string), n_kept; then rest.

    Removed is each byte that is covered by a string of `length` bytes that also starts in a document with a smaller
    doc_id; strings are judged on the input. kept_sha256 is over the remaining bytes; kept leaves whole characters
    only: where a span begins or ends inside one, that character stays. A null text is empty. Rows with equal ids don't
    remove from each other; rows without an id neither remove nor lose. rest: columns to pass through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(64, total // (4 << 20)))))
    buckets = 1 << bits
    # at least as many table buckets as shuffle partitions: with fewer, the planner would rather deal the texts anew
    table = _block_table(docs, block_bytes, min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 << 20))), rest)

    ask = table.select("block", "ids", "lens", "data").mapInArrow(_ask_anchors(length, bits), "bucket int, block long, n int, data binary, often binary")
    shared = _by_bucket(ask, buckets).mapInArrow(_answer_anchors(hot), "block long, bucket int, data binary")
    shared = shared.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "data"))).alias("shared"))
    known = table.join(shared.hint("shuffle_hash"), "block", "left")
    asked = known.select("block", "ids", "lens", "data", "shared").mapInArrow(_ask_contexts(length, bits), "bucket int, block long, kind int, n int, least binary, data binary")
    told = _by_bucket(asked, buckets).mapInArrow(_answer_contexts(length), "block long, bucket int, data binary")
    told = told.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "data"))).alias("told"))
    final = known.join(told.hint("shuffle_hash"), "block", "left")
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string, n_kept long" if texts else "") + (f", rest struct<{', '.join(f'`{c}`:{kinds[c]}' for c in rest)}>" if rest else "")
    out = final.select("block", "ids", "lens", "data", "shared", "told", *(["rest"] if rest else [])).mapInArrow(_finish(length, bits, texts, bool(rest)), schema)
    return out.select(*[c for c in out.columns if c != "rest"], *[F.col("rest")[c].alias(c) for c in rest])


def _by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together, in the order of buckets; a task takes one bucket after another if there are over MOST_TASKS."""
    n = min(buckets, MOST_TASKS)
    task = F.expr(f"cast(bucket as long) * {n} div {buckets}").cast("int")
    dealt = df.repartitionById(n, task) if hasattr(df, "repartitionById") else df.repartition(n, task)
    return dealt.sortWithinPartitions("bucket")


def _block_table(docs: DataFrame, block_bytes: int, buckets: int, rest: tuple[str, ...]) -> DataFrame:
    """Documents in blocks, one row each, in a table in the shared folder that is bucketed by block."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = np.cumsum(np.array([len(x.as_py()) for x in b.column(1)], dtype=np.int64))
            cut, held = [0], 0
            for i, s in enumerate(sizes):
                if s - held > block_bytes and i > cut[-1]:
                    cut.append(i)
                    held = sizes[i - 1]
            for a, e in zip(cut, [*cut[1:], b.num_rows]):
                if e > a:
                    part = b.slice(a, e - a)
                    ids = part.column(0).to_pylist()
                    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
                    part = part.take(pa.array(order))
                    texts = part.column(1).to_pylist()
                    cols = [pa.array([(task << 32) | made]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary())]
                    names = ["block", "ids", "lens", "data"]
                    if rest:
                        inner = pa.StructArray.from_arrays([part.column(2 + k) for k in range(len(rest))], names=list(rest))
                        cols.append(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner))
                        names.append("rest")
                    made += 1
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = "block long, ids array<long>, lens array<int>, data binary" + (f", rest array<struct<{', '.join(f'`{c}`:{kinds[c]}' for c in rest)}>>" if rest else "")
    blocks = docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("t"), *rest).mapInArrow(run, schema)
    path = work_path(docs.sparkSession, "blocks")
    name = f"trajlake_{path.rsplit('-', 1)[1]}"
    blocks.write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    table = docs.sparkSession.table(name)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the files stay, and the frame knows of their buckets
    return table


def _give_back() -> None:
    """Return freed memory to the system: a worker process lives on, and its heap would keep its largest size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, Block(b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py(), length)
            _give_back()


def _sparse(counts: np.ndarray) -> bytes:
    """Places (u32) of the counts over one, and by how much (u16) they are over it."""
    at = np.flatnonzero(counts > 1)
    return at.astype("<u4").tobytes() + (counts[at] - 1).astype("<u2").tobytes()


def _ask_anchors(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches, length):
            distinct, often = x.distinct()
            parts = spans(distinct, bits)
            short = ((distinct << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits behind the bucket's
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([b.column(0)[i].as_py()] * len(parts), pa.int64()), pa.array([e - a for _, (a, e) in parts], pa.int32()), pa.array([short[a:e].tobytes() for _, (a, e) in parts], pa.binary()), pa.array([_sparse(often[a:e]) for _, (a, e) in parts], pa.binary())], ["bucket", "block", "n", "data", "often"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one bucket each, from batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for a, e in zip(cut, cut[1:]):
            if e > a:
                if held and held[0].column(0)[0].as_py() != keys[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(a, e - a))
    if held:
        yield pa.Table.from_batches(held)


def _answer_anchors(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            _give_back()
            sizes, data = t.column("n").to_numpy(), t.column("data").to_pylist()
            flat = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
            flat[:, :6] = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 6)
            _, back, count = np.unique(flat.view("<u8").ravel(), return_inverse=True, return_counts=True)
            cut = np.cumsum(sizes)[:-1]
            total = count.astype(np.int64)
            for at, more in zip([0, *cut], t.column("often").to_pylist()):
                k = len(more) // 6
                np.add.at(total, back[at + np.frombuffer(more, dtype="<u4", count=k)], np.frombuffer(more, dtype="<u2", offset=4 * k))
            yes, hot = count[back] > 1, total[back] > most
            out = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(yes, cut), np.split(hot, cut))]
            yield pa.RecordBatch.from_arrays([pa.array(t.column("block").to_pylist(), pa.int64()), pa.array(t.column("bucket").to_pylist(), pa.int32()), pa.array(out, pa.binary())], ["block", "bucket", "data"])

    return run


def _ask_contexts(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches, length):
            x.narrow(dict(b.column(4)[i].as_py() or ()), bits)
            x.gather()
            cool = ~x.row_hot
            rows, least = x.rows[cool], x.row_least[cool]
            keys, hashes, key_least, _ = x.hot_windows()
            asked = [(k, 0, e - a, least[a:e], rows[a:e]) for k, (a, e) in spans(x.row_hash[cool], bits)] + [(k, 1, e - a, key_least[a:e], keys[a:e]) for k, (a, e) in spans(hashes, bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q[0] for q in asked], pa.int32()), pa.array([b.column(0)[i].as_py()] * len(asked), pa.int64()), pa.array([q[1] for q in asked], pa.int32()), pa.array([q[2] for q in asked], pa.int32()),
                 pa.array([q[3].astype("<i8").tobytes() for q in asked], pa.binary()), pa.array([q[4].tobytes() for q in asked], pa.binary())],
                ["bucket", "block", "kind", "n", "least", "data"])

    return run


def _answer_contexts(length: int):
    width, key = 2 * length - GRAM, -(-length // 4) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            _give_back()
            for kind, asked in ((0, t.filter(pc.equal(t.column("kind"), 0))), (1, t.filter(pc.equal(t.column("kind"), 1)))):
                if not asked.num_rows:
                    continue
                cut = np.cumsum(asked.column("n").to_numpy())[:-1]
                data, least = b"".join(asked.column("data").to_pylist()), np.frombuffer(b"".join(asked.column("least").to_pylist()), dtype="<i8")
                if kind:
                    low = _least_of_keys(np.frombuffer(data, dtype=np.uint8).reshape(-1, key), least)
                    out = [a.astype("<i8").tobytes() for a in np.split(low, cut)]
                else:
                    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
                    low, mask = compare(rows, least, length)
                    out = [a.astype("<i8").tobytes() + m.astype("<u4").tobytes() for a, m in zip(np.split(low, cut), np.split(mask, cut))]
                yield pa.RecordBatch.from_arrays([pa.array(asked.column("block").to_pylist(), pa.int64()), pa.array([k | (WINDOWS * kind) for k in asked.column("bucket").to_pylist()], pa.int32()), pa.array(out, pa.binary())], ["block", "bucket", "data"])

    return run


def _least_of_keys(keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each key the least label of its equals."""
    first, back = equal_rows(keys)
    low = np.full(len(first), NO_DOC)
    np.minimum.at(low, back, least)
    return low[back]


def _finish(length: int, bits: int, texts: bool, rest: bool):
    left, windows = length - GRAM, length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches, length):
            x.narrow(dict(b.column(4)[i].as_py() or ()), bits)
            x.gather()
            told = dict(b.column(5)[i].as_py() or ())
            low, mask = np.full(len(x.rows), NO_DOC), np.zeros(len(x.rows), np.uint32)
            cool = np.flatnonzero(~x.row_hot)
            for bucket, (a, e) in spans(x.row_hash[cool], bits):
                n = e - a
                low[cool[a:e]] = np.frombuffer(told[bucket], dtype="<i8", count=n)
                mask[cool[a:e]] = np.frombuffer(told[bucket], dtype="<u4", offset=8 * n, count=n)
            keys, hashes, _, at_key = x.hot_windows()
            key_low = np.full(len(keys) + 1, NO_DOC)  # the last stands for no window
            for bucket, (a, e) in spans(hashes, bits):
                key_low[a:e] = np.frombuffer(told[bucket | WINDOWS], dtype="<i8", count=e - a)
            hot_row = np.cumsum(x.row_hot) - 1
            hot = np.flatnonzero(x.row_hot[x.back])  # occurrences of hot contexts
            starts = np.concatenate([[0], x.ends[:-1]])
            earlier = low[x.back] < x.id_of[x.doc]
            found = np.zeros(len(x.buf), dtype=bool)
            for s in range(windows):
                at = x.place - left + s
                hit = earlier | ((mask >> np.uint32(s)) & np.uint32(1)).astype(bool)[x.back]
                hit[hot] = key_low[at_key[hot_row[x.back[hot]], s]] < x.id_of[x.doc[hot]]
                found[at[(at >= starts[x.doc]) & (at + length <= x.ends[x.doc]) & hit]] = True
            at = np.flatnonzero(found)
            change = np.zeros(len(x.buf) + 1, dtype=np.int8)
            if len(at):
                apart = at[1:] > at[:-1] + length
                change[at[np.concatenate([[True], apart])]] = 1
                change[at[np.concatenate([apart, [True]])] + length] -= 1
            cover = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
            yield _rows_of(x, cover, starts, texts, b.column(6)[i].values if rest else None)

    return run


def _rows_of(x: Block, cover: np.ndarray, starts: np.ndarray, texts: bool, rest) -> pa.RecordBatch:
    ids, out = x.ids, []
    for d, (a, e) in enumerate(zip(starts, x.ends)):
        c, t = cover[a:e], x.buf[a:e]
        n = int(c.sum())
        row = [ids[d], int(e - a), n, int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if n else 0, hashlib.sha256((t[~c] if n else t).tobytes()).hexdigest()]
        if texts:
            if n:  # a character goes if all of its bytes do
                head = (t & 0xC0) != 0x80
                whole = np.logical_and.reduceat(c, np.flatnonzero(head)) if head.any() else np.empty(0, bool)
                t = t[~whole[np.cumsum(head) - 1]]
            kept = t.tobytes().decode("utf-8", "replace")
            row += [kept, len(kept)]
        out.append(row)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string(), pa.int64()] if texts else [])]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "n_kept"] if texts else [])]
    cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
    return pa.RecordBatch.from_arrays([*cols, rest], [*names, "rest"]) if rest is not None else pa.RecordBatch.from_arrays(cols, names)


def op7_suffix_run_length(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, for strings of 50 bytes."""
    from trajlake.llm.common import table

    return suffix_dedup(table(spark, sf_dir, "documents"))


#: Bytes as pairs of hexadecimal digits; windows are cut from pieces of 500 bytes, as long texts are slow to be cut from.
OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
c AS (SELECT k, doc_id, length(b) // 2 AS n, unnest(range(0, length(b) // 2, 500)) AS o, substr(b, 2 * unnest(range(0, length(b) // 2, 500)) + 1, 1098) AS t FROM d),
p AS (SELECT k, doc_id, o + unnest(range(1, least(500, n - o) + 1)) AS i, substr(t, 2 * unnest(range(1, least(500, n - o) + 1)) - 1, 100) AS w FROM c),
f AS (SELECT w, min(doc_id) AS least FROM p WHERE length(w) = 100 GROUP BY w),
h AS (SELECT p.k, p.i, left(p.w, 2) AS x, coalesce(least < p.doc_id, false) AS hit FROM p LEFT JOIN f USING (w)),
g AS (SELECT k, i, x, bool_or(hit) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
s AS (SELECT k, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), false) AS start FROM g),
a AS (SELECT k, count_if(gone)::BIGINT AS n_removed, count_if(start)::BIGINT AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256 FROM s GROUP BY k)
SELECT doc_id, (length(b) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256(''::BLOB)) AS kept_sha256 FROM d LEFT JOIN a USING (k)
"""
