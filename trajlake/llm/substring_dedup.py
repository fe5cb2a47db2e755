"""Removal of repeated runs of words with suffix trees that are split by prefixes of variable length.

A suffix starts at each word and is cut at `length` words, as only nodes that deep tell repeats. Suffixes are dealt by
their prefixes: one word, or as many more as it takes until fewer than a share of 1 / GROUPS of all suffixes begin that way,
so that no frequent beginning gathers in one place. Inside a partition they are sorted (Spark's sort, which spills), and a task
reads the tree off the sorted suffixes as a stream: the suffixes below a node are neighbours, and a node as deep as `length` is a
run of equal ones. The least doc_id below such a node is the one that keeps its words. However many suffixes a node has, a
task holds a batch of them.

Only suffixes that can repeat are sent. Documents are kept in blocks, in a table bucketed by block, so that texts never cross
the network, and three exchanges of messages go between blocks and buckets of hashes:

1. digests of whole documents: of documents with equal words the one with the least id stays, the others go as a whole;
2. anchors: each window of `length` words has a run of GRAM words whose hash is least in it; equal windows have equal anchors,
   so a window repeats only if its anchor is in another block or document;
3. the suffixes of those windows, one of each block with the block's least id, and back the least id of all where it
   is a smaller one.

Hashes only choose what is sent and where to; what is removed has been compared byte by byte (documents as a whole by 128
bits of a cryptographic hash, suffixes of over LONG bytes by 256).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import from_planes, planes, small_batches, squeezed, table, unsqueezed, written
from trajlake.llm.suffix_dedup import NO_DOC, _block_table, _by_bucket, _give_back, _grouped, spans

GRAM = 6
GROUPS = 1 << 14  # a prefix with a greater share of all suffixes than 1 / GROUPS is made longer
LONG = 1024
SOME = 16384  # suffixes that are handled at once
BASE = 0x9E3779B97F4A7C15
UNDONE = pow(BASE, -1, 1 << 64)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """A block's documents as words `[^\\x20\\x09-\\x0D]+`, with one space behind each. All that it derives depends on the block alone."""

    def __init__(self, ids: list[int | None], lens: list[int], data: bytes):
        self.ids = ids
        self.id_of = np.array([NO_DOC if i is None else i for i in ids], dtype=np.int64)
        raw, ends = np.frombuffer(data, dtype=np.uint8), np.cumsum(np.array(lens, dtype=np.int64))
        inside = ~SPACE[raw]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        first = np.concatenate([[0], ends[:-1]])[np.array(lens) > 0] if len(lens) else np.empty(0, np.int64)
        head[first] = inside[first]
        letters, head_at = raw[inside], np.flatnonzero(head)
        word = np.cumsum(head[inside]) - 1  # of each letter
        self.buf = np.full(len(letters) + len(head_at), 0x20, dtype=np.uint8)
        self.buf[np.arange(len(letters)) + word] = letters
        size = np.bincount(word, minlength=len(head_at)).astype(np.int64)
        self.end = np.cumsum(size + 1) - 1  # without the space
        self.start = self.end - size
        self.doc = np.searchsorted(ends, head_at, side="right")
        self.n_words = np.bincount(self.doc, minlength=len(ids)).astype(np.int64)

    def hashes(self, first: np.ndarray, words: int) -> np.ndarray:
        """A 64-bit hash of the `words` words from each word of first."""
        if not hasattr(self, "sums"):
            power = _powers(BASE, len(self.buf))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power)])
            self.back = _powers(UNDONE, len(self.buf))
        a, b = self.start[first], self.end[first + words - 1]
        h = (self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64)
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def windows(self, length: int, keep: np.ndarray | None = None) -> np.ndarray:
        """The first words of all windows of `length` words inside one document (of those in keep)."""
        n = max(0, len(self.doc) - length + 1)
        ok = self.doc[:n] == self.doc[length - 1 :][:n]
        return np.flatnonzero(ok if keep is None else ok & keep[self.doc[:n]])

    def digests(self) -> list[bytes]:
        """128 bits that tell the words of each document."""
        cut = np.concatenate([[0], np.cumsum(self.n_words)])
        edge = np.append(self.start, len(self.buf))[cut]
        return [hashlib.blake2b(self.buf[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edge[:-1], edge[1:])]

    def anchors(self, first: np.ndarray, length: int) -> np.ndarray:
        """For each window the hash of its anchor, the run of GRAM words (or all) with the least hash in it."""
        gram = min(GRAM, length)
        if not len(first):
            return np.empty(0, np.uint64)
        least, span, w = self.hashes(np.arange(len(self.doc) - gram + 1), gram), 1, length - gram + 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        h = np.minimum(least[first], least[first + w - span])
        for _ in range(2):  # least hashes are small numbers; mixed again, one to one, they fall evenly into buckets
            h = h * np.uint64(BASE)
            h ^= h >> np.uint64(32)
        return h

    def distinct(self, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(one, back): a window of each class of equal ones, and the class of each window of first."""
        if not len(first):
            return first, np.empty(0, np.int64)
        h = self.hashes(first, length)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        for s in range(0, len(same), SOME):
            at = np.flatnonzero(same[s : s + SOME]) + s
            if len(at) and self.bytes_of(first[order[at]], length) != self.bytes_of(first[order[at + 1]], length):
                _, one, back = np.unique(np.array(self.bytes_of(first, length), dtype=object), return_index=True, return_inverse=True)
                return first[one], back
        back = np.empty(len(first), np.int64)
        back[order] = np.cumsum(np.concatenate([[True], ~same])) - 1
        return first[order[np.concatenate([[True], ~same])]], back

    def bytes_of(self, first: np.ndarray, length: int) -> list[bytes]:
        """The bytes of windows; of those over LONG bytes a space and a digest, which no window begins with."""
        whole = self.buf.tobytes() if not hasattr(self, "whole") else self.whole
        self.whole = whole
        a, b = self.start[first].tolist(), self.end[first + length - 1].tolist()
        return [whole[x:y] if y - x <= LONG else b" " + hashlib.sha256(whole[x:y]).digest() for x, y in zip(a, b)]

    def prefixes(self, first: np.ndarray, length: int, frequent: np.ndarray) -> np.ndarray:
        """The hash of each suffix's prefix: of the first words until these are not among the frequent hashes (sorted)."""
        out = np.zeros(len(first), np.uint64)
        open_ = np.arange(len(first))
        for words in range(1, length + 1):
            h = self.hashes(first[open_], words)
            out[open_] = h
            at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
            open_ = open_[frequent[at] == h] if len(frequent) else open_[:0]
            if not len(open_):
                break
        return out

    def frequent_prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, counts) of prefixes that at least half a share of 1 / GROUPS of the block's suffixes begin with."""
        first = self.windows(length)
        least = max(2, len(first) // (2 * GROUPS))
        hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for words in range(1, length):
            h, back, n = np.unique(self.hashes(first, words), return_inverse=True, return_counts=True)
            hashes.append(h[n >= least])
            counts.append(n[n >= least])
            first = first[(n >= least)[back]]
            if not len(first):
                break
        return np.concatenate(hashes), np.concatenate(counts).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Words]]:
    """Batches begin with block, ids, lens, data."""
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, Words(b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py())
            _give_back()


def _messages(block: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([d for _, d in parts], pa.binary())], ["bucket", "block", "data"])


MESSAGE = "bucket int, block long, data binary"


def _first_look(length: int, bits: int):
    """Messages of document digests and ids, and, in bucket -1, of frequent prefixes with their counts and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches):
            block = b.column(0)[i].as_py()
            hashes, counts = x.frequent_prefixes(length)
            yield _messages(block, [(-1, np.concatenate([[len(x.windows(length))], hashes.view(np.int64), counts]).astype("<i8").tobytes()), *_digest_parts(x, bits)])

    return run


def _digest_parts(x: Words, bits: int) -> list[tuple[int, bytes]]:
    """Documents with an id in the order of their digests: for each bucket 16 bytes and the id of each."""
    named = np.array([i is not None for i in x.ids], dtype=bool)
    d = np.array([np.frombuffer(h, "<u8") for h in x.digests()], dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((d[:, 1], d[:, 0]))
    order = order[named[order]]
    return [(k, d[order[a:e]].astype("<u8").tobytes() + x.id_of[order[a:e]].astype("<i8").tobytes()) for k, (a, e) in spans(d[order, 0], bits)]


def _answer_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each digest asked for the least id that has it."""
    for t in _grouped(batches):
        data = t.column("data").to_pylist()
        size = [len(x) // 24 for x in data]
        d = np.concatenate([np.frombuffer(x, "<u8", count=2 * n).reshape(-1, 2) for x, n in zip(data, size)])
        ids = np.concatenate([np.frombuffer(x, "<i8", offset=16 * n) for x, n in zip(data, size)])
        _, back = np.unique(d, axis=0, return_inverse=True)
        least = np.full(len(d), NO_DOC)
        np.minimum.at(least, back, ids)
        told = np.split(least[back], np.cumsum(size)[:-1])
        yield _messages_of(t, [x.astype("<i8").tobytes() for x in told])


def _messages_of(t: pa.Table, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t.column("bucket").to_pylist(), pa.int32()), pa.array(t.column("block").to_pylist(), pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "data"])


def _kept_documents(x: Words, told: dict[int, bytes], bits: int) -> np.ndarray:
    """Has the document an id that is the least of all documents with its words?"""
    named = np.array([i is not None for i in x.ids], dtype=bool)
    d = np.array([np.frombuffer(h, "<u8") for h in x.digests()], dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((d[:, 1], d[:, 0]))
    order = order[named[order]]
    out = np.zeros(len(x.ids), dtype=bool)
    for k, (a, e) in spans(d[order, 0], bits):
        out[order[a:e]] = np.frombuffer(told[k], "<i8") == x.id_of[order[a:e]]
    return out


def _ask_anchors(length: int, bits: int):
    """48 bits behind the bucket's of the distinct anchors of documents that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches):
            kept = _kept_documents(x, dict(b.column(4)[i].as_py() or ()), bits)
            h = np.unique(x.anchors(x.windows(length, kept), length))
            short = ((h << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield _messages(b.column(0)[i].as_py(), [(k, short[a:e].tobytes()) for k, (a, e) in spans(h, bits)])

    return run


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each anchor: does another block have it?"""
    for t in _grouped(batches):
        _give_back()
        data = t.column("data").to_pylist()
        size = [len(x) // 6 for x in data]
        flat = np.zeros((sum(size), 8), dtype=np.uint8)
        flat[:, :6] = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 6)
        _, back, n = np.unique(flat.view("<u8").ravel(), return_inverse=True, return_counts=True)
        yield _messages_of(t, [np.packbits(x).tobytes() for x in np.split(n[back] > 1, np.cumsum(size)[:-1])])


def _candidates(x: Words, told: dict[int, bytes], shared: dict[int, bytes], length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, first, one, back, least): documents that stay; their windows whose anchor another block or document has; one window
    of each class of equal ones with the least id that has it, and the class of each window."""
    kept = _kept_documents(x, told, bits)
    first = x.windows(length, kept)
    h, back = np.unique(x.anchors(first, length), return_inverse=True)
    yes = np.zeros(len(h), dtype=bool)
    for k, (a, e) in spans(h, bits):
        yes[a:e] = np.unpackbits(np.frombuffer(shared[k], dtype=np.uint8), count=e - a)
    ids = x.id_of[x.doc[first]]
    lo, hi = np.full(len(h), NO_DOC), np.full(len(h), np.iinfo(np.int64).min)
    np.minimum.at(lo, back, ids)
    np.maximum.at(hi, back, ids)
    pick = (yes | (lo != hi))[back]
    first, ids = first[pick], ids[pick]
    one, back = x.distinct(first, length)
    least = np.full(len(one), NO_DOC)
    np.minimum.at(least, back, ids)
    return kept, first, one, back, least


def _ask_suffixes(length: int, bits: int, tasks: int, frequent: np.ndarray):
    """The suffixes of candidate windows, with the task that their prefix goes to, the block's least id and their place in the block.

    A message holds those of one task in their order, so that neighbours are alike and compress.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches):
            block = b.column(0)[i].as_py()
            _, _, one, _, least = _candidates(x, dict(b.column(4)[i].as_py() or ()), dict(b.column(5)[i].as_py() or ()), length, bits)
            task = (x.prefixes(one, length, frequent) % np.uint64(tasks)).astype(np.int32)
            suffix = np.array([*x.bytes_of(one, length), None], dtype=object)[:-1]
            order = np.argsort(suffix)
            order = order[np.argsort(task[order], kind="stable")]
            cut = [0, *(np.flatnonzero(np.diff(task[order])) + 1), len(order)]
            parts = [order[p:q] for p, q in zip(cut, cut[1:]) if q > p]
            data = [_packed(suffix[p], least[p], p) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([task[p[0]] for p in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([len(p) for p in parts], pa.int32()), pa.array(data, pa.binary())], ["task", "block", "n", "data"])

    return run


def _packed(suffix: np.ndarray, least: np.ndarray, at: np.ndarray) -> bytes:
    size = np.fromiter(map(len, suffix), np.int64, len(suffix))
    return squeezed(planes(size, least, at) + b"".join(suffix))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of messages (block, n, data), a row each."""
    held, n = [], 0
    for b in batches:
        for block, k, data in zip(*(b.column(c).to_pylist() for c in range(3))):
            data = unsqueezed(data)
            size, least, at = from_planes(data[: 24 * k], k)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            suffix = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[24 * k :])])
            held.append(pa.RecordBatch.from_arrays([suffix, pa.array(least), pa.array(np.full(k, block)), pa.array(at.astype(np.int32))], ["suffix", "least", "block", "at"]))
            n += k
            if n > SOME:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes in order, and by least id among equal ones: what each block has to know of the nodes of full depth.

    A message holds places (i4) and least ids (i8) of suffixes whose node has a smaller id than their block.
    """
    last, low, held, n = None, 0, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        suffix, least = b.column(0), b.column(1).to_numpy()
        new = np.ones(len(least), dtype=bool)
        new[1:] = ~pc.equal(suffix.slice(1), suffix.slice(0, len(suffix) - 1)).to_numpy(zero_copy_only=False)
        new[0] = suffix[0].as_py() != last
        run = np.cumsum(new)
        of_run = np.concatenate([[low], least[new]])  # the first of a node has its least id
        node = of_run[run]
        last, low = suffix[-1].as_py(), int(node[-1])
        hit = np.flatnonzero(node < least)
        held.append((b.column(2).to_numpy()[hit], b.column(3).to_numpy()[hit], node[hit]))
        n += len(hit)
        if n > 1 << 19:
            yield _told(held)
            held, n = [], 0
    if n:
        yield _told(held)


def _told(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    block, at, node = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(block, kind="stable")
    cut = np.flatnonzero(np.diff(block[order])) + 1
    parts = np.split(order, cut)
    return pa.RecordBatch.from_arrays([pa.array([block[p[0]] for p in parts], pa.int64()), pa.array([at[p].astype("<i4").tobytes() + node[p].astype("<i8").tobytes() for p in parts], pa.binary())], ["block", "data"])


def _finish(length: int, bits: int, texts: bool, rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, x in _blocks(batches):
            kept, first, _, back, least = _candidates(x, dict(b.column(4)[i].as_py() or ()), dict(b.column(5)[i].as_py() or ()), length, bits)
            for m in b.column(6)[i].as_py() or ():
                n = len(m) // 12
                least[np.frombuffer(m, "<i4", count=n)] = np.frombuffer(m, "<i8", offset=4 * n)
            hit = first[least[back] < x.id_of[x.doc[first]]]
            change = np.zeros(len(x.doc) + 1, dtype=np.int32)
            change[hit] += 1
            change[hit + length] -= 1  # a window starts at a word once, so places don't repeat
            gone = np.cumsum(change[:-1]) > 0
            copy = ~kept & (x.id_of != NO_DOC) & (x.n_words >= length)
            gone |= copy[x.doc]
            yield _rows_of(x, gone, texts, b.column(7)[i].values if rest else None)

    return run


def _rows_of(x: Words, gone: np.ndarray, texts: bool, rest) -> pa.RecordBatch:
    left = x.buf[np.repeat(~gone, x.end - x.start + 1)].tobytes()
    cut = np.concatenate([[0], np.cumsum(x.n_words)])
    size = np.concatenate([[0], np.cumsum(np.where(gone, 0, x.end - x.start + 1))])[cut]
    removed = np.concatenate([[0], np.cumsum(gone)])[cut]
    begins = gone.copy()
    begins[1:] &= ~(gone[:-1] & (x.doc[1:] == x.doc[:-1]))
    spans_ = np.concatenate([[0], np.cumsum(begins)])[cut]
    kept = [left[a : max(a, e - 1)] for a, e in zip(size[:-1], size[1:])]
    cols = [pa.array(x.ids, pa.int64()), pa.array(x.n_words), pa.array(np.diff(removed).astype(np.int64)), pa.array(np.diff(spans_).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
    names = ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"]
    if texts:
        cols.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays([*cols, rest], [*names, "rest"]) if rest is not None else pa.RecordBatch.from_arrays(cols, names)


def _by_block(messages: DataFrame) -> DataFrame:
    return messages.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "data"))).alias("told"))


def substring_dedup(docs: DataFrame, length: int = 13, block_bytes: int = 2 << 20, rest: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_spans, kept_sha256; with texts, kept (string); then the columns of rest.

    Removed is each word that is covered by `length` consecutive words that also start in a document with a smaller doc_id;
    windows are judged on the input. n_spans: maximal removed runs. kept: the other words with one space between them, and
    kept_sha256 the hexadecimal SHA-256 of its UTF-8. A null text has no words. Rows with equal ids don't remove from each
    other; rows without an id neither remove nor lose. rest: columns to pass through, whatever their names are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(64, total // (8 << 20)))))
    buckets, tasks = 1 << bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, total // (8 << 20)))
    blocks = _block_table(docs, block_bytes, tasks, rest)
    body = ["block", "ids", "lens", "data"]

    looked = written(blocks.select(*body).mapInArrow(_first_look(length, bits), MESSAGE), "first-look")
    frequent = _frequent(looked)
    told = written(_by_block(_by_bucket(looked.filter("bucket >= 0"), buckets).mapInArrow(_answer_digests, MESSAGE)), "digests")
    known = blocks.join(told.hint("shuffle_hash"), "block", "left")

    asked = known.select(*body, "told").mapInArrow(_ask_anchors(length, bits), MESSAGE)
    shared = written(_by_block(_by_bucket(asked, buckets).mapInArrow(_answer_anchors, MESSAGE)).withColumnRenamed("told", "shared"), "anchors")
    known = known.join(shared.hint("shuffle_hash"), "block", "left")

    suffixes = known.select(*body, "told", "shared").mapInArrow(_ask_suffixes(length, bits, tasks, frequent), "task int, block long, n int, data binary")
    dealt = suffixes.repartitionById(tasks, "task") if hasattr(suffixes, "repartitionById") else suffixes.repartition(tasks, "task")
    tree = dealt.select("block", "n", "data").mapInArrow(_unpacked, "suffix binary, least long, block long, at int").sortWithinPartitions("suffix", "least")
    least = tree.mapInArrow(_deep_nodes, "block long, data binary").groupBy("block").agg(F.collect_list("data").alias("least"))
    final = known.join(least.hint("shuffle_hash"), "block", "left")

    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if texts else "") + (f", rest struct<{', '.join(f'`{c}`:{kinds[c]}' for c in rest)}>" if rest else "")
    out = final.select(*body, "told", "shared", "least", *(["rest"] if rest else [])).mapInArrow(_finish(length, bits, texts, bool(rest)), schema)
    return out.select(*[c for c in out.columns if c != "rest"], *[F.col("rest")[c].alias(c) for c in rest])


def _frequent(looked: DataFrame) -> np.ndarray:
    """Sorted hashes of the prefixes with a share of over 1 / GROUPS of all suffixes: fewer than 2 GROUPS for each number of words."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0).to_pylist():
                v = np.frombuffer(m, "<i8")
                n = (len(v) - 1) // 2
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0], v[1 : n + 1]])), pa.array(np.concatenate([v[:1], v[n + 1 :]])), pa.array(np.arange(n + 1) == 0)], ["h", "n", "all"])

    rows = looked.filter("bucket = -1").select("data").mapInArrow(counted, "h long, n long, all boolean").groupBy("h", "all").agg(F.sum("n").alias("n"))
    rows = written(rows, "prefixes")
    windows = rows.filter("all").agg(F.sum("n")).first()[0] or 0
    found = rows.filter(~F.col("all") & (F.col("n") * GROUPS > windows)).select("h").collect()
    return np.sort(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))


def op13_prefix_suffix_trees(spark, sf_dir):
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of every document, for runs of 13 words."""
    return substring_dedup(table(spark, sf_dir, "documents"))


#: Windows are told by their words joined by one space, as no word holds a space.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT k, doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT k, doc_id, i, word, CASE WHEN i + 12 <= n THEN string_agg(word, ' ') OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS t FROM p),
f AS (SELECT t, min(doc_id) AS least FROM s WHERE t IS NOT NULL GROUP BY t),
h AS (SELECT s.k, s.i, s.word, coalesce(f.least < s.doc_id, false) AS hit FROM s LEFT JOIN f USING (t)),
g AS (SELECT k, i, word, bool_or(hit) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
e AS (SELECT k, i, word, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), false) AS start FROM g),
a AS (SELECT k, count_if(gone)::BIGINT AS n_removed, count_if(start)::BIGINT AS n_spans, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM e GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN a USING (k)
"""
