"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may have k = rate * m edits. It is split into k + 1 pieces: if it occurs in a text with at
most k edits, one piece occurs unchanged. One automaton finds all piece hits of a text; each hit gives a window, which
has to share enough trigrams with the item (each edit spoils three at most) and is then verified with Myers'
bit-parallel distance. Texts and items are compared as lower-case words with one space between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import written

WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def normalise(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end): least edit distance of the pattern to a substring of text, and the first end that has it.

    anchored: the substring starts where the text starts.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """All items of a block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 0):
        self.items = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for row, (item_id, text) in enumerate(dict.fromkeys((i, normalise(x)) for i, x in items)):
            if text and len(text) >= min_chars:
                k = int(rate * len(text))
                self.items[row] = (item_id, text, k, [text[i : i + 3] for i in range(len(text) - 2)])
                for at, piece in pieces(text, k):
                    places.setdefault(piece, []).append((row, at))
        self.found = ahocorasick.Automaton()
        for piece, where in places.items():
            self.found.add_word(piece, (len(piece), where))
        if places:
            self.found.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item within its budget in the normalised text.

        Of an item_id with several texts the best match of them all.
        """
        t = normalise(text)
        starts: dict[int, set[int]] = {}
        if not t or not self.items:
            return []
        for last, (n, where) in self.found.iter(t):
            for row, at in where:
                starts.setdefault(row, set()).add(last + 1 - n - at)
        out: dict[int, tuple[int, int, int, int]] = {}
        for row, at in starts.items():
            item_id, item, k, grams = self.items[row]
            best, todo = None, sorted(at)
            while todo:
                low = todo[0]
                same = next((i for i, s in enumerate(todo) if s > low + 2 * k), len(todo))
                a, b = max(0, low - k), min(len(t), todo[same - 1] + len(item) + k)
                todo = todo[same:]
                window = t[a:b]
                there = {window[i : i + 3] for i in range(len(window) - 2)}
                if sum(map(there.__contains__, grams)) < len(grams) - 3 * k:
                    continue
                d, end = myers(item, window)
                if not k and not (t[low - 1 : low] in ("", " ") and t[low + len(item) : low + len(item) + 1] in ("", " ")):
                    continue
                if d <= k and (best is None or d < best[0]):
                    best = (d, a, end)
            if best and (item_id not in out or best[0] < out[item_id][1]):
                d, a, end = best
                _, back = myers(item[::-1], t[a : a + end][::-1], anchored=True)
                out[item_id] = (item_id, d, a + end - back, a + end)
        return list(out.values())


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_bytes, one at a time; at least one block."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    for i in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        yield [(r[0], r[1]) for r in block.orderBy("item_id", "text").toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 8, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best place of each item in each document that holds it.

    Offsets are characters of the normalised document. Items of under min_chars characters, normalised, tell nothing and
    are ignored; an item that is too short for an edit has to stand as whole words. The items are a query set that goes
    against all rows in blocks of about block_bytes. If there are several, the matches of one are written before the
    next is read, so that a benchmark of any size needs bounded memory on the driver and in tasks. Documents are read once
    for a block, without a shuffle. Null or empty texts and items match nothing; repeated rows each count; of an
    item_id with several texts the best match of each block counts; a null item_id is ignored; other columns are not read.
    """
    out = held = None
    for got in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], got=got) -> Iterator[pa.RecordBatch]:
            m = Matcher(got, rate, min_chars)
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in m.search(t)]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "start", "end"])

        if held is not None:
            part = written(held, "matches")
            out = part if out is None else out.unionByName(part)
        held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return held if out is None else out.unionByName(held)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_chars: int = 8, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs in whose text no item is found, judged row by row in one pass for each block of items.

    Ids play no part: rows without one, or with one of several rows, are judged by their own texts. A null or empty text
    holds no item. Nothing is shuffled. The rules for items are those of matches.
    """
    schema, at, out = docs.schema, docs.columns.index("text"), docs
    for i, got in enumerate(_blocks(benchmark, block_bytes)):

        def run(batches: Iterator[pa.RecordBatch], got=got) -> Iterator[pa.RecordBatch]:
            m = Matcher(got, rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([not m.search(t) for t in b.column(at).cast(pa.string()).to_pylist()], pa.bool_()))

        out = (written(out, "clean") if i else out).mapInArrow(run, schema)
    return out


def op2_decontaminate_edit(spark, sf_dir):
    """doc_id, item_id, distance, start and end of every benchmark item found in a document."""
    from trajlake.llm.common import table

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
