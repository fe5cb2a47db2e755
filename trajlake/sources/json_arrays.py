"""One large JSON array of objects, read by many tasks.

A byte range of the file can't tell by itself whether it begins inside a string, or how deep. But what it makes of either
beginning is a small map (from a string or not, to a string or not, and by how many levels deeper), and maps compose: each range is
scanned once for its map, the maps, one row each, are added up in the order of the file, and each range then knows where it begins
and so where elements end. Ranges are Spark's own splits of a text file with "}" for the end of a line. An element that
lies in several splits is put together from its parts. Elements are parsed by from_json.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trajlake.operators.order import pinned

#: Up to so many splits their entry states are broadcast, some 100 bytes each; more are joined by a shuffle.
BROADCAST_SPLITS = 100_000
DEEPER = np.zeros(256, dtype=np.int64)
DEEPER[[0x7B, 0x5B]], DEEPER[[0x7D, 0x5D]] = 1, -1


def marks(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it in a string (a closing quote isn't), and by how many levels the text is deeper behind it.

    inside: does the text begin in a string? It doesn't begin behind a backslash.
    """
    plain = text.replace(b"\\\\", b"__").replace(b'\\"', b"__")
    raw = np.frombuffer(plain, dtype=np.uint8)
    quoted = (np.cumsum(raw == 0x22) + inside) % 2 == 1
    return quoted, np.cumsum(np.where(quoted, 0, DEEPER[raw]))


def _splits(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list, bytes, np.ndarray]]:
    """(first columns, text with "}" behind each piece, its places) of the rows of one split, a batch at a time."""
    for b in batches:
        heads = [c.to_pylist() for c in b.columns[:columns]]
        keys = list(zip(heads[0], heads[1]))
        cut = [0, *(i for i in range(1, b.num_rows) if keys[i] != keys[i - 1]), b.num_rows]
        for a, e in zip(cut, cut[1:]):
            if e > a:
                pieces = b.column(columns).slice(a, e - a).to_pylist()
                ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
                yield [h[a] for h in heads], b"}".join(pieces) + b"}", ends


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, flips, d0, d1) of each split: does it end in the other state, and by how much deeper if begun outside or in a string."""
    now, state, deeper = None, [0, 1], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([state[0]], pa.int32()), pa.array([deeper[0]], pa.int64()), pa.array([deeper[1]], pa.int64())], ["file", "at", "flips", "d0", "d1"])

    for (file, at), text, _ in _splits(batches, 2):
        if now != (file, at):
            if now is not None:
                yield row()
            now, state, deeper = (file, at), [0, 1], [0, 0]
        for s in (0, 1):
            inside, levels = marks(text, state[s])
            state[s], deeper[s] = int(inside[-1]), deeper[s] + int(levels[-1])
    if now is not None:
        yield row()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, part, value): whole elements (part null), and of each split what stands before its first end (0) or behind its last (1)."""
    now, quoted, depth, held, ended = None, 0, 0, b"", False

    def row(part: int | None, values: list[bytes]) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(values, pa.binary()).cast(pa.string())], ["file", "at", "part", "value"])

    for (file, at, q, d), text, ends in _splits(batches, 4):
        if now != (file, at):
            if now is not None:
                yield row(1 if ended else 0, [held])
            now, quoted, depth, held, ended = (file, at), q, d, b"", False
        inside, levels = marks(text, quoted)
        stop = ends[(levels[ends] + depth == 1) & ~inside[ends]]
        quoted, depth, a, whole = int(inside[-1]), depth + int(levels[-1]), 0, []
        for e in stop.tolist():
            if ended:
                whole.append(held + text[a : e + 1])
            else:
                yield row(0, [held + text[a : e + 1]])
            held, a, ended = b"", e + 1, True
        if whole:
            yield row(None, whole)
        held += text[a:]
    if now is not None:  # nothing behind the last end is told too, as the next split begins anew then
        yield row(1 if ended else 0, [held])


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the elements of JSON arrays of objects as texts, in no order.

    path: files of one array each. What stands between elements is left out; an empty file or array has none. A task holds a
    batch of pieces and one element. Splits of a file are read twice: for their maps, and for their elements.
    """
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("i"))
    maps = pinned(pieces.select("file", "at", "value").mapInArrow(_maps, "file string, at long, flips int, d0 long, d1 long"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("quoted", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    maps = maps.withColumn("deeper", F.when(F.col("quoted") == 1, F.col("d1")).otherwise(F.col("d0")))
    entry = maps.select("file", "at", "quoted", F.coalesce(F.sum("deeper").over(before), F.lit(0)).cast("long").alias("depth"))
    if maps.count() <= BROADCAST_SPLITS:
        known = pieces.join(F.broadcast(entry), ["file", "at"])
    else:
        known = pieces.join(entry, ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "i")
    found = known.select("file", "at", "quoted", "depth", "value").mapInArrow(_elements, "file string, at long, part int, value string")
    # parts of one element: what is left at the end of a split, and all up to the first end behind it
    ends = found.filter("part is not null").withColumn("no", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("at", "part")))
    joined = ends.groupBy("file", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part", "value"))), lambda p: p["value"]), "").alias("value"))
    every = found.filter("part is null").select("file", "value").unionByName(joined.select("file", "value"))
    body = F.regexp_replace("value", r"^[^{]*", "")  # the array's bracket, commas and blanks
    return every.select("file", body.alias("value")).filter("value <> ''")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of JSON arrays of objects, as spark.read with multiLine gives them, in no order."""
    return array_elements(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
