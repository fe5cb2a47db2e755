"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id into shards whose bounds depend on the data alone; a shard's files roll when their
compressed size is reached; headers and digests are made anew. A task writes files under temporary names and reports them
in a manifest, which Spark commits with the successful attempts only; a second step renames what the manifest lists.
A lost executor leaves nothing but temporary files that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.common import fresh_path, spread_join, utf8, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1d3c1e-9a55-4a6b-8a0e-3d5a1c0f7b21")
MANIFEST = "shard long, seq int, temp string, name string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
BAD = re.compile(r"[\x00-\x20\x7f]")
CELLS, CELL_SHARE = 1024, 8
MOST_TASKS = 100_000


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # the gzip header has no time and no name
    return c.compress(data) + c.flush()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record. A revisit has the HTTP head of its page, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    uri = BAD.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{kind}').urn}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{uuid.uuid5(NAMESPACE, f'{refers_to}/{digest}/response').urn}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    if url is None:
        fields.append(("X-No-URL", "1"))
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = f"software: trajlake\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    lines = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid5(NAMESPACE, name).urn}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return b"WARC/1.1\r\n" + lines.encode() + block + b"\r\n\r\n"


def shard_bounds(sized: DataFrame, shard_bytes: int) -> list[int]:
    """Increasing first ids of the shards 1, 2, ... so that a shard holds at most shard_bytes, from (id long, bytes long).

    A histogram over equal cells of the id range, CELL_SHARE for each shard, is summed exactly; cells that are too full and
    hold more than one id are divided again, by CELLS. The cells stay distributed: the driver sees the totals of groups of
    CELLS cells, from which each group's cells are added up where they are, and then the bounds, one long for a shard. So
    bounds depend on the data alone. An id whose pages alone exceed a cell makes its shard
    that much larger. Null ids are ignored.
    """
    sized = sized.filter("id is not null")
    low, high, total = sized.agg(F.min("id"), F.max("id"), F.sum("bytes")).first()
    if low is None:
        return []
    kind = "long" if high - low < 2**62 else "decimal(38,0)"
    cells, most = max(CELLS, CELL_SHARE * (total // shard_bytes)), shard_bytes // CELL_SHARE
    width = top = max(1, -(-(high - low + 1) // cells))
    cur, closed = sized.select("id", "bytes", F.array().cast("array<long>").alias("key")), None
    while True:
        child = F.expr(f"(cast(id as {kind}) - cast({low} as {kind})) div cast({width} as {kind})").cast("long")
        cur = cur.withColumn("key", F.concat("key", F.array(child)))
        got = written(cur.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.sum("bytes").alias("n")), "cells")
        full = (F.col("n") > most) & (F.col("a") != F.col("z"))
        part = got.filter(~full).select("a", "n")
        closed = part if closed is None else closed.unionByName(part)
        over = got.filter(full).select("key")
        if over.isEmpty():
            break
        width = max(1, -(-width // CELLS))
        cur = cur.join(over, "key", "left_semi")
    group = F.expr(f"(cast(a as {kind}) - cast({low} as {kind})) div cast({top * CELLS} as {kind})").cast("long")
    closed = written(closed.withColumn("g", group), "cells")
    before, held = [], 0
    for r in closed.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").toLocalIterator():
        before.append((r["g"], held))
        held += r["n"]
    offsets = sized.sparkSession.createDataFrame(before, "g long, before long")
    ahead = F.sum("n").over(Window.partitionBy("g").orderBy("a")) - F.col("n")
    placed = closed.select("a", "g", "n", ahead.alias("ahead")).join(F.broadcast(offsets), "g")
    # a cell is at most a CELL_SHARE-th of a shard, so that one that starts anew at each multiple of the rest isn't over-full
    shard = F.expr(f"(before + ahead) div {shard_bytes - most}")
    firsts = placed.groupBy(shard.alias("k")).agg(F.min("a").alias("a"))
    return sorted(r["a"] for r in firsts.select("a").toLocalIterator())[1:]


def revisits(sized: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, first) of the pages whose payload another page with a smaller id has: first is the smallest.

    Groups are counted with partial aggregation, so a payload that a third of all pages share costs a row for each
    task, and what is told of it goes to all tasks.
    """
    groups = sized.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return spread_join(sized.filter("page_id is not null"), groups, "digest").filter("page_id > first").select("page_id", "digest", "first").distinct()


def write_warcs(pages: DataFrame, path: str, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under path; gives the committed manifest.

    Of equal payloads of at least min_bytes the one with the smallest page_id is a response and the others are revisits of
    it; shorter payloads are all responses. Equal rows with the smallest id: one is the response, the others revisit
    it. A null html is the empty payload, a null url a record of urn:page:<id>; pages without an id are responses of their
    own in shards behind the others, dealt by their digests. Other columns are ignored. The payload crosses the network
    once, in the range sort; a task takes one shard, or several neighbours if there are over MOST_TASKS.
    """
    spark = pages.sparkSession
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("payload"))
    sized = src.select("page_id", F.octet_length("payload").cast("long").alias("bytes"), F.unhex(F.sha1("payload")).alias("digest"))
    sized = written(sized, "sized")
    bounds = shard_bounds(sized.select(F.col("page_id").alias("id"), (F.col("bytes") + 600).alias("bytes")), shard_bytes)
    nameless = sized.filter("page_id is null").agg(F.sum(F.col("bytes") + 600)).first()[0] or 0
    more = max(1, -(-nameless // shard_bytes))
    apart = F.lit(len(bounds) + 1) + F.pmod(F.xxhash64("digest", "url"), F.lit(more))
    shard = F.when(F.col("page_id").isNull(), apart).otherwise(_shard_of(F.col("page_id"), bounds))
    rows = src.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.lit(None).cast("long").alias("first"), "url", "payload")
    told = revisits(sized, min_bytes).select("page_id", "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    dealt = rows.unionByName(told).withColumn("shard", shard)
    shards = len(bounds) + 1 + (more if nameless else 0)
    n = min(shards, MOST_TASKS)
    task = F.expr(f"cast(shard as long) * {n} div {shards}").cast("int")
    dealt = dealt.repartitionById(n, task) if hasattr(dealt, "repartitionById") else dealt.repartition(n, task)
    # what was told of a page comes first, then its rows
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", F.col("first").asc_nulls_last(), F.col("url").asc_nulls_first())
    out = dealt.select("shard", "page_id", "digest", "first", "url", "payload").mapInArrow(_writer(path, roll_bytes, min_bytes, date), MANIFEST)
    out.write.parquet(f"{path}/_attempts")
    listed = spark.read.schema(MANIFEST).parquet(f"{path}/_attempts")
    listed.mapInArrow(_commit(path), MANIFEST).write.parquet(f"{path}/_manifest")
    fs, root = pafs.FileSystem.from_uri(path)
    fs.delete_dir(f"{root}/_temporary") if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory else None
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def _shard_of(page_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at most page_id: a tree of comparisons, or a search in Arrow batches for many."""
    if not bounds:
        return F.lit(0).cast("long")
    if len(bounds) > 256:
        at = np.array(bounds)

        @F.pandas_udf("long")
        def search(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(at, ids.fillna(at[0] - 1).to_numpy(dtype=np.int64), side="right"))

        return search(page_id)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(page_id >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def _writer(path: str, roll_bytes: int, min_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        attempt, done, out = uuid.uuid4().hex, [], None
        told = last = None  # what the row before says of (page, digest); the last response written

        def close() -> None:
            out["stream"].close()
            done.append([*(out[k] for k in ("shard", "seq", "temp", "name", "records", "bytes")), out["sha256"].hexdigest()])

        for b in batches:
            for shard, page, digest, first, url, payload in zip(*(c.to_pylist() for c in b.columns)):
                if first is not None:
                    told = (page, digest, first)
                    continue
                if out and (out["shard"] != shard or out["bytes"] >= roll_bytes):
                    seq = out["seq"] + 1 if out["shard"] == shard else 0
                    close()
                    out = None
                else:
                    seq = 0
                if not out:
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    temp = f"_temporary/{attempt}-{name}"
                    out = {"shard": shard, "seq": seq, "temp": temp, "name": name, "records": 0, "bytes": 0, "sha256": hashlib.sha256(), "stream": fs.open_output_stream(f"{root}/{temp}", compression=None)}
                    z = _gz(_info(name, date))
                    out["stream"].write(z)
                    out["bytes"] += len(z)
                    out["sha256"].update(z)
                refers = told[2] if told and told[:2] == (page, digest) else page if last == (page, digest) and page is not None and len(payload) >= min_bytes else None
                kind = "response" if refers is None else "revisit"
                if kind == "response":
                    last = (page, digest)
                z = _gz(record(kind, page, url, payload, base64.b32encode(digest).decode(), refers, date))
                out["stream"].write(z)
                out["records"] += 1
                out["bytes"] += len(z)
                out["sha256"].update(z)
        if out:
            close()
        cols = list(zip(*done)) or [[]] * 7
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "seq", "temp", "name", "records", "bytes", "sha256"])

    return run


def _commit(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for temp, name, size in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist()):
                if fs.get_file_info(f"{root}/{temp}").type == pafs.FileType.File:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                got = fs.get_file_info(f"{root}/{name}")  # an earlier attempt of this task may have moved it
                if got.type != pafs.FileType.File or got.size != size:
                    raise OSError(f"{name} is not as the manifest says")
            yield b

    return run


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a compressed stream, member by member."""
    z, left, data = zlib.decompressobj(31), stream.read(1 << 18), b""
    while left:
        data += z.decompress(left)
        left = z.unused_data if z.eof else b""
        if z.eof:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a record")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(fields["content-length"])
            if rest[n:] != b"\r\n\r\n":
                raise ValueError("a record is longer or shorter than it says")
            yield fields, rest[:n]
            z, data = zlib.decompressobj(31), b""
        left = left or stream.read(1 << 18)
    if data:
        raise ValueError("the file ends inside a record")


def read_warcs(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record of the manifest's files.

    Digests of blocks, and of payloads where the record has one, are computed from the bytes and compared to the headers; a
    difference raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as s:
                    for fields, block in read_records(s):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
                            raise ValueError(f"block digest of {fields['warc-record-id']}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        if kind == "response" and (sha1_base32(payload) != digest or len(payload) != size):
                            raise ValueError(f"payload digest of {fields['warc-record-id']}")
                        page, refers = fields["x-page-id"], fields.get("x-refers-to-page-id")
                        rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, None if "x-no-url" in fields else fields["warc-target-uri"]))
                        if len(rows) >= 4096:
                            yield packed(rows)
                            rows = []
                yield packed(rows)

    files = manifest.select("name").repartition(min(MOST_TASKS, max(1, manifest.count())), "name")
    return files.mapInArrow(run, RECORD)


def op1_warc_round_trip(spark, sf_dir):
    """What reading gives of the archives written of pages: one row per page."""
    from trajlake.llm.common import table

    path = fresh_path(spark, "warc")
    manifest = write_warcs(table(spark, sf_dir, "pages"), path)
    return read_warcs(spark, path, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
b AS (SELECT DISTINCT h, list_aggregate(list_transform(regexp_extract_all(h, '.'), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits FROM p),
d AS (SELECT h, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
  + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest FROM b),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN d USING (h) JOIN f USING (h)
"""
