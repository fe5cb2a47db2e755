"""Shared plumbing: table access, the shared work folder, lineage cuts and stable splits."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs in one process (local mode, as in tests) a folder is made and set; on a
    cluster that is an error, as a folder of one machine is no shared folder.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="trajlake-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for what only this job reads; scratch removes it."""
    _made.append(fresh_path(spark, name))
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of the shared folder that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """On leaving, removes what was written to the shared folder inside, but for written tables that the body adds to the list it
    gets.

    For steps whose result is written before the end: what they read on the way is then of no more use.
    """
    first, tables = len(_made), []
    yield tables
    kept = [t.folder for t in tables]
    gone = [p for p in _made[first:] if p not in kept]
    _made[first:] = kept
    remove(spark, gone)


HOT_ROWS, HOT_KEYS = 1024, 1000


def spread_join(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """big joined (inner) with small, which has one row for a key, where a key may hold any share of big's rows.

    The HOT_KEYS most frequent keys of big that have over HOT_ROWS rows are told by partial counts; their rows of small, at
    most HOT_KEYS, are broadcast. All other keys hold less than a thousandth of big each and meet by a shuffle, as all
    do if there is no such key. big is read several times and should be a written table. Null keys join nothing.
    """
    counted = big.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT_ROWS)
    hot = [r[0] for r in counted.orderBy(F.desc("_rows"), on).limit(HOT_KEYS).select(on).collect()]
    if not hot:
        return big.join(small, on)
    often = big.filter(F.col(on).isin(hot)).join(F.broadcast(small.filter(F.col(on).isin(hot))), on)
    return often.unionByName(big.filter(~F.col(on).isin(hot)).join(small, on))


def crc_split(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def squeezed(data: bytes) -> bytes:
    """A message in few bytes: zstandard tells runs and rare bytes, which Spark's own compression of shuffles passes by."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(*arrays: np.ndarray) -> bytes:
    """Whole numbers as bytes of equal weight one behind the other, which compress well where numbers are small or sorted."""
    return b"".join(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)


def from_planes(data: bytes, n: int) -> list[np.ndarray]:
    """The arrays of n numbers each."""
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in np.frombuffer(data, np.uint8).reshape(-1, 8, n)] if n else []


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def whole_keys(batches: Iterator, kinds: list) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by their first column, as arrays of these types that never part the rows of one key.

    A key that goes on over many batches is put together once, when it ends.
    """
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [b.column(i).to_numpy().view(k) for i, k in enumerate(kinds)]
        if not len(cols[0]):
            continue
        same = int(np.searchsorted(cols[0], held[0][0][0], side="right")) if held else 0
        if held:
            held.append([c[:same] for c in cols])
            if same == len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield [np.concatenate([*(h[i] for h in held), c[same:max(last, same)]]) for i, c in enumerate(cols)]
            held = [[c[max(last, same):] for c in cols]]
        else:
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield [c[:last] for c in cols]
            held = [[c[last:] for c in cols]]
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(len(kinds))]


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch for rows that hold megabytes; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(c for c in spark.conf.get(name) if c.isdigit())
    if not now or int(now) > most:
        spark.conf.set(name, str(most))
