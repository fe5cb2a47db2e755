"""Streams of trajectories: complete groups, appends that happen once, windowed metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Groups(StatefulProcessor):
    """Holds the payloads of open groups in a list of the state store, to which arrivals are appended.

    A timer of an open group is set anew at each arrival; when it rings, the group comes out as it is.
    """

    def __init__(self, uid: str, payload: str, kind: T.DataType, n: int, limit: int):
        self.uid, self.payload, self.kind, self.n, self.limit = uid, payload, kind, n, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([T.StructField("payload", self.kind)]))
        self.size = handle.getValueState("size", "n int")

    def _rows(self, key: tuple, groups: list[list], complete: bool) -> pd.DataFrame:
        return pd.DataFrame({self.uid: [key[0]] * len(groups), "payloads": groups, "complete": [complete] * len(groups)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = [x for f in rows for x in f[self.payload].tolist()]
        size = self.size.get()[0] if self.size.exists() else 0
        whole, left = [], arrived
        if size + len(arrived) >= self.n:
            every = [r[0] for r in self.held.get()] + arrived
            whole = [every[a : a + self.n] for a in range(0, len(every) - self.n + 1, self.n)]
            left, size = every[len(whole) * self.n :], 0
            self.held.clear()
        if left:
            self.held.appendList([(x,) for x in left])
            self.size.update((size + len(left),))
        elif self.size.exists():
            self.size.clear()
        if self.limit:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if left:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit)
        if whole:
            yield self._rows(key, whole, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.size.exists():
            held = [r[0] for r in self.held.get()]
            self.held.clear()
            self.size.clear()
            yield self._rows(key, [held], False)

    def close(self) -> None:
        pass


def complete_groups(stream: DataFrame, uid: str, payload: str, n: int, timeout: str | None = None) -> DataFrame:
    """(uid, payloads, complete): a row once n rows of a uid have arrived, in the order of arrival; more rows begin anew.

    State holds fewer than n payloads for each open uid and survives a restart from the checkpoint. With a timeout (processing time, as
    "10 minutes") a group to which nothing comes for so long comes out as it is, with complete false; what arrives later
    begins a new one. Repeated rows each count, null payloads too; a null uid is a group. Sets the session's state store to RocksDB,
    which lists and timers need.
    """
    limit = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else 0
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    key, kind = stream.schema[uid].dataType, stream.schema[payload].dataType
    out = T.StructType([T.StructField(uid, key), T.StructField("payloads", T.ArrayType(kind)), T.StructField("complete", T.BooleanType())])
    return stream.select(uid, payload).groupBy(uid).transformWithStateInPandas(Groups(uid, payload, kind, n, limit), out, "Append", "ProcessingTime" if limit else "None")


class CommitLog:
    """What a folder of Parquet files has taken in: one entry for each batch, with the files that the batch adds.

    A batch is written to a hidden folder first; then its entry is made, complete from the first moment by renaming; then its files
    are moved to where readers see them; then the entry is marked as done. A batch that comes again after it is done adds nothing; one
    that died before its entry was made begins anew, and one that died later has the rest of its files moved.
    """

    def __init__(self, spark: SparkSession, target: str):
        sc = spark.sparkContext
        self.spark, self.target, self.path = spark, target.rstrip("/"), sc._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(target).getFileSystem(sc._jsc.hadoopConfiguration())
        self.jvm = sc._jvm

    def _at(self, *names: str):
        return self.path("/".join([self.target, *names]))

    def _write(self, name: str, text: str) -> None:
        temp = self._at("_log", f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(temp, self._at("_log", name)) and not self.fs.exists(self._at("_log", name)):
            raise OSError(f"no log entry {name} in {self.target}")

    def _read(self, name: str) -> list[str]:
        lines = self.spark.read.text(self._at("_log", name).toString(), wholetext=True).first()
        return json.loads(lines[0])

    def done(self, batch: str) -> bool:
        return self.fs.exists(self._at("_log", f"{batch}.done"))

    def append(self, batch: str, rows) -> bool:
        """Adds the rows (a function that gives a DataFrame, called only if they are needed) once; was there anything to do?"""
        if self.done(batch):
            return False
        entry, staged = f"{batch}.json", f"_staged/{batch}"
        if not self.fs.exists(self._at("_log", entry)):
            rows().write.mode("overwrite").parquet(self._at(staged).toString())
            files = sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(staged)))
            self._write(entry, json.dumps([f for f in files if f.endswith(".parquet")]))
        for k, file in enumerate(self._read(entry)):
            there = self._at(f"part-{batch}-{k:05d}.parquet")
            if not self.fs.exists(there) and not self.fs.rename(self._at(staged, file), there):
                raise OSError(f"{file} of batch {batch} could not be moved")
        self._write(f"{batch}.done", "")
        self.fs.delete(self._at(staged), True)
        return True


def append_new(target: str, key: str):
    """For foreachBatch: appends the rows whose key the target doesn't have; a batch that comes twice or dies half-way comes out once.

    Repeats are told by the query and the number of the batch in the target's commit log, not by their rows. Of rows with one
    key a batch adds one; rows with a null key are all added. Of the target only keys between the batch's
    least and greatest are read, a filter that reaches the files' statistics. One query at a time may write to a target.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        log = CommitLog(spark, target)

        def rows() -> DataFrame:
            named = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
            if log.fs.exists(log._at("_log")):
                low, high = batch.agg(F.min(key), F.max(key)).first()
                old = spark.read.schema(batch.schema).parquet(target).select(key).filter(F.col(key).between(low, high))
                named = named.join(old, key, "left_anti")
            return named.select(*batch.columns).unionByName(batch.filter(F.col(key).isNull()))

        log.append(f"{query}-{batch_id}", rows)

    return write


def with_retry(df: DataFrame, call, result: str, attempts: int = 3, timeout: float = 7200.0) -> DataFrame:
    """df with result (a DDL type), attempts (tries used) and error (text of the last one, null on success).

    call(row as a dict) runs once for a row and again after an error or after `timeout` seconds, up to `attempts` times. What
    fails throughout has a null result; it isn't lost, and `error is not null` tells it. A call has to bear being repeated,
    as a task that is lost begins anew. A call that doesn't return is left behind in its thread, at most `attempts` for a row;
    all others share one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(1)
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                value, error, used = None, None, 0
                while used < attempts:
                    used += 1
                    tried = pool.submit(call, row)
                    try:
                        value, error = tried.result(timeout), None
                        break
                    except Exception as e:  # whatever a call may raise is its row's error
                        error = f"{type(e).__name__}: {e}"
                    if not tried.done():
                        pool.shutdown(wait=False)
                        pool = ThreadPoolExecutor(1)
                out.append((value, used, error))
            yield f.assign(result=[x[0] for x in out], attempts=[x[1] for x in out], error=[x[2] for x in out])
        pool.shutdown(wait=False)

    kind = T._parse_datatype_string(f"result {result}").fields[0].dataType
    more = [T.StructField("result", kind), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())]
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *more]))


def windowed_rates(stream: DataFrame, ts: str, reward: str, window: str = "1 hour", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Rows and success share in tumbling windows of event time, with a watermark."""
    t = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = t.groupBy(F.window("_ts", window), *(by or [])).agg(F.count("*").alias("n"), F.avg((F.col(reward) > 0).cast("double")).alias("success_rate"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "n", "success_rate")


def sessions(stream: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of events with gaps below `gap`."""
    t = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = t.groupBy(F.session_window("_ts", gap), user).agg(F.count("*").alias("n"))
    return g.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_available(df: DataFrame, target: str, checkpoint: str, key: str | None = None):
    """Process what is there and stop; appends by key if one is named."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(append_new(target, key)).start() if key else w.format("parquet").option("path", target).outputMode("append").start()
    q.awaitTermination()
