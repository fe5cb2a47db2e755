from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from trajlake.streaming import groups

SCHEMA = "uid string, payload string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def started(spark, folder, checkpoint, name, sink, **options):
    def keep(batch, _):
        sink.extend((r.uid, sorted(r.payloads, key=str), r.complete) for r in batch.collect())

    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return groups.complete_groups(stream, "uid", "payload", 3, **options).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(keep).start()


def test_groups_survive_a_restart_and_repeated_rows_count(spark, tmp_path):
    folder, checkpoint, sink = f"{tmp_path}/in", f"{tmp_path}/cp", []
    add(spark, folder, [("a", "1"), ("a", "1"), ("b", "x"), (None, "n"), ("c", None)])
    q = started(spark, folder, checkpoint, "one", sink)
    q.processAllAvailable()
    q.stop()
    assert sink == []
    add(spark, folder, [("a", "2"), ("a", "3"), ("b", "y"), (None, "m"), (None, "o"), ("c", "p"), ("c", None)])
    q = started(spark, folder, checkpoint, "two", sink)
    q.processAllAvailable()
    add(spark, folder, [("b", "z"), *[("d", str(i)) for i in range(7)]])
    q.processAllAvailable()
    q.stop()
    assert sorted(sink, key=str) == sorted([("a", ["1", "1", "2"], True), (None, ["m", "n", "o"], True), ("c", [None, None, "p"], True), ("b", ["x", "y", "z"], True), ("d", ["0", "1", "2"], True), ("d", ["3", "4", "5"], True)], key=str)


def test_open_groups_expire(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", []
    add(spark, folder, [("a", "1"), ("b", "x")])
    q = started(spark, folder, f"{tmp_path}/cp", "late", sink, timeout="2 seconds")
    end = time.time() + 90
    while len(sink) < 2 and time.time() < end:
        time.sleep(0.5)
    add(spark, folder, [("a", "2"), ("a", "3"), ("a", "4")])  # what is late begins anew
    while len(sink) < 3 and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert sorted(sink) == [("a", ["1"], False), ("a", ["2", "3", "4"], True), ("b", ["x"], False)]


def rows_at(spark, target):
    return sorted((tuple(r) for r in spark.read.parquet(target).collect()), key=str)


def test_appends_happen_once(spark, tmp_path):
    target = f"{tmp_path}/out"
    write = groups.append_new(target, "uid")
    first = spark.createDataFrame([("a", "1"), ("a", "1"), (None, "n"), (None, "n")], SCHEMA)
    for _ in range(2):  # the batch comes twice
        write(first, 0)
    assert rows_at(spark, target) == [("a", "1"), (None, "n"), (None, "n")]
    write(spark.createDataFrame([("a", "2"), ("b", "3"), (None, "n")], SCHEMA), 1)  # another batch: a is there
    assert rows_at(spark, target) == sorted([("a", "1"), ("b", "3"), (None, "n"), (None, "n"), (None, "n")], key=str)
    write(spark.createDataFrame([], SCHEMA), 2)
    write(spark.createDataFrame([(None, "only")], SCHEMA), 3)
    assert len(rows_at(spark, target)) == 6


@pytest.mark.parametrize("dies_at", ["staged", "logged", "moved"])
def test_a_batch_that_dies_half_way_comes_out_once(spark, tmp_path, monkeypatch, dies_at):
    target = f"{tmp_path}/out"
    df = spark.range(40).select(F.col("id").cast("string").alias("uid"), F.lit("p").alias("payload")).repartition(4)
    write, real = groups.append_new(target, "uid"), groups.CommitLog._write

    def dying(self, name, text):
        if dies_at == "staged" and name.endswith(".json"):
            raise RuntimeError("lost")
        real(self, name, text) if not (dies_at == "moved" and name.endswith(".done")) else (_ for _ in ()).throw(RuntimeError("lost"))
        if dies_at == "logged" and name.endswith(".json"):
            raise RuntimeError("lost")

    monkeypatch.setattr(groups.CommitLog, "_write", dying)
    with pytest.raises(RuntimeError):
        write(df, 5)
    monkeypatch.setattr(groups.CommitLog, "_write", real)
    if dies_at == "staged":
        spark.createDataFrame([], SCHEMA).coalesce(1).write.mode("append").parquet(target)
        assert spark.read.parquet(target).count() == 0  # nothing is visible yet
    for _ in range(2):
        write(df, 5)
    assert spark.read.parquet(target).count() == 40 == spark.read.parquet(target).select("uid").distinct().count()


def test_a_stream_from_its_checkpoint_and_a_new_one(spark, tmp_path):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    add(spark, folder, [("a", "1"), ("b", "2"), (None, "3")])
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    for _ in range(2):
        groups.run_available(stream, target, f"{tmp_path}/cp", key="uid")
    assert spark.read.parquet(target).count() == 3
    add(spark, folder, [("c", "4")])
    groups.run_available(stream, target, f"{tmp_path}/cp", key="uid")
    assert spark.read.parquet(target).count() == 4
