from __future__ import annotations

import json
import random

import numpy as np

from pyspark.sql import functions as F

from trajlake.operators import metrics, similarity
from trajlake.operators.order import round_robin_shards
from trajlake.sources import io
from trajlake.streaming import groups


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "real_reward": 1.0}, {"id": 2, "real_reward": None}]))
    (tmp_path / "b.jsonl").write_text('{"id": 3, "real_reward": 0.5}\n\nnot json\n{"id": 4}\n')
    (tmp_path / "c.csv").write_text("id,name\n1,x\n")
    ddl = "id int, real_reward double"
    assert io.read_any(spark, f"{tmp_path}/a.json", ddl).count() == 2 and io.read_any(spark, f"{tmp_path}/c.csv").first()["name"] == "x"
    assert [r["eval_reward"] for r in io.read_json_or_lines(spark, f"{tmp_path}/a.json", ddl).collect()] == [1.0, None]
    rows, rejects = io.read_lines(spark, f"{tmp_path}/b.jsonl", ddl)
    assert [r["id"] for r in rows.collect()] == [3, 4] and [r["value"] for r in rejects.collect()] == ["not json"]
    assert io.last_of_file(rows).first()["id"] == 4
    assert [r["path"].rsplit("/", 1)[-1] for r in io.discover(spark, str(tmp_path)).collect()] == ["a.json", "b.jsonl"]
    try:
        io.read_any(spark, "x.toml")
        raise AssertionError
    except ValueError:
        pass


def test_registry_and_shards(spark, tmp_path):
    reg = io.Registry(spark, f"file://{tmp_path}/reg")
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    reg.register(df, "math", "train")
    reg.register(df, "math", "test")
    assert reg.names() == ["math"] and reg.splits("math") == ["test", "train"] and reg.exists("math", "train")
    assert reg.load("math", "train", wrapped=True).first()["reward_model"]["ground_truth"] == "a"
    assert reg.remove("math", "test") and reg.splits("math") == ["train"]
    io.write_sharded(round_robin_shards(spark.range(10), ["id"], 3), f"{tmp_path}/shards")
    got = spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().orderBy("shard").collect()
    assert [(r["shard"], r["count"]) for r in got] == [(0, 4), (1, 3), (2, 3)]


def test_resume(spark, tmp_path):
    calls = []

    def work(df):
        calls.append(df.count())
        return df.select("id", F.when(F.col("id") == 2, "bad").alias("error"))

    job = io.ResumableJob(spark, f"{tmp_path}/out", "id", "id long, error string", error="error")
    job.run(spark.range(4), work)
    job.run(spark.range(5), work)
    assert calls == [4, 2] and job.latest().count() == 5


def test_decoding_takes_json_only(spark):
    import base64
    import pickle

    rows = [('[{"input":"1","output":"2"}]',), (base64.b64encode(b'[{"input":"3","output":"4"}]').decode(),), (base64.b64encode(pickle.dumps([1])).decode(),)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(io.decode_tests(F.col("x"))).collect()]
    assert got[0][0]["input"] == "1" and got[1][0]["input"] == "3" and not got[2]


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(u, f"{u}{i}") for u in "ab" for i in range(3 if u == "a" else 2)], "uid string, payload string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("uid string, payload string").parquet(source)
    q = groups.complete_groups(stream, "uid", "payload", 3).writeStream.format("memory").queryName("done").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["uid"], sorted(r["payloads"]), r["complete"]) for r in spark.table("done").collect()] == [("a", ["a0", "a1", "a2"], True)]
    for _ in range(2):
        groups.run_available(stream, f"{tmp_path}/sink", f"{tmp_path}/cp{_}", key="payload")
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 5
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = groups.windowed_rates(events, "ts", "value").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f'{{"id": {i}}}' if i % 7 else ("" if i % 2 else f"bad {i}") for i in range(1, 4001)]
    (tmp_path / "n.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = io.numbered_lines(spark, f"{tmp_path}/n.jsonl")
        assert spark.read.text(f"{tmp_path}/n.jsonl").select("_metadata.file_block_start").distinct().count() > 5
        assert {r["line"]: r["value"] for r in got.collect()} == dict(enumerate(lines, 1))
        rows, rejects = io.read_lines(spark, f"{tmp_path}/n.jsonl", "id int")
        assert all(r["line"] == r["id"] for r in rows.collect())
        assert {(r["line"], r["value"]) for r in rejects.collect()} == {(i, f"bad {i}") for i in range(14, 4001, 14)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rewrite_in_place_and_alignment(spark, tmp_path):
    path = f"{tmp_path}/log"
    spark.createDataFrame([(1, "agent"), (2, "traj_time_limit"), (3, None)], "id int, reason string").write.json(path)
    assert io.rewrite_without(spark, path, "id int, reason string", F.col("reason") == "traj_time_limit") == 1
    assert sorted(r["id"] for r in spark.read.schema("id int").json(path).collect()) == [1, 3]
    assert io.rewrite_without(spark, path, "id int, reason string", F.col("reason") == "traj_time_limit") == 0
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "c", None)], "global_step int, chat string, score double")
    told = {r["global_step"]: (r["rows"], r["aligned"]) for r in io.write_trajectories(rows, f"{tmp_path}/steps", needed=("chat", "score")).collect()}
    assert told == {0: (2, True), 1: (1, False)} and spark.read.json(f"{tmp_path}/steps").count() == 3


def test_first_files(spark, tmp_path):
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.json").write_text("{}")
    assert [r["path"].rsplit("/", 1)[1] for r in io.first_files(spark, str(tmp_path), 2).collect()] == ["a.json", "b.json"]


def test_retry_counts_attempts(spark):
    def call(row):
        if row["id"] == 1:
            raise ValueError("never")
        if row["id"] == 2:
            import time

            time.sleep(3)
        return row["id"] * 10

    df = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    got = {r["id"]: (r["result"], r["attempts"], r["error"]) for r in groups.with_retry(df, call, "long", attempts=2, timeout=0.5).collect()}
    assert got[0] == (0, 1, None) and got[1] == (None, 2, "ValueError: never") and got[2][:2] == (None, 2) and "Timeout" in got[2][2]


def test_nearest_of_all_is_top_k(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    key = lambda x: {(r["query_id"], r["index_id"]): r["score"] for r in x.collect()}
    got, want = key(similarity.nearest_of_all(df.repartition(3), "vec_id", "embedding", 4, block_rows=37)), key(similarity.top_k(df, df, "vec_id", "embedding", 4, exclude_self=True))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_similar_or_named_rows_go(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "an AIME problem"), (3, [0.0, 1.0], "y"), (4, [0.6, 0.8], None)], "id long, v array<double>, text string")
    b = spark.createDataFrame([(9, [2.0, 0.1])], "id long, v array<double>")
    assert sorted(r["id"] for r in similarity.drop_similar_or_named(a, b, "id", "v", "text", ["AIME", "aime"]).collect()) == [3, 4]
