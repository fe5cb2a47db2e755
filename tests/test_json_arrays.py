from __future__ import annotations

import json
import random

import pytest

from trajlake.sources import json_arrays

SCHEMA = "id long, text string, tags array<string>, nest struct<a:long,b:struct<c:string>>, list array<struct<x:long>>"


def rows_of(df):
    return sorted((json.dumps(r.asDict(True), sort_keys=True) for r in df.collect()))


def records(n, seed=1):
    rng = random.Random(seed)
    bits = ["}", "{", "[", "]", '"', "\\\\", "\\", ",", "},{", "é", "日", "\n", " ", "a" * 30, '\\"}', "\\\\}"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    return [{"id": i, "text": text(), "tags": [text() for _ in range(rng.randint(0, 3))], "nest": {"a": i, "b": {"c": text()}} if i % 3 else None, "list": [{"x": k} for k in range(i % 4)]} for i in range(n)]


@pytest.mark.parametrize(("split", "indent"), [(200, None), (64, 2), (1 << 20, None)])
@pytest.mark.parametrize("most", [100_000, 0])
def test_equal_to_a_reader_in_one_task(spark, tmp_path, monkeypatch, split, indent, most):
    monkeypatch.setattr(json_arrays, "BROADCAST_SPLITS", most)
    path = str(tmp_path / "a.json")
    with open(path, "w") as f:
        json.dump(records(120), f, ensure_ascii=False, indent=indent)
    want = rows_of(spark.read.schema(SCHEMA).json(path, multiLine=True))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > (20 if split < 1000 else 0)
        assert rows_of(json_arrays.read_json_array(spark, path, SCHEMA)) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_several_files_and_empty_ones(spark, tmp_path):
    for name, content in (("a", records(7)), ("b", []), ("c", records(5, 2))):
        (tmp_path / f"{name}.json").write_text(" \n" + json.dumps(content) + "\n")
    (tmp_path / "d.json").write_text("")
    assert rows_of(json_arrays.read_json_array(spark, str(tmp_path), SCHEMA)) == rows_of(spark.read.schema(SCHEMA).json(str(tmp_path), multiLine=True))
