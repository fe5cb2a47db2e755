"""Readers by extension, line numbers, file discovery, the dataset registry, sharded writers and resumable jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trajlake.operators.joins import resume
from trajlake.operators.shape import rl_row
from trajlake.sources.json_arrays import read_json_array

BAD = "_corrupt_record"


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """json (an array or an object), jsonl, csv with a header, parquet or text by extension; any other is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None and kind not in ("txt", "text") else spark.read
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "csv":
        return reader.csv(path, header=True)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for .{kind}: {path}")


def read_json_or_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON array or JSON lines, told by the first character that isn't blank; real_reward also fills eval_reward.

    Arrays of objects whose files have several splits are read by as many tasks (json_arrays), in no order; others in a task for each file.
    """
    first = spark.read.text(path).filter("trim(value) <> ''").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).limit(1).collect()
    array = bool(first) and first[0]["c"] == "["
    large = array and not spark.read.option("lineSep", "}").text(path).filter("_metadata.file_block_start > 0").isEmpty()
    df = read_json_array(spark, path, schema) if large else spark.read.schema(schema).json(path, multiLine=array)
    return df.withColumn("eval_reward", F.col("real_reward")) if "real_reward" in df.columns else df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers, from 1, blank ones included.

    A file's splits are counted where they are read and added up in the order in which they stand in the file.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"), "value")
    split = Window.partitionBy("file", "_at")
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = text.groupBy("file", "_at").agg(F.count("*").alias("_n"))
    base = sizes.select("file", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return text.withColumn("_k", F.row_number().over(split.orderBy("_i"))).join(base, ["file", "_at"]).select("file", (F.col("_base") + F.col("_k")).alias("line"), "value")


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines; blank lines are skipped, rejects are (file, line, value) of what isn't JSON, line the
    line's number in its file."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    text = numbered_lines(spark, path).filter("trim(value) <> ''")
    got = text.withColumn("r", F.from_json("value", f"{ddl}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    good = F.col(f"r.{BAD}").isNull() & F.col("r").isNotNull()
    return got.filter(good).select("file", "line", "r.*").drop(BAD), got.filter(~good).select("file", "line", "value")


def first_files(spark: SparkSession, path: str, n: int, glob: str = "*.json*") -> DataFrame:
    """(path, length) of the first n files under a folder in the order of their paths."""
    return discover(spark, path, glob).limit(n)


def read_root(spark: SparkSession, path: str, schema: StructType | str, list_key: str | None = None) -> DataFrame:
    """Rows of a JSON root: a list, one object, or the list under a key of the object."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(F.explode(list_key).alias("r")).select("r.*") if list_key else df


def discover(spark: SparkSession, path: str, glob: str = "*.json*") -> DataFrame:
    """(path, length) of the files under a folder, each once, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length").distinct().orderBy("path")


def read_tree(spark: SparkSession, path: str, schema: StructType | str, suffix: str) -> DataFrame:
    """JSON lines of all files under a folder whose names end in a suffix, with the file's name."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(path).withColumn("file", F.input_file_name())


def last_of_file(df: DataFrame, file: str = "file", place: str = "line") -> DataFrame:
    """The last record of each file."""
    row = F.struct(*[c for c in df.columns if c != file])
    return df.groupBy(file).agg(F.max_by(row, F.col(place)).alias("r")).select(file, "r.*")


def merge_parquet(spark: SparkSession, folder: str, out: str) -> None:
    spark.read.option("recursiveFileLookup", True).parquet(folder).write.mode("overwrite").json(out)


def write_jsonl(df: DataFrame, path: str, mode: str = "append", by: list[str] | None = None) -> None:
    """JSON lines; the commit is atomic for each task, so that no lock is needed."""
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def write_sharded(df: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder for each shard; rows of a shard go to one task unless it splits."""
    df.repartition(F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


def write_trajectories(df: DataFrame, path: str, step: str = "global_step", needed: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines in a folder for each training step; gives (step, rows, aligned).

    aligned: all `needed` columns have a value in every row of the step. A step that isn't aligned is written too.
    """
    write_jsonl(df, path, by=[step])
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy(step).agg(F.count("*").alias("rows"), F.bool_and(whole).alias("aligned"))


def rewrite_without(spark: SparkSession, path: str, schema: StructType | str, condition) -> int:
    """Rewrites a folder of JSON lines without the rows of a condition (a null condition keeps the row); gives how many went.

    The new files are written beside the old ones and take their place by renaming, so that readers never see half of them.
    """
    df = spark.read.schema(schema).json(path)
    bad = F.coalesce(condition, F.lit(False))
    gone = df.filter(bad).count()
    if gone:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        old, new, away = (hadoop(f"{path.rstrip('/')}{end}") for end in ("", ".new", ".old"))
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        df.filter(~bad).write.mode("overwrite").json(str(new.toString()))
        if not (fs.rename(old, away) and fs.rename(new, old)):
            raise OSError(f"{path} could not be replaced")
        fs.delete(away, True)
    return gone


def builtin_path(root: str, split: str, kind: str, name: str) -> str:
    """Path of a built-in dataset: <root>/<train or test>/<math, code or web>/<name>.json."""
    if split not in ("train", "test") or kind not in ("math", "code", "web"):
        raise ValueError(f"no such dataset: {split}/{kind}/{name}")
    return f"{root.rstrip('/')}/{split}/{kind}/{name.lower()}.json"


def repo_list(df: DataFrame, column: str) -> DataFrame:
    """Repositories of JSON text that is a list, or an object of lists."""
    as_list = F.from_json(column, "array<string>")
    as_map = F.flatten(F.map_values(F.from_json(column, "map<string,array<string>>")))
    return df.select(F.explode(F.when(F.ltrim(F.col(column)).startswith("["), as_list).otherwise(as_map)).alias("repo"))


class Registry:
    """Datasets by name and split under a folder: raw rows and rows wrapped for training, both parquet.

    The layout is the registry: <root>/<name>/<split>/raw and .../wrapped; listings go through Hadoop's file system, so that
    any store that Spark reads will do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _dirs(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def register(self, df: DataFrame, name: str, split: str, question: str = "question", answer: str = "answer") -> None:
        base = f"{self.root}/{name}/{split}"
        df.write.mode("overwrite").parquet(f"{base}/raw")
        prompt = F.col(question) if question in df.columns else F.lit("")
        truth = F.col(answer).cast("string") if answer in df.columns else F.lit(None).cast("string")
        df.select(rl_row(prompt, truth, "rule", F.to_json(F.struct(*df.columns))).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{base}/wrapped")

    def load(self, name: str, split: str, wrapped: bool = False) -> DataFrame:
        if not self.exists(name, split):
            raise KeyError(f"{name}/{split}")
        return self.spark.read.parquet(f"{self.root}/{name}/{split}/{'wrapped' if wrapped else 'raw'}")

    def names(self) -> list[str]:
        return self._dirs(self.root)

    def splits(self, name: str) -> list[str]:
        return self._dirs(f"{self.root}/{name}")

    def exists(self, name: str, split: str | None = None) -> bool:
        return bool(self._fs.exists(self._path(f"{self.root}/{name}" + (f"/{split}" if split else ""))))

    def remove(self, name: str, split: str | None = None) -> bool:
        return bool(self._fs.delete(self._path(f"{self.root}/{name}" + (f"/{split}" if split else "")), True))


class ResumableJob:
    """Work that skips ids that are in its output, and appends."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str, error: str | None = None):
        self.spark, self.path, self.key, self.schema, self.error = spark, path, key, schema, error

    def done(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(self.schema).json(self.path) if there else self.spark.createDataFrame([], self.schema)

    def todo(self, df: DataFrame) -> DataFrame:
        return resume(df, self.done(), self.key, self.error)

    def run(self, df: DataFrame, work) -> None:
        """work: DataFrame -> DataFrame with the job's schema. An id that comes out with an error comes again next time."""
        write_jsonl(work(self.todo(df)), self.path)

    def latest(self) -> DataFrame:
        """One output for each id, one without an error if there is one."""
        df = self.done()
        bad = F.col(self.error).isNotNull().cast("int") if self.error else F.lit(0)
        w = Window.partitionBy(self.key).orderBy(bad, F.xxhash64(F.to_json(F.struct(*df.columns))))
        return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def decode_tests(column, schema: str = "array<struct<input:string,output:string>>"):
    """Test lists that come as JSON text or as base64 of it. Anything that isn't JSON, pickles included, gives null."""
    direct = F.from_json(column, schema)
    return F.coalesce(direct, F.from_json(F.try_to_binary(column, F.lit("base64")).cast("string"), schema))


def dump_config(spark: SparkSession, path: str, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
