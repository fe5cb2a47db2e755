"""Commits as rows of their diffs: counters, rebuilt patches, files that actions touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.text import file_extension, is_test_path


def commit_counters(lines: DataFrame, commit: str) -> DataFrame:
    """(commit, files, test_files, hunks, added, deleted, edited_lines, other_edited_lines, extensions) of rows as patch_rows gives them.

    Edited lines are added or deleted ones; other_edited_lines leaves out those of tests.
    """
    test, edit = is_test_path(F.col("path")), F.col("kind") != "context"
    return lines.groupBy(commit).agg(
        F.countDistinct("path").alias("files"), F.countDistinct(F.when(test, F.col("path"))).alias("test_files"), F.countDistinct("file_no", "hunk_no").alias("hunks"), F.count_if(F.col("kind") == "added").alias("added"),
        F.count_if(F.col("kind") == "deleted").alias("deleted"), F.count_if(edit).alias("edited_lines"), F.count_if(edit & ~test).alias("other_edited_lines"), F.sort_array(F.collect_set(file_extension(F.col("path")))).alias("extensions"))


def rebuilt(lines: DataFrame, commit: str, tests: bool = True, others: bool = True, only_python: bool = False) -> DataFrame:
    """(commit, patch): the patch written anew from its rows, with or without tests, other files, and files other than Python.

    Hunk headers are counted from the lines, so that a patch without context changes comes out equal line by line.
    """
    keep = F.lit(True)
    if not tests:
        keep = keep & ~is_test_path(F.col("path"))
    if not others:
        keep = keep & is_test_path(F.col("path"))
    if only_python:
        keep = keep & F.endswith(F.col("path"), F.lit(".py"))
    sign = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "deleted", "-").otherwise(" ")
    hunks = lines.filter(keep).groupBy(commit, "file_no", "path", "hunk_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.concat(sign, "text").alias("t")))).alias("ls"), F.min("old_line").alias("a"), F.count("old_line").alias("na"), F.min("new_line").alias("b"), F.count("new_line").alias("nb"))
    span = lambda at, n: F.when(F.col(n) == 1, F.col(at).cast("string")).otherwise(F.concat(F.coalesce(F.col(at), F.lit(0)).cast("string"), F.lit(","), F.col(n).cast("string")))
    text = F.concat(F.lit("@@ -"), span("a", "na"), F.lit(" +"), span("b", "nb"), F.lit(" @@\n"), F.array_join(F.transform("ls", lambda x: x["t"]), "\n"), F.lit("\n"))
    files = hunks.select(commit, "file_no", "path", "hunk_no", "na", "nb", text.alias("t")).groupBy(commit, "file_no", "path").agg(F.array_sort(F.collect_list(F.struct("hunk_no", "t"))).alias("hs"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    name = lambda side, n: F.when(F.col(n) > 0, F.concat(F.lit(side + "/"), "path")).otherwise("/dev/null")
    whole = F.concat(F.lit("--- "), name("a", "na"), F.lit("\n+++ "), name("b", "nb"), F.lit("\n"), F.array_join(F.transform("hs", lambda x: x["t"]), ""))
    per = files.select(commit, "file_no", whole.alias("t"))
    return per.groupBy(commit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "t"))), lambda x: x["t"]), "").alias("patch"))


def touched_files(actions: Column) -> Column:
    """struct<created, edited, viewed> of an array of parsed editor actions (fn, params): paths, each once, in order."""
    pick = lambda *commands: F.array_distinct(F.array_compact(F.transform(F.filter(actions, lambda a: a["params"]["command"].isin(*commands)), lambda a: a["params"]["path"])))
    return F.struct(pick("create").alias("created"), pick("str_replace", "insert", "edit").alias("edited"), pick("view").alias("viewed"))


def issue_contents(commits: DataFrame, issues: DataFrame) -> DataFrame:
    """(commit_hash, contents): title and body of each issue that a commit resolves; issues that aren't there are left out."""
    got = commits.select("commit_hash", F.posexplode("issues").alias("_i", "issue")).join(issues, "issue")
    g = got.groupBy("commit_hash").agg(F.array_sort(F.collect_list(F.struct("_i", "title", "body"))).alias("c"))
    return g.select("commit_hash", F.transform("c", lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body"))).alias("contents"))


def routing_skew(log: DataFrame, server: str, load: str, limit: int = 4) -> DataFrame:
    """(server, load, rebalance): loads by server from a log of requests, and whether they differ by the limit or more."""
    per = log.groupBy(server).agg(F.sum(load).alias("load"))
    edge = per.agg(F.min("load").alias("_lo"), F.max("load").alias("_hi"))
    return per.crossJoin(F.broadcast(edge)).select(server, "load", ((F.col("_hi") - F.col("_lo")) >= limit).alias("rebalance"))
