"""A tree of files as scan rows: by Spark's binaryFile source, or by a walk that sees links, rights and empty directories."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import empty_directories
from ..operators.rules import IgnoreRule, is_ignored, is_ignored_below, may_contain_included
from ..operators.scale import staged

EDGE = 4096


def scan_files(spark: SparkSession, root: str, ignore: list[IgnoreRule] | None = None, hashes: bool = True, edge: int = EDGE) -> DataFrame:
    """(path, kind, length, mtime_ticks [, head_hash, tail_hash, full_hash]) of all files below root, hidden ones too
    unless Spark leaves them out (names that begin with _ or a dot). path is relative to root; ticks are 100 ns since
    1970. Without hashes the files' contents are not read. Links are followed by the file system, so kind is file.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    bare = base.partition("://")[2] or base.removeprefix("file:")
    path = F.expr("substring(path, locate(_root, path) + length(_root) + 1)")
    named = files.withColumn("_root", F.lit(bare)).withColumn("path", path)
    if ignore:
        named = named.where(~is_ignored_below(F.col("path"), ignore))
    digests = [F.md5(F.substring("content", 1, edge)).alias("head_hash"), F.md5(F.expr(f"substring(content, greatest(1, length(content) - {edge - 1}))")).alias("tail_hash"), F.md5("content").alias("full_hash")] if hashes else []
    return named.select("path", F.lit("file").alias("kind"), "length", (F.unix_micros("modificationTime") * 10).alias("mtime_ticks"), *digests)


_WALKED = "path string, kind string, is_directory boolean, length long, mtime_ticks long, permissions string, target string, reason string"


def _listing(root: str):
    """Rows of what stands right in each directory (path, relative to root) of a batch. What cannot be read is a row, not an
    error: the directory itself, or the entry of it."""

    def row(path: str, kind: str, is_directory: bool, s: os.stat_result | None = None, target: str | None = None, reason: str | None = None) -> tuple:
        clean = path.encode("utf-8", "replace").decode()
        known = (s.st_size if kind == "file" else 0, s.st_mtime_ns // 100, f"{stat.S_IMODE(s.st_mode):04o}") if s else (None, None, None)
        return (clean, kind, is_directory, *known, target, reason if clean == path else "its name is not UTF-8")

    def entry(path: str, e: os.DirEntry) -> tuple | None:
        try:
            s = e.stat(follow_symlinks=False)
            if stat.S_ISLNK(s.st_mode):
                return row(path, "symlink", False, s, os.readlink(e.path))
            if stat.S_ISDIR(s.st_mode):
                return row(path, "directory", True, s)
            if stat.S_ISREG(s.st_mode):
                return row(path, "file", False, s) if os.access(e.path, os.R_OK) else row(path, "unreadable", False, s, reason="may not be read")
            return None  # pipes, sockets and devices are no content
        except OSError as x:
            return row(path, "unreadable", False, reason=x.strerror)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _WALKED.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for directory in batch["path"]:
                try:
                    with os.scandir(os.path.join(root, directory)) as found:
                        for e in found:
                            if made := entry(f"{directory}/{e.name}" if directory else e.name, e):
                                rows.append(made)
                            if len(rows) >= 10_000:
                                yield pd.DataFrame(rows, columns=columns).astype({"length": "Int64", "mtime_ticks": "Int64"})
                                rows = []
                except OSError as x:
                    rows.append(row(directory, "unreadable", True, reason=x.strerror))
            yield pd.DataFrame(rows, columns=columns).astype({"length": "Int64", "mtime_ticks": "Int64"})

    return listed


def walk_tree(spark: SparkSession, root: str, ignore: list[IgnoreRule] | None = None, scope: DataFrame | None = None, symlinks: bool = False) -> DataFrame:
    """(path, kind, is_directory, length, mtime_ticks, permissions, target, reason) of all below root, which all executors
    have to see under this path. kind: file, symlink (with its target, never followed; left out unless symlinks), empty (a
    directory in scope that nothing is kept below, no empty directory either), or unreadable (with the reason; the root itself has the path "").

    The tree is listed level by level: the directories of a level are dealt over tasks, and one that is ignored, or below
    which scope(prefix, included) includes nothing, is never listed. Each level is written, so a lost executor costs one
    level at most. Levels are as many as the tree is deep.
    """
    rules = ignore or []
    frontier = spark.createDataFrame([("",)], "path string")
    levels: list[DataFrame] = []
    while not levels or not frontier.isEmpty():
        # dealt by path, so that a level of many directories is many tasks
        found = frontier.repartition("path").mapInPandas(_listing(root.rstrip("/") or "/"), _WALKED)
        if not symlinks:
            found = found.where("kind <> 'symlink'")
        if rules:
            found = found.where(~is_ignored(F.col("path"), F.col("is_directory"), rules) | ((F.col("kind") == "unreadable") & (F.col("path") == "")))
        if scope is not None:
            keyed = may_contain_included(found.select("path").distinct(), scope)
            found = found.join(keyed.select("path", "in_scope", "may_contain"), "path").where("in_scope or is_directory and may_contain").drop("may_contain")
        else:
            found = found.withColumn("in_scope", F.lit(True))
        levels.append(staged(found, "walk"))
        frontier = levels[-1].where("kind = 'directory'").select("path")
    every = reduce(DataFrame.unionByName, levels)
    kept = every.where("kind <> 'directory'")
    inside = every.where("kind = 'directory' and in_scope").select("path")
    bare = empty_directories(inside, kept.select("path").union(inside))
    empty = every.where("kind = 'directory'").join(bare, "path", "left_semi").withColumn("kind", F.lit("empty"))
    return kept.unionByName(empty).drop("in_scope")
