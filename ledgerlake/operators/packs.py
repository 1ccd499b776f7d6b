"""Grouping of files into packs under three limits, the same way for the same input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argument_bytes, parent_dir
from .scale import sum_before

SINGLE, BY_DIRECTORY, CROSS = "single", "directory", "cross"


def classify(files: DataFrame, threshold: int, dont_group: Column | bool = False, dont_compress: Column | bool = False, min_per_dir: int = 1) -> DataFrame:
    """files with lane (single, directory, cross), dir and store_only: large or don't-group files stand alone, those
    of a directory with fewer than min_per_dir candidates go to the cross lane, the rest stay with their directory."""
    col = lambda c: F.lit(c) if isinstance(c, bool) else c
    named = files.withColumn("dir", parent_dir(F.col("path"))).withColumn("store_only", col(dont_compress)).withColumn("_alone", (F.col("length") >= threshold) | col(dont_group))
    counts = directory_counts(named.where("not _alone"))
    lane = F.when(F.col("_alone"), SINGLE).when(F.col("candidates") < min_per_dir, CROSS).otherwise(BY_DIRECTORY)
    return named.join(counts, "dir", "left").withColumn("lane", lane).drop("_alone", "candidates")


def directory_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(parent_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("candidates"))


def greedy_packs(files: DataFrame, groups: list[str], cap: int, max_members: int = 2**31, max_path_bytes: int = 2**62) -> DataFrame:
    """files with pack (from 0 in each group): in path order a pack is sealed when the next file would break a limit;
    a file over a limit still gets a pack of its own.

    The sealing depends on all that went before, so a group is one sorted run; rows stream through a task in batches
    and only the open pack's three sums are kept, however large the group is. Running sums are searched, so the steps are
    one for each pack and not for each file.
    """
    named = files.withColumn("_bytes", argument_bytes(F.col("path")))
    dealt = named.repartition(*groups).sortWithinPartitions(*groups, "path", "length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", pack long"
    columns = files.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pack, total, members, paths = None, 0, 0, 0, 0
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            starts = np.flatnonzero((batch[groups] != batch[groups].shift()).any(axis=1).to_numpy()).tolist() if len(batch) else []
            lengths, sizes = batch["length"].to_numpy(np.int64), batch["_bytes"].to_numpy(np.int64)
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                key = tuple(batch[groups].iloc[start])
                if key != at:
                    at, pack, total, members, paths = key, 0, 0, 0, 0
                # running sums of the run; each round takes as many files as the open pack has room for
                size, names = np.concatenate(([0], np.cumsum(lengths[start:end]))), np.concatenate(([0], np.cumsum(sizes[start:end])))
                i, n = 0, end - start
                while i < n:
                    room = min(int(np.searchsorted(size, size[i] + cap - total, "right")), int(np.searchsorted(names, names[i] + max_path_bytes - paths, "right")), i + max_members - members + 1) - 1
                    take = max(room, i + 1) if members == 0 else max(room, i)
                    out[start + i : start + min(take, n)] = pack
                    take = min(take, n)
                    total, members, paths = total + int(size[take] - size[i]), members + take - i, paths + int(names[take] - names[i])
                    i = take
                    if i < n:
                        pack, total, members, paths = pack + 1, 0, 0, 0
            yield batch[columns].assign(pack=pd.array(out, dtype="int64"))

    return dealt.mapInPandas(fold, schema)


def requeue(changed: DataFrame, threshold: int, max_attempts: int = 5) -> DataFrame:
    """What becomes of files that changed while they were packed, by their new length and the attempts made before:
    changed with attempts one higher, lane and gave_up. Files at or over the threshold, and those that have changed
    max_attempts times, stand alone; the rest keep their lane and go through greedy_packs again, as the next round.
    A null count of attempts is none."""
    n = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    gave_up = n >= max_attempts
    alone = F.coalesce(F.col("length") >= threshold, F.lit(False)) | gave_up
    return changed.select(*[c for c in changed.columns if c not in ("attempts", "lane")], n.alias("attempts"), F.when(alone, SINGLE).otherwise(F.col("lane")).alias("lane"), gave_up.alias("gave_up"))


def number_packs(packed: DataFrame) -> DataFrame:
    """packed with pack_number from 1: directories in order, compressed packs before stored ones, the cross lane
    last. One row a group is put in order, over ranges of groups."""
    group = ["lane", "dir", "store_only"]
    sizes = packed.groupBy(*group).agg((F.max("pack") + 1).alias("packs")).withColumn("last", (F.col("lane") == CROSS).cast("int"))
    before = sum_before(sizes, [], ["last", "dir", "store_only"], "packs").drop("packs", "last")
    return packed.join(before, group).withColumn("pack_number", F.col("before") + F.col("pack") + 1).drop("before")
