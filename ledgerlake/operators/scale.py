"""Ways to number rows and to join on keys that a large part of all rows may share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key of so many rows is hot: its rows are dealt over COPIES tasks. Hot keys are at most rows / HOT_ROWS, and broadcast.
HOT_ROWS, COPIES = 1_000_000, 64
#: Rows of each side that meet in one cell of join_pairs, the part of them that equal rows may fill as one run, and the most
#: partitions over which cells are dealt.
SIDE_ROWS, RUNS, MOST_CELLS = 2_000, 16, 4_000
#: Lists of rules or directories up to this many rows are broadcast.
BROADCAST_ROWS = 20_000


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that driver and executors share (spark.checkpoint.dir). Where that is unset, a local
    master gets a new one; a cluster has none, so there it is an error."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sum_before(df: DataFrame, groups: list[str], order: list[str | Column], value: str | None = None, out: str = "before") -> DataFrame:
    """df with out: the sum of value (without it, the number) of the rows of its group that come before a row. Rows are dealt
    over ranges of groups and order, so a group is not one task's; what is summed in order are one row for each range and
    group. Rows alike in order take their places in any order."""
    ordered = staged(df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ranged = ordered.withColumn("_part", F.shiftright("_at", 33))
    own = F.sum(value) if value else F.count(F.lit(1))
    ranges = ranged.groupBy("_part", *groups).agg(own.alias("_own"), F.min("_at").alias("_first"))
    within = Window.partitionBy(*groups).orderBy("_part") if groups else Window.orderBy("_part")
    before = ranges.select("_part", *groups, "_first", (F.sum("_own").over(within) - F.col("_own")).alias("_before"))
    named = before.select(F.col("_part").alias("_in"), *[F.col(g).alias(f"_in_{g}") for g in groups], "_first", "_before")
    same = F.col("_part") == F.col("_in")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_in_{g}"))
    joined = ranged.join(F.broadcast(named), same)  # one row for each range and group
    if value:
        inside = F.sum(value).over(Window.partitionBy("_part", *groups).orderBy("_at")) - F.col(value)
    else:
        inside = F.col("_at") - F.col("_first")
    return joined.withColumn(out, (F.col("_before") + inside).cast("long")).select(*df.columns, out)


def join_each(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: str, hot_rows: int = HOT_ROWS, copies: int = COPIES) -> DataFrame:
    """rows LEFT JOIN per_key USING keys, where per_key has one row for each key. Rows of hot keys are dealt over copies by a hash
    of the column spread, and their key's row is copied as often; so are rows with a null in a key, which match nothing."""
    hot = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows).select(*keys, F.lit(True).alias("_hot"))
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    deal = F.pmod(F.xxhash64(spread), F.lit(copies)).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_copy", F.when(nulls | F.col("_hot"), deal).otherwise(0)).drop("_hot")
    each = per_key.join(F.broadcast(hot), keys, "left").withColumn("_copy", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(each, [*keys, "_copy"], "left").drop("_copy")


def join_pairs(left: DataFrame, right: DataFrame, keys: list[str], side: int = SIDE_ROWS) -> DataFrame:
    """left JOIN right USING keys, where many rows of both may share a key, so that the result is far longer than either. A
    key of more than side * side pairs is hot: its rows are dealt, by a hash of the whole row, into pieces of about side
    rows, and each piece of one side meets each of the other in a cell of its own. Equal rows, which such a hash can't part,
    are counted and dealt in runs, each one row until it is in its cell. Rows are copied once for each piece of the other
    side; a pair meets in one cell. Hot keys are few, as each has many rows, and broadcast."""
    left, right = left.dropna(subset=keys), right.dropna(subset=keys)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys)
    pieces = [F.ceil(F.col(c) / side).cast("int").alias(out) for c, out in (("_l", "_ls"), ("_r", "_rs"))]
    hot = counts.where(F.col("_l") * F.col("_r") > side * side).select(*keys, *pieces)
    cells = hot.agg(F.sum(F.col("_ls").cast("long") * F.col("_rs"))).first()[0]
    if not cells:
        return left.join(right, keys)

    # twice the cells, as some fall into one partition
    cell, n, run = [*keys, "_ls_at", "_rs_at"], min(2 * cells, MOST_CELLS), max(side // RUNS, 1)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        alike = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(hot), keys, "left")
        runs = alike.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(run).cast("long"))))
        piece = F.pmod(F.xxhash64(*df.columns, "_from"), F.coalesce(own, F.lit(1))).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        length = F.least(F.col("_n") - F.col("_from"), F.lit(run)).cast("int")
        cells_of = runs.select(*df.columns, length.alias("_n"), piece.alias(f"{own}_at"), met.alias(f"{other}_at")).repartition(n, *cell)
        return cells_of.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")

    return dealt(left, "_ls", "_rs").join(dealt(right, "_rs", "_ls"), cell).drop("_ls_at", "_rs_at")


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has BROADCAST_ROWS rows at most, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
