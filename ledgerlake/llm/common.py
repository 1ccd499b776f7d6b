"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: whole texts of some KB each, so that a batch has a few MB in the JVM and in Python.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS, unless smaller ones are set already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local master, whose
    executors are the driver, gets a new one; a cluster has no such folder, so there it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later jobs start from these files, so that lost
    executors cost no recomputation beyond them."""
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text):
    """Column: A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def columns_free_of(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns (in any case of letters) that would clash with what an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value made once, however often `then` uses it; the result is copied once."""
    return F.transform(F.array(value), then)[0]


#: Values of a block of `running`.
BLOCK = 256


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each of an array's ints, op over all of them before it; 0 for the first.

    A fold copies what it has gathered in each step, so a list of all results would take quadratic time. Here blocks of
    values are folded to one number, these numbers are run through, and then each block from its own start.
    """
    none = F.array().cast("array<int>")

    def through(items: Column, first: Column) -> Column:
        zero = F.struct(first.cast("int").alias("at"), none.alias("out"))
        return F.aggregate(items, zero, lambda acc, x: F.struct(op(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def over(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

        def placed(bs: Column) -> Column:
            starts = through(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda x, y: op(x, y).cast("int"))), F.lit(0))
            return F.flatten(F.transform(F.arrays_zip(bs.alias("b"), starts.alias("s")), lambda z: through(z["b"], z["s"])))

        return F.when(F.size(v) == 0, none).otherwise(let(blocks, placed))

    return let(values, over)
