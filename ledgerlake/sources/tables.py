"""Sinks: versions that are written once, inserts of what is absent, and keyed upserts, over Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path, or an empty one with the columns of `like` where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0)


def write_version(entries: DataFrame, path: str, version: int) -> int:
    """Writes a version's entries as the partition version=N, reads them back, and returns their number. A version is
    written once: a partition that is there already fails, as does one that reads back with another number of rows. The
    rows are counted while they are written, so that entries are made once."""
    seen = Observation()
    try:
        entries.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{path}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError(f"version {version} is there already") from e
    rows = seen.get["rows"]
    back = entries.sparkSession.read.schema(entries.schema).parquet(f"{path}/version={version}").count()
    if back != rows:
        raise ValueError(f"version {version} reads back with {back} rows instead of {rows}")
    return rows


def replace_if_match(rows: DataFrame, path: str, etag: str | None) -> str:
    """Writes rows as the next state of a small table, kept as path/etag=N, and returns its tag. The state that the rows were
    made from has to be the newest still (None: there is none yet), else it fails and nothing is written; of two writers
    that saw the same state one fails, as both write the same new folder. Earlier states stay until they are deleted."""
    spark = rows.sparkSession
    if current_etag(spark, path) != etag:
        raise ValueError("the table has changed since it was read")
    fresh = str(int(etag or 0) + 1)
    try:
        rows.write.mode("errorifexists").parquet(f"{path}/etag={fresh}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError("the table has changed since it was read") from e
    return fresh


def current_etag(spark: SparkSession, path: str) -> str | None:
    """The tag of the newest state of a table of replace_if_match."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    tags = [int(s.getPath().getName().removeprefix("etag=")) for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("etag=")]
    return str(max(tags)) if tags else None


def append_records(records: DataFrame, path: str, confirmed: DataFrame) -> None:
    """Appends journal records whose object is confirmed(ref) to be stored, as JSON lines."""
    records.join(confirmed.select("ref").distinct(), "ref", "left_semi").select(records.columns).write.mode("append").json(path)


def insert_absent(rows: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key is not in the table; of rows with one key one is taken. Null keys are not inserted."""
    known = _read(rows.sparkSession, path, rows).select(*key)
    fresh = rows.dropna(subset=key).dropDuplicates(key).join(known, key, "left_anti")
    fresh.select(rows.columns).write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key. The result must go to a place of its own."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(new.columns).unionByName(new)
