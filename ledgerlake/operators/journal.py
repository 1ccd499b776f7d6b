"""Run journals: what earlier, interrupted runs have confirmed, and what of it a new run may take over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adoption(journals: DataFrame, config_id: int, baseline_version: int, local_root: str, encryption: str) -> DataFrame:
    """journals with adopted: a header equal in all four parts; any other is void."""
    same = (F.col("config_id") == config_id) & (F.col("baseline_version") == baseline_version) & (F.col("local_root") == local_root) & F.col("encryption_identity").eqNullSafe(F.lit(encryption))
    return journals.withColumn("adopted", F.coalesce(same, F.lit(False)))


def sweep_needed(adopted: DataFrame, first_run: bool) -> DataFrame:
    return adopted.agg((F.coalesce(F.bool_or("adopted"), F.lit(False)) | F.coalesce(F.bool_or(~F.col("adopted")), F.lit(False)) | F.lit(first_run)).alias("sweep"))


def newest_records(records: DataFrame) -> DataFrame:
    """One record a path: of the journal that began last, its first line. An aggregate, so that no path is sorted."""
    order = F.struct(F.col("started_at"), F.col("run_id"), -F.col("line_no"))
    return records.groupBy("path").agg(F.max_by(F.struct(*[F.col(c) for c in records.columns if c != "path"]), order).alias("r")).select("path", "r.*")


def resume_cheap(scan: DataFrame, records: DataFrame) -> DataFrame:
    """Scanned rows that a record confirms by path, time and length; a missing time confirms nothing."""
    mine = records.select("path", F.col("mtime_utc_ticks").alias("mtime_ticks"), "length", F.col("ref").alias("ref"))
    return scan.join(mine, ["path", "mtime_ticks", "length"])


def resume_full(scan: DataFrame, records: DataFrame) -> DataFrame:
    """Scanned rows that a record confirms by path and all four parts of the content's identity."""
    return scan.join(records.select("path", "full_hash", "length", "head_hash", "tail_hash", "ref"), ["path", "full_hash", "length", "head_hash", "tail_hash"])


def resume_packs(planned: DataFrame, recorded: DataFrame) -> DataFrame:
    """(pack, ref) of planned packs with exactly the members, in order, of a recorded one: compared by one digest.
    Both: (pack or ref, path, full_hash, at)."""

    def listed(df: DataFrame, key: str) -> DataFrame:
        members = F.transform(F.sort_array(F.collect_list(F.struct("at", "path", "full_hash"))), lambda m: F.concat(m["path"], F.lit("\t"), F.coalesce(m["full_hash"], F.lit(""))))
        return df.groupBy(key).agg(F.md5(F.array_join(members, "\n")).alias("members"))

    return listed(planned, "pack").join(listed(recorded, "ref"), "members").groupBy("pack").agg(F.min("ref").alias("ref"))


def active_refs(records: DataFrame) -> DataFrame:
    return records.where("kind in ('blob', 'pack')").select("kind", "ref").distinct()


def peek(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id").agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes"))


def first_in_order(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; for keys with few rows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
