"""Run journals: JSON lines, the first of which is the header of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scale import staged

HEADER = "run_id string, config_id int, started_at timestamp, baseline_version int, local_root string, encryption_identity string"
RECORD = (
    "kind string, ref string, path string, full_hash string, head_hash string, tail_hash string, length bigint, raw boolean, mtime_utc_ticks bigint, store_only boolean, "
    "members array<struct<path:string,entry_name:string,full_hash:string,length:bigint>>, volumes int, volume_sizes array<bigint>"
)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """(file, header columns, line_no, record columns) of all journals below path.

    Lines that are no record, a half-written last one among them, are left out; a file whose first line is no header
    is void as a whole. Missing fields are null. Files without lines give no rows. Journals are read by lines, a long one
    in many splits: lines are numbered within their split in the order in which the task reads them, and what is put in
    order is one row for each split, with its count and its first line. Blank lines have no number. Numbered lines are
    written to the shared folder once, as a second reading may be split in other places.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    split = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim("value").alias("line")).where("line != ''")
    lines = staged(split.withColumn("at", F.monotonically_increasing_id()), "lines")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min_by("line", "at").alias("head"))
    file = Window.partitionBy("file").orderBy("block")
    before = blocks.select("file", "block", "first", (F.sum("n").over(file) - F.col("n")).alias("before"), F.from_json(F.first("head").over(file), HEADER).alias("h")).where("h.run_id is not null")
    headed = lines.join(before, ["file", "block"]).withColumn("line_no", F.col("before") + F.col("at") - F.col("first")).where("line_no > 0")
    parsed = headed.select("file", "h.*", "line_no", F.from_json("line", RECORD).alias("r"))
    return parsed.where("r.kind in ('blob', 'pack')").select("file", *[c for c in parsed.columns if c not in ("file", "r")], "r.*")
