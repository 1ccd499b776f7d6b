"""Journals as a stream: records are added as they come, and a batch that runs again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.journal import newest_records
from ..sources.journals import RECORD

STREAMED = f"run_id string, started_at timestamp, line_no bigint, {RECORD}"


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Records from new JSON files below path, each with run_id, started_at and line_no."""
    return spark.readStream.schema(STREAMED).option("maxFilesPerTrigger", files_per_batch).json(path)


def replay(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's newest record of each path to target/batch=N. N is the batch's number, and its folder is
    overwritten, so a batch that is repeated after a failure leaves the same files. Late records are kept, as no
    watermark drops them."""

    def put(batch: DataFrame, number: int) -> None:
        newest_records(batch.where("path is not null")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(spark: SparkSession, target: str) -> DataFrame:
    """One record for each path: the newest of all batches."""
    return newest_records(spark.read.parquet(target).drop("batch"))


def log_levels_by_hour(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of each level by hour of a log stream(ts, level); counts are final once the watermark has passed an hour."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour"), "level").count().select(F.col("hour.start").alias("hour"), "level", "count")
