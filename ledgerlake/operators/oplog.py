"""The operation log: queries, retention, and what belongs to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import join_pairs


def query_log(log: DataFrame, min_level: int | None = None, source: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; each filter is left out where None, a blank source too; at most min(max(limit or 200, 1), 1000)."""
    if min_level is not None:
        log = log.where(F.col("level") >= min_level)
    if source and source.strip():
        log = log.where(F.col("source") == source)
    if since is not None:
        log = log.where(F.col("ts") >= F.lit(since).cast(log.schema["ts"].dataType))
    if until is not None:
        log = log.where(F.col("ts") <= F.lit(until).cast(log.schema["ts"].dataType))
    return log.orderBy(F.col("id").desc()).limit(min(max(200 if limit is None else limit, 1), 1000))


def trim_log(log: DataFrame, before: str) -> DataFrame:
    """What stays: durable rows, and ephemeral ones not older than before."""
    return log.where(~(F.col("ephemeral") & (F.col("ts") < F.lit(before).cast(log.schema["ts"].dataType))))


def delete_for(log: DataFrame, suffix: str) -> DataFrame:
    """What stays when the rows of sources that end in :suffix go."""
    return log.where(~F.endswith("source", F.lit(f":{suffix}")))


def members_of(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, name, members): each group with its members by name, folded first; groups without any have []."""
    listed = members.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.lower("member").alias("f"), F.col("member").alias("m")))), lambda x: x["m"]).alias("members"))
    return groups.join(listed, "group_id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>")))


def resolve_targets(tasks: DataFrame, members: DataFrame) -> DataFrame:
    """(task_id, target): a task's own target, or each member of its group. That is all pairs of tasks and members of a
    group, so large groups are dealt over many tasks of Spark."""
    own, asked = tasks.where("target is not null").select("task_id", "target"), tasks.where("target is null").select("task_id", "group_id")
    return own.unionByName(join_pairs(asked, members, ["group_id"]).select("task_id", F.col("member").alias("target")))


def occupancy(containers: DataFrame, configs: DataFrame) -> DataFrame:
    """containers with the first config, by id, that uses each."""
    first = configs.groupBy("container").agg(F.min("config_id").alias("config_id"))
    return containers.join(first, "container", "left")


def auto_resume(journals: DataFrame) -> DataFrame:
    """Configs of which every journal was left by a shutdown."""
    return journals.groupBy("config_id").agg(F.bool_and(F.coalesce(F.col("shutting_down"), F.lit(False))).alias("all_down")).where("all_down").select("config_id")


def events_matching(configs: DataFrame, event: int) -> DataFrame:
    """Configs whose mask has the event's bit."""
    return configs.where(F.col("events").bitwiseAND(event) != 0)


def last_events(events: DataFrame, key: str, n: int) -> DataFrame:
    """The last n events of each key. The window is limited by rank, so Spark keeps n rows of a key in a task before
    the shuffle already."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where(F.col("_n") <= n).drop("_n")


def inherited(configs: DataFrame, defaults: DataFrame, columns: list[str]) -> DataFrame:
    """configs with missing settings from the one row of defaults; an empty string is a setting."""
    named = defaults.select(*[F.col(c).alias(f"_{c}") for c in columns]).limit(1)
    joined = configs.join(F.broadcast(named), F.lit(True), "left")  # one row
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in configs.columns])
