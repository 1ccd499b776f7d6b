"""Content identity across versions and within a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_key, data_address
from .scale import join_each

_KEY = ["full_hash", "length", "head_hash", "tail_hash"]


def known_blobs(probes: DataFrame, prior: DataFrame) -> DataFrame:
    """probes with ref and volumes of the content's own object, if an earlier version has all four parts of its
    identity; the newest version wins. prior(version, full_hash, length, head_hash, tail_hash, ref, volumes)."""
    newest = prior.groupBy(*_KEY).agg(F.max_by(F.struct("ref", "volumes"), "version").alias("found"))
    return join_each(probes, newest, _KEY, "path").withColumn("ref", F.col("found.ref")).withColumn("volumes", F.col("found.volumes")).drop("found")


def known_members(probes: DataFrame, prior: DataFrame) -> DataFrame:
    """probes with pack_id and entry_name of a pack's member with the same content; the oldest version wins. Tails
    must be equal, where two missing ones are."""
    oldest = prior.groupBy(*_KEY).agg(F.min_by(F.struct("pack_id", "entry_name"), "version").alias("found"))
    # a missing tail is a value of its own here
    tail = lambda df: df.withColumn("_tail", F.coalesce(F.concat(F.lit("="), F.col("tail_hash")), F.lit("")))
    joined = join_each(tail(probes), tail(oldest).drop("tail_hash"), ["full_hash", "length", "head_hash", "_tail"], "path")
    return joined.select(*probes.columns, F.col("found.pack_id").alias("pack_id"), F.col("found.entry_name").alias("entry_name"))


def prescreen(probes: DataFrame, prior: DataFrame) -> DataFrame:
    """Probes for which a whole digest is worth reading: an earlier content has their length and head."""
    return probes.join(prior.select("length", "head_hash").distinct(), ["length", "head_hash"], "left_semi")


def aliases(rows: DataFrame) -> DataFrame:
    """rows with leader: the first path of the same content, by path; null where a part of the identity is missing.
    A content is one row before it is joined, and the rows of one that very many paths have are dealt over several tasks."""
    whole = F.col("full_hash").isNotNull() & F.col("head_hash").isNotNull() & F.col("tail_hash").isNotNull() & F.col("length").isNotNull()
    first = rows.where(whole).groupBy(*_KEY).agg(F.min("path").alias("leader"))
    return join_each(rows, first, _KEY, "path")


def backfill_aliases(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, leader, ref, orphan) of aliases: the leader's storage if it is in a pack and stands, else an orphan to be
    run again. rows(path, leader), stored(path, kind, ref, overridden, unreadable)."""
    lead = stored.select(F.col("path").alias("leader"), F.when((F.col("kind") == "pack") & ~F.col("overridden") & ~F.col("unreadable"), F.col("ref")).alias("ref"))
    return rows.where("path <> leader").select("path", "leader").join(lead, "leader", "left").withColumn("orphan", F.col("ref").isNull())


def addresses(rows: DataFrame) -> DataFrame:
    """(path, address): the content's address, with ~1, ~2... for the second, third... content that has it."""
    base = rows.withColumn("base", data_address(F.col("full_hash"))).withColumn("content", content_key(*(F.col(c) for c in ("full_hash", "length", "head_hash", "tail_hash"))))
    firsts = base.groupBy("base", "content").agg(F.min("path").alias("first_path"))
    # contents of one address differ though their digest is the same: a handful
    numbered = firsts.withColumn("number", F.row_number().over(Window.partitionBy("base").orderBy("first_path")) - 1)
    address = F.when(F.col("number") == 0, F.col("base")).otherwise(F.concat("base", F.lit("~"), F.col("number").cast("string")))
    return base.join(numbered, ["base", "content"]).select("path", address.alias("address"))
