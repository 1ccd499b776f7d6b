"""References, orphans, retention, dead weight, checks and restore over versions, packs and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_name, object_of, pack_id_of, parent_dir, storage_key, volume_names, within


def reference_set(entries: DataFrame, packs: DataFrame, versions: DataFrame, info_names: list[str]) -> DataFrame:
    """(name) of every object that anything refers to: info files, index volumes, and the volumes of each stored
    content. A pack without a row in packs fails the query, as this set guards what is deleted."""
    stored = entries.where("ref is not null").select("storage_kind", "ref", "volumes").distinct()
    known = packs.select(F.col("pack_id").alias("ref"), F.col("volumes").alias("pack_volumes"), F.lit("pack").alias("storage_kind"))
    joined = stored.join(known, ["storage_kind", "ref"], "left")
    missing = (F.col("storage_kind") == "pack") & F.col("pack_volumes").isNull()
    volumes = F.when(missing, F.raise_error(F.concat(F.lit("no metadata of pack "), F.col("ref"))).cast("int")).when(F.col("storage_kind") == "pack", F.col("pack_volumes")).otherwise(F.coalesce("volumes", F.lit(1)))
    contents = joined.select(F.explode(volume_names(object_of(F.col("storage_kind"), F.col("ref")), volumes)).alias("name"))
    indexes = versions.select(F.explode(volume_names(F.col("index_blob"), F.col("index_volumes"))).alias("name"))
    infos = entries.sparkSession.createDataFrame([(n,) for n in info_names], "name string")
    return contents.union(indexes).union(infos).distinct()


def orphans(objects: DataFrame, references: DataFrame) -> DataFrame:
    return objects.join(references.select("name"), "name", "left_anti")


def sweep(objects: DataFrame, referenced: DataFrame, active: DataFrame) -> DataFrame:
    """Objects whose name without volume number is neither referenced nor in use by a run: both sets of base names
    are one union, so it is one anti-join."""
    keep = referenced.select("base").union(active.select("base")).distinct()
    return objects.withColumn("base", base_name(F.col("name"))).join(keep, "base", "left_anti")


def prune_packs(packs: DataFrame, referenced: DataFrame, active: DataFrame) -> DataFrame:
    return packs.join(referenced.select("pack_id").union(active.select("pack_id")).distinct(), "pack_id", "left_anti")


def cleanup_report(removed: DataFrame) -> DataFrame:
    """One row: packs, blobs and bytes among removed objects(name, base, size)."""
    is_pack = pack_id_of(F.col("name")).isNotNull()
    return removed.agg(F.countDistinct(F.when(is_pack, F.col("base"))).alias("packs"), F.countDistinct(F.when(~is_pack, F.col("base"))).alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed_bytes"))


def retention(versions: DataFrame, now, mode: str, max_versions: int, max_days: int, group: list[str] | None = None) -> DataFrame:
    """versions with retired. mode: VersionOnly, TimeOnly, Either or Both; excess is a rank from the newest over
    max_versions, too old is created strictly before now less max_days; the newest version is never retired."""
    newest = Window.partitionBy(*[F.col(g) for g in group] if group else [F.lit(0)]).orderBy(F.col("version").desc())
    ranked = versions.withColumn("_rank", F.row_number().over(newest))
    excess = F.col("_rank") > max_versions
    old = F.col("created_at") < F.lit(now) - F.expr(f"interval {int(max_days)} days")
    retired = {"VersionOnly": excess, "TimeOnly": old, "Either": excess | old, "Both": excess & old}[mode]
    return ranked.withColumn("retired", retired & (F.col("_rank") > 1)).drop("_rank")


def live_members(entries: DataFrame) -> DataFrame:
    """(pack_id, members, live_bytes): a pack's members in use, by entry name over all versions; the newest version's
    length counts. Members whose digest is unknown are not counted."""
    named = entries.where("storage_kind = 'pack' and full_hash is not null").groupBy("ref", F.coalesce("entry_name", "path").alias("entry")).agg(F.max_by("length", "version").alias("length"))
    return named.groupBy(F.col("ref").alias("pack_id")).agg(F.count(F.lit(1)).alias("members"), F.sum("length").alias("live_bytes"))


def dead_weight(packs: DataFrame, live: DataFrame, threshold: float = 0.30) -> DataFrame:
    """packs with ratio of dead bytes and compact: over the threshold, and something still lives."""
    joined = packs.join(live, "pack_id", "left").withColumn("live_bytes", F.coalesce("live_bytes", F.lit(0)))
    ratio = F.when(F.col("original_bytes") == 0, 0.0).otherwise(F.greatest(F.lit(0), F.col("original_bytes") - F.col("live_bytes")) / F.col("original_bytes"))
    return joined.withColumn("ratio", ratio).withColumn("compact", (F.col("ratio") > threshold) & (F.col("live_bytes") > 0))


def expected_volumes(refs: DataFrame, packs: DataFrame) -> DataFrame:
    """refs(storage_kind, ref, volumes, volume_sizes) with what a check expects; an unknown pack counts as one volume
    without a size."""
    known = packs.select(F.col("pack_id").alias("ref"), F.lit("pack").alias("storage_kind"), F.col("volumes").alias("_v"), F.col("volume_sizes").alias("_s"))
    pack = F.col("storage_kind") == "pack"
    return refs.join(known, ["storage_kind", "ref"], "left").select(
        "storage_kind",
        "ref",
        F.when(pack, F.coalesce("_v", F.lit(1))).otherwise(F.coalesce("volumes", F.lit(1))).alias("volumes"),
        F.when(pack, F.coalesce("_s", F.array().cast("array<bigint>"))).otherwise(F.coalesce("volume_sizes", F.array().cast("array<bigint>"))).alias("volume_sizes"),
    )


def cloud_check(expected: DataFrame, objects: DataFrame) -> DataFrame:
    """(ref, verdict): Missing if a volume is not there, SizeMismatch if one has another size than known, else Ok. The one
    volume of an object may also be stored as its first volume."""
    base = object_of(F.col("storage_kind"), F.col("ref"))
    volumes = expected.select("ref", "volume_sizes", F.col("volumes").alias("n"), F.posexplode(volume_names(base, F.col("volumes"))).alias("at", "name"))
    either = F.when(F.col("n") <= 1, F.array("name", F.concat("name", F.lit(".001")))).otherwise(F.array("name"))
    tried = volumes.select("ref", "at", F.get("volume_sizes", F.col("at")).alias("wanted"), F.posexplode(either).alias("choice", "name")).join(objects.select("name", "size"), "name", "left")
    joined = tried.groupBy("ref", "at").agg(F.first("wanted").alias("wanted"), F.min_by("size", F.when(F.col("size").isNotNull(), F.col("choice"))).alias("size"))
    return joined.groupBy("ref").agg(F.when(F.bool_or(F.col("size").isNull()), "Missing").when(F.bool_or(F.coalesce(F.col("wanted") != F.col("size"), F.lit(False))), "SizeMismatch").otherwise("Ok").alias("verdict"))


def local_check(entries: DataFrame, local: DataFrame, level: str = "Content") -> DataFrame:
    """entries with local: NotChecked at level None, else Missing, Changed or Ok against local(path, kind, length,
    permissions, target, full_hash, unreadable).

    Paths that leave the root, files that cannot be read and links that are none are Missing. Links are compared by their
    target; files at level Attributes by length and permissions, at level Content by their digest.
    """
    if level == "None":
        return entries.withColumn("local", F.lit("NotChecked"))
    mine = local.select("path", F.struct("kind", "length", "permissions", "target", "full_hash", "unreadable").alias("_m"))
    same = {"Attributes": F.col("_m.length").eqNullSafe(F.col("length")) & F.col("_m.permissions").eqNullSafe(F.col("permissions")), "Content": F.col("_m.full_hash").eqNullSafe(F.col("full_hash"))}[level]
    link = F.col("kind") == "symlink"
    verdict = (
        F.when(~within(F.col("path")) | F.col("_m").isNull() | (link & (F.col("_m.kind") != "symlink")), "Missing")
        .when(link, F.when(F.col("_m.target").eqNullSafe(F.col("target")), "Ok").otherwise("Changed"))
        .when(F.coalesce("_m.unreadable", F.lit(False)), "Missing")
        .when(same, "Ok")
        .otherwise("Changed")
    )
    return entries.join(mine, "path", "left").withColumn("local", verdict).drop("_m")


def findings(entries: DataFrame, cloud: DataFrame) -> DataFrame:
    """entries (with local) with cloud and repairable: the stored content is bad and the local one good. Files
    without storage are always well stored."""
    joined = entries.join(cloud.withColumnRenamed("verdict", "_cloud"), "ref", "left").withColumn("cloud", F.coalesce("_cloud", F.lit("Ok"))).drop("_cloud")
    return joined.withColumn("repairable", (F.col("cloud") != "Ok") & (F.col("local") == "Ok"))


def check_report(found: DataFrame) -> DataFrame:
    """One row: ok if every cloud copy is, whatever the local files are; refs whose copy is missing or of a wrong size;
    their files, and those of them that can be repaired."""
    return found.agg(
        F.coalesce(F.bool_and(F.col("cloud") == "Ok"), F.lit(True)).alias("ok"),
        F.countDistinct(F.when(F.col("cloud") != "Ok", F.col("ref"))).alias("missing_refs"),
        F.count_if(F.col("cloud") != "Ok").alias("corrupted"),
        F.count_if("repairable").alias("repairable"),
    )


def restore_estimate(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """One row: files, bytes to write, objects, and bytes to fetch: each stored object counts once."""
    key = storage_key(F.col("storage_kind"), F.col("ref"))
    sizes = packs.select(F.concat(F.lit("pack:"), F.col("pack_id")).alias("key"), F.aggregate("volume_sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("bytes"))
    own = F.aggregate(F.coalesce("volume_sizes", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, b: a + b)
    objects = entries.where("ref is not null").groupBy(key.alias("key")).agg(F.max(own).alias("own")).join(sizes, "key", "left")
    fetched = objects.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(F.coalesce("bytes", "own")), F.lit(0)).alias("download_bytes"))
    return entries.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).crossJoin(fetched)  # one row each


def restore_groups(entries: DataFrame) -> DataFrame:
    """(key, files, bytes, total_known): what is restored from one object; the total is known if all lengths are."""
    key = storage_key(F.col("storage_kind"), F.col("ref"))
    return entries.where("ref is not null").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.bool_and(F.col("length") > 0).alias("total_known"))


def drop_duplicate_paths(entries: DataFrame) -> DataFrame:
    """entries without any row of a path that occurs twice."""
    return entries.join(entries.groupBy("path").count().where("count = 1").select("path"), "path", "left_semi")


def case_collisions(entries: DataFrame) -> DataFrame:
    """(folded, paths): different paths that are equal when case is folded."""
    once = entries.select("path", F.lower("path").alias("folded")).distinct()
    several = once.groupBy("folded").count().where("count > 1").select("folded")
    return once.join(several, "folded").groupBy("folded").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def substitute(entries: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """entries, with columns of paths in other replaced by other's."""
    sub = other.select("path", F.lit(True).alias("_sub"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = entries.join(sub, "path", "left")
    return joined.select(*[F.when(F.col("_sub"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in entries.columns])


def restore_decision(entries: DataFrame, target: DataFrame, mode: str) -> DataFrame:
    """entries with restore: absent targets are; in mode Skip present ones are not; else those of another, or of an
    unknown, content are."""
    there = target.select("path", F.lit(True).alias("_there"), F.col("full_hash").alias("_hash"))
    decided = F.when(F.col("_there").isNull(), True).when(F.lit(mode == "Skip"), False).otherwise(F.coalesce(F.col("_hash") != F.col("full_hash"), F.lit(True)))
    return entries.join(there, "path", "left").withColumn("restore", decided).drop("_there", "_hash")


def repair_sources(bad: DataFrame, entries: DataFrame, local: DataFrame) -> DataFrame:
    """(ref, source): for each bad ref the smallest local path whose content matches one of its entries, or null."""
    uses = entries.join(bad.select("ref").distinct(), "ref", "left_semi").select("ref", "path", "full_hash").distinct()
    good = uses.join(local.select("path", "full_hash"), ["path", "full_hash"], "left_semi").groupBy("ref").agg(F.min("path").alias("source"))
    return bad.select("ref").distinct().join(good, "ref", "left")


def unrecoverable_entries(bad: DataFrame, entries: DataFrame, sources: DataFrame, marked: DataFrame) -> DataFrame:
    """(version, path) to mark as unrecoverable: uses, in any version, of a bad ref that has no source, but for those
    marked(version, path) already. sources(ref, source) as repair_sources gives them."""
    lost = bad.select("ref").distinct().join(sources.where("source is not null").select("ref"), "ref", "left_anti")
    return entries.join(lost, "ref", "left_semi").select("version", "path").distinct().join(marked.select("version", "path"), ["version", "path"], "left_anti")


def direct_children(entries: DataFrame, empty_dirs: DataFrame, directory: str) -> DataFrame:
    """(name, is_dir, has_children, length) of what stands right in a directory of a flat manifest. Where a file and a
    directory have one name, the directory is shown."""
    prefix = f"{directory}/" if directory else ""
    inside = lambda df: df.where(F.startswith("path", F.lit(prefix)) & (F.length("path") > len(prefix))).withColumn("_rest", F.substring("path", len(prefix) + 1, 2**31 - 1))
    files = inside(entries).select(F.split("_rest", "/").alias("p"), F.col("length"), F.lit(False).alias("_empty"))
    empties = inside(empty_dirs).select(F.split("_rest", "/").alias("p"), F.lit(None).cast("long").alias("length"), F.lit(True).alias("_empty"))
    rows = files.unionByName(empties).select(F.col("p")[0].alias("name"), (F.col("_empty") | (F.size("p") > 1)).alias("is_dir"), (F.size("p") > 1).alias("deeper"), "length")
    return rows.groupBy("name").agg(F.bool_or("is_dir").alias("is_dir"), F.bool_or("deeper").alias("has_children"), F.max(F.when(~F.col("is_dir"), F.col("length"))).alias("_l")).select("name", "is_dir", "has_children", F.when(~F.col("is_dir"), F.col("_l")).alias("length"))


def browse(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of a directory's listing: directories first, then by name without regard to case; with total, the number of
    all rows, and truncated, whether any come after the page."""
    page = rows.orderBy(F.col("is_dir").desc(), F.lower("name"), "name").offset(offset).limit(limit)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def nearest_versions(entries: DataFrame, unrecoverable: DataFrame, path: str, version: int) -> DataFrame:
    """(version, distance) of versions from which a path can be had, nearest first."""
    found = entries.where(F.col("path") == path).select("version", "path").distinct().join(unrecoverable, ["version", "path"], "left_anti")
    return found.select("version", F.abs(F.col("version") - version).alias("distance")).orderBy("distance", F.col("version").desc())


def archive_check(entries: DataFrame, members: DataFrame) -> DataFrame:
    """entries of packs with verdict against members(pack_id, name, size, full_hash): Missing, Length, Hash or Ok. An unknown
    digest, on either side, is not compared."""
    inside = members.select(F.col("pack_id").alias("ref"), F.col("name").alias("entry"), F.col("size").alias("_size"), F.col("full_hash").alias("_hash"))
    rows = entries.where("storage_kind = 'pack'").withColumn("entry", F.coalesce("entry_name", "path"))
    return rows.join(inside, ["ref", "entry"], "left").withColumn("verdict", F.when(F.col("_size").isNull(), "Missing").when(F.col("_size") != F.col("length"), "Length").when(F.coalesce(F.col("_hash") != F.col("full_hash"), F.lit(False)), "Hash").otherwise("Ok")).drop("_size", "_hash", "entry")


def directories(entries: DataFrame) -> DataFrame:
    return entries.select(parent_dir(F.col("path")).alias("path")).distinct()
