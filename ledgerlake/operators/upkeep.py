"""Discovery, repair and retirement: what a store holds, which entries a repair touches, and what goes with a version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import storage_key, volume_names
from .diff import under_directories


def list_objects(objects: DataFrame, prefix: str | None = None) -> DataFrame:
    return objects if not prefix else objects.where(F.startswith("name", F.lit(prefix)))


def presence(plain: Column, encrypted: Column) -> Column:
    """What kind of index a container has; with both, the plain one counts."""
    return F.when(plain, "Plain").when(encrypted, "Encrypted").otherwise("None")


def discover(containers: DataFrame, objects: DataFrame, plain_name: str, encrypted_name: str) -> DataFrame:
    """containers(container) with presence, from objects(container, name): only the two names are looked at, and a
    container is one row before the join."""
    found = objects.where(F.col("name").isin(plain_name, encrypted_name)).groupBy("container").agg(F.bool_or(F.col("name") == plain_name).alias("_plain"), F.bool_or(F.col("name") == encrypted_name).alias("_enc"))
    joined = containers.join(found, "container", "left")
    return joined.withColumn("presence", presence(F.coalesce("_plain", F.lit(False)), F.coalesce("_enc", F.lit(False)))).drop("_plain", "_enc")


def is_transient(kind: Column, status: Column, cancelled: Column) -> Column:
    """Whether an error is worth another attempt. kind: request (by its HTTP status; 0 is no answer), io, socket, timeout,
    canceled (unless the run itself was), moved; any other is not."""
    request = (status == 0) | (status >= 500) | status.isin(408, 429)
    return F.coalesce(F.when(kind == "request", request).when(kind.isin("io", "socket", "timeout", "moved"), True).when(kind == "canceled", ~cancelled), F.lit(False))


def unresolved_paths(unrecoverable: DataFrame, resolved: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Unrecoverable paths without a substitute, of the selected ones where there is a selection."""
    left = unrecoverable.select("path").distinct().join(resolved.select("path"), "path", "left_anti")
    return left if selected is None else left.join(selected.select("path"), "path", "left_semi")


def carry_empty_dirs(scanned: DataFrame, previous: DataFrame, unreadable_dirs: DataFrame) -> DataFrame:
    """(path) of the scan's empty directories and, of the earlier version's, those below a directory that the scan could
    not read."""
    kept = under_directories(previous.select("path"), unreadable_dirs).select("path")
    return scanned.select("path").union(kept).distinct()


def override_values(entries: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """entries, with the values of columns that were found while their files were stored, where they are known: a null in
    overrides leaves the entry's own."""
    late = overrides.select("path", F.struct(*columns).alias("_late"))
    joined = entries.join(late, "path", "left")
    return joined.select(*[F.coalesce(F.col(f"_late.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in entries.columns])


def metadata_source(entries: DataFrame) -> DataFrame:
    """(ref, path, version) of the entry whose values describe a stored object: the first, by version and path, that has
    both edge digests, else the first."""
    lacks = (F.col("head_hash").isNull() | F.col("tail_hash").isNull()).cast("int")
    return entries.where("ref is not null").groupBy("ref").agg(F.min(F.struct(lacks.alias("lacks"), "version", "path")).alias("m")).select("ref", "m.path", "m.version")


def rewrite_volumes(entries: DataFrame, replaced: DataFrame) -> DataFrame:
    """entries of all versions, with volumes and volume_sizes of refs in replaced(ref, volumes, volume_sizes) in place of
    their own, and changed."""
    fresh = replaced.select("ref", F.struct("volumes", "volume_sizes").alias("_new"))
    joined = entries.join(fresh, "ref", "left")
    new = F.col("_new").isNotNull()
    columns = [F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in ("volumes", "volume_sizes") else F.col(c) for c in entries.columns]
    return joined.select(*columns, new.alias("changed"))


def members_across_versions(entries: DataFrame) -> DataFrame:
    """(ref, entry_name, full_hash, uses) of every member of a pack that has a name of its own: the digest of its first use,
    by version and path, and all (version, path) that use it."""
    named = entries.where("storage_kind = 'pack' and entry_name is not null")
    use = F.struct("version", "path")
    return named.groupBy("ref", "entry_name").agg(F.min_by("full_hash", use).alias("full_hash"), F.sort_array(F.collect_list(use)).alias("uses"))


def twin_entries(entries: DataFrame, members: DataFrame) -> DataFrame:
    """entries whose member's name another member of their pack has but for case, so that a file system that folds case
    cannot keep both. members(pack_id, name, is_directory)."""
    twins = members.where("not is_directory").groupBy(F.col("pack_id").alias("ref"), F.lower("name").alias("_folded")).count().where("count > 1").select("ref", "_folded")
    named = entries.where("storage_kind = 'pack'").withColumn("_folded", F.lower(F.replace(F.coalesce("entry_name", "path"), F.lit("\\"), F.lit("/"))))
    return named.join(twins, ["ref", "_folded"], "left_semi").drop("_folded")


def retired_index_volumes(versions: DataFrame, retired: DataFrame) -> DataFrame:
    """(version, name) of every volume of the indexes of retired versions."""
    gone = versions.join(retired.select("version").distinct(), "version", "left_semi")
    return gone.select("version", F.explode(volume_names(F.col("index_blob"), F.col("index_volumes"))).alias("name"))


def to_rehydrate(volumes: DataFrame) -> DataFrame:
    """Volumes that are archived and not on their way back yet."""
    return volumes.where((F.col("tier") == "Archive") & (F.coalesce("archive_status", F.lit("")) == ""))


def volumes_by_key(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """(key, volumes): of a pack as packs says, or 1 where it is unknown; of a blob as its first entry, by path, says."""
    first = entries.where("ref is not null").groupBy("storage_kind", "ref").agg(F.min_by("volumes", "path").alias("_own"))
    known = packs.select(F.lit("pack").alias("storage_kind"), F.col("pack_id").alias("ref"), F.col("volumes").alias("_pack"))
    volumes = F.when(F.col("storage_kind") == "pack", F.coalesce("_pack", F.lit(1))).otherwise(F.col("_own"))
    return first.join(known, ["storage_kind", "ref"], "left").select(storage_key(F.col("storage_kind"), F.col("ref")).alias("key"), volumes.alias("volumes"))


def unreadable_entries(entries: DataFrame) -> DataFrame:
    return entries.where("unreadable_at is not null").select("path", "unreadable_at")


def backup_names(configs: DataFrame) -> DataFrame:
    """(account_id, names): each account's backups by name, whatever the case."""
    listed = F.sort_array(F.collect_list(F.struct(F.lower("name").alias("f"), F.col("name").alias("n"))))
    return configs.groupBy("account_id").agg(F.transform(listed, lambda x: x["n"]).alias("names"))


def restore_totals(parts: DataFrame) -> DataFrame:
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("restored", "skipped", "failed")])


def all_readable(*secrets: DataFrame) -> DataFrame:
    """One row: whether every secret that is there can be read, over tables of (secret, readable); empty ones are none."""
    rows = secrets[0].select("secret", "readable")
    for more in secrets[1:]:
        rows = rows.union(more.select("secret", "readable"))
    return rows.where("secret is not null and secret <> ''").agg(F.coalesce(F.bool_and("readable"), F.lit(True)).alias("all_readable"))


def newest_first(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.col("version").desc())


def latest(versions: DataFrame, position: str = "position") -> DataFrame:
    """The version that is last in the list, which need not be the largest."""
    return versions.orderBy(F.col(position).desc()).limit(1)


def union_of_missing(*missing: DataFrame) -> DataFrame:
    rows = missing[0].select("path")
    for more in missing[1:]:
        rows = rows.union(more.select("path"))
    return rows.distinct()


def leftover_volumes(stored: DataFrame, replaced: DataFrame) -> DataFrame:
    """stored(name, base) volumes of families that were written anew, replaced(base, volumes), which the new family lacks."""
    kept = replaced.select(F.explode(volume_names(F.col("base"), F.col("volumes"))).alias("name"))
    return stored.join(replaced.select("base"), "base", "left_semi").join(kept, "name", "left_anti")


def safe_names(conflicts: DataFrame, existing: DataFrame, stamp: str) -> DataFrame:
    """(path, renamed): path.bak-stamp, or the first of path.bak-stamp-1, -2... that no existing(path) has. The taken numbers
    are gathered for each conflict alone, of names that begin as its own."""
    wanted = conflicts.select("path", F.concat("path", F.lit(f".bak-{stamp}")).alias("_base"))
    taken = existing.select(F.regexp_replace("path", r"(\.bak-[0-9]{8}-[0-9]{6})-[1-9][0-9]{0,8}\z", "$1").alias("_base"), F.coalesce(F.regexp_extract("path", r"\.bak-[0-9]{8}-[0-9]{6}-([1-9][0-9]{0,8})\z", 1).try_cast("int"), F.lit(0)).alias("_n"))
    numbers = taken.join(wanted.select("_base"), "_base", "left_semi").groupBy("_base").agg(F.collect_set("_n").alias("_taken"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("_taken")), F.col("_taken")))
    n = F.coalesce(F.when(F.col("_taken").isNotNull(), free), F.lit(0))
    return wanted.join(numbers, "_base", "left").select("path", F.when(n == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n.cast("string"))).alias("renamed"))
