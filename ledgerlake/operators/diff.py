"""What changed between a scan and an earlier manifest, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ancestors
from .scale import small

ADDED, MODIFIED, METADATA, UNREADABLE, UNCHANGED, DELETED = "Added", "Modified", "MetadataOnly", "Unreadable", "Unchanged", "Deleted"
_SIDE = ("kind", "length", "mtime_ticks", "permissions", "target", "head_hash", "tail_hash", "full_hash")


def comparison(a: str, b: str) -> Column:
    """The rungs for a path that both sides have; a is the scan, b the earlier manifest. First hit wins."""
    same = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    tail_differs = F.col(f"{b}.tail_hash").isNotNull() & F.col(f"{a}.tail_hash").isNotNull() & (F.col(f"{a}.tail_hash") != F.col(f"{b}.tail_hash"))
    return (
        F.when(~same("kind"), MODIFIED)
        .when(F.col(f"{a}.kind") == "symlink", F.when(same("target"), UNCHANGED).otherwise(MODIFIED))
        .when(~same("length"), MODIFIED)
        .when(same("mtime_ticks") & same("permissions"), UNCHANGED)
        .when(~same("head_hash") | tail_differs, MODIFIED)
        .when(same("full_hash"), METADATA)
        .otherwise(MODIFIED)
    )


def under_directories(rows: DataFrame, dirs: DataFrame, path: str = "path") -> DataFrame:
    """(path, directory) of rows that are below one of dirs(path); the root is "" or ".". Each path is joined by its
    ancestors, so the join is an equality whatever the number of directories; nearest directory first wins. A short list
    of directories is broadcast; the root, which all paths are below, is no key of the join."""
    every = rows.select(path).distinct()
    wanted = dirs.select(F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("directory")).distinct()
    exploded = every.withColumn("directory", F.explode(ancestors(F.col(path))))
    found = exploded.join(small(wanted.where("directory <> ''")), "directory").groupBy(path).agg(F.max_by("directory", F.length("directory")).alias("directory"))
    root = wanted.where("directory = ''").agg(F.count(F.lit(1)).alias("_root"))  # one row
    placed = every.join(found, path, "left").crossJoin(F.broadcast(root))
    return placed.where("directory is not null or _root > 0").select(path, F.coalesce("directory", F.lit("")).alias("directory"))


def manifest_diff(scan: DataFrame, previous: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(path, change, length, prev_length): one full outer join on path, then the rungs of `comparison`.

    unreadable(path, is_directory): earlier rows under such a directory, and such files themselves, are Unreadable,
    not Deleted, unless they were scanned; an unreadable file is a row even without an earlier one.
    """
    joined = scan.alias("s").join(previous.alias("p"), "path", "full_outer")
    here, there = F.col("s.kind").isNotNull(), F.col("p.kind").isNotNull()
    change = F.when(here & ~there, ADDED).when(~here & there, DELETED).otherwise(comparison("s", "p"))
    out = joined.select("path", change.alias("change"), F.col("s.length").alias("length"), F.col("p.length").alias("prev_length"))
    if unreadable is None:
        return out
    files = unreadable.where("not is_directory").select("path").distinct().withColumn("_file", F.lit(True))
    below = under_directories(previous.join(scan, "path", "left_anti"), unreadable.where("is_directory")).select("path").withColumn("_below", F.lit(True))
    marked = out.join(files, "path", "full_outer").join(below, "path", "left")
    kept = (F.col("change") == DELETED) & (F.col("_file").isNotNull() | F.col("_below").isNotNull())
    return marked.select("path", F.when(kept | F.col("change").isNull(), UNREADABLE).otherwise(F.col("change")).alias("change"), "length", "prev_length")


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: rows of each kind, bytes changed (Added and Modified) and deleted, in one pass."""
    count = lambda k: F.count_if(F.col("change") == k)
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    changed = F.col("change").isin(ADDED, MODIFIED)
    return changes.agg(
        *[count(k).alias(k.lower()) for k in (ADDED, MODIFIED, METADATA, UNREADABLE, UNCHANGED, DELETED)],
        F.count_if(changed).alias("changed_files"),
        total(changed, "length").alias("changed_bytes"),
        total(F.col("change") == DELETED, "prev_length").alias("deleted_bytes"),
    )


def version_stats(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """(version, files, bytes, changed_files, changed_bytes): what a version has, and what of it was Added or Modified, from
    changes(version, change, length)."""
    stats = entries.groupBy("version").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    changed = changes.where(F.col("change").isin(ADDED, MODIFIED)).groupBy("version").agg(F.count(F.lit(1)).alias("changed_files"), F.sum("length").alias("changed_bytes"))
    zero = F.lit(0).cast("long")
    return stats.join(changed, "version", "left").select("version", "files", "bytes", F.coalesce("changed_files", zero).alias("changed_files"), F.coalesce("changed_bytes", zero).alias("changed_bytes"))


def unreadable_summary(changes: DataFrame, unreadable: DataFrame) -> DataFrame:
    """(path, affected): rows that each unreadable directory holds back, then unreadable files outside of these."""
    lost = changes.where(F.col("change") == UNREADABLE)
    placed = under_directories(lost, unreadable.where("is_directory"))
    dirs = placed.groupBy(F.col("directory").alias("path")).agg(F.count(F.lit(1)).alias("affected"))
    return dirs.unionByName(lost.join(placed, "path", "left_anti").select("path", F.lit(1).cast("long").alias("affected")))


def build_entries(scan: DataFrame, changes: DataFrame, previous: DataFrame, storage: DataFrame, now_ticks: int) -> DataFrame:
    """The next manifest: Deleted rows go; Unreadable ones are the earlier row with its first unreadable time, and go
    without one; the others are scanned rows with storage new, else carried, and none for empty files."""
    prev = previous.select("path", *[F.col(c).alias(f"p_{c}") for c in (*_SIDE, "ref", "unreadable_at")])
    rows = changes.select("path", "change").where(F.col("change") != DELETED).join(scan, "path", "left").join(prev, "path", "left").join(storage.select("path", F.col("ref").alias("new_ref")), "path", "left")
    lost = F.col("change") == UNREADABLE
    pick = lambda c: F.when(lost, F.col(f"p_{c}")).otherwise(F.coalesce(F.col(c), F.col(f"p_{c}")) if c == "tail_hash" else F.col(c)).alias(c)
    ref = F.when(lost, F.col("p_ref")).when((F.col("kind") != "file") | (F.col("length") == 0), F.lit(None)).otherwise(F.coalesce("new_ref", F.when(F.col("change").isin(UNCHANGED, METADATA), F.col("p_ref"))))
    return rows.where(~lost | F.col("p_kind").isNotNull()).select("path", "change", *[pick(c) for c in _SIDE], ref.alias("ref"), F.when(lost, F.coalesce("p_unreadable_at", F.lit(now_ticks))).cast("long").alias("unreadable_at"))


def empty_directories(all_dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """Directories, not the root, without anything kept below."""
    used = entries.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return all_dirs.where("path <> ''").join(used, "path", "left_anti").select("path").distinct()


def version_drift(mine: DataFrame, theirs: DataFrame, columns: list[str]) -> DataFrame:
    """(position, same): two version lists compared by position in version order; a missing position is not the same."""
    from pyspark.sql import Window

    def numbered(df: DataFrame) -> DataFrame:
        return df.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("version")) - 1).cast("long").alias("position"), F.struct(*columns).alias("row"))

    a, b = numbered(mine), numbered(theirs)
    return a.alias("a").join(b.alias("b"), "position", "full_outer").select("position", F.col("a.row").eqNullSafe(F.col("b.row")).alias("same"))
