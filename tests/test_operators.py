"""Small cases with known answers, and the edges: nulls, ties, limits, empty tables."""

import datetime

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlake.functions import scalars as fn
from ledgerlake.operators import dedup, diff, journal, metrics, oplog, packs, rules, storage
from ledgerlake.plans import registry

_SIDE = "path string, kind string, length long, mtime_ticks long, permissions string, target string, head_hash string, tail_hash string, full_hash string"


def _file(path, length=1, mtime=0, mode="0644", head="h", tail="t", full="f"):
    return (path, "file", length, mtime, mode, None, head, tail, full)


def test_diff_takes_the_first_rung_that_holds(spark):
    now = [
        _file("new"), _file("same", full=None), _file("touched", mtime=1), _file("longer", length=2), _file("head", mtime=1, head="x"), _file("tail", mtime=1, tail="x"),
        _file("middle", mtime=1, full="x"), _file("kind"), ("link", "symlink", 0, 9, "0777", "a", None, None, None), ("relink", "symlink", 0, 0, "0777", "b", None, None, None), _file("mode", mode="0600"),
    ]
    before = [_file(p) for p in ("same", "touched", "longer", "head", "tail", "middle", "mode", "gone", "dir/kept", "dir/seen", "lost")]
    before += [("kind", "symlink", 1, 0, "0644", "q", None, None, None), ("link", "symlink", 0, 0, "0644", "a", None, None, None), ("relink", "symlink", 0, 0, "0777", "a", None, None, None)]
    unreadable = spark.createDataFrame([("dir", True), ("lost", False), ("never", False)], "path string, is_directory boolean")
    changes = diff.manifest_diff(spark.createDataFrame([*now, _file("dir/seen")], _SIDE), spark.createDataFrame(before, _SIDE), unreadable)
    assert {r.path: r.change for r in changes.collect()} == {
        "new": "Added", "same": "Unchanged", "touched": "MetadataOnly", "longer": "Modified", "head": "Modified", "tail": "Modified", "middle": "Modified", "kind": "Modified",
        "link": "Unchanged", "relink": "Modified", "mode": "MetadataOnly", "gone": "Deleted", "dir/kept": "Unreadable", "dir/seen": "Unchanged", "lost": "Unreadable", "never": "Unreadable",
    }
    assert diff.change_summary(changes).first().changed_files == 7


def test_diff_of_empty_manifests(spark):
    none = spark.createDataFrame([], _SIDE)
    assert diff.manifest_diff(none, none).collect() == []
    assert diff.change_summary(diff.manifest_diff(none, none)).first().changed_bytes == 0


def test_dedup_ties_and_missing_parts(spark):
    probes = spark.createDataFrame([("a", "f", 1, "h", "t"), ("b", "f", 1, "h", None), ("c", "f", 2, "h", "t")], "path string, full_hash string, length long, head_hash string, tail_hash string")
    blobs = spark.createDataFrame([(1, "f", 1, "h", "t", "old", 1), (2, "f", 1, "h", "t", "new", 3)], "version int, full_hash string, length long, head_hash string, tail_hash string, ref string, volumes int")
    assert {r.path: r.ref for r in dedup.known_blobs(probes, blobs).collect()} == {"a": "new", "b": None, "c": None}
    members = spark.createDataFrame([(2, "f", 1, "h", None, "pNEW", "y"), (1, "f", 1, "h", None, "pOLD", "x")], "version int, full_hash string, length long, head_hash string, tail_hash string, pack_id string, entry_name string")
    assert {r.path: r.pack_id for r in dedup.known_members(probes, members).collect()} == {"a": None, "b": "pOLD", "c": None}
    assert {r.path: r.leader for r in dedup.aliases(probes.union(probes.where("path = 'a'").withColumn("path", F.lit("0")))).collect()} == {"0": "0", "a": "0", "b": None, "c": "c"}


@pytest.mark.parametrize(
    "sizes,limits,want",
    [
        ([40, 40, 40], dict(cap=100), [0, 0, 1]),
        ([100, 200], dict(cap=1000), [0, 0]),
        ([500, 1, 1], dict(cap=100), [0, 1, 1]),
        ([1, 1, 1], dict(cap=100, max_members=2), [0, 0, 1]),
        ([1, 1, 1], dict(cap=100, max_path_bytes=9), [0, 0, 1]),
    ],
)
def test_packs_are_sealed_at_each_limit(spark, sizes, limits, want):
    files = spark.createDataFrame([(f"{i}é", n, "d") for i, n in enumerate(sizes)], "path string, length long, dir string")
    got = packs.greedy_packs(files, ["dir"], **limits).orderBy("path").collect()
    assert [r.pack for r in got] == want


def test_changed_members_are_packed_again_until_they_stand_alone(spark):
    rows = [("a", 10, None), ("b", 10, 3), ("c", 10, 4), ("d", 100, 0), ("e", None, 1)]
    changed = spark.createDataFrame(rows, "path string, length long, attempts int").withColumn("lane", F.lit("directory"))
    got = {r.path: (r.attempts, r.lane, r.gave_up) for r in packs.requeue(changed, 100).collect()}
    assert got == {"a": (1, "directory", False), "b": (4, "directory", False), "c": (5, "single", True), "d": (1, "single", False), "e": (2, "directory", False)}
    assert packs.requeue(changed.limit(0), 100).collect() == []


@pytest.mark.parametrize("mode,keep,days,ages,want", [("VersionOnly", 3, 0, [50, 40, 30, 20, 10], [1, 2]), ("TimeOnly", 0, 180, [365, 45, 5], [1]), ("Either", 2, 180, [900, 400, 5], [1, 2]), ("Both", 2, 180, [900, 400, 5], [1]), ("VersionOnly", 0, 0, [9], [])])
def test_retention(spark, mode, keep, days, ages, want):
    now = datetime.datetime(2026, 7, 16)
    rows = spark.createDataFrame([(i + 1, now - datetime.timedelta(days=a)) for i, a in enumerate(ages)], "version int, created_at timestamp_ntz")
    assert [r.version for r in storage.retention(rows, now, mode, keep, days).where("retired").orderBy("version").collect()] == want


_PACKS = "pack_id string, volumes int, volume_sizes array<bigint>"


def test_restore_estimate_counts_each_object_once(spark):
    entries = spark.createDataFrame([("a", 100, "pack", "1", None), ("b", 80, "pack", "1", None), ("c", 30, "blob", "data/h", [30]), ("d", 30, "blob", "data/h", [30])], "path string, length long, storage_kind string, ref string, volume_sizes array<bigint>")
    r = storage.restore_estimate(entries, spark.createDataFrame([("1", 3, [100, 100, 50])], _PACKS)).first()
    assert (r.files, r.bytes, r.objects, r.download_bytes) == (4, 240, 2, 280)


def test_reference_set_needs_every_pack(spark):
    entries = spark.createDataFrame([("pack", "p1", None), ("blob", "data/h", 1), (None, None, None)], "storage_kind string, ref string, volumes int")
    versions = spark.createDataFrame([("idx/1", 1)], "index_blob string, index_volumes int")
    names = {r.name for r in storage.reference_set(entries, spark.createDataFrame([("p1", 3, None)], _PACKS), versions, ["info"]).collect()}
    assert names == {"info", "idx/1", "data/h", "packs/p1.7z.001", "packs/p1.7z.002", "packs/p1.7z.003"}
    with pytest.raises(PySparkException, match="no metadata of pack p1"):
        storage.reference_set(entries, spark.createDataFrame([], _PACKS), versions, []).collect()


def test_direct_children(spark):
    entries = spark.createDataFrame([("a/b/c.txt", 1), ("a/d.txt", 2), ("top.txt", 3)], "path string, length long")
    empty = spark.createDataFrame([("a/empty",)], "path string")
    shown = lambda d: [(r.name, r.is_dir, r.has_children, r.length) for r in storage.browse(storage.direct_children(entries, empty, d), 0, 9).collect()]
    assert shown("") == [("a", True, True, None), ("top.txt", False, False, 3)]
    assert shown("a") == [("b", True, True, None), ("empty", True, False, None), ("d.txt", False, False, 2)]
    assert shown("x") == []


def test_ignore_rules_last_match_wins(spark):
    compiled = rules.compile_ignore_rules(["*.log", "!keep.log", "# no", "", "build/", "/root.txt", "docs/**/x", "a?c"])
    cases = {"a.log": True, "d/b.log": True, "d/keep.log": False, "build/f": True, "x/build/f": True, "build": False, "root.txt": True, "d/root.txt": False, "docs/x": True, "docs/a/b/x": True, "abc": True, "ac": False}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.i for r in df.select("path", rules.is_ignored_below(F.col("path"), compiled).alias("i")).collect()} == cases


def test_scope_longest_prefix_wins(spark):
    table = spark.createDataFrame(rules.normalize_scope([("a", False), ("a/b", True), ("./c/", True), ("a/x", False)]), "prefix string, included boolean")
    assert {r.prefix for r in table.collect()} == {"a", "a/b"}
    cases = {"a": False, "a/b": True, "a/b/c": True, "a/bc": False, "ab": True, "z": True}
    assert {r.path: r.in_scope for r in rules.in_scope(spark.createDataFrame([(p,) for p in cases], "path string"), table).collect()} == cases
    assert rules.with_scope_rule([("a", False), ("a/b", True)], "a", True) == []


def test_newest_journal_wins_and_its_first_line(spark):
    rows = [("r1", 1, 0, "p", "old", "blob"), ("r2", 2, 5, "p", "later", "blob"), ("r2", 2, 3, "p", "first", "blob")]
    for order in (rows, rows[::-1]):
        found = journal.newest_records(spark.createDataFrame(order, "run_id string, started_at long, line_no long, path string, ref string, kind string"))
        assert [r.ref for r in found.collect()] == ["first"]


def test_log_limits(spark):
    log = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), i % 4, "s" if i % 2 else "t") for i in range(300)], "id long, ts timestamp_ntz, level int, source string")
    assert len(oplog.query_log(log).collect()) == 200
    assert [r.id for r in oplog.query_log(log, 3, " ", limit=0).collect()] == [299]
    assert oplog.query_log(log, source="nobody").collect() == []


def test_sample_quotas():
    assert metrics.sample_quotas({0: 10, 1: 5}, 200) == {0: 10, 1: 5}
    quotas = metrics.sample_quotas({0: 5000, 1: 3, 2: 1}, 200)
    assert sum(quotas.values()) == 200 and all(quotas.values())


def test_throttle_counts_from_the_last_emission(spark):
    rows = [("s", ms, forced) for ms, forced in [(0, False), (150, False), (199, False), (200, False), (350, True), (450, False), (549, False), (550, False)]]
    assert [r.ms for r in metrics.throttle(spark.createDataFrame(rows, "stage string, ms long, forced boolean")).orderBy("ms").collect()] == [0, 200, 350, 550]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(fn.human_bytes(F.lit(b).cast("long"))) for b in (0, 999, 1000, 1150, 999_949, 999_960, 1_500_000_000)] == ["0 B", "999 B", "1.0 KB", "1.2 KB", "999.9 KB", "1.0 MB", "1.5 GB"]
    assert value(fn.normalized_path(F.lit("a\\ b //c/x/5425/"))) == "a/b/c/x/5425"
    assert value(fn.volume_names(F.lit("b"), F.lit(1000)))[-1] == "b.1000"
    assert value(fn.base_name(F.lit("data/h.1000"))) == "data/h"
    assert value(fn.content_key(F.lit("f"), F.lit(None), F.lit("h"), F.lit(None))) == "f\n\nh\n"
    assert value(fn.ancestors(F.lit("a/b/c"))) == ["a", "a/b"] and value(fn.ancestors(F.lit("a"))) == []
    waits = spark.range(1).select(fn.exponential_delays(F.lit(5), F.lit(100.0), 2, 300).alias("g"), fn.exponential_delays(F.lit(1), F.lit(100.0), 2, 300).alias("none"), fn.sequence_delays([100, 200], None, F.lit(750)).alias("s"), fn.sequence_delays([100, 200], None, F.lit(50)).alias("z")).first()
    assert (waits.g, waits.none, waits.s, waits.z) == ([100, 200, 300, 300], [], [100, 200, 200, 200], [])


def test_binary_bytes_near_and_beyond_the_units(spark, tmp_path):
    one = spark.range(1)
    value = lambda b, *unit: one.select(fn.human_bytes_binary(F.lit(b).cast("long"), *unit).alias("x")).first().x
    assert [value(b) for b in (0, 1023, 1024, 1048570, 1048576, 2_800_000_000, 3 * 1024**4)] == ["0 B", "1023 B", "1.0 KB", "1024.0 KB", "1.0 MB", "2.608 GB", "3.000 TB"]
    assert value(3 * 1024**4, "GB") == "3072.000 GB"
    # the query on order keys whose figures round up to the next unit, and reach 1024 GB
    keys = [*range(1020, 1030), *range(1_048_500, 1_048_600), 8_999_999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()["f14_binary_bytes"]).fetchall()
    assert sorted(map(tuple, registry.queries()["f14_binary_bytes"](spark, str(tmp_path)).collect())) == sorted(want)
