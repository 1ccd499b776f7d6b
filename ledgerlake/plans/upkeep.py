"""Queries of discovery, repair and retirement over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import journal, rules, storage, upkeep
from ..operators.scale import fresh_folder
from ..sources import journals, tables
from ..streaming import replay
from . import fixtures as fx
from .registry import _CLOUD_CTE, _NEWEST_CTE, _cloud, _objects, _query

#: Files over which the lines of a run are dealt.
JOURNALS = 16
_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@_query("SELECT name FROM objects WHERE starts_with(name, 'packs/')", fx.CTES, fx.STORED_CTE)
def a10_objects_by_prefix(spark, sf):
    return upkeep.list_objects(_objects(spark, sf), "packs/").select("name")


@_query(
    """SELECT n_name AS container, CASE WHEN bool_or(coalesce(c_custkey % 5 = 0, FALSE)) THEN 'Plain' WHEN bool_or(coalesce(c_custkey % 5 = 1, FALSE)) THEN 'Encrypted' ELSE 'None' END AS presence
    FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 4 <> 0 AND c_custkey % 5 IN (0, 1, 2) AND c_custkey <= 200) ON n_nationkey = c_nationkey GROUP BY n_name"""
)
def a11_discovery(spark, sf):
    nations = fx.table(spark, sf, "nation")
    held = fx.table(spark, sf, "customer").where("c_nationkey % 4 <> 0 and c_custkey % 5 in (0, 1, 2) and c_custkey <= 200").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.element_at(F.array(F.lit("index"), F.lit("index.enc"), F.lit("other")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return upkeep.discover(nations.select(F.col("n_name").alias("container")), held.select(F.col("n_name").alias("container"), name.alias("name")), "index", "index.enc")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'Plain' WHEN o_orderkey % 2 = 1 THEN 'Plain' WHEN o_orderkey % 4 = 2 THEN 'Encrypted' ELSE 'None' END AS presence FROM orders")
def d08_presence(spark, sf):
    key = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select("o_orderkey", upkeep.presence(key % 2 == 1, key % 4 >= 2).alias("presence"))


@_query(
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN s = 0 OR s >= 500 OR s IN (408, 429) WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN TRUE WHEN 4 THEN o_custkey % 2 = 0 WHEN 5 THEN TRUE ELSE FALSE END AS transient
    FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 600 ELSE [0, 408, 429, 404][o_orderkey // 2 % 4 + 1] END AS s FROM orders)"""
)
def d09_transient_errors(spark, sf):
    rows = fx.table(spark, sf, "orders")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("request", "io", "socket", "timeout", "canceled", "moved", "other")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    status = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 600 ELSE element_at(array(0, 408, 429, 404), cast(o_orderkey div 2 % 4 + 1 as int)) END")
    return rows.select("o_orderkey", upkeep.is_transient(kind, status, F.col("o_custkey") % 2 == 1).alias("transient"))


@_query("SELECT path FROM v1 WHERE doc_id % 11 = 0 AND doc_id % 3 <> 0 AND doc_id % 2 = 0", fx.CTES)
def c18_unresolved_paths(spark, sf):
    rows = fx.version(spark, sf, 1)
    return upkeep.unresolved_paths(rows.where("doc_id % 11 = 0"), rows.where("doc_id % 3 = 0"), rows.where("doc_id % 2 = 0"))


@_query(f"SELECT DISTINCT {_DIR} || '/empty' AS path FROM scan UNION SELECT path FROM (SELECT {_DIR} || '/empty' AS path FROM v1) WHERE path LIKE 'src3/en/%' OR path LIKE 'src5/%'", fx.CTES)
def e03_carried_empty_dirs(spark, sf):
    empties = lambda df: df.select(F.concat(fn.parent_dir(F.col("path")), F.lit("/empty")).alias("path")).distinct()
    return upkeep.carry_empty_dirs(empties(fx.scan(spark, sf)), empties(fx.version(spark, sf, 1)), fx.unreadable(spark, sf).where("is_directory"))


@_query("SELECT path, CASE WHEN doc_id % 7 = 1 AND doc_id % 2 = 0 THEN 0 ELSE length END AS length, CASE WHEN doc_id % 7 = 1 THEN 'late' ELSE full_hash END AS full_hash FROM v2", fx.CTES)
def e08_overridden_values(spark, sf):
    late = fx.version(spark, sf, 2).where("doc_id % 7 = 1").select("path", F.when(F.col("doc_id") % 2 == 0, 0).cast("long").alias("length"), F.lit("late").alias("full_hash"))
    return upkeep.override_values(fx.version(spark, sf, 2).select("path", "length", "full_hash"), late, ["length", "full_hash"])


_PARTLY = "partly AS (SELECT version, path, ref, CASE WHEN length % 2 = 0 THEN head_hash END AS head_hash, CASE WHEN length % 3 = 0 THEN tail_hash END AS tail_hash FROM stored WHERE ref IS NOT NULL)"


@_query("SELECT ref, path, version FROM partly QUALIFY row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN head_hash IS NULL OR tail_hash IS NULL THEN 1 ELSE 0 END, version, path) = 1", fx.CTES, fx.STORED_CTE, _PARTLY)
def e09_metadata_source(spark, sf):
    rows = fx.stored(spark, sf).withColumn("head_hash", F.when(F.col("length") % 2 == 0, F.col("head_hash"))).withColumn("tail_hash", F.when(F.col("length") % 3 == 0, F.col("tail_hash")))
    return upkeep.metadata_source(rows)


@_query("SELECT path, CASE WHEN coalesce(ref LIKE 'data/%a', FALSE) THEN 2 ELSE volumes END AS volumes, CASE WHEN coalesce(ref LIKE 'data/%a', FALSE) THEN '10,5' ELSE '' END AS sizes, coalesce(ref LIKE 'data/%a', FALSE) AS changed FROM stored", fx.CTES, fx.STORED_CTE)
def e07_rewritten_volumes(spark, sf):
    rows = fx.stored(spark, sf)
    replaced = rows.where("ref LIKE 'data/%a'").select("ref").distinct().select("ref", F.lit(2).alias("volumes"), F.array(F.lit(10).cast("long"), F.lit(5).cast("long")).alias("volume_sizes"))
    return upkeep.rewrite_volumes(rows, replaced).select("path", "volumes", F.coalesce(F.array_join(F.col("volume_sizes").cast("array<string>"), ","), F.lit("")).alias("sizes"), "changed")


_TWO_VERSIONS = """twice AS (SELECT 2 AS version, path, ref, full_hash, path AS entry_name FROM stored WHERE storage_kind = 'pack'
  UNION ALL SELECT 1, path, ref, md5(full_hash), path FROM stored WHERE storage_kind = 'pack' AND length % 2 = 0)"""


@_query("SELECT ref, entry_name, arg_min(full_hash, version) AS full_hash, string_agg(version || ':' || path, ',' ORDER BY version, path) AS uses FROM twice GROUP BY ref, entry_name", fx.CTES, fx.STORED_CTE, _TWO_VERSIONS)
def g22_members_across_versions(spark, sf):
    rows = fx.stored(spark, sf).where("storage_kind = 'pack'").withColumn("entry_name", F.col("path"))
    twice = rows.withColumn("version", F.lit(2)).unionByName(rows.where("length % 2 = 0").withColumn("version", F.lit(1)).withColumn("full_hash", F.md5("full_hash")))
    return upkeep.members_across_versions(twice).withColumn("uses", F.array_join(F.transform("uses", lambda u: F.concat(u["version"].cast("string"), F.lit(":"), u["path"])), ","))


@_query("SELECT path FROM stored WHERE storage_kind = 'pack' AND length % 17 = 0", fx.CTES, fx.STORED_CTE)
def g20_archive_twins(spark, sf):
    rows = fx.stored(spark, sf).where("storage_kind = 'pack'")
    names = rows.select(F.col("ref").alias("pack_id"), F.explode(F.when(F.col("length") % 17 == 0, F.array("path", F.upper("path"))).otherwise(F.array("path"))).alias("name"), F.lit(False).alias("is_directory"))
    folders = rows.select(F.col("ref").alias("pack_id"), F.upper("path").alias("name"), F.lit(True).alias("is_directory"))
    return upkeep.twin_entries(rows, names.union(folders)).select("path")


@_query("SELECT version, CASE WHEN n = 1 THEN 'idx/' || version ELSE 'idx/' || version || '.' || printf('%03d', i) END AS name FROM (SELECT version, n, unnest(range(1, n + 1)) AS i FROM (SELECT c_custkey AS version, c_nationkey % 3 + 1 AS n FROM customer WHERE c_custkey % 4 = 0))")
def c29_retired_indexes(spark, sf):
    rows = fx.table(spark, sf, "customer")
    versions = rows.select(F.col("c_custkey").alias("version"), F.concat(F.lit("idx/"), F.col("c_custkey").cast("string")).alias("index_blob"), (F.col("c_nationkey") % 3 + 1).alias("index_volumes"))
    return upkeep.retired_index_volumes(versions, versions.where("version % 4 = 0"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def c30_rehydration(spark, sf):
    status = F.when(F.col("o_orderkey") % 3 == 0, "rehydrate-pending-to-hot").when(F.col("o_orderkey") % 3 == 1, "")
    return upkeep.to_rehydrate(fx.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Archive").otherwise("Hot").alias("tier"), status.alias("archive_status"))).select("o_orderkey")


@_query(
    """SELECT storage_kind || ':' || ref AS key, CASE WHEN storage_kind = 'pack' THEN coalesce(max(p.volumes), 1) ELSE arg_min(s.volumes, s.path) END AS volumes
    FROM stored s LEFT JOIN (SELECT * FROM packs WHERE pack_id NOT LIKE 'src2%') p ON s.storage_kind = 'pack' AND s.ref = p.pack_id WHERE ref IS NOT NULL GROUP BY storage_kind, ref""",
    fx.CTES,
    fx.STORED_CTE,
)
def c31_volumes_by_key(spark, sf):
    rows = fx.stored(spark, sf)
    return upkeep.volumes_by_key(rows, fx.packs(rows).where("pack_id not like 'src2%'"))


@_query("SELECT path, doc_id AS unreadable_at FROM v1 WHERE doc_id % 6 = 0", fx.CTES)
def d11_unreadable_entries(spark, sf):
    return upkeep.unreadable_entries(fx.version(spark, sf, 1).withColumn("unreadable_at", F.when(F.col("doc_id") % 6 == 0, F.col("doc_id"))))


@_query("SELECT c_nationkey AS account_id, string_agg(n, '|' ORDER BY lower(n), n) AS names FROM (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE lower(c_name) END AS n FROM customer) GROUP BY 1")
def g11_backup_names(spark, sf):
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.lower("c_name"))
    return upkeep.backup_names(fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("account_id"), name.alias("name"))).withColumn("names", F.array_join("names", "|"))


@_query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS restored, CAST(sum(l_orderkey % 3) AS BIGINT) AS skipped, CAST(sum(l_partkey % 2) AS BIGINT) AS failed FROM lineitem")
def g14_restore_totals(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("restored"), (F.col("l_orderkey") % 3).alias("skipped"), (F.col("l_partkey") % 2).alias("failed"))
    return upkeep.restore_totals(rows)


@_query("SELECT bool_and(c_custkey % 997 <> 5) AS all_readable FROM customer")
def g17_all_readable(spark, sf):
    rows = fx.table(spark, sf, "customer").select(F.col("c_name").alias("secret"), (F.col("c_custkey") % 997 != 5).alias("readable"))
    empty = rows.select(F.lit("").alias("secret"), F.lit(False).alias("readable"))
    return upkeep.all_readable(rows, empty, rows.where("readable"))


@_query("SELECT o_orderkey AS version FROM orders ORDER BY 1 DESC")
def i04_newest_first(spark, sf):
    return upkeep.newest_first(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("version")))


@_query("SELECT o_orderkey AS version FROM orders ORDER BY o_orderkey % 1000 DESC, o_orderkey DESC LIMIT 1")
def i06_latest_version(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("version"), F.struct(F.col("o_orderkey") % 1000, "o_orderkey").alias("position"))
    return upkeep.latest(rows).select("version")


@_query("SELECT path FROM v1 WHERE doc_id % 5 = 0 OR doc_id % 3 = 0", fx.CTES)
def j06_union_of_missing(spark, sf):
    rows = fx.version(spark, sf, 1)
    return upkeep.union_of_missing(rows.where("doc_id % 5 = 0"), rows.where("doc_id % 3 = 0"))


@_query(
    r"""SELECT base || '.' || printf('%03d', i) AS name FROM (SELECT 'data/' || c_custkey AS base, c_nationkey % 4 + 2 AS n, unnest(range(1, 7)) AS i FROM customer WHERE c_custkey % 2 = 0) WHERE i > n"""
)
def b05_leftover_volumes(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("data/"), F.col("c_custkey").cast("string")).alias("base"), (F.col("c_nationkey") % 4 + 2).alias("volumes"))
    stored = rows.select("base", F.explode(fn.volume_names(F.col("base"), F.lit(6))).alias("name"))
    return upkeep.leftover_volumes(stored, rows.where("c_custkey % 2 = 0")).select("name")


@_query("SELECT 'f' || c_custkey AS path, 'f' || c_custkey || '.bak-20240101-000000' || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-1' WHEN 2 THEN '-2' ELSE '' END AS renamed FROM customer")
def f26_safe_names(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"))
    bak = lambda s: F.concat("path", F.lit(".bak-20240101-000000" + s))
    there = F.when(F.col("c_custkey") % 4 == 1, F.array("path", bak(""), bak("-2"))).when(F.col("c_custkey") % 4 == 2, F.array("path", bak(""), bak("-1"))).when(F.col("c_custkey") % 4 == 3, F.array("path", bak("-1"))).otherwise(F.array("path"))
    return upkeep.safe_names(rows, rows.select(F.explode(there).alias("path")), "20240101-000000")


@_query(
    """SELECT path, CASE WHEN doc_id % 5 = 4 THEN TRUE ELSE length = CASE WHEN doc_id % 7 = 0 THEN length + 1 ELSE length END AND (doc_id % 3 = 0 OR doc_id % 11 <> 0) AND (doc_id % 2 = 0 OR doc_id % 13 <> 0) END AS matches FROM v1""",
    fx.CTES,
)
def f04_verifiers(spark, sf):
    key = F.col("doc_id")
    rows = fx.version(spark, sf, 1)
    stored = fn.verifiers(F.col("full_hash"), F.when(key % 7 == 0, F.col("length") + 1).otherwise(F.col("length")), F.when(key % 3 != 0, F.when(key % 11 == 0, "x").otherwise(F.col("head_hash"))), F.when(key % 2 != 0, F.when(key % 13 == 0, "x").otherwise(F.col("tail_hash"))))
    meta = F.when(key % 5 == 4, F.create_map().cast("map<string,string>")).otherwise(stored)
    return rows.select("path", fn.verified(meta, *(F.col(c) for c in ("full_hash", "length", "head_hash", "tail_hash"))).alias("matches"))


@_query(
    """SELECT doc_id, md5(b[1:4096]) AS head_hash, md5(b[greatest(1, octet_length(b) - 4095):octet_length(b)]) AS tail_hash, md5(b) AS full_hash FROM (SELECT doc_id, encode(text) AS b FROM documents WHERE text IS NOT NULL)"""
)
def f01_content_hashes(spark, sf):
    rows = fx.table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", *[c.alias(name) for name, c in fn.content_hashes(F.col("text")).items()])


@_query(
    """SELECT b, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round(b / 1048576.0, 1)) ELSE printf('%.3f GB', round(b / 1073741824.0, 3)) END AS binary_bytes
    FROM (SELECT DISTINCT o_orderkey * f AS b FROM orders, (SELECT unnest([CAST(1 AS BIGINT), 1024, 1048576]) AS f))"""
)
def f14_binary_bytes(spark, sf):
    b = fx.table(spark, sf, "orders").select(F.explode(F.array(*[F.col("o_orderkey") * k for k in (1, 1024, 1048576)])).alias("b")).distinct()
    return b.select("b", fn.human_bytes_binary(F.col("b"), "GB").alias("binary_bytes"))


@_query("SELECT o_orderkey, 'run7-p' || printf('%04d', o_orderkey) AS pack FROM orders")
def f18_pack_names(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", fn.pack_name(F.col("o_orderkey"), "run7-").alias("pack"))


@_query("SELECT path, starts_with(path, 'src1/') OR (regexp_matches(path, '^(?:.*/)?[^/]*7$') AND NOT regexp_matches(path, '(?i)^(?:.*/)?SRC2/.*7$')) AS ignored FROM v1", fx.CTES)
def d06_joined_rules(spark, sf):
    """Two lists, one that minds case and one that does not, as one: the last match of all wins."""
    both = rules.compile_ignore_rules(["/src1/**", "/SRC2/**", "*7"]) + rules.compile_ignore_rules(["!SRC2/**/*7"], ignore_case=True)
    return fx.version(spark, sf, 1).select("path", rules.is_ignored(F.col("path"), False, both).alias("ignored"))


@_query(
    """SELECT version, path FROM stored WHERE ref IN (SELECT ref FROM cloud WHERE verdict <> 'Ok') AND ref NOT IN (SELECT s.ref FROM stored s JOIN v2 l ON s.path = l.path AND s.full_hash = l.full_hash WHERE s.ref IS NOT NULL) AND length % 3 <> 0""",
    fx.CTES,
    fx.STORED_CTE,
    _CLOUD_CTE,
)
def c28_unrecoverable_entries(spark, sf):
    rows, bad = fx.stored(spark, sf), _cloud(spark, sf).where("verdict <> 'Ok'")
    return storage.unrecoverable_entries(bad, rows, storage.repair_sources(bad, rows, fx.version(spark, sf, 2)), rows.where("length % 3 = 0"))


@_query("SELECT count(*) > 0 AS sweep FROM customer")
def c27_sweep_needed(spark, sf):
    rows = fx.table(spark, sf, "customer").select((F.col("c_nationkey") % 5 == 1).alias("adopted"))
    return journal.sweep_needed(rows, False)


# Sources, sinks and streams, written to the shared folder and read back


@_query("SELECT run_id, CAST(r + 1 AS INTEGER) AS baseline_version, path, ref, length FROM (SELECT *, CAST(substring(run_id, 4) AS INTEGER) AS r FROM journal) WHERE r <> 2 AND line_no % 7 <> 0", fx.CTES, fx.JOURNAL_CTE)
def a08_journals_read(spark, sf):
    """Journals of three runs as text: the second one's headers are broken, and every seventh line of the others. A run's
    lines are dealt over JOURNALS files, each with the run's header, so that no run is one task's."""
    rows = fx.journal(spark, sf).withColumn("r", F.substring("run_id", 4, 1).cast("int"))
    record = F.to_json(F.struct("kind", "ref", "path", "full_hash", "length"))
    line = F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("{"), record)).otherwise(record)
    lines = rows.select("r", F.pmod(F.xxhash64("line_no"), F.lit(JOURNALS)).cast("int").alias("part"), "line_no", line.alias("value"))
    header = F.to_json(F.struct("run_id", F.lit(1).alias("config_id"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"), (F.col("r") + 1).alias("baseline_version")))
    runs = rows.select("run_id", "r", "started_at").distinct().select("r", F.when(F.col("r") == 2, F.lit("no header")).otherwise(header).alias("value"))
    headers = runs.select("r", F.explode(F.sequence(F.lit(0), F.lit(JOURNALS - 1))).alias("part"), F.lit(None).cast("long").alias("line_no"), "value")
    path = f"{fresh_folder(spark, 'journals')}/all"
    # nulls first: the header; the files' writer keeps the order, as its own is by r and part
    lines.union(headers).repartition("r", "part").sortWithinPartitions("r", "part", "line_no").select("r", "part", "value").write.partitionBy("r", "part").text(path)
    return journals.read_journals(spark, path).select("run_id", "baseline_version", "path", "ref", "length")


@_query("SELECT CAST(v AS INTEGER) AS version, path, length FROM (SELECT 1 AS v, path, length FROM v1 UNION ALL SELECT 2, path, length FROM v2)", fx.CTES)
def b01_versions_written(spark, sf):
    path = fresh_folder(spark, "versions")
    for v in (1, 2):
        tables.write_version(fx.version(spark, sf, v).select("path", "length"), path, v)
    return spark.read.parquet(path)


@_query("SELECT path, length FROM v1 UNION ALL SELECT path, length FROM v2 WHERE path NOT IN (SELECT path FROM v1)", fx.CTES)
def b04_inserted_where_absent(spark, sf):
    path = f"{fresh_folder(spark, 'inserted')}/all"
    for v in (1, 2):
        tables.insert_absent(fx.version(spark, sf, v).select("path", "length"), path, ["path"])
    return spark.read.parquet(path)


@_query("SELECT path, length FROM v2 WHERE doc_id % 2 = 0 UNION ALL SELECT path, length FROM v1 WHERE path NOT IN (SELECT path FROM v2 WHERE doc_id % 2 = 0)", fx.CTES)
def b06_upserted(spark, sf):
    return tables.upserted(fx.version(spark, sf, 1).select("path", "length"), fx.version(spark, sf, 2).where("doc_id % 2 = 0").select("path", "length"), ["path"])


@_query("SELECT path, run_id, line_no, ref FROM newest", fx.CTES, fx.JOURNAL_CTE, _NEWEST_CTE)
def l03_replayed_stream(spark, sf):
    """The journals' records as a stream of files, replayed to the newest record of each path."""
    folder = fresh_folder(spark, "replay")
    fx.journal(spark, sf).withColumn("started_at", F.col("started_at").cast("timestamp")).repartition("run_id").write.json(f"{folder}/in")
    query = replay.replay(replay.record_stream(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return replay.replayed(spark, f"{folder}/out").select("path", "run_id", "line_no", "ref")


@_query("SELECT date_trunc('hour', ts) AS hour, level, count(*) AS count FROM oplog GROUP BY 1, 2", fx.OPLOG_CTE)
def l04_log_levels_by_hour(spark, sf):
    """The counts that the stream comes to once all rows have been seen."""
    log = fx.oplog(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return replay.log_levels_by_hour(log).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
