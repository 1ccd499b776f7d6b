"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import schedule, texts
from ..operators import dedup, diff, journal, metrics, oplog, packs, rules, storage
from . import fixtures as fx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, *ctes: str):
    """Registers a query under its function's name; ctes are put before the SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = (f"WITH {', '.join(ctes)} {sql}" if ctes else sql).strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import upkeep  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import upkeep  # noqa: F401

    return dict(_ORACLES)


# What changed

_LADDER = """
CASE WHEN s.kind IS DISTINCT FROM p.kind THEN 'Modified'
  WHEN s.kind = 'symlink' THEN CASE WHEN s.target IS NOT DISTINCT FROM p.target THEN 'Unchanged' ELSE 'Modified' END
  WHEN s.length <> p.length THEN 'Modified'
  WHEN s.mtime_ticks = p.mtime_ticks AND s.permissions = p.permissions THEN 'Unchanged'
  WHEN s.head_hash <> p.head_hash OR s.tail_hash <> p.tail_hash THEN 'Modified'
  WHEN s.full_hash = p.full_hash THEN 'MetadataOnly' ELSE 'Modified' END"""
_CHANGES = f"""
changes AS (
  SELECT coalesce(path, upath) AS path, CASE WHEN change IS NULL THEN 'Unreadable'
      WHEN change = 'Deleted' AND (upath IS NOT NULL OR EXISTS (SELECT 1 FROM unreadable d WHERE d.is_directory AND starts_with(c.path, d.path || '/'))) THEN 'Unreadable'
      ELSE change END AS change, length, prev_length
  FROM (
    SELECT coalesce(s.path, p.path) AS path, s.length, p.length AS prev_length,
      CASE WHEN p.path IS NULL THEN 'Added' WHEN s.path IS NULL THEN 'Deleted' ELSE {_LADDER} END AS change
    FROM scan s FULL JOIN v1 p ON s.path = p.path
  ) c FULL JOIN (SELECT path AS upath FROM unreadable WHERE NOT is_directory) u ON c.path = u.upath
)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return diff.manifest_diff(fx.scan(spark, sf), fx.version(spark, sf, 1), fx.unreadable(spark, sf))


@_query("SELECT path, change, length, prev_length FROM changes", fx.CTES, _CHANGES)
def c01_manifest_diff(spark, sf):
    return _changes(spark, sf)


@_query(f"SELECT s.path, {_LADDER} AS change FROM v2 s JOIN v1 p ON s.path = p.path", fx.CTES)
def c02_comparison_ladder(spark, sf):
    return diff.manifest_diff(fx.version(spark, sf, 2), fx.version(spark, sf, 1)).where("change not in ('Added', 'Deleted')").select("path", "change")


@_query("SELECT path FROM v1 WHERE path NOT IN (SELECT path FROM v2)", fx.CTES)
def c03_deleted(spark, sf):
    return fx.version(spark, sf, 1).join(fx.version(spark, sf, 2), "path", "left_anti").select("path")


@_query("SELECT p.path, max(d.path) AS directory FROM v1 p JOIN unreadable d ON d.is_directory AND starts_with(p.path, d.path || '/') GROUP BY p.path", fx.CTES)
def c04_unreadable_subtree(spark, sf):
    return diff.under_directories(fx.version(spark, sf, 1), fx.unreadable(spark, sf).where("is_directory"))


@_query(
    """SELECT count(*) FILTER (WHERE change = 'Added') AS added, count(*) FILTER (WHERE change = 'Modified') AS modified, count(*) FILTER (WHERE change = 'MetadataOnly') AS metadataonly,
      count(*) FILTER (WHERE change = 'Unreadable') AS unreadable, count(*) FILTER (WHERE change = 'Unchanged') AS unchanged, count(*) FILTER (WHERE change = 'Deleted') AS deleted,
      count(*) FILTER (WHERE change IN ('Added', 'Modified')) AS changed_files, CAST(coalesce(sum(length) FILTER (WHERE change IN ('Added', 'Modified')), 0) AS BIGINT) AS changed_bytes,
      CAST(coalesce(sum(prev_length) FILTER (WHERE change = 'Deleted'), 0) AS BIGINT) AS deleted_bytes FROM changes""",
    fx.CTES,
    _CHANGES,
)
def g02_change_summary(spark, sf):
    return diff.change_summary(_changes(spark, sf))


@_query(
    """SELECT CAST(v AS BIGINT) AS version, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, CASE WHEN v = 1 THEN 0 ELSE (SELECT count(*) FROM changes WHERE change IN ('Added', 'Modified')) END AS changed_files,
      CASE WHEN v = 1 THEN 0 ELSE (SELECT CAST(coalesce(sum(length), 0) AS BIGINT) FROM changes WHERE change IN ('Added', 'Modified')) END AS changed_bytes
    FROM (SELECT 1 AS v, length FROM v1 UNION ALL SELECT 2, length FROM v2) GROUP BY v""",
    fx.CTES,
    _CHANGES,
)
def g01_version_stats(spark, sf):
    both = [fx.version(spark, sf, v).select(F.lit(v).cast("long").alias("version"), "length") for v in (1, 2)]
    return diff.version_stats(both[0].union(both[1]), _changes(spark, sf).withColumn("version", F.lit(2).cast("long")))


@_query(
    """SELECT coalesce(d, path) AS path, count(*) AS affected FROM (
      SELECT c.path, (SELECT max(u.path) FROM unreadable u WHERE u.is_directory AND starts_with(c.path, u.path || '/')) AS d FROM changes c WHERE change = 'Unreadable') GROUP BY 1""",
    fx.CTES,
    _CHANGES,
)
def g12_unreadable_summary(spark, sf):
    return diff.unreadable_summary(_changes(spark, sf), fx.unreadable(spark, sf))


@_query(
    """SELECT c.path, c.change, CASE WHEN lost THEN p.kind ELSE s.kind END AS kind, CASE WHEN lost THEN p.length ELSE s.length END AS length,
      CASE WHEN lost THEN p.mtime_ticks ELSE s.mtime_ticks END AS mtime_ticks, CASE WHEN lost THEN p.permissions ELSE s.permissions END AS permissions,
      CASE WHEN lost THEN p.target ELSE s.target END AS target, CASE WHEN lost THEN p.head_hash ELSE s.head_hash END AS head_hash,
      CASE WHEN lost THEN p.tail_hash ELSE coalesce(s.tail_hash, p.tail_hash) END AS tail_hash, CASE WHEN lost THEN p.full_hash ELSE s.full_hash END AS full_hash,
      CASE WHEN lost THEN o.ref WHEN s.kind <> 'file' OR s.length = 0 THEN NULL WHEN change IN ('Added', 'Modified') THEN 'data/' || s.full_hash ELSE o.ref END AS ref,
      CASE WHEN lost THEN CAST(77 AS BIGINT) END AS unreadable_at
    FROM (SELECT *, change = 'Unreadable' AS lost FROM changes WHERE change <> 'Deleted') c LEFT JOIN scan s ON c.path = s.path LEFT JOIN v1 p ON c.path = p.path LEFT JOIN stored o ON c.path = o.path
    WHERE NOT lost OR p.kind IS NOT NULL""",
    fx.CTES,
    _CHANGES,
    fx.STORED_CTE,
)
def e01_build_entries(spark, sf):
    changes = _changes(spark, sf)
    previous = fx.version(spark, sf, 1).join(fx.stored(spark, sf).select("path", "ref"), "path", "left").withColumn("unreadable_at", F.lit(None).cast("long"))
    fresh = changes.where("change in ('Added', 'Modified')").join(fx.scan(spark, sf).where("kind = 'file' and length > 0"), "path", "left_semi").join(fx.scan(spark, sf).select("path", "full_hash"), "path")
    return diff.build_entries(fx.scan(spark, sf).drop("doc_id"), changes, previous, fresh.select("path", F.concat(F.lit("data/"), F.col("full_hash")).alias("ref")), 77)


@_query("SELECT d AS path FROM (SELECT DISTINCT 'src' || CAST(i AS VARCHAR) || '/' || l AS d FROM (SELECT unnest(range(0, 25)) AS i), (SELECT unnest(['en', 'de', 'xx']) AS l)) WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE starts_with(v1.path, d || '/'))", fx.CTES)
def a03_empty_directories(spark, sf):
    dirs = spark.range(25).select(F.explode(F.array(*[F.concat(F.lit("src"), F.col("id").cast("string"), F.lit(f"/{x}")) for x in ("en", "de", "xx")])).alias("path"))
    return diff.empty_directories(dirs, fx.version(spark, sf, 1))


@_query("SELECT CAST(p AS BIGINT) AS position, s AS same FROM (VALUES (0, TRUE), (1, FALSE), (2, FALSE)) t(p, s)")
def c24_metadata_drift(spark, sf):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "version long, index_blob string")
    return diff.version_drift(a, spark.createDataFrame([(1, "a"), (2, "x")], "version long, index_blob string"), ["version", "index_blob"])


# Content identity

_DEDUP_KEY = "full_hash, length, head_hash, tail_hash"


@_query(
    f"""SELECT v2.path, k.ref, k.volumes FROM v2 LEFT JOIN (SELECT {_DEDUP_KEY}, max(ref) AS ref, max(volumes) AS volumes FROM stored WHERE storage_kind = 'blob' GROUP BY ALL) k
      ON v2.full_hash = k.full_hash AND v2.length = k.length AND v2.head_hash = k.head_hash AND v2.tail_hash = k.tail_hash""",
    fx.CTES,
    fx.STORED_CTE,
)
def c05_known_blobs(spark, sf):
    return dedup.known_blobs(fx.version(spark, sf, 2), fx.stored(spark, sf).where("storage_kind = 'blob'")).select("path", "ref", "volumes")


@_query(
    f"""SELECT v2.path, k.pack_id, k.entry_name FROM v2 LEFT JOIN (SELECT {_DEDUP_KEY}, CAST(min((doc_version, ref, path)).ref AS VARCHAR) AS pack_id, CAST(min((doc_version, ref, path)).path AS VARCHAR) AS entry_name
      FROM (SELECT *, row_number() OVER (ORDER BY path) AS doc_version FROM stored WHERE storage_kind = 'pack') GROUP BY {_DEDUP_KEY}) k
      ON v2.full_hash = k.full_hash AND v2.length = k.length AND v2.head_hash = k.head_hash AND v2.tail_hash IS NOT DISTINCT FROM k.tail_hash""".replace("min((doc_version, ref, path)).ref", "arg_min(ref, doc_version)").replace("min((doc_version, ref, path)).path", "arg_min(path, doc_version)"),
    fx.CTES,
    fx.STORED_CTE,
)
def c06_known_members(spark, sf):
    prior = fx.stored(spark, sf).where("storage_kind = 'pack'").select("full_hash", "length", "head_hash", "tail_hash", F.col("ref").alias("pack_id"), F.col("path").alias("entry_name"), F.col("path").alias("version"))
    return dedup.known_members(fx.version(spark, sf, 2), prior).select("path", "pack_id", "entry_name")


@_query("SELECT path FROM v2 WHERE (length, head_hash) IN (SELECT (length, head_hash) FROM v1)", fx.CTES)
def c07_prescreen(spark, sf):
    return dedup.prescreen(fx.version(spark, sf, 2), fx.version(spark, sf, 1)).select("path")


@_query(f"SELECT path, first_value(path) OVER (PARTITION BY {_DEDUP_KEY} ORDER BY path) AS leader FROM v2", fx.CTES)
def h03_aliases(spark, sf):
    return dedup.aliases(fx.version(spark, sf, 2)).select("path", "leader")


_LEADERS = f"leaders AS (SELECT path, first_value(path) OVER (PARTITION BY {_DEDUP_KEY} ORDER BY path) AS leader FROM v1)"


@_query(
    """SELECT l.path, leader, CASE WHEN s.storage_kind = 'pack' AND s.length % 7 <> 0 THEN s.ref END AS ref, NOT coalesce(s.storage_kind = 'pack' AND s.length % 7 <> 0, FALSE) AS orphan
      FROM leaders l JOIN stored s ON l.leader = s.path WHERE l.path <> leader""",
    fx.CTES,
    fx.STORED_CTE,
    _LEADERS,
)
def h04_alias_backfill(spark, sf):
    stored = fx.stored(spark, sf).select("path", F.col("storage_kind").alias("kind"), "ref", (F.col("length") % 7 == 0).alias("overridden"), F.lit(False).alias("unreadable"))
    return dedup.backfill_aliases(dedup.aliases(fx.version(spark, sf, 1)), stored)


@_query(
    """SELECT path, base || CASE WHEN n = 0 THEN '' ELSE '~' || CAST(n AS VARCHAR) END AS address FROM (
      SELECT path, base, dense_rank() OVER (PARTITION BY base ORDER BY f) - 1 AS n FROM (SELECT path, 'data/' || substring(full_hash, 1, 2) AS base, min(path) OVER (PARTITION BY full_hash, length, head_hash, tail_hash) AS f FROM v2))""",
    fx.CTES,
)
def h09_collision_addresses(spark, sf):
    short = F.substring("full_hash", 1, 2)  # two digits only, so that addresses do collide
    rows = fx.version(spark, sf, 2).withColumn("head_hash", F.concat("head_hash", F.col("full_hash"))).withColumn("full_hash", short)
    return dedup.addresses(rows)


@_query("SELECT path, full_hash || chr(10) || CAST(length AS VARCHAR) || chr(10) || head_hash || chr(10) || tail_hash AS content_key FROM v2", fx.CTES)
def f02_content_key(spark, sf):
    return fx.version(spark, sf, 2).select("path", fn.content_key(*(F.col(c) for c in ("full_hash", "length", "head_hash", "tail_hash"))).alias("content_key"))


@_query()
def f03_keyed_address(spark, sf):
    key = fn.derive_address_key(b"password", b"salt")
    return fx.version(spark, sf, 2).select("path", fn.data_address(F.col("full_hash"), key).alias("address"))


# rules

_IGNORE = ["# comment", "src1/", "*/de/*7", "!src1*/de/*77", "/src2/**", "src1?/en/*5", "!**/*9", "00000013"]


@_query(
    r"""SELECT path, CASE WHEN regexp_matches(path, '^(?:.*/)?00000013$') THEN TRUE WHEN regexp_matches(path, '^(?:.*/)?[^/]*9$') THEN FALSE WHEN regexp_matches(path, '^src1[^/]/en/[^/]*5$') THEN TRUE
      WHEN regexp_matches(path, '^src2/.*$') THEN TRUE WHEN regexp_matches(path, '^src1[^/]*/de/[^/]*77$') THEN FALSE WHEN regexp_matches(path, '^[^/]*/de/[^/]*7$') THEN TRUE ELSE FALSE END AS ignored FROM v1""",
    fx.CTES,
)
def d02_ignore_rules(spark, sf):
    return fx.version(spark, sf, 1).select("path", rules.is_ignored(F.col("path"), False, rules.compile_ignore_rules(_IGNORE)).alias("ignored"))


@_query(
    r"""SELECT path, starts_with(path, 'src1/') OR starts_with(path, 'src2/') OR CASE WHEN regexp_matches(path, '^(?:.*/)?00000013$') THEN TRUE WHEN regexp_matches(path, '^(?:.*/)?[^/]*9$') THEN FALSE
      WHEN regexp_matches(path, '^src1[^/]/en/[^/]*5$') THEN TRUE WHEN regexp_matches(path, '^src1[^/]*/de/[^/]*77$') THEN FALSE WHEN regexp_matches(path, '^[^/]*/de/[^/]*7$') THEN TRUE ELSE FALSE END AS ignored
    FROM v1""",
    fx.CTES,
)
def d03_ignored_with_ancestors(spark, sf):
    return fx.version(spark, sf, 1).select("path", rules.is_ignored_below(F.col("path"), rules.compile_ignore_rules(_IGNORE)).alias("ignored"))


_SCOPE = [("src1", False), ("src1/en", True), ("src2/fr", False), ("src3", False), ("src3/de", True), ("src4", True)]
_SCOPE_CTE = "rules AS (SELECT * FROM (VALUES ('src1', FALSE), ('src1/en', TRUE), ('src2/fr', FALSE), ('src3', FALSE), ('src3/de', TRUE)) t(prefix, included))"


@_query("SELECT path, coalesce((SELECT arg_max(included, length(prefix)) FROM rules r WHERE v1.path = prefix OR starts_with(v1.path, prefix || '/')), TRUE) AS in_scope FROM v1", fx.CTES, _SCOPE_CTE)
def d04_in_scope(spark, sf):
    table = spark.createDataFrame(rules.normalize_scope(_SCOPE), "prefix string, included boolean")
    return rules.in_scope(fx.version(spark, sf, 1).select("path"), table)


@_query(
    """SELECT path, s AS in_scope, s OR coalesce(any_in, FALSE) AS may_contain, coalesce(CASE WHEN s THEN NOT all_in ELSE any_in END, FALSE) AS partial FROM (
      SELECT path, coalesce((SELECT arg_max(included, length(prefix)) FROM rules r WHERE d.path = prefix OR starts_with(d.path, prefix || '/')), TRUE) AS s,
        (SELECT bool_or(included) FROM rules r WHERE starts_with(prefix, d.path || '/')) AS any_in, (SELECT bool_and(included) FROM rules r WHERE starts_with(prefix, d.path || '/')) AS all_in
      FROM (SELECT DISTINCT source AS path FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT source || '/' || lang FROM documents) d WHERE path IS NOT NULL)""",
    _SCOPE_CTE,
)
def d05_may_contain(spark, sf):
    docs = fx.table(spark, sf, "documents")
    dirs = docs.select(F.explode(F.array("source", F.concat("source", F.lit("/"), "lang"))).alias("path")).where("path is not null").distinct()
    return rules.may_contain_included(dirs, spark.createDataFrame(rules.normalize_scope(_SCOPE), "prefix string, included boolean"))


@_query(r"SELECT DISTINCT l AS name, regexp_matches(l, '^[a-z0-9](-?[a-z0-9])+$') AND length(l) BETWEEN 3 AND 63 AS valid FROM (SELECT lower(replace(c_name, '#', '-')) AS l FROM customer UNION ALL SELECT replace(n_name, ' ', '--') FROM nation)")
def d12_container_names(spark, sf):
    names = fx.table(spark, sf, "customer").select(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("name")).union(fx.table(spark, sf, "nation").select(F.replace("n_name", F.lit(" "), F.lit("--"))))
    return names.distinct().select("name", fn.valid_container_name(F.col("name")).alias("valid"))


@_query("SELECT p AS path, o AS inside FROM (VALUES ('a/b', TRUE), ('a/../b', TRUE), ('../a', FALSE), ('a/../../b', FALSE), ('/a', FALSE), ('a\\..\\..\\b', FALSE), ('', TRUE), ('C:/x', FALSE), ('./a', TRUE)) t(p, o)")
def d13_path_containment(spark, sf):
    paths = ["a/b", "a/../b", "../a", "a/../../b", "/a", "a\\..\\..\\b", "", "C:/x", "./a"]
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", fn.within(F.col("path")).alias("inside"))


# F: scalar functions over whole tables


@_query(
    r"""SELECT url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, strlen(url) + 1 AS argument_bytes, len(string_split(url, '/')) - 1 AS depth, array_to_string([trim(x) for x in string_split(replace(url, '\', '/'), '/') if trim(x) <> ''], '/') AS normalized FROM pages WHERE url IS NOT NULL"""
)
def f05_paths(spark, sf):
    url = F.col("url")
    return fx.table(spark, sf, "pages").where("url is not null").select("url", fn.parent_dir(url).alias("parent"), fn.argument_bytes(url).cast("long").alias("argument_bytes"), F.size(fn.ancestors(url)).cast("long").alias("depth"), fn.normalized_path(url).alias("normalized"))


@_query("SELECT DISTINCT path, array_to_string(string_split(path, '/')[1:i], '/') AS ancestor FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM v1)", fx.CTES)
def f07_ancestors(spark, sf):
    return fx.version(spark, sf, 1).select("path", F.explode(fn.ancestors(F.col("path"))).alias("ancestor"))


@_query("SELECT ref, CASE WHEN n <= 1 THEN ref ELSE ref || '.' || printf('%03d', i) END AS name, TRUE AS belongs FROM (SELECT ref, n, unnest(range(1, n + 1)) AS i FROM (SELECT DISTINCT ref, volumes AS n FROM stored WHERE storage_kind = 'blob'))", fx.CTES, fx.STORED_CTE)
def f08_volume_names(spark, sf):
    rows = fx.stored(spark, sf).where("storage_kind = 'blob'").select("ref", "volumes").distinct()
    named = rows.select("ref", F.explode(fn.volume_names(F.col("ref"), F.col("volumes"))).alias("name"))
    return named.withColumn("belongs", fn.is_volume_of(F.col("ref"), F.col("name")) & (fn.base_name(F.col("name")) == F.col("ref")))


@_query(
    r"""SELECT name, regexp_replace(name, '\.[0-9]{3,}$', '') AS base, nullif(regexp_extract(name, '^packs/(.+?)\.7z(?:\.[0-9]+)?$', 1), '') AS pack_id FROM objects""",
    fx.CTES,
    fx.STORED_CTE,
)
def f09_base_names(spark, sf):
    return _objects(spark, sf).select("name", fn.base_name(F.col("name")).alias("base"), fn.pack_id_of(F.col("name")).alias("pack_id"))


_TENTHS = " ".join(
    f"WHEN (b * 10 + {10**p // 2}) // {10**p} < 10000 THEN CAST((b * 10 + {10**p // 2}) // {10**p} // 10 AS VARCHAR) || '.' || CAST((b * 10 + {10**p // 2}) // {10**p} % 10 AS VARCHAR) || ' {u}'" for p, u in ((3, "KB"), (6, "MB"), (9, "GB"))
)


@_query(
    f"SELECT b, CASE WHEN b < 1000 THEN CAST(b AS VARCHAR) || ' B' {_TENTHS} END AS decimal_bytes FROM (SELECT DISTINCT CAST(strlen(text) AS BIGINT) * f AS b FROM documents, (SELECT unnest([1, 1000, 40000]) AS f) WHERE text IS NOT NULL)"
)
def f13_human_bytes(spark, sf):
    b = fx.table(spark, sf, "documents").where("text is not null").select(F.explode(F.array(*[F.octet_length("text").cast("long") * k for k in (1, 1000, 40000)])).alias("b")).distinct()
    return b.select("b", fn.human_bytes(F.col("b")).alias("decimal_bytes"))


@_query(
    """SELECT s, CASE WHEN s >= 86400 THEN CAST(s // 86400 AS VARCHAR) || 'd ' || CAST(s // 3600 % 24 AS VARCHAR) || 'h' WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s // 60 % 60 AS VARCHAR) || 'm'
      WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s AS VARCHAR) || 's' END AS duration FROM (SELECT DISTINCT o_orderkey * 37 AS s FROM orders)"""
)
def f15_durations(spark, sf):
    return fx.table(spark, sf, "orders").select((F.col("o_orderkey") * 37).alias("s")).distinct().select("s", fn.human_duration(F.col("s")).alias("duration"))


@_query("SELECT o_orderkey, lpad(printf('%o', o_orderkey % 512), 4, '0') AS permissions, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey * 3000 < 1000000 THEN 1 WHEN o_orderkey * 3000 < 100000000 THEN 2 ELSE 3 END AS INTEGER) AS bucket FROM orders")
def f21_permissions_and_buckets(spark, sf):
    size = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") * 3000)
    return fx.table(spark, sf, "orders").select("o_orderkey", fn.octal_permissions(F.col("o_orderkey") % 512).alias("permissions"), fn.size_bucket(size).alias("bucket"))


# packing

_CAP, _LARGE = 20_000, 15_000
_PACK_CTES = f"""
files AS (SELECT path, length, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, strlen(path) + 1 AS pb, doc_id % 6 = 0 AS store_only FROM v1 WHERE kind = 'file'),
lanes AS (SELECT f.*, CASE WHEN length >= {_LARGE} THEN 'single' WHEN n < 9 THEN 'cross' ELSE 'directory' END AS lane FROM files f LEFT JOIN (SELECT d, count(*) AS n FROM files WHERE length < {_LARGE} GROUP BY d) c ON f.d = c.d),
grouped AS (SELECT *, CASE WHEN lane = 'cross' THEN '' ELSE d END AS g, row_number() OVER (PARTITION BY lane, CASE WHEN lane = 'cross' THEN '' ELSE d END, store_only ORDER BY path) AS rn FROM lanes WHERE lane <> 'single'),
folded AS (
  SELECT lane, g, store_only, path, rn, CAST(0 AS BIGINT) AS pack, length AS total, CAST(1 AS BIGINT) AS members, CAST(pb AS BIGINT) AS paths FROM grouped WHERE rn = 1
  UNION ALL
  SELECT n.lane, n.g, n.store_only, n.path, n.rn, CASE WHEN f.total + n.length > {_CAP} OR f.members + 1 > 6 OR f.paths + n.pb > 100 THEN f.pack + 1 ELSE f.pack END,
    CASE WHEN f.total + n.length > {_CAP} OR f.members + 1 > 6 OR f.paths + n.pb > 100 THEN n.length ELSE f.total + n.length END,
    CASE WHEN f.total + n.length > {_CAP} OR f.members + 1 > 6 OR f.paths + n.pb > 100 THEN 1 ELSE f.members + 1 END,
    CASE WHEN f.total + n.length > {_CAP} OR f.members + 1 > 6 OR f.paths + n.pb > 100 THEN n.pb ELSE f.paths + n.pb END
  FROM folded f JOIN grouped n ON f.lane = n.lane AND f.g = n.g AND f.store_only = n.store_only AND n.rn = f.rn + 1
)"""


def _classified(spark, sf) -> DataFrame:
    files = fx.version(spark, sf, 1).where("kind = 'file'").select("path", "length", "doc_id")
    return packs.classify(files, _LARGE, dont_compress=F.col("doc_id") % 6 == 0, min_per_dir=9)


def _packed(spark, sf) -> DataFrame:
    grouped = _classified(spark, sf).where("lane <> 'single'").withColumn("dir", F.when(F.col("lane") == "cross", "").otherwise(F.col("dir")))
    return packs.greedy_packs(grouped, ["lane", "dir", "store_only"], _CAP, 6, 100)


@_query("SELECT path, lane, store_only FROM lanes", "RECURSIVE " + fx.CTES, _PACK_CTES)
def h06_classify(spark, sf):
    return _classified(spark, sf).select("path", "lane", "store_only")


@_query("SELECT path, lane, store_only, pack FROM folded", "RECURSIVE " + fx.CTES, _PACK_CTES)
def h05_greedy_packs(spark, sf):
    return _packed(spark, sf).select("path", "lane", "store_only", "pack")


@_query("SELECT path, dense_rank() OVER (ORDER BY CASE WHEN lane = 'cross' THEN 1 ELSE 0 END, g, store_only, pack) AS pack_number FROM folded", "RECURSIVE " + fx.CTES, _PACK_CTES)
def h07_pack_numbers(spark, sf):
    return packs.number_packs(_packed(spark, sf)).select("path", "pack_number")


@_query(
    f"SELECT path, doc_id % 6 + 1 AS attempts, CASE WHEN length >= {_LARGE} OR doc_id % 6 + 1 >= 5 THEN 'single' ELSE 'directory' END AS lane, doc_id % 6 + 1 >= 5 AS gave_up FROM v1 WHERE kind = 'file'",
    fx.CTES,
)
def h08_requeue(spark, sf):
    changed = fx.version(spark, sf, 1).where("kind = 'file'").select("path", "length", (F.col("doc_id") % 6).alias("attempts"), F.lit(packs.BY_DIRECTORY).alias("lane"))
    return packs.requeue(changed, _LARGE).drop("length")


@_query("SELECT d AS dir, count(*) AS candidates FROM files WHERE length < 15000 GROUP BY d", fx.CTES, _PACK_CTES.partition("lanes AS")[0].rstrip().rstrip(","))
def g09_directory_counts(spark, sf):
    return packs.directory_counts(fx.version(spark, sf, 1).where("kind = 'file' and length < 15000"))


# storage


def _references(spark, sf) -> DataFrame:
    rows = fx.stored(spark, sf)
    return storage.reference_set(rows, fx.packs(rows), fx.index_versions(spark), ["info", "info.enc"])


def _objects(spark, sf) -> DataFrame:
    return fx.objects(spark, sf, _references(spark, sf))


@_query("SELECT DISTINCT name FROM references_", fx.CTES, fx.STORED_CTE)
def c08_reference_set(spark, sf):
    return _references(spark, sf)


@_query("SELECT name, size FROM objects WHERE name NOT IN (SELECT name FROM references_)", fx.CTES, fx.STORED_CTE)
def c09_orphans(spark, sf):
    return storage.orphans(_objects(spark, sf), _references(spark, sf))


_SWEEP = r"swept AS (SELECT * FROM (SELECT *, regexp_replace(name, '\.[0-9]{3,}$', '') AS base FROM objects) WHERE base NOT IN (SELECT base FROM references_) AND base <> 'packs/gone3.7z')"


def _swept(spark, sf) -> DataFrame:
    bases = _references(spark, sf).select(fn.base_name(F.col("name")).alias("base")).distinct()
    return storage.sweep(_objects(spark, sf), bases, spark.createDataFrame([("packs/gone3.7z",)], "base string"))


@_query("SELECT base, name, size FROM swept", fx.CTES, fx.STORED_CTE, _SWEEP)
def c10_retention_sweep(spark, sf):
    return _swept(spark, sf)


@_query("SELECT pack_id FROM packs WHERE pack_id NOT IN (SELECT ref FROM stored WHERE storage_kind = 'pack' AND length % 2 = 0) AND pack_id <> 'src1-en'", fx.CTES, fx.STORED_CTE)
def c11_pack_prune(spark, sf):
    rows = fx.stored(spark, sf)
    used = rows.where("storage_kind = 'pack' and length % 2 = 0").select(F.col("ref").alias("pack_id")).distinct()
    return storage.prune_packs(fx.packs(rows), used, spark.createDataFrame([("src1-en",)], "pack_id string")).select("pack_id")


@_query("SELECT s.storage_kind, s.ref, CASE WHEN s.storage_kind = 'pack' THEN coalesce(p.volumes, 1) ELSE coalesce(s.v, 1) END AS volumes FROM (SELECT storage_kind, ref, max(volumes) AS v FROM stored WHERE ref IS NOT NULL GROUP BY 1, 2) s LEFT JOIN (SELECT * FROM packs WHERE pack_id NOT LIKE 'src2%') p ON s.ref = p.pack_id", fx.CTES, fx.STORED_CTE)
def c12_expected_volumes(spark, sf):
    rows = fx.stored(spark, sf)
    refs = rows.where("ref is not null").groupBy("storage_kind", "ref").agg(F.max("volumes").alias("volumes")).withColumn("volume_sizes", F.lit(None).cast("array<bigint>"))
    return storage.expected_volumes(refs, fx.packs(rows).where("pack_id not like 'src2%'")).select("storage_kind", "ref", "volumes")


_CLOUD_CTE = """cloud AS (
  SELECT ref, CASE WHEN bool_or(coalesce(o.size, one.size) IS NULL) THEN 'Missing' WHEN bool_or(coalesce(i = 1 AND coalesce(o.size, one.size) % 5 = 0, FALSE)) THEN 'SizeMismatch' ELSE 'Ok' END AS verdict FROM (
    SELECT ref, i, n, CASE WHEN n <= 1 THEN base ELSE base || '.' || printf('%03d', i) END AS name FROM (SELECT ref, base, n, unnest(range(1, greatest(n, 1) + 1)) AS i FROM (
      SELECT pack_id AS ref, 'packs/' || pack_id || '.7z' AS base, volumes AS n FROM packs UNION ALL SELECT ref, ref, max(volumes) FROM stored WHERE storage_kind = 'blob' GROUP BY ref))
  ) e LEFT JOIN objects o ON e.name = o.name LEFT JOIN objects one ON e.n <= 1 AND one.name = e.name || '.001' GROUP BY ref)"""


def _cloud(spark, sf) -> DataFrame:
    rows = fx.stored(spark, sf)
    refs = rows.where("ref is not null").groupBy("storage_kind", "ref").agg(F.max("volumes").alias("volumes")).withColumn("volume_sizes", F.lit(None).cast("array<bigint>"))
    expected = storage.expected_volumes(refs, fx.packs(rows))
    base = fn.object_of(F.col("storage_kind"), F.col("ref"))
    first = F.length(fn.volume_names(base, F.col("volumes"))[0]) + 100
    # the first volume's size is known, and known wrongly where it can be divided by five
    known = expected.withColumn("volume_sizes", F.array(F.when(first % 5 == 0, first + 1).otherwise(first).cast("long")))
    return storage.cloud_check(known, _objects(spark, sf))


@_query("SELECT ref, verdict FROM cloud", fx.CTES, fx.STORED_CTE, _CLOUD_CTE)
def c23_cloud_check(spark, sf):
    return _cloud(spark, sf)


_LOCAL_CTE = """checked AS (
  SELECT s.*, CASE WHEN l.path IS NULL OR s.kind = 'symlink' AND l.kind <> 'symlink' THEN 'Missing' WHEN s.kind = 'symlink' THEN CASE WHEN l.target IS NOT DISTINCT FROM s.target THEN 'Ok' ELSE 'Changed' END
    WHEN l.doc_id % 37 = 0 THEN 'Missing' WHEN l.full_hash = s.full_hash THEN 'Ok' ELSE 'Changed' END AS local FROM stored s LEFT JOIN v2 l ON s.path = l.path),
found AS (SELECT c.path, c.ref, coalesce(verdict, 'Ok') AS cloud, local, coalesce(verdict, 'Ok') <> 'Ok' AND local = 'Ok' AS repairable FROM checked c LEFT JOIN cloud k ON c.ref = k.ref)"""


def _local(spark, sf) -> DataFrame:
    return fx.version(spark, sf, 2).withColumn("unreadable", F.col("doc_id") % 37 == 0)


def _found(spark, sf) -> DataFrame:
    return storage.findings(storage.local_check(fx.stored(spark, sf), _local(spark, sf)), _cloud(spark, sf)).select("path", "ref", "cloud", "local", "repairable")


@_query("SELECT path, local FROM checked", fx.CTES, fx.STORED_CTE, _CLOUD_CTE, _LOCAL_CTE)
def c22_local_check(spark, sf):
    return storage.local_check(fx.stored(spark, sf), _local(spark, sf)).select("path", "local")


@_query("SELECT s.path, CASE WHEN l.path IS NULL OR s.kind = 'symlink' AND l.kind <> 'symlink' THEN 'Missing' WHEN s.kind = 'symlink' THEN CASE WHEN l.target IS NOT DISTINCT FROM s.target THEN 'Ok' ELSE 'Changed' END WHEN l.doc_id % 37 = 0 THEN 'Missing' WHEN l.length = s.length AND l.permissions = s.permissions THEN 'Ok' ELSE 'Changed' END AS local FROM stored s LEFT JOIN v2 l ON s.path = l.path", fx.CTES, fx.STORED_CTE)
def c22_local_attributes(spark, sf):
    return storage.local_check(fx.stored(spark, sf), _local(spark, sf), "Attributes").select("path", "local")


@_query("SELECT * FROM found", fx.CTES, fx.STORED_CTE, _CLOUD_CTE, _LOCAL_CTE)
def e04_findings(spark, sf):
    return _found(spark, sf)


@_query("SELECT bool_and(cloud = 'Ok') AS ok, count(DISTINCT ref) FILTER (WHERE cloud <> 'Ok') AS missing_refs, count(*) FILTER (WHERE cloud <> 'Ok') AS corrupted, count(*) FILTER (WHERE repairable) AS repairable FROM found", fx.CTES, fx.STORED_CTE, _CLOUD_CTE, _LOCAL_CTE)
def g08_check_report(spark, sf):
    return storage.check_report(_found(spark, sf))


@_query("SELECT s.path, s.ref, CASE WHEN s.length % 11 = 0 THEN 'Missing' WHEN s.length % 13 = 0 THEN 'Length' WHEN s.length % 5 = 1 THEN 'Hash' ELSE 'Ok' END AS verdict FROM stored s WHERE storage_kind = 'pack'", fx.CTES, fx.STORED_CTE)
def c25_archive_check(spark, sf):
    rows = fx.stored(spark, sf)
    members = rows.where("storage_kind = 'pack' and length % 11 <> 0").select(F.col("ref").alias("pack_id"), F.col("path").alias("name"), (F.col("length") + F.when(F.col("length") % 13 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("length") % 5 == 1, "other").when(F.col("length") % 5 != 2, F.col("full_hash")).alias("full_hash"))
    return storage.archive_check(rows, members).select("path", "ref", "verdict")


_LIVE_CTE = "live AS (SELECT ref AS pack_id, count(*) AS members, CAST(sum(length) AS BIGINT) AS live_bytes FROM stored WHERE storage_kind = 'pack' AND length % 4 <> 0 GROUP BY ref)"


@_query("SELECT * FROM live", fx.CTES, fx.STORED_CTE, _LIVE_CTE)
def g03_live_members(spark, sf):
    return storage.live_members(fx.stored(spark, sf).where("length % 4 <> 0"))


@_query(
    """SELECT pack_id, round(r, 9) AS ratio, r > 0.3 AND live_bytes > 0 AS compact FROM (SELECT p.pack_id, coalesce(live_bytes, 0) AS live_bytes, CASE WHEN original_bytes = 0 THEN 0.0 ELSE greatest(0, original_bytes - coalesce(live_bytes, 0)) / CAST(original_bytes AS DOUBLE) END AS r FROM packs p LEFT JOIN live l ON p.pack_id = l.pack_id)""",
    fx.CTES,
    fx.STORED_CTE,
    _LIVE_CTE,
)
def g04_dead_weight(spark, sf):
    rows = fx.stored(spark, sf)
    return storage.dead_weight(fx.packs(rows), storage.live_members(rows.where("length % 4 <> 0"))).select("pack_id", F.round("ratio", 9).alias("ratio"), "compact")


@_query(
    """SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, (SELECT count(DISTINCT storage_kind || ref) FROM stored WHERE ref IS NOT NULL) AS objects,
      CAST((SELECT sum(volumes * 10) FROM packs) + (SELECT sum(x) FROM (SELECT max(length) AS x FROM stored WHERE storage_kind = 'blob' GROUP BY ref)) AS BIGINT) AS download_bytes FROM stored""",
    fx.CTES,
    fx.STORED_CTE,
)
def g05_restore_estimate(spark, sf):
    rows = fx.stored(spark, sf)
    sized = rows.withColumn("volume_sizes", F.when(F.col("storage_kind") == "blob", F.array("length")))
    return storage.restore_estimate(sized, fx.packs(rows).withColumn("volume_sizes", F.array_repeat(F.lit(10).cast("long"), F.col("volumes"))))


@_query("SELECT count(DISTINCT base) FILTER (WHERE base LIKE 'packs/%') AS packs, count(DISTINCT base) FILTER (WHERE base NOT LIKE 'packs/%') AS blobs, CAST(coalesce(sum(size), 0) AS BIGINT) AS freed_bytes FROM swept", fx.CTES, fx.STORED_CTE, _SWEEP)
def g06_cleanup_report(spark, sf):
    return storage.cleanup_report(_swept(spark, sf))


@_query("SELECT storage_kind || ':' || ref AS key, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, bool_and(length > 0) AS total_known FROM stored WHERE ref IS NOT NULL GROUP BY 1", fx.CTES, fx.STORED_CTE)
def g10_restore_groups(spark, sf):
    return storage.restore_groups(fx.stored(spark, sf))


_VERSIONS_CTE = "numbered AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderdate AS created_at FROM orders)"


@_query(
    "SELECT o_custkey, version, r > 1 AND (r > 3 OR created_at < TIMESTAMP '1998-08-01' - INTERVAL 900 DAY) AS retired FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) AS r FROM numbered)",
    _VERSIONS_CTE,
)
def h01_retention(spark, sf):
    rows = spark.sql("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version, o_orderdate AS created_at FROM {orders}", orders=fx.table(spark, sf, "orders"))
    import datetime

    return storage.retention(rows, datetime.datetime(1998, 8, 1), "Either", 3, 900, ["o_custkey"]).select("o_custkey", "version", "retired")


# Restore and browse


@_query("SELECT a.path, CASE WHEN b.path IS NOT NULL AND a.doc_id % 3 = 0 THEN b.full_hash ELSE a.full_hash END AS full_hash FROM v1 a LEFT JOIN v2 b ON a.path = b.path", fx.CTES)
def c16_substitution(spark, sf):
    return storage.substitute(fx.version(spark, sf, 1).select("path", "full_hash"), fx.version(spark, sf, 2).where("doc_id % 3 = 0"), ["full_hash"])


@_query("SELECT path FROM v1 WHERE path IN (SELECT path FROM v2 WHERE doc_id % 3 = 0)", fx.CTES)
def c17_selection(spark, sf):
    return fx.version(spark, sf, 1).join(fx.version(spark, sf, 2).where("doc_id % 3 = 0"), "path", "left_semi").select("path")


@_query("SELECT a.path, CASE WHEN b.path IS NULL THEN TRUE ELSE coalesce(a.full_hash <> b.full_hash, TRUE) END AS restore FROM v1 a LEFT JOIN v2 b ON a.path = b.path", fx.CTES)
def c26_restore_decision(spark, sf):
    return storage.restore_decision(fx.version(spark, sf, 1), fx.version(spark, sf, 2), "Overwrite").select("path", "restore")


@_query("SELECT ref, min(CASE WHEN l.path IS NOT NULL THEN s.path END) AS source FROM stored s LEFT JOIN v2 l ON s.path = l.path AND s.full_hash = l.full_hash WHERE ref IN (SELECT ref FROM cloud WHERE verdict <> 'Ok') GROUP BY ref", fx.CTES, fx.STORED_CTE, _CLOUD_CTE)
def c28_repair_sources(spark, sf):
    return storage.repair_sources(_cloud(spark, sf).where("verdict <> 'Ok'"), fx.stored(spark, sf), fx.version(spark, sf, 2))


@_query("SELECT p AS path FROM (SELECT lower(c_mktsegment) || '/' || CAST(c_custkey % 97 AS VARCHAR) || CAST(c_nationkey AS VARCHAR) AS p FROM customer) GROUP BY p HAVING count(*) = 1")
def e06_duplicate_paths(spark, sf):
    rows = fx.table(spark, sf, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("/"), (F.col("c_custkey") % 97).cast("string"), F.col("c_nationkey").cast("string")).alias("path"))
    return storage.drop_duplicate_paths(rows).select("path")


@_query(
    "SELECT lower(p) AS folded, array_to_string(list_sort(list(DISTINCT p)), '|') AS paths FROM (SELECT CASE WHEN doc_id % 40 = 0 THEN 'SRC' || CAST(doc_id % 20 AS VARCHAR) || '/x' ELSE 'src' || CAST(doc_id % 20 AS VARCHAR) || '/' || CASE WHEN doc_id % 3 = 0 THEN 'X' ELSE 'x' END END AS p FROM documents) GROUP BY 1 HAVING count(DISTINCT p) > 1"
)
def g19_case_collisions(spark, sf):
    rows = fx.table(spark, sf, "documents").selectExpr("CASE WHEN doc_id % 40 = 0 THEN 'SRC' || CAST(doc_id % 20 AS STRING) || '/x' ELSE 'src' || CAST(doc_id % 20 AS STRING) || '/' || CASE WHEN doc_id % 3 = 0 THEN 'X' ELSE 'x' END END AS path")
    return storage.case_collisions(rows).select("folded", F.array_join("paths", "|").alias("paths"))


_TREE = """SELECT name, bool_or(is_dir) AS is_dir, bool_or(deeper) AS has_children, CASE WHEN NOT bool_or(is_dir) THEN max(length) END AS length FROM (
  SELECT p[1] AS name, len(p) > 1 AS is_dir, len(p) > 1 AS deeper, length FROM (SELECT string_split(substring(path, {n}), '/') AS p, length FROM v1 WHERE starts_with(path, '{d}'))
  UNION ALL SELECT '{e}', TRUE, FALSE, NULL) GROUP BY name"""


@_query(_TREE.format(n=6, d="src1/", e="empty"), fx.CTES)
def k01_direct_children(spark, sf):
    return storage.direct_children(fx.version(spark, sf, 1), spark.createDataFrame([("src1/empty",), ("other",)], "path string"), "src1")


@_query(f"SELECT name, is_dir, count(*) OVER () AS total, count(*) OVER () > 12 AS truncated FROM ({_TREE.format(n=1, d='', e='zz')}) ORDER BY is_dir DESC, lower(name), name LIMIT 7 OFFSET 5", fx.CTES)
def i05_browse_page(spark, sf):
    return storage.browse(storage.direct_children(fx.version(spark, sf, 1), spark.createDataFrame([("zz",)], "path string"), ""), 5, 7).select("name", "is_dir", "total", "truncated")


@_query("SELECT version, abs(version - 4) AS distance FROM numbered WHERE o_custkey = 1 AND version % 3 <> 0", _VERSIONS_CTE)
def i07_nearest_versions(spark, sf):
    rows = spark.sql("SELECT CAST(o_custkey AS STRING) AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version FROM {orders}", orders=fx.table(spark, sf, "orders"))
    return storage.nearest_versions(rows, rows.where("version % 3 = 0"), "1", 4)


# journals

_NEWEST_CTE = "newest AS (SELECT * FROM journal QUALIFY row_number() OVER (PARTITION BY path ORDER BY started_at DESC, line_no) = 1)"


@_query("SELECT path, run_id, line_no, ref FROM newest", fx.CTES, fx.JOURNAL_CTE, _NEWEST_CTE)
def h02_newest_records(spark, sf):
    return journal.newest_records(fx.journal(spark, sf)).select("path", "run_id", "line_no", "ref")


@_query("SELECT s.path, n.ref FROM v2 s JOIN newest n ON s.path = n.path AND s.mtime_ticks = n.mtime_utc_ticks AND s.length = n.length", fx.CTES, fx.JOURNAL_CTE, _NEWEST_CTE)
def c13_resume_cheap(spark, sf):
    return journal.resume_cheap(fx.version(spark, sf, 2), journal.newest_records(fx.journal(spark, sf))).select("path", "ref")


@_query("SELECT s.path, n.ref FROM v2 s JOIN newest n ON s.path = n.path AND s.full_hash = n.full_hash AND s.length = n.length AND s.head_hash = n.head_hash AND s.tail_hash = n.tail_hash", fx.CTES, fx.JOURNAL_CTE, _NEWEST_CTE)
def c14_resume_full(spark, sf):
    return journal.resume_full(fx.version(spark, sf, 2), journal.newest_records(fx.journal(spark, sf))).select("path", "ref")


@_query(
    """SELECT a.d AS pack, min(b.d) AS ref FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, list(path || chr(9) || full_hash ORDER BY path) AS m FROM v1 GROUP BY 1) a
      JOIN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, list(path || chr(9) || full_hash ORDER BY path) AS m FROM v1 WHERE doc_id % 17 <> 0 GROUP BY 1) b ON a.m = b.m GROUP BY a.d""",
    fx.CTES,
)
def c15_resume_packs(spark, sf):
    rows = fx.version(spark, sf, 1).select(fn.parent_dir(F.col("path")).alias("pack"), "path", "full_hash", F.col("path").alias("at"), "doc_id")
    return journal.resume_packs(rows, rows.where("doc_id % 17 <> 0").withColumnRenamed("pack", "ref"))


@_query("SELECT DISTINCT kind, ref FROM journal", fx.CTES, fx.JOURNAL_CTE)
def g18_active_refs(spark, sf):
    return journal.active_refs(fx.journal(spark, sf))


@_query("SELECT run_id, count(*) AS records, CAST(sum(length) AS BIGINT) AS bytes FROM journal GROUP BY run_id", fx.CTES, fx.JOURNAL_CTE)
def a09_journal_peek(spark, sf):
    return journal.peek(fx.journal(spark, sf))


@_query("SELECT c_custkey AS run, c_nationkey % 5 = 1 AND c_custkey % 2 = 0 AS adopted FROM customer")
def c27_journal_adoption(spark, sf):
    rows = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_nationkey") % 5).alias("config_id"), (F.col("c_custkey") % 2).alias("baseline_version"), F.lit("/data").alias("local_root"), F.lit(None).cast("string").alias("encryption_identity"))
    return journal.adoption(rows, 1, 0, "/data", None).select("run", "adopted")


# Log and operations


@_query("SELECT id, level, source, message FROM oplog WHERE level >= 1 AND source = 'backup:1:purchase' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25' ORDER BY id DESC LIMIT 150", fx.OPLOG_CTE)
def i01_log_query(spark, sf):
    return oplog.query_log(fx.oplog(spark, sf), 1, "backup:1:purchase", "2024-01-03", "2024-01-25", 150).select("id", "level", "source", "message")


@_query("SELECT id FROM oplog WHERE NOT (ephemeral AND ts < TIMESTAMP '2024-01-16')", fx.OPLOG_CTE)
def b07_log_trim(spark, sf):
    return oplog.trim_log(fx.oplog(spark, sf), "2024-01-16").select("id")


@_query("SELECT id FROM oplog WHERE source NOT LIKE '%:click'", fx.OPLOG_CTE)
def b07_log_delete_for(spark, sf):
    return oplog.delete_for(fx.oplog(spark, sf), "click").select("id")


@_query("SELECT level, source, count(*) AS n FROM oplog GROUP BY 1, 2", fx.OPLOG_CTE)
def f22_log_levels(spark, sf):
    return fx.oplog(spark, sf).groupBy("level", "source").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT n_nationkey AS group_id, n_name AS name, coalesce(m, '') AS members FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(c_name, ',' ORDER BY lower(c_name), c_name) AS m FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def c20_group_members(spark, sf):
    groups = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    members = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_name").alias("member"))
    return oplog.members_of(groups, members).withColumn("members", F.array_join("members", ","))


@_query("SELECT s_suppkey AS task_id, s_name AS target FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, c_name FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_suppkey % 3 <> 0")
def c21_schedule_targets(spark, sf):
    tasks = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("task_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("target"), F.col("s_nationkey").alias("group_id"))
    return oplog.resolve_targets(tasks, fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_name").alias("member")))


@_query("SELECT n_name AS container, min(c_custkey) AS config_id FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 2 = 0) ON n_nationkey = c_nationkey GROUP BY n_name")
def c19_container_occupancy(spark, sf):
    nations = fx.table(spark, sf, "nation")
    configs = fx.table(spark, sf, "customer").where("c_nationkey % 2 = 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("config_id"), F.col("n_name").alias("container"))
    return oplog.occupancy(nations.select(F.col("n_name").alias("container")), configs)


@_query("SELECT o_custkey AS config_id FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus = 'F')")
def g21_auto_resume(spark, sf):
    return oplog.auto_resume(fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("config_id"), (F.col("o_orderstatus") == "F").alias("shutting_down")))


@_query("SELECT p_partkey AS config_id FROM part WHERE (p_size & 4) <> 0")
def d10_event_mask(spark, sf):
    return oplog.events_matching(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("config_id"), F.col("p_size").alias("events")), 4).select("config_id")


@_query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def h14_last_events(spark, sf):
    return oplog.last_events(fx.table(spark, sf, "events"), "user_id", 20).select("event_id", "user_id")


@_query("SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'default' WHEN c_nationkey % 4 = 1 THEN '' ELSE c_mktsegment END AS tier FROM customer")
def e05_settings_inheritance(spark, sf):
    configs = fx.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 == 0, None).when(F.col("c_nationkey") % 4 == 1, "").otherwise(F.col("c_mktsegment")).alias("tier"))
    return oplog.inherited(configs, spark.createDataFrame([("default",)], "tier string"), ["tier"])


# progress


@_query(
    "SELECT stage, ms, bytes, CASE WHEN ms > t THEN (bytes - b) * 1000 // (ms - t) ELSE 0 END AS speed FROM (SELECT *, greatest(min(bytes) OVER w, min(bytes) OVER h) AS b, greatest(min(ms) OVER w, min(ms) OVER h) AS t FROM samples WINDOW w AS (PARTITION BY stage ORDER BY ms RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW), h AS (PARTITION BY stage ORDER BY ms ROWS BETWEEN 255 PRECEDING AND CURRENT ROW))",
    fx.SAMPLES_CTE,
)
def h10_rolling_speed(spark, sf):
    return metrics.rolling_speed(fx.samples(spark, sf))


@_query("SELECT stage, ms, CASE WHEN bytes > 0 AND bytes < 50000 THEN (ms - 28000000) * (50000 - bytes) // bytes END AS eta_ms FROM samples", fx.SAMPLES_CTE)
def h11_time_to_go(spark, sf):
    rows = fx.samples(spark, sf).withColumn("ms", F.col("ms") - 28_000_000).withColumn("total", F.lit(50_000).cast("long"))
    return metrics.time_to_go(rows).select("stage", (F.col("ms") + 28_000_000).alias("ms"), "eta_ms")


@_query(
    """SELECT stage, ms FROM walk WHERE emitted""",
    "RECURSIVE " + fx.SAMPLES_CTE,
    """ordered AS (SELECT stage, ms, ms % 53 = 0 AS forced, row_number() OVER (PARTITION BY stage ORDER BY ms) AS rn FROM samples),
walk AS (SELECT stage, rn, ms, ms AS last, TRUE AS emitted FROM ordered WHERE rn = 1
  UNION ALL SELECT o.stage, o.rn, o.ms, CASE WHEN forced OR o.ms - last >= 200 THEN o.ms ELSE last END, forced OR o.ms - last >= 200 FROM walk w JOIN ordered o ON w.stage = o.stage AND o.rn = w.rn + 1)""",
)
def h12_throttle(spark, sf):
    return metrics.throttle(fx.samples(spark, sf).select("stage", "ms", (F.col("ms") % 53 == 0).alias("forced"))).select("stage", "ms")


@_query(
    """SELECT l_shipmode AS stage, count(*) AS total, count(*) FILTER (WHERE s = 0) AS pending, count(*) FILTER (WHERE s = 1) AS running, count(*) FILTER (WHERE s = 2) AS done, count(*) FILTER (WHERE s = 3) AS failed, TRUE AS balanced FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_orderkey % 4 AS s FROM lineitem) GROUP BY 1"""
)
def h13_item_ledger(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "done", "failed")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return metrics.ledger(fx.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("stage"), state.alias("state")))


@_query()
def h16_stratified_sample(spark, sf):
    rows = fx.version(spark, sf, 1).select("path", "length", F.when(F.col("length") < 500, 0).when(F.col("length") < 2000, 1).when(F.col("length") < 10000, 2).otherwise(3).alias("bucket"))
    return metrics.stratified_sample(rows, "bucket", "path", 200)


@_query(
    """SELECT count(*) AS sampled, count(*) FILTER (WHERE l.path IS NOT NULL AND l.length = s.length) AS matched, count(*) FILTER (WHERE l.path IS NULL) AS missing, count(*) FILTER (WHERE l.length <> s.length) AS size_differs,
      count(*) FILTER (WHERE l.length = s.length AND l.mtime_ticks <> s.mtime_ticks) AS time_differs, (SELECT array_to_string(list(path ORDER BY path), ',') FROM (SELECT s.path FROM v1 s LEFT JOIN v2 l ON s.path = l.path WHERE l.path IS NULL OR l.length <> s.length ORDER BY 1 LIMIT 10)) AS examples, round(count(*) FILTER (WHERE l.length = s.length) / CAST(count(*) AS DOUBLE), 6) AS rate,
      CASE WHEN count(*) FILTER (WHERE l.length = s.length) >= 0.95 * count(*) THEN 'ok' WHEN count(*) FILTER (WHERE l.length = s.length) >= 0.05 * count(*) THEN 'confirm' ELSE 'reject' END AS verdict
    FROM v1 s LEFT JOIN v2 l ON s.path = l.path""",
    fx.CTES,
)
def g13_sampled_match(spark, sf):
    later = fx.version(spark, sf, 2).withColumn("mtime_ticks", F.col("mtime_ticks") * 20_000_000)
    return metrics.sampled_match(fx.version(spark, sf, 1), later).withColumn("examples", F.array_join("examples", ","))


@_query(
    """SELECT p_partkey, array_to_string([CAST(floor(least(p_size * 100 * pow(1.5, i - 1), 9000.0)) AS BIGINT) FOR i IN range(1, p_partkey % 7)], ',') AS growing,
      array_to_string(list_concat([[500, 1000, 4000][i] FOR i IN range(1, CASE WHEN p_size * 300 >= 5500 THEN 4 WHEN p_size * 300 >= 1500 THEN 3 WHEN p_size * 300 >= 500 THEN 2 ELSE 1 END)],
        [3000 FOR i IN range(CASE WHEN p_size * 300 >= 5500 THEN (p_size * 300 - 5500) // 3000 ELSE 0 END)]), ',') AS listed FROM part"""
)
def f25_retry_delays(spark, sf):
    base, total = (F.col("p_size") * 100).cast("double"), F.col("p_size") * 300
    growing = fn.exponential_delays((F.col("p_partkey") % 7).cast("int"), base, 1.5, 9000)
    return fx.table(spark, sf, "part").select("p_partkey", F.array_join(growing.cast("array<string>"), ",").alias("growing"), F.array_join(fn.sequence_delays([500, 1000, 4000], 3000, total).cast("array<string>"), ",").alias("listed"))


# J: sets


@_query("SELECT full_hash FROM v1 UNION SELECT full_hash FROM v2", fx.CTES)
def j01_union(spark, sf):
    return fx.version(spark, sf, 1).select("full_hash").union(fx.version(spark, sf, 2).select("full_hash")).distinct()


@_query("SELECT full_hash FROM v1 EXCEPT SELECT full_hash FROM v2", fx.CTES)
def j03_difference(spark, sf):
    return fx.version(spark, sf, 1).select("full_hash").distinct().join(fx.version(spark, sf, 2).select("full_hash"), "full_hash", "left_anti")


@_query("SELECT path, 'dir' AS kind FROM (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM v1) UNION ALL SELECT path, 'file' FROM v1", fx.CTES)
def j05_ordered_concat(spark, sf):
    rows = fx.version(spark, sf, 1)
    return storage.directories(rows).select("path", F.lit("dir").alias("kind")).unionByName(rows.select("path", F.lit("file").alias("kind")))


# Texts and schedules

_FULL = "'%Y-%m-%d %H:%M:%S'"


@_query(
    f"""SELECT event_id, strftime(e, {_FULL}) AS local_time, 'UTC+08:00' AS utc_offset,
      CASE WHEN event_id % 7 = 0 THEN '—' ELSE strftime(s, {_FULL}) END || ' → ' || CASE WHEN event_id % 7 <> 0 AND CAST(s AS DATE) = CAST(e AS DATE) THEN strftime(e, '%H:%M:%S') ELSE strftime(e, {_FULL}) END AS span
    FROM (SELECT event_id, ts + INTERVAL 2 HOUR AS s, ts + INTERVAL 8 HOUR AS e FROM events)"""
)
def f16_local_times(spark, sf):
    started = F.when(F.col("event_id") % 7 != 0, F.expr("ts - INTERVAL 6 HOURS"))
    zone = "Asia/Shanghai"
    return fx.table(spark, sf, "events").select("event_id", texts.local_time(F.col("ts"), zone).alias("local_time"), texts.utc_offset(F.col("ts"), zone).alias("utc_offset"), texts.version_span(started, F.col("ts"), zone).alias("span"))


@_query(
    """SELECT p_partkey, strftime(CASE p_partkey % 5 WHEN 1 THEN date_trunc('hour', a) + to_minutes((minute(a) // 15 + 1) * 15) ELSE (
        SELECT min(c) FROM (SELECT date_trunc('day', a) + to_days(CAST(d AS INTEGER)) + to_hours(h) + to_minutes(m) AS c FROM (SELECT unnest(range(0, 41)) AS d)) t
        WHERE c > a AND (p_partkey % 5 = 0 OR p_partkey % 5 = 2 AND isodow(c) <= 5 OR p_partkey % 5 = 3 AND day(c) IN (1, 15))) END, '%Y-%m-%d %H:%M:%S') AS next_run
    FROM (SELECT p_partkey, p_size % 60 AS m, p_partkey % 24 AS h, TIMESTAMP '2024-02-26 10:30:00' + to_hours(p_partkey) AS a FROM part)"""
)
def f17_next_runs(spark, sf):
    cron = F.expr("element_at(array(p_size % 60 || ' ' || p_partkey % 24 || ' * * *', '*/15 * * * *', p_size % 60 || ' ' || p_partkey % 24 || ' * * MON-FRI', p_size % 60 || ' ' || p_partkey % 24 || ' 1,15 * *', 'soon'), cast(p_partkey % 5 as int) + 1)")
    after = F.timestamp_add("HOUR", F.col("p_partkey"), F.lit("2024-02-26 10:30:00").cast("timestamp_ntz"))
    return fx.table(spark, sf, "part").select("p_partkey", F.date_format(schedule.next_occurrence(cron, after), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@_query(
    r"""SELECT c_custkey, '{"t": "' || replace(replace(t, '\', '\\'), '"', '\"') || '", "b": "' || c_mktsegment || '", "raw": ' || t || '}' AS as_json, 'x?t=' || url_encode(t) || '&b=' || url_encode(c_mktsegment) AS as_url
    FROM (SELECT c_custkey, c_mktsegment, c_name || ' "a\b" $1 é/~' AS t FROM customer)"""
)
def f20_filled_templates(spark, sf):
    title, body = F.concat("c_name", F.lit(' "a\\b" $1 é/~')), F.col("c_mktsegment")
    filled = [texts.fill_template(F.lit(t), title, body, how).alias(f"as_{how}") for t, how in (('{"t": "{Title}", "b": "{BODY}", "raw": {titleraw}}', "json"), ("x?t={title}&b={Body}", "url"))]
    return fx.table(spark, sf, "customer").select("c_custkey", *filled)


@_query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'pack ' || p_brand || ' (' || CAST(p_size % 3 AS VARCHAR) || CASE WHEN p_size % 3 = 1 THEN ' file)' ELSE ' files)' END
      WHEN p_size % 3 > 0 THEN p_name ELSE p_brand END AS label FROM part"""
)
def f24_transfer_labels(spark, sf):
    kind = F.when(F.col("p_partkey") % 3 == 0, "pack").otherwise("blob")
    return fx.table(spark, sf, "part").select("p_partkey", texts.transfer_label(kind, F.col("p_brand"), F.col("p_size") % 3, F.col("p_name")).alias("label"))


def _megabytes(k: str) -> str:
    return f"CASE WHEN {k} = 0 THEN '0 B' ELSE {k} || '.0 MB' END"


@_query(
    f"""SELECT c_custkey, concat_ws(chr(10), 'Version ' || c_custkey,
      'Files: ' || coalesce(nullif(concat_ws(', ', CASE WHEN n > 0 THEN n || ' new' END, CASE WHEN m > 0 THEN m || ' modified' END,
        CASE WHEN d > 0 THEN d || ' deleted' || CASE WHEN db > 0 THEN ' (' || {_megabytes('db')} || ')' ELSE '' END END, CASE WHEN u > 0 THEN u || ' unreadable (skipped)' END), ''), 'no changes'),
      CASE WHEN cb > 0 OR ub > 0 THEN 'Data: ' || {_megabytes('cb')} || ' changed at source → ' || {_megabytes('ub')} || ' uploaded' END,
      'Retention: ' || nullif(concat_ws(', ', CASE WHEN n > 0 THEN 'retired ' || n || ' version(s)' END,
        'deleted ' || nullif(concat_ws(' + ', CASE WHEN m > 0 THEN m || ' pack(s)' END, CASE WHEN u > 0 THEN u || ' blob(s)' END), ''), CASE WHEN ub > 0 THEN 'freed ' || {_megabytes('ub')} END), ''),
      CASE WHEN c_custkey % 6 = 0 THEN 'Cleanup: skipped, will retry next run (busy)' END) AS summary
    FROM (SELECT c_custkey, c_custkey % 3 AS n, c_nationkey % 2 AS m, c_custkey % 5 AS d, c_custkey % 7 AS db, c_nationkey % 4 AS u, c_custkey % 2 AS cb, c_nationkey % 3 AS ub FROM customer)"""
)
def g16_run_summaries(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    freed = nation % 3 * 1_000_000
    retention = texts.retention_line(key % 3, nation % 2, nation % 4, freed)
    summary = texts.run_summary(key, key % 3, nation % 2, key % 5, key % 7 * 1_000_000, nation % 4, key % 2 * 1_000_000, freed, retention, F.when(key % 6 == 0, "busy"))
    return fx.table(spark, sf, "customer").select("c_custkey", summary.alias("summary"))
