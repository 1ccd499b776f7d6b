"""Domain views over the driver's tables, once for Spark and once as DuckDB CTEs.

A document is a file source/lang/<id>. Version 1 lacks every tenth document, version 2 every seventh; version 2 has
changed, touched and re-kinded ones, so that each kind of change occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One text for both engines; {S} is the string type, {B} the count of bytes.
_ROWS = """
SELECT doc_id, path,
  CASE WHEN doc_id % 23 = 0 OR ({v} = 2 AND doc_id % 29 = 0) THEN 'symlink' ELSE 'file' END AS kind,
  CAST({B}(t) AS BIGINT) AS length,
  CAST(CASE WHEN {v} = 2 AND (doc_id % 5 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 11 = 0) THEN 1 ELSE 0 END AS BIGINT) AS mtime_ticks,
  CASE WHEN {v} = 2 AND doc_id % 19 = 0 THEN '0600' ELSE '0644' END AS permissions,
  CASE WHEN doc_id % 23 = 0 THEN CASE WHEN {v} = 2 AND doc_id % 2 = 0 THEN 'b' ELSE 'a' END END AS target,
  md5(substring(t, 1, 64)) AS head_hash, md5(right(t, 64)) AS tail_hash, md5(t) AS full_hash
FROM (
  SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id AS {S}), 8, '0') AS path,
    CASE WHEN {v} = 1 THEN text WHEN doc_id % 5 = 0 THEN '~' || substring(text, 2, 100000000)
      WHEN doc_id % 13 = 0 THEN substring(text, 1, length(text) - 1) || '~' WHEN doc_id % 17 = 0 THEN text || '~' ELSE text END AS t
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND doc_id % {m} <> 0
) x
"""


def _version(v: int, spark_side: bool) -> str:
    return _ROWS.format(v=v, m={1: 10, 2: 7}[v], S="STRING" if spark_side else "VARCHAR", B="octet_length" if spark_side else "strlen")


UNREADABLE_DIRS = ("src3/en", "src5")
#: What a scan cannot see: everything below the directories, and these files.
_HIDDEN = "(path LIKE 'src3/en/%' OR path LIKE 'src5/%' OR doc_id % 97 = 0)"

CTES = f"""
v1 AS ({_version(1, False)}),
v2 AS ({_version(2, False)}),
scan AS (SELECT * FROM v2 WHERE NOT {_HIDDEN}),
unreadable AS (
  SELECT 'src3/en' AS path, TRUE AS is_directory UNION ALL SELECT 'src5', TRUE
  UNION ALL SELECT path, FALSE FROM v2 WHERE doc_id % 97 = 0 AND NOT (path LIKE 'src3/en/%' OR path LIKE 'src5/%')
)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def version(spark: SparkSession, sf: str, v: int) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return spark.sql(_version(v, True).replace("documents", "{documents}"), documents=docs)


def scan(spark: SparkSession, sf: str) -> DataFrame:
    return version(spark, sf, 2).where(f"NOT {_HIDDEN}")


def unreadable(spark: SparkSession, sf: str) -> DataFrame:
    dirs = spark.createDataFrame([(d, True) for d in UNREADABLE_DIRS], "path string, is_directory boolean")
    files = version(spark, sf, 2).where("doc_id % 97 = 0 AND NOT (path LIKE 'src3/en/%' OR path LIKE 'src5/%')").select("path", F.lit(False).alias("is_directory"))
    return dirs.union(files)


#: Where version 1 keeps its contents: files of less than 3000 bytes are members of their directory's pack.
STORED_CTE = """
stored AS (
  SELECT CAST(1 AS BIGINT) AS version, path, kind, length, permissions, target, full_hash, head_hash, tail_hash,
    CASE WHEN kind <> 'file' OR length = 0 THEN NULL WHEN length < 3000 THEN 'pack' ELSE 'blob' END AS storage_kind,
    CASE WHEN kind <> 'file' OR length = 0 THEN NULL WHEN length < 3000 THEN replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', '-') ELSE 'data/' || full_hash END AS ref,
    CASE WHEN kind = 'file' AND length >= 3000 THEN CAST(1 + length // 5000 AS INTEGER) END AS volumes
  FROM v1
),
packs AS (
  SELECT ref AS pack_id, CAST(sum(length) + 100 * count(*) FILTER (WHERE length % 3 = 0) AS BIGINT) AS original_bytes, CAST(1 + count(*) // 8 AS INTEGER) AS volumes
  FROM stored WHERE storage_kind = 'pack' GROUP BY ref
),
references_ AS (
  SELECT DISTINCT CASE WHEN n <= 1 THEN base ELSE base || '.' || printf('%03d', i) END AS name, base FROM (
    SELECT base, n, unnest(range(1, greatest(n, 1) + 1)) AS i FROM (
      SELECT 'packs/' || pack_id || '.7z' AS base, volumes AS n FROM packs
      UNION SELECT ref, max(volumes) FROM stored WHERE storage_kind = 'blob' GROUP BY ref
      UNION ALL SELECT 'idx/1', 1 UNION ALL SELECT 'idx/2', 2 UNION ALL SELECT 'info', 1 UNION ALL SELECT 'info.enc', 1
    ))
),
objects AS (
  SELECT CASE WHEN name LIKE 'data/%3' AND name NOT LIKE '%.0%' THEN name || '.001' ELSE name END AS name, CAST(100 + length(name) AS BIGINT) AS size FROM references_ WHERE name NOT LIKE '%7.002'
  UNION ALL SELECT DISTINCT 'data/' || md5('orphan' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS BIGINT) FROM documents WHERE doc_id % 50 = 0
  UNION ALL SELECT DISTINCT 'packs/gone' || CAST(doc_id % 9 AS VARCHAR) || '.7z.' || printf('%03d', doc_id % 4 + 1), CAST(500 AS BIGINT) FROM documents WHERE doc_id % 31 = 0
)"""


def stored(spark: SparkSession, sf: str) -> DataFrame:
    file = (F.col("kind") == "file") & (F.col("length") > 0)
    return version(spark, sf, 1).select(
        F.lit(1).cast("long").alias("version"), "path", "kind", "length", "permissions", "target", "full_hash", "head_hash", "tail_hash",
        F.when(file, F.when(F.col("length") < 3000, "pack").otherwise("blob")).alias("storage_kind"),
        F.when(file, F.when(F.col("length") < 3000, F.replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("/"), F.lit("-"))).otherwise(F.concat(F.lit("data/"), F.col("full_hash")))).alias("ref"),
        F.when(file & (F.col("length") >= 3000), (1 + F.floor(F.col("length") / 5000)).cast("int")).alias("volumes"),
        F.lit(None).cast("string").alias("entry_name"), F.lit(None).cast("array<bigint>").alias("volume_sizes"),
    )


def packs(rows: DataFrame) -> DataFrame:
    return rows.where("storage_kind = 'pack'").groupBy(F.col("ref").alias("pack_id")).agg(
        (F.sum("length") + 100 * F.count_if(F.col("length") % 3 == 0)).alias("original_bytes"), (1 + F.floor(F.count(F.lit(1)) / 8)).cast("int").alias("volumes"), F.lit(None).cast("array<bigint>").alias("volume_sizes")
    )


def index_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "idx/1", 1), (2, "idx/2", 2)], "version long, index_blob string, index_volumes int")


def objects(spark: SparkSession, sf: str, references: DataFrame) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    there = references.where("name NOT LIKE '%7.002'").selectExpr("CASE WHEN name LIKE 'data/%3' AND name NOT LIKE '%.0%' THEN name || '.001' ELSE name END AS name", "CAST(100 + length(name) AS BIGINT) AS size")
    lost = docs.where("doc_id % 50 = 0").select(F.concat(F.lit("data/"), F.md5(F.concat(F.lit("orphan"), F.col("doc_id").cast("string")))).alias("name"), F.col("doc_id").cast("long").alias("size")).distinct()
    gone = docs.where("doc_id % 31 = 0").select(F.concat(F.lit("packs/gone"), (F.col("doc_id") % 9).cast("string"), F.lit(".7z."), F.format_string("%03d", F.col("doc_id") % 4 + 1)).alias("name"), F.lit(500).cast("long").alias("size")).distinct()
    return there.union(lost).union(gone)


#: The operation log, from events.
OPLOG_CTE = """
oplog AS (
  SELECT event_id AS id, ts, CAST(CASE WHEN event_type IN ('error', 'signup') THEN 3 ELSE 1 END AS INTEGER) AS level,
    'backup:' || CAST(user_id % 3 AS VARCHAR) || ':' || event_type AS source, props AS message, event_id % 4 <> 0 AS ephemeral
  FROM events
)"""


def oplog(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalars import event_level

    # the events of the table stand for notifications
    named = F.element_at(F.create_map(*[F.lit(x) for kv in (("error", "BackupFailure"), ("signup", "UnrecoverableError"), ("purchase", "BackupSuccess"), ("view", "CheckSuccess"), ("click", "RestoreSuccess")) for x in kv]), F.col("event_type"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", event_level(named).alias("level"), F.concat(F.lit("backup:"), (F.col("user_id") % 3).cast("string"), F.lit(":"), F.col("event_type")).alias("source"), F.col("props").alias("message"), (F.col("event_id") % 4 != 0).alias("ephemeral")
    )


#: Cumulative bytes by user over time, from events; one sample a millisecond and user.
SAMPLES_CTE = """
ticks AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS stage, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS ms, CAST(sum(CAST(abs(value) * 100 AS BIGINT)) AS BIGINT) AS step FROM events GROUP BY 1, 2
),
samples AS (SELECT stage, ms, CAST(sum(step) OVER (PARTITION BY stage ORDER BY ms) AS BIGINT) AS bytes FROM ticks)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return spark.sql(
        """SELECT stage, ms, sum(step) OVER (PARTITION BY stage ORDER BY ms) AS bytes FROM (
             SELECT 'u' || CAST(user_id AS STRING) AS stage, unix_micros(CAST(ts AS TIMESTAMP)) div 60000000 AS ms, sum(CAST(round(abs(value) * 100) AS BIGINT)) AS step
             FROM {events} GROUP BY 1, 2)""",
        events=events,
    )


#: Journals of three runs: version 1's files, in part, with some contents that have changed since.
JOURNAL_CTE = """
journal AS (
  SELECT 'run' || CAST(r AS VARCHAR) AS run_id, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL (r) DAY AS started_at, doc_id AS line_no, CASE WHEN length < 3000 THEN 'pack' ELSE 'blob' END AS kind,
    'ref' || CAST(r AS VARCHAR) || '-' || full_hash AS ref, path, full_hash, head_hash, tail_hash, length, CASE WHEN doc_id % 8 <> 0 THEN mtime_ticks END AS mtime_utc_ticks
  FROM v1, (SELECT unnest([1, 2, 3]) AS r) WHERE kind = 'file' AND doc_id % (r + 1) = 0
)"""


def journal(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        """SELECT 'run' || CAST(r AS STRING) AS run_id, TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(r) AS started_at, doc_id AS line_no, CASE WHEN length < 3000 THEN 'pack' ELSE 'blob' END AS kind,
             'ref' || CAST(r AS STRING) || '-' || full_hash AS ref, path, full_hash, head_hash, tail_hash, length, CASE WHEN doc_id % 8 <> 0 THEN mtime_ticks END AS mtime_utc_ticks
           FROM (SELECT *, explode(array(1, 2, 3)) AS r FROM {v1}) WHERE kind = 'file' AND doc_id % (r + 1) = 0""",
        v1=version(spark, sf, 1),
    )
