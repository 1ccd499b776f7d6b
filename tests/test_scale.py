"""Numbering over ranges, joins on hot keys, and packs and reports by searched sums, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import metrics, oplog, packs, scale


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v long")
    seen = {}
    for r in sorted(scale.sum_before(df, ["g"], ["o"], "v").collect(), key=lambda r: (r.g or "", r.o, r.before, r.v)):
        assert r.before == seen.get(r.g, 0)
        seen[r.g] = r.before + r.v
    numbers = sorted((r.g or "", r.n) for r in scale.sum_before(df, ["g"], ["o"], out="n").collect())
    assert numbers == sorted((g, i) for g in ("", "a", "b") for i in range(sum((x[0] or "") == g for x in rows)))
    assert scale.sum_before(df.limit(0), [], ["o"]).collect() == []


@pytest.mark.parametrize("hot", [1, 40, 1000])
def test_join_on_hot_keys(spark, hot):
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 20}", i) for i in range(200)]
    each = {k: f"v{k}" for k, _ in rows if k and k != "k4"}
    df = spark.createDataFrame(rows, "k string, i long")
    out = scale.join_each(df, spark.createDataFrame(list(each.items()), "k string, v string"), ["k"], "i", hot_rows=hot, copies=5)
    assert sorted((r.i, r.k, r.v) for r in out.collect()) == sorted((i, k, each.get(k)) for k, i in rows)


@pytest.mark.parametrize("side", [3, 10, 1000])
def test_join_of_pairs(spark, side):
    left = [("hot" if i % 2 else None if i % 7 == 0 else f"k{i % 20}", i // 2) for i in range(100)]
    right = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 15}", f"m{i % 50}") for i in range(120)]
    out = scale.join_pairs(spark.createDataFrame(left, "k string, i long"), spark.createDataFrame(right, "k string, m string"), ["k"], side)
    assert out.columns == ["k", "i", "m"]
    assert sorted(map(tuple, out.collect())) == sorted((k, i, m) for k, i in left for j, m in right if k is not None and j == k)


def test_targets_of_one_large_group(spark):
    """16 million pairs from files of one task each."""
    tasks = spark.range(4000).select(F.col("id").alias("task_id"), F.lit(None).cast("string").alias("target"), F.lit(1).alias("group_id")).coalesce(1)
    members = spark.range(4000).select(F.lit(1).alias("group_id"), F.format_string("m%04d", "id").alias("member")).coalesce(1)
    by_task = [r["count"] for r in oplog.resolve_targets(tasks, members).groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert sum(by_task) == 16_000_000 and max(by_task) < 12_000_000


def test_pairs_of_equal_rows_are_dealt(spark):
    """A million pairs of rows that no hash tells apart."""
    left = spark.range(1000).select(F.lit("hot").alias("k"), F.lit(7).alias("i"))
    right = spark.range(1000).select(F.lit("hot").alias("k"), F.lit("m").alias("m"))
    out = scale.join_pairs(left, right, ["k"], 100).groupBy("k", "i", "m", F.spark_partition_id().alias("at")).count().collect()
    assert {(r.k, r.i, r.m) for r in out} == {("hot", 7, "m")}
    assert sum(r["count"] for r in out) == 1_000_000 and max(r["count"] for r in out) < 200_000


def test_packs_by_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), f"p{i:04d}{'x' * rng.randrange(5)}", rng.choice([0, 1, 5, 30, 200])) for i in range(600)]
    df = spark.createDataFrame(rows, "dir string, path string, length long")
    want, state = {}, {}
    for d, path, n in sorted(rows):
        pack, total, members, names = state.get(d, (0, 0, 0, 0))
        size = len(path) + 1
        if members and (total + n > 100 or members + 1 > 6 or names + size > 40):
            pack, total, members, names = pack + 1, 0, 0, 0
        state[d] = pack, total + n, members + 1, names + size
        want[path] = pack
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.path: r.pack for r in packs.greedy_packs(df, ["dir"], 100, 6, 40).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_throttle_by_a_plain_loop(spark):
    rng = random.Random(3)
    rows = sorted((rng.choice("abc"), rng.randrange(20_000), rng.random() < 0.05) for _ in range(800))
    want, last = [], {}
    for stage, ms, forced in sorted(rows, key=lambda r: r[:2]):
        if forced or stage not in last or ms - last[stage] >= 200:
            last[stage] = ms
            want.append((stage, ms))
    df = spark.createDataFrame([r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]], "stage string, ms long, forced boolean")
    kept = {(s, m): f for s, m, f in reversed(rows)}
    want, last = [], {}
    for (stage, ms), forced in sorted(kept.items()):
        if forced or stage not in last or ms - last[stage] >= 200:
            last[stage] = ms
            want.append((stage, ms))
    assert sorted((r.stage, r.ms) for r in metrics.throttle(df).select("stage", "ms").collect()) == want
    assert metrics.throttle(df.where(F.lit(False))).collect() == []
