"""Schedules and texts: known answers and edges."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import schedule, texts


@pytest.mark.parametrize(
    "cron,after,zone,want",
    [
        ("0 9 * * *", "2026-07-17 10:00:00", "UTC", "2026-07-18 09:00:00"),
        ("0 9 * * *", "2026-07-17 09:00:00", "UTC", "2026-07-18 09:00:00"),
        ("0 9 * * *", "2026-07-17 08:59:59", "UTC", "2026-07-17 09:00:00"),
        ("* * * * *", "2026-12-31 23:59:30", "UTC", "2027-01-01 00:00:00"),
        ("0 0 29 feb *", "2024-02-29 00:00:00", "UTC", "2028-02-29 00:00:00"),
        ("5/20 8-10/2 * * 7", "2024-01-01 00:00:00", "UTC", "2024-01-07 08:05:00"),
        ("0 0 13 * FRI", "2024-01-01 00:00:00", "UTC", "2024-09-13 00:00:00"),
        ("0 9 * * *", "2026-07-17 00:30:00", "Asia/Shanghai", "2026-07-17 01:00:00"),
        ("0 9 ? * *", "2026-07-17 01:00:00", "Asia/Shanghai", "2026-07-18 01:00:00"),
        ("0 0 30 2 *", "2024-01-01 00:00:00", "UTC", None),
        ("not a cron", "2024-01-01 00:00:00", "UTC", None),
        ("60 * * * *", "2024-01-01 00:00:00", "UTC", None),
        ("5-1 * * * *", "2024-01-01 00:00:00", "UTC", None),
        ("*/0 * * * *", "2024-01-01 00:00:00", "UTC", None),
        ("1,,2 * * * *", "2024-01-01 00:00:00", "UTC", None),
        ("0 0 * * * *", "2024-01-01 00:00:00", "UTC", None),
        (None, "2024-01-01 00:00:00", "UTC", None),
    ],
)
def test_next_occurrence(spark, cron, after, zone, want):
    row = spark.createDataFrame([(cron, after)], "cron string, after string")
    got = row.select(schedule.next_occurrence(F.col("cron"), F.col("after").cast("timestamp_ntz"), zone).cast("string").alias("at")).first().at
    assert got == want


def test_next_occurrence_by_a_plain_loop(spark):
    rng = random.Random(4)
    allowed = lambda text, low, high: {v for p in text.split(",") for v in (range(low, high + 1) if p == "*" else range(int(p.split("-")[0]), int(p.split("-")[-1]) + 1))}
    rows, want = [], {}
    for i in range(400):
        cron = [rng.choice(["*", "0", "7,30-40,8"]), rng.choice(["*", "23", "5,0-2"]), rng.choice(["*", "29", "31", "1,15", "28-31"]), rng.choice(["*", "2", "2", "4,12", "6-8"]), rng.choice(["*", "0", "7", "1-5", "6"])]
        after = datetime(rng.choice([2023, 2024, 2095, 2096]), rng.randint(1, 12), rng.choice([1, 15, 28]), rng.randrange(24), rng.randrange(60), rng.randrange(60)) + timedelta(days=rng.randrange(4))
        minutes, hours, days, months, week = (allowed(c, *r) for c, r in zip(cron, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
        times = sorted(h * 60 + m for h in hours for m in minutes)
        day, found = datetime(after.year, after.month, after.day), None
        for k in range(schedule.HORIZON_DAYS + 1):
            on = day + timedelta(days=k)
            if on.month in months and on.day in days and on.isoweekday() % 7 in {w % 7 for w in week}:
                found = next((on + timedelta(minutes=t) for t in times if k or t > after.hour * 60 + after.minute), None)
                if found:
                    break
        rows.append((i, " ".join(cron), after))
        want[i] = found
    df = spark.createDataFrame(rows, "i int, cron string, after timestamp_ntz")
    assert {r.i: r.at for r in df.select("i", schedule.next_occurrence(F.col("cron"), F.col("after")).alias("at")).collect()} == want
    assert None in want.values()


def test_next_occurrence_of_many_rows(spark):
    """A search by days would look at 500 million of them here."""
    rows = spark.range(170_000).select(F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-01 10:30:00").cast("timestamp_ntz")).alias("after"))
    began = time.monotonic()
    late = rows.where(schedule.next_occurrence(F.lit("15 9 * * MON-FRI"), F.col("after")) > F.col("after") + F.expr("interval 72 hours")).count()
    assert late == 0 and time.monotonic() - began < 60


def test_due_tasks(spark):
    rows = [(True, "2026-07-16 09:00:00", "x"), (False, "2026-07-16 09:00:00", "x"), (True, "2026-07-17 09:00:00", "x"), (True, None, "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "enabled boolean, last string, x string")
    due = schedule.is_due(F.col("enabled"), F.lit("0 9 * * *"), F.col("last").cast("timestamp_ntz"), F.lit("2026-07-16 00:00:00").cast("timestamp_ntz"), F.lit("2026-07-17 12:00:00").cast("timestamp_ntz"))
    assert [r.due for r in df.select(due.alias("due")).collect()] == [True, False, False, True, False]


def test_offsets_follow_the_clock_change(spark):
    rows = spark.createDataFrame([("2024-01-15 12:00:00",), ("2024-07-15 12:00:00",), (None,)], "ts string").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    got = [r.o for r in rows.select(texts.utc_offset(F.col("ts"), "America/St_Johns").alias("o")).collect()]
    assert got[:2] == ["UTC-03:30", "UTC-02:30"]


def test_templates_take_marks_of_patterns_as_they_are(spark):
    row = spark.createDataFrame([("a\\$1\n\"é",)], "t string")
    filled = texts.fill_template(F.lit("{TITLE}|{titleRaw}|{Body}"), F.col("t"), F.lit("*~ +"), "json")
    assert row.select(filled.alias("x")).first().x == 'a\\\\$1\\n\\"é|a\\$1\n"é|*~ +'
    assert row.select(texts.url_escaped(F.lit("*~ +é")).alias("x")).first().x == "%2A~%20%2B%C3%A9"


def test_summary_leaves_zeros_out(spark):
    zero = F.lit(0).cast("long")
    one = spark.range(1)
    quiet = texts.run_summary(F.lit(3), zero, zero, zero, zero, zero, zero, zero, texts.retention_line(zero, zero, zero, zero), F.lit(None).cast("string"))
    assert one.select(quiet.alias("x")).first().x == "Version 3\nFiles: no changes"
    freed = texts.retention_line(zero, zero, F.lit(4), F.lit(1_200_000_000))
    assert one.select(freed.alias("x")).first().x == "Retention: deleted 4 blob(s), freed 1.2 GB"
