"""Progress: rolling speed, time to go, throttled reports, ledgers and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import sum_before

WINDOW_MS, QUIET_MS, MAX_SAMPLES = 10_000, 200, 256


def rolling_speed(samples: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """samples(stage, ms, bytes) with speed: bytes a second since the oldest of the last MAX_SAMPLES samples that is not
    older than window_ms, whole numbers; 0 where the clock has not moved. Bytes are running totals, so they tell the
    order of samples of one ms."""
    sample = F.struct("ms", "bytes")
    recent = F.min(sample).over(Window.partitionBy("stage").orderBy("ms").rangeBetween(-window_ms, 0))
    held = F.min(sample).over(Window.partitionBy("stage").orderBy("ms", "bytes").rowsBetween(1 - MAX_SAMPLES, 0))
    oldest = samples.withColumn("_o", F.greatest(recent, held))
    return oldest.withColumn("speed", F.when(F.col("ms") > F.col("_o.ms"), F.expr("(bytes - _o.bytes) * 1000 div (ms - _o.ms)")).otherwise(F.lit(0).cast("long"))).drop("_o")


def time_to_go(samples: DataFrame) -> DataFrame:
    """samples(stage, ms, bytes, total) with eta_ms: elapsed * remaining / done; null unless the total is known and
    0 < done < total."""
    known = F.col("total").isNotNull() & (F.col("bytes") > 0) & (F.col("bytes") < F.col("total"))
    return samples.withColumn("eta_ms", F.when(known, F.expr("ms * (total - bytes) div bytes")))


def throttle(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """events(stage, ms, forced) that are emitted: forced, or quiet_ms after the last emitted one of their stage. What
    counts is the last emission, so each stage is one sorted run of which a task keeps one number."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stage, last = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            names, ms, forced = batch["stage"].to_numpy(), batch["ms"].to_numpy(), np.flatnonzero(batch["forced"].fillna(False).to_numpy(bool))
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))).tolist() if len(batch) else []
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                if names[start] != stage:
                    stage, last = names[start], None
                i = start
                while i < end:  # from one emitted event to the next
                    due = i if last is None else i + int(np.searchsorted(ms[i:end], last + quiet_ms, "left"))
                    k = int(np.searchsorted(forced, i, "left"))
                    i = min(due, int(forced[k]) if k < len(forced) else end)
                    if i >= end:
                        break
                    keep[i], last = True, ms[i]
                    i += 1
            yield batch[keep]

    return events.repartition("stage").sortWithinPartitions("stage", "ms").mapInPandas(run, schema)


def ledger(items: DataFrame) -> DataFrame:
    """(stage, total, pending, running, done, failed, balanced): items by state, and whether the states add up."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("pending", "running", "done", "failed")]
    out = items.groupBy("stage").agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumn("balanced", F.col("total") == F.col("pending") + F.col("running") + F.col("done") + F.col("failed"))


def sample_quotas(sizes: dict[int, int], cap: int) -> dict[int, int]:
    """How many of each bucket: in proportion, one at least, together at most cap; what is over is taken back from the
    fattest, what is left is given to those with most to spare."""
    total = sum(sizes.values())
    if total <= cap:
        return dict(sizes)
    out = {b: min(n, max(1, cap * n // total)) for b, n in sizes.items() if n}
    while sum(out.values()) > cap:
        fattest = max(out, key=lambda b: (out[b], -b))
        out[fattest] -= 1
    while sum(out.values()) < cap:
        spare = max(out, key=lambda b: (sizes[b] - out[b], -b))
        out[spare] += 1
    return out


def stratified_sample(rows: DataFrame, bucket: str, order: str, cap: int = 200) -> DataFrame:
    """At most cap rows, evenly by `order` within each of a few buckets; the counts of the buckets are all that comes to
    the driver. A row is taken if it is the i * size div quota -th of its bucket for some i."""
    sizes = {r[0]: r[1] for r in rows.groupBy(bucket).count().collect()}
    quotas = sample_quotas(sizes, cap)
    quota = F.create_map(*[F.lit(x) for b in sizes for x in (b, quotas.get(b, 0))]) if sizes else None
    if quota is None:
        return rows
    n = F.create_map(*[F.lit(x) for b in sizes for x in (b, sizes[b])])
    numbered = sum_before(rows, [bucket], [order], out="_n").withColumn("_q", quota[F.col(bucket)]).withColumn("_s", n[F.col(bucket)])
    # the next multiple of size / quota at or after the row falls on it
    return numbered.where(F.expr("_q > 0 AND ((_n * _q + _s - 1) div _s) < _q AND (((_n * _q + _s - 1) div _s) * _s) div _q = _n")).drop("_n", "_q", "_s")


def sampled_match(sample: DataFrame, local: DataFrame, examples: int = 10) -> DataFrame:
    """One row: how many sampled entries the local files have alike, by path, length and time, the rate and the verdict:
    from 0.95 on ok, from 0.05 on to be confirmed, else rejected."""
    mine = local.select("path", F.col("length").alias("_l"), F.col("mtime_ticks").alias("_t"))
    joined = sample.join(mine, "path", "left")
    missing, size = F.col("_l").isNull(), F.col("_l") != F.col("length")
    late = ~size & (F.abs(F.col("_t") - F.col("mtime_ticks")) > 10_000_000)
    matched = F.count_if(~missing & ~size)
    out = joined.agg(
        F.count(F.lit(1)).alias("sampled"),
        matched.alias("matched"),
        F.count_if(missing).alias("missing"),
        F.count_if(size).alias("size_differs"),
        F.count_if(late).alias("time_differs"),
    )
    # the least paths first: only these are gathered
    first = joined.where(missing | size).select("path").orderBy("path").limit(examples).agg(F.sort_array(F.collect_list("path")).alias("examples"))
    out = out.crossJoin(first)  # one row each
    rate = F.when(F.col("sampled") == 0, 0.0).otherwise(F.round(F.col("matched") / F.col("sampled"), 6))
    return out.withColumn("rate", rate).withColumn("verdict", F.when(F.col("rate") >= 0.95, "ok").when(F.col("rate") >= 0.05, "confirm").otherwise("reject"))
