"""Packing into length buckets whose bounds a dynamic program chooses, and batches of a token budget inside them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import columns_free_of, read_table, written

BUCKETS = 16
#: Tokens of a batch, padding included. A document that is longer makes a batch of its own.
TOKEN_BUDGET = 65_536
#: The histogram comes to the driver: one row for each length that occurs, 24 bytes each. More lengths than this fail.
MAX_LENGTHS = 2_000_000
_ADDED = ["n_tokens", "bucket", "bucket_tokens", "batch", "place"]


@F.pandas_udf(LongType())
def word_tokens(text: pd.Series) -> pd.Series:
    """Tokens of a text: its words, parted by space, tab, LF, VT, FF and CR, and one end mark. Null counts as empty."""
    return pd.Series([len((t or "").encode("utf-8", "surrogatepass").split()) + 1 for t in text], dtype="int64")


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int) -> tuple[list[int], int]:
    """(upper bounds of at most `buckets` buckets, tokens of padding): the bounds under which padding every row up to
    its bucket's bound costs least. histogram: (length, rows), lengths ascending.

    With C and T the running counts of rows and tokens, a bucket over (i, j] costs L[j] (C[j] - C[i]) - (T[j] - T[i]):
    for each j the best i is a lowest of lines with slopes -C[i] at L[j], which a hull of lines gives in turn, so the
    program takes buckets x lengths steps.
    """
    if not histogram:
        return [], 0
    lengths = [x for x, _ in histogram]
    count, tokens = [0], [0]
    for x, rows in histogram:
        count.append(count[-1] + rows)
        tokens.append(tokens[-1] + x * rows)
    m = len(lengths)
    best = [0] + [float("inf")] * m
    came: list[list[int]] = []
    for _ in range(min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        head, now, back = 0, [float("inf")] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            if best[j - 1] != float("inf"):
                k, h = -count[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) - head >= 2:
                    (k1, h1, _), (k2, h2, _) = hull[-2], hull[-1]
                    if (h - h1) * (k1 - k2) > (h2 - h1) * (k1 - k):
                        break
                    hull.pop()
                hull.append((k, h, j - 1))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if head < len(hull):
                k, h, i = hull[head]
                now[j], back[j] = k * x + h + x * count[j] - tokens[j], i
        came.append(back)
        best = now
        if best[m] == 0:
            break
    bounds, j = [], m
    for back in reversed(came):
        bounds.append(lengths[j - 1])
        j = back[j]
    return bounds[::-1], int(best[m])


def pack(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """docs with n_tokens, bucket (from 0), bucket_tokens (the length to pad to), batch (from 0 in each bucket) and
    place (from 0 in its batch).

    Rows of a bucket are numbered by id, then by length, and every max(1, budget div bucket_tokens) of them make a
    batch. Rows are dealt over ranges of (bucket, id, length), whatever the ids' type and however they are spread, and
    written in that order; a row's number is its place in its range and the count of its bucket's rows in the ranges
    before, of which there is one row for each range and bucket. Equal ids and lengths are parted by a hash and by the
    rows' place in the input, so that no range has to hold all of them. Nulls: a null text has the end mark only, null
    ids stand first; rows that are alike in id and length take their numbers in any order. Documents longer than the
    budget are batches of one. Empty tables give no rows. Columns of docs with the names of the added ones are replaced.
    """
    names = columns_free_of(docs, _ADDED).columns
    # the columns of docs travel in one struct, where no name can clash with those of the steps
    doc = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("doc")
    sized = docs.select(doc, F.col(id_col).alias("id"), (tokens if tokens is not None else word_tokens(F.col(text_col))).alias("n_tokens"))
    own = [F.col(f"doc.`{c}`") for c in names]
    histogram = sized.groupBy("n_tokens").count().limit(MAX_LENGTHS + 1).collect()
    if len(histogram) > MAX_LENGTHS:
        raise ValueError(f"more than {MAX_LENGTHS} different lengths: round n_tokens up first")
    bounds, _ = optimal_bounds(sorted((r[0], r[1]) for r in histogram), buckets)
    if not bounds:
        return sized.select(*own, "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_tokens", "long"), ("batch", "long"), ("place", "long"))])
    upper = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = reduce(lambda a, b: a + b, [(F.col("n_tokens") > b).cast("int") for b in bounds])
    placed = sized.withColumn("bucket", bucket).withColumn("row", F.monotonically_increasing_id())
    order = ["bucket", F.col("id").asc_nulls_first(), "n_tokens", F.xxhash64("row"), "row"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("row", "id").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered, "packing")
    part = F.shiftright("at", 33)  # the number of the range is in the high bits
    ranges = ordered.groupBy(part.alias("part"), "bucket").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = ranges.select("part", "bucket", "first", (F.sum("rows").over(Window.partitionBy("bucket").orderBy("part")) - F.col("rows")).alias("before"))
    rows = F.greatest(F.lit(1), F.expr(f"{budget} div bucket_tokens"))
    return (
        ordered.withColumn("part", part)
        .join(F.broadcast(before), ["part", "bucket"])  # one row for each range and bucket
        .withColumn("number", F.col("before") + F.col("at") - F.col("first"))
        .withColumn("bucket_tokens", F.element_at(upper, F.col("bucket") + 1))
        .withColumn("batch", F.floor(F.col("number") / rows))
        .withColumn("place", F.col("number") % rows)
        .select(*own, "n_tokens", "bucket", "bucket_tokens", "batch", "place")
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", word_tokens(F.col("text")).alias("size"))
    return pack(docs, F.col("size")).drop("size")


QUERIES = {"op5_packing": op5_packing}
ORACLES = {}
