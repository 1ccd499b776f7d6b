"""Substring dedup by content-defined chunks, cut by a gear rolling hash, of which each digest is kept once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .shingles import mix

#: Chunks end at the smallest rolling hash of each stretch of MAX bytes, so they have MIN to MAX bytes, about 29 in the
#: mean. Where two texts have the same L bytes, their ends are the same from _REACH + MAX bytes after the passage's
#: start to MAX bytes before its end: L - 2 * MAX - _REACH bytes or more are whole chunks of both.
MIN, MAX = 1, 56
#: Repeated chunks are taken out where a run of them has this many bytes at least.
MIN_RUN = 128
#: The hash looks back over this many bytes, so equal bytes have equal hashes from there on.
_REACH = 8
_GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data: [end, ...], the last is len(data)."""
    size = len(data)
    if size <= MAX:
        return [size] if size else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    # h[i] = sum of gear[byte i - k] << k over the last _REACH bytes, by doubling
    reach = 1
    while reach < _REACH:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    # key[i] = (hash, place) of the smallest hash in the MAX places from i on, by doubling; the first place wins ties
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(size, dtype=np.uint64)
    width = 1
    while width < MAX:
        step = min(width, MAX - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    key = key[np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))]
    places, hashes = (key & np.uint64(0xFFFFFFFF)).astype(np.int64).tolist(), (key >> np.uint64(32)).tolist()
    out, before = [], -1
    for place, value in zip(places, hashes, strict=True):
        # in runs of one byte all hashes are alike: these are cut each MAX bytes
        if value == before and place + 1 - out[-1] < MAX:
            continue
        out.append(place + 1)
        before = value
    if out[-1] < size:
        out.append(size)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, numbers, ends, sizes, digests = [], [], [], [], []

        def table(batch=batch):
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(ends, pa.int32()), pa.array(sizes, pa.int32()), *(pa.array(x) for x in np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T.copy())],
                ["id", "chunk", "ending", "size", "h1", "h2"],
            )

        for row, text in enumerate(batch.column(1)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            at = 0
            for number, end in enumerate(cuts(data)):
                rows.append(row)
                numbers.append(number)
                ends.append(end)
                sizes.append(end - at)
                digests.append(xxhash.xxh3_128_digest(data[at:end]))
                at = end
            if len(rows) > 100_000:
                yield table()
                rows, numbers, ends, sizes, digests = [], [], [], [], []
        if rows:
            yield table()


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, ending, size, h1, h2): the chunks of each text in order, by UTF-8 bytes; h1 and h2 are the digest."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_chunks, f"id {own.schema['id'].dataType.simpleString()}, chunk int, ending int, size int, h1 long, h2 long")


#: Chunks of a digest that are dealt over copies of its row once it has so many.
HOT_ROWS, COPIES = 1_000_000, 64


def _with_key(chunks: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """chunks JOIN per_key USING keys; n is a key's number of chunks. A digest that a large part of all chunks have is dealt
    over COPIES tasks: there are at most chunks / HOT_ROWS such digests, which are broadcast to mark their chunks."""
    hot = F.broadcast(per_key.where(F.col("n") >= HOT_ROWS).select(*keys, F.lit(True).alias("hot")))
    left = chunks.join(hot, keys, "left").withColumn("copy", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "chunk"), F.lit(COPIES))).otherwise(0).cast("int")).drop("hot")
    copies = F.when(F.col("n") >= HOT_ROWS, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    return left.join(per_key.withColumn("copy", F.explode(copies)), [*keys, "copy"]).drop("copy")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(id, spans): for each document with repeated text the [start, end) UTF-8 byte spans to take out, in order.

    The first place of a digest, by id and chunk number, is kept; later places are repeats. Spans are runs of
    consecutive repeats of min_run bytes or more. Digests are counted before anything is joined, and the chunks of one that
    a third of all documents have are dealt over several tasks. Texts are chunked twice, which costs less than storing all chunks. Rows with equal ids count as one document's rows: the same chunk
    of a repeated row is the kept place, not a repeat. Rows with a null id have no spans and keep no digest.
    """
    chunks = chunk_table(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    # half digests that occur once, nearly all, go first; what is left is compared by whole digests
    twice = written(chunks.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    some = written(_with_key(chunks, twice, ["h1"]).select(chunks.columns), "chunks")
    place = F.struct("id", "chunk")
    first = some.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("h1", "h2", "low", "n")
    repeats = _with_key(some, first, ["h1", "h2"]).where(place != F.col("low")).select("id", "chunk", "ending", "size").distinct()
    runs = (
        repeats.selectExpr("id", "ending", "size", "chunk - row_number() OVER (PARTITION BY id ORDER BY chunk) AS run")
        .groupBy("id", "run")
        .agg((F.min(F.col("ending") - F.col("size"))).alias("start"), F.max("ending").alias("end"))
        .where(F.col("end") - F.col("start") >= min_run)
    )
    return runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans; a character that a span's end would split is kept whole."""
    for batch in batches:
        out, taken = [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text, spans = text.as_py(), spans.as_py()
            removed = 0
            if text is not None and spans:
                data, parts, done = text.encode("utf-8", "surrogatepass"), [], 0
                for s in spans:
                    a, b = s["start"], s["end"]
                    while a < len(data) and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    if b > a:
                        parts.append(data[done:a])
                        done, removed = b, removed + b - a
                text = b"".join([*parts, data[done:]]).decode("utf-8", "surrogatepass")
            out.append(text)
            taken.append(removed)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(taken, pa.int64())], ["doc", "text", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """docs with the repeated spans cut out of text_col, and removed_bytes (0 where nothing was).

    Null and empty texts stay as they are, as do texts of rows with a null id; empty tables give no rows. A column
    removed_bytes of docs is replaced.
    """
    docs = docs.drop("removed_bytes")
    spans = repeated_spans(docs, id_col, text_col, min_run).withColumnRenamed("id", "_id").withColumnRenamed("spans", "_spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"))
    packed = rows.join(spans, "_id", "left").select("doc", "text", "_spans")
    done = packed.mapInArrow(_cut_out, f"doc {packed.schema['doc'].dataType.simpleString()}, text string, removed long")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns], F.col("removed").alias("removed_bytes"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: bytes, bytes removed, the number of removed spans, and the spans themselves."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeated_spans(docs)
    listed = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).join(spans, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long")).alias("repeated_bytes"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(listed, F.lit("")).alias("spans"),
    )


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {}
