"""Benchmark decontamination: training words streamed through a suffix automaton of the test items."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .suffix_automaton import SuffixAutomaton, words_of

WINDOW = 10
#: An automaton holds about this many words of items (about 100 MB in a task); more items make more automata, and each is a
#: pass over docs.
MAX_WORDS = 200_000
#: Items longer than this are cut into pieces that overlap by WINDOW - 1 words, so no window is lost.
PIECE_WORDS = 50_000
#: The same words in a text whose A-Z are not lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOUND = "n_words long, hits array<struct<first:int,last:int>>, items array<string>, longest int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers, texts, sizes = [], [], [], []
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            words = words_of(text.as_py())
            for k, at in enumerate(range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS - WINDOW + 1)):
                part = words[at : at + PIECE_WORDS]
                if part:
                    ids.append(key.as_py())
                    numbers.append(k)
                    texts.append(b" ".join(part))
                    sizes.append(len(part))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], ["item_id", "piece", "words", "n"])


def _build(table: pa.Table) -> pa.Table:
    """The automaton of one shard's pieces, pickled."""
    rows = sorted(zip(table.column("item_id").to_pylist(), table.column("piece").to_pylist(), table.column("words").to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1], r[2]))
    blob = pickle.dumps(SuffixAutomaton([(key, words.split()) for key, _, words in rows], WINDOW), protocol=5)
    return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([blob], pa.binary())})


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(shard, blob): pickled automata over all items, each of about max_words words, built in tasks and written.

    Pieces are dealt by a hash of their words too, over as many shards as the count of all words asks for.
    """
    pieces = written(items.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(_pieces, "item_id string, piece int, words binary, n long"), "items")
    # a piece that an item has several times, or that items without an id share, says no more than once
    pieces = pieces.dropDuplicates(["item_id", "piece", "words"])
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // max_words)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece", "words"), F.lit(max(1, shards))).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(_build, "shard int, blob binary"), "automata")


def _scan(blob, min_run: int | None = None):
    """Adds what one automaton finds to what earlier ones have found; with min_run, runs of so many hit words are then
    cut out of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(blob.value)
        for batch in batches:
            names = batch.schema.names
            text, hits, items, longest = (batch.column(names.index(c)) for c in ("text", "hits", "items", "longest"))
            n_words, all_hits, all_items, all_longest, clean = [], [], [], [], []
            for t, h, k, m in zip(text, hits, items, longest, strict=True):
                words = words_of(t.as_py())
                spans, keys, best = automaton.matches(words)
                if before := h.as_py():
                    spans = _united([[x["first"], x["last"] + 1] for x in before] + spans)
                n_words.append(len(words))
                all_hits.append([{"first": a, "last": b - 1} for a, b in spans])
                all_items.append(sorted({*(k.as_py() or ()), *(x for x in keys if x is not None)}))
                all_longest.append(max(best, m.as_py() or 0))
                if min_run is not None:
                    clean.append(_without(t.as_py(), [x for x in spans if x[1] - x[0] >= min_run]))
            new = {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(all_hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), "items": pa.array(all_items, pa.list_(pa.string())), "longest": pa.array(all_longest, pa.int32())}
            if min_run is not None:
                new["text"] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    return scan


def _united(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _without(text: str | None, runs: list[list[int]]) -> str | None:
    """The text without the given [start, end) runs of words; what stood around a removed run is parted by one space."""
    if not runs:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    parts, done = [], 0
    for first, end in runs:
        parts.append(text[done : at[first][0]])
        done = at[end - 1][1]
    parts.append(text[done:])
    return " ".join(p.strip() for p in parts if p.strip())


def _scanned(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, max_words: int, min_run: int | None) -> DataFrame:
    """(doc, text, n_words, hits, items, longest): docs in one struct, where no name can clash, its text, and what is found.
    One automaton at a time comes to the driver and is broadcast; its size is bounded by max_words and a piece."""
    spark = docs.sparkSession
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    out = docs.select(rest.alias("doc"), F.col(text_col).alias("text")).selectExpr("doc", "text", "0L as n_words", "cast(array() as array<struct<first:int,last:int>>) as hits", "cast(array() as array<string>) as items", "0 as longest")
    built = automata(items, item_col, item_text_col, max_words)
    shards = [r.shard for r in built.select("shard").orderBy("shard").collect()]
    for k, shard in enumerate(shards or [None]):
        if k:
            out = written(out, "contamination")
        blob = pickle.dumps(SuffixAutomaton([], WINDOW)) if shard is None else bytes(built.where(F.col("shard") == shard).first().blob)
        cut = min_run if k == max(1, len(shards)) - 1 else None
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(blob), cut), f"doc {out.schema['doc'].dataType.simpleString()}, text string, {_FOUND}")
    return out


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS, min_run: int | None = None) -> DataFrame:
    """docs with a struct column `contamination`: n_words, hits (first and last word of each maximal run of words
    that windows cover), items (sorted ids of the items with occurring windows) and longest (the longest match).

    A window is WINDOW consecutive words of an item, or a whole shorter item. Null texts and texts or items without
    words have no windows. Items with a null id mark words but are not listed. An earlier column `contamination` is
    replaced. With min_run, runs of at least so many hit words are cut out of the text, in the same pass. One pass
    over docs for each automaton, no shuffle; between passes the rows are written.
    """
    docs = docs.drop("contamination")
    out = _scanned(docs, items, text_col, item_col, item_text_col, max_words, min_run)
    named = [F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns]
    return out.select(*named, F.struct("n_words", "hits", "items", "longest").alias("contamination"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", min_run: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs without contamination, with the same columns: runs of at least min_run hit words are cut out of the text,
    and documents of which hit words are more than max_coverage go. Rows without hits stay as they are."""
    found = _scanned(docs, items, text_col, "item_id", "text", MAX_WORDS, min_run)
    n_hit = hit_words(F.struct("hits"))
    kept = found.where((n_hit <= max_coverage * F.col("n_words")) | (n_hit == 0))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])


def hit_words(contamination: Column) -> Column:
    return F.aggregate(contamination["hits"], F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    c = F.col("contamination")
    return (
        find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
        .select("doc_id", c["n_words"].alias("n_words"), hit_words(c).alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS k, array_to_string(w[s : s + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)
),
m AS (SELECT doc_id, item_id, s, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
}
