"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import read_table
from .shingles import mix

#: Features are hashed into this many coordinates; weights are one float for each, so a model has 1 MB at most.
BITS = 18
#: The fit reads at most this many labelled rows, those with the smallest hash of their id; all rows are scored.
MAX_LABELLED = 16_000
#: The sample may be dealt over several models whose weights are averaged; each fits its part in one task.
SHARDS = 1
EPOCHS = 8
#: L1 is this times the root of the number of rows: evidence that is chance grows with that root.
ALPHA, BETA, L1_RATE, L2 = 1.0, 1.0, 0.28, 1.0
#: Skip-grams leave out this many words.
SKIPS = (1,)
_STRIP = b".,;:!?\"'()[]{}<>|*#$%&"


class _Words(dict):
    """word (bytes) -> 64-bit hash of its lower-cased form without marks at its ends; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower().strip(_STRIP))
        return h


def features(text: str | None, words: _Words) -> np.ndarray:
    """Coordinates, with repeats, of a text's words, word pairs and pairs that skip a word."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    parts = [h]
    for gap in (1, *(1 + s for s in SKIPS)):
        if len(h) > gap:
            parts.append(mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap)))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) from rows of distinct coordinates. Rates fall per coordinate with the
    gradients seen there, and coordinates whose evidence stays under L1 have weight zero."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])
    l1 = np.full((1 << BITS) + 1, L1_RATE * len(rows) ** 0.5)
    l1[-1] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1[i], 0.0, w)

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            i = np.concatenate((x, bias))
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange((1 << BITS) + 1))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, shards, rows, labels, order = _Words(), [], [], [], []
    for batch in batches:
        for shard, place, text, label in zip(*batch.columns, strict=True):
            shards.append(shard.as_py())
            order.append(place.as_py())
            rows.append(np.unique(features(text.as_py(), words)))
            labels.append(label.as_py())
    for shard in sorted(set(shards)):
        mine = sorted((i for i in range(len(rows)) if shards[i] == shard), key=lambda i: (order[i], len(rows[i]), labels[i]))
        w = fit_ftrl([rows[i] for i in mine], np.array([labels[i] for i in mine], float))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["at", "weight"])


def _order(id_col: str):
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(7))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, shards: int = SHARDS) -> np.ndarray:
    """Weights from labelled rows; rows without a label are left out and null texts count as empty.

    The sample is the max_labelled rows with the smallest hash of their id, dealt by that hash over `shards` models
    that learn apart, each in one task; the mean of their weights is the model. Rows of one hash, repeated ids among
    them, are put in order by text and label, so that the sample is the same in every run. Without any row all weights are 0.
    Only the non-zero weights come to the driver.
    """
    sample = labelled.where(F.col(label_col).isNotNull()).select(_order(id_col).alias("place"), F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label")).orderBy("place", F.xxhash64("text"), "label").limit(max_labelled)
    dealt = sample.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", "text", "label").repartition(shards, "shard")
    w = np.zeros((1 << BITS) + 1)
    for r in dealt.mapInArrow(_fit, "at int, weight double").groupBy("at").agg(F.sum("weight").alias("weight")).collect():
        w[r.at] = r.weight / shards
    return w


def scorer(spark: SparkSession, weights: np.ndarray):
    """A function from a text Column to the probability of label 1, from the whole text alone. Each distinct feature counts
    once. Null texts score as empty ones, which is the bias alone."""
    blob = spark.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf(DoubleType())
    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, w = _Words(), blob.value
        for texts in parts:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                at = features(text.as_py(), words)
                at = np.unique(at[w[at] != 0])
                out[i] = np.float64(w[at].sum(dtype=np.float64) + w[-1])
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return probability


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col: the probability of label 1. An earlier column of that name is replaced."""
    return docs.drop(out_col).withColumn(out_col, scorer(docs.sparkSession, weights)(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def learned(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The model from the labelled documents that are not held out. The sample is drawn from the labels, so what is
    broadcast are MAX_LABELLED ids at most, and no text moves but those of the sample."""
    labels = read_table(spark, sf_dir, "labels").where("toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labels.orderBy(_order("doc_id"), "doc_id").limit(MAX_LABELLED)
    return train(read_table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(sample), "doc_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learned(spark, sf_dir)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES = {}
