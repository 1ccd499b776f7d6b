"""Each stage of the corpus pipeline on edge cases, and the whole of it against the operators' brute-force versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm.toxicity import op8_toxicity

from .test_decontaminate import brute as brute_windows
from .test_near_dedup import brute as brute_components
from .test_pii import brute as brute_base

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ["_toxicity", "contamination", "score", "doc", "spans", "node", "id", "hits", "n", "key", "text_", "row", "at"]


def edge_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = " ".join(f"c{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, clean), (3, clean), (4, clean), (None, clean), (None, "quite another text of several words here"), (5, f"{clean} x{item}"), (6, f"{clean} {item} mail a@b.cd"), (7, "w " * 200_000), (8, "mail a@b.cd now"), (9, " \t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(7 as bigint) AS n_chars")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in EXTRA])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_edges(spark, name):
    df = edge_rows(spark)
    rows = STAGES[name](spark, df, SF).collect()
    if name == "packing":
        assert len(rows) == df.count() and {"doc_id", "text", "n_tokens", "bucket", "batch", "place"} <= set(rows[0].asDict())
    else:
        assert set(df.columns) == set(rows[0].asDict())
        assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in EXTRA)
    texts = {r.doc_id: r.text for r in rows}
    assert texts[1] is None and texts[2] == ""
    if name == "near_dedup":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, i) for i in (1, 2, 3, 5, 7, 8, 9)] + [(True, 0)] or sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 3, 5, 6, 7, 8, 9]
    if name == "decontamination":
        assert len(rows) == df.count() and texts[3] == texts[4] and "c0 c1" in texts[6] and len(texts[6]) < len(df.where("doc_id = 6").first().text)
    if name == "pii":
        assert texts[8] == "mail [EMAIL] now" and len(rows) == df.count()
    assert STAGES[name](spark, df.limit(0), SF).collect() == []


def test_whole_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in op8_toxicity(spark, SF).collect() if r.predicted}
    left = [(i, t) for i, t in docs.items() if i not in toxic]
    components = brute_components(left)
    left = [(i, t) for i, t in left if components[i][1] == i]
    windows = brute_windows(left, items)
    left = {i: t for i, t in left if windows[i][1] <= 0.5 * windows[i][0] or not windows[i][1]}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left) and len(rows) == len(left)
    for r in rows:
        assert brute_base(r.text) == [] and (windows[r.doc_id][1] or brute_base(left[r.doc_id]) or r.text == left[r.doc_id])
        assert brute_windows([(0, r.text)], items)[0][1] == 0
        assert r.n_tokens == len((r.text or "").encode().split()) + 1 <= r.bucket_tokens
    assert len({(r.bucket, r.batch, r.place) for r in rows}) == len(rows)
