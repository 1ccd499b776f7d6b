import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import toxicity
from ledgerlake.llm.toxicity import op8_toxicity, score, train

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.94
    assert ((got.predicted == 1) & (got.toxic == 1)).sum() > 0.6 * got.toxic.sum()
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.02 * (got.toxic == 0).sum()


def test_edges(spark):
    rows = [(i, ("you idiot " if i % 3 == 0 else "hello there ") + f"w{i}", int(i % 3 == 0)) for i in range(300)] + [(None, None, None), (900, None, 1), (901, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    w = train(df)
    assert (w == train(df.orderBy(F.rand(1)))).all()
    out = {(r.doc_id, r.text): r.score for r in score(df.selectExpr("*", "9 as SCORE", "1 as doc"), w).collect()}
    assert len(out) == 303 and all(0 <= p <= 1 for p in out.values())
    assert out[(900, None)] == out[(901, "")] and out[(0, "you idiot w0")] > 0.5 > out[(1, "hello there w1")]
    assert train(df.limit(0)).sum() == 0 and score(df.limit(0), w).collect() == []


def test_fit_and_score_by_a_plain_loop(spark):
    """FTRL-proximal written out coordinate by coordinate over words, pairs and skip pairs, and scores from its weights."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["bad", "worse"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(120)] + ["", None]
    labels = [float("bad" in (t or "").split() or rng.random() < 0.1) for t in texts]
    words = toxicity._Words()
    rows = [np.unique(toxicity.features(t, words)) for t in texts]
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1_RATE * len(rows) ** 0.5
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - (l1 if zi > 0 else -l1)) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in zip(rows, labels, strict=True):
            at = [*x.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = toxicity.fit_ftrl(rows, np.array(labels))
    want = {i: weight(i) for i in z if weight(i)}
    assert set(np.flatnonzero(got).tolist()) == set(want)
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in toxicity.score(df, got).collect():
        total = sum(want.get(i, 0.0) for i in set(rows[r.doc_id].tolist())) + want.get(bias, 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-5
