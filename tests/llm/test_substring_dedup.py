import random

import pyarrow.parquet as pq

from ledgerlake.llm.substring_dedup import MAX, MIN, cuts, op7_substring_dedup, remove_repeats, repeated_spans

SF = "/root/testdata/sf0.001"


def brute(rows, min_run=128):
    first, chunks = {}, {}
    for i, text in sorted((i, t) for i, t in rows if i is not None):
        data, at = (text or "").encode(), 0
        for k, end in enumerate(cuts(data)):
            chunks.setdefault(i, []).append((k, at, end, data[at:end]))
            first.setdefault(data[at:end], (i, k))
            at = end
    out = {}
    for i, cs in chunks.items():
        runs = []
        for k, a, b, data in cs:
            if first[data] != (i, k):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        out[i] = [tuple(r) for r in runs if r[1] - r[0] >= min_run]
    return {i: r for i, r in out.items() if r}


def test_chunks_cover_texts_and_resist_shifts():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(20000))
    ends = cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(MIN <= s <= MAX for s in sizes[:-1])
    moved = {e - 7 for e in cuts(b"shifted" + data)}
    assert len(moved & set(ends)) > 0.95 * len(ends)
    assert cuts(b"") == [] and cuts(b"abc") == [3] and cuts(b"z" * 1000)[-1] == 1000


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: [tuple(map(int, s.split(":"))) for s in r.spans.split(",")] for r in op7_substring_dedup(spark, SF).collect() if r.n_spans}
    assert got == want


def test_hot_digests_are_dealt_over_copies(spark, monkeypatch):
    from ledgerlake.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(substring_dedup, "COPIES", 3)
    test_whole_table(spark)


def test_passages_and_edges(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = text(55)
    rows = [(i, f"{text(40)} {passage} {text(40)}") for i in range(40)] + [(100, text(300)), (101, None), (102, ""), (None, passage), (103, "é" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as removed_bytes", "2 as id", "3 as spans", "4 as _spans", "5 as _id", "6 as doc")
    found = {r.id: r.spans for r in repeated_spans(df.select("doc_id", "text")).collect()}
    assert set(range(1, 40)) <= set(found) and 100 not in found
    out = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert all((r.id, r.spans, r._spans, r._id, r.doc) == (2, 3, 4, 5, 6) for r in out.values())
    assert out[0].text == rows[0][1] and out[100].removed_bytes == 0 and out[101].text is None and out[None].text == passage
    assert all(len(out[i].text.encode()) + out[i].removed_bytes == len(rows[i][1].encode()) for i in range(40))
    assert repeated_spans(df.select("doc_id", "text").limit(0)).collect() == []


def test_passages_of_51_words_in_two_documents():
    words = [w for t in sample_texts() for w in t.split()]
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    missed = 0
    for _ in range(1000):
        passage = text(51)
        rows = [(i, f"{text(rng.randint(20, 80))} {passage} {text(rng.randint(20, 80))}") for i in range(2)]
        missed += not brute(rows).get(1)
    assert missed == 0


def sample_texts():
    return [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
