import random

import pytest

from ledgerlake.llm.decontaminate import decontaminate, find_contamination
from ledgerlake.llm.suffix_automaton import words_of


def brute(docs, items, k=10):
    windows = {}
    for key, text in items:
        w = words_of(text)
        n = min(k, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(key)
    sizes = {len(x) for x in windows}
    out = {}
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[g]
        out[key] = (len(w), len(hit), sorted(str(f) for f in found if f is not None))
    return out


@pytest.mark.parametrize("max_words", [200_000, 60])
def test_against_brute_force(spark, max_words):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(6)] + ["Ünï", "9"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1 + i % 3, 5, 9, 10, 11, 25, 40]))) for i in range(14)] + [(90, None), (91, "--"), (92, text(12)), (None, text(11))]
    items = [x for x in items if x[1] is None or len(words_of(x[1])) != 1]
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(100, None), (101, ""), (102, items[0][1]), (103, "zz " + (items[4][1] or "") + ", yy. " + (items[2][1] or "").upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as hits", "'b' as items", "1 as contamination", "2 as doc")
    got = {r.doc_id: r for r in find_contamination(d, spark.createDataFrame(items, "item_id long, text string"), max_words=max_words).collect()}
    assert {k: (r.contamination.n_words, sum(h.last - h.first + 1 for h in r.contamination.hits), list(r.contamination.items)) for k, r in got.items()} == brute(docs, items)


def test_cleaning(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    clean = " ".join(f"c{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{clean}. {passage}! {clean}"), (2, f"{passage} x"), (3, clean), (4, None), (5, f"{clean.upper()}-A {passage.upper()}, End")], "doc_id long, text string").selectExpr("*", "7 as n_chars")
    out = {r.doc_id: r.text for r in decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert out == {1: f"{clean}. ! {clean}", 3: clean, 4: None, 5: f"{clean.upper()}-A , End"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contamination.n_words for r in find_contamination(docs, none).collect()] == [3]
    assert find_contamination(docs.limit(0), none).collect() == []
