import random
from itertools import combinations

import pytest

from ledgerlake.llm.near_dedup import near_duplicates, op6_near_dedup

SF = "/root/testdata/sf0.001"


def brute(rows):
    """{id: (n, component)} by comparing all pairs of the exact sets of word tuples."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    at = {}
    for i, found in sets.items():
        for shingle in found:
            at.setdefault(shingle, []).append(i)
    # all pairs that share anything
    for a, b in {pair for ids in at.values() for pair in combinations(sorted(set(ids)), 2)}:
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def check(out, rows):
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(op6_near_dedup(spark, SF).collect(), rows)


def test_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op6_near_dedup(spark, sf).collect(), rows)


def test_small_sets_at_the_threshold(spark):
    """Pairs of 4 to 60 shingles whose similarity is 0.7 to 0.8: each link is found, also by pairs that share one band."""
    rng = random.Random(8)
    rows = []
    for i in range(700):
        n = rng.randint(4, 60)
        words = [f"p{i}_{j}" for j in range(n + 4)]
        cut = round(n * rng.uniform(0.2, 0.3))  # of the n shingles of one text, the other lacks these
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: n + 4 - cut]))]
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_families_of_several_clusters_in_blocks(spark, monkeypatch):
    from ledgerlake.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "MEMBERS_A_COPY", 2)
    rng = random.Random(4)
    base = [f"w{j}" for j in range(100)]
    rows = []
    for i in range(60):  # each has its own part of one text, so that some link only by others between them
        a = rng.randrange(40)
        rows.append((i, " ".join(base[a : a + 60])))
    check(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_chains_copies_and_edges(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three")]
    words = list(base)
    for i in range(10, 40):  # each differs a little from the one before: a chain
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(base)) for i in range(50)]  # exact copies
    rows += [(200 + i, " ".join(base[:40] + [f"y{i}_{j}" for j in range(60)])) for i in range(30)]  # a shared passage
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as NODE", "'x' as component_id", "'y' as id")
    check(near_duplicates(df).collect(), rows)


def test_threshold_is_met_exactly(spark):
    words = [f"t{i}" for i in range(39)]  # 35 shingles; dropping 5 words at the end leaves 30 of them: 0.857
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5])), (3, " ".join(f"u{i}" for i in range(24))), (4, " ".join(f"u{i}" for i in range(19))), (5, " ".join(f"u{i}" for i in range(18)))]
    # 3 and 4: 20 and 15 shingles, 0.75 exactly; 3 and 5: 14 of 20
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f"), (7, "a b c d e f"), (None, "lonely text of five words more"), (7, "a b c d e f")]])
def test_empty_tables_null_and_repeated_ids(spark, rows):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == ([(-1, -1, False), (-1, 7, False), (7, 7, True), (7, 7, True)] if rows else [])
