import random
from itertools import combinations

from ledgerlake.llm.packing import op5_packing, optimal_bounds, pack

SF = "/root/testdata/sf0.001"


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        hist = [(x, rng.randint(1, 20)) for x in lengths]
        for k in (1, 2, 3, 4, 12):
            cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist)
            best = min(cost((*c, lengths[-1])) for c in combinations(lengths[:-1], min(k, len(lengths)) - 1))
            bounds, padding = optimal_bounds(hist, k)
            assert padding == best == cost(bounds) and len(bounds) <= k


def test_whole_table_by_brute_force(spark):
    sizes = {r.doc_id: len((r.text or "").encode().split()) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_packing(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == sizes
    hist = {}
    for n in sizes.values():
        hist[n] = hist.get(n, 0) + 1
    bounds, _ = optimal_bounds(sorted(hist.items()), 16)
    seen = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        b = next(i for i, x in enumerate(bounds) if x >= r.n_tokens)
        number, per = seen.get(b, 0), max(1, 65536 // bounds[b])
        seen[b] = number + 1
        assert (r.bucket, r.bucket_tokens, r.batch, r.place) == (b, bounds[b], number // per, number % per)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, ""), (-5, " x "), (10**12, "w " * 5000)], "doc_id long, text string").selectExpr("*", "'q' as bucket", "1 as N_TOKENS", "2 as place")
    rows = pack(df, buckets=2, budget=100).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 3, 3, 5001]
    assert len({(r.bucket, r.batch, r.place) for r in rows}) == 6
    assert pack(df.limit(0)).collect() == []


def test_ids_of_any_type_and_hot_ids(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'same' ELSE 'k' || id END AS doc_id", "'w' AS text")
    rows = pack(df, buckets=3, budget=100).collect()
    numbers = sorted((r.batch * 50 + r.place, r.doc_id or "") for r in rows)
    assert [n for n, _ in numbers] == list(range(3000))
    assert [k for _, k in numbers] == sorted(k for _, k in numbers)  # null ids first, then by id


def test_clashing_columns_keep_their_values(spark):
    extra = ["doc", "id", "_stretch", "_before", "_in_stretch", "_number", "count", "row", "at", "part", "first", "before", "number"]
    df = spark.range(50).selectExpr("id as doc_id", "repeat('w ', cast(id as int)) as text", *[f"concat('{c}', id) as {c}" for c in extra])
    rows = pack(df, buckets=3, budget=100).collect()
    assert len(rows) == 50 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
