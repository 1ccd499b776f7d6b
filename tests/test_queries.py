"""Each registered query of the manifest domain gives the rows of its SQL, over whole tables."""

import hashlib
import hmac
import os

import duckdb
import pytest

from ledgerlake.functions.scalars import derive_address_key
from ledgerlake.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(_plain(tuple(r[c] for c in columns))) for r in df.collect())
    assert got == sorted(repr(_plain(tuple(r[i] for i in at))) for r in want.fetchall())


def test_keyed_addresses_are_hmac(spark, duck):
    key = derive_address_key(b"password", b"salt")
    hashes = {r.path: r.full_hash for r in QUERIES["f02_content_key"](spark, SF).selectExpr("path", "split(content_key, '\\n')[0] AS full_hash").collect()}
    for r in QUERIES["f03_keyed_address"](spark, SF).collect():
        assert r.address == "data/" + hmac.new(key, hashes[r.path].encode(), hashlib.sha256).hexdigest()[:32]


def test_sample_has_its_quotas(spark):
    rows = QUERIES["h16_stratified_sample"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len({r.path for r in rows}) == 200
    assert {r.bucket for r in rows} == {0, 1, 2, 3}
