"""Registered queries against their SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from portica.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    rel = oracle.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def _same_rows(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        if (folder / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got and got == sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    return df


def test_proposals_with_holdings_above_their_weights(spark, tmp_path):
    """Suppliers of six times as many months, some with negative numbers, so that weights fall to 0 and below."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CASE WHEN k = 5 THEN -1 ELSE 1 END * l_suppkey AS l_suppkey, CAST(l_shipdate + to_years(7 * k) AS TIMESTAMP) AS l_shipdate, * EXCLUDE (l_suppkey, l_shipdate, k) FROM RANGE(6) r(k), '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    df = _same_rows(spark, tmp_path, "n6_trade_proposals")
    assert df.where("account_id < 0 AND n_trades = 0").count()


@pytest.mark.parametrize("name", ["n8_valued_ledger", "n8_instant_returns"])
def test_trades_move_once_by_part_and_once_by_account(spark, name):
    assert str(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") <= 3
