"""Registered text queries against their SQL on the smallest tables."""

import duckdb
import pytest
from portica.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    rel = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_mixing_queries_bind(spark):
    rows = {n: QUERIES[n](spark, SF).collect() for n in QUERIES if "mixing" in n}
    assert max(r["block"] for r in rows["op6_mixing"]) == 1
    per = {n: {r["source"]: r["weight"] for r in rows[n]} for n in rows if "languages" in n}
    assert all(len(set(w.values())) == 4 for w in per.values())
    assert per["mixing_languages_by_entropy"] != per["mixing_languages_by_repeats"]
