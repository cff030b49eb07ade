"""Prep views over the shared tables, written once for Spark SQL and for the SQL of the oracle.

`{name}` stands for a raw table or another view; `@EL(a, i)` for the i-th element of an array, from 1, and
`@EACH(a)` for a row by element with its place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

_ASSETS = "(SELECT * FROM (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) AS v(asset, i))"

VIEWS = {
    # Five assets by day: the kinds of events with their mean value.
    "px_small": "SELECT event_type AS asset, CAST(ts AS DATE) AS t, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / COUNT(*) AS px, COUNT(*) AS volume FROM {events} GROUP BY event_type, CAST(ts AS DATE)",
    "ret_small": "SELECT asset, t, ret FROM (SELECT asset, t, px / LAG(px) OVER (PARTITION BY asset ORDER BY t) - 1 AS ret FROM {px_small}) x WHERE ret IS NOT NULL",
    # Brands by month: unit prices.
    "px_month": "SELECT p_brand AS asset, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS t, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS px FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, CAST(DATE_TRUNC('month', l_shipdate) AS DATE)",
    "ret_month": "SELECT asset, t, ret FROM (SELECT asset, t, px / LAG(px) OVER (PARTITION BY asset ORDER BY t) - 1 AS ret FROM {px_month}) x WHERE ret IS NOT NULL",
    # One small panel for each supplier.
    "px_many": "SELECT l_suppkey AS book, l_returnflag AS asset, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS t, SUM(l_extendedprice) / SUM(l_quantity) AS px FROM {lineitem} GROUP BY l_suppkey, l_returnflag, CAST(DATE_TRUNC('month', l_shipdate) AS DATE)",
    "ret_many": "SELECT book, asset, t, ret FROM (SELECT book, asset, t, px / LAG(px) OVER (PARTITION BY book, asset ORDER BY t) - 1 AS ret FROM {px_many}) x WHERE ret IS NOT NULL",
    # Strategy books: regions, their monthly turnover as NAV, segments as holdings.
    "sales": "SELECT r_name AS book, c_mktsegment AS symbol, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS m, o_totalprice AS v FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "book_nav": "SELECT book, m AS obs_time, SUM(v) AS nav FROM {sales} GROUP BY book, m",
    "book_holdings": "SELECT book, symbol, obs_time, CAST(obs_time + INTERVAL '2' DAY AS DATE) AS available_at, 0.9 * v / SUM(v) OVER (PARTITION BY book, obs_time) AS weight FROM (SELECT book, symbol, m AS obs_time, SUM(v) AS v FROM {sales} GROUP BY book, symbol, m) x",
    "book_scores": "SELECT c_mktsegment AS symbol, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS obs_time, CAST(DATE_TRUNC('month', l_shipdate) + INTERVAL '15' DAY AS DATE) AS available_at, AVG(l_discount) AS score FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3",
    "cutoffs": "SELECT DISTINCT CAST(DATE_TRUNC('month', o_orderdate) + INTERVAL '20' DAY AS DATE) AS cutoff FROM {orders}",
    "books": "SELECT r_name AS book, CAST(r_regionkey + 1 AS DOUBLE) AS weight, 1.0 - CAST(r_regionkey AS DOUBLE) / 10 AS position_scale FROM {region}",
    # Bitemporal returns of sleeves: order priorities by month, every third month revised later.
    "obs_v0": "SELECT o_orderpriority AS sleeve, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS start, AVG(o_totalprice % 1000) / 10000 - 0.05 AS net_return FROM {orders} GROUP BY 1, 2",
    "obs_v1": "SELECT o_orderpriority AS sleeve, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS start, AVG(o_totalprice % 1000) / 10000 - 0.05 AS net_return FROM {orders} WHERE o_orderstatus = 'F' AND EXTRACT(MONTH FROM o_orderdate) % 3 = 0 GROUP BY 1, 2",
    "obs": (
        "SELECT 'study' AS study, sleeve, start, CAST(start + INTERVAL '1' MONTH AS DATE) AS end_, vintage, net_return, CAST(CAST(start + INTERVAL '1' MONTH AS DATE) + (CASE WHEN vintage = 1 THEN INTERVAL '45' DAY ELSE INTERVAL '0' DAY END) AS DATE) AS known_at, "
        "1.0 + (EXTRACT(MONTH FROM start) % 7) * 0.01 AS fx_start, 1.0 + ((EXTRACT(MONTH FROM start) + 1) % 7) * 0.01 AS fx_end "
        "FROM (SELECT sleeve, start, net_return, 0 AS vintage FROM {obs_v0} UNION ALL SELECT sleeve, start, net_return, 1 AS vintage FROM {obs_v1}) x"
    ),
    "decisions": "SELECT DISTINCT 'study' AS study, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) AS decision_at FROM {orders}",
    # Candidate portfolios: a customer each, over the five assets.
    "cand": f"SELECT portfolio_id, asset, raw / SUM(raw) OVER (PARTITION BY portfolio_id) AS weight FROM (SELECT c_custkey AS portfolio_id, asset, CAST((c_custkey * 7 + i * 13) % 11 + 1 AS DOUBLE) AS raw FROM {{customer}} CROSS JOIN {_ASSETS} a) x",
    "liq_small": "SELECT asset, SUM(px * volume) / COUNT(*) AS adv, STDDEV_SAMP(px) / AVG(px) / 10 AS volatility, 0.0005 + CAST(LENGTH(asset) AS DOUBLE) / 100000 AS linear_rate FROM {px_small} GROUP BY asset",
    # Accounts: suppliers, their line items as trades.
    "acct_trades": (
        "SELECT l_suppkey AS account_id, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS trade_id, p_brand AS symbol, "
        "CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS DECIMAL(18,8)) AS quantity, CAST(FLOOR(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(18,8)) AS price, "
        "CAST(FLOOR(l_extendedprice * l_tax) / 100 AS DECIMAL(18,8)) AS fee, CAST(l_shipdate AS DATE) AS traded_at FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    "parent_orders": (
        "SELECT o_orderkey AS order_id, o_orderpriority AS grp, o_totalprice AS notional_base, 1000000.0 * (1 + CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT)) AS adv_base, 0.01 + (o_custkey % 7) * 0.002 AS daily_volatility, "
        "0.001 + 0.2 * (0.01 + (o_custkey % 7) * 0.002) * SQRT(o_totalprice / (1000000.0 * (1 + CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT)))) + ((o_orderkey % 11) - 5) * 0.0001 AS signed_adverse_rate, "
        "CAST(o_orderdate AS DATE) AS accepted_at, CAST(o_orderdate + INTERVAL '1' DAY AS DATE) AS last_fill_at, CAST(o_orderdate + INTERVAL '3' DAY AS DATE) AS known_at FROM {orders}"
    ),
    "loadings": "SELECT vec_id AS asset, 'f' || CAST(i AS VARCHAR(9)) AS factor, CAST(@EL(embedding, i) AS DOUBLE) AS x FROM (SELECT vec_id, embedding, @EACH(embedding) AS i FROM {embeddings}) e",
    "vec_weights": "SELECT 1 AS portfolio_id, vec_id AS asset, label AS grp, CAST(vec_id % 10 + 1 AS DOUBLE) / total AS weight FROM {embeddings} CROSS JOIN (SELECT SUM(CAST(vec_id % 10 + 1 AS DOUBLE)) AS total FROM {embeddings}) s",
    "decision_log": "SELECT user_id, ts, event_id, event_type <> 'error' AS published, event_type AS status FROM {events}",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def oracle(text: str) -> str:
    """The text with views as common table expressions, for the oracle's engine."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in RAW or name in order:
            return
        for inner in _names(VIEWS[name]):
            visit(inner)
        order.append(name)

    for name in _names(text):
        visit(name)
    plain = lambda s: re.sub(r"@EACH\((\w+)\)", r"UNNEST(RANGE(1, LEN(\1) + 1))", re.sub(r"@EL\((\w+), (\w+)\)", r"list_extract(\1, \2)", re.sub(r"\{(\w+)\}", r"\1", s)))
    if not order:
        return plain(text)
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {ctes}, {body.lstrip()[len('WITH'):]}"
    return f"WITH {ctes} {body}"


class Tables:
    """The raw tables and views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.got = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.view(name)

    def view(self, name: str) -> DataFrame:
        if name not in self.got:
            self.got[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet") if name in RAW else self.sql(VIEWS[name])
        return self.got[name]

    def sql(self, text: str) -> DataFrame:
        text = re.sub(r"@EACH\((\w+)\)", r"EXPLODE(SEQUENCE(1, SIZE(\1)))", re.sub(r"@EL\((\w+), (\w+)\)", r"element_at(\1, \2)", text))
        return self.spark.sql(text, **{n: self.view(n) for n in _names(text)})
