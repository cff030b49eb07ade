"""Queries of the readers and sinks: what the tables give is written to the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..shared import remove, saved, shared_folder
from ..sources import readers, sinks, studies
from .prep import Tables
from .registry import query


def _read_back(t: Tables, f: Callable[[str], DataFrame]) -> DataFrame:
    """What f writes to a new place in the shared folder and reads from there; the files go once the rows are saved."""
    place = f"{shared_folder(t.spark)}/reports-{uuid.uuid4().hex}"
    rows = saved(f(place))
    remove(t.spark, place)
    return rows


# Symbols with leading zeros, and one that spells a missing value.
_SYMBOLS = "SELECT CASE WHEN p_partkey = 1 THEN 'NA' ELSE LPAD(CAST(p_partkey AS VARCHAR(9)), 9, '0') END AS symbol, p_retailprice AS price FROM {part}"


@query("a1_read_symbol_table", text="symbol", real="price", digits=2, sql=_SYMBOLS)
def _(t: Tables) -> DataFrame:
    return _read_back(t, lambda place: readers.read_symbol_table(t.spark, sinks.write_artifacts(t.sql(_SYMBOLS), place, "csv"), ["price"]))


@query("a2_read_nav", text="book obs_time", real="nav", digits=2, sql="SELECT 'all' AS book, obs_time, SUM(nav) AS nav FROM {book_nav} GROUP BY obs_time")
def _(t: Tables) -> DataFrame:
    total = t.sql("SELECT obs_time AS date, SUM(nav) AS nav FROM {book_nav} GROUP BY obs_time")
    nav = _read_back(t, lambda place: readers.read_nav(t.spark, sinks.write_artifacts(total, place, "csv"), "all"))
    return nav.withColumn("obs_time", F.to_date("obs_time"))


# The files of a statement for all accounts at once.
_FILES = {
    "opening_positions": "SELECT account_id, symbol, SUM(quantity) AS quantity, MIN(price) AS average_cost, MIN(traded_at) AS acquired_on FROM {acct_trades} WHERE side = 'buy' GROUP BY account_id, symbol",
    "trades": "SELECT account_id, trade_id, symbol, side, quantity, price, fee, traded_at AS event_time FROM {acct_trades}",
    "cash_flows": "SELECT s_suppkey AS account_id, s_nationkey AS transfer_id, CAST(s_acctbal AS DECIMAL(18,2)) AS amount, DATE '1998-12-01' AS event_time FROM {supplier}",
    "closing_positions": "SELECT account_id, symbol, SUM(quantity) AS quantity, MAX(quantity) AS available_quantity FROM {acct_trades} GROUP BY account_id, symbol",
    "prices": "SELECT account_id, symbol, 'main' AS venue, MAX(price) AS price, MAX(traded_at) AS as_of FROM {acct_trades} GROUP BY account_id, symbol",
}
_AMOUNTS = {"opening_positions": "quantity", "trades": "quantity", "cash_flows": "amount", "closing_positions": "quantity", "prices": "price"}
_TOTALS = "\nUNION ALL ".join(f"SELECT '{name}' AS file, CAST(account_id AS VARCHAR(19)) AS account_id, COUNT(*) AS n, SUM({_AMOUNTS[name]}) AS total FROM ({text}) f GROUP BY account_id" for name, text in _FILES.items())


@query("a4_read_statement", text="file account_id", whole="n", real="total", digits=2, sql=_TOTALS)
def _(t: Tables) -> DataFrame:
    def totals(place: str) -> DataFrame:
        out = []
        for name, text in _FILES.items():
            sinks.write_artifacts(t.sql(text), f"{place}/{name}.csv", "csv")
        for name, df in readers.read_statement(t.spark, place, "unknown").items():
            out.append(df.groupBy("account_id").agg(F.count("*").alias("n"), F.sum(_AMOUNTS[name]).alias("total")).select(F.lit(name).alias("file"), "account_id", "n", "total"))
        first, *others = out
        for df in others:
            first = first.union(df)
        return first

    return _read_back(t, totals)


@query("a6_publish_json", text="book symbol obs_time", real="weight", sql="SELECT book, symbol, obs_time, weight FROM {book_holdings}")
def _(t: Tables) -> DataFrame:
    return _read_back(t, lambda place: t.spark.read.schema("book string, symbol string, obs_time date, weight double").json(sinks.publish_json(t.book_holdings, place)))


@query("a7_write_artifacts", text="asset t", real="px", sql="SELECT asset, t, px FROM {px_month}")
def _(t: Tables) -> DataFrame:
    return _read_back(t, lambda place: t.spark.read.parquet(sinks.write_artifacts(t.px_month, place)))


# Sleeve studies: one for each year, with the observations that start in it.
_YEAR = "CAST(EXTRACT(YEAR FROM start) AS VARCHAR(4))"
_SEEN = f"SELECT {_YEAR} AS study_id, sleeve, CAST(start AS VARCHAR(10)) AS start, CAST(end_ AS VARCHAR(10)) AS end_, CAST(known_at AS VARCHAR(10)) || 'T00:00:00Z' AS known_at, net_return, fx_start, fx_end FROM {{obs}}"


def _document(kind: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(f"desk.{studies.KINDS[kind]}").alias("schema"), "study_id", *fields)).alias("document")


def _sleeve_documents(t: Tables) -> DataFrame:
    told = F.struct("sleeve", "start", F.col("end_").alias("end"), "known_at", "net_return", "fx_start", "fx_end")
    docs = t.sql(_SEEN).groupBy("study_id").agg(F.collect_list(told).alias("observations"), F.collect_set("sleeve").alias("names"))
    sleeves = F.transform("names", lambda n: F.struct(n.alias("id"), F.lit("USD").alias("currency"))).alias("sleeves")
    weights = F.map_from_entries(F.transform("names", lambda n: F.struct(n, 1 / F.size("names")))).alias("initial_weights")
    return docs.select("study_id", _document("sleeve", F.lit("USD").alias("base_currency"), sleeves, "observations", weights))


@query("a3_sleeve_study", text="study_id sleeve start end_ vintage", real="net_return fx_start fx_end", digits=9, sql=f"SELECT study_id, sleeve, start, end_, CAST(SUBSTRING(known_at, 1, 10) AS TIMESTAMP) AS vintage, net_return, fx_start, fx_end FROM ({_SEEN}) s")
def _(t: Tables) -> DataFrame:
    """Observations of nested documents, one a year."""
    def read(place: str) -> DataFrame:
        return studies.read_study_json(t.spark, sinks.publish_documents(_sleeve_documents(t), place))["observations"].withColumnRenamed("end", "end_")

    return _read_back(t, read)


@query("a3_initial_weights", text="study_id sleeve", real="weight", digits=9, sql=f"SELECT study_id, sleeve, 1.0 / COUNT(*) OVER (PARTITION BY study_id) AS weight FROM (SELECT DISTINCT study_id, sleeve FROM ({_SEEN}) s) x")
def _(t: Tables) -> DataFrame:
    """Maps of nested documents as rows."""
    return _read_back(t, lambda place: studies.read_study_json(t.spark, sinks.publish_documents(_sleeve_documents(t), place))["initial_weights"])


@query("a3_document_checks", text="study_id rule", sql="SELECT 'n' || CAST(n_nationkey AS VARCHAR(4)) AS study_id, 'unknown_schema' AS rule FROM {nation} WHERE n_nationkey % 5 IN (1, 2)")
def _(t: Tables) -> DataFrame:
    """Documents by nation: a fifth are of another kind, a fifth are no JSON, both are rows and not failures."""
    names = t.sql("SELECT 'n' || CAST(n_nationkey AS VARCHAR(4)) AS study_id, n_nationkey % 5 AS fifth, n_name FROM {nation}")
    good, other = _document("capacity", F.col("n_name").alias("base_currency")), _document("market")
    docs = names.select("study_id", F.when(F.col("fifth") == 1, other).when(F.col("fifth") == 2, F.concat(F.lit("{broken "), "n_name")).otherwise(good).alias("document"))

    def read(place: str) -> DataFrame:
        return studies.document_checks(t.spark, sinks.publish_documents(docs, place), "capacity")

    return _read_back(t, read)


@query("a3_market_marks", text="study_id observation_id instrument_id", real="price", digits=4, sql="SELECT 'm' || CAST(EXTRACT(YEAR FROM t) AS VARCHAR(4)) AS study_id, CAST(t AS VARCHAR(10)) AS observation_id, asset AS instrument_id, CAST(px AS DECIMAL(18,8)) AS price FROM {px_month}")
def _(t: Tables) -> DataFrame:
    """Marks of market files, one a year; prices are text in the documents and decimals as rows."""
    by_day = t.px_month.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("asset", F.col("px").cast("decimal(18,8)").cast("string")))).alias("prices"))
    one = F.struct(F.col("t").cast("string").alias("observation_id"), F.col("t").cast("string").alias("at"), F.col("t").cast("string").alias("available_at"), "prices")
    docs = by_day.groupBy(F.concat(F.lit("m"), F.year("t").cast("string")).alias("study_id")).agg(F.collect_list(one).alias("observations"))
    return _read_back(t, lambda place: studies.read_market_json(t.spark, sinks.publish_documents(docs.select("study_id", _document("market", F.col("observations"))), place))["marks"])
