"""Study documents as tables: sleeve studies, capacity studies, order calibrations, capital plans and market files.

A path may hold many documents; every table carries `study_id`, which is the name of the file, or of its folder `doc=..`, where the
document has none. Amounts that may be text become decimals, and null where they do not fit; instants stay text for the strict
check of times, but for `vintage`. A document that does not parse, or is of another kind, is a row of
`document_checks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import check_rows

# Kinds of documents, as their schema ids end after any prefix and a dot, and the names of their fields.
KINDS = {
    "sleeve": "sleeve-study/v1",
    "capacity": "capacity-study/v1",
    "calibration": "cost-calibration/v1",
    "plan": "capital-plan/v1",
    "market": "capital-market/v1",
}
_PERIOD = "ARRAY<STRUCT<start STRING, end STRING, cash_return DOUBLE, cash_known_at STRING>>"
_MARKET = "ARRAY<STRUCT<observation_id STRING, at STRING, available_at STRING, prices MAP<STRING, STRING>, fx MAP<STRING, STRING>>>"
_FIXED = "STRUCT<units: BIGINT, scale: INT>"
_AXES = ("capital", "turnover_scales", "liquidity_scales", "impact_coefficients", "volatility_scales")
_FIELDS = {
    "sleeve": (
        "base_currency STRING, evaluation_as_of STRING, sleeves ARRAY<STRUCT<id STRING, currency STRING, source_ref STRING, return_basis STRING>>, "
        "observations ARRAY<STRUCT<sleeve STRING, start STRING, end STRING, known_at STRING, net_return DOUBLE, fx_start DOUBLE, fx_end DOUBLE, fx_start_known_at STRING, fx_end_known_at STRING>>, "
        f"periods {_PERIOD}, evaluation_periods {_PERIOD}, markets {_MARKET}, initial_weights MAP<STRING, DOUBLE>, linear_costs MAP<STRING, DOUBLE>, max_weight DOUBLE, invested_limit DOUBLE, initial_capital DOUBLE"
    ),
    "capacity": (
        "base_currency STRING, as_of STRING, max_liquidity_age_days DOUBLE, holdings_weights MAP<STRING, DOUBLE>, trade_weights MAP<STRING, DOUBLE>, max_participation DOUBLE, execution_days INT, liquidation_days INT, cost_budget_return DOUBLE, "
        + ", ".join(f"{a} ARRAY<DOUBLE>" for a in _AXES)
        + ", liquidity ARRAY<STRUCT<asset STRING, adv_base DOUBLE, daily_volatility DOUBLE, linear_rate DOUBLE, observed_at STRING, known_at STRING, source_ref STRING>>"
    ),
    "calibration": (
        "training_end STRING, holdout_start STRING, evaluation_as_of STRING, minimum_orders INT, max_reference_age_seconds DOUBLE, "
        "orders ARRAY<STRUCT<order_id STRING, accepted_at STRING, last_fill_at STRING, known_at STRING, reference_at STRING, reference_known_at STRING, liquidity_known_at STRING, source_ref STRING, notional_base DOUBLE, adv_base DOUBLE, daily_volatility DOUBLE, signed_adverse_rate DOUBLE>>"
    ),
    "plan": (
        "base_currency STRING, opened_at STRING, opening_fx MAP<STRING, STRING>, owners MAP<STRING, STRING>, allocations MAP<STRING, MAP<STRING, STRING>>, cost_policy STRUCT<model STRING, fee_per_unit STRING>, "
        f"instruments ARRAY<STRUCT<instrument_id STRING, asset_class STRING, venue STRING, settlement_currency STRING, price_tick {_FIXED}, quantity_step {_FIXED}, contract_multiplier {_FIXED}, margin_mode STRING, inverse BOOLEAN, effective_from STRING, effective_to STRING, available_at STRING>>, "
        "decisions ARRAY<STRUCT<decision_id STRING, signal_observation_id STRING, execution_observation_id STRING, instrument_id STRING, target_notional STRING, settles_at STRING>>, "
        "cash_events ARRAY<STRUCT<event_id STRING, at STRING, sequence INT, kind STRING, sleeve STRING, currency STRING, amount STRING>>"
    ),
    "market": f"observations {_MARKET}",
}


def _documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    raw = spark.read.schema(f"schema STRING, study_id STRING, {_FIELDS[kind]}").option("multiLine", True).json(path)
    place = F.regexp_extract(F.col("_metadata.file_path"), r"/doc=([^/]*)/[^/]*$", 1)
    named = F.when(place != "", F.url_decode(place)).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return raw.withColumn("study_id", F.coalesce("study_id", named))


def document_checks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(study_id, rule): documents of another kind or that do not parse, and ids that occur twice."""
    docs = _documents(spark, path, kind).select("study_id", "schema")
    again = docs.groupBy("study_id").agg(F.count("*").alias("n")).where("n > 1").select("study_id", F.lit("repeated_id").alias("rule"))
    return check_rows(docs, {"unknown_schema": ~F.substring_index("schema", ".", -1).eqNullSafe(KINDS[kind])}, ["study_id"]).union(again)


def _decimal(c: str) -> Column:
    return F.expr(f"try_cast({c} AS decimal(18,8))")


def _each(docs: DataFrame, field: str) -> DataFrame:
    return docs.select("study_id", F.explode(field).alias("_e")).select("study_id", "_e.*")


def _pairs(docs: DataFrame, field: str, name: str, value: str) -> DataFrame:
    return docs.select("study_id", F.explode(field).alias(name, value))


def _market(docs: DataFrame, field: str) -> dict[str, DataFrame]:
    m, place = _each(docs, field), ["study_id", "observation_id", "at", "available_at"]
    return {
        "marks": m.select(*place, F.explode("prices").alias("instrument_id", "price")).withColumn("price", _decimal("price")),
        "fx": m.select(*place, F.explode("fx").alias("currency", "rate")).withColumn("rate", _decimal("rate")),
    }


def read_study_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of sleeve studies: studies, sleeves, observations (their vintage is when they were known), periods,
    initial weights and costs by sleeve, and marks and FX rates if the document has any."""
    d = _documents(spark, path, "sleeve")
    return {
        "studies": d.select("study_id", "schema", "base_currency", "evaluation_as_of", "max_weight", "invested_limit", "initial_capital"),
        "sleeves": _each(d, "sleeves"),
        "observations": _each(d, "observations").withColumn("vintage", F.try_to_timestamp("known_at")),
        "periods": _each(d.withColumn("_p", F.coalesce("evaluation_periods", "periods")), "_p"),
        "initial_weights": _pairs(d, "initial_weights", "sleeve", "weight"),
        "linear_costs": _pairs(d, "linear_costs", "sleeve", "rate"),
        **_market(d, "markets"),
    }


def read_capacity_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of capacity studies: studies, liquidity, holdings, trades and the values of each axis of the grid."""
    d = _documents(spark, path, "capacity")
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("values")) for a in _AXES])
    return {
        "studies": d.select("study_id", "schema", "base_currency", "as_of", "max_liquidity_age_days", "max_participation", "execution_days", "liquidation_days", "cost_budget_return"),
        "liquidity": _each(d, "liquidity"),
        "holdings": _pairs(d, "holdings_weights", "asset", "weight"),
        "trades": _pairs(d, "trade_weights", "asset", "weight"),
        "axes": d.select("study_id", F.inline(axes)).select("study_id", "axis", F.explode("values").alias("value")),
    }


def read_calibration_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of cost calibrations: studies and orders."""
    d = _documents(spark, path, "calibration")
    return {"studies": d.select("study_id", "schema", "training_end", "holdout_start", "evaluation_as_of", "minimum_orders", "max_reference_age_seconds"), "orders": _each(d, "orders")}


def read_plan_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of capital plans: plans, instruments, owners, allocations, decisions and cash events."""
    d = _documents(spark, path, "plan")
    fixed = lambda c: (F.col(c)["units"] * F.pow(F.lit(10.0), -F.col(c)["scale"])).cast("decimal(18,8)").alias(c)
    instruments = _each(d, "instruments")
    numbers = ("price_tick", "quantity_step", "contract_multiplier")
    shares = _pairs(d, "allocations", "sleeve", "_by").select("study_id", "sleeve", F.explode("_by").alias("currency", "amount"))
    return {
        "plans": d.select("study_id", "schema", "base_currency", "opened_at", F.expr("try_cast(cost_policy.fee_per_unit AS decimal(18,8))").alias("fee_per_unit")),
        "instruments": instruments.select(*[fixed(c) if c in numbers else F.col(c) for c in instruments.columns]),
        "owners": _pairs(d, "owners", "instrument_id", "sleeve"),
        "opening_fx": _pairs(d, "opening_fx", "currency", "rate").withColumn("rate", _decimal("rate")),
        "allocations": shares.withColumn("amount", _decimal("amount")),
        "decisions": _each(d, "decisions").withColumn("target_notional", _decimal("target_notional")),
        "cash_events": _each(d, "cash_events").withColumn("amount", _decimal("amount")),
    }


def read_market_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of market files: marks and FX rates by observation."""
    return _market(_documents(spark, path, "market"), "observations")
