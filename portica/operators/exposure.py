"""Combination of books and exposure aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import ratio
from ..shared import Scratch, saved
from .pit import greatest_so_far


def book_budgets(books: DataFrame, keys: list[str]) -> DataFrame:
    """`books` has nav, weight and position_scale: capital share, budget and cash by book, and the total NAV.

    Status: ok, or no_weight where the weights of a key sum to nothing, so that there are no shares.
    """
    w = Window.partitionBy(*keys)
    capital = ratio(F.col("weight"), F.sum("weight").over(w))
    out = books.withColumn("capital_weight", capital)
    return (
        out.withColumn("budget_weight", F.col("capital_weight") * F.col("position_scale"))
        .withColumn("cash_weight", F.col("capital_weight") - F.col("budget_weight"))
        .withColumn("total_nav", F.sum(F.col("nav") * F.col("capital_weight")).over(w))
        .withColumn("status", F.when(F.col("capital_weight").isNull(), "no_weight").otherwise("ok"))
    )


def combine_holdings(holdings: DataFrame, budgets: DataFrame, keys: list[str], book: str = "book") -> DataFrame:
    """(keys.., symbol, weight): holdings times their book's budget, summed; what is not invested stays cash."""
    j = holdings.join(budgets.select(*keys, book, "budget_weight"), [*keys, book])
    return j.groupBy(*keys, "symbol").agg(F.sum(F.col("weight") * F.col("budget_weight")).alias("weight"))


def factor_tilt(weights: DataFrame, scores: DataFrame, strength: float, keys: list[str]) -> DataFrame:
    """(keys.., symbol, weight, status): scored holdings tilted within their own budget, the others unchanged."""
    ids = [*keys, "symbol"]
    j = weights.join(scores.select(*ids, "score"), ids, "left")
    w = Window.partitionBy(*keys)
    has = F.col("score").isNotNull()
    spread = F.stddev_pop("score").over(w)
    z = (F.col("score") - F.avg("score").over(w)) / F.when(spread > 0, spread).otherwise(1.0)
    j = j.withColumn("_t", F.when(has, F.greatest(F.col("weight") * (1 + strength * z), F.lit(0.0))))
    j = j.withColumn("_total", F.sum("_t").over(w)).withColumn("_budget", F.sum(F.when(has, F.col("weight"))).over(w))
    still = (F.lit(strength) == 0) | ~has | (F.coalesce("_budget", F.lit(0.0)) == 0)
    gone = ~still & ~(F.col("_total") > 0)
    tilted = F.when(still, F.col("weight")).when(gone, F.lit(None)).otherwise(F.col("_t") / F.when(F.col("_total") > 0, F.col("_total")) * F.col("_budget"))
    return j.select(*ids, tilted.alias("weight"), F.when(gone, "removed_every_holding").when(still, "unchanged").otherwise("tilted").alias("status"))


def group_weights(weights: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., grp, weight): unmapped assets fall in `__ungrouped__`."""
    j = weights.join(groups, "asset", "left")
    return j.groupBy(*keys, F.coalesce("grp", F.lit("__ungrouped__")).alias("grp")).agg(F.sum("weight").alias("weight"))


def bucket_exposures(weights: DataFrame, attributes: list[str], keys: list[str]) -> DataFrame:
    """(keys.., attribute, bucket, gross): gross exposure by each attribute, case ignored, in one pass."""
    cols = {a: F.lower(F.col(a)) for a in attributes}
    flat = weights.select(*keys, "weight", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), c.alias("bucket")) for a, c in cols.items()])).alias("b"))
    return flat.groupBy(*keys, "b.attribute", "b.bucket").agg(F.sum(F.abs("weight")).alias("gross"))


def leverage_summary(weights: DataFrame, keys: list[str]) -> DataFrame:
    return weights.groupBy(*keys).agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))


def factor_exposures(weights: DataFrame, loadings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., factor, exposure, active): X'w and X'(w - benchmark); `benchmark` may be absent."""
    bench = F.col("benchmark") if "benchmark" in weights.columns else F.lit(0.0)
    j = weights.withColumn("_b", bench).join(loadings, "asset")
    return j.groupBy(*keys, "factor").agg(F.sum(F.col("x") * F.col("weight")).alias("exposure"), F.sum(F.col("x") * (F.col("weight") - F.col("_b"))).alias("active"))


def shifted_factor_bounds(bounds: DataFrame, benchmark: DataFrame, loadings: DataFrame, keys: list[str]) -> DataFrame:
    """`bounds(keys.., factor, lo, hi)` of active exposures as bounds of exposures: moved by the benchmark's own.

    `benchmark(keys.., asset, weight)`; a factor that no benchmark asset loads on keeps its bounds.
    """
    own = factor_exposures(benchmark, loadings, keys).select(*keys, "factor", F.col("exposure").alias("_own"))
    j = bounds.join(own, [*keys, "factor"], "left").withColumn("_own", F.coalesce("_own", F.lit(0.0)))
    return j.select(*keys, "factor", (F.col("lo") + F.col("_own")).alias("lo"), (F.col("hi") + F.col("_own")).alias("hi"))


def fund_look_through(weights: DataFrame, disclosures: DataFrame, keys: list[str], max_depth: int = 8, max_age_days: int = 180) -> tuple[DataFrame, DataFrame]:
    """(exposures, totals): funds expanded to what they hold, level by level, until a level holds no fund.

    `weights(keys.., at, instrument_id, weight)`; `disclosures(fund_id, holding_date, available_at,
    instrument_id, weight)`. A fund is known through its latest disclosure that is available and fresh at
    `at`, in the last revision of that holding date. Branches that are stale, circular or too deep, and what a fund
    does not disclose, stay unknown. Decimal weights stay decimals of their scale, cut after each product; others are
    doubles. Each level is a table written to the shared folder, so there are as many
    jobs as the data are deep; only funds that a level holds look for their editions.
    """
    funds = disclosures.select(F.col("fund_id").alias("instrument_id")).distinct().withColumn("is_fund", F.lit(True))
    number = kind if (kind := dict(weights.dtypes)["weight"]).startswith("decimal") else "double"
    zero = F.lit(0).cast(number)
    schema = ", ".join(f"`{k}` {kind}" for k, kind in weights.select(*keys).dtypes) + f", instrument_id string, known {number}, unknown {number}"
    with Scratch(weights.sparkSession) as scratch:
        parts = [weights.sparkSession.createDataFrame([], schema)]

        def tell(rows: DataFrame, known: str, unknown: str) -> None:
            parts.append(rows.select(*keys, F.col("instrument_id").cast("string"), F.expr(known).cast(number).alias("known"), F.expr(unknown).cast(number).alias("unknown")))

        level = weights.select(*keys, "at", "instrument_id", F.col("weight").cast(number).alias("weight"), F.array("instrument_id").alias("path"))
        for depth in range(max_depth + 1):
            marked = scratch.put(level.join(funds, "instrument_id", "left"))
            tell(marked.where("is_fund IS NULL"), "weight", "0.0")
            opened = marked.where("is_fund").withColumn("fund_id", F.col("instrument_id"))
            if opened.isEmpty():
                break
            if depth == max_depth:
                tell(opened, "NULL", "weight")
                break
            asked = opened.select("fund_id", "at").distinct()
            editions = disclosures.join(asked.select("fund_id").distinct(), "fund_id", "left_semi").select("fund_id", "holding_date", "available_at").distinct()
            last = greatest_so_far(editions, asked, ["fund_id"], F.col("available_at"), F.struct("holding_date", "available_at"), "at").select("fund_id", "at", "found.*")
            held = last.where(F.datediff("at", "holding_date") <= max_age_days).join(disclosures, ["fund_id", "holding_date", "available_at"])
            fresh = scratch.put(held.groupBy("at", "fund_id", "instrument_id").agg(F.sum("weight").alias("part")))
            told = fresh.groupBy("at", "fund_id").agg(F.sum("part").alias("told"))
            tell(opened.join(told, ["at", "fund_id"], "left").withColumn("rest", F.col("weight") * (1 - F.coalesce("told", F.lit(0)))).withColumn("rest", F.col("rest").cast(number)).where("rest <> 0"), "NULL", "rest")
            down = opened.drop("instrument_id").join(fresh, ["at", "fund_id"]).withColumn("weight", (F.col("weight") * F.col("part")).cast(number))
            met = F.array_contains("path", F.col("instrument_id"))
            tell(down.where(met), "NULL", "weight")
            level = down.where(~met).select(*keys, "at", "instrument_id", "weight", F.concat("path", F.array("instrument_id")).alias("path"))
        rows, *others = parts
        for more in others:
            rows = rows.union(more)
        rows = saved(rows)
    exposures = rows.where("known IS NOT NULL").groupBy(*keys, "instrument_id").agg(F.sum("known").alias("exposure"), F.count("*").alias("n_paths"))
    return exposures, rows.groupBy(*keys).agg(F.coalesce(F.sum("known"), zero).alias("known_weight"), F.sum("unknown").alias("unknown_weight"))
