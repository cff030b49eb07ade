"""Constraint audits and feasibility bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import flow_share

TOLERANCE = 1e-7


def constraint_residuals(weights: DataFrame, limits: DataFrame, keys: list[str], group_caps: DataFrame | None = None, groups: DataFrame | None = None, factor_bounds: DataFrame | None = None, loadings: DataFrame | None = None, budget_equality: bool = True, tracking: DataFrame | None = None) -> DataFrame:
    """(keys.., constraint, residual, ok): positive residuals are violations, accepted up to TOLERANCE.

    `weights(keys.., asset, weight, current, lower, upper)`; `limits(keys.., invested, max_turnover)`, where
    `turnover_offset`, if there, is turnover that has happened already, and `max_tracking_error` bounds the
    `tracking(keys.., tracking_error)` of risk.
    """
    w = weights.groupBy(*keys).agg(
        F.sum("weight").alias("total"),
        F.max(F.col("lower") - F.col("weight")).alias("lower"),
        F.max(F.col("weight") - F.col("upper")).alias("upper"),
        F.sum(F.abs(F.col("weight") - F.col("current"))).alias("turnover"),
    )
    j = w.join(limits, keys)
    budget = F.col("total") - F.col("invested")
    spent = F.coalesce("turnover_offset", F.lit(0.0)) if "turnover_offset" in limits.columns else F.lit(0.0)
    rows = F.array(
        F.struct(F.lit("budget").alias("constraint"), (F.abs(budget) if budget_equality else budget).alias("residual")),
        F.struct(F.lit("lower").alias("constraint"), F.col("lower").alias("residual")),
        F.struct(F.lit("upper").alias("constraint"), F.col("upper").alias("residual")),
        F.struct(F.lit("turnover").alias("constraint"), (F.col("turnover") + spent - F.col("max_turnover")).alias("residual")),
    )
    out = j.select(*keys, F.inline(rows))
    if group_caps is not None and groups is not None:
        g = weights.join(groups, "asset").groupBy(*keys, "grp").agg(F.sum("weight").alias("held")).join(group_caps, "grp")
        out = out.union(g.select(*keys, F.concat(F.lit("group:"), "grp"), F.col("held") - F.col("cap")))
    if factor_bounds is not None and loadings is not None:
        e = weights.join(loadings, "asset").groupBy(*keys, "factor").agg(F.sum(F.col("x") * F.col("weight")).alias("e")).join(factor_bounds, "factor")
        both = F.array(F.struct(F.concat(F.lit("factor_lower:"), "factor").alias("constraint"), (F.col("lo") - F.col("e")).alias("residual")), F.struct(F.concat(F.lit("factor_upper:"), "factor").alias("constraint"), (F.col("e") - F.col("hi")).alias("residual")))
        out = out.union(e.select(*keys, F.inline(both)))
    if tracking is not None:
        te = tracking.join(limits.select(*keys, "max_tracking_error"), keys).where("max_tracking_error IS NOT NULL")
        out = out.union(te.select(*keys, F.lit("tracking_error"), F.col("tracking_error") - F.col("max_tracking_error")))
    return out.withColumn("ok", F.col("residual") <= TOLERANCE)


def retained_holdings_audit(problems: DataFrame, residuals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., status): the zero-trade portfolio against its constraints.

    `problems(keys.., cash, tradability_known, extra_assets, weight_gap)`. Unknown where cash is negative, where
    tradability is not known, where assets are outside the problem, or where held weights differ from its own.
    """
    worst = residuals.groupBy(*keys).agg(F.max("residual").alias("worst"))
    unknown = (F.col("cash") < 0) | ~F.coalesce("tradability_known", F.lit(False)) | (F.col("extra_assets") > 0) | (F.col("weight_gap") > 1e-10) | F.col("worst").isNull()
    return problems.join(worst, keys, "left").withColumn("status", F.when(unknown, "unknown").when(F.col("worst") <= TOLERANCE, "compliant").otherwise("noncompliant"))


# Codes of limits that bind.
BINDING_CODES = {
    "gross": "GROSS_LEVERAGE", "min_net": "NET_LEVERAGE_MIN", "max_net": "NET_LEVERAGE_MAX", "turnover": "TURNOVER", "participation": "ADV_PARTICIPATION", "days_to_liquidate": "DAYS_TO_LIQUIDATE",
    "initial_margin_use": "INITIAL_MARGIN", "maintenance_margin_use": "MAINTENANCE_MARGIN", "min_cash": "CASH",
    "asset_class": "ASSET_CLASS", "currency": "CURRENCY", "venue": "VENUE", "strategy": "STRATEGY",
}
BINDING_TOLERANCE = 1e-10


def cross_asset_report(targets: DataFrame, accounts: DataFrame, limits: dict[str, float], keys: list[str], caps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, bindings): totals of each account and the limits that bind: code, observed, allowed and scope.

    `targets(keys.., instrument_id, weight, current, linear_rate, impact_coef, volatility, adv, initial_margin,
    maintenance_margin, margin_mode)`, `accounts(keys.., nav, cash_value)`; money in the account's base. `limits` are
    named as in BINDING_CODES. `caps(bucket, name, cap)` bound the gross weight of one asset_class, currency, venue
    or strategy, which are then columns of `targets`; names in any case.
    """
    d = F.col("weight") - F.col("current")
    j = targets.join(accounts, keys).withColumn("_q", F.abs(d) * F.col("nav"))
    settles = F.col("margin_mode").isin("none", "cash")
    r = j.groupBy(*keys).agg(
        F.sum(F.abs("weight")).alias("gross"),
        F.sum("weight").alias("net"),
        F.sum(F.abs(d)).alias("turnover"),
        F.sum(F.col("_q") * F.col("linear_rate")).alias("linear_cost"),
        F.sum(F.when(F.col("_q") == 0, 0.0).otherwise(F.col("_q") * F.col("impact_coef") * F.col("volatility") * F.sqrt(flow_share(F.col("_q"), F.col("adv"))))).alias("impact_cost"),
        F.sum(F.abs("weight") * F.col("initial_margin")).alias("initial_margin_use"),
        F.sum(F.abs("weight") * F.col("maintenance_margin")).alias("maintenance_margin_use"),
        (F.max("cash_value") - F.sum(F.when(settles, d * F.col("nav")).otherwise(0.0))).alias("_cash"),
        F.max(flow_share(F.col("_q"), F.col("adv"))).alias("max_participation"),
        (F.max(flow_share(F.col("_q"), F.col("adv"))) / limits.get("participation", 0.1)).alias("days_to_liquidate"),
    )
    r = r.withColumn("cash_residual", F.col("_cash") - F.col("linear_cost") - F.col("impact_cost")).drop("_cash")
    at_most = {"gross": "gross", "max_net": "net", "turnover": "turnover", "participation": "max_participation", "days_to_liquidate": "days_to_liquidate", "initial_margin_use": "initial_margin_use", "maintenance_margin_use": "maintenance_margin_use"}
    at_least = {"min_net": ("net", BINDING_TOLERANCE), "min_cash": ("cash_residual", 0.0)}
    row = lambda code, seen, broken: F.struct(F.lit(BINDING_CODES[code]).alias("code"), F.col(seen).cast("double").alias("observed"), F.lit(float(limits[code])).alias("allowed"), F.lit("portfolio").alias("scope"), broken.alias("_broken"))
    rows = [row(c, seen, F.col(seen) > limits[c] + BINDING_TOLERANCE) for c, seen in at_most.items() if c in limits]
    rows += [row(c, seen, F.col(seen) < limits[c] - slack) for c, (seen, slack) in at_least.items() if c in limits]
    shape = "array<struct<code string, observed double, allowed double, scope string, _broken boolean>>"
    bindings = r.select(*keys, F.inline(F.array(*rows).cast(shape))).where("_broken").drop("_broken")
    if caps is not None:
        names = [b for b in ("asset_class", "currency", "venue", "strategy") if b in targets.columns]
        each = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lower(b).alias("_name")) for b in names]))
        held = targets.select(*keys, F.abs("weight").alias("_w"), each.alias("_b")).groupBy(*keys, "_b.bucket", "_b._name").agg(F.sum("_w").alias("observed"))
        c = held.join(caps.select("bucket", F.lower("name").alias("_name"), F.col("name").alias("scope"), F.col("cap").alias("allowed")), ["bucket", "_name"])
        code = F.coalesce(*[F.when(F.col("bucket") == b, BINDING_CODES[b]) for b in names])
        bindings = bindings.union(c.where(F.col("observed") > F.col("allowed") + BINDING_TOLERANCE).select(*keys, code, "observed", "allowed", "scope"))
    return r, bindings


def minimum_turnover_bound(weights: DataFrame, keys: list[str], invested: float, groups: DataFrame | None = None, group_caps: DataFrame | None = None) -> DataFrame:
    """(keys.., bound): the least turnover that any feasible portfolio needs.

    The budget gap, the trades that bounds force, and per group its forced sales with the buys they force outside.
    """
    w = weights.withColumn("_sell", F.greatest(F.col("current") - F.col("upper"), F.lit(0.0))).withColumn("_buy", F.greatest(F.col("lower") - F.col("current"), F.lit(0.0)))
    base = w.groupBy(*keys).agg(F.abs(F.lit(invested) - F.sum("current")).alias("gap"), (F.sum("_sell") + F.sum("_buy")).alias("forced"), F.sum("current").alias("held"))
    if groups is None or group_caps is None:
        return base.select(*keys, F.greatest("gap", "forced").alias("bound"))
    g = w.join(groups, "asset").groupBy(*keys, "grp").agg(F.sum("current").alias("inside")).join(group_caps, "grp").join(base, keys)
    sale = F.greatest(F.col("inside") - F.col("cap"), F.lit(0.0))
    outside = F.greatest(F.lit(invested) - F.col("cap") - (F.col("held") - F.col("inside")), F.lit(0.0))
    per = g.groupBy(*keys).agg(F.max(F.when(sale > 0, sale + outside).otherwise(0.0)).alias("group_bound"))
    return base.join(per, keys, "left").select(*keys, F.greatest("gap", "forced", F.coalesce("group_bound", F.lit(0.0))).alias("bound"))


def factor_attainable_range(loadings: DataFrame, bounds: DataFrame, keys: list[str], invested: float = 1.0) -> DataFrame:
    """(keys.., factor, low, high): least and greatest x'w on the capped simplex, filled greedily.

    `bounds(keys.., asset, lower, upper)`.
    """
    j = bounds.join(loadings, "asset").withColumn("_room", F.col("upper") - F.col("lower"))
    all_ = Window.partitionBy(*keys, "factor")
    j = j.withColumn("_free", F.lit(invested) - F.sum("lower").over(all_))
    for name, order in (("low", [F.col("x"), F.col("asset")]), ("high", [F.col("x").desc(), F.col("asset")])):
        before = F.coalesce(F.sum("_room").over(all_.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        fill = F.least(F.col("_room"), F.greatest(F.col("_free") - before, F.lit(0.0)))
        j = j.withColumn(f"_{name}", F.col("x") * (F.col("lower") + fill))
    return j.groupBy(*keys, "factor").agg(F.sum("_low").alias("low"), F.sum("_high").alias("high"))


def bounds_feasibility(bounds: DataFrame, keys: list[str], invested: float, groups: DataFrame | None = None, group_caps: DataFrame | None = None) -> DataFrame:
    """(keys.., sum_lower, sum_upper, status): boxes against the budget, group caps against members' minimums."""
    b = bounds.groupBy(*keys).agg(F.sum("lower").alias("sum_lower"), F.sum("upper").alias("sum_upper"), F.max(F.when(F.col("lower") > F.col("upper"), 1).otherwise(0)).alias("_crossed"))
    status = F.when(F.col("_crossed") == 1, "crossed_bounds").when(F.col("sum_lower") > invested + 1e-12, "lower_above_budget").when(F.col("sum_upper") < invested - 1e-12, "upper_below_budget")
    if groups is not None and group_caps is not None:
        member = bounds.join(groups, "asset", "left").groupBy(*keys, F.coalesce("grp", F.lit("__ungrouped__")).alias("grp")).agg(F.sum("lower").alias("lo"), F.sum("upper").alias("hi"))
        m = member.join(group_caps, "grp", "left").groupBy(*keys).agg(F.max(F.when(F.col("lo") > F.col("cap") + 1e-12, 1).otherwise(0)).alias("_over"), F.sum(F.least("hi", F.coalesce("cap", "hi"))).alias("_room"))
        b = b.join(m, keys)
        status = status.when(F.col("_over") == 1, "group_minimum_above_cap").when(F.col("_room") < invested - 1e-12, "group_capacity_below_budget")
    return b.select(*keys, "sum_lower", "sum_upper", status.otherwise("feasible").alias("status"))


def publishing_summary(decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys.., decisions, published, rate, longest_gap): the longest run without a published target."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = decisions.withColumn("_i", F.sum(F.when(F.col("published"), 1).otherwise(0)).over(w))
    runs = island.groupBy(*keys, "_i").agg(F.sum(F.when(F.col("published"), 0).otherwise(1)).alias("_run"), F.count("*").alias("_n"), F.sum(F.when(F.col("published"), 1).otherwise(0)).alias("_p"))
    return runs.groupBy(*keys).agg(F.sum("_n").alias("decisions"), F.sum("_p").alias("published"), (F.sum("_p") / F.sum("_n")).alias("rate"), F.max("_run").alias("longest_gap"))


def failure_causes(decisions: DataFrame, keys: list[str]) -> DataFrame:
    return decisions.where("NOT published").groupBy(*keys, "status").agg(F.count("*").alias("n"))
