"""Trading costs, capacity and cost calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import age_days, flow_share, ratio


def impact_cost(orders: DataFrame, coef: float) -> DataFrame:
    """`orders(.., notional, adv, volatility)` with participation, rate and cost by the square-root law; all infinite without ADV."""
    q = F.abs("notional")
    out = orders.withColumn("participation", flow_share(q, F.col("adv"))).withColumn("rate", F.lit(coef) * F.col("volatility") * F.sqrt("participation"))
    return out.withColumn("cost", F.when(q == 0, 0.0).otherwise(q * F.col("rate")))


def impact_drag(trades: DataFrame, coef: float) -> DataFrame:
    """`trades(.., d, volatility, adv, nav)` with drag, the same law as a share of NAV."""
    d = F.abs("d")
    return trades.withColumn("drag", F.when(d == 0, 0.0).otherwise(F.lit(coef) * F.col("volatility") * d * F.sqrt(flow_share(d * F.col("nav"), F.col("adv")))))


def linear_costs(trades: DataFrame) -> DataFrame:
    """`trades(.., d, buy_rate, sell_rate)` with cost and cost_bps."""
    rate = F.when(F.col("d") >= 0, F.col("buy_rate")).otherwise(F.col("sell_rate"))
    return trades.withColumn("cost", F.abs("d") * rate).withColumn("cost_bps", rate * 1e4)


def capacity(weights: DataFrame, keys: list[str], max_participation: float, days: float) -> DataFrame:
    """(keys.., capacity, binding_asset): `weights(keys.., asset, weight, adv)`; first asset among ties, null if none is active."""
    c = F.col("adv") * max_participation * days / F.abs(F.when(F.col("weight") != 0, F.col("weight")))
    b = weights.withColumn("_c", c).groupBy(*keys).agg(F.min(F.when(F.col("_c").isNotNull(), F.struct("_c", "asset"))).alias("b"))
    return b.select(*keys, F.col("b._c").alias("capacity"), F.col("b.asset").alias("binding_asset"))


def capacity_grid(book: DataFrame, axes: dict[str, list[float]], keys: list[str], impact_coef: float, max_participation: float, days: float) -> tuple[DataFrame, DataFrame]:
    """(cells, detail): costs and breaches for every capital x turnover x liquidity x impact x volatility scale.

    `book(keys.., asset, weight, trade, adv, volatility, linear_rate)`, weights and trades as shares of capital.
    The axes are a few numbers each; they are dealt to rows before the assets are met.
    """
    names = ["capital", "turnover_scale", "liquidity_scale", "impact_scale", "volatility_scale"]
    grid = book.select(*keys).distinct()
    for n in names:
        grid = grid.withColumn(n, F.explode(F.array(*[F.lit(float(v)) for v in axes[n]])))
    j = grid.join(book, keys)
    q = F.abs("trade") * F.col("turnover_scale") * F.col("capital")
    adv = F.col("adv") * F.col("liquidity_scale")
    detail = j.withColumn("notional", q).withColumn("participation", flow_share(q, adv)).withColumn("linear", q * F.col("linear_rate"))
    detail = detail.withColumn("impact", F.when(q == 0, 0.0).otherwise(q * F.lit(impact_coef) * F.col("impact_scale") * F.col("volatility") * F.col("volatility_scale") * F.sqrt("participation")))
    room = adv * max_participation * days
    detail = detail.withColumn("trade_capacity", ratio(adv * max_participation, F.abs("trade") * F.col("turnover_scale"))).withColumn("holding_capacity", ratio(room, F.abs("weight")))
    cells = detail.groupBy(*keys, *names).agg(
        F.sum("linear").alias("linear"), F.sum("impact").alias("impact"), F.max("participation").alias("peak_participation"), F.min("trade_capacity").alias("trade_capacity"), F.min("holding_capacity").alias("holding_capacity")
    )
    cells = cells.withColumn("total", F.col("linear") + F.col("impact")).withColumn("cost_return", ratio(F.col("total"), F.col("capital")))
    cells = cells.withColumn("breach_participation", F.col("peak_participation") > max_participation)
    return cells.withColumn("breach_trade", F.col("trade_capacity") < F.col("capital")).withColumn("breach_holding", F.col("holding_capacity") < F.col("capital")), detail


def calibration_partitions(orders: DataFrame, training_end: str, holdout_start: str, as_of: str, max_reference_age_days: float | None = None) -> DataFrame:
    """`orders` with part: training if accepted, filled and known by its end; holdout if accepted later and known by `as_of`.

    Orders out of order in time, or without a positive ADV or notional, are invalid.
    """
    t = lambda x: F.lit(x).cast("timestamp")
    sane = (F.col("accepted_at") <= F.col("last_fill_at")) & (F.col("last_fill_at") <= F.col("known_at"))
    for c in ("adv_base", "notional_base"):
        if c in orders.columns:
            sane = sane & (F.col(c) > 0)
    if max_reference_age_days is not None:
        sane = sane & (age_days(F.col("accepted_at"), F.col("reference_at")) <= max_reference_age_days)
    training = (F.col("accepted_at") <= t(training_end)) & (F.col("last_fill_at") <= t(training_end)) & (F.col("known_at") <= t(training_end))
    holdout = (F.col("accepted_at") >= t(holdout_start)) & (F.col("known_at") <= t(as_of))
    return orders.withColumn("part", F.when(~F.coalesce(sane, F.lit(False)), "invalid").when(training, "training").when(holdout, "holdout").otherwise("excluded"))


def calibrate_costs(orders: DataFrame, keys: list[str], min_orders: int = 3) -> DataFrame:
    """(keys.., status, intercept, coefficient, baseline, n_training, n_holdout, mae_bps, baseline_mae_bps, signed_bps).

    Notional-weighted least squares of the signed adverse rate on volatility * sqrt(notional / adv), fitted on
    training orders and judged on the holdout.
    """
    x = F.col("daily_volatility") * F.sqrt(ratio(F.col("notional_base"), F.col("adv_base")))
    o = orders.withColumn("_x", x).withColumn("_w", F.col("notional_base")).withColumn("_y", F.col("signed_adverse_rate"))
    tr = o.where("part = 'training'").groupBy(*keys).agg(
        F.count("*").alias("n_training"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("wx"), F.sum(F.col("_w") * F.col("_y")).alias("wy"), F.stddev_pop("_x").alias("spread")
    )
    tr = tr.withColumn("mx", ratio(F.col("wx"), F.col("w"))).withColumn("baseline", ratio(F.col("wy"), F.col("w")))
    c = o.where("part = 'training'").join(tr.select(*keys, "mx", F.col("baseline").alias("my")), keys)
    dx = F.col("_x") - F.col("mx")
    fit = c.groupBy(*keys).agg(F.sum(F.col("_w") * dx * dx).alias("sxx"), F.sum(F.col("_w") * dx * (F.col("_y") - F.col("my"))).alias("sxy"))
    m = tr.join(fit, keys)
    status = F.when(F.col("n_training") < min_orders, "too_few_orders").when(F.col("spread") <= 1e-12, "no_dispersion").otherwise("ok")
    m = m.withColumn("status", status).withColumn("coefficient", F.when(F.col("status") == "ok", ratio(F.col("sxy"), F.col("sxx"))))
    m = m.withColumn("intercept", F.col("baseline") - F.col("coefficient") * F.col("mx"))
    h = o.where("part = 'holdout'").join(m.select(*keys, "intercept", "coefficient", "baseline"), keys)
    miss = F.col("intercept") + F.col("coefficient") * F.col("_x") - F.col("_y")
    judged = h.groupBy(*keys).agg(
        F.count("*").alias("n_holdout"),
        (ratio(F.sum(F.col("_w") * F.abs(miss)), F.sum("_w")) * 1e4).alias("mae_bps"),
        (ratio(F.sum(F.col("_w") * F.abs(F.col("baseline") - F.col("_y"))), F.sum("_w")) * 1e4).alias("baseline_mae_bps"),
        (ratio(F.sum(F.col("_w") * miss), F.sum("_w")) * 1e4).alias("signed_bps"),
    )
    out = m.join(judged, keys, "left")
    return out.select(*keys, "status", "intercept", "coefficient", "baseline", "n_training", F.coalesce("n_holdout", F.lit(0)).alias("n_holdout"), "mae_bps", "baseline_mae_bps", "signed_bps")
