"""Replay of target schedules, backtests and overfitting diagnostics."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import flow_share, normal_cdf, normal_quantile, ratio
from .covariance import risk_contributions

EULER = 0.5772156649015329


def replay_schedule(targets: DataFrame, returns: DataFrame, keys: list[str], cost_rate: float = 0.0, cash: DataFrame | None = None) -> DataFrame:
    """(keys.., t, turnover, cost, gross, net, wealth, status) of target weights (keys.., t, asset, weight).

    What is held before a trade is the last target grown by the last return, so it needs the row before only.
    An asset without a target on a date of its key has the target zero; the first date of a key starts free.
    `returns(asset, t, ret)`; `cash(t, cash_return)` pays on what is not invested. Status `ruined`: a cost of
    everything or a gross loss of everything, then or before, which leaves no wealth; after it nothing is held.
    `missing_return`: a weight without a return, which counts as zero.
    """
    j = targets.select(*keys, "asset", "t", "weight").join(returns, ["asset", "t"], "left")
    j = j.withColumn("_unknown", F.col("ret").isNull() & (F.col("weight") != 0)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    day = _days(j, keys, cash)
    turn = _trades(j, day, keys).groupBy(*keys, "t").agg(F.sum("trade").alias("turnover"))
    out = day.select(*keys, "t", "gross", "_unknown").join(turn, [*keys, "t"]).withColumn("cost", F.col("turnover") * cost_rate)
    out = out.withColumn("_lost", (F.col("cost") >= 1) | (F.col("gross") <= -1))
    out = out.withColumn("net", F.when(F.col("_lost"), -1.0).otherwise((1 - F.col("cost")) * (1 + F.col("gross")) - 1))
    path = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("wealth", F.product(1 + F.col("net")).over(path)).withColumn("_lost", F.max("_lost").over(path))
    status = F.when(F.col("_lost"), "ruined").when(F.col("_unknown"), "missing_return").otherwise("ok")
    return out.withColumn("status", status).drop("_unknown", "_lost")


def _days(j: DataFrame, keys: list[str], cash: DataFrame | None = None) -> DataFrame:
    """(keys.., t, gross, _unknown, _next, _first): the return of each date, the date after it and the key's first."""
    day = j.groupBy(*keys, "t").agg(F.sum(F.col("weight") * F.col("ret")).alias("_g"), F.sum("weight").alias("_in"), F.max("_unknown").alias("_unknown"))
    day = day.withColumn("_c", F.lit(0.0)) if cash is None else day.join(cash.select("t", F.coalesce("cash_return", F.lit(0.0)).alias("_c")), "t", "left").fillna(0.0, ["_c"])
    per_key = Window.partitionBy(*keys)
    gross = F.col("_g") + (1 - F.col("_in")) * F.col("_c")
    return day.select(*keys, "t", gross.alias("gross"), "_unknown", F.lead("t").over(per_key.orderBy("t")).alias("_next"), F.min("t").over(per_key).alias("_first"))


def _trades(j: DataFrame, day: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., t, asset, trade): targets less what the targets of the date before have grown to, in one sort by asset.

    An asset without a row on the next date is sold there. Nothing is traded on the first date.
    """
    w = Window.partitionBy(*keys, "asset").orderBy("t")
    rows = j.join(day.select(*keys, "t", "gross", "_next", "_first"), [*keys, "t"]).withColumn("_grown", F.coalesce(ratio(F.col("weight") * (1 + F.col("ret")), 1 + F.col("gross")), F.lit(0.0)))
    held = F.when(F.lag("_next").over(w) == F.col("t"), F.lag("_grown").over(w)).otherwise(0.0)
    rows = rows.withColumn("_trade", F.when(F.col("t") == F.col("_first"), 0.0).otherwise(F.abs(F.col("weight") - held))).withColumn("_again", F.lead("t").over(w))
    gone = F.col("_next").isNotNull() & ~F.col("_again").eqNullSafe(F.col("_next"))
    own, sold = F.struct(F.col("t"), F.col("_trade").alias("trade")), F.struct(F.col("_next").alias("t"), F.abs("_grown").alias("trade"))
    return rows.select(*keys, "asset", F.inline(F.when(gone, F.array(own, sold)).otherwise(F.array(own))))


def replay_with_impact(targets: DataFrame, returns: DataFrame, liquidity: DataFrame, keys: list[str], linear_rate: float, coef: float, capital: float) -> DataFrame:
    """(keys.., t, turnover, cost, net, wealth) where the square-root impact depends on the wealth so far.

    Everything but one number for each date is summed first; wealth is then one pass over the dates of a key, four
    numbers each. An asset without liquidity trades without impact; one with none left (ADV 0) costs everything. A cost
    or loss of everything leaves no wealth.
    """
    j = targets.select(*keys, "asset", "t", "weight").join(returns, ["asset", "t"], "left").withColumn("_unknown", F.lit(False)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    day = _days(j, keys)
    d = _trades(j, day, keys).withColumnRenamed("trade", "_d").join(liquidity, "asset", "left")
    a = d.groupBy(*keys, "t").agg(F.sum("_d").alias("turnover"), F.sum(F.when(F.col("_d") == 0, 0.0).otherwise(F.lit(coef) * F.col("volatility") * F.col("_d") * F.sqrt(flow_share(F.col("_d"), F.col("adv"))))).alias("a")).withColumn("a", F.coalesce("a", F.lit(0.0)))
    rows = day.select(*keys, "t", "gross").join(a, [*keys, "t"])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        wealth, out = 1.0, ([], [], [])
        for turnover, gross, a in zip(*(table[c].to_pylist() for c in ("turnover", "gross", "a")), strict=True):
            cost = turnover * linear_rate + (a * math.sqrt(wealth * capital) if a and wealth > 0 else 0.0)
            net = -1.0 if cost >= 1 or gross <= -1 else (1 - cost) * (1 + gross) - 1
            wealth *= 1 + net
            for column, value in zip(out, (cost, net, wealth), strict=True):
                column.append(value)
        return pa.table([*(table[c] for c in (*keys, "t", "turnover")), *(pa.array(c, pa.float64()) for c in out)], names=[*keys, "t", "turnover", "cost", "net", "wealth"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kind[c]}" for c in (*keys, "t", "turnover")) + ", cost double, net double, wealth double"
    return rows.groupBy(*keys).applyInArrow(walk, schema)


def causal_guard(decisions: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., decision_at, rule): decisions with an input not strictly before them, or a clock that does not rise."""
    late = inputs.groupBy(*keys, "decision_at").agg(F.max("available_at").alias("m")).where("m >= decision_at").select(*keys, "decision_at", F.lit("look_ahead").alias("rule"))
    again = decisions.groupBy(*keys, "decision_at").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "decision_at", F.lit("clock").alias("rule"))
    return late.union(again)


def spread_backtest(series: DataFrame, keys: list[str], cost_bps: float) -> DataFrame:
    """`series(keys.., t, spread, position)` with held, gross, cost, net, equity and drawdown.

    The position of a row earns from the next row on; changes are in population standard deviations over 100.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    scale = F.stddev_pop("spread").over(Window.partitionBy(*keys))
    s = series.withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0)))
    s = s.withColumn("_move", F.coalesce(ratio(F.col("spread") - F.lag("spread").over(w), scale) / 100, F.lit(0.0)))
    s = s.withColumn("gross", F.col("held") * F.col("_move")).withColumn("trade", F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0))))
    s = s.withColumn("cost", F.col("trade") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))
    path = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("equity", F.product(1 + F.col("net")).over(path))
    return s.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(path)) - 1).drop("_move")


def backtest_metrics(net: DataFrame, keys: list[str], periods: float = 252.0) -> DataFrame:
    """(keys.., total_return, volatility, sharpe, max_drawdown, turnover, trades, observations) of `net(.., net, drawdown, trade)`."""
    m = net.groupBy(*keys).agg(
        (F.product(1 + F.col("net")) - 1).alias("total_return"),
        F.stddev_pop("net").alias("_s"),
        F.avg("net").alias("_m"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum("trade").cast("double").alias("turnover"),
        F.sum(F.when(F.col("trade") > 0, 1).otherwise(0)).alias("trades"),
        F.count("*").alias("observations"),
    )
    root = math.sqrt(periods)
    return m.select(*keys, "total_return", (F.col("_s") * root).alias("volatility"), F.coalesce(ratio(F.col("_m") * root, F.col("_s")), F.lit(0.0)).alias("sharpe"), "max_drawdown", "turnover", "trades", "observations")


def compare_methods(replays: DataFrame, keys: list[str], max_turnover: float | None = None) -> DataFrame:
    """(keys.., method, total_return, max_drawdown, turnover, periods, breaches) of replays that carry `method`."""
    w = Window.partitionBy(*keys, "method").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    r = replays.withColumn("_dd", F.col("wealth") / F.greatest(F.max("wealth").over(w), F.lit(1.0)) - 1)
    over = F.col("turnover") > max_turnover if max_turnover is not None else F.lit(False)
    return r.groupBy(*keys, "method").agg(
        (F.product(1 + F.col("net")) - 1).alias("total_return"), F.min("_dd").alias("max_drawdown"), F.sum("turnover").alias("turnover"), F.count("*").alias("periods"), F.sum(F.when(over, 1).otherwise(0)).alias("breaches")
    )


def period_risk(targets: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., method, t, volatility, diversification_ratio, top_share) of targets that carry `method`, by `cov(keys.., a <= b, value)`.

    `top_share` is the largest part of the variance that one asset contributes; null where there is no variance.
    """
    by = [*keys, "method", "t"]
    r = risk_contributions(targets, cov, by, keys)
    return r.groupBy(*by).agg(F.max("volatility").alias("volatility"), F.max("diversification_ratio").alias("diversification_ratio"), F.max(ratio(F.col("contribution"), F.col("variance"))).alias("top_share"))


def group_bounds(n: Column, groups: int, g: Column) -> tuple[Column, Column]:
    """[first, past last) row of group g among `groups` contiguous groups of n rows; half-even rounding."""
    return F.bround(n * g / groups).cast("long"), F.bround(n * (g + 1) / groups).cast("long")


def cpcv_splits(sizes: DataFrame, groups: int, test: int, purge: int, embargo: int, keys: list[str]) -> DataFrame:
    """(keys.., split, row, role) for `sizes(keys.., n)`: every choice of test groups; rows near a test block are blocked."""
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << groups) - 1)), lambda m: F.bit_count(m) == test)
    s = sizes.select(*keys, "n", F.posexplode(masks).alias("split", "mask"))
    parts = s.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    lo, hi = group_bounds(F.col("n"), groups, F.col("g"))
    parts = parts.withColumn("lo", lo).withColumn("hi", hi).where(F.shiftright("mask", 0).bitwiseAND(F.expr("shiftleft(1, g)")) != 0)
    blocks = parts.groupBy(*keys, "n", "split").agg(F.collect_list(F.struct("lo", "hi")).alias("blocks"))
    rows = blocks.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    inside = F.exists("blocks", lambda b: (F.col("row") >= b["lo"]) & (F.col("row") < b["hi"]))
    near = F.exists("blocks", lambda b: (F.col("row") >= b["lo"] - purge) & (F.col("row") < b["hi"] + embargo))
    return rows.select(*keys, "split", "row", F.when(inside, "test").when(near, "blocked").otherwise("train").alias("role"))


def deflated_sharpe(returns: DataFrame, keys: list[str], n_trials: int | None = None) -> DataFrame:
    """(keys.., strategy, sharpe, benchmark, probability, trials, observations) of the best strategy by key.

    `returns(keys.., strategy, ret)`. The benchmark is the greatest Sharpe to expect from so many trials; with one
    strategy the trials' dispersion is the sampling variance of its own Sharpe.
    """
    per = returns.groupBy(*keys, "strategy").agg(
        F.count("*").alias("n"), (F.avg("ret") / F.when(F.stddev_samp("ret") > 0, F.stddev_samp("ret"))).alias("sharpe"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt")
    )
    best = per.groupBy(*keys).agg(
        F.min(F.struct((-F.col("sharpe")).alias("less"), "strategy", "sharpe", "n", "skew", "kurt")).alias("b"), F.count("*").alias("found"), F.var_samp("sharpe").alias("spread")
    ).select(*keys, "found", "spread", "b.strategy", "b.sharpe", F.col("b.n").alias("observations"), "b.skew", "b.kurt")
    own = (1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") ** 2) / (F.col("observations") - 1)
    out = best.withColumn("trials", F.lit(n_trials).cast("long") if n_trials else F.col("found")).withColumn("_own", own)
    var = F.when(F.col("found") > 1, F.col("spread")).otherwise(F.col("_own"))
    most = (1 - EULER) * normal_quantile(1 - 1 / F.col("trials")) + EULER * normal_quantile(1 - 1 / (F.col("trials") * math.e))
    out = out.withColumn("benchmark", F.when((F.col("trials") > 1) & (var > 0), F.sqrt(var) * most).otherwise(0.0))
    return out.select(*keys, "strategy", "sharpe", "benchmark", normal_cdf((F.col("sharpe") - F.col("benchmark")) / F.sqrt("_own")).alias("probability"), "trials", "observations")


def backtest_overfitting_probability(returns: DataFrame, groups: int, keys: list[str]) -> DataFrame:
    """(keys.., probability, splits, mean_logit): how often the in-sample winner is below the out-of-sample median.

    `returns(keys.., strategy, row, ret)`, rows from 0. Sums by (strategy, group) are added over the groups of each
    half, so no split sees the rows again.
    """
    n = returns.groupBy(*keys).agg((F.max("row") + 1).alias("n"))
    r = returns.join(n, keys)
    bounds = [F.bround(F.col("n") * (g + 1) / groups).cast("long") for g in range(groups - 1)]
    group = sum((F.when(F.col("row") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    sums = r.groupBy(*keys, "strategy", group.alias("g")).agg(F.count("*").alias("c"), F.sum("ret").alias("s"), F.sum(F.col("ret") ** 2).alias("q"))
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << groups) - 1)), lambda m: F.bit_count(m) == groups // 2)
    split = sums.withColumn("mask", F.explode(masks)).withColumn("inside", F.expr("(mask & shiftleft(1, g)) <> 0"))
    half = split.groupBy(*keys, "mask", "strategy", "inside").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") ** 2 / F.col("c")) / (F.col("c") - 1)
    half = half.withColumn("sharpe", ratio(F.col("s") / F.col("c"), F.sqrt(F.greatest(var, F.lit(0.0)))))
    both = half.groupBy(*keys, "mask", "strategy").agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("si"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("so"))
    winner = both.groupBy(*keys, "mask").agg(F.min(F.struct((-F.col("si")).alias("less"), "strategy", "so")).alias("w")).select(*keys, "mask", F.col("w.so").alias("won"))
    ranks = both.join(winner, [*keys, "mask"]).groupBy(*keys, "mask").agg(
        ((F.sum(F.when(F.col("so") < F.col("won"), 1.0).otherwise(0.0)) + 0.5 * F.sum(F.when(F.col("so") == F.col("won"), 1.0).otherwise(0.0))) / F.count("*")).alias("rank")
    )
    clipped = F.least(F.greatest("rank", F.lit(1e-6)), F.lit(1 - 1e-6))
    return ranks.groupBy(*keys).agg(F.avg(F.when(F.col("rank") < 0.5, 1.0).otherwise(0.0)).alias("probability"), F.count("*").alias("splits"), F.avg(F.log(clipped / (1 - clipped))).alias("mean_logit"))
