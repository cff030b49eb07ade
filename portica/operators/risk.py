"""Risk measures and objective scoring of candidate portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ratio
from .blocks import attach
from .covariance import portfolio_variance


def scenario_pnl(weights: DataFrame, scenarios: DataFrame, keys: list[str], scenario_keys: list[str] | None = None) -> DataFrame:
    """(keys.., scenario_no, pnl): portfolio return in each scenario."""
    on = [*(scenario_keys or []), "asset"]
    return weights.join(scenarios, on).groupBy(*keys, "scenario_no").agg(F.sum(F.col("weight") * F.col("ret")).alias("pnl"))


def drawdown_path(pnl: DataFrame, keys: list[str], order: str = "scenario_no") -> DataFrame:
    """`pnl` with drawdown: drop of the cumulative simple return from its running peak, the peak never below 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = pnl.withColumn("_c", F.sum("pnl").over(w))
    return p.withColumn("drawdown", F.greatest(F.max("_c").over(w), F.lit(0.0)) - F.col("_c")).drop("_c")


def max_drawdown(pnl: DataFrame, keys: list[str], order: str = "scenario_no") -> DataFrame:
    return drawdown_path(pnl, keys, order).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))


def wealth_drawdown(equity: DataFrame, keys: list[str], opening: float | None = None) -> DataFrame:
    """`equity(keys.., t, equity)` with drawdown: equity over its running peak less one, null where the peak is 0; the opening capital may count."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    if opening is not None:
        peak = F.greatest(peak, F.lit(opening))
    return equity.withColumn("drawdown", ratio(F.col("equity"), peak) - 1)


#: Rank error of the first brackets of an order statistic, as a share of a key's rows: one in ACCURACY.
ACCURACY = 10_000


def order_statistic(values: DataFrame, keys: list[str], rank: Column, share: float, column: str = "loss") -> DataFrame:
    """(keys.., value): the value of a rank, from 1, in each key; `rank` is an expression of `_n`, a key's values, near share * _n.

    A sketch of fixed size brackets the value; exact counts say whether it is one of the two ends, which may be
    tied however often, or between which of them it lies. Only rows there, a few thousandths of a percent of a large
    key, are put in order, so no task holds or sorts a key. Nulls are left out.
    """
    rows = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_x"))
    shares = [max(share - 2 / ACCURACY, 0.0), min(share + 2 / ACCURACY, 1.0)]
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", shares, ACCURACY).alias("_e"))
    ends = ends.select(*keys, rank.cast("long").alias("_rank"), F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    place = F.when(x < lo, 0).when(x == lo, 1).when(x < hi, 2).when(x == hi, 3).otherwise(4)
    placed = attach(rows, ends, keys).withColumn("_place", place)
    counts = placed.groupBy(*keys).agg(F.max("_rank").alias("_rank"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.sum(F.when(F.col("_place") == p, 1).otherwise(0)).alias(f"_c{p}") for p in range(5)])
    before = [F.lit(0).cast("long")]
    for p in range(4):
        before.append(before[-1] + F.col(f"_c{p}"))
    where_, skipped = F.lit(4), before[4]
    for p in range(3, -1, -1):
        inside = F.col("_rank") <= before[p + 1]
        where_, skipped = F.when(inside, p).otherwise(where_), F.when(inside, before[p]).otherwise(skipped)
    asked = counts.select(*keys, where_.alias("_where"), (F.col("_rank") - skipped).alias("_left"), F.col("_lo"), F.col("_hi"))
    tied = asked.where("_where IN (1, 3)").select(*keys, F.when(F.col("_where") == 1, F.col("_lo")).otherwise(F.col("_hi")).alias("value"))
    few = attach(placed.drop("_rank", "_lo", "_hi"), asked.where("_where NOT IN (1, 3)").select(*keys, "_where", "_left"), keys).where("_place = _where")
    order = Window.partitionBy(*keys).orderBy("_x")
    return tied.union(few.withColumn("_r", F.row_number().over(order)).where("_r = _left").select(*keys, F.col("_x").alias("value")))


def _tail(losses: DataFrame, keys: list[str], beta: float, rank: Column) -> DataFrame:
    """(keys.., var, value): q + mean(max(l - q, 0)) / (1 - beta), where q is the order statistic of the given rank."""
    some = losses.where("loss IS NOT NULL")
    q = order_statistic(some, keys, rank, beta).withColumnRenamed("value", "var")
    return attach(some, q, keys).groupBy(*keys).agg(F.first("var").alias("var"), (F.first("var") + F.avg(F.greatest(F.col("loss") - F.col("var"), F.lit(0.0))) / (1 - beta)).alias("value"))


def cvar(losses: DataFrame, keys: list[str], beta: float) -> DataFrame:
    """(keys.., var, value): the least of the Rockafellar-Uryasev form, attained at order statistic ceil(n beta)."""
    return _tail(losses, keys, beta, F.greatest(F.ceil(F.round(F.col("_n") * beta, 9)), F.lit(1)))


def cdar(pnl: DataFrame, keys: list[str], beta: float, quantile_rule: str = "higher", order: str = "scenario_no") -> DataFrame:
    """(keys.., var, value): the tail form on drawdowns; the quantile is the minimiser or the next higher order statistic."""
    losses = drawdown_path(pnl, keys, order).select(*keys, F.col("drawdown").alias("loss"))
    if quantile_rule == "minimum":
        return cvar(losses, keys, beta)
    return _tail(losses, keys, beta, F.least(F.ceil(F.round((F.col("_n") - 1) * beta, 9)) + 1, F.col("_n")))


def evar(losses: DataFrame, keys: list[str], beta: float, points: int = 40, rounds: int = 3) -> DataFrame:
    """(keys.., value, temperature): min over T of T (log mean exp(l / T) - log(1 - beta)).

    Rounds of a geometric grid, each one aggregate over (key, grid point), around the best point of the round
    before. The exponent is shifted by the greatest loss.
    """
    top = losses.groupBy(*keys).agg(F.max("loss").alias("_top"), F.greatest(F.max(F.abs("loss")), F.lit(1e-12)).alias("_scale"))
    lo, hi = F.col("_scale") * 1e-4, F.col("_scale") * 1e3
    for _ in range(rounds):
        grid = top.select(*keys, "_top", "_scale", lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
        grid = grid.withColumn("_t", F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), F.col("_i") / (points - 1)))
        sums = losses.join(grid, keys).groupBy(*keys, "_top", "_scale", "_lo", "_hi", "_i", "_t").agg(F.avg(F.exp((F.col("loss") - F.col("_top")) / F.col("_t"))).alias("_m"))
        value = F.col("_top") + F.col("_t") * (F.log("_m") - F.log(F.lit(1 - beta)))
        best = sums.groupBy(*keys, "_top", "_scale", "_lo", "_hi").agg(F.min(F.struct(value.alias("value"), F.col("_i").alias("i"), F.col("_t").alias("t"))).alias("b"))
        step = F.pow(F.col("_hi") / F.col("_lo"), F.lit(1 / (points - 1)))
        top = best.select(*keys, "_top", "_scale", F.col("b.value").alias("value"), F.col("b.t").alias("temperature"), (F.col("b.t") / step).alias("_nlo"), (F.col("b.t") * step).alias("_nhi"))
        lo, hi = F.col("_nlo"), F.col("_nhi")
    return top.select(*keys, "value", "temperature")


def sharpe_ratio(portfolios: DataFrame, rf: float = 0.0) -> DataFrame:
    """`portfolios(.., mean, variance)` with sharpe and a status that keeps undefined cases apart."""
    excess = F.col("mean") - rf
    status = F.when(F.col("variance") <= 1e-18, "undefined_ratio").when(excess <= 0, "no_positive_excess_return").otherwise("ok")
    return portfolios.withColumn("status", status).withColumn("sharpe", F.when(F.col("status") == "ok", excess / F.sqrt("variance")))


def excess_return_ratio(portfolios: DataFrame) -> DataFrame:
    """`portfolios(.., mean, benchmark_mean, tracking_error)` with active return over tracking error, as sharpe_ratio."""
    active = F.col("mean") - F.col("benchmark_mean")
    status = F.when(F.col("tracking_error") <= 1e-9, "undefined_ratio").when(active <= 0, "no_positive_excess_return").otherwise("ok")
    return portfolios.withColumn("status", status).withColumn("ratio", F.when(F.col("status") == "ok", active / F.col("tracking_error")))


def target_distance_values(candidates: DataFrame, target: DataFrame, keys: list[str], linear: DataFrame | None = None, turnover_penalty: float = 0.0, impact: DataFrame | None = None) -> DataFrame:
    """(keys.., kind, value, status): less the squared distance of candidates (keys.., asset, weight) to `target(asset, weight)`.

    With `linear(asset, held, buy_rate, sell_rate)` the costs of the way from `held` count too, with the penalty
    on turnover, and with `impact(asset, coef)` the 3/2-power impact. An asset on one side only has weight zero on
    the other.
    """
    names = target.select("asset").union(linear.select("asset") if linear is not None else target.select("asset")).distinct()
    grid = candidates.select(*keys).distinct().crossJoin(names).select(*keys, "asset").union(candidates.select(*keys, "asset")).distinct()
    zero = F.lit(0.0)
    j = grid.join(candidates, [*keys, "asset"], "left").join(target.withColumnRenamed("weight", "_target"), "asset", "left")
    j = j.withColumn("weight", F.coalesce("weight", zero)).withColumn("_target", F.coalesce("_target", zero))
    paid = zero
    if linear is not None:
        j = j.join(linear, "asset", "left").withColumn("_d", F.col("weight") - F.coalesce("held", zero))
        paid = F.when(F.col("_d") > 0, F.col("_d") * F.coalesce("buy_rate", zero)).otherwise(-F.col("_d") * F.coalesce("sell_rate", zero)) + F.abs("_d") * turnover_penalty
        if impact is not None:
            j = j.join(impact, "asset", "left")
            paid = paid + F.coalesce("coef", zero) * F.pow(F.abs("_d"), F.lit(1.5))
    total = j.groupBy(*keys).agg((-F.sum((F.col("weight") - F.col("_target")) ** 2 + paid)).alias("value"))
    return total.select(*keys, F.lit("target_distance").alias("kind"), "value", F.lit("ok").alias("status"))


def tail_values(pnl: DataFrame, keys: list[str], beta: float) -> DataFrame:
    """(keys.., kind, value, status): less CVaR, EVaR and CDaR of candidates' `pnl(keys.., scenario_no, pnl)`."""
    losses = pnl.select(*keys, (-F.col("pnl")).alias("loss"))
    parts = [("cvar", cvar(losses, keys, beta)), ("evar", evar(losses, keys, beta)), ("cdar", cdar(pnl, keys, beta))]
    rows = [df.select(*keys, F.lit(kind).alias("kind"), (-F.col("value")).alias("value"), F.lit("ok").alias("status")) for kind, df in parts]
    return rows[0].union(rows[1]).union(rows[2])


def diversification_ratio(weights: DataFrame, cov: DataFrame, keys: list[str], cov_keys: list[str] | None = None) -> DataFrame:
    """(keys.., ratio): w' sigma over the portfolio's volatility; null at zero volatility."""
    own = cov.where("a = b").select(*(cov_keys or []), F.col("a").alias("asset"), F.sqrt("value").alias("sigma"))
    alone = weights.join(own, [*(cov_keys or []), "asset"]).groupBy(*keys).agg(F.sum(F.col("weight") * F.col("sigma")).alias("alone"))
    var = portfolio_variance(weights, cov, keys, cov_keys)
    return alone.join(var, keys).select(*keys, ratio(F.col("alone"), F.sqrt("variance")).alias("ratio"))


def _paid(d: Column, turnover_penalty: float, impact: bool) -> Column:
    """Costs of a trade d: linear by side, a penalty on its size and the 3/2-power impact."""
    zero = F.lit(0.0)
    paid = F.when(d > 0, d * F.coalesce("buy_rate", zero)).otherwise(-d * F.coalesce("sell_rate", zero)) + F.abs(d) * turnover_penalty
    return paid + F.coalesce("coef", zero) * F.pow(F.abs(d), F.lit(1.5)) if impact else paid


def _ways(candidates: DataFrame, current: DataFrame, costs: DataFrame, keys: list[str], turnover_penalty: float, impact: DataFrame | None) -> DataFrame:
    """(keys.., cost) of the way from `current(asset, weight)`: what all of it would cost to sell, mended for the assets that a candidate keeps."""
    rates = costs if impact is None else costs.join(impact, "asset", "full_outer")
    held = current.select("asset", F.col("weight").alias("held")).join(rates, "asset", "full_outer")
    held = held.withColumn("held", F.coalesce("held", F.lit(0.0))).withColumn("_sold", _paid(-F.col("held"), turnover_penalty, impact is not None))
    sold = held.agg(F.coalesce(F.sum("_sold"), F.lit(0.0))).scalar()
    d = candidates.join(held, "asset", "left").withColumn("_d", F.col("weight") - F.coalesce("held", F.lit(0.0)))
    mended = d.groupBy(*keys).agg(F.sum(_paid(F.col("_d"), turnover_penalty, impact is not None) - F.coalesce("_sold", F.lit(0.0))).alias("_mended"))
    return mended.select(*keys, (F.col("_mended") + sold).alias("cost"))


def _active_variance(variance: DataFrame, candidates: DataFrame, benchmark: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., active): (w - b)' S (w - b) as w'Sw - 2 w'Sb + b'Sb, so the benchmark is multiplied once for all candidates."""
    both = cov.select("a", "b", "value").union(cov.where("a < b").select(F.col("b"), F.col("a"), "value"))
    sb = both.join(benchmark.select(F.col("asset").alias("b"), F.col("weight").alias("_b")), "b").groupBy(F.col("a").alias("asset")).agg(F.sum(F.col("value") * F.col("_b")).alias("_sb"))
    own = sb.join(benchmark.select("asset", F.col("weight").alias("_b")), "asset").agg(F.coalesce(F.sum(F.col("_sb") * F.col("_b")), F.lit(0.0))).scalar()
    cross = candidates.join(sb, "asset").groupBy(*keys).agg(F.sum(F.col("weight") * F.col("_sb")).alias("_cross"))
    active = F.greatest(F.col("variance") - 2 * F.coalesce("_cross", F.lit(0.0)) + own, F.lit(0.0))
    return variance.join(cross, keys, "left").select(*keys, active.alias("active"))


def objective_values(
    candidates: DataFrame, mu: DataFrame, cov: DataFrame, keys: list[str], risk_aversion: float = 4.0, rf: float = 0.0, costs: DataFrame | None = None, current: DataFrame | None = None,
    benchmark: DataFrame | None = None, turnover_penalty: float = 0.0, impact: DataFrame | None = None, scenarios: DataFrame | None = None, beta: float = 0.95, target: DataFrame | None = None,
) -> DataFrame:
    """(keys.., kind, value, status) for candidate portfolios (keys.., asset, weight), as best_feasible_candidate ranks them.

    Kinds: mean_variance, sharpe and diversification; with `scenarios(scenario_no, asset, ret)` also cvar, evar and
    cdar, with `target(asset, weight)` also target_distance. Costs of the way from `current(asset, weight)` count in
    mean_variance and target_distance, not in the ratios: linear at `costs(asset, buy_rate, sell_rate)`, a penalty on turnover
    and `impact(asset, coef)` times the 3/2-power of a trade. With `benchmark(asset, weight)` the risk of
    mean_variance is that of the active weights.
    """
    means = candidates.join(mu, "asset").groupBy(*keys).agg(F.sum(F.col("weight") * F.col("mu")).alias("mean"))
    variance = portfolio_variance(candidates, cov, keys)
    base = means.join(variance, keys).join(diversification_ratio(candidates, cov, keys), keys, "left")
    base = base.withColumn("risk", F.col("variance")) if benchmark is None else base.join(_active_variance(variance, candidates, benchmark, cov, keys).withColumnRenamed("active", "risk"), keys)
    paid = costs is not None and current is not None
    base = base.join(_ways(candidates, current, costs, keys, turnover_penalty, impact), keys) if paid else base.withColumn("cost", F.lit(0.0))
    s = sharpe_ratio(base, rf)
    rows = F.array(
        F.struct(F.lit("mean_variance").alias("kind"), (F.col("mean") - F.lit(risk_aversion / 2) * F.col("risk") - F.col("cost")).alias("value"), F.lit("ok").alias("status")),
        F.struct(F.lit("sharpe").alias("kind"), F.col("sharpe").alias("value"), F.col("status").alias("status")),
        F.struct(F.lit("diversification").alias("kind"), F.col("ratio").alias("value"), F.when(F.col("ratio").isNull(), "undefined_ratio").otherwise("ok").alias("status")),
    )
    out = s.select(*keys, F.inline(rows))
    if scenarios is not None:
        out = out.union(tail_values(scenario_pnl(candidates, scenarios, keys), keys, beta))
    if target is not None:
        linear = costs.join(current.withColumnRenamed("weight", "held"), "asset", "full_outer") if paid else None
        out = out.union(target_distance_values(candidates, target, keys, linear, turnover_penalty, impact))
    return out


def best_feasible_candidate(values: DataFrame, violations: DataFrame, keys: list[str], portfolio: str = "portfolio_id") -> DataFrame:
    """(keys.., kind, portfolio, value, status): the best value by key and kind among portfolios without a violation.

    Ties go to the first portfolio id. Without a feasible one the status is infeasible, without a defined value it
    is that of the values.
    """
    ok = values.join(violations.select(*keys, portfolio).distinct(), [*keys, portfolio], "left_anti")
    best = ok.groupBy(*keys, "kind").agg(
        F.min(F.when(F.col("status") == "ok", F.struct((-F.col("value")).alias("less"), F.col(portfolio).alias("p")))).alias("b"), F.min(F.when(F.col("status") != "ok", F.col("status"))).alias("why")
    )
    asked = values.select(*keys, "kind").distinct()
    j = asked.join(best, [*keys, "kind"], "left")
    status = F.when(F.col("b").isNotNull(), "ok").otherwise(F.coalesce("why", F.lit("infeasible")))
    return j.select(*keys, "kind", F.col("b.p").alias(portfolio), (-F.col("b.less")).alias("value"), status.alias("status"))


def candidate_grid(universe: DataFrame, steps: int, keys: list[str]) -> DataFrame:
    """(keys.., portfolio_id, asset, weight): all ways to deal `steps` equal parts to the assets of each key.

    Grows one asset at a time and keeps only partial sums within the whole; the last asset takes the rest.
    """
    listed = universe.groupBy(*keys).agg(F.sort_array(F.collect_set("asset")).alias("assets"))
    most = listed.agg(F.max(F.size("assets")).alias("m")).first()["m"] or 0
    g = listed.withColumn("parts", F.array().cast("array<int>"))
    used = F.aggregate("parts", F.lit(0), lambda a, x: a + x)
    for i in range(most):
        n = F.size("assets")
        choice = F.when(n > i + 1, F.sequence(F.lit(0), F.lit(steps) - used)).when(n == i + 1, F.array(F.lit(steps) - used)).otherwise(F.array(F.lit(-1)))
        g = g.withColumn("c", F.explode(choice)).withColumn("parts", F.when(F.col("c") >= 0, F.concat("parts", F.array("c"))).otherwise(F.col("parts"))).drop("c")
    g = g.withColumn("portfolio_id", F.array_join(F.transform("parts", lambda x: x.cast("string")), "-"))
    return g.select(*keys, "portfolio_id", F.inline(F.arrays_zip(F.col("assets").alias("asset"), F.col("parts").alias("part")))).select(*keys, "portfolio_id", "asset", (F.col("part") / steps).alias("weight"))
