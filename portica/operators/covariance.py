"""Covariance and dependence over long panels (keys.., t, asset, ret).

Estimators give long upper triangles (keys.., a, b, value) with a <= b. They are not repaired to positive
definiteness; where the sample cannot support it, `may_be_singular` says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import check_rows
from ..functions.columns import ratio
from .blocks import attach, pair_sums


def _demeaned(returns: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "asset")
    return returns.select(*keys, "t", "asset", (F.col("ret") - F.avg("ret").over(w)).alias("x"))


def pair_moments(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., a, b, n, s11, s22, s31, s13): moments of demeaned values that the estimators share, by block products."""
    products = {f"s{p}{q}": (("x", p), ("x", q)) for p, q in ((1, 1), (2, 2), (3, 1), (1, 3))}
    return pair_sums(_demeaned(returns.where("ret IS NOT NULL"), keys), keys, ["x"], products)


def panel_checks(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., asset, rule): assets without a value at some t of their key, and assets that do not vary.

    The shrinkage estimators (E3 to E7) need panels without the first, E7 without the second.
    """
    per = returns.groupBy(*keys, "asset").agg(F.count("ret").alias("n"), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    times = returns.select(*keys, "t").distinct().groupBy(*keys).agg(F.count("*").alias("times"))
    return check_rows(attach(per, times, keys), {"incomplete": F.col("n") < F.col("times"), "no_variance": F.col("lo").eqNullSafe(F.col("hi"))}, [*keys, "asset"])


def _joint(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over the common rows of each pair, values demeaned by asset."""
    products = {f"s{p}{q}": (("x", p), ("x", q)) for p, q in ((1, 1), (1, 0), (0, 1), (2, 0), (0, 2))}
    return pair_sums(_demeaned(returns.where("ret IS NOT NULL"), keys), keys, ["x"], products)


def cov_diagonal(returns: DataFrame, keys: list[str], shrinkage: float = 0.2, annualization: float = 252.0) -> DataFrame:
    """Pairwise-complete sample covariance; off-diagonals shrunk toward zero. Pairs need two joint rows."""
    out = _joint(returns, keys).where("n >= 2").withColumn("c", (F.col("s11") - F.col("s10") * F.col("s01") / F.col("n")) / (F.col("n") - 1))
    scale = F.when(F.col("a") == F.col("b"), F.lit(annualization)).otherwise(F.lit(annualization * (1 - shrinkage)))
    return out.select(*keys, "a", "b", "n", (F.col("c") * scale).alias("value"))


def _traces(moments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., n_obs, n_assets, tr, fro): observations, assets, trace and squared Frobenius norm of S = s11 / T."""
    s = F.col("s11") / F.col("n")
    diag = F.col("a") == F.col("b")
    return moments.groupBy(*keys).agg(
        F.max("n").cast("double").alias("n_obs"),
        F.sum(F.when(diag, 1.0).otherwise(0.0)).alias("n_assets"),
        F.sum(F.when(diag, s).otherwise(0.0)).alias("tr"),
        F.sum(F.when(diag, s * s).otherwise(2 * s * s)).alias("fro"),
    )


def _toward_identity(moments: DataFrame, intensities: DataFrame, keys: list[str], annualization: float) -> DataFrame:
    j = attach(moments, intensities.select(*keys, "n_obs", "n_assets", "tr", "intensity"), keys)
    s, mu = F.col("s11") / F.col("n"), F.col("tr") / F.col("n_assets")
    target = F.when(F.col("a") == F.col("b"), mu).otherwise(0.0)
    value = ((1 - F.col("intensity")) * s + F.col("intensity") * target) * annualization
    return j.select(*keys, "a", "b", value.alias("value"), "intensity", ((F.col("n_obs") <= F.col("n_assets")) & (F.col("intensity") == 0)).alias("may_be_singular"))


def cov_ledoit_wolf(returns: DataFrame, keys: list[str], annualization: float = 252.0, moments: DataFrame | None = None) -> DataFrame:
    """Shrinkage toward the mean variance times identity, intensity by the sampling error of S."""
    m = pair_moments(returns, keys) if moments is None else moments
    rows = _demeaned(returns, keys).groupBy(*keys, "t").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    fourth = rows.groupBy(*keys).agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    t = attach(_traces(m, keys), fourth, keys)
    mu = F.col("tr") / F.col("n_assets")
    beta = (F.col("q2") / F.col("n_obs") - F.col("fro")) / (F.col("n_assets") * F.col("n_obs"))
    delta = (F.col("fro") - 2 * mu * F.col("tr") + F.col("n_assets") * mu * mu) / F.col("n_assets")
    intensity = F.when((beta > 0) & (delta > 0), F.least(beta, delta) / F.when(delta > 0, delta)).otherwise(0.0)
    return _toward_identity(m, t.withColumn("intensity", intensity), keys, annualization)


def cov_oas(returns: DataFrame, keys: list[str], annualization: float = 252.0, moments: DataFrame | None = None) -> DataFrame:
    """Oracle-approximating shrinkage toward the mean variance times identity."""
    m = pair_moments(returns, keys) if moments is None else moments
    t = _traces(m, keys)
    top = (1 - 2 / F.col("n_assets")) * F.col("fro") + F.col("tr") ** 2
    low = (F.col("n_obs") + 1 - 2 / F.col("n_assets")) * (F.col("fro") - F.col("tr") ** 2 / F.col("n_assets"))
    intensity = F.when(low <= 0, 1.0).otherwise(F.least(F.greatest(top / F.when(low > 0, low), F.lit(0.0)), F.lit(1.0)))
    return _toward_identity(m, t.withColumn("intensity", intensity), keys, annualization)


def cov_constant_correlation(returns: DataFrame, keys: list[str], annualization: float = 252.0, moments: DataFrame | None = None) -> DataFrame:
    """Shrinkage toward own variances with one mean correlation."""
    m = pair_moments(returns, keys) if moments is None else moments
    diag = m.where("a = b").select(*keys, F.col("a").alias("i"), (F.col("s11") / F.col("n")).alias("v"))
    j = m.join(diag.select(*keys, F.col("i").alias("a"), F.col("v").alias("va")), [*keys, "a"]).join(diag.select(*keys, F.col("i").alias("b"), F.col("v").alias("vb")), [*keys, "b"])
    j = j.withColumn("s", F.col("s11") / F.col("n")).withColumn("root", F.sqrt(F.col("va") * F.col("vb")))
    off = F.col("a") < F.col("b")
    mean = j.groupBy(*keys).agg(F.avg(F.when(off, ratio(F.col("s"), F.col("root")))).alias("rbar"))
    j = attach(j, mean, keys)
    target = F.when(off, F.col("rbar") * F.col("root")).otherwise(F.col("s"))
    pi = F.col("s22") / F.col("n") - F.col("s") ** 2
    up = F.col("s31") / F.col("n") - F.col("va") * F.col("s")
    down = F.col("s13") / F.col("n") - F.col("vb") * F.col("s")
    rho_off = F.col("rbar") * (F.sqrt(ratio(F.col("vb"), F.col("va"))) * up + F.sqrt(ratio(F.col("va"), F.col("vb"))) * down)
    gap = (F.col("s") - target) ** 2
    per = j.groupBy(*keys).agg(
        F.max("n").alias("n_obs"),
        F.sum(F.when(off, 2 * pi).otherwise(pi)).alias("phi"),
        F.sum(F.when(off, rho_off).otherwise(pi)).alias("rho"),
        F.sum(F.when(off, 2 * gap).otherwise(gap)).alias("gamma"),
    )
    k = F.when(F.col("gamma") > 0, (F.col("phi") - F.col("rho")) / F.when(F.col("gamma") > 0, F.col("gamma")) / F.col("n_obs")).otherwise(0.0)
    out = attach(j.withColumn("target", target), per.select(*keys, F.least(F.greatest(k, F.lit(0.0)), F.lit(1.0)).alias("intensity")), keys)
    return out.select(*keys, "a", "b", (((1 - F.col("intensity")) * F.col("s") + F.col("intensity") * F.col("target")) * annualization).alias("value"), "intensity")


def cov_ewma(returns: DataFrame, keys: list[str], decay: float = 0.94, annualization: float = 252.0) -> DataFrame:
    """Exponentially weighted second moments, no demeaning, weights adding to one."""
    w = Window.partitionBy(*keys, "asset").orderBy(F.col("t").desc())
    aged = returns.withColumn("u", F.pow(F.lit(decay), F.row_number().over(w) - 1))
    aged = aged.select(*keys, "t", "asset", "ret", "u", (F.col("u") * F.col("ret")).alias("v"))
    p = pair_sums(aged, keys, ["ret", "u", "v"], {"top": (("v", 1), ("ret", 1)), "low": (("u", 1), ("ret", 0))})
    return p.select(*keys, "a", "b", (F.col("top") / F.col("low") * annualization).alias("value"))


def cov_factor(loadings: DataFrame, factor_cov: DataFrame, specific: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, value) of X F X' + diag(d) for the requested `pairs(a, b)`; `factor_cov(f, g, value)` is symmetric in full."""
    xf = loadings.join(factor_cov, loadings["factor"] == factor_cov["f"]).groupBy("asset", "g").agg(F.sum(F.col("x") * F.col("value")).alias("xf"))
    right = loadings.select(F.col("asset").alias("b"), F.col("factor").alias("g"), F.col("x").alias("y"))
    asked = pairs.select("a", "b").distinct().join(xf.withColumnRenamed("asset", "a"), "a")
    common = asked.join(right, ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("xf") * F.col("y")).alias("c"))
    own = specific.select(F.col("asset").alias("a"), "d")
    return common.join(own, "a", "left").select("a", "b", (F.col("c") + F.when(F.col("a") == F.col("b"), F.coalesce("d", F.lit(0.0))).otherwise(0.0)).alias("value"))


def factored_variance(weights: DataFrame, loadings: DataFrame, factor_cov: DataFrame, specific: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., variance) as (X'w)'F(X'w) + sum d w^2, without the full matrix."""
    e = weights.join(loadings, "asset").groupBy(*keys, "factor").agg(F.sum(F.col("x") * F.col("weight")).alias("e"))
    pairs = e.join(factor_cov, e["factor"] == factor_cov["f"]).select(*keys, F.col("e").alias("ef"), F.col("g").alias("factor"), "value")
    common = pairs.join(e, [*keys, "factor"]).groupBy(*keys).agg(F.sum(F.col("ef") * F.col("value") * F.col("e")).alias("common"))
    own = weights.join(specific, "asset").groupBy(*keys).agg(F.sum(F.col("d") * F.col("weight") ** 2).alias("own"))
    return common.join(own, keys).select(*keys, (F.col("common") + F.col("own")).alias("variance"))


def correlation_matrix(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., a, b, value): Pearson; null where a side is constant."""
    spread = lambda square, total: F.col(square) - F.col(total) ** 2 / F.col("n")
    varies = lambda square, total: F.when(spread(square, total) > 1e-13 * F.col(square), spread(square, total))
    root = F.sqrt(varies("s20", "s10") * varies("s02", "s01"))
    return _joint(returns, keys).select(*keys, "a", "b", ((F.col("s11") - F.col("s10") * F.col("s01") / F.col("n")) / root).alias("value"))


def _sigma_w(weights: DataFrame, cov: DataFrame, keys: list[str], cov_keys: list[str], value: str = "weight") -> DataFrame:
    """(keys.., asset, weight, sw): each asset's row of the covariance times the weights."""
    both = cov.select(*cov_keys, "a", "b", "value").union(cov.where("a < b").select(*cov_keys, F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    w = weights.select(*keys, F.col("asset").alias("b"), F.col(value).alias("wb"))
    sw = w.join(both, [*cov_keys, "b"]).groupBy(*keys, "a").agg(F.sum(F.col("value") * F.col("wb")).alias("sw"))
    own = weights.select(*keys, F.col("asset").alias("a"), F.col(value).alias("weight"))
    return own.join(sw, [*keys, "a"]).withColumnRenamed("a", "asset")


def portfolio_variance(weights: DataFrame, cov: DataFrame, keys: list[str], cov_keys: list[str] | None = None, value: str = "weight") -> DataFrame:
    """(keys.., variance): w' S w, not below zero; `cov_keys` are the keys that the covariance has too."""
    return _sigma_w(weights, cov, keys, cov_keys or [], value).groupBy(*keys).agg(F.greatest(F.sum(F.col("weight") * F.col("sw")), F.lit(0.0)).alias("variance"))


def tracking_error(weights: DataFrame, cov: DataFrame, keys: list[str], cov_keys: list[str] | None = None, horizon_scale: float = 1.0) -> DataFrame:
    """(keys.., tracking_error) of weight - benchmark."""
    active = weights.withColumn("_active", F.col("weight") - F.coalesce("benchmark", F.lit(0.0)))
    return portfolio_variance(active, cov, keys, cov_keys, "_active").select(*keys, F.sqrt(F.col("variance") * horizon_scale).alias("tracking_error"))


def risk_contributions(weights: DataFrame, cov: DataFrame, keys: list[str], cov_keys: list[str] | None = None) -> DataFrame:
    """(keys.., asset, weight, contribution, variance, volatility, diversification_ratio, volatility_reduction)."""
    s = _sigma_w(weights, cov, keys, cov_keys or [])
    own = cov.where("a = b").select(*(cov_keys or []), F.col("a").alias("asset"), F.sqrt("value").alias("sigma"))
    j = s.join(own, [*(cov_keys or []), "asset"])
    w = Window.partitionBy(*keys)
    variance = F.greatest(F.sum(F.col("weight") * F.col("sw")).over(w), F.lit(0.0))
    j = j.withColumn("contribution", F.col("weight") * F.col("sw")).withColumn("variance", variance).withColumn("volatility", F.sqrt("variance"))
    alone: Column = F.sum(F.abs("weight") * F.col("sigma")).over(w)
    return j.withColumn("diversification_ratio", ratio(alone, F.col("volatility"))).withColumn("volatility_reduction", 1 - ratio(F.col("volatility"), alone)).drop("sw", "sigma")
