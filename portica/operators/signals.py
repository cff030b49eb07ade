"""Forecasts and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import ratio
from .covariance import _sigma_w
from .pit import mature_labels, non_overlapping_periods


def cross_sectional_zscore(scores: DataFrame, keys: list[str], universe: DataFrame | None = None) -> DataFrame:
    """(keys.., asset, score, z): population z-score; zero where all scores are equal.

    With `universe(keys.., asset, score)` the mean and spread are those of the universe.
    """
    base = (universe or scores).groupBy(*keys).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    j = scores.join(base, keys)
    return j.withColumn("z", F.coalesce(ratio(F.col("score") - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def mature_ic(labels: DataFrame, decisions: DataFrame, horizon: int, lookback: int, min_periods: int) -> DataFrame:
    """(decision_at, ic, n_periods, first_signal, last_signal, status): mean correlation of score and return over
    the last non-overlapping periods that a decision could see; a period needs three rows and both sides varying."""
    m = mature_labels(labels, decisions, horizon)
    per = m.groupBy("decision_at", "signal_at").agg(
        F.count("*").alias("n"), F.count_distinct("label_end").alias("n_ends"), F.max("label_end").alias("label_end"),
        F.covar_samp("score", "ret").alias("c"), F.stddev_samp("score").alias("ss"), F.stddev_samp("ret").alias("sr"),
    )
    per = per.withColumn("ic", F.when(F.col("n") >= 3, ratio(F.col("c"), F.col("ss") * F.col("sr"))))
    kept = non_overlapping_periods(per.where("ic IS NOT NULL"), lookback, ["decision_at"])
    out = kept.join(per.select("decision_at", "signal_at", "ic"), ["decision_at", "signal_at"]).groupBy("decision_at").agg(
        F.avg("ic").alias("ic"), F.count("*").alias("n_periods"), F.min("signal_at").alias("first_signal"), F.max("signal_at").alias("last_signal")
    )
    return out.withColumn("status", F.when(F.col("n_periods") < min_periods, "too_few").otherwise("ok"))


def ic_vol_forecast(scores: DataFrame, variances: DataFrame, ic: float, keys: list[str], horizon_scale: float = 1.0) -> DataFrame:
    """(keys.., asset, forecast): IC * volatility * z; `variances(asset, value)` may carry keys."""
    z = cross_sectional_zscore(scores, keys)
    on = [c for c in [*keys, "asset"] if c in variances.columns]
    return z.join(variances.select(*on, "value"), on).select(*keys, "asset", (F.lit(ic) * F.sqrt(F.col("value") * horizon_scale) * F.col("z")).alias("forecast"))


def equilibrium_returns(cov: DataFrame, weights: DataFrame, risk_aversion: float, keys: list[str], cov_keys: list[str] | None = None) -> DataFrame:
    """(keys.., asset, equilibrium): risk aversion times covariance times market weights."""
    return _sigma_w(weights, cov, keys, cov_keys or []).select(*keys, "asset", (F.lit(risk_aversion) * F.col("sw")).alias("equilibrium"))


def black_litterman(cov: DataFrame, weights: DataFrame, views: DataFrame, keys: list[str], tau: float = 0.05, risk_aversion: float = 2.5) -> DataFrame:
    """(keys.., asset, prior, posterior) with view noise diag(P tau S P').

    `cov(keys.., a, b, value)`, `weights(keys.., asset, weight)`, `views(keys.., view, asset, p, q)`: a view is
    the rows of one name. One small solve for each key, in tasks.
    """
    import numpy as np
    import pandas as pd

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    full = cov.select(*keys, F.col("a").alias("asset"), F.col("b").alias("other"), F.col("value").alias("v"), F.lit("c").alias("kind"))
    full = full.union(weights.select(*keys, "asset", F.lit(""), F.col("weight"), F.lit("w"))).union(views.select(*keys, "asset", F.col("view").cast("string"), F.col("p"), F.lit("p")))
    full = full.union(views.groupBy(*keys, "view").agg(F.max("q").alias("q")).select(*keys, F.lit(""), F.col("view").cast("string"), "q", F.lit("q")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf[pdf["kind"] == "w"].set_index("asset")["v"].sort_index()
        at = {a: i for i, a in enumerate(w.index)}
        s = np.zeros((len(at), len(at)))
        for a, b, v in pdf.loc[pdf["kind"] == "c", ["asset", "other", "v"]].itertuples(index=False):
            s[at[a], at[b]] = s[at[b], at[a]] = v
        prior = risk_aversion * s @ w.to_numpy()
        q = pdf[pdf["kind"] == "q"].set_index("other")["v"].sort_index()
        post = prior
        if len(q):
            p = np.zeros((len(q), len(at)))
            row = {n: i for i, n in enumerate(q.index)}
            for a, n, v in pdf.loc[pdf["kind"] == "p", ["asset", "other", "v"]].itertuples(index=False):
                p[row[n], at[a]] += v
            ts = tau * s
            noise = np.diag(np.diag(p @ ts @ p.T))
            post = prior + ts @ p.T @ np.linalg.solve(p @ ts @ p.T + noise, q.to_numpy() - p @ prior)
        out = pd.DataFrame({"asset": list(at), "prior": prior, "posterior": post})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join([f"{k} {kind(weights, k)}" for k in keys] + ["asset string", "prior double", "posterior double"])
    return full.groupBy(*keys).applyInPandas(solve, schema)


def causal_zscore(series: DataFrame, lookback: int, keys: list[str], value: str = "x") -> DataFrame:
    """`series` with z: against the population mean and spread of the rows before; null until those are full."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-lookback, -1)
    z = ratio(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return series.withColumn("z", F.when(F.count(value).over(w) == lookback, z))


def hysteresis_position(series: DataFrame, entry: float, exit_: float, keys: list[str]) -> DataFrame:
    """`series` with position: -1 from z >= entry, +1 from z <= -entry, 0 from abs(z) <= exit or null z; no direct flip.

    Between resets a position keeps the sign of the first entry, which windows express without a loop.
    """
    if not entry > exit_ >= 0:
        raise ValueError("entry must be above exit, and exit not negative")
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    reset = F.col("z").isNull() | (F.abs("z") <= exit_)
    signal = F.when(F.col("z") >= entry, -1).when(F.col("z") <= -entry, 1)
    s = series.withColumn("_segment", F.sum(F.when(reset, 1).otherwise(0)).over(w)).withColumn("_signal", signal)
    inside = Window.partitionBy(*keys, "_segment").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("position", F.coalesce(F.first("_signal", ignorenulls=True).over(inside), F.lit(0))).drop("_segment", "_signal")
