"""Target weights in closed form, and small kernels for many groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import ratio


def equal_weights(universe: DataFrame, keys: list[str], invested: float = 1.0, cap: float = 1.0) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    out = universe.withColumn("weight", F.lit(invested) / n)
    return out.withColumn("status", F.when(n * cap < invested - 1e-12, "infeasible").otherwise("ok"))


def inverse_vol_weights(returns: DataFrame, keys: list[str], invested: float = 1.0, cap: float | None = None) -> DataFrame:
    """(keys.., asset, volatility, weight, status) by one over sample volatility; zero volatility is an error.

    With a `cap` the weights move to the nearest ones within it that sum to the same; `infeasible` if none do.
    """
    s = returns.groupBy(*keys, "asset").agg(F.stddev_samp("ret").alias("volatility"))
    w = Window.partitionBy(*keys)
    inv = ratio(F.lit(1.0), F.col("volatility"))
    bad = F.max(F.when(F.coalesce("volatility", F.lit(0.0)) == 0, 1).otherwise(0)).over(w)
    out = s.withColumn("_inv", inv).withColumn("_bad", bad)
    out = out.withColumn("weight", F.when(F.col("_bad") == 0, F.lit(invested) * F.col("_inv") / F.sum("_inv").over(w))).select(*keys, "asset", "volatility", "weight", F.when(F.col("_bad") == 1, "zero_volatility").otherwise("ok").alias("status"))
    if cap is None:
        return out
    near = project_capped_simplex(out.where("status = 'ok'").select(*keys, "asset", F.col("weight").alias("v")), keys, 0.0, cap, invested)
    near = near.select(*keys, "asset", F.col("weight").alias("_w"), F.col("status").alias("_s"))
    return out.join(near, [*keys, "asset"], "left").select(*keys, "asset", "volatility", F.col("_w").alias("weight"), F.coalesce("_s", "status").alias("status"))


def project_capped_simplex(values: DataFrame, keys: list[str], lo: float, hi: float, total: float) -> DataFrame:
    """`values(keys.., asset, v)` with weight: the nearest point with lo <= w <= hi that sums to total.

    sum(clip(v - theta)) is piecewise linear in theta and falls from N hi to N lo, with a slope that changes at
    v - hi and v - lo; theta is interpolated between the two breakpoints around the total.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    v = values.withColumn("_n", n)
    ends = v.select(*keys, "_n", F.explode(F.array(F.struct((F.col("v") - hi).alias("b"), F.lit(1).alias("d")), F.struct((F.col("v") - lo).alias("b"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.select(*keys, "_n", "e.b", "e.d").groupBy(*keys, "_n", "b").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("b")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = ends.withColumn("slope", F.sum("d").over(run)).withColumn("next", F.lead("b").over(w))
    steps = steps.withColumn("fall", F.coalesce(F.col("slope") * (F.col("next") - F.col("b")), F.lit(0.0)))
    steps = steps.withColumn("at", F.col("_n") * hi - F.coalesce(F.sum("fall").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    here = steps.where((F.col("at") >= total) & ((F.col("at") - F.col("fall") <= total) | F.col("next").isNull()))
    theta = here.withColumn("theta", F.col("b") + F.coalesce(ratio(F.col("at") - total, F.col("slope").cast("double")), F.lit(0.0))).groupBy(*keys).agg(F.min("theta").alias("theta"))
    j = v.join(theta, keys, "left")
    inside = F.least(F.greatest(F.col("v") - F.col("theta"), F.lit(lo)), F.lit(hi))
    bad = (F.col("_n") * lo > total + 1e-12) | (F.col("_n") * hi < total - 1e-12)
    weight = F.when(bad, F.lit(None)).when(F.abs(F.col("_n") * lo - total) <= 1e-12, lo).when(F.abs(F.col("_n") * hi - total) <= 1e-12, hi).otherwise(inside)
    return j.withColumn("weight", weight).withColumn("status", F.when(bad, "infeasible").otherwise("ok")).drop("_n", "theta")


def project_l1_ball(values: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """`values(keys.., asset, v, center)` with weight: the nearest point within `radius` of the center in L1."""
    d = values.withColumn("_d", F.col("v") - F.col("center")).withColumn("_a", F.abs("_d"))
    w = Window.partitionBy(*keys).orderBy(F.col("_a").desc(), "asset")
    d = d.withColumn("_k", F.row_number().over(w)).withColumn("_c", F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    all_ = Window.partitionBy(*keys)
    active = F.when(F.col("_a") - (F.col("_c") - radius) / F.col("_k") > 0, (F.col("_c") - radius) / F.col("_k"))
    d = d.withColumn("_theta", F.greatest(F.max(active).over(all_), F.lit(0.0)))
    inside = F.sum("_a").over(all_) <= radius
    moved = F.signum("_d") * F.greatest(F.col("_a") - F.col("_theta"), F.lit(0.0))
    return d.withColumn("weight", F.when(inside, F.col("v")).otherwise(F.col("center") + moved)).drop("_d", "_a", "_k", "_c", "_theta")


def blend_to_turnover(weights: DataFrame, keys: list[str], max_turnover: float) -> DataFrame:
    """`weights(.., current, target)` with weight: toward the target as far as the turnover allows."""
    t = F.sum(F.abs(F.col("target") - F.col("current"))).over(Window.partitionBy(*keys))
    part = F.when(t > max_turnover, F.lit(max_turnover) / F.when(t > 0, t)).otherwise(1.0)
    return weights.withColumn("turnover", t).withColumn("weight", F.col("current") + (F.col("target") - F.col("current")) * part)


def soft_threshold_trades(weights: DataFrame, step: float) -> DataFrame:
    """`weights(.., current, target, cost)` with trade: the gap shrunk by step times cost."""
    d = F.col("target") - F.col("current")
    return weights.withColumn("trade", F.signum(d) * F.greatest(F.abs(d) - F.lit(step) * F.col("cost"), F.lit(0.0)))


def apply_exposure_caps(weights: DataFrame, caps: DataFrame, keys: list[str], attributes: list[str], max_single: float, max_gross: float, min_net: float, max_net: float, max_turnover: float) -> DataFrame:
    """`weights(keys.., asset, attributes.., current, value)` with weight after the caps, in their order.

    Single names are clipped, gross is scaled, then each attribute's buckets in turn; then the side that makes the
    net too high (or low) is scaled, and the result is blended toward the current weights. If the net is too high
    and nothing is long, the turnover step is left out. `caps(attribute, bucket, cap)` ignore case.
    """
    all_ = Window.partitionBy(*keys)
    x = weights.withColumn("_w", F.greatest(F.least("value", F.lit(max_single)), F.lit(-max_single)))
    gross = F.sum(F.abs("_w")).over(all_)
    x = x.withColumn("_w", F.col("_w") * F.when(gross > max_gross, F.lit(max_gross) / F.when(gross > 0, gross)).otherwise(1.0))
    for a in attributes:
        mine = caps.where(F.col("attribute") == a).select(F.lower("bucket").alias("_bucket"), F.col("cap").alias("_cap"))
        x = x.withColumn("_bucket", F.lower(a)).join(mine, "_bucket", "left")
        held = F.sum(F.abs("_w")).over(Window.partitionBy(*keys, "_bucket"))
        x = x.withColumn("_w", F.col("_w") * F.when(held > F.col("_cap"), F.col("_cap") / F.when(held > 0, held)).otherwise(1.0)).drop("_bucket", "_cap")
    x = x.withColumn("_long", F.sum(F.when(F.col("_w") > 0, F.col("_w")).otherwise(0.0)).over(all_)).withColumn("_short", F.sum(F.when(F.col("_w") < 0, F.col("_w")).otherwise(0.0)).over(all_))
    net = F.col("_long") + F.col("_short")
    high, low = net > max_net, net < min_net
    up = F.greatest(F.lit(0.0), ratio(F.lit(max_net) - F.col("_short"), F.col("_long")))
    down = F.greatest(F.lit(0.0), ratio(F.lit(min_net) - F.col("_long"), F.col("_short")))
    factor = F.when(high & (F.col("_long") > 0) & (F.col("_w") > 0), up).when(~high & low & (F.col("_short") < 0) & (F.col("_w") < 0), down).otherwise(1.0)
    x = x.withColumn("_stop", high & (F.col("_long") <= 0)).withColumn("_w", F.col("_w") * factor)
    turn = F.sum(F.abs(F.col("_w") - F.col("current"))).over(all_)
    part = F.when(~F.col("_stop") & (turn > max_turnover), F.lit(max_turnover) / F.when(turn > 0, turn)).otherwise(1.0)
    return x.withColumn("weight", F.when(part == 1.0, F.col("_w")).otherwise(F.col("current") + (F.col("_w") - F.col("current")) * part)).drop("_w", "_long", "_short", "_stop")


def _matrix_kernel(cov: DataFrame, keys: list[str], solve) -> DataFrame:
    """(keys.., asset, weight, status) from one dense matrix for each key, in tasks."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {n: i for i, n in enumerate(names)}
        s = np.zeros((len(names), len(names)))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        s[i, j] = s[j, i] = pdf["value"].to_numpy()
        weight, status = (np.full(len(names), np.nan), "zero_variance") if (np.diag(s) <= 0).any() else solve(s)
        out = pd.DataFrame({"asset": names, "weight": weight, "status": status})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = ", ".join([f"{k} {cov.schema[k].dataType.simpleString()}" for k in keys] + ["asset string", "weight double", "status string"])
    return cov.select(*keys, "a", "b", "value").groupBy(*keys).applyInPandas(run, schema)


def equal_risk_contribution(cov: DataFrame, keys: list[str], tolerance: float = 1e-10, max_rounds: int = 10_000) -> DataFrame:
    """Long-only weights whose risk contributions are equal, for every key's covariance."""

    def solve(s):
        import numpy as np

        n = len(s)
        x = 1 / np.sqrt(np.diag(s))
        for _ in range(max_rounds):
            for i in range(n):  # the positive root of s_ii x^2 + c x - 1/n
                c = s[i] @ x - s[i, i] * x[i]
                x[i] = (-c + np.sqrt(c * c + 4 * s[i, i] / n)) / (2 * s[i, i])
            parts = x * (s @ x)
            if np.ptp(parts) <= tolerance * parts.sum():
                return x / x.sum(), "ok"
        return x / x.sum(), "not_converged"

    return _matrix_kernel(cov, keys, solve)


def hierarchical_risk_parity(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Single-linkage order of correlation distances, then inverse-variance bisection, for every key."""

    def solve(s):
        import numpy as np

        sd = np.sqrt(np.diag(s))
        dist = np.sqrt(np.clip((1 - s / np.outer(sd, sd)) / 2, 0, 1))
        # The least distance of each cluster to a later one, and which: the first of equals wins throughout.
        n = len(s)
        clusters, d = {i: [i] for i in range(n)}, np.where(np.tri(n, dtype=bool), np.inf, dist)
        least, to = d.min(axis=1, initial=np.inf), d.argmin(axis=1)
        for _ in range(n - 1):
            a = int(least.argmin())
            b = int(to[a])
            clusters[a] = clusters[a] + clusters.pop(b)
            row = np.minimum(np.minimum(d[a], d[:, a]), np.minimum(d[b], d[:, b]))
            row[[i for i in (a, b)]] = np.inf
            d[b], d[:, b], least[b] = np.inf, np.inf, np.inf
            alive = np.zeros(n, dtype=bool)
            alive[list(clusters)] = True
            row[~alive] = np.inf
            d[a, a + 1 :], d[:a, a] = row[a + 1 :], row[:a]
            closer = np.flatnonzero((d[:a, a] < least[:a]) | (d[:a, a] == least[:a]) & (a < to[:a]))
            least[closer], to[closer] = d[closer, a], a
            for i in [a, *np.flatnonzero((to == b) & alive).tolist()]:
                least[i], to[i] = d[i].min(), d[i].argmin()
        w = np.ones(len(s))

        def variance(items):
            iv = 1 / np.diag(s)[items]
            iv /= iv.sum()
            return iv @ s[np.ix_(items, items)] @ iv

        queue = [next(iter(clusters.values()))]
        while queue:
            items = queue.pop()
            if len(items) > 1:
                left, right = items[: len(items) // 2], items[len(items) // 2 :]
                vl, vr = variance(left), variance(right)
                w[left] *= vr / (vl + vr)
                w[right] *= vl / (vl + vr)
                queue += [left, right]
        return w, "ok"

    return _matrix_kernel(cov, keys, solve)
