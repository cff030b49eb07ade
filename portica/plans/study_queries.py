"""Queries of the covariance, signal, target and risk operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import covariance, risk, signals, spectrum, targets
from .pit_queries import _LABELS, _YEARS, _labels
from .prep import Tables
from .registry import query

# Pairs of demeaned returns of the small panel, and of every supplier's.
_X = "SELECT t, asset, ret - AVG(ret) OVER (PARTITION BY asset) AS x FROM {ret_small}"
_MOM = f"SELECT a.asset AS a, b.asset AS b, COUNT(*) AS n, SUM(a.x * b.x) AS s11, SUM(a.x * a.x * b.x * b.x) AS s22, SUM(a.x * a.x * a.x * b.x) AS s31, SUM(a.x * b.x * b.x * b.x) AS s13 FROM ({_X}) a JOIN ({_X}) b ON a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2"
_TR = "SELECT CAST(MAX(n) AS DOUBLE) AS t, CAST(SUM(CASE WHEN a = b THEN 1 ELSE 0 END) AS DOUBLE) AS n, SUM(CASE WHEN a = b THEN s11 / n ELSE 0 END) AS tr, SUM(CASE WHEN a = b THEN 1 ELSE 2 END * (s11 / n) * (s11 / n)) AS fro FROM m"


@query("e1_pair_moments", text="a b", whole="n", real="s11 s22 s31 s13", digits=9, sql=_MOM)
def _(t: Tables) -> DataFrame:
    return covariance.pair_moments(t.ret_small, [])


@query("e1_pair_moments_many", text="a b", whole="book n", real="s11", digits=3, sql="WITH x AS (SELECT book, t, asset, ret - AVG(ret) OVER (PARTITION BY book, asset) AS x FROM {ret_many})\nSELECT a.book AS book, a.asset AS a, b.asset AS b, COUNT(*) AS n, SUM(a.x * b.x) AS s11 FROM x a JOIN x b ON a.book = b.book AND a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return covariance.pair_moments(t.ret_many, ["book"])


@query("e2_cov_diagonal", text="a b", whole="n", real="value", digits=8, sql="SELECT * FROM (SELECT a.asset AS a, b.asset AS b, COUNT(*) AS n, COVAR_SAMP(a.ret, b.ret) * CASE WHEN a.asset = b.asset THEN 252 ELSE 252 * 0.8 END AS value FROM {ret_month} a JOIN {ret_month} b ON a.t = b.t AND a.asset <= b.asset GROUP BY a.asset, b.asset) x WHERE n >= 2")
def _(t: Tables) -> DataFrame:
    return covariance.cov_diagonal(t.ret_month, [])


_LW = f"""WITH m AS ({_MOM}), q AS (SELECT SUM(q * q) AS q2 FROM (SELECT t, SUM(x * x) AS q FROM ({_X}) x GROUP BY t) y), p AS ({_TR}),
 i AS (SELECT p.*, (q2 / t - fro) / (n * t) AS beta, (fro - 2 * tr / n * tr + tr * tr / n) / n AS delta FROM p, q)
SELECT a, b, ((1 - k) * s11 / m.n + k * CASE WHEN a = b THEN tr / i.n ELSE 0 END) * 252 AS value, k AS intensity FROM m, (SELECT *, CASE WHEN beta > 0 AND delta > 0 THEN LEAST(beta, delta) / delta ELSE 0 END AS k FROM i) i"""


@query("e3_ledoit_wolf", text="a b", real="value intensity", digits=8, sql=_LW)
def _(t: Tables) -> DataFrame:
    return covariance.cov_ledoit_wolf(t.ret_small, [])


@query("e4_oas", text="a b", real="value intensity", digits=8, sql=f"""WITH m AS ({_MOM}), p AS ({_TR}), i AS (SELECT *, LEAST(GREATEST(((1 - 2 / n) * fro + tr * tr) / ((t + 1 - 2 / n) * (fro - tr * tr / n)), 0), 1) AS k FROM p)
SELECT a, b, ((1 - k) * s11 / m.n + k * CASE WHEN a = b THEN tr / i.n ELSE 0 END) * 252 AS value, k AS intensity FROM m, i""")
def _(t: Tables) -> DataFrame:
    return covariance.cov_oas(t.ret_small, [])


@query("e5_constant_correlation", text="a b", real="value intensity", digits=8, sql=f"""WITH m AS ({_MOM}), j AS (SELECT m.a, m.b, m.n, m.s11 / m.n AS s, m.s22 / m.n AS s22, m.s31 / m.n AS s31, m.s13 / m.n AS s13, x.s11 / x.n AS va, y.s11 / y.n AS vb FROM m JOIN m x ON x.a = m.a AND x.b = m.a JOIN m y ON y.a = m.b AND y.b = m.b),
 r AS (SELECT AVG(s / SQRT(va * vb)) AS rbar FROM j WHERE a < b), k AS (SELECT j.*, rbar, CASE WHEN a < b THEN rbar * SQRT(va * vb) ELSE s END AS f FROM j, r),
 c AS (SELECT SUM((s22 - s * s) * CASE WHEN a < b THEN 2 ELSE 1 END) AS phi, SUM(CASE WHEN a < b THEN rbar * (SQRT(vb / va) * (s31 - va * s) + SQRT(va / vb) * (s13 - vb * s)) ELSE s22 - s * s END) AS rho, SUM((s - f) * (s - f) * CASE WHEN a < b THEN 2 ELSE 1 END) AS gamma, MAX(n) AS t FROM k)
SELECT a, b, ((1 - i) * s + i * f) * 252 AS value, i AS intensity FROM k, (SELECT LEAST(GREATEST((phi - rho) / gamma / t, 0), 1) AS i FROM c) z""")
def _(t: Tables) -> DataFrame:
    return covariance.cov_constant_correlation(t.ret_small, [])


@query("e6_ewma", text="a b", real="value", digits=8, sql="WITH u AS (SELECT *, POWER(0.94, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY t DESC) - 1) AS u FROM {ret_small})\nSELECT a.asset AS a, b.asset AS b, SUM(a.u * a.ret * b.ret) / SUM(a.u) * 252 AS value FROM u a JOIN u b ON a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return covariance.cov_ewma(t.ret_small, [])


_FC = "SELECT a.factor AS f, b.factor AS g, COVAR_SAMP(a.x, b.x) AS value FROM {loadings} a JOIN {loadings} b ON a.asset = b.asset GROUP BY 1, 2"


@query("e8_factored_variance", whole="grp", real="variance", digits=8, sql=f"WITH e AS (SELECT grp, factor, SUM(x * weight) AS e FROM {{vec_weights}} w JOIN {{loadings}} l ON l.asset = w.asset GROUP BY 1, 2), c AS ({_FC}), s AS (SELECT grp, SUM((0.01 + (asset % 5) * 0.001) * weight * weight) AS own FROM {{vec_weights}} GROUP BY grp)\nSELECT x.grp AS grp, SUM(x.e * value * y.e) + MAX(own) AS variance FROM e x JOIN c ON c.f = x.factor JOIN e y ON y.factor = c.g AND y.grp = x.grp JOIN s ON s.grp = x.grp GROUP BY x.grp")
def _(t: Tables) -> DataFrame:
    spec = t.vec_weights.select("asset", (0.01 + (F.col("asset") % 5) * 0.001).alias("d"))
    return covariance.factored_variance(t.vec_weights, t.loadings, t.sql(_FC), spec, ["grp"])


@query("e8_cov_factor", whole="a b", real="value", digits=8, sql=f"WITH c AS ({_FC})\nSELECT x.asset AS a, y.asset AS b, SUM(x.x * value * y.x) + CASE WHEN x.asset = y.asset THEN 0.01 ELSE 0 END AS value FROM {{loadings}} x JOIN c ON c.f = x.factor JOIN {{loadings}} y ON y.factor = c.g WHERE y.asset IN (x.asset, x.asset + 1) GROUP BY x.asset, y.asset")
def _(t: Tables) -> DataFrame:
    """The variances, and the covariances of neighbours by id."""
    assets = t.loadings.select("asset").distinct()
    pairs = assets.select(F.col("asset").alias("a"), F.explode(F.array("asset", F.col("asset") + 1)).alias("b"))
    return covariance.cov_factor(t.loadings, t.sql(_FC), assets.withColumn("d", F.lit(0.01)), pairs)


_COR = "SELECT a.asset AS a, b.asset AS b, COVAR_SAMP(a.ret, b.ret) / NULLIF(STDDEV_SAMP(a.ret) * STDDEV_SAMP(b.ret), 0) AS value FROM {ret_small} a JOIN {ret_small} b ON a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2"


_VECTORS = "SELECT asset, factor AS t, x AS ret FROM {loadings}"


@query("e7_random_matrix", whole="a b n_signals", real="value", digits=6)
def _(t: Tables) -> DataFrame:
    """All vectors as assets, their elements as times: more assets than times."""
    return spectrum.cov_random_matrix(t.sql(_VECTORS), [])


@query("e7_cleaned_variances", whole="a", real="value", digits=8, sql=f"SELECT asset AS a, VAR_POP(ret) * 252 AS value FROM ({_VECTORS}) v GROUP BY asset")
def _(t: Tables) -> DataFrame:
    """The diagonal of the cleaned covariance: own variances, as its correlations are one there."""
    return spectrum.cov_random_matrix(t.sql(_VECTORS), [], diagonal=True)


@query("panel_checks", text="asset rule", sql="SELECT asset, 'incomplete' AS rule FROM {ret_month} GROUP BY asset HAVING COUNT(ret) < (SELECT COUNT(DISTINCT t) FROM {ret_month})")
def _(t: Tables) -> DataFrame:
    """Assets of the monthly panel with gaps."""
    return covariance.panel_checks(t.ret_month, [])


@query("e9_correlation", text="a b", real="value", digits=9, sql=_COR)
def _(t: Tables) -> DataFrame:
    return covariance.correlation_matrix(t.ret_small, [])


_COV = "SELECT a.asset AS a, b.asset AS b, COVAR_SAMP(a.ret, b.ret) AS value FROM {ret_small} a JOIN {ret_small} b ON a.t = b.t GROUP BY 1, 2"


def _cov(t: Tables) -> DataFrame:
    return covariance.cov_diagonal(t.ret_small, [], 0.0, 1.0)


_VAR = f"WITH c AS ({_COV}), sw AS (SELECT portfolio_id, a AS asset, SUM(value * weight) AS sw FROM {{cand}} w JOIN c ON c.b = w.asset GROUP BY 1, 2), r AS (SELECT w.portfolio_id, w.asset, weight, sw, weight * sw AS contribution, SUM(weight * sw) OVER (PARTITION BY w.portfolio_id) AS variance, SUM(weight * SQRT(value)) OVER (PARTITION BY w.portfolio_id) AS alone FROM {{cand}} w JOIN sw ON sw.portfolio_id = w.portfolio_id AND sw.asset = w.asset JOIN c ON c.a = w.asset AND c.b = w.asset)"


@query("e10_portfolio_variance", whole="portfolio_id", real="variance", digits=9, sql=_VAR + "\nSELECT DISTINCT portfolio_id, ROUND(variance, 12) AS variance FROM r")
def _(t: Tables) -> DataFrame:
    return covariance.portfolio_variance(t.cand, _cov(t), ["portfolio_id"])


@query("e10_tracking_error", whole="portfolio_id", real="tracking_error", digits=7, sql=f"WITH c AS ({_COV}), w AS (SELECT portfolio_id, asset, weight - 0.2 AS d FROM {{cand}})\nSELECT x.portfolio_id AS portfolio_id, SQRT(GREATEST(SUM(x.d * value * y.d), 0) * 21) AS tracking_error FROM w x JOIN c ON c.a = x.asset JOIN w y ON y.asset = c.b AND y.portfolio_id = x.portfolio_id GROUP BY x.portfolio_id")
def _(t: Tables) -> DataFrame:
    return covariance.tracking_error(t.cand.withColumn("benchmark", F.lit(0.2)), _cov(t), ["portfolio_id"], horizon_scale=21.0)


@query("e11_risk_contributions", text="asset", whole="portfolio_id", real="contribution volatility diversification_ratio volatility_reduction", digits=7, sql=_VAR + "\nSELECT portfolio_id, asset, contribution, SQRT(variance) AS volatility, alone / SQRT(variance) AS diversification_ratio, 1 - SQRT(variance) / alone AS volatility_reduction FROM r")
def _(t: Tables) -> DataFrame:
    return covariance.risk_contributions(t.cand, _cov(t), ["portfolio_id"])


# --- signals

_Z = "SELECT t, asset, ret, COALESCE((ret - AVG(ret) OVER (PARTITION BY t)) / NULLIF(STDDEV_POP(ret) OVER (PARTITION BY t), 0), 0) AS z FROM {ret_month}"


@query("g1_cross_sectional_zscore", text="t asset", real="z", sql=_Z)
def _(t: Tables) -> DataFrame:
    return signals.cross_sectional_zscore(t.ret_month.withColumnRenamed("ret", "score"), ["t"])


@query("g2_mature_ic", text="decision_at status", whole="n_periods", real="ic", sql="""WITH RECURSIVE per AS (SELECT decision_at, signal_at, MAX(label_end) AS label_end, COVAR_SAMP(score, ret) / (STDDEV_SAMP(score) * STDDEV_SAMP(ret)) AS ic FROM (@LABELS) l JOIN (@YEARS) d ON available_at <= decision_at AND label_end <= decision_at AND signal_at < decision_at GROUP BY decision_at, signal_at HAVING COUNT(*) >= 3),
 walk AS (SELECT decision_at, MAX(signal_at) AS s, 1 AS k FROM per GROUP BY decision_at UNION ALL SELECT decision_at, s, k FROM (SELECT w.decision_at, MAX(p.signal_at) OVER (PARTITION BY w.decision_at) AS s, p.signal_at, w.k + 1 AS k FROM walk w JOIN per p ON p.decision_at = w.decision_at AND p.label_end <= w.s WHERE w.k < 8) z WHERE signal_at = s)
SELECT walk.decision_at, AVG(ic) AS ic, COUNT(*) AS n_periods, CASE WHEN COUNT(*) < 5 THEN 'too_few' ELSE 'ok' END AS status FROM walk JOIN per ON per.decision_at = walk.decision_at AND per.signal_at = s GROUP BY walk.decision_at""".replace("@LABELS", _LABELS).replace("@YEARS", _YEARS))
def _(t: Tables) -> DataFrame:
    return signals.mature_ic(_labels(t), t.sql(_YEARS), 2, 8, 5)


@query("g3_ic_vol_forecast", text="t asset", real="forecast", digits=8, sql=f"WITH z AS ({_Z}), v AS (SELECT asset, VAR_SAMP(ret) AS value FROM {{ret_month}} GROUP BY asset)\nSELECT t, z.asset AS asset, 0.05 * SQRT(value * 2) * z AS forecast FROM z JOIN v ON v.asset = z.asset")
def _(t: Tables) -> DataFrame:
    v = t.ret_month.groupBy("asset").agg(F.var_samp("ret").alias("value"))
    return signals.ic_vol_forecast(t.ret_month.withColumnRenamed("ret", "score"), v, 0.05, ["t"], 2.0)


@query("g4_equilibrium_returns", text="asset", whole="portfolio_id", real="equilibrium", digits=8, sql=f"WITH c AS ({_COV})\nSELECT portfolio_id, a AS asset, 2.5 * SUM(value * weight) AS equilibrium FROM {{cand}} w JOIN c ON c.b = w.asset GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return signals.equilibrium_returns(_cov(t), t.cand, 2.5, ["portfolio_id"])


@query("g5_black_litterman", text="asset", whole="book", real="prior posterior")
def _(t: Tables) -> DataFrame:
    """One view by supplier: the first return flag beats the last by one percent."""
    cov = covariance.cov_diagonal(t.ret_many, ["book"], 0.2, 12.0)
    w = t.ret_many.select("book", "asset").distinct().withColumn("weight", F.lit(1 / 3))
    views = w.select("book", F.lit(1).alias("view"), "asset", F.when(F.col("asset") == "A", 1.0).when(F.col("asset") == "R", -1.0).otherwise(0.0).alias("p"), F.lit(0.01).alias("q"))
    return signals.black_litterman(cov, w, views, ["book"])


_CZ = "SELECT asset, t, px, CASE WHEN COUNT(px) OVER w = 5 THEN (px - AVG(px) OVER w) / NULLIF(STDDEV_POP(px) OVER w, 0) END AS z FROM {px_month} WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


def _zed(t: Tables) -> DataFrame:
    return signals.causal_zscore(t.px_month.withColumnRenamed("px", "x"), 5, ["asset"])


@query("g6_causal_zscore", text="asset t", real="z", digits=5, sql=_CZ)
def _(t: Tables) -> DataFrame:
    return _zed(t)


_POS = f"WITH z AS ({_CZ}), s AS (SELECT *, SUM(CASE WHEN z IS NULL OR ABS(z) <= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY t) AS seg, CASE WHEN z >= 1 THEN -1 WHEN z <= -1 THEN 1 END AS sig FROM z), p AS (SELECT asset, t, px, COALESCE(FIRST_VALUE(sig IGNORE NULLS) OVER (PARTITION BY asset, seg ORDER BY t), 0) AS position FROM s)"


def _positions(t: Tables) -> DataFrame:
    return signals.hysteresis_position(_zed(t), 1.0, 0.3, ["asset"])


@query("g7_hysteresis", text="asset t", whole="position", sql=_POS + "\nSELECT asset, t, position FROM p")
def _(t: Tables) -> DataFrame:
    return _positions(t)


# --- targets

@query("h1_equal_weights", text="asset status", whole="book", real="weight", sql="SELECT book, asset, 0.9 / COUNT(*) OVER (PARTITION BY book) AS weight, CASE WHEN COUNT(*) OVER (PARTITION BY book) * 0.4 < 0.9 THEN 'infeasible' ELSE 'ok' END AS status FROM (SELECT DISTINCT book, asset FROM {px_many}) x")
def _(t: Tables) -> DataFrame:
    return targets.equal_weights(t.px_many.select("book", "asset").distinct(), ["book"], 0.9, 0.4)


_IV = "SELECT book, asset, s AS volatility, 0.9 / s / SUM(1 / s) OVER (PARTITION BY book) AS weight FROM (SELECT book, asset, STDDEV_SAMP(ret) AS s FROM {ret_many} GROUP BY 1, 2) x"


@query("h2_inverse_vol", text="asset", whole="book", real="volatility weight", sql=_IV)
def _(t: Tables) -> DataFrame:
    return targets.inverse_vol_weights(t.ret_many, ["book"], 0.9)


@query("h3_capped_simplex", text="asset status", whole="portfolio_id", real="weight", digits=6, sql="""WITH RECURSIVE v AS (SELECT portfolio_id, asset, weight * 2 - 0.3 AS v FROM {cand}), b AS (SELECT portfolio_id, MIN(v) - 1 AS lo, MAX(v) + 1 AS hi, 0 AS k FROM v GROUP BY 1
 UNION ALL SELECT portfolio_id, CASE WHEN total > 1 THEN mid ELSE lo END, CASE WHEN total > 1 THEN hi ELSE mid END, k + 1 FROM (SELECT b.portfolio_id, lo, hi, (lo + hi) / 2 AS mid, k, SUM(LEAST(GREATEST(v - (lo + hi) / 2, 0.02), 0.35)) AS total FROM b JOIN v ON v.portfolio_id = b.portfolio_id WHERE k < 60 GROUP BY b.portfolio_id, lo, hi, k) x)
SELECT v.portfolio_id AS portfolio_id, asset, LEAST(GREATEST(v - lo, 0.02), 0.35) AS weight, 'ok' AS status FROM v JOIN b ON b.portfolio_id = v.portfolio_id AND k = 60""")
def _(t: Tables) -> DataFrame:
    return targets.project_capped_simplex(t.cand.select("portfolio_id", "asset", (F.col("weight") * 2 - 0.3).alias("v")), ["portfolio_id"], 0.02, 0.35, 1.0)


@query("h4_l1_ball", text="asset", whole="portfolio_id", real="weight", sql="""WITH RECURSIVE v AS (SELECT portfolio_id, asset, weight - 0.2 AS d FROM {cand}), b AS (SELECT portfolio_id, 0.0::DOUBLE AS lo, MAX(ABS(d)) AS hi, SUM(ABS(d)) AS far, 0 AS k FROM v GROUP BY 1
 UNION ALL SELECT portfolio_id, CASE WHEN total > 0.25 THEN mid ELSE lo END, CASE WHEN total > 0.25 THEN hi ELSE mid END, far, k + 1 FROM (SELECT b.portfolio_id, lo, hi, far, (lo + hi) / 2 AS mid, k, SUM(GREATEST(ABS(d) - (lo + hi) / 2, 0)) AS total FROM b JOIN v ON v.portfolio_id = b.portfolio_id WHERE k < 60 GROUP BY b.portfolio_id, lo, hi, far, k) x)
SELECT v.portfolio_id AS portfolio_id, asset, 0.2 + CASE WHEN far <= 0.25 THEN d ELSE SIGN(d) * GREATEST(ABS(d) - lo, 0) END AS weight FROM v JOIN b ON b.portfolio_id = v.portfolio_id AND k = 60""")
def _(t: Tables) -> DataFrame:
    return targets.project_l1_ball(t.cand.select("portfolio_id", "asset", F.col("weight").alias("v"), F.lit(0.2).alias("center")), ["portfolio_id"], 0.25)


_CAPPED = "SELECT portfolio_id, asset, CASE WHEN asset IN ('click', 'view') THEN 'Web' ELSE 'Other' END AS venue, CASE WHEN asset IN ('error', 'view') THEN 'Down' ELSE 'Up' END AS asset_class, 0.1 AS held, weight * 3 * CASE WHEN asset IN ('error', 'view') THEN -1 ELSE 1 END AS value FROM {cand}"


@query("h5_exposure_caps", text="asset", whole="portfolio_id", real="weight", sql=f"""WITH a AS (SELECT *, GREATEST(LEAST(value, 0.6), -0.6) AS w FROM ({_CAPPED}) x), b AS (SELECT *, w * CASE WHEN SUM(ABS(w)) OVER (PARTITION BY portfolio_id) > 1.5 THEN 1.5 / SUM(ABS(w)) OVER (PARTITION BY portfolio_id) ELSE 1 END AS w2 FROM a),
 c AS (SELECT *, w2 * CASE WHEN asset_class = 'Down' AND SUM(ABS(w2)) OVER (PARTITION BY portfolio_id, asset_class) > 0.5 THEN 0.5 / SUM(ABS(w2)) OVER (PARTITION BY portfolio_id, asset_class) ELSE 1 END AS w3 FROM b), d AS (SELECT *, w3 * CASE WHEN venue = 'Web' AND SUM(ABS(w3)) OVER (PARTITION BY portfolio_id, venue) > 0.4 THEN 0.4 / SUM(ABS(w3)) OVER (PARTITION BY portfolio_id, venue) ELSE 1 END AS w4 FROM c),
 e AS (SELECT *, SUM(GREATEST(w4, 0)) OVER (PARTITION BY portfolio_id) AS l, SUM(LEAST(w4, 0)) OVER (PARTITION BY portfolio_id) AS s FROM d), f AS (SELECT *, w4 * CASE WHEN l + s > 0.3 AND w4 > 0 THEN GREATEST(0, (0.3 - s) / l) WHEN l + s < -0.2 AND w4 < 0 THEN GREATEST(0, (-0.2 - l) / s) ELSE 1 END AS w5 FROM e),
 g AS (SELECT *, SUM(ABS(w5 - held)) OVER (PARTITION BY portfolio_id) AS turn FROM f)
SELECT portfolio_id, asset, CASE WHEN turn > 0.7 THEN held + (w5 - held) * 0.7 / turn ELSE w5 END AS weight FROM g""")
def _(t: Tables) -> DataFrame:
    caps = t.spark.createDataFrame([("asset_class", "down", 0.5), ("venue", "WEB", 0.4)], "attribute string, bucket string, cap double")
    return targets.apply_exposure_caps(t.sql(_CAPPED).withColumnRenamed("held", "current"), caps, ["portfolio_id"], ["asset_class", "venue"], 0.6, 1.5, -0.2, 0.3, 0.7)


@query("h6_blend_to_turnover", text="asset", whole="portfolio_id", real="turnover weight", sql="SELECT portfolio_id, asset, turnover, 0.2 + (weight - 0.2) * CASE WHEN turnover > 0.3 THEN 0.3 / turnover ELSE 1 END AS weight FROM (SELECT *, SUM(ABS(weight - 0.2)) OVER (PARTITION BY portfolio_id) AS turnover FROM {cand}) x")
def _(t: Tables) -> DataFrame:
    return targets.blend_to_turnover(t.cand.select("portfolio_id", "asset", F.lit(0.2).alias("current"), F.col("weight").alias("target")), ["portfolio_id"], 0.3)


@query("h7_soft_threshold", text="asset", whole="portfolio_id", real="trade", sql="SELECT portfolio_id, asset, SIGN(weight - 0.2) * GREATEST(ABS(weight - 0.2) - 0.01 * LENGTH(asset), 0) AS trade FROM {cand}")
def _(t: Tables) -> DataFrame:
    return targets.soft_threshold_trades(t.cand.select("portfolio_id", "asset", F.lit(0.2).alias("current"), F.col("weight").alias("target"), F.length("asset").alias("cost")), 0.01)


# Covariances of the three flags of each supplier that has them all, in one row.
_THREE = "WITH m AS (SELECT a.book AS book, a.asset AS a, b.asset AS b, COVAR_SAMP(a.ret, b.ret) * CASE WHEN a.asset = b.asset THEN 12 ELSE 12 * 0.8 END AS v FROM {ret_many} a JOIN {ret_many} b ON a.book = b.book AND a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2), s AS (SELECT book, MAX(CASE WHEN a = 'A' AND b = 'A' THEN v END) AS aa, MAX(CASE WHEN a = 'A' AND b = 'N' THEN v END) AS an, MAX(CASE WHEN a = 'A' AND b = 'R' THEN v END) AS ar, MAX(CASE WHEN a = 'N' AND b = 'N' THEN v END) AS nn, MAX(CASE WHEN a = 'N' AND b = 'R' THEN v END) AS nr, MAX(CASE WHEN a = 'R' AND b = 'R' THEN v END) AS rr FROM m GROUP BY 1 HAVING COUNT(*) = 6)"


def _three(t: Tables) -> DataFrame:
    cov = covariance.cov_diagonal(t.ret_many, ["book"], 0.2, 12.0)
    return cov.join(cov.groupBy("book").agg(F.count("*").alias("pairs")).where("pairs = 6").select("book"), "book")


@query("g5_one_view", text="asset", whole="book", real="prior posterior", sql=_THREE + """, f AS (SELECT book, 'A' AS asset, (aa + an + ar) / 3 * 2.5 AS prior, aa - ar AS sp FROM s UNION ALL SELECT book, 'N', (an + nn + nr) / 3 * 2.5, an - nr FROM s UNION ALL SELECT book, 'R', (ar + nr + rr) / 3 * 2.5, ar - rr FROM s), g AS (SELECT book, SUM(CASE WHEN asset = 'A' THEN sp WHEN asset = 'R' THEN -sp ELSE 0 END) AS psp, SUM(CASE WHEN asset = 'A' THEN prior WHEN asset = 'R' THEN -prior ELSE 0 END) AS expected FROM f GROUP BY 1)
SELECT f.book AS book, asset, prior, prior + sp / (2 * psp) * (0.01 - expected) AS posterior FROM f JOIN g ON g.book = f.book""")
def _(t: Tables) -> DataFrame:
    """One view by supplier, where the posterior has a closed form."""
    cov = _three(t)
    w = cov.where("a = b").select("book", F.col("a").alias("asset"), F.lit(1 / 3).alias("weight"))
    views = w.select("book", F.lit(1).alias("view"), "asset", F.when(F.col("asset") == "A", 1.0).when(F.col("asset") == "R", -1.0).otherwise(0.0).alias("p"), F.lit(0.01).alias("q"))
    return signals.black_litterman(cov, w, views, ["book"])


@query("h8_risk_shares", text="asset", whole="book", real="share", digits=5, sql=_THREE + "\nSELECT book, asset, 1.0 / 3 AS share FROM s CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS f(asset)")
def _(t: Tables) -> DataFrame:
    """Shares of the variance under equal risk, as E11 finds them."""
    cov = _three(t)
    parts = covariance.risk_contributions(targets.equal_risk_contribution(cov, ["book"]), cov, ["book"], ["book"])
    return parts.withColumn("share", F.col("contribution") / F.col("variance"))


@query("h9_three_assets", text="asset", whole="book", real="weight", digits=6, sql=_THREE + """, v AS (SELECT *, (1 / nn + 1 / rr + 2 * nr / (nn * rr)) / ((1 / nn + 1 / rr) * (1 / nn + 1 / rr)) AS pair FROM s)
SELECT book, 'A' AS asset, pair / (aa + pair) AS weight FROM v UNION ALL SELECT book, 'N', aa / (aa + pair) * rr / (nn + rr) FROM v UNION ALL SELECT book, 'R', aa / (aa + pair) * nn / (nn + rr) FROM v""")
def _(t: Tables) -> DataFrame:
    """Three assets: the first stands against the two others, whatever the links."""
    return targets.hierarchical_risk_parity(_three(t), ["book"])


@query("h8_equal_risk", text="asset status", whole="book", real="weight", digits=5)
def _(t: Tables) -> DataFrame:
    return targets.equal_risk_contribution(covariance.cov_diagonal(t.ret_many, ["book"], 0.2, 12.0), ["book"])


@query("h9_hierarchical_risk_parity", text="asset status", whole="book", real="weight", digits=5)
def _(t: Tables) -> DataFrame:
    return targets.hierarchical_risk_parity(covariance.cov_diagonal(t.ret_many, ["book"], 0.2, 12.0), ["book"])


# --- risk

_PNL = "SELECT portfolio_id, t AS scenario_no, SUM(weight * ret) AS pnl FROM {cand} w JOIN {ret_small} r ON r.asset = w.asset GROUP BY 1, 2"


def _pnl(t: Tables) -> DataFrame:
    return risk.scenario_pnl(t.cand, t.ret_small.withColumnRenamed("t", "scenario_no"), ["portfolio_id"])


@query("j1_scenario_pnl", text="scenario_no", whole="portfolio_id", real="pnl", sql=_PNL)
def _(t: Tables) -> DataFrame:
    return _pnl(t)


_DD = f"WITH p AS ({_PNL}), c AS (SELECT *, SUM(pnl) OVER (PARTITION BY portfolio_id ORDER BY scenario_no) AS c FROM p), d AS (SELECT portfolio_id, scenario_no, GREATEST(MAX(c) OVER (PARTITION BY portfolio_id ORDER BY scenario_no), 0) - c AS drawdown FROM c)"


@query("j2_max_drawdown", whole="portfolio_id", real="max_drawdown", sql=_DD + "\nSELECT portfolio_id, MAX(drawdown) AS max_drawdown FROM d GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return risk.max_drawdown(_pnl(t), ["portfolio_id"])


@query("j3_wealth_drawdown", text="t", whole="book", real="drawdown", digits=5, sql="WITH m AS (SELECT book, t, AVG(ret) AS r FROM {ret_many} GROUP BY 1, 2), e AS (SELECT book, t, EXP(SUM(LN(1 + r / 20)) OVER (PARTITION BY book ORDER BY t)) AS equity FROM m)\nSELECT book, t, equity / GREATEST(MAX(equity) OVER (PARTITION BY book ORDER BY t), 1) - 1 AS drawdown FROM e")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("book").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    e = t.ret_many.groupBy("book", "t").agg(F.avg("ret").alias("r")).withColumn("equity", F.product(1 + F.col("r") / 20).over(w))
    return risk.wealth_drawdown(e, ["book"], 1.0)


@query("j4_cvar", whole="portfolio_id", real="var value", sql=f"WITH l AS (SELECT portfolio_id, -pnl AS loss FROM ({_PNL}) p), q AS (SELECT portfolio_id, QUANTILE_DISC(loss, 0.9) AS var FROM l GROUP BY 1)\nSELECT l.portfolio_id AS portfolio_id, MAX(var) AS var, MAX(var) + AVG(GREATEST(loss - var, 0)) / 0.1 AS value FROM l JOIN q ON q.portfolio_id = l.portfolio_id GROUP BY l.portfolio_id")
def _(t: Tables) -> DataFrame:
    return risk.cvar(_pnl(t).select("portfolio_id", (-F.col("pnl")).alias("loss")), ["portfolio_id"], 0.9)


@query("j5_cdar", whole="portfolio_id", real="var value", sql=_DD + ", k AS (SELECT portfolio_id, drawdown AS loss, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY drawdown) AS r, COUNT(*) OVER (PARTITION BY portfolio_id) AS n FROM d), q AS (SELECT *, MAX(CASE WHEN r = CEIL(ROUND((n - 1) * 0.8, 9)) + 1 THEN loss END) OVER (PARTITION BY portfolio_id) AS var FROM k)\nSELECT portfolio_id, MAX(var) AS var, MAX(var) + AVG(GREATEST(loss - var, 0)) / 0.2 AS value FROM q GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return risk.cdar(_pnl(t), ["portfolio_id"], 0.8)


def _evar_sql(losses: str, beta: float, points: int = 40, rounds: int = 3) -> str:
    """The rounds of the grid, each around the best point of the round before, as common table expressions."""
    parts = [f"l AS ({losses})", f"b0 AS (SELECT portfolio_id, MAX(loss) AS top, GREATEST(MAX(ABS(loss)), 1e-12) * 1e-4 AS lo, GREATEST(MAX(ABS(loss)), 1e-12) * 1e3 AS hi FROM l GROUP BY 1)", f"i AS (SELECT UNNEST(RANGE(0, {points})) AS i)"]
    for r in range(rounds):
        parts.append(f"g{r} AS (SELECT portfolio_id, top, lo, hi, i, lo * POW(hi / lo, i / {points - 1}.0) AS tau FROM b{r}, i)")
        parts.append(f"m{r} AS (SELECT g{r}.portfolio_id AS portfolio_id, MAX(top) AS top, MAX(lo) AS lo, MAX(hi) AS hi, g{r}.i AS i, MAX(tau) AS tau, MAX(top) + MAX(tau) * (LN(AVG(EXP((loss - top) / tau))) - LN(1 - {beta})) AS value FROM g{r} JOIN l ON l.portfolio_id = g{r}.portfolio_id GROUP BY g{r}.portfolio_id, g{r}.i)")
        parts.append(f"b{r + 1} AS (SELECT portfolio_id, MAX(top) AS top, MIN(value) AS value, ARG_MIN(tau, value) / POW(MAX(hi) / MAX(lo), 1.0 / {points - 1}) AS lo, ARG_MIN(tau, value) * POW(MAX(hi) / MAX(lo), 1.0 / {points - 1}) AS hi FROM m{r} GROUP BY 1)")
    return f"WITH {', '.join(parts)}\nSELECT portfolio_id, value FROM b{rounds}"


@query("j6_evar", whole="portfolio_id", real="value", digits=5, sql=_evar_sql(f"SELECT portfolio_id, -pnl AS loss FROM ({_PNL}) p", 0.9))
def _(t: Tables) -> DataFrame:
    return risk.evar(_pnl(t).select("portfolio_id", (-F.col("pnl")).alias("loss")), ["portfolio_id"], 0.9)


_OBJ = _VAR + ", mu AS (SELECT asset, AVG(ret) AS mu FROM {ret_small} GROUP BY 1), o AS (SELECT r.portfolio_id, SUM(weight * mu) AS mean, MAX(variance) AS variance, MAX(alone) AS alone, SUM(CASE WHEN weight > 0.2 THEN (weight - 0.2) * 0.001 ELSE (0.2 - weight) * 0.002 END) AS cost FROM r JOIN mu ON mu.asset = r.asset GROUP BY 1)"
_VALUES = "SELECT portfolio_id, 'mean_variance' AS kind, mean - 2 * variance - cost AS value, 'ok' AS status FROM o UNION ALL SELECT portfolio_id, 'sharpe' AS kind, CASE WHEN mean > 0.0005 THEN (mean - 0.0005) / SQRT(variance) END AS value, CASE WHEN mean > 0.0005 THEN 'ok' ELSE 'no_positive_excess_return' END AS status FROM o UNION ALL SELECT portfolio_id, 'diversification' AS kind, alone / SQRT(variance) AS value, 'ok' AS status FROM o"


def _objectives(t: Tables) -> DataFrame:
    mu = t.ret_small.groupBy("asset").agg(F.avg("ret").alias("mu"))
    held = mu.select("asset", F.lit(0.2).alias("weight"))
    rates = mu.select("asset", F.lit(0.001).alias("buy_rate"), F.lit(0.002).alias("sell_rate"))
    return risk.objective_values(t.cand, mu, _cov(t), ["portfolio_id"], 4.0, 0.0005, rates, held)


@query("j7_sharpe", text="status", whole="portfolio_id", real="value", sql=_OBJ + "\nSELECT portfolio_id, CASE WHEN mean > 0.0005 THEN (mean - 0.0005) / SQRT(variance) END AS value, CASE WHEN mean > 0.0005 THEN 'ok' ELSE 'no_positive_excess_return' END AS status FROM o")
def _(t: Tables) -> DataFrame:
    return _objectives(t).where("kind = 'sharpe'")


@query("j7_excess_return_ratio", text="status", whole="portfolio_id", real="ratio", sql="WITH a AS (SELECT portfolio_id, t, SUM((weight - 0.2) * ret) AS active, SUM(weight * ret) AS own, SUM(0.2 * ret) AS bench FROM {cand} w JOIN {ret_small} r ON r.asset = w.asset GROUP BY 1, 2), p AS (SELECT portfolio_id, AVG(own) AS mean, AVG(bench) AS benchmark_mean, STDDEV_SAMP(active) AS te FROM a GROUP BY 1)\nSELECT portfolio_id, CASE WHEN te > 1e-9 AND mean > benchmark_mean THEN (mean - benchmark_mean) / te END AS ratio, CASE WHEN te <= 1e-9 THEN 'undefined_ratio' WHEN mean <= benchmark_mean THEN 'no_positive_excess_return' ELSE 'ok' END AS status FROM p")
def _(t: Tables) -> DataFrame:
    a = t.cand.join(t.ret_small, "asset").groupBy("portfolio_id", "t").agg(F.sum((F.col("weight") - 0.2) * F.col("ret")).alias("active"), F.sum(F.col("weight") * F.col("ret")).alias("own"), F.sum(0.2 * F.col("ret")).alias("bench"))
    p = a.groupBy("portfolio_id").agg(F.avg("own").alias("mean"), F.avg("bench").alias("benchmark_mean"), F.stddev_samp("active").alias("tracking_error"))
    return risk.excess_return_ratio(p)


@query("j9_target_distance", text="kind status", whole="portfolio_id", real="value", sql="SELECT portfolio_id, 'target_distance' AS kind, 'ok' AS status, -SUM((weight - 0.2) * (weight - 0.2) + CASE WHEN weight > 0.1 THEN (weight - 0.1) * 0.001 ELSE (0.1 - weight) * 0.002 END + ABS(weight - 0.1) * 0.01 + 0.05 * POW(ABS(weight - 0.1), 1.5)) AS value FROM {cand} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    names = t.ret_small.select("asset").distinct()
    linear = names.select("asset", F.lit(0.1).alias("held"), F.lit(0.001).alias("buy_rate"), F.lit(0.002).alias("sell_rate"))
    return risk.target_distance_values(t.cand, names.select("asset", F.lit(0.2).alias("weight")), ["portfolio_id"], linear, 0.01, names.select("asset", F.lit(0.05).alias("coef")))


@query("j8_diversification_ratio", whole="portfolio_id", real="ratio", sql=_OBJ + "\nSELECT portfolio_id, alone / SQRT(variance) AS ratio FROM o")
def _(t: Tables) -> DataFrame:
    return risk.diversification_ratio(t.cand, _cov(t), ["portfolio_id"])


@query("j9_objective_values", text="kind status", whole="portfolio_id", real="value", sql=_OBJ + f", v AS ({_VALUES})\nSELECT * FROM v")
def _(t: Tables) -> DataFrame:
    return _objectives(t)


@query("j9_active", text="kind status", whole="portfolio_id", real="value", digits=7, sql=_OBJ + f""", sb AS (SELECT a AS asset, SUM(value * CASE WHEN b = 'click' THEN 0.5 WHEN b = 'view' THEN 0.3 ELSE 0 END) AS sb FROM c GROUP BY 1), bb AS (SELECT SUM(sb * CASE WHEN asset = 'click' THEN 0.5 WHEN asset = 'view' THEN 0.3 ELSE 0 END) AS bb FROM sb),
 x AS (SELECT w.portfolio_id AS portfolio_id, SUM(weight * sb) AS wb, SUM(CASE WHEN weight > 0.2 THEN (weight - 0.2) * 0.001 ELSE (0.2 - weight) * 0.002 END + ABS(weight - 0.2) * 0.01 + 0.05 * POW(ABS(weight - 0.2), 1.5)) AS paid FROM {{cand}} w JOIN sb ON sb.asset = w.asset GROUP BY 1)
SELECT o.portfolio_id AS portfolio_id, 'mean_variance' AS kind, 'ok' AS status, mean - 2 * (variance - 2 * wb + bb) - paid AS value FROM o JOIN x ON x.portfolio_id = o.portfolio_id, bb""")
def _(t: Tables) -> DataFrame:
    """Mean-variance against a benchmark, after linear costs, a penalty on turnover and impact."""
    mu = t.ret_small.groupBy("asset").agg(F.avg("ret").alias("mu"))
    bench = mu.select("asset", F.when(F.col("asset") == "click", 0.5).otherwise(0.3).alias("weight")).where("asset IN ('click', 'view')")
    held, rates = mu.select("asset", F.lit(0.2).alias("weight")), mu.select("asset", F.lit(0.001).alias("buy_rate"), F.lit(0.002).alias("sell_rate"))
    v = risk.objective_values(t.cand, mu, _cov(t), ["portfolio_id"], 4.0, 0.0005, rates, held, bench, 0.01, mu.select("asset", F.lit(0.05).alias("coef")))
    return v.where("kind = 'mean_variance'")


def _tails(t: Tables) -> DataFrame:
    mu = t.ret_small.groupBy("asset").agg(F.avg("ret").alias("mu"))
    return risk.objective_values(t.cand, mu, _cov(t), ["portfolio_id"], scenarios=t.ret_small.withColumnRenamed("t", "scenario_no"), beta=0.9, target=mu.select("asset", F.lit(0.2).alias("weight")))


_TAIL_ROWS = _DD + f""", l AS (SELECT portfolio_id, -pnl AS loss FROM p), q AS (SELECT portfolio_id, QUANTILE_DISC(loss, 0.9) AS var FROM l GROUP BY 1), cv AS (SELECT l.portfolio_id AS portfolio_id, -(MAX(var) + AVG(GREATEST(loss - var, 0)) / 0.1) AS value FROM l JOIN q ON q.portfolio_id = l.portfolio_id GROUP BY l.portfolio_id),
 k AS (SELECT portfolio_id, drawdown AS loss, ROW_NUMBER() OVER (PARTITION BY portfolio_id ORDER BY drawdown) AS r, COUNT(*) OVER (PARTITION BY portfolio_id) AS n FROM d), e AS (SELECT *, MAX(CASE WHEN r = CEIL(ROUND((n - 1) * 0.9, 9)) + 1 THEN loss END) OVER (PARTITION BY portfolio_id) AS var FROM k), cd AS (SELECT portfolio_id, -(MAX(var) + AVG(GREATEST(loss - var, 0)) / 0.1) AS value FROM e GROUP BY 1),
 td AS (SELECT portfolio_id, -SUM((weight - 0.2) * (weight - 0.2)) AS value FROM {{cand}} GROUP BY 1), v AS (SELECT portfolio_id, 'cvar' AS kind, value FROM cv UNION ALL SELECT portfolio_id, 'cdar', value FROM cd UNION ALL SELECT portfolio_id, 'target_distance', value FROM td)"""


@query("j9_tail_values", text="kind status", whole="portfolio_id", real="value", sql=_TAIL_ROWS + "\nSELECT portfolio_id, kind, 'ok' AS status, value FROM v")
def _(t: Tables) -> DataFrame:
    """CVaR, CDaR and target distance as objectives; j6_evar has the SQL of EVaR."""
    return _tails(t).where("kind IN ('cvar', 'cdar', 'target_distance')")


@query("j10_best_by_tail", text="kind status", whole="grp", real="value", sql=_TAIL_ROWS + "\nSELECT portfolio_id % 50 AS grp, kind, 'ok' AS status, MAX(value) AS value FROM v WHERE portfolio_id NOT IN (SELECT portfolio_id FROM {cand} WHERE weight > 0.3) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """The best feasible candidate of each group by tail risk and by distance."""
    values = _tails(t).where("kind IN ('cvar', 'cdar', 'target_distance')").withColumn("grp", F.col("portfolio_id") % 50)
    bad = t.cand.where("weight > 0.3").select((F.col("portfolio_id") % 50).alias("grp"), "portfolio_id").distinct()
    return risk.best_feasible_candidate(values, bad, ["grp"]).where("status = 'ok'")


@query("j10_best_candidate", text="kind status", whole="grp", real="value", sql=_OBJ + f", v AS ({_VALUES}), ok AS (SELECT v.portfolio_id % 50 AS grp, v.* FROM v WHERE portfolio_id NOT IN (SELECT portfolio_id FROM {{cand}} WHERE weight > 0.3)), best AS (SELECT grp, kind, MAX(CASE WHEN status = 'ok' THEN value END) AS value, MIN(CASE WHEN status <> 'ok' THEN status END) AS why FROM ok GROUP BY 1, 2), asked AS (SELECT DISTINCT portfolio_id % 50 AS grp, kind FROM v)\nSELECT asked.grp AS grp, asked.kind AS kind, value, CASE WHEN value IS NOT NULL THEN 'ok' ELSE COALESCE(why, 'infeasible') END AS status FROM asked LEFT JOIN best ON best.grp = asked.grp AND best.kind = asked.kind")
def _(t: Tables) -> DataFrame:
    values = _objectives(t).withColumn("grp", F.col("portfolio_id") % 50)
    bad = t.cand.where("weight > 0.3").select((F.col("portfolio_id") % 50).alias("grp"), "portfolio_id").distinct()
    return risk.best_feasible_candidate(values, bad, ["grp"])


@query("j11_candidate_grid", text="asset", whole="book n", real="total", sql="WITH a AS (SELECT DISTINCT book FROM {px_many}), s AS (SELECT UNNEST(RANGE(0, 6)) AS i), g AS (SELECT book, x.i AS x, y.i AS y, 5 - x.i - y.i AS z FROM a, s x, s y WHERE x.i + y.i <= 5)\nSELECT book, 'A' AS asset, COUNT(*) AS n, SUM(x / 5) AS total FROM g GROUP BY 1 UNION ALL SELECT book, 'N' AS asset, COUNT(*) AS n, SUM(y / 5) AS total FROM g GROUP BY 1 UNION ALL SELECT book, 'R' AS asset, COUNT(*) AS n, SUM(z / 5) AS total FROM g GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = risk.candidate_grid(t.px_many.select("book", "asset").distinct(), 5, ["book"])
    return g.groupBy("book", "asset").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))
