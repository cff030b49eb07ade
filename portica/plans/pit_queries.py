"""Queries of the point-in-time and exposure operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import checks, columns
from ..operators import exposure, pit
from .prep import Tables
from .registry import query

_LATEST = """SELECT book, cutoff, obs_time, nav, DATE_DIFF('day', obs_time, cutoff) AS age_days,
 CASE WHEN DATE_DIFF('day', obs_time, cutoff) > 25 THEN 'stale' WHEN DATE_DIFF('day', obs_time, cutoff) > 0 THEN 'carried' ELSE 'ok' END AS status
 FROM (SELECT b.*, cutoff, ROW_NUMBER() OVER (PARTITION BY book, cutoff ORDER BY obs_time DESC) AS rn FROM {book_nav} b JOIN {cutoffs} ON obs_time <= cutoff) x WHERE rn = 1"""


def _latest(t: Tables) -> DataFrame:
    return pit.latest_as_of(t.book_nav, t.cutoffs, ["book"], 25.0)


@query("b1_latest_as_of", text="book cutoff obs_time status", real="nav age_days", sql=_LATEST, digits=3)
def _(t: Tables) -> DataFrame:
    return _latest(t)


_SNAP = f"""WITH l AS ({_LATEST}), h AS (SELECT l.book, l.cutoff, symbol, weight, h.obs_time AS held_at, l.obs_time, available_at, MAX(h.obs_time) OVER (PARTITION BY l.book, l.cutoff) AS last_held
 FROM l JOIN {{book_holdings}} h ON h.book = l.book AND h.obs_time <= l.obs_time)
SELECT book, cutoff, symbol, weight, CASE WHEN held_at <> obs_time THEN 'date_mismatch' WHEN available_at > cutoff THEN 'late' ELSE 'ok' END AS status FROM h WHERE held_at = last_held"""


@query("b2_match_snapshot", text="book cutoff symbol status", real="weight", sql=_SNAP)
def _(t: Tables) -> DataFrame:
    return pit.match_snapshot(t.book_holdings, _latest(t), ["book"])


_SCORES = """SELECT symbol, cutoff, obs_time, available_at, score FROM (SELECT s.*, cutoff, ROW_NUMBER() OVER (PARTITION BY symbol, cutoff ORDER BY obs_time DESC, available_at DESC) AS rn
 FROM {book_scores} s JOIN {cutoffs} ON obs_time <= cutoff AND available_at <= cutoff) x WHERE rn = 1"""


@query("b3_latest_scores", text="symbol cutoff obs_time available_at", real="score", sql=_SCORES, digits=9)
def _(t: Tables) -> DataFrame:
    return pit.latest_scores_as_of(t.book_scores, t.cutoffs, ["symbol"])


def _fx(t: Tables) -> DataFrame:
    o = t.obs.withColumnRenamed("end_", "end").withColumn("fx_start_known_at", F.col("start")).withColumn("fx_end_known_at", F.date_add("end", 1))
    return pit.fx_base_returns(o)


_FX = "SELECT study, sleeve, start, end_, vintage, (1 + net_return) * (fx_end / fx_start) - 1 AS base_return, GREATEST(known_at, CAST(end_ + INTERVAL '1' DAY AS DATE)) AS available_at FROM {obs}"


@query("b4_fx_base_returns", text="sleeve start available_at", whole="vintage", real="base_return", sql=_FX, digits=9)
def _(t: Tables) -> DataFrame:
    return _fx(t)


_VIS = f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sleeve, start, end_ ORDER BY vintage DESC) AS rn FROM ({_FX}) f WHERE available_at <= DATE '1999-01-01') x WHERE rn = 1"


@query("b5_visible_vintage", text="sleeve start", whole="vintage", real="base_return", sql=_VIS, digits=9)
def _(t: Tables) -> DataFrame:
    return pit.visible_vintage(_fx(t), F.lit("1999-01-01").cast("date"), ["sleeve"])


@query("b6_align_complete_periods", text="sleeve start", real="base_return", digits=9, sql=f"SELECT sleeve, start, base_return FROM (SELECT *, COUNT(*) OVER (PARTITION BY start, end_) AS n FROM ({_VIS}) v) y WHERE n = 5")
def _(t: Tables) -> DataFrame:
    return pit.align_complete_periods(pit.visible_vintage(_fx(t), F.lit("1999-01-01").cast("date"), ["sleeve"]), 5)


@query("b6_coverage", text="latest_input", whole="visible complete incomplete", sql=f"SELECT COUNT(*) AS visible, SUM(CASE WHEN n = 5 THEN 1 ELSE 0 END) AS complete, SUM(CASE WHEN n <> 5 THEN 1 ELSE 0 END) AS incomplete, MAX(a) AS latest_input FROM (SELECT start, end_, COUNT(DISTINCT sleeve) AS n, MAX(available_at) AS a FROM ({_VIS}) v GROUP BY start, end_) y")
def _(t: Tables) -> DataFrame:
    return pit.coverage(pit.visible_vintage(_fx(t), F.lit("1999-01-01").cast("date"), ["sleeve"]), 5)


@query("b7_overlap_check", text="sleeve s e previous_end", sql="SELECT * FROM (SELECT sleeve, s, e, LAG(e) OVER (PARTITION BY sleeve ORDER BY s, e) AS previous_end FROM (SELECT DISTINCT o_orderpriority AS sleeve, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + (CAST(o_custkey % 3 AS INT) + 1) * INTERVAL '1' DAY AS DATE) AS e FROM {orders}) d) x WHERE previous_end > s")
def _(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderpriority").alias("sleeve"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 3).cast("int") + 1).alias("end"))
    return pit.overlap_check(o, ["sleeve"]).withColumnsRenamed({"start": "s", "end": "e"})


_HIST = f"""WITH fx AS ({_FX}), seen AS (SELECT fx.*, decision_at, ROW_NUMBER() OVER (PARTITION BY decision_at, sleeve, start, end_ ORDER BY vintage DESC) AS rn FROM fx JOIN {{decisions}} d ON d.study = fx.study AND end_ <= decision_at AND available_at <= decision_at),
 last AS (SELECT *, COUNT(*) OVER (PARTITION BY decision_at, start, end_) AS n FROM seen WHERE rn = 1), ranked AS (SELECT *, DENSE_RANK() OVER (PARTITION BY decision_at ORDER BY start DESC, end_ DESC) AS r FROM last WHERE n = 5),
 cut AS (SELECT * FROM ranked WHERE r <= 6)
SELECT decision_at, sleeve, start, base_return, MAX(r) OVER (PARTITION BY decision_at) AS n_periods, CASE WHEN MAX(r) OVER (PARTITION BY decision_at) < 4 THEN 'too_few' ELSE 'ok' END AS status FROM cut"""


@query("b8_rolling_asof_history", text="decision_at sleeve start status", whole="n_periods", real="base_return", sql=_HIST, digits=9)
def _(t: Tables) -> DataFrame:
    return pit.rolling_asof_history(_fx(t), t.decisions, 6, 4, 5)


def _labels(t: Tables) -> DataFrame:
    """Month labels of brands: the score is the return before, known five days after the label ends."""
    return t.sql(_LABELS)


_LABELS = "SELECT asset, t AS signal_at, CAST(t + INTERVAL '2' MONTH AS DATE) AS label_end, CAST(CAST(t + INTERVAL '2' MONTH AS DATE) + INTERVAL '5' DAY AS DATE) AS available_at, score, ret, 2 AS horizon_sessions FROM (SELECT asset, t, px / LAG(px) OVER (PARTITION BY asset ORDER BY t) - 1 AS score, LEAD(px, 2) OVER (PARTITION BY asset ORDER BY t) / px - 1 AS ret FROM {px_month}) x WHERE score IS NOT NULL AND ret IS NOT NULL"
_YEARS = "SELECT DISTINCT CAST(DATE_TRUNC('year', l_shipdate) AS DATE) AS decision_at FROM {lineitem}"


@query("b9_mature_labels", text="decision_at", whole="n", real="total", digits=6, sql=f"SELECT decision_at, COUNT(*) AS n, SUM(ret) AS total FROM ({_LABELS}) l JOIN ({_YEARS}) d ON available_at <= decision_at AND label_end <= decision_at AND signal_at < decision_at GROUP BY decision_at")
def _(t: Tables) -> DataFrame:
    return pit.mature_labels(_labels(t), t.sql(_YEARS), 2).groupBy("decision_at").agg(F.count("*").alias("n"), F.sum("ret").alias("total"))


@query("b10_non_overlapping_periods", text="decision_at s e", sql=f"""WITH RECURSIVE per AS (SELECT decision_at, signal_at, MAX(label_end) AS label_end FROM ({_LABELS}) l JOIN ({_YEARS}) d ON available_at <= decision_at AND label_end <= decision_at AND signal_at < decision_at GROUP BY decision_at, signal_at),
 walk AS (SELECT decision_at, MAX(signal_at) AS s, 1 AS k FROM per GROUP BY decision_at
 UNION ALL SELECT decision_at, s, k FROM (SELECT w.decision_at, MAX(p.signal_at) OVER (PARTITION BY w.decision_at) AS s, p.signal_at, w.k + 1 AS k FROM walk w JOIN per p ON p.decision_at = w.decision_at AND p.label_end <= w.s WHERE w.k < 6) z WHERE signal_at = s)
SELECT walk.decision_at, s, label_end AS e FROM walk JOIN per ON per.decision_at = walk.decision_at AND per.signal_at = s""")
def _(t: Tables) -> DataFrame:
    m = pit.mature_labels(_labels(t), t.sql(_YEARS), 2)
    per = m.groupBy("decision_at", "signal_at").agg(F.max("label_end").alias("label_end"), F.count_distinct("label_end").alias("n_ends"))
    return pit.non_overlapping_periods(per, 6, ["decision_at"]).select("decision_at", F.to_date("signal_at").alias("s"), F.to_date("label_end").alias("e"))


@query("b11_pit_market_check", text="rule", whole="n", sql="""WITH i AS (SELECT l_suppkey AS account_id, l_partkey AS instrument_id, l_extendedprice / l_quantity - 1500 AS price, 1 + l_tax - 0.05 AS fx, l_quantity - 1 AS adv, l_shipdate, l_linenumber FROM {lineitem}), one AS (SELECT account_id, instrument_id, MAX(price) AS price, MAX(fx) AS fx, MAX(adv) AS adv, MAX(l_shipdate) AS seen_at FROM i GROUP BY 1, 2),
 bad AS (SELECT 'price:not_positive' AS rule FROM one WHERE NOT price > 0 UNION ALL SELECT 'fx:not_positive' FROM one WHERE NOT fx > 0 UNION ALL SELECT 'adv:not_positive' FROM one WHERE NOT adv > 0 UNION ALL SELECT 'price:not_available' FROM one WHERE seen_at > TIMESTAMP '2001-01-01')
SELECT rule, COUNT(*) AS n FROM bad GROUP BY rule""")
def _(t: Tables) -> DataFrame:
    one = t.lineitem.groupBy(F.col("l_suppkey").alias("account_id"), F.col("l_partkey").alias("instrument_id")).agg(
        F.max(F.col("l_extendedprice") / F.col("l_quantity") - 1500).alias("price"), F.max(1 + F.col("l_tax") - 0.05).alias("fx"), F.max(F.col("l_quantity") - 1).alias("adv"), F.max("l_shipdate").alias("price_available_at")
    )
    day = F.lit("2001-01-01").cast("timestamp_ntz")
    inputs = one.select("*", day.alias("decision_at"), day.alias("fx_available_at"), day.alias("adv_available_at"), day.alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"), F.lit(False).alias("inverse"))
    held = one.select("account_id", "instrument_id", F.lit(1.0).alias("quantity"))
    return pit.pit_market_check(inputs, held, ["account_id"]).groupBy("rule").agg(F.count("*").alias("n"))


@query("b12_risk_snapshot", text="decision_at asset available_at", real="value", digits=9, sql="SELECT decision_at, asset, available_at, value FROM (SELECT decision_at, asset, available_at, value, ROW_NUMBER() OVER (PARTITION BY decision_at, asset ORDER BY available_at DESC, t DESC) AS rn FROM (SELECT asset, t, CAST(t + INTERVAL '10' DAY AS DATE) AS available_at, ret * ret AS value FROM {ret_month}) r JOIN {decisions} ON available_at <= decision_at) x WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    risk = t.ret_month.select(F.lit("study").alias("study"), "asset", F.col("t").alias("estimated_at"), F.date_add("t", 10).alias("available_at"), (F.col("ret") * F.col("ret")).alias("value"), F.lit(2).alias("horizon"))
    d = t.decisions.withColumn("horizon", F.lit(2))
    universe = risk.select("study", "asset").distinct()
    return pit.risk_snapshot_as_of(risk, d, universe, ["study"])[0]


def _sets(t: Tables):
    ids = t.cand.select("portfolio_id", "asset", "weight")
    return (ids.where("asset IN ('click', 'view')"), ids.where("asset IN ('view', 'error')"), ids.where("asset = 'purchase' AND portfolio_id % 2 = 0"), ids.where("asset = 'click' AND portfolio_id % 3 = 0").select("portfolio_id", "asset", F.lit(0.1).alias("lower"), F.lit(0.6).alias("upper")))


_UNION = """SELECT portfolio_id, asset, CASE WHEN asset IN ('view', 'error') THEN weight ELSE 0 END AS held, CASE WHEN asset = 'purchase' THEN weight ELSE 0 END AS benchmark, CASE WHEN asset = 'click' AND portfolio_id % 3 = 0 THEN 0.1 ELSE 0 END AS lo,
 CASE WHEN asset = 'click' AND portfolio_id % 3 = 0 THEN 0.6 WHEN asset IN ('click', 'view') THEN 1 ELSE 0 END AS hi FROM {cand} WHERE asset IN ('click', 'view', 'error') OR (asset = 'purchase' AND portfolio_id % 2 = 0)"""


@query("b13_asset_union", text="asset", whole="portfolio_id", real="held benchmark lo hi", sql=_UNION)
def _(t: Tables) -> DataFrame:
    return pit.asset_union(*_sets(t), ["portfolio_id"]).withColumnsRenamed({"current": "held", "lower": "lo", "upper": "hi"})


@query("b14_cost_coverage", text="asset status", whole="n", real="buy", sql=f"SELECT asset, CASE WHEN asset <> 'error' THEN 'ok' WHEN hi > 0 OR held <> 0 THEN 'missing' ELSE 'free' END AS status, COUNT(*) AS n, SUM(CASE WHEN asset <> 'error' THEN 0.001 * LENGTH(asset) ELSE 0 END) AS buy FROM ({_UNION}) u GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    u = pit.asset_union(*_sets(t), ["portfolio_id"])
    rates = t.cand.where("asset <> 'error'").select("portfolio_id", "asset", (0.001 * F.length("asset")).alias("buy_rate"), F.lit(0.002).alias("sell_rate"))
    return pit.cost_coverage(u, rates, ["portfolio_id"]).groupBy("asset", "status").agg(F.count("*").alias("n"), F.sum("buy_rate").alias("buy"))


@query("b15_evaluation_periods", text="s rule", sql=f"WITH p AS (SELECT DISTINCT start AS s, end_ AS e, LAG(end_) OVER (ORDER BY start) AS prev FROM (SELECT DISTINCT start, end_ FROM {{obs}} WHERE EXTRACT(MONTH FROM start) <> 5) q)\nSELECT s, 'gap' AS rule FROM p WHERE prev IS NOT NULL AND prev <> s UNION ALL SELECT s, 'immature' AS rule FROM p WHERE CAST(e + INTERVAL '3' DAY AS DATE) > DATE '2001-01-02' UNION ALL SELECT s, 'incomplete' AS rule FROM p WHERE s NOT IN (SELECT start FROM {{obs}} WHERE vintage = 1 GROUP BY start HAVING COUNT(DISTINCT sleeve) = 5)")
def _(t: Tables) -> DataFrame:
    o = t.obs.withColumnRenamed("end_", "end")
    periods = o.where("month(start) <> 5").select("study", "start", "end").distinct().withColumn("cash_known_at", F.date_add("end", 3))
    return pit.evaluation_periods_check(periods, o.where("vintage = 1"), F.lit("2001-01-02").cast("date"), 5, ["study"]).withColumnRenamed("start", "s")


@query("b16_liquidity_snapshot", text="asset rule", sql="SELECT asset, 'stale' AS rule FROM {liq_small} WHERE LENGTH(asset) > 6 UNION ALL SELECT asset, 'universe' AS rule FROM {liq_small} WHERE asset IN ('click', 'view')")
def _(t: Tables) -> DataFrame:
    liq = t.liq_small.select(F.lit(1).alias("book"), "asset", F.when(F.length("asset") > 6, F.lit("2024-01-01")).otherwise(F.lit("2024-01-29")).cast("timestamp").alias("observed_at"), F.lit("2024-01-30").cast("timestamp").alias("known_at"), F.col("adv").alias("adv_base"))
    return pit.liquidity_snapshot_check(liq, liq.where("asset <> 'click'"), liq.where("asset <> 'view'"), F.lit("2024-01-31").cast("timestamp"), 10.0, ["book"])


@query("b17_horizon_scenarios", text="asset status", whole="book scenario_no n_scenarios", real="ret", sql="SELECT book, asset, MAX(b) OVER (PARTITION BY book, asset) - b AS scenario_no, MAX(b) OVER (PARTITION BY book, asset) + 1 AS n_scenarios, ret, CASE WHEN MAX(b) OVER (PARTITION BY book, asset) + 1 < 10 THEN 'too_few' ELSE 'ok' END AS status FROM (SELECT book, asset, b, PRODUCT(1 + ret) - 1 AS ret FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY book, asset ORDER BY t DESC) - 1) // 3 AS b FROM {ret_many}) x GROUP BY 1, 2, 3 HAVING COUNT(*) = 3) y", digits=5)
def _(t: Tables) -> DataFrame:
    return pit.horizon_scenarios(t.ret_many, 3, 10, ["book"])


@query("b18_align_markets", whole="account_id trade_id", real="mark", digits=4, sql="SELECT account_id, trade_id, (SELECT MAX_BY(px, t) FROM {px_month} p WHERE p.asset = a.symbol AND t <= traded_at) AS mark FROM {acct_trades} a")
def _(t: Tables) -> DataFrame:
    events = t.acct_trades.select("account_id", "trade_id", F.col("symbol").alias("asset"), F.col("traded_at").alias("at"), F.lit(1).alias("sequence"))
    marks = t.px_month.select("asset", F.col("t").alias("at"), F.lit(0).alias("sequence"), F.col("px").alias("price"), F.lit(1.0).alias("fx"))
    return pit.align_markets_to_events(events, marks, ["asset"]).withColumnRenamed("price", "mark")


# --- combination and exposures

_BUDGET = """SELECT l.book, cutoff, l.nav, weight / SUM(weight) OVER (PARTITION BY cutoff) AS capital_weight, weight / SUM(weight) OVER (PARTITION BY cutoff) * position_scale AS budget_weight,
 weight / SUM(weight) OVER (PARTITION BY cutoff) * (1 - position_scale) AS cash_weight FROM (""" + _LATEST + """) l JOIN {books} b ON b.book = l.book"""


def _budgets(t: Tables) -> DataFrame:
    return exposure.book_budgets(_latest(t).join(t.books, "book"), ["cutoff"])


@query("c1_book_budgets", text="book cutoff", real="capital_weight budget_weight cash_weight total_nav", digits=4, sql=f"SELECT *, SUM(nav * capital_weight) OVER (PARTITION BY cutoff) AS total_nav FROM ({_BUDGET}) x")
def _(t: Tables) -> DataFrame:
    return _budgets(t)


_COMBINED = f"WITH b AS ({_BUDGET}), s AS ({_SNAP.replace('WITH l AS', 'WITH l AS')})\nSELECT s.cutoff, symbol, SUM(weight * budget_weight) AS weight FROM s JOIN b ON b.book = s.book AND b.cutoff = s.cutoff GROUP BY 1, 2"


def _combined(t: Tables) -> DataFrame:
    return exposure.combine_holdings(pit.match_snapshot(t.book_holdings, _latest(t), ["book"]), _budgets(t), ["cutoff"])


@query("c2_combine_holdings", text="cutoff symbol", real="weight", sql=_COMBINED)
def _(t: Tables) -> DataFrame:
    return _combined(t)


_TILT = f"""WITH w AS ({_COMBINED}), sc AS ({_SCORES}), j AS (SELECT w.cutoff, w.symbol, weight, score, AVG(score) OVER (PARTITION BY w.cutoff) AS m, STDDEV_POP(score) OVER (PARTITION BY w.cutoff) AS s FROM w LEFT JOIN sc ON sc.symbol = w.symbol AND sc.cutoff = w.cutoff),
 k AS (SELECT *, GREATEST(weight * (1 + 0.25 * (score - m) / CASE WHEN s > 0 THEN s ELSE 1 END), 0) AS tilted FROM j)
SELECT cutoff, symbol, CASE WHEN score IS NULL THEN weight ELSE tilted / SUM(tilted) OVER (PARTITION BY cutoff) * SUM(CASE WHEN score IS NOT NULL THEN weight END) OVER (PARTITION BY cutoff) END AS weight FROM k"""


def _tilted(t: Tables) -> DataFrame:
    return exposure.factor_tilt(_combined(t), pit.latest_scores_as_of(t.book_scores, t.cutoffs, ["symbol"]), 0.25, ["cutoff"])


@query("c3_factor_tilt", text="cutoff symbol", real="weight", sql=_TILT)
def _(t: Tables) -> DataFrame:
    return _tilted(t)


@query("book_status", text="cutoff symbol", real="weight total_nav", digits=4, sql=f"WITH tilt AS ({_TILT}), nav AS (SELECT cutoff, SUM(nav * capital_weight) AS total_nav FROM ({_BUDGET}) x GROUP BY cutoff)\nSELECT tilt.cutoff, symbol, weight, total_nav FROM tilt JOIN nav ON nav.cutoff = tilt.cutoff")
def _(t: Tables) -> DataFrame:
    """The status of all strategy books at every cutoff: tilted weights and the total NAV."""
    nav = _budgets(t).groupBy("cutoff").agg(F.max("total_nav").alias("total_nav"))
    return _tilted(t).join(nav, "cutoff")


@query("c4_group_weights", text="grp", whole="portfolio_id", real="weight", sql="SELECT portfolio_id, CASE WHEN asset IN ('click', 'view') THEN 'browse' WHEN asset = 'purchase' THEN 'buy' ELSE '__ungrouped__' END AS grp, SUM(weight) AS weight FROM {cand} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    groups = t.px_small.select("asset").distinct().where("asset IN ('click', 'view', 'purchase')").withColumn("grp", F.when(F.col("asset") == "purchase", "buy").otherwise("browse"))
    return exposure.group_weights(t.cand, groups, ["portfolio_id"])


_HELD = "SELECT l_suppkey AS account_id, p_brand AS venue, p_type AS asset_class, l_returnflag AS currency, l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS weight FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"


@query("c5_bucket_exposures", text="attribute bucket", whole="account_id", real="gross", sql=f"WITH h AS ({_HELD})\nSELECT account_id, 'venue' AS attribute, LOWER(venue) AS bucket, SUM(ABS(weight)) AS gross FROM h GROUP BY 1, 3 UNION ALL SELECT account_id, 'asset_class' AS attribute, LOWER(asset_class) AS bucket, SUM(ABS(weight)) AS gross FROM h GROUP BY 1, 3 UNION ALL SELECT account_id, 'currency' AS attribute, LOWER(currency) AS bucket, SUM(ABS(weight)) AS gross FROM h GROUP BY 1, 3")
def _(t: Tables) -> DataFrame:
    return exposure.bucket_exposures(t.sql(_HELD), ["venue", "asset_class", "currency"], ["account_id"])


@query("c6_leverage", whole="account_id", real="gross net", sql=f"SELECT account_id, SUM(ABS(weight)) AS gross, SUM(weight) AS net FROM ({_HELD}) h GROUP BY account_id")
def _(t: Tables) -> DataFrame:
    return exposure.leverage_summary(t.sql(_HELD), ["account_id"])


@query("c7_factor_exposures", text="factor", whole="grp", real="exposure active", sql="SELECT grp, factor, SUM(x * weight) AS exposure, SUM(x * (weight - 0.001)) AS active FROM {vec_weights} w JOIN {loadings} l ON l.asset = w.asset GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return exposure.factor_exposures(t.vec_weights.withColumn("benchmark", F.lit(0.001)), t.loadings, ["grp"])


@query("c7_shifted_bounds", text="factor", whole="grp", real="lo hi", digits=5, sql="SELECT grp, factor, -0.1 + SUM(x * weight) AS lo, 0.1 + SUM(x * weight) AS hi FROM {vec_weights} w JOIN {loadings} l ON l.asset = w.asset GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """Bounds of active exposures, moved by those of a benchmark for each group."""
    bounds = t.vec_weights.select("grp").distinct().crossJoin(t.loadings.select("factor").distinct()).withColumns({"lo": F.lit(-0.1), "hi": F.lit(0.1)})
    return exposure.shifted_factor_bounds(bounds, t.vec_weights, t.loadings, ["grp"])


_EDGES = """SELECT 'R' || r_name AS fund_id, 'N' || n_name AS instrument_id, 0.9 / COUNT(*) OVER (PARTITION BY r_name) AS weight FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
 UNION ALL SELECT 'N' || n_name AS fund_id, c_mktsegment AS instrument_id, 0.95 * SUM(c_acctbal + 1000) / SUM(SUM(c_acctbal + 1000)) OVER (PARTITION BY n_name) AS weight FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment"""


@query("c8_fund_look_through", text="instrument_id", whole="portfolio_id", real="exposure", sql=f"WITH e AS ({_EDGES}), w AS (SELECT CAST(r_regionkey AS BIGINT) % 2 AS portfolio_id, 'R' || r_name AS id, 1.0 / COUNT(*) OVER (PARTITION BY r_regionkey % 2) AS weight FROM {{region}})\nSELECT portfolio_id, b.instrument_id, SUM(w.weight * a.weight * b.weight) AS exposure FROM w JOIN e a ON a.fund_id = w.id JOIN e b ON b.fund_id = a.instrument_id GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    day = F.lit("2024-01-10").cast("date")
    edges = t.sql(_EDGES).withColumn("holding_date", day)
    # Every disclosure is revised; the first edition held twice as much.
    first = edges.withColumn("weight", F.col("weight") * 2).withColumn("available_at", day)
    edges = first.union(edges.withColumn("available_at", F.date_add(day, 3)))
    w = t.sql("SELECT CAST(r_regionkey AS BIGINT) % 2 AS portfolio_id, 'R' || r_name AS instrument_id, 1.0 / COUNT(*) OVER (PARTITION BY r_regionkey % 2) AS weight FROM {region}").withColumn("at", F.lit("2024-02-01").cast("date"))
    return exposure.fund_look_through(w, edges, ["portfolio_id"], max_depth=3)[0]


# --- checks

@query("a8_check_numeric", text="rule", whole="n", sql="SELECT 'c_acctbal:too_low' AS rule, COUNT(*) AS n FROM {customer} WHERE c_acctbal < 0 UNION ALL SELECT 'c_acctbal:too_high' AS rule, COUNT(*) AS n FROM {customer} WHERE c_acctbal > 9000")
def _(t: Tables) -> DataFrame:
    return checks.check_numeric(t.customer, {"c_acctbal": (0.0, 9000.0)}, ["c_custkey"]).groupBy("rule").agg(F.count("*").alias("n"))


@query("a9_check_keys", text="rule", whole="l_orderkey l_linenumber n", sql="SELECT l_orderkey, l_linenumber, COUNT(*) AS n, 'duplicate_key' AS rule FROM {lineitem} GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _(t: Tables) -> DataFrame:
    return checks.check_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("a10_observation_time", whole="event_id micros", sql="SELECT event_id, EPOCH_US(CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE DATE_TRUNC('second', ts) END) AS micros FROM {events}")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", F.unix_micros(columns.observation_time(text).cast("timestamp")).alias("micros"))


_ROW = """'{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_totalprice":' || CAST(o_totalprice AS VARCHAR) || '}'"""
_QUARTERS = ", ".join(f"SUM(CAST('0x' || SUBSTRING(h, {16 * i + 1}, 16) AS UBIGINT)) AS q{i}" for i in range(4))


@query("a11_digest_rows", text="grp digest", whole="rows", sql=f"WITH h AS (SELECT o_orderpriority AS grp, SHA256({_ROW}) AS h FROM {{orders}}), s AS (SELECT grp, COUNT(*) AS n, {_QUARTERS} FROM h GROUP BY 1)\nSELECT grp, n AS rows, SHA256(CONCAT_WS('|', n, q0, q1, q2, q3)) AS digest FROM s")
def _(t: Tables) -> DataFrame:
    return checks.digest_rows(t.orders.withColumnRenamed("o_orderpriority", "grp"), ["o_orderkey", "o_custkey", "o_totalprice"], ["grp"])


_CANDLE = "SELECT event_type AS product, CAST(ts AS DATE) AS day, MIN(value) AS low, MAX(value) AS high, MIN_BY(value, STRUCT_AT) AS open, MAX_BY(value, STRUCT_AT) AS close, COUNT(*) AS volume FROM {events} GROUP BY 1, 2"


@query("a5_candle_quality", text="product", whole="bars duplicates missing_days invalid_bars", real="adv adv_low adv_high volatility", digits=5, sql=f"""WITH c AS (SELECT * FROM ({_CANDLE.replace('STRUCT_AT', "ROW(ts, event_id)")}) x WHERE EXTRACT(DAY FROM day) <> 7), r AS (SELECT *, close / LAG(close) OVER (PARTITION BY product ORDER BY day) - 1 AS ret FROM c)
SELECT product, COUNT(*) AS bars, 0 AS duplicates, 31 - COUNT(*) AS missing_days, SUM(CASE WHEN low <= 0 OR low > LEAST(open, close) OR high < GREATEST(open, close) THEN 1 ELSE 0 END) AS invalid_bars, AVG(close * volume) AS adv, AVG(low * volume) AS adv_low, AVG(high * volume) AS adv_high, STDDEV_SAMP(ret) AS volatility FROM r GROUP BY product""")
def _(t: Tables) -> DataFrame:
    from ..sources.readers import candle_quality

    c = t.sql(_CANDLE.replace("STRUCT_AT", "STRUCT(ts, event_id)")).where("day(day) <> 7").withColumn("time", F.col("day").cast("timestamp"))
    return candle_quality(c, "2024-01-01", "2024-02-01", ["product"])
