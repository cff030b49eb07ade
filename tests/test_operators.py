"""Small tables with known results, and invariances."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from portica.functions import checks, columns
from portica.operators import audit, costs, covariance, exposure, ledger, pit, replay, risk, signals, targets
from portica.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_opaque_symbols_and_checks(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("symbol,weight\n000001,0.5\nNA,0.2\nNULL,0.1\n x,0.1\n,0.1\nNA,x\n")
    df = readers.read_symbol_table(spark, str(p), ["weight"])
    assert [r["symbol"] for r in df.collect()][:3] == ["000001", "NA", "NULL"]
    assert {(r["symbol"], r["rule"]) for r in readers.symbol_checks(df).collect()} == {(" x", "padded"), (None, "blank"), ("NA", "repeated")}


def test_numeric_checks_report_each_rule(spark):
    df = spark.createDataFrame([(1, 0.5, True), (2, float("nan"), True), (3, -1.0, False), (4, None, True)], "id int, x double, b boolean")
    got = rows(checks.check_numeric(df, {"x": (0.0, 1.0)}, ["id"]), "id", "rule")
    assert got == [(2, "x:not_finite"), (3, "x:too_low"), (4, "x:not_finite")]
    assert checks.check_numeric(df, {"b": (None, None)}, ["id"]).count() == 4
    with pytest.raises(checks.CheckFailed):
        checks.require(checks.check_keys(spark.createDataFrame([(1,), (1,)], "id int"), ["id"]))


def test_times_and_normal_functions(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01T12:00:00Z",), ("2024-01-01 12:00:00",)], "x string")
    got = [r[0] for r in df.select(F.unix_micros(columns.observation_time(F.col("x"))).alias("a")).collect()]
    assert got == [1704153599999999, 1704110400000000, 1704110400000000]
    assert [r[0] is None for r in df.select(columns.strict_timestamp(F.col("x"))).collect()] == [True, False, True]
    p = spark.createDataFrame([(0.5,), (0.975,), (0.025,)], "p double").select(columns.normal_quantile(F.col("p")), columns.normal_cdf(columns.normal_quantile(F.col("p")))).collect()
    assert [round(r[0], 6) for r in p] == [0.0, 1.959964, -1.959964]
    assert all(abs(r[1] - q) < 1e-8 for r, q in zip(p, (0.5, 0.975, 0.025)))
    c = spark.range(1).select(columns.normal_cdf(F.lit(1.0))).first()[0]
    assert abs(c - 0.8413447460685429) < 1e-14


def test_future_rows_change_no_earlier_selection(spark):
    obs = [("A", date(2024, 1, d), float(d)) for d in (1, 2, 5)]
    cut = spark.createDataFrame([(date(2024, 1, 3),)], "cutoff date")
    schema = "book string, obs_time date, nav double"
    base = pit.latest_as_of(spark.createDataFrame(obs[:2], schema), cut, ["book"], 1.0).collect()
    late = pit.latest_as_of(spark.createDataFrame(obs, schema), cut, ["book"], 1.0).collect()
    assert base == late and base[0]["nav"] == 2.0 and base[0]["status"] == "carried"


def test_tilt_golden_case(spark):
    w = spark.createDataFrame([(1, "AAA", 0.5), (1, "BBB", 0.5)], "k int, symbol string, weight double")
    s = spark.createDataFrame([(1, "AAA", 0.0), (1, "BBB", 1.0)], "k int, symbol string, score double")
    assert rows(exposure.factor_tilt(w, s, 0.25, ["k"]), "symbol", "weight") == [("AAA", 0.375), ("BBB", 0.625)]
    assert rows(exposure.factor_tilt(w, s, 0.0, ["k"]), "weight") == [(0.5,), (0.5,)]


def test_look_through_uses_the_last_revision(spark):
    d = date(2024, 1, 1)
    w = spark.createDataFrame([(1, date(2024, 2, 1), "F", 1.0)], "k int, at date, instrument_id string, weight double")
    e = spark.createDataFrame([("F", d, d, "S", 0.6), ("F", d, date(2024, 1, 5), "S", 0.5), ("F", d, date(2024, 3, 1), "S", 0.9)], "fund_id string, holding_date date, available_at date, instrument_id string, weight double")
    x, t = exposure.fund_look_through(w, e, ["k"])
    assert x.first()["exposure"] == 0.5 and rows(t, "known_weight", "unknown_weight") == [(0.5, 0.5)]


def test_look_through_adds_paths_and_keeps_unknown(spark):
    d = date(2024, 1, 1)
    w = spark.createDataFrame([(1, date(2024, 2, 1), "F1", 0.5), (1, date(2024, 2, 1), "F2", 0.5)], "k int, at date, instrument_id string, weight double")
    e = spark.createDataFrame([("F1", d, d, "S", 0.8), ("F2", d, d, "S", 0.8)], "fund_id string, holding_date date, available_at date, instrument_id string, weight double")
    x, t = exposure.fund_look_through(w, e, ["k"])
    assert round(x.first()["exposure"], 12) == 0.8 and x.first()["n_paths"] == 2
    assert round(t.first()["unknown_weight"], 12) == 0.2
    loop = spark.createDataFrame([("F1", d, d, "F2", 1.0), ("F2", d, d, "F1", 1.0)], "fund_id string, holding_date date, available_at date, instrument_id string, weight double")
    assert exposure.fund_look_through(w, loop, ["k"])[1].first()["unknown_weight"] == 1.0


def test_two_asset_risk(spark):
    r = spark.createDataFrame([(t, a, x) for a, xs in (("A", (0.1, -0.1, 0.0)), ("B", (0.0, 0.1, -0.1))) for t, x in enumerate(xs)], "t int, asset string, ret double")
    w = spark.createDataFrame([(1, "A", 0.4), (1, "B", 0.6)], "p int, asset string, weight double")
    cov = covariance.cov_diagonal(r, [], 0.0, 1.0)
    v = 0.16 * 0.01 + 0.36 * 0.01 - 0.48 * 0.005
    assert math.isclose(covariance.portfolio_variance(w, cov, ["p"]).first()["variance"], v)
    assert math.isclose(sum(x["contribution"] for x in covariance.risk_contributions(w, cov, ["p"]).collect()), v)
    assert math.isclose(covariance.risk_contributions(w, cov, ["p"]).first()["diversification_ratio"], 0.1 / v**0.5)
    flat = r.withColumn("ret", F.when(F.col("asset") == "A", 1.0).otherwise(F.col("ret")))
    assert [x["value"] for x in covariance.correlation_matrix(flat, []).where("a = 'A' and b = 'B'").collect()] == [None]


def test_risk_parity_kernels(spark):
    cov = spark.createDataFrame([(1, "A", "A", 0.04), (1, "A", "B", -0.012), (1, "B", "B", 0.01)], "k int, a string, b string, value double")
    for f in (targets.equal_risk_contribution, targets.hierarchical_risk_parity):
        got = {x["asset"]: x["weight"] for x in f(cov, ["k"]).collect()}
        want = (1 / 3, 2 / 3) if f is targets.equal_risk_contribution else (0.2, 0.8)
        assert abs(got["A"] - want[0]) < 1e-6 and abs(got["B"] - want[1]) < 1e-6


def test_black_litterman_without_views_is_the_prior(spark):
    cov = spark.createDataFrame([(1, "A", "A", 0.04), (1, "B", "B", 0.01)], "k int, a string, b string, value double")
    w = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], "k int, asset string, weight double")
    none = spark.createDataFrame([], "k int, view int, asset string, p double, q double")
    assert all(x["prior"] == x["posterior"] for x in signals.black_litterman(cov, w, none, ["k"]).collect())
    view = spark.createDataFrame([(1, 1, "A", 1.0, 0.2)], "k int, view int, asset string, p double, q double")
    a = {x["asset"]: x for x in signals.black_litterman(cov, w, view, ["k"]).collect()}["A"]
    assert math.isclose(a["posterior"], (a["prior"] + 0.2) / 2)


def test_causal_zscore_and_position(spark):
    s = spark.createDataFrame([(1, t, x) for t, x in enumerate((0.0, 1.0, 2.0, 100.0))], "k int, t int, x double")
    z = {r["t"]: r["z"] for r in signals.causal_zscore(s, 3, ["k"]).collect()}
    assert z[2] is None and math.isclose(z[3], 99 / math.sqrt(2 / 3))
    path = spark.createDataFrame([(1, t, x) for t, x in enumerate((0.0, 2.1, 1.0, -3.0, 0.1, -2.5, None))], "k int, t int, z double")
    assert [r["position"] for r in signals.hysteresis_position(path, 2.0, 0.5, ["k"]).orderBy("t").collect()] == [0, -1, -1, -1, 0, 1, 0]


def test_simplex_projection_bounds(spark):
    v = spark.createDataFrame([(1, "A", 5.0), (1, "B", 0.0), (1, "C", 0.0)], "k int, asset string, v double")
    got = rows(targets.project_capped_simplex(v, ["k"], 0.0, 0.5, 1.0), "asset", "weight")
    assert [round(w, 9) for _, w in got] == [0.5, 0.25, 0.25]
    assert {r["status"] for r in targets.project_capped_simplex(v, ["k"], 0.0, 0.2, 1.0).collect()} == {"infeasible"}
    assert [round(w, 9) for _, w in rows(targets.project_capped_simplex(v, ["k"], 0.0, 1 / 3, 1.0), "asset", "weight")] == [round(1 / 3, 9)] * 3


def test_tail_measures(spark):
    l = spark.createDataFrame([(1, float(x)) for x in range(1, 6)], "k int, loss double")
    assert math.isclose(risk.cvar(l, ["k"], 0.8).first()["value"], 5.0)
    one = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, loss double")
    assert abs(risk.evar(one, ["k"], 0.9).first()["value"] - 2.0) < 0.01
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.1, -0.3, 0.1))], "k int, scenario_no int, pnl double")
    assert math.isclose(risk.max_drawdown(p, ["k"]).first()["max_drawdown"], 0.3)


def test_grid_and_best_candidate(spark):
    u = spark.createDataFrame([(1, a) for a in "ABC"], "k int, asset string")
    g = risk.candidate_grid(u, 4, ["k"])
    assert g.select("portfolio_id").distinct().count() == 15
    assert all(abs(r["s"] - 1) < 1e-12 for r in g.groupBy("portfolio_id").agg(F.sum("weight").alias("s")).collect())
    v = spark.createDataFrame([(1, p, "sharpe", x, "ok") for p, x in (("a", 1.0), ("b", 2.0), ("c", 2.0))], "k int, portfolio_id string, kind string, value double, status string")
    bad = spark.createDataFrame([], "k int, portfolio_id string")
    assert risk.best_feasible_candidate(v, bad, ["k"]).first()["portfolio_id"] == "b"
    assert risk.best_feasible_candidate(v, v.select("k", "portfolio_id"), ["k"]).first()["status"] == "infeasible"


def test_replay_golden(spark):
    t = spark.createDataFrame([(1, d, a, 0.5) for d in (1, 2) for a in "AB"], "k int, t int, asset string, weight double")
    r = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 0.0), ("B", 1, 0.0), ("B", 2, 0.0)], "asset string, t int, ret double")
    out = replay.replay_schedule(t, r, ["k"]).orderBy("t").collect()
    assert [round(x["turnover"], 9) for x in out] == [0.0, round(1 / 3, 9)] and out[-1]["wealth"] == 1.5


def test_replay_switch_of_all_holdings(spark):
    t = spark.createDataFrame([(1, 1, "A", 1.0), (1, 2, "B", 1.0), (1, 3, "B", 1.0), (1, 4, "A", 1.0)], "k int, t int, asset string, weight double")
    r = spark.createDataFrame([(a, d, 0.0) for a in "AB" for d in (1, 2, 3)], "asset string, t int, ret double")
    out = replay.replay_schedule(t, r, ["k"], 0.1).orderBy("t").collect()
    assert [x["turnover"] for x in out] == [0.0, 2.0, 0.0, 2.0] and round(out[1]["net"], 9) == -0.2
    assert [x["status"] for x in out] == ["ok", "ok", "ok", "missing_return"]
    liq = spark.createDataFrame([("A", 4.0, 1.0), ("B", 4.0, 1.0)], "asset string, adv double, volatility double")
    hit = replay.replay_with_impact(t.withColumn("t", F.timestamp_seconds("t")), r.withColumn("t", F.timestamp_seconds("t")), liq, ["k"], 0.0, 0.1, 1.0).orderBy("t").collect()
    assert [round(x["cost"], 9) for x in hit[:2]] == [0.0, 0.1]  # two trades of 1: 0.1 * 1 / sqrt(4) each


def test_overfitting_golden(spark):
    block = [(0.02, -0.01), (-0.01, 0.02)]
    data = [(1, s, i, (0.02 if (i // 4 + k) % 2 else -0.01) + 0.001 * (i % 2)) for k, s in enumerate("xy") for i in range(16)]
    df = spark.createDataFrame(data, "k int, strategy string, row int, ret double")
    assert replay.backtest_overfitting_probability(df, 4, ["k"]).first()["splits"] == 6 and block
    best = spark.createDataFrame([(1, s, i, (0.05 if s == "x" else -0.05) + 0.001 * (i % 3)) for s in "xy" for i in range(16)], "k int, strategy string, row int, ret double")
    assert replay.backtest_overfitting_probability(best, 4, ["k"]).first()["probability"] == 0.0


def test_capacity_ties_and_calibration(spark):
    w = spark.createDataFrame([(1, "B", 0.5, 100.0), (1, "A", 0.5, 100.0), (1, "C", 0.0, 1.0)], "k int, asset string, weight double, adv double")
    got = costs.capacity(w, ["k"], 0.1, 1.0).first()
    assert (got["capacity"], got["binding_asset"]) == (20.0, "A")
    t = datetime(2024, 1, 1)
    o = spark.createDataFrame([(1, 100.0 * i, 1e4, 0.02, 0.001 + 0.2 * 0.02 * math.sqrt(100.0 * i / 1e4), p) for i, p in ((1, "training"), (2, "training"), (3, "training"), (4, "holdout"))], "k int, notional_base double, adv_base double, daily_volatility double, signed_adverse_rate double, part string")
    fit = costs.calibrate_costs(o, ["k"]).first()
    assert abs(fit["intercept"] - 0.001) < 1e-12 and abs(fit["coefficient"] - 0.2) < 1e-9 and fit["mae_bps"] < 1e-8 and t
    assert costs.calibrate_costs(o.where("notional_base < 250"), ["k"]).first()["status"] == "too_few_orders"


def test_orders_and_statement(spark):
    want = spark.createDataFrame([(1, "X", 2.0), (1, "Y", 1.0)], "k int, instrument_id string, quantity double")
    have = spark.createDataFrame([(1, "X", -1.0), (1, "Y", 1.0)], "k int, instrument_id string, quantity double")
    assert rows(ledger.order_intents(want, have, ["k"]), "leg", "side", "quantity", "reduce_only") == [("close", "buy", 1.0, True), ("open", "buy", 2.0, False)]
    dec = "decimal(18,8)"
    at = datetime(2024, 1, 2)
    df = lambda data, schema: spark.createDataFrame(data, schema)
    cast = lambda d, *cs: d.select(*[F.col(c).cast(dec).alias(c) if c in cs else F.col(c) for c in d.columns])
    opening = cast(df([("a", "S", 100.0)], "account_id string, symbol string, quantity double"), "quantity")
    flows = cast(df([("a", 500.0, at)], "account_id string, amount double, at timestamp"), "amount")
    trades = cast(df([("a", "t1", "S", "sell", 100.0, 11.0, 5.0, at)], "account_id string, trade_id string, symbol string, side string, quantity double, price double, fee double, at timestamp"), "quantity", "price", "fee")
    prices = cast(df([("S", 11.0)], "symbol string, price double"), "price")
    for closing_cash, status in ((2595.0, "reconciled"), (2600.0, "blocked")):
        accounts = cast(df([("a", datetime(2024, 1, 1), datetime(2024, 1, 3), 1000.0, closing_cash)], "account_id string, opening_at timestamp, closing_at timestamp, opening_cash double, closing_cash double"), "opening_cash", "closing_cash")
        got = ledger.reconcile_accounts(opening, flows, trades, opening.where("1 = 0"), prices, accounts)[0].first()
        assert float(got["cash"]) == 2595.0 and got["status"] == status


def test_trade_proposals_golden(spark):
    book = lambda q: spark.createDataFrame([("a", "S", True, 0.25, q, q, 10.0)], "account_id string, symbol string, managed boolean, weight double, quantity double, available double, price double")
    acc = lambda cash: spark.createDataFrame([("a", 100000.0, cash, "paper_ready", datetime(2030, 1, 1))], "account_id string, nav double, cash double, status string, valid_until timestamp")
    buy = ledger.trade_proposals(book(0.0), acc(100000.0), now="2024-01-01")[0].first()
    assert (buy["side"], buy["quantity"]) == ("buy", 2400.0)
    sell = ledger.trade_proposals(book(4000.0), acc(60000.0), now="2024-01-01")[0].first()
    assert (sell["side"], sell["quantity"], round(sell["execution_price"], 2), round(sell["fee"], 4)) == ("sell", 1500.0, 9.99, 12.4925)


def test_publishing_summary(spark):
    d = spark.createDataFrame([(1, 1, True, "ok"), (1, 2, False, "timeout"), (1, 3, False, "infeasible"), (1, 4, True, "ok")], "k int, at int, published boolean, status string")
    got = audit.publishing_summary(d, ["k"], ["at"]).first()
    assert (got["rate"], got["longest_gap"]) == (0.5, 2)


def test_reports_are_not_overwritten(spark, tmp_path):
    df = spark.range(3)
    sinks.publish_json(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.publish_json(df, str(tmp_path / "r"))
    sinks.write_artifacts(df, str(tmp_path / "a"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 3


def test_study_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"study_id": "x", "observations": [{"sleeve": "a", "net_return": 0.1}], "markets": [{"observation_id": "1", "prices": {"A": 1.0, "B": 2.0}, "fx": {"EUR": 1.1}}]}')
    t = readers.read_study_json(spark, str(tmp_path / "s.json"))
    assert (t["observations"].count(), t["marks"].count(), t["fx"].count(), t["periods"].count()) == (1, 2, 1, 0)


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, x string")
    assert rows(checks.digest_rows(df, ["x"], ["k"]), "k", "digest") == rows(checks.digest_rows(df.repartition(3, "x"), ["x"], ["k"]), "k", "digest")


def test_residuals_of_tracking_and_spent_turnover(spark):
    w = spark.createDataFrame([(1, "A", 0.6, 0.5, 0.0, 1.0), (1, "B", 0.4, 0.5, 0.0, 1.0)], "k int, asset string, weight double, current double, lower double, upper double")
    limits = spark.createDataFrame([(1, 1.0, 0.3, 0.25, 0.05)], "k int, invested double, max_turnover double, turnover_offset double, max_tracking_error double")
    te = spark.createDataFrame([(1, 0.08)], "k int, tracking_error double")
    got = {r["constraint"]: (round(r["residual"], 9), r["ok"]) for r in audit.constraint_residuals(w, limits, ["k"], tracking=te).collect()}
    assert got["turnover"] == (0.15, False) and got["tracking_error"] == (0.03, False) and got["budget"] == (0.0, True)


def test_bounds_move_with_the_benchmark(spark):
    x = spark.createDataFrame([("A", "f", 2.0), ("B", "f", 1.0)], "asset string, factor string, x double")
    b = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], "k int, asset string, weight double")
    bounds = spark.createDataFrame([(1, "f", -0.1, 0.1), (1, "g", -1.0, 1.0)], "k int, factor string, lo double, hi double")
    assert rows(exposure.shifted_factor_bounds(bounds, b, x, ["k"]), "factor", "lo", "hi") == [("f", 1.4, 1.6), ("g", -1.0, 1.0)]


def test_inverse_vol_within_a_cap(spark):
    r = [(1, a, t, s * (-1) ** t) for a, s in (("A", 0.01), ("B", 0.02), ("C", 0.04)) for t in range(6)]
    df = spark.createDataFrame(r, "k int, asset string, t int, ret double")
    free = dict(rows(targets.inverse_vol_weights(df, ["k"]), "asset", "weight"))
    assert abs(free["A"] - 4 / 7) < 1e-9
    got = dict(rows(targets.inverse_vol_weights(df, ["k"], 1.0, 0.5), "asset", "weight"))
    assert abs(sum(got.values()) - 1) < 1e-9 and abs(got["A"] - 0.5) < 1e-9 and abs(got["B"] - got["C"] - (free["B"] - free["C"])) < 1e-9
    assert {r["status"] for r in targets.inverse_vol_weights(df, ["k"], 1.0, 0.3).collect()} == {"infeasible"}


def test_more_objectives(spark):
    c = spark.createDataFrame([(1, "A", 0.5), (1, "C", 0.5)], "p int, asset string, weight double")
    t = spark.createDataFrame([("A", 0.75), ("B", 0.25)], "asset string, weight double")
    assert abs(risk.target_distance_values(c, t, ["p"]).first()["value"] + 0.375) < 1e-12
    lin = spark.createDataFrame([("A", 1.0, 0.01, 0.02)], "asset string, held double, buy_rate double, sell_rate double")
    imp = spark.createDataFrame([("A", 0.1)], "asset string, coef double")
    want = 0.375 + 0.5 * 0.02 + 1.0 * 0.003 + 0.1 * 0.5**1.5
    assert abs(risk.target_distance_values(c, t, ["p"], lin, 0.003, imp).first()["value"] + want) < 1e-12
    pnl = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((1, -2, 3, -4, 5, -6, 2, 1, 0, -1))], "p int, scenario_no int, pnl double")
    got = dict(rows(risk.tail_values(pnl, ["p"], 0.8), "kind", "value"))
    assert abs(got["cvar"] + 5.0) < 1e-9 and -6.0 <= got["evar"] <= -5.0 and got["cdar"] < 0
    e = spark.createDataFrame([(1, 0.03, 0.01, 0.04), (2, 0.01, 0.02, 0.04), (3, 0.03, 0.01, 0.0)], "p int, mean double, benchmark_mean double, tracking_error double")
    assert rows(risk.excess_return_ratio(e), "p", "status") == [(1, "ok"), (2, "no_positive_excess_return"), (3, "undefined_ratio")]


def test_reconcile_reports_unknown_accounts_and_bad_available(spark):
    at = "timestamp'2024-01-02'"
    acc = spark.sql("SELECT 1 AS account_id, timestamp'2024-01-01' AS opening_at, timestamp'2024-02-01' AS closing_at, CAST(0 AS DECIMAL(18,8)) AS opening_cash, CAST(90 AS DECIMAL(28,8)) AS closing_cash")
    tr = spark.sql(f"SELECT a AS account_id, a AS trade_id, 'S' AS symbol, 'buy' AS side, CAST(1 AS DECIMAL(18,8)) AS quantity, CAST(10 AS DECIMAL(18,8)) AS price, CAST(0 AS DECIMAL(18,8)) AS fee, {at} AS at FROM VALUES (1), (2) AS v(a)")
    fl = spark.sql(f"SELECT 1 AS account_id, CAST(100 AS DECIMAL(18,8)) AS amount, {at} AS at")
    cl = spark.sql("SELECT 1 AS account_id, 'S' AS symbol, CAST(1 AS DECIMAL(18,8)) AS quantity, CAST(2 AS DECIMAL(18,8)) AS available")
    px = spark.sql("SELECT 'S' AS symbol, CAST(11 AS DECIMAL(18,8)) AS price")
    got = {r["account_id"]: (r["status"], r["reasons"]) for r in ledger.reconcile_accounts(cl.where("1 = 0"), fl, tr, cl, px, acc)[0].collect()}
    assert got == {1: ("blocked", "bad_available"), 2: ("blocked", "unknown_account")}


def test_nav_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nav,date,note\n1.5,2024-01-02,x\nabc,2024-01-03,y\n2,2024-01-02,z\n")
    (tmp_path / "b.csv").write_text("day,value\n2024-01-02T03:04:05Z,7\n")
    nav = readers.read_nav(spark, str(tmp_path / "a.csv"), "B")
    assert [r.nav for r in nav.collect()] == [1.5, None, 2.0]
    assert sorted(r.rule for r in readers.nav_checks(nav).collect()) == ["bad_nav", "repeated"]
    assert [(r.book, r.nav) for r in readers.read_nav(spark, str(tmp_path / "b.csv"), "C").collect()] == [("C", 7.0)]


def test_statement_files(spark, tmp_path):
    (tmp_path / "opening_positions.csv").write_text("\ufeffsymbol,quantity,average_cost,acquired_on\n000123,100,10,2024-01-01\n")
    (tmp_path / "trades.csv").write_text("fee,trade_id,symbol,side,quantity,price,event_time\n1,t1,000123,sell,40,12,2024-01-02T10:00:00+08:00\n1,t1,000123,sell,x,12,2024-01-02T10:00:00+08:00\n")
    (tmp_path / "cash_flows.csv").write_text("transfer_id,amount,event_time\nf1,5,2024-01-02T09:00:00+08:00\n")
    (tmp_path / "closing_positions.csv").write_text("symbol,quantity,available_quantity\n000123,60,60\n")
    (tmp_path / "prices.csv").write_text("symbol,venue,price,as_of\n000123,SZSE,12,2024-01-02T15:00:00+08:00\n")
    t = readers.read_statement(spark, str(tmp_path), "acc")
    assert [r.symbol for r in t["opening_positions"].collect()] == ["000123"]
    assert sorted((r.file, r.id, r.rule) for r in readers.statement_checks(t).collect()) == [("trades", "t1", "bad_quantity"), ("trades", "t1", "repeated")]
    accounts = spark.sql("SELECT 'acc' AS account_id, TIMESTAMP '2024-01-01 00:00:00' AS opening_at, TIMESTAMP '2024-01-02 07:00:00' AS closing_at, CAST(0 AS DECIMAL(18,8)) AS opening_cash, CAST(484 AS DECIMAL(28,8)) AS closing_cash")
    trades = t["trades"].where("quantity IS NOT NULL")
    got = ledger.reconcile_accounts(t["opening_positions"], t["cash_flows"], trades, t["closing_positions"], t["prices"].select("symbol", "price"), accounts)[0].collect()
    assert [(r.status, float(r.cash), float(r.nav)) for r in got] == [("reconciled", 484.0, 1204.0)]


def test_candle_files(spark, tmp_path):
    (tmp_path / "c.json").write_text("[[86400, 1, 3, 2, 2.5, 10], [172800, 1, 3, 2, 2, 20]]")
    c = readers.read_candles(spark, str(tmp_path / "c.json"), "P")
    (r,) = readers.candle_quality(c, "1970-01-02", "1970-01-05", ["product"]).collect()
    assert (r.bars, r.missing_days, r.invalid_bars, r.adv) == (2, 1, 0, 32.5)


def test_study_documents(spark, tmp_path):
    from portica.sources import studies

    (tmp_path / "cap").mkdir()
    (tmp_path / "cap" / "one.json").write_text('{"schema": "desk.capacity-study/v1", "capital": [1, 2], "impact_coefficients": [0.1], "holdings_weights": {"A": 0.5}, "trade_weights": {"A": 0.1, "B": 0.2}, "liquidity": [{"asset": "A", "adv_base": 7}]}')
    (tmp_path / "cap" / "two.json").write_text("not json")
    t = studies.read_capacity_json(spark, str(tmp_path / "cap"))
    assert {k: v.count() for k, v in t.items()} == {"studies": 2, "liquidity": 1, "holdings": 1, "trades": 2, "axes": 3}
    assert [(r.study_id, r.rule) for r in studies.document_checks(spark, str(tmp_path / "cap"), "capacity").collect()] == [("two", "unknown_schema")]
    (tmp_path / "o.json").write_text('{"orders": [{"order_id": "1", "notional_base": 10}]}')
    assert studies.read_calibration_json(spark, str(tmp_path / "o.json"))["orders"].count() == 1
    (tmp_path / "p.json").write_text('{"instruments": [{"instrument_id": "A", "price_tick": {"units": 5, "scale": 2}}], "owners": {"A": "s"}, "allocations": {"s": {"USD": "600"}}, "cost_policy": {"fee_per_unit": "1"}, "decisions": [{"decision_id": "d", "target_notional": "500.5"}], "cash_events": []}')
    p = studies.read_plan_json(spark, str(tmp_path / "p.json"))
    assert float(p["instruments"].first().price_tick) == 0.05 and float(p["decisions"].first().target_notional) == 500.5
    assert [(r.sleeve, r.currency, float(r.amount)) for r in p["allocations"].collect()] == [("s", "USD", 600.0)] and p["cash_events"].count() == 0
    (tmp_path / "m.json").write_text('{"observations": [{"observation_id": "o", "prices": {"A": "125", "B": "x"}, "fx": {}}]}')
    m = studies.read_market_json(spark, str(tmp_path / "m.json"))
    assert [r.price is None for r in m["marks"].orderBy("instrument_id").collect()] == [False, True] and m["fx"].count() == 0


def test_ledger_with_marks(spark):
    d = "CAST({} AS DECIMAL(18,8))".format
    events = spark.sql(f"SELECT 1 AS k, TIMESTAMP '2024-01-01 00:00:00' AS at, 0 AS sequence, CAST(NULL AS STRING) AS symbol, {d('NULL')} AS quantity, {d('NULL')} AS price, {d('NULL')} AS fee, {d(100)} AS flow UNION ALL SELECT 1, TIMESTAMP '2024-01-02 00:00:00', 5, 'A', {d(3)}, {d(10)}, {d(1)}, {d(0)}")
    marks = spark.sql(f"SELECT 1 AS k, TIMESTAMP '2024-01-02 00:00:00' AS at, 6 AS sequence, 'A' AS symbol, {d(10)} AS price UNION ALL SELECT 1, TIMESTAMP '2024-01-03 00:00:00', 1, 'A', {d(12.5)}")
    v = ledger.valued_ledger(events, marks, ["k"])
    assert [(None if r.nav is None else float(r.nav), r.unmarked) for r in v.orderBy("at", "sequence").collect()] == [(100.0, 0), (None, 1), (99.0, 0), (106.5, 0)]


def test_lots_audit_on_weights_after_fees(spark):
    lots = spark.createDataFrame([(1, "A", 0.5, 1000.0, 10.0, 10, 50, 50, 500.0, 0.0)], "k int, asset string, weight double, nav double, price double, lot int, quantity int, trade int, cash double, noncash double")
    (r,) = ledger.executable_audit(lots.withColumn("noncash", F.lit(500.0)), ["k"], 0.01, 0.6).collect()
    assert (r.status, r.nav_after, r.cash_after, round(r.shortfall, 9)) == ("negative_cash", 995.0, -5.0, 0.1)
    assert abs(r.distance - (0.5 - 500 / 995) ** 2) < 1e-12
    assert ledger.executable_audit(lots, ["k"], 0.01).first().status == "unbalanced"
    assert abs(ledger.executable_weights(lots, ["k"], 0.01).first().weight - 500 / 995) < 1e-12
