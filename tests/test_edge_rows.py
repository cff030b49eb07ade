"""Rows that report instead of jobs that fail, and plans that select and join without holding a key."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portica.operators import audit, costs, exposure, ledger, pit, prefix, replay, risk, targets


def test_total_loss_is_a_status(spark):
    targets = spark.createDataFrame([("p", t, "A", 1.0) for t in (1, 2, 3)] + [("q", 1, "B", 0.5)], "k string, t int, asset string, weight double")
    returns = spark.createDataFrame([("A", 1, -1.0), ("A", 2, 0.5), ("A", 3, 0.1), ("B", 1, 0.2)], "asset string, t int, ret double")
    got = {(r.k, r.t): r for r in replay.replay_schedule(targets, returns, ["k"]).collect()}
    assert [got["p", t].status for t in (1, 2, 3)] == ["ruined"] * 3 and [got["p", t].wealth for t in (1, 2, 3)] == [0.0] * 3
    assert got["q", 1].status == "ok" and math.isclose(got["q", 1].wealth, 1.1)
    assert got["p", 2].turnover == 1.0 and got["p", 3].turnover == 0.0  # nothing is held after the loss
    liquidity = spark.createDataFrame([("A", 0.1, 0.0), ("B", 0.1, 100.0)], "asset string, volatility double, adv double")
    m2 = {(r.k, r.t): r.wealth for r in replay.replay_with_impact(targets, returns, liquidity, ["k"], 0.0, 0.1, 1e6).collect()}
    assert m2["p", 3] == 0.0 and math.isclose(m2["q", 1], 1.1)


def test_impact_path_is_linear_in_dates(spark):
    n = 20_000
    targets = spark.range(n).selectExpr("'p' AS k", "CAST(id AS INT) AS t", "'A' AS asset", "CASE WHEN id % 2 = 0 THEN 0.5 ELSE 0.4 END AS weight")
    returns = spark.range(n).selectExpr("'A' AS asset", "CAST(id AS INT) AS t", "0.0001 * ((id % 5) - 2) AS ret")
    liquidity = spark.createDataFrame([("A", 0.01, 1e9)], "asset string, volatility double, adv double")
    rows = replay.replay_with_impact(targets, returns, liquidity, ["k"], 1e-6, 0.1, 1e4).orderBy("t").collect()
    assert len(rows) == n and all(math.isclose(b.wealth, a.wealth * (1 + b.net)) for a, b in zip(rows[:50], rows[1:51], strict=True))


def test_zero_nav_weights_and_prices(spark):
    budgets = exposure.book_budgets(spark.createDataFrame([(1, 10.0, 0.0, 1.0), (1, 20.0, 0.0, 1.0), (2, 5.0, 2.0, 0.5)], "k int, nav double, weight double, position_scale double"), ["k"])
    assert sorted((r.k, r.status, r.total_nav) for r in budgets.collect()) == [(1, "no_weight", None), (1, "no_weight", None), (2, "ok", 5.0)]
    schema = "k int, asset string, weight double, nav double, price double, lot int, current_qty int, max_buy int, max_sell int, cash double"
    rows = [(1, "A", 0.5, 0.0, 10.0, 10, 0, 0, 0, 0.0), (2, "A", 0.5, 1000.0, 0.0, 10, 5, 9, 9, 1000.0), (3, "A", 0.5, 1000.0, 10.0, 0, 5, 9, 9, 950.0), (4, "A", 0.5, 1000.0, 10.0, 10, 0, 90, 90, 1000.0)]
    lots = ledger.floor_to_lots(spark.createDataFrame(rows, schema), ["k"])
    assert sorted((r.k, r.trade, r.quantity, r.status) for r in lots.collect()) == [(1, 0, 0, "ok"), (2, 0, 5, "bad_price"), (3, 0, 5, "bad_lot"), (4, 50, 50, "ok")]
    assert {r.k: r.status for r in ledger.executable_audit(lots, ["k"], 0.0).collect()} == {1: "nonpositive_nav", 2: "ok", 3: "ok", 4: "ok"}
    assert {r.k: r.weight for r in ledger.executable_weights(lots, ["k"], 0.0).collect()}[1] is None
    asked = [(0.5, 100.0, 10.0, 0.0, 1.0, 1.0, 1.0), (0.5, 100.0, 10.0, 0.1, 1.0, 1.0, 0.0), (0.5, 0.0, 10.0, 0.1, 1.0, 1.0, 1.0), (0.5, 100.0, 0.01, 0.1, 1.0, 1.0, 1.0)]
    out = ledger.target_quantities(spark.createDataFrame(asked, "weight double, nav double, price double, tick double, multiplier double, fx double, step double"))
    assert [(r.status, r.quantity, r.realized_weight) for r in out.collect()] == [("bad_step", None, None), ("bad_step", None, None), ("ok", 0.0, None), ("zero_price", None, None)]


def test_no_volume_is_infinite_participation(spark):
    orders = spark.createDataFrame([(0.0, 0.0, 0.1), (5.0, 0.0, 0.1), (4.0, 16.0, 0.1)], "notional double, adv double, volatility double")
    assert [(r.participation, r.cost) for r in costs.impact_cost(orders, 1.0).collect()] == [(0.0, 0.0), (math.inf, math.inf), (0.25, 4.0 * (1.0 * 0.1 * 0.5))]
    trades = orders.selectExpr("notional AS d", "adv", "volatility", "1.0D AS nav")
    assert [r.drag for r in costs.impact_drag(trades, 1.0).collect()][:2] == [0.0, math.inf]
    target = spark.createDataFrame([(1, "A", 0.5, 0.0, 0.0, 0.1, 0.1, 0.0, 0.0, 0.0, "none"), (2, "A", 0.5, 0.5, 0.0, 0.1, 0.1, 0.0, 0.0, 0.0, "none")], "k int, instrument_id string, weight double, current double, linear_rate double, impact_coef double, volatility double, adv double, initial_margin double, maintenance_margin double, margin_mode string")
    accounts = spark.createDataFrame([(1, 100.0, 50.0), (2, 100.0, 50.0)], "k int, nav double, cash_value double")
    report, bindings = audit.cross_asset_report(target, accounts, {"participation": 0.1}, ["k"])
    assert {r.k: r.max_participation for r in report.collect()} == {1: math.inf, 2: 0.0} and [r.k for r in bindings.collect()] == [1]
    equity = spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0), (1, 3, 1.0)], "k int, t int, equity double")
    assert [r.drawdown for r in risk.wealth_drawdown(equity, ["k"]).orderBy("t").collect()] == [None, 0.0, -0.5]


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_order_statistics(spark, monkeypatch, accuracy):
    monkeypatch.setattr(risk, "ACCURACY", accuracy)
    rng = np.random.default_rng(4)
    data = {"normal": rng.standard_normal(3000), "tied": np.repeat([0.0, 1.0, 2.0], [2000, 3, 500]), "one": np.array([7.0]), "few": np.array([3.0, 1.0, 2.0]), "tail": np.exp(rng.standard_normal(2000) * 8)}
    losses = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("few", None)], "k string, loss double").repartition(5)
    for beta in (0.05, 0.5, 0.9, 0.999):
        got = {r.k: (r["var"], r.value) for r in risk.cvar(losses, ["k"], beta).collect()}
        for k, v in data.items():
            q = np.sort(v)[max(math.ceil(round(len(v) * beta, 9)), 1) - 1]
            assert got[k][0] == q and math.isclose(got[k][1], q + np.maximum(v - q, 0).mean() / (1 - beta), rel_tol=1e-9)
    text = risk.cvar(losses, ["k"], 0.9)._jdf.queryExecution().toString()
    assert "percentile_disc" not in text.lower() and "percentiledisc" not in text.lower()


def test_label_revisions_and_windows(spark):
    rng = random.Random(8)
    day = "date_add(DATE '2024-01-01', {})".format
    labels = [(rng.randint(0, 60), rng.choice("AB"), rng.randint(-1, 9), rng.randint(-1, 30), rng.choice([2, 2, 3]), rng.random()) for _ in range(300)]
    rows = spark.createDataFrame([(s, a, s + e, s + e + v, h, x) for s, a, e, v, h, x in labels], "s int, asset string, e int, v int, horizon_sessions int, ret double")
    rows = rows.selectExpr(f"{day('s')} AS signal_at", "asset", f"{day('e')} AS label_end", f"{day('v')} AS available_at", "horizon_sessions", "ret")
    decisions = spark.createDataFrame([(d,) for d in range(0, 110, 9)], "d int").selectExpr(f"{day('d')} AS decision_at")
    got = pit.mature_labels(rows, decisions, 2, bucket_days=13)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    listed = [r.asDict() for r in rows.collect()]
    want = set()
    for (d,) in decisions.collect():
        best = {}
        for r in listed:
            if r["horizon_sessions"] == 2 and r["signal_at"] < r["label_end"] <= r["available_at"] <= d:
                k = (r["signal_at"], r["asset"])
                if k not in best or (r["available_at"], r["label_end"]) >= (best[k]["available_at"], best[k]["label_end"]):
                    best[k] = r
        want |= {(d, *k, r["available_at"]) for k, r in best.items()}
    assert {(r.decision_at, r.signal_at, r.asset, r.available_at) for r in got.collect()} == want
    obs = [("s", n, p, p + rng.choice([1, 2, 7]), p + rng.randint(0, 25), v) for n in "XY" for p in range(0, 80, 2) for v in range(rng.choice([1, 1, 2, 3]))]
    o = spark.createDataFrame([(k, n, p, e, max(e, a) + 10 * v, v) for k, n, p, e, a, v in obs], "study string, sleeve string, s int, e int, a int, vintage int")
    o = o.selectExpr("study", "sleeve", f"{day('s')} AS start", f"{day('e')} AS `end`", f"{day('a')} AS available_at", "vintage")
    hist = pit.rolling_asof_history(o, decisions.selectExpr("'s' AS study", "decision_at"), 4, 2, 2)
    assert "NestedLoop" not in hist._jdf.queryExecution().executedPlan().toString()
    listed, want = [r.asDict() for r in o.collect()], set()
    for (d,) in decisions.collect():
        seen = {}
        for r in listed:
            if r["end"] <= d and r["available_at"] <= d:
                k = (r["start"], r["end"], r["sleeve"])
                seen[k] = max(seen.get(k, -1), r["vintage"])
        periods = sorted({k[:2] for k in seen if {(*k[:2], n) for n in "XY"} <= set(seen)}, reverse=True)[:4]
        want |= {(d, *p, n, seen[(*p, n)], len(periods)) for p in periods for n in "XY"}
    assert {(r.decision_at, r.start, r.end, r.sleeve, r.vintage, r.n_periods) for r in hist.collect()} == want


def plain_linkage(s):
    """Order of assets by merging the closest clusters, the first of equals, by looking at all pairs."""
    sd = np.sqrt(np.diag(s))
    dist = np.sqrt(np.clip((1 - s / np.outer(sd, sd)) / 2, 0, 1))
    clusters = {i: [i] for i in range(len(s))}
    while len(clusters) > 1:
        names = sorted(clusters)
        _, a, b = min((min(dist[p, q] for p in clusters[a] for q in clusters[b]), a, b) for k, a in enumerate(names) for b in names[k + 1 :])
        clusters[a] = clusters[a] + clusters.pop(b)
    return next(iter(clusters.values()))


def plain_parity(s):
    w, queue = np.ones(len(s)), [plain_linkage(s)]
    variance = lambda x: (lambda iv: iv @ s[np.ix_(x, x)] @ iv)((1 / np.diag(s)[x]) / (1 / np.diag(s)[x]).sum())
    while queue:
        x = queue.pop()
        if len(x) > 1:
            left, right = x[: len(x) // 2], x[len(x) // 2 :]
            vl, vr = variance(left), variance(right)
            w[left] *= vr / (vl + vr)
            w[right] *= vl / (vl + vr)
            queue += [left, right]
    return w


def test_hierarchical_parity_with_ties(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for k in range(12):
        n = int(rng.integers(1, 14))
        x = np.round(rng.standard_normal((n, 30)) + rng.standard_normal((1, 30)), 0 if k % 2 else 6)
        s = np.round(x @ x.T / 30, 1 if k % 3 == 0 else 9) + np.eye(n)
        want |= {(k, f"a{i:02d}"): v for i, v in enumerate(plain_parity(s))}
        rows += [(k, f"a{i:02d}", f"a{j:02d}", float(s[i, j])) for i in range(n) for j in range(i, n)]
    got = targets.hierarchical_risk_parity(spark.createDataFrame(rows, "k int, a string, b string, value double"), ["k"]).collect()
    assert len(got) == len(want) and all(math.isclose(r.weight, want[r.k, r.asset], rel_tol=1e-9) for r in got)


def test_way_from_assets_that_a_candidate_leaves(spark):
    cand = spark.createDataFrame([(1, "A", 1.0), (2, "B", 0.5), (2, "A", 0.5)], "p int, asset string, weight double")
    mu = spark.createDataFrame([("A", 0.0), ("B", 0.0)], "asset string, mu double")
    cov = spark.createDataFrame([("A", "A", 0.04), ("A", "B", 0.01), ("B", "B", 0.09)], "a string, b string, value double")
    current = spark.createDataFrame([("B", 0.5), ("C", 0.5)], "asset string, weight double")
    rates = spark.createDataFrame([("A", 0.01, 0.02), ("B", 0.03, 0.04), ("C", 0.05, 0.06)], "asset string, buy_rate double, sell_rate double")
    impact = spark.createDataFrame([("C", 2.0)], "asset string, coef double")
    bench = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "asset string, weight double")
    v = risk.objective_values(cand, mu, cov, ["p"], 2.0, 0.0, rates, current, bench, 0.1, impact).where("kind = 'mean_variance'")
    left = 0.5 * 0.06 + 0.5 * 0.1 + 2.0 * 0.5**1.5  # C is sold in both
    active = {1: 0.25 * (0.04 - 2 * 0.01 + 0.09), 2: 0.0}
    paid = {1: left + 1.0 * 0.11 + 0.5 * 0.14, 2: left + 0.5 * 0.11}
    assert all(math.isclose(r.value, -active[r.p] - paid[r.p]) for r in v.collect())


def test_look_through_in_decimals(spark):
    d, kind = "DATE '2024-01-01'", "decimal(20,10)"
    w = spark.sql(f"SELECT 1 AS k, DATE '2024-02-01' AS at, 'F' AS instrument_id, CAST('0.3' AS {kind}) AS weight")
    e = spark.sql(f"SELECT 'F' AS fund_id, {d} AS holding_date, {d} AS available_at, 'G' AS instrument_id, CAST('0.1' AS {kind}) AS weight UNION ALL SELECT 'G', {d}, {d}, 'S', CAST('0.7' AS {kind}) UNION ALL SELECT 'F', {d}, {d}, 'S', CAST('0.2' AS {kind})")
    exposures, totals = exposure.fund_look_through(w, e, ["k"])
    assert [(r.instrument_id, str(r.exposure), r.n_paths) for r in exposures.collect()] == [("S", "0.0810000000", 2)]
    assert [(str(r.known_weight), str(r.unknown_weight)) for r in totals.collect()] == [("0.0810000000", "0.2190000000")]


def test_running_sums_in_pieces(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), rng.randint(0, 400), i, rng.choice([None, 1.5, -2.0, 3.25])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, d int, seq int, v double").selectExpr("k", "date_add(DATE '2024-01-01', d) AS at", "d", "seq", "v").repartition(3)
    got = prefix.running_sums(df, ["k"], ["at", "seq"], {"total": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}, prefix.time_bucket(F.col("at"), 30))
    assert got.columns == ["k", "at", "d", "seq", "v", "total", "n"]
    want, sums = {}, {}
    for k, _, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total, n = sums.get(k, (0.0, 0))
        want[seq] = sums[k] = (total + (v or 0.0), n + 1)
    assert {r.seq: (r.total, r.n) for r in got.collect()} == want


def test_marks_of_events_in_one_piece(spark):
    """Fills that carry their mark, sorted in one task, end as fills and marks of their own do, sorted in pieces."""
    rng, d = random.Random(12), "CAST({} AS DECIMAL(18,8))".format
    rows = [(rng.choice([1, 2, None]), i, rng.randint(0, 300), rng.choice("AB"), rng.randint(-9, 9), rng.randint(1, 50)) for i in range(200)]
    fills = spark.createDataFrame(rows, "k int, i int, d int, symbol string, q int, p int").selectExpr("k", "CAST(DATE_ADD(DATE '2024-01-01', d) AS TIMESTAMP) AS at", "CAST(i * 2 + 1 AS BIGINT) AS sequence", "symbol", f"{d('q')} AS quantity", f"{d('p')} AS price", f"{d('1')} AS fee", f"{d('IF(i % 9 = 0, 500, 0)')} AS flow")
    marks = fills.select("k", "at", "sequence", "symbol", "price")
    whole = ledger.valued_ledger(fills.withColumn("mark", F.col("price")), None, ["k"], bucket_days=None)
    pieces = ledger.valued_ledger(fills.withColumn("sequence", F.col("sequence") - 1), marks, ["k"], bucket_days=30).where("sequence % 2 = 1")
    names = ["position", "mark", "cash", "fees", "flows", "value", "unmarked", "nav", "negative_cash", "short_position"]
    a, b = ({(r.k, r.at, r.sequence): tuple(float(r[c]) for c in names) for r in x.collect()} for x in (whole, pieces))
    assert len(a) == 200 and a == b
