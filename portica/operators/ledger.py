"""Orders, accounts, ledgers and revisions. Money and quantities are decimals or doubles as the tables have them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import check_rows
from ..functions.columns import ratio
from .prefix import running_sums, time_bucket


def toward_zero(x: Column, step: Column) -> Column:
    """Cut to whole steps; null where the step is not positive."""
    return F.signum(x) * F.floor(F.abs(x) / F.when(step > 0, step)) * step


def target_quantities(weights: DataFrame) -> DataFrame:
    """`weights(.., weight, nav, price, tick, multiplier, fx, step)` with unit value, quantity and realized weight.

    The price is floored to its tick and the quantity cut toward zero to its step; a price that rounds to zero is
    an error status, as is a tick or step that is not positive.
    """
    out = weights.withColumn("rounded_price", F.floor(F.col("price") / F.when(F.col("tick") > 0, F.col("tick"))) * F.col("tick"))
    out = out.withColumn("unit", F.col("rounded_price") * F.col("multiplier") * F.col("fx"))
    ok = F.col("unit") > 0
    quantity = F.when(ok, toward_zero(F.col("weight") * F.col("nav") / F.when(ok, F.col("unit")), F.col("step")))
    out = out.withColumn("quantity", quantity).withColumn("realized_weight", ratio(quantity * F.col("unit"), F.col("nav")))
    bad = F.when(F.coalesce(F.least("tick", "step"), F.lit(0)) <= 0, "bad_step")
    return out.withColumn("status", bad.when(ok, "ok").otherwise("zero_price"))


def order_intents(targets: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., instrument_id, leg, side, quantity, reduce_only, intent_id): deltas, a crossing split into close and open."""
    ids = [*keys, "instrument_id"]
    j = targets.select(*ids, F.col("quantity").alias("want")).join(positions.select(*ids, F.col("quantity").alias("have")), ids, "full_outer")
    want, have = F.coalesce("want", F.lit(0.0)), F.coalesce("have", F.lit(0.0))
    crossing = want * have < 0
    leg = lambda name, q, reduce: F.struct(F.lit(name).alias("leg"), q.alias("q"), reduce.alias("reduce_only"))
    one = leg("single", want - have, (F.abs(want) < F.abs(have)) & (want * have >= 0))
    legs = F.when(crossing, F.array(leg("close", -have, F.lit(True)), leg("open", want, F.lit(False)))).otherwise(F.array(one))
    flat = j.select(*ids, F.inline(legs)).where("q <> 0")
    out = flat.withColumn("side", F.when(F.col("q") > 0, "buy").otherwise("sell")).withColumn("quantity", F.abs("q"))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in ids], "leg", "side", F.format_string("%.8f", "quantity"))
    return out.select(*ids, "leg", "side", "quantity", "reduce_only", F.sha2(name, 256).alias("intent_id"))


def floor_to_lots(weights: DataFrame, keys: list[str]) -> DataFrame:
    """`weights(keys.., asset, weight, nav, price, lot, current_qty, max_buy, max_sell)` with quantity and residual cash.

    Trades are whole lots from the current quantity; where the target is zero, an odd remainder may be sold whole.
    Status bad_price or bad_lot: not positive, so there is no trade and the quantity stays.
    """
    price, lot = F.when(F.col("price") > 0, F.col("price")), F.when(F.col("lot") > 0, F.col("lot"))
    want = F.floor(F.col("weight") * F.col("nav") / price)
    gap = want - F.col("current_qty")
    trade = F.when(gap >= 0, F.floor(F.least(gap, F.col("max_buy")) / lot) * lot)
    sell = F.least(-gap, F.col("max_sell"))
    whole = (F.col("weight") == 0) & (F.col("max_sell") >= F.col("current_qty"))
    trade = trade.when(gap < 0, F.when(whole, -F.col("current_qty")).otherwise(-F.floor(sell / lot) * lot))
    status = F.when(price.isNull(), "bad_price").when(lot.isNull(), "bad_lot").otherwise("ok")
    trade = F.coalesce(F.when(price.isNotNull() & lot.isNotNull(), trade), F.lit(0))
    out = weights.withColumn("trade", trade.cast("long")).withColumn("quantity", (F.col("current_qty") + trade).cast("long")).withColumn("status", status)
    held = F.sum(F.col("quantity") * F.col("price")).over(Window.partitionBy(*keys))
    return out.withColumn("residual_cash", F.col("nav") - held)


def executable_weights(lots: DataFrame, keys: list[str], fee_rate: float) -> DataFrame:
    """(keys.., asset, weight): what the quantities of `lots` weigh on the NAV after fees, for constraint_residuals; null where that is 0."""
    fees = F.sum(F.abs("trade") * F.col("price") * fee_rate).over(Window.partitionBy(*keys))
    return lots.select(*keys, "asset", ratio(F.col("quantity") * F.col("price"), F.col("nav") - fees).alias("weight"))


def executable_audit(lots: DataFrame, keys: list[str], fee_rate: float, invested_cap: float = 1.0) -> DataFrame:
    """(keys.., nav_after, cash_after, invested, noncash, cost, distance, shortfall, illegal_moves, status) of `lots`.

    `lots` come from floor_to_lots, with `cash` and, if the account has other assets, their `noncash` value. Cash,
    holdings and other assets must make up the NAV less costs. `distance` is squared, on weights after fees;
    `shortfall` is what of the cap stays uninvested.
    """
    fee = F.abs("trade") * F.col("price") * fee_rate
    legal = (F.col("trade") == 0) | (F.col("quantity") == 0) | F.coalesce(F.col("trade") % F.when(F.col("lot") > 0, F.col("lot")) == 0, F.lit(False))
    held = F.col("quantity") * F.col("price")
    noncash = F.col("noncash") if "noncash" in lots.columns else F.lit(0.0)
    g = lots.groupBy(*keys).agg(
        F.max("nav").alias("nav"),
        F.max(noncash).alias("noncash"),
        (F.max("cash") - F.sum(F.col("trade") * F.col("price")) - F.sum(fee)).alias("cash_after"),
        F.sum(held).alias("invested"),
        F.sum(fee).alias("cost"),
        F.sum(F.col("weight") * F.col("weight")).alias("_ww"),
        F.sum(F.col("weight") * held).alias("_wh"),
        F.sum(held * held).alias("_hh"),
        F.sum(F.when(legal, 0).otherwise(1)).alias("illegal_moves"),
    )
    g = g.withColumn("nav_after", F.col("nav") - F.col("cost")).withColumn("shortfall", invested_cap - ratio(F.col("invested"), F.col("nav")))
    g = g.withColumn("distance", F.col("_ww") - 2 * ratio(F.col("_wh"), F.col("nav_after")) + ratio(ratio(F.col("_hh"), F.col("nav_after")), F.col("nav_after")))
    gap = F.abs(F.col("cash_after") + F.col("invested") + F.col("noncash") - F.col("nav_after"))
    status = (
        F.when(F.col("nav_after") <= 0, "nonpositive_nav").when(gap > F.col("nav") * 1e-9, "unbalanced").when(F.col("illegal_moves") > 0, "illegal_move")
        .when(F.col("cash_after") < 0, "negative_cash").when(F.col("shortfall") < -1e-7, "over_invested").otherwise("ok")
    )
    return g.withColumn("status", status).drop("_ww", "_wh", "_hh")


def reconcile_accounts(opening: DataFrame, flows: DataFrame, trades: DataFrame, closing: DataFrame, prices: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts, positions): every account's closing cash and quantities from its statement, compared exactly.

    `accounts(account_id, opening_at, closing_at, opening_cash, closing_cash)`, `opening/closing(account_id, symbol,
    quantity)`, `flows(account_id, amount, at)`, `trades(account_id, trade_id, symbol, side, quantity, price, fee,
    at)`, `prices(symbol, price)`; decimals. Blocked accounts carry their reasons. `closing` may have `available`,
    which must lie between zero and the quantity. Accounts of trades or flows that have no statement are blocked
    as `unknown_account`.
    """
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    money = trades.select("account_id", (-sign * F.col("quantity") * F.col("price") - F.col("fee")).cast("decimal(28,8)").alias("amount"), "at", F.col("fee") < 0)
    money = money.toDF("account_id", "amount", "at", "bad").union(flows.select("account_id", F.col("amount").cast("decimal(28,8)"), "at", F.lit(False)))
    j = money.join(accounts.select("account_id", "opening_at", "closing_at"), "account_id")
    outside = (F.col("at") <= F.col("opening_at")) | (F.col("at") > F.col("closing_at"))
    moved = j.groupBy("account_id").agg(F.sum("amount").alias("moved"), F.sum(F.when(outside, 1).otherwise(0)).alias("outside"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("negative_fees"))
    again = trades.groupBy("account_id", "trade_id").agg(F.count("*").alias("n")).where("n > 1").groupBy("account_id").agg(F.count("*").alias("duplicates"))
    q = opening.select("account_id", "symbol", F.col("quantity").cast("decimal(28,8)").alias("q")).union(trades.select("account_id", "symbol", (sign * F.col("quantity")).cast("decimal(28,8)")))
    computed = q.groupBy("account_id", "symbol").agg(F.sum("q").alias("computed"))
    stated = closing.groupBy("account_id", "symbol").agg(F.sum(F.col("quantity").cast("decimal(28,8)")).alias("stated"))
    zero = F.lit(0).cast("decimal(28,8)")
    positions = computed.join(stated, ["account_id", "symbol"], "full_outer").select("account_id", "symbol", F.coalesce("computed", zero).alias("computed"), F.coalesce("stated", zero).alias("stated"))
    positions = positions.join(prices, "symbol", "left").withColumn("match", F.col("computed") == F.col("stated"))
    per = positions.groupBy("account_id").agg(F.sum(F.when(F.col("match"), 0).otherwise(1)).alias("mismatches"), F.sum((F.col("computed") * F.col("price")).cast("decimal(28,8)")).alias("value"))
    a = accounts.join(moved, "account_id", "left").join(again, "account_id", "left").join(per, "account_id", "left")
    wrong = ~F.col("available").between(0, F.col("quantity")) if "available" in closing.columns else F.lit(False)
    a = a.join(closing.where(wrong).groupBy("account_id").agg(F.count("*").alias("unavailable")), "account_id", "left")
    a = a.withColumn("cash", (F.col("opening_cash") + F.coalesce("moved", zero)).cast("decimal(28,8)")).withColumn("nav", (F.col("cash") + F.coalesce("value", zero)).cast("decimal(28,8)"))
    n = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.filter(
        F.array(
            F.when(F.col("cash") != F.col("closing_cash"), "cash"), F.when(n("mismatches") > 0, "positions"), F.when(n("outside") > 0, "events_outside_period"),
            F.when(n("negative_fees") > 0, "negative_fee"), F.when(n("duplicates") > 0, "duplicate_trade"), F.when(n("unavailable") > 0, "bad_available"),
        ), lambda x: x.isNotNull(),
    )
    a = a.withColumn("reasons", F.array_join(reasons, ",")).withColumn("status", F.when(F.col("reasons") == "", "reconciled").otherwise("blocked"))
    strangers = trades.select("account_id").union(flows.select("account_id")).distinct().join(accounts, "account_id", "left_anti")
    none = F.lit(None).cast("decimal(28,8)")
    unknown = strangers.select("account_id", none.alias("cash"), none.alias("nav"), F.lit("blocked").alias("status"), F.lit("unknown_account").alias("reasons"))
    return a.select("account_id", "cash", "nav", "status", "reasons").union(unknown), positions


def trade_proposals(
    book: DataFrame, accounts: DataFrame, commission: float = 0.0003, min_commission: float = 5.0, stamp_tax: float = 0.0005, slippage: float = 0.001,
    max_weight: float = 0.30, cash_buffer: float = 0.05, now: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trades, accounts): lot trades toward decision weights, and the reasons that hold an account's trades back.

    `book(account_id, symbol, managed, weight, quantity, available, price)`; `accounts(account_id, nav, cash, status,
    valid_until)`. Prices slip to the cent against the trader; buys are the lots that their gap affords with fees;
    sells round up to lots; proceeds of sells are not spent. A symbol without a weight is not traded. Any reason
    leaves an account without trades.
    """
    j = book.join(accounts, "account_id")
    gap = F.round(F.col("nav") * F.col("weight") - F.col("quantity") * F.col("price"), 8)
    j = j.withColumn("gap", F.when(F.col("managed"), gap)).withColumn("buying", F.col("gap") > 0)
    cents = F.round(F.col("price") * 100 * F.when(F.col("buying"), 1 + slippage).otherwise(1 - slippage), 6)
    j = j.withColumn("execution_price", F.when(F.col("buying"), F.ceil(cents)).otherwise(F.floor(cents)) / 100)
    hundred = F.col("execution_price") * 100
    lots = F.greatest(F.lit(0.0), F.least(F.floor(ratio(F.col("gap") - min_commission, hundred)), F.floor(ratio(F.col("gap"), hundred * (1 + commission)))))
    sold = F.ceil(F.round(ratio(-F.col("gap"), F.col("price")) / 100, 9)) * 100
    j = j.withColumn("delta", F.when(F.coalesce(F.col("gap"), F.lit(0.0)) == 0, 0.0).when(F.col("buying"), lots * 100).otherwise(-sold).cast("double"))
    odd = (F.col("delta") < 0) & (-F.col("delta") > F.col("quantity"))
    short = (F.col("delta") < 0) & ~odd & (-F.col("delta") > F.col("available"))
    j = j.withColumn("why", F.when(odd, F.concat(F.lit("odd_lot_liquidation_requires_manual_review:"), "symbol")).when(short, F.concat(F.lit("insufficient_available_shares:"), "symbol"))).withColumn("delta", F.when(F.col("why").isNull(), F.col("delta")).otherwise(0.0))
    j = j.withColumn("notional", F.abs("delta") * F.col("execution_price"))
    fee = F.when(F.col("delta") != 0, F.greatest(F.lit(min_commission), F.col("notional") * commission) + F.when(F.col("delta") < 0, F.col("notional") * stamp_tax).otherwise(0.0)).otherwise(0.0)
    j = j.withColumn("fee", fee).withColumn("value_after", (F.col("quantity") + F.col("delta")) * F.col("price"))
    per = j.groupBy("account_id").agg(
        F.max("nav").alias("nav"), F.max("cash").alias("cash"), F.max("status").alias("status"), F.max("valid_until").alias("valid_until"),
        F.sum(F.when(F.col("delta") > 0, F.col("notional") + F.col("fee")).otherwise(0.0)).alias("buy_cash"),
        (F.max("nav") - F.sum(F.col("delta") * (F.col("execution_price") - F.col("price")) + F.col("fee"))).alias("nav_after"),
        (F.max("cash") - F.sum(F.col("delta") * F.col("execution_price") + F.col("fee"))).alias("cash_after"),
        F.max("value_after").alias("largest"), F.sum(F.when(F.col("delta") != 0, 1).otherwise(0)).alias("n_trades"), F.array_sort(F.collect_set("why")).alias("whys"),
        F.max(F.when(F.col("managed") & (F.col("weight") > max_weight), 1).otherwise(0)).alias("big_target"),
        F.max(F.when(~F.col("managed") & (F.col("quantity") * F.col("price") > F.col("nav") * max_weight), 1).otherwise(0)).alias("big_other"),
    )
    expired = F.col("valid_until") <= (F.current_timestamp() if now is None else F.lit(now).cast("timestamp"))
    reasons = F.concat(
        F.filter(
            F.array(
                F.when((F.col("status") != "paper_ready") | F.coalesce(expired, F.lit(True)), "decision_unavailable_or_expired"),
                F.when(F.col("big_other") == 1, "unmanaged_concentration_limit"),
                F.when(F.col("big_target") == 1, "target_concentration_limit"),
                F.when(F.col("buy_cash") > F.greatest(F.lit(0.0), F.col("cash") - F.col("nav") * cash_buffer), "insufficient_settled_cash_reconcile_sells_first"),
                F.when(F.col("nav_after") <= 0, "nonpositive_projected_nav"),
                F.when(F.col("largest") > F.col("nav_after") * max_weight, "projected_concentration_limit"),
                F.when((F.col("n_trades") > 0) & (F.col("cash_after") < F.col("nav_after") * cash_buffer), "projected_cash_buffer_limit"),
            ), lambda x: x.isNotNull(),
        ), "whys",
    )
    per = per.withColumn("reasons", F.array_join(reasons, ","))
    ok = per.where("reasons = ''").select("account_id")
    trades = j.where("delta <> 0").join(ok, "account_id", "left_semi")
    trades = trades.select("account_id", "symbol", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("quantity"), "execution_price", "fee")
    return trades, per.select("account_id", "n_trades", "buy_cash", "nav_after", "cash_after", "reasons")


def build_event_schedule(cash_events: DataFrame, fx: DataFrame, marks: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(schedule, checks): one log ordered by (at, sequence): cash from 0, FX then marks from 100, decisions from 1000.

    Inputs are (keys.., event_id, at, name, amount), marks and FX also (available_at), decisions also (signal_at).
    """
    def numbered(df: DataFrame, kind: str, base: int) -> DataFrame:
        w = Window.partitionBy(*keys, "at").orderBy("name", "event_id")
        for c in ("available_at", "signal_at"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("timestamp"))
        return df.select(*keys, "event_id", "at", "name", "amount", "available_at", "signal_at", F.lit(kind).alias("kind"), (F.row_number().over(w) - 1 + base).alias("sequence"))

    prices = fx.withColumn("name", F.concat(F.lit("0:"), "name")).withColumn("_k", F.lit("fx")).unionByName(marks.withColumn("name", F.concat(F.lit("1:"), "name")).withColumn("_k", F.lit("mark")), allowMissingColumns=True)
    market = numbered(prices, "market", 100).withColumn("kind", F.when(F.col("name").startswith("0:"), "fx").otherwise("mark")).withColumn("name", F.expr("substr(name, 3)"))
    log = numbered(cash_events, "cash", 0).union(market).union(numbered(decisions, "decision", 1000))
    rules = {"late_input": F.coalesce(F.col("available_at") > F.col("at"), F.lit(False)), "signal_not_before": F.coalesce(F.col("signal_at") >= F.col("at"), F.lit(False)), "too_many_events": (F.col("kind") == "cash") & (F.col("sequence") > 99) | F.col("kind").isin("fx", "mark") & (F.col("sequence") > 999)}
    broken = check_rows(log, rules, [*keys, "event_id"])
    again = log.groupBy(*keys, "event_id").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "event_id", F.lit("repeated_id").alias("rule"))
    return log, broken.union(again)


def running_ledger(events: DataFrame, keys: list[str], bucket_days: int | None = 366) -> DataFrame:
    """`events(keys.., at, sequence, symbol, quantity, price, fee, flow)` with position, cash, fees and flags after each.

    `quantity` is signed; `flow` is external cash. Cash and fees run over the account, the position over the symbol.
    Decimals stay decimals: products are cut to eight places before they are added. An account is sorted in pieces
    of `bucket_days`, or in one task if that is None, which suits events that lie by account.
    """
    out = _positions(events, keys, bucket_days)
    return _flagged(running_sums(out, keys, ["at", "sequence"], _account_sums(out), _bucket(bucket_days)))


def _bucket(days: int | None) -> Column | None:
    return None if days is None else time_bucket(F.col("at"), days)


def _positions(events: DataFrame, keys: list[str], bucket_days: int | None) -> DataFrame:
    return running_sums(events, [*keys, "symbol"], ["at", "sequence"], {"position": F.coalesce("quantity", F.lit(0))}, _bucket(bucket_days))


def _account_sums(events: DataFrame) -> dict[str, Column]:
    paid, money = F.col("quantity") * F.col("price"), _money(events)
    delta = money(F.coalesce("flow", F.lit(0))) - money(F.coalesce(paid, F.lit(0))) - money(F.coalesce("fee", F.lit(0)))
    return {"cash": money(delta), "fees": F.coalesce("fee", F.lit(0)), "flows": F.coalesce("flow", F.lit(0))}


def _flagged(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("negative_cash", F.col("cash") < 0).withColumn("short_position", F.col("position") < 0)


def _money(events: DataFrame):
    exact = dict(events.dtypes)["quantity"].startswith("decimal")
    return lambda c: c.cast("decimal(28,8)") if exact else c


def valued_ledger(events: DataFrame, marks: DataFrame | None, keys: list[str], bucket_days: int | None = 366) -> DataFrame:
    """running_ledger over `events` and `marks(keys.., at, sequence, symbol, price)`, with mark, value, unmarked and nav.

    Events may carry a `mark` of their own, which holds from the event on; then `marks` may be None. A position counts
    at the last mark of its symbol. Each row changes one symbol's value only, so the account's value is a running sum
    of such changes. `unmarked` positions have no mark yet; while there are any, NAV is null.
    """
    both = events if marks is None else events.unionByName(marks.select(*keys, "at", "sequence", "symbol", F.col("price").alias("mark")), allowMissingColumns=True)
    one = Window.partitionBy(*keys, "symbol").orderBy("at", "sequence")
    money = _money(events)
    position = F.col("position").cast("decimal(20,8)") if dict(events.dtypes)["quantity"].startswith("decimal") else F.col("position")
    out = _positions(both, keys, bucket_days).withColumn("mark", F.last("mark", True).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_value", money(F.coalesce(position * F.col("mark"), F.lit(0)))).withColumn("_open", F.when((F.col("position") != 0) & F.col("mark").isNull(), 1).otherwise(0))
    change = lambda part: F.col(part) - F.coalesce(F.lag(part).over(one), F.lit(0))
    out = out.withColumns({"_value_change": change("_value"), "_open_change": change("_open")})
    sums = _account_sums(out) | {"value": F.col("_value_change"), "unmarked": F.col("_open_change")}
    out = _flagged(running_sums(out, keys, ["at", "sequence"], sums, _bucket(bucket_days)))
    return out.withColumn("nav", F.when(F.col("unmarked") == 0, F.col("cash") + F.col("value"))).drop("_value", "_open", "_value_change", "_open_change")


def instant_returns(valued: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., at, ret, flow, nav) from `valued(keys.., at, sequence, nav, flow)`: event returns compounded by instant.

    External flows are taken out of the return of the event that brings them.
    """
    w = Window.partitionBy(*keys).orderBy("at", "sequence")
    before = F.lag("nav").over(w)
    v = valued.withColumn("_r", F.when(before > 0, (F.col("nav") - F.col("flow")) / before - 1).otherwise(0.0))
    return v.groupBy(*keys, "at").agg((F.product(1 + F.col("_r")) - 1).alias("ret"), F.sum("flow").alias("flow"), F.max_by("nav", "sequence").alias("nav"))


def decisions_to_orders(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """`decisions(keys.., instrument_id, at, notional, signal_price, price, multiplier, step, unit_fee)` with target, order and fee.

    What is held is the instrument's target before, so a lag is enough.
    """
    target = F.floor(ratio(ratio(F.col("notional"), F.col("signal_price") * F.col("multiplier")), F.col("step"))) * F.col("step")
    w = Window.partitionBy(*keys, "instrument_id").orderBy("at")
    out = decisions.withColumn("target", target.cast("double"))
    out = out.withColumn("order", F.col("target") - F.coalesce(F.lag("target").over(w), F.lit(0.0)))
    return out.withColumn("fee", F.abs("order") * F.col("unit_fee")).withColumn("cash_change", -F.col("order") * F.col("price") * F.col("multiplier") - F.col("fee"))


def revision_diff(old: DataFrame, new: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(ids.., column, old_value, new_value) for every value that differs between two versions, null-safe; text values."""
    o = old.select(*ids, *[F.col(v).cast("string").alias(f"o_{v}") for v in values], F.lit(True).alias("_o"))
    n = new.select(*ids, *[F.col(v).cast("string").alias(f"n_{v}") for v in values], F.lit(True).alias("_n"))
    j = o.join(n, ids, "full_outer")
    rows = F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"o_{v}").alias("old_value"), F.col(f"n_{v}").alias("new_value")) for v in values])
    return j.select(*ids, F.inline(rows)).where("NOT (old_value <=> new_value)")


def revision_study(old: DataFrame, new: DataFrame, plan: Callable[[DataFrame, list[str]], DataFrame], keys: list[str], ids: list[str], values: list[str]) -> DataFrame:
    """revision_diff of what `plan(input, keys)` makes of two versions of its input; one run, with `version` as a key.

    It tells how results depend on revised data; it replaces no decision of the past.
    """
    both = old.withColumn("version", F.lit("old")).unionByName(new.withColumn("version", F.lit("new")))
    out = plan(both, ["version", *keys])
    pick = lambda v: out.where(F.col("version") == v).drop("version")
    return revision_diff(pick("old"), pick("new"), ids, values)
