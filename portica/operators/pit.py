"""Point-in-time selection, joins and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import check_rows
from ..functions.columns import age_days


def _latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def greatest_so_far(obs: DataFrame, asked: DataFrame, by: list[str], known: Column, value: Column, at: str) -> DataFrame:
    """(by.., at, found): for each asked (by.., at) the greatest `value` of the rows known by then.

    Both sides go through one sort for each key, so no observation meets more than its own key's rows once.
    """
    rows = obs.select(*by, known.cast("timestamp").alias("_known"), F.lit(0).alias("_asks"), F.lit(None).cast(asked.schema[at].dataType).alias(at), value.alias("_value"))
    both = rows.unionByName(asked.select(*by, F.col(at).cast("timestamp").alias("_known"), F.lit(1).alias("_asks"), at), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_known", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.max("_value").over(w)).where("_asks = 1").select(*by, at, "found")


def latest_as_of(obs: DataFrame, cutoffs: DataFrame, keys: list[str], max_age_days: float = 0.0) -> DataFrame:
    """(keys.., cutoff, obs_time, values.., age_days, status): the last observation at or before each cutoff.

    `cutoffs` has `cutoff` and any of `keys`. Status is ok, carried (older than the cutoff), stale (beyond
    the limit) or missing.
    """
    shared = [k for k in keys if k in cutoffs.columns]
    asked = cutoffs if shared == keys else obs.select(*keys).distinct().join(cutoffs, shared) if shared else obs.select(*keys).distinct().crossJoin(cutoffs)
    values = [c for c in obs.columns if c not in (*keys, "obs_time")]
    found = greatest_so_far(obs, asked.select(*keys, "cutoff").distinct(), keys, F.col("obs_time"), F.struct("obs_time", *values), "cutoff")
    age = age_days(F.col("cutoff"), F.col("obs_time"))
    out = found.select(*keys, "cutoff", "found.*").withColumn("age_days", age)
    status = F.when(F.col("obs_time").isNull(), "missing").when(F.col("age_days") > max_age_days, "stale").when(F.col("age_days") > 0, "carried").otherwise("ok")
    return out.withColumn("status", status)


def default_cutoff(obs: DataFrame) -> DataFrame:
    return obs.agg(F.max("obs_time").alias("cutoff"))


def match_snapshot(holdings: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """Holdings that carry the selected NAV's date, with a status for each (keys, cutoff, symbol).

    Status: ok, date_mismatch, late (not available at the cutoff), short (negative weight), repeated symbol,
    or overweight (weights of the snapshot above 1).
    """
    h = holdings.withColumnRenamed("obs_time", "held_at")
    j = latest.select(*keys, "cutoff", "obs_time").join(h, keys).where("held_at <= cutoff")
    j = _at_most(j, [*keys, "cutoff"], "held_at", "obs_time")
    one = Window.partitionBy(*keys, "cutoff", "symbol")
    all_ = Window.partitionBy(*keys, "cutoff")
    status = (
        F.when(F.col("held_at") != F.col("obs_time"), "date_mismatch")
        .when(F.col("available_at") > F.col("cutoff"), "late")
        .when(F.col("weight") < 0, "short")
        .when(F.count("*").over(one) > 1, "repeated")
        .when(F.sum("weight").over(all_) > 1 + 1e-12, "overweight")
        .otherwise("ok")
    )
    return j.select(*keys, "cutoff", "symbol", "weight", status.alias("status"))


def _at_most(df: DataFrame, by: list[str], col: str, limit: str) -> DataFrame:
    """Rows of the latest `col` not after `limit`."""
    w = Window.partitionBy(*by)
    return df.where(F.col(col) <= F.col(limit)).withColumn("_last", F.max(col).over(w)).where(F.col(col) == F.col("_last")).drop("_last")


def latest_scores_as_of(scores: DataFrame, cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., cutoff, obs_time, available_at, score): bitemporal, latest (obs_time, available_at) by key."""
    s = scores.withColumn("available_at", F.coalesce("available_at", "obs_time"))
    asked = s.select(*keys).distinct().crossJoin(cutoffs.select("cutoff").distinct())
    found = greatest_so_far(s, asked, keys, F.greatest("obs_time", "available_at"), F.struct("obs_time", "available_at", "score"), "cutoff")
    return found.where("found IS NOT NULL").select(*keys, "cutoff", "found.*")


def fx_base_returns(obs: DataFrame) -> DataFrame:
    """Base-currency returns with the cross term, and the instant from which all their parts are known."""
    base = (1 + F.col("net_return")) * (F.col("fx_end") / F.col("fx_start")) - 1
    return obs.withColumn("base_return", base).withColumn("available_at", F.greatest("known_at", "fx_start_known_at", "fx_end_known_at"))


def fx_checks(obs: DataFrame, show: list[str]) -> DataFrame:
    rules = {"period": ~(F.col("start") < F.col("end")), "early": F.col("known_at") < F.col("end"), "fx": ~((F.col("fx_start") > 0) & (F.col("fx_end") > 0))}
    return check_rows(obs, rules, show)


def visible_vintage(obs: DataFrame, as_of: Column, keys: list[str], before: Column | None = None) -> DataFrame:
    """The last vintage of each (keys, start, end) that is available at `as_of` (and ends by `before`)."""
    seen = obs.where(F.col("available_at") <= as_of)
    if before is not None:
        seen = seen.where(F.col("end") <= before)
    return _latest(seen, [*keys, "start", "end"], [F.col("vintage").desc()])


def align_complete_periods(obs: DataFrame, n_names: int, name: str = "sleeve", keys: list[str] | None = None) -> DataFrame:
    """Rows of the exact periods that all names have; nothing is filled."""
    by = [*(keys or []), "start", "end"]
    full = obs.groupBy(*by).agg(F.count_distinct(name).alias("_n")).where(F.col("_n") == n_names).drop("_n")
    return obs.join(full, by, "left_semi")


def coverage(obs: DataFrame, n_names: int, name: str = "sleeve", keys: list[str] | None = None) -> DataFrame:
    """Counts of periods: visible, complete, incomplete; and the latest input."""
    keys = keys or []
    per = obs.groupBy(*keys, "start", "end").agg(F.count_distinct(name).alias("n"), F.max("available_at").alias("a"))
    complete = F.sum(F.when(F.col("n") == n_names, 1).otherwise(0))
    return per.groupBy(*keys).agg(F.count("*").alias("visible"), complete.alias("complete"), (F.count("*") - complete).alias("incomplete"), F.max("a").alias("latest_input"))


def overlap_check(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Periods that start before the one before them has ended."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return obs.select(*keys, "start", "end").distinct().withColumn("previous_end", F.lag("end").over(w)).where("previous_end > start")


def _while_valid(rows: DataFrame, decisions: DataFrame, keys: list[str], bucket_days: int) -> DataFrame:
    """`rows` with each decision_at of their key from `_from` on and before `_until`, where that is not null.

    Both sides meet by buckets of time, so the join has equal keys; an interval costs a row for each bucket it reaches.
    """
    number = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bucket_days * 86_400_000_000))
    asked = decisions.select(*keys, "decision_at").distinct()
    last = asked.agg(F.max("decision_at")).scalar()
    dealt = rows.where((F.col("_from") <= last) & (F.col("_until").isNull() | (F.col("_from") < F.col("_until"))))
    dealt = dealt.withColumn("_bucket", F.explode(F.sequence(number(F.col("_from")), number(F.least(F.coalesce("_until", last), last)))))
    met = dealt.join(asked.withColumn("_bucket", number(F.col("decision_at"))), [*keys, "_bucket"])
    within = (F.col("decision_at") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("decision_at") < F.col("_until")))
    return met.where(within).drop("_bucket", "_from", "_until")


def rolling_asof_history(obs: DataFrame, decisions: DataFrame, lookback: int, min_obs: int, n_names: int, name: str = "sleeve", key: str = "study", max_span_days: int | None = None, bucket_days: int = 92) -> DataFrame:
    """(key, decision_at, sleeve, start, end, value.., n_periods, status): the window each decision could see.

    Everything ends and is available by the decision. A period is complete from the instant at which its last name is
    first known, and out of every window once `lookback` later ones are complete, so a decision meets little
    more than its window. `max_span_days` leaves out periods that start longer before the decision.
    """
    period = [key, "start", "end"]
    known = obs.groupBy(*period, name).agg(F.min("available_at").alias("_known"))
    full = known.groupBy(*period).agg(F.max("_known").alias("_known"), F.count("*").alias("_n")).where(F.col("_n") >= n_names)
    full = full.select(*period, F.greatest("end", "_known").alias("_from"))
    later = Window.partitionBy(key).orderBy("start", "end").rowsBetween(1, lookback)
    spans = full.withColumn("_until", F.when(F.count("*").over(later) == lookback, F.max("_from").over(later)))
    met = _while_valid(spans, decisions, [key], bucket_days)
    if max_span_days is not None:
        met = met.where(F.col("start") >= F.col("decision_at") - F.make_dt_interval(F.lit(max_span_days)))
    w = Window.partitionBy(key, "decision_at").orderBy(F.col("start").desc(), F.col("end").desc())
    all_ = Window.partitionBy(key, "decision_at")
    cut = met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= lookback).withColumn("n_periods", F.count("*").over(all_)).drop("_r")
    seen = cut.join(obs, period).where(F.col("available_at") <= F.col("decision_at"))
    rows = _latest(seen, [*period, "decision_at", name], [F.col("vintage").desc()])
    return rows.select(*obs.columns, "decision_at", "n_periods", F.when(F.col("n_periods") < min_obs, "too_few").otherwise("ok").alias("status"))


def mature_labels(labels: DataFrame, decisions: DataFrame, horizon: int, bucket_days: int = 31) -> DataFrame:
    """Labels that a decision may use: known, ended and signalled before it; last revision by (signal_at, asset).

    A revision holds from the instant at which it is known and ended to that of a later one, so each decision meets
    only the revision that it uses.
    """
    sane = labels.where((F.col("label_end") > F.col("signal_at")) & (F.col("available_at") >= F.col("label_end")) & (F.col("horizon_sessions") == horizon))
    later = Window.partitionBy("signal_at", "asset").orderBy("available_at", "label_end").rowsBetween(1, Window.unboundedFollowing)
    held = sane.withColumn("_from", F.greatest("available_at", "label_end"))
    return _while_valid(held.withColumn("_until", F.min("_from").over(later)), decisions, [], bucket_days).select("decision_at", *labels.columns)


def non_overlapping_periods(periods: DataFrame, lookback: int, keys: list[str]) -> DataFrame:
    """(keys.., signal_at, label_end): periods walked backwards, each ending by the start of the one kept before.

    `periods` has one row for each (keys, signal_at) with `label_end` and `n_ends` (different label ends); one
    with several ends is passed over. Periods of a decision are few, so they are folded in an array.
    """
    listed = periods.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("signal_at", "label_end", "n_ends")), asc=False).alias("all"))
    pick_type = "struct<next:timestamp,kept:array<struct<signal_at:timestamp,label_end:timestamp>>>"
    zero = F.struct(F.lit(None).cast("timestamp").alias("next"), F.array().cast("array<struct<signal_at:timestamp,label_end:timestamp>>").alias("kept")).cast(pick_type)

    def step(acc: Column, p: Column) -> Column:
        ok = (p["n_ends"] == 1) & (F.size(acc["kept"]) < lookback) & (acc["next"].isNull() | (p["label_end"] <= acc["next"]))
        more = F.concat(acc["kept"], F.array(F.struct(p["signal_at"].cast("timestamp").alias("signal_at"), p["label_end"].cast("timestamp").alias("label_end"))))
        return F.when(ok, F.struct(p["signal_at"].cast("timestamp").alias("next"), more.alias("kept")).cast(pick_type)).otherwise(acc)

    return listed.select(*keys, F.inline(F.aggregate("all", zero, step, lambda acc: acc["kept"])))


def pit_market_check(inputs: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., instrument_id, rule): prices, FX and ADV positive and known, instruments in force, holdings covered."""
    rules = {}
    for c in ("price", "fx", "adv"):
        rules[f"{c}:not_positive"] = ~(F.col(c) > 0)
        rules[f"{c}:not_available"] = F.col(f"{c}_available_at") > F.col("decision_at")
    rules["not_effective"] = ~((F.col("effective_from") <= F.col("decision_at")) & (F.coalesce("effective_to", "decision_at") >= F.col("decision_at")))
    rules["inverse"] = F.coalesce("inverse", F.lit(False))
    ids = [*keys, "instrument_id"]
    broken = check_rows(inputs, rules, ids)
    again = inputs.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").select(*ids, F.lit("repeated").alias("rule"))
    missing = held.where("quantity <> 0").join(inputs, ids, "left_anti").select(*ids, F.lit("no_input").alias("rule"))
    return broken.union(again).union(missing)


def risk_snapshot_as_of(risk: DataFrame, decisions: DataFrame, universe: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs, missing): the last risk input by (keys, decision_at, asset), and universe assets without one."""
    r = risk.where("estimated_at <= available_at")
    by = [*keys, "horizon", "asset"]
    wanted = r.select(*by).distinct().join(decisions.select(*keys, "horizon", "decision_at").distinct(), [*keys, "horizon"])
    order = ["available_at", "estimated_at"]
    found = greatest_so_far(r, wanted, by, F.col("available_at"), F.struct(*order, *[c for c in r.columns if c not in (*order, *by)]), "decision_at")
    inputs = found.where("found IS NOT NULL").select(*by, "decision_at", "found.*").select(*r.columns, "decision_at")
    asked = decisions.select(*keys, "decision_at").join(universe, keys)
    late = risk.select(*keys, "asset").distinct().withColumn("exists", F.lit(True))
    missing = asked.join(inputs.select(*keys, "decision_at", "asset"), [*keys, "decision_at", "asset"], "left_anti").join(late, [*keys, "asset"], "left")
    return inputs, missing.select(*keys, "decision_at", "asset", F.when(F.col("exists"), "not_available_yet").otherwise("never_estimated").alias("reason"))


def asset_union(candidates: DataFrame, current: DataFrame, benchmark: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., asset, current, benchmark, lower, upper): the union of three asset sets; non-candidates must go to 0."""
    ids = [*keys, "asset"]
    all_ = candidates.select(*ids).union(current.select(*ids)).union(benchmark.select(*ids)).distinct()
    c = candidates.select(*ids, F.lit(True).alias("is_candidate")).distinct()
    out = all_.join(c, ids, "left").join(current.select(*ids, F.col("weight").alias("current")), ids, "left")
    out = out.join(benchmark.select(*ids, F.col("weight").alias("benchmark")), ids, "left").join(bounds.select(*ids, F.col("lower").alias("_lo"), F.col("upper").alias("_hi")), ids, "left")
    return out.select(
        *ids,
        F.coalesce("current", F.lit(0.0)).alias("current"),
        F.coalesce("benchmark", F.lit(0.0)).alias("benchmark"),
        F.coalesce("_lo", F.lit(0.0)).alias("lower"),
        F.coalesce("_hi", F.when(F.col("is_candidate"), 1.0).otherwise(0.0)).alias("upper"),
    )


def cost_coverage(union: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., asset, buy_rate, sell_rate, status): rates must cover candidates and held names, others are free."""
    ids = [*keys, "asset"]
    j = union.join(rates, ids, "left")
    needed = (F.col("upper") > 0) | (F.col("current") != 0)
    status = F.when(F.col("buy_rate").isNotNull() & F.col("sell_rate").isNotNull(), "ok").when(needed, "missing").otherwise("free")
    return j.select(*ids, F.coalesce("buy_rate", F.lit(0.0)).alias("buy_rate"), F.coalesce("sell_rate", F.lit(0.0)).alias("sell_rate"), status.alias("status"))


def evaluation_periods_check(periods: DataFrame, realized: DataFrame, as_of: Column, n_names: int, keys: list[str]) -> DataFrame:
    """(keys.., start, end, rule): periods must touch, be mature, and be complete in the realised panel."""
    w = Window.partitionBy(*keys).orderBy("start")
    p = periods.withColumn("_prev", F.lag("end").over(w))
    rules = {
        "order": ~(F.col("start") < F.col("end")),
        "gap": F.col("_prev").isNotNull() & (F.coalesce("_prev", "start") != F.col("start")),
        "immature": ~((F.col("end") <= F.col("cash_known_at")) & (F.col("cash_known_at") <= as_of)),
    }
    ids = [*keys, "start", "end"]
    full = realized.groupBy(*ids).agg(F.count_distinct("sleeve").alias("n")).where(F.col("n") == n_names)
    return check_rows(p, rules, ids).union(periods.join(full, ids, "left_anti").select(*ids, F.lit("incomplete").alias("rule")))


def liquidity_snapshot_check(liquidity: DataFrame, holdings: DataFrame, trades: DataFrame, as_of: Column, max_age_days: float, keys: list[str]) -> DataFrame:
    """(keys.., asset, rule): liquidity known and fresh, and one universe in all three tables."""
    ids = [*keys, "asset"]
    rules = {"time": ~((F.col("observed_at") <= F.col("known_at")) & (F.col("known_at") <= as_of)), "stale": age_days(as_of, F.col("observed_at")) > max_age_days, "adv": ~(F.col("adv_base") > 0)}
    mark = lambda df, name: df.select(*ids, F.lit(1).alias(name)).distinct()
    worlds = mark(liquidity, "l").join(mark(holdings, "h"), ids, "full_outer").join(mark(trades, "t"), ids, "full_outer")
    apart = worlds.where("l IS NULL OR h IS NULL OR t IS NULL").select(*ids, F.lit("universe").alias("rule"))
    return check_rows(liquidity, rules, ids).union(apart)


def horizon_scenarios(returns: DataFrame, horizon: int, min_observations: int, keys: list[str]) -> DataFrame:
    """(keys.., asset, scenario_no, ret, n_scenarios, status): blocks counted back from the last row, compounded."""
    w = Window.partitionBy(*keys, "asset").orderBy(F.col("t").desc())
    b = returns.withColumn("_b", F.floor((F.row_number().over(w) - 1) / horizon))
    blocks = b.groupBy(*keys, "asset", "_b").agg(F.count("*").alias("_n"), (F.product(1 + F.col("ret")) - 1).alias("ret")).where(F.col("_n") == horizon)
    every = Window.partitionBy(*keys, "asset")
    out = blocks.withColumn("n_scenarios", F.count("*").over(every))
    # The oldest block is scenario 0, so that scenarios run in time.
    return out.select(*keys, "asset", (F.col("n_scenarios") - 1 - F.col("_b")).cast("long").alias("scenario_no"), "ret", "n_scenarios", F.when(F.col("n_scenarios") < min_observations, "too_few").otherwise("ok").alias("status"))


def align_markets_to_events(events: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Events with the last price and FX known at (at, sequence); one sort for each key, no range join."""
    e = events.withColumn("price", F.lit(None).cast("double")).withColumn("fx", F.lit(None).cast("double")).withColumn("_event", F.lit(True))
    m = marks.select(*keys, "at", "sequence", "price", "fx").withColumn("_event", F.lit(False))
    both = e.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("at", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("price", "fx"):
        both = both.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return both.where("_event").drop("_event")
