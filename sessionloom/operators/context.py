"""Named windows, gaps, history and causal alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6

from sessionloom.functions.scalars import direction, interaction_state, ratio, safe_divide

DAY_KEY = ["instrument_id", "trading_date"]


def context_instances(calendar: DataFrame, windows: Sequence[tuple]) -> DataFrame:
    """Every open target date x named window with its source session and clipped bounds."""
    spec = F.array(*[F.struct(
        F.lit(w[0]).alias("context_id"), F.lit(w[1]).alias("d0"), F.lit(w[2]).alias("c0"), F.lit(w[3]).alias("d1"),
        F.lit(w[4]).alias("c1"), F.lit(w[5]).alias("source_session")) for w in windows])
    targets = calendar.filter(F.col("open").isNotNull()).select(
        F.col("trading_date").alias("target_date"), "previous_session", F.inline(spec))
    targets = targets.withColumn(
        "source_date", F.when(F.col("source_session") == "TARGET", F.col("target_date")).otherwise(F.col("previous_session")))
    bounds = calendar.select(F.col("trading_date").alias("source_date"), F.unix_timestamp("open").alias("_open"),
                             F.unix_timestamp("close").alias("_close"))
    rows = targets.join(F.broadcast(bounds), "source_date", "left")
    day = F.unix_timestamp(F.col("source_date").cast("timestamp"))
    start, end = day + F.col("d0") * 86400 + F.col("c0"), day + F.col("d1") * 86400 + F.col("c1")
    low, high = F.greatest(start, F.col("_open")), F.least(end, F.col("_close"))
    scheduled = high > low
    return rows.select(
        "target_date", "source_date", "context_id", scheduled.alias("is_scheduled"),
        F.when(scheduled, low).otherwise(start).alias("_from"), F.when(scheduled, high).otherwise(end).alias("_until"),
        (~scheduled | (low != start) | (high != end)).alias("is_schedule_clipped"))


def grid_count(start: Column, end: Column, interval: int) -> Column:
    """Bars of the base grid that lie wholly inside [start, end)."""
    return F.greatest(F.floor(end / interval) - F.ceil(start / interval), F.lit(0))


def market_context(bars: DataFrame, calendar: DataFrame, windows: Sequence[tuple], interval: int) -> DataFrame:
    """One row per instrument, open target date and window: observed prices, or the first reason why not."""
    coverage = bars.groupBy("instrument_id").agg(
        F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"),
        F.unix_timestamp(F.min("bar_start")).alias("_cov0"), F.unix_timestamp(F.max("bar_end")).alias("_cov1"))
    dates = coverage.withColumn("target_date", F.explode(F.sequence("first_date", "last_date")))
    base = dates.join(F.broadcast(context_instances(calendar, windows)), "target_date")
    present = bars.groupBy("instrument_id", F.col("trading_date").alias("source_date")).agg(F.count(F.lit(1)).alias("_session_bars"))
    base = base.join(present, ["instrument_id", "source_date"], "left")
    rows = bars.select("instrument_id", F.col("trading_date").alias("source_date"), "contract", "bar_start", "bar_end", "open",
                       "high", "low", "close", F.unix_timestamp("bar_start").alias("_s"), F.unix_timestamp("bar_end").alias("_e"))
    keys = ["instrument_id", "target_date", "context_id"]
    inside = rows.join(F.broadcast(context_instances(calendar, windows).select("target_date", "source_date", "context_id", "is_scheduled", "_from", "_until")),
                       "source_date").filter((F.col("_s") >= F.col("_from")) & (F.col("_e") <= F.col("_until")) & F.col("is_scheduled"))
    seen = inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("contract").alias("_k0"), F.max("contract").alias("_k1"),
        F.min_by("open", "bar_end").alias("observed_open"), F.max("high").alias("observed_high"),
        F.min("low").alias("observed_low"), F.max_by("close", "bar_end").alias("observed_close"),
        F.min(F.struct((-F.col("high")).alias("v"), "bar_end")).alias("_hi"), F.min(F.struct("low", "bar_end")).alias("_lo"))
    out = base.join(seen, keys, "left")
    expected = F.when(F.col("is_scheduled"), grid_count(F.col("_from"), F.col("_until"), interval)).otherwise(0)
    observed = F.coalesce("_n", F.lit(0))
    reason = (
        F.when(F.col("source_date").isNull() | (F.col("_from") < F.col("_cov0")), "INSUFFICIENT_HISTORY")
        .when(F.col("_until") > F.col("_cov1"), "INSUFFICIENT_FUTURE_COVERAGE")
        .when(F.col("_session_bars").isNull(), "MISSING_EXPECTED_SESSION").when(~F.col("is_scheduled"), "NOT_SCHEDULED")
        .when(observed == 0, "NO_OBSERVATIONS").when(F.col("_k0") != F.col("_k1"), "MIXED_CONTRACT")
        .when(observed < expected, "INCOMPLETE_WINDOW"))
    return out.select(
        "instrument_id", "target_date", "source_date", "context_id", F.timestamp_seconds("_from").alias("window_start"),
        F.timestamp_seconds("_until").alias("available_at"),
        F.when(F.col("_k0") == F.col("_k1"), F.col("_k0")).alias("contract"),
        "observed_open", "observed_high", "observed_low", "observed_close", F.col("_hi.bar_end").alias("high_at"),
        F.col("_lo.bar_end").alias("low_at"), expected.cast("bigint").alias("expected_count"), observed.alias("observed_count"),
        (expected - observed).cast("bigint").alias("missing_count"), "is_schedule_clipped",
        reason.isNull().alias("is_available"), reason.alias("unavailable_reason"))


def valid_levels(context: DataFrame) -> DataFrame:
    """Available contexts only, with plain price names."""
    return context.filter("is_available").withColumnsRenamed(
        {f"observed_{c}": c for c in ("open", "high", "low", "close")}).drop("unavailable_reason", "is_available", "missing_count")


def window_summary(context: DataFrame) -> DataFrame:
    """Range, net move, direction and efficiency; null unless the window is complete."""
    full = (F.col("expected_count") > 0) & (F.col("observed_count") == F.col("expected_count"))
    only = lambda c: F.when(full, c)
    width = F.col("observed_high") - F.col("observed_low")
    net = F.col("observed_close") - F.col("observed_open")
    return context.select(
        "instrument_id", "target_date", "context_id", "available_at", full.alias("feature_available"), "expected_count", "observed_count",
        *[only(F.col(f"observed_{c}")).alias(c) for c in ("open", "high", "low", "close")],
        only(width).alias("range_ticks"), only(net).alias("net_ticks"),
        F.round(only(safe_divide(net, F.col("observed_open"))), 9).alias("net_pct"), only(direction(net)).alias("direction"),
        F.round(only(safe_divide(F.abs(net), width)), 9).alias("efficiency"),
        only(F.col("high_at")).alias("high_at"), only(F.col("low_at")).alias("low_at"),
        F.when(full, "").otherwise("INCOMPLETE_WINDOW").alias("missing_reason"))


def opening_context(levels: DataFrame) -> DataFrame:
    """Opening-range context: mid, direction, efficiency and close location."""
    width, net = F.col("or_high") - F.col("or_low"), F.col("or_close") - F.col("or_open")
    ok = F.col("valid")
    return levels.select(
        *DAY_KEY, "valid", "or_bars", "or_open", "or_high", "or_low", "or_close",
        F.when(ok, F.col("or_mid2") / 2.0).alias("or_mid"), F.when(ok, width).alias("or_width_ticks"),
        F.when(ok, net).alias("or_net_ticks"), F.when(ok, direction(net)).alias("or_direction"),
        F.round(F.when(ok, safe_divide(F.abs(net), width)), 9).alias("or_efficiency"),
        F.round(F.when(ok, safe_divide(F.col("or_close") - F.col("or_low"), width)), 9).alias("or_close_location"),
        F.col("or_end").alias("or_available_at"))


def previous_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per instrument and date: the previous expected session and the last session that has data."""
    present = bars.select("instrument_id", "trading_date").distinct()
    # one row per day and instrument
    order = Window.partitionBy("instrument_id").orderBy("trading_date")
    expected = calendar.select("trading_date", F.col("previous_session").alias("previous_expected"))
    return present.withColumn("previous_present", F.lag("trading_date").over(order)).join(
        F.broadcast(expected), "trading_date", "left").select(*DAY_KEY, "previous_expected", "previous_present")


def reopen_gap(bars: DataFrame, calendar: DataFrame, until_clock: int, interval: int) -> DataFrame:
    """Gap from the previous session's last bar to the reopening bar, and how far it was filled by a clock time."""
    bounds = calendar.filter(F.col("open").isNotNull()).select(
        "trading_date", "previous_session", F.unix_timestamp("open").alias("_open"), F.unix_timestamp("close").alias("_close"))
    slots = F.ceil(F.col("_open") / interval) * interval
    dim = F.broadcast(bounds.withColumn("_open", slots))
    until = F.unix_timestamp(F.col("trading_date").cast("timestamp")) + until_clock
    rows = bars.select(*DAY_KEY, "bar_end", "open", "high", "low", "close", F.unix_timestamp("bar_start").alias("_s"),
                       F.unix_timestamp("bar_end").alias("_e")).join(dim, "trading_date")
    early = F.col("_e") <= until
    # the last bar of a session is the one that starts last before the close
    final = F.col("_s") + interval >= F.col("_close")
    day = rows.groupBy(*DAY_KEY, "previous_session", "_open").agg(
        F.max(F.when(F.col("_s") == F.col("_open"), F.col("open"))).alias("reopen_ticks"),
        F.max(F.when(final, F.col("close"))).alias("final_close"),
        F.max(F.when(early, F.col("high"))).alias("_h"), F.min(F.when(early, F.col("low"))).alias("_l"),
        F.count_if(early).alias("observed_bars"))
    prior = day.select("instrument_id", F.col("trading_date").alias("previous_session"), F.col("final_close").alias("prior_close_ticks"))
    both = day.drop("final_close").join(prior, ["instrument_id", "previous_session"], "left")
    expected = F.floor((until - F.col("_open")) / interval)
    known = F.col("reopen_ticks").isNotNull() & F.col("prior_close_ticks").isNotNull()
    full = known & (F.col("observed_bars") == expected)
    gap = F.col("reopen_ticks") - F.col("prior_close_ticks")
    filled = F.when(gap > 0, F.col("_l") <= F.col("prior_close_ticks")).otherwise(F.col("_h") >= F.col("prior_close_ticks"))
    partial = F.when(gap > 0, F.col("_l") < F.col("reopen_ticks")).otherwise(F.col("_h") > F.col("reopen_ticks"))
    state = F.when(gap == 0, "NO_GAP").when(filled, "FILLED").when(partial, "PARTIAL").otherwise("OPEN")
    return both.select(
        *DAY_KEY, full.alias("feature_available"), F.when(full, F.col("prior_close_ticks")).alias("prior_close_ticks"),
        F.when(full, F.col("reopen_ticks")).alias("reopen_ticks"), F.when(full, gap).alias("gap_ticks"),
        F.when(full, direction(gap)).alias("gap_direction"), F.when(full, state).alias("fill_state"),
        F.when(~known, "MISSING_PRIOR_CLOSE_OR_REOPEN").when(~full, "INCOMPLETE_GAP_OBSERVATION_WINDOW").otherwise("").alias("missing_reason"))


def open_gap(bars: DataFrame, calendar: DataFrame, prior_clock: int, open_clock: int) -> DataFrame:
    """Gap from the previous session's close at one clock time to today's open at another."""
    clock = F.unix_timestamp("bar_start") - F.unix_timestamp(F.col("trading_date").cast("timestamp"))
    end_clock = F.unix_timestamp("bar_end") - F.unix_timestamp(F.col("trading_date").cast("timestamp"))
    day = bars.groupBy(*DAY_KEY).agg(F.max(F.when(clock == open_clock, F.col("open"))).alias("open_ticks"),
                                     F.max(F.when(end_clock == prior_clock, F.col("close"))).alias("_prior"))
    links = calendar.select("trading_date", "previous_session")
    prior = day.select("instrument_id", F.col("trading_date").alias("previous_session"), F.col("_prior").alias("prior_close_ticks"),
                       F.lit(True).alias("_has"))
    both = day.drop("_prior").join(F.broadcast(links), "trading_date").join(prior, ["instrument_id", "previous_session"], "left")
    gap = F.col("open_ticks") - F.col("prior_close_ticks")
    reason = (F.when(F.col("_has").isNull(), "NO_PRIOR_SESSION").when(F.col("prior_close_ticks").isNull(), "MISSING_PRIOR_CLOSE_BAR")
              .when(F.col("open_ticks").isNull(), "MISSING_CURRENT_OPEN_BAR").otherwise(""))
    return both.select(*DAY_KEY, "prior_close_ticks", "open_ticks", gap.alias("gap_ticks"), direction(gap).alias("gap_direction"),
                       F.round(safe_divide(gap, F.col("prior_close_ticks")), 9).alias("gap_pct"),
                       (reason == "").alias("feature_available"), reason.alias("missing_reason"))


def causal_history(daily: DataFrame, keys: Sequence[str], order: str, value: str, lookbacks: Sequence[int]) -> DataFrame:
    """Midrank percentile and population z-score against the previous k rows only (one row per day)."""
    out = daily
    current = F.col(value)
    for k in lookbacks:
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, -1)
        prior = F.collect_list(value).over(frame)  # nulls drop out; at most k values
        out = out.withColumns({f"_p{k}": prior, f"_sd{k}": F.stddev_pop(value).over(frame), f"_mean{k}": F.avg(value).over(frame)})
        prior = F.col(f"_p{k}")
        enough = (F.size(prior) >= k) & current.isNotNull()
        less = F.size(F.filter(prior, lambda x: x < current))
        equal = F.size(F.filter(prior, lambda x: x == current))
        out = out.withColumns({
            f"hist_{k}_sample_count": F.size(prior),
            f"hist_{k}_available": enough,
            f"hist_{k}_percentile": r6(F.when(enough, (less + 0.5 * equal) / F.size(prior))),
            f"hist_{k}_zscore": r6(F.when(enough & (F.col(f"_sd{k}") > 0), (current - F.col(f"_mean{k}")) / F.col(f"_sd{k}"))),
        }).drop(f"_p{k}", f"_sd{k}", f"_mean{k}")
    return out


def align_context(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Context of the bar's trading date as the bar may see it: AVAILABLE / PENDING / UNAVAILABLE / CONTRACT_MISMATCH."""
    right = context.select("instrument_id", F.col("target_date").alias("trading_date"), "context_id", "available_at", "is_available",
                           F.col("contract").alias("_contract"), "observed_high", "observed_low")
    rows = bars.select(*DAY_KEY, "contract", "bar_start", "bar_end").join(right, DAY_KEY, "left")
    status = (F.when(F.col("context_id").isNull() | ~F.col("is_available"), "UNAVAILABLE")
              .when(F.col("available_at") > F.col("bar_start"), "PENDING")
              .when(F.col("_contract") != F.col("contract"), "CONTRACT_MISMATCH").otherwise("AVAILABLE"))
    rows = rows.withColumn("status", status)
    shown = F.col("status") == "AVAILABLE"
    return rows.select(*DAY_KEY, "bar_start", "bar_end", "context_id", "status",
                       F.when(shown, F.col("observed_high")).alias("context_high"), F.when(shown, F.col("observed_low")).alias("context_low"))


def align_context_wide(aligned: DataFrame, context_ids: Sequence[str]) -> DataFrame:
    """One row per bar with the visible high of each context."""
    return aligned.groupBy("instrument_id", "bar_end").pivot("context_id", list(context_ids)).agg(F.max("context_high"))


def sweep_path(context: DataFrame, earlier: str, later: str) -> DataFrame:
    """Whether the later window took the earlier window's high or low."""
    def side(context_id, prefix):
        return context.filter((F.col("context_id") == context_id) & F.col("is_available")).select(
            "instrument_id", "target_date", F.col("observed_high").alias(f"{prefix}_high"), F.col("observed_low").alias(f"{prefix}_low"))
    both = side(earlier, "e").join(side(later, "l"), ["instrument_id", "target_date"])
    return both.select("instrument_id", "target_date", interaction_state(F.col("l_high") > F.col("e_high"), F.col("l_low") < F.col("e_low")).alias("path"))


def expansion_ratios(levels: DataFrame, context: DataFrame, context_ids: Sequence[str]) -> DataFrame:
    """Opening-range width relative to the range of each window."""
    ranges = context.filter("is_available").groupBy("instrument_id", F.col("target_date").alias("trading_date")).pivot(
        "context_id", list(context_ids)).agg(F.max(F.col("observed_high") - F.col("observed_low")))
    width = F.col("or_high") - F.col("or_low")
    rows = levels.filter("valid").join(ranges, DAY_KEY, "left")
    return rows.select(*DAY_KEY, *[F.round(ratio(width, F.col(c)), 9).alias(f"or_to_{c}") for c in context_ids])


def availability_audit(bars: DataFrame, schedule: DataFrame, context: DataFrame) -> DataFrame:
    """One row per unavailable window: expected, observed, missing bars, first and last missing instant and reason."""
    missing = context.filter("not is_available and expected_count > 0")
    due = schedule.select(F.col("trading_date").alias("source_date"), "bar_start", "bar_end")
    want = missing.select("instrument_id", "target_date", "context_id", "source_date", "window_start", "available_at").join(
        due, "source_date").filter((F.col("bar_start") >= F.col("window_start")) & (F.col("bar_end") <= F.col("available_at")))
    gone = want.join(bars.select("instrument_id", "bar_start"), ["instrument_id", "bar_start"], "left_anti")
    spans = gone.groupBy("instrument_id", "target_date", "context_id").agg(
        F.count(F.lit(1)).alias("missing_bars"), F.min("bar_end").alias("first_missing"), F.max("bar_end").alias("last_missing"))
    reason = (F.when(F.col("observed_count") == 0, "ENTIRE_WINDOW_MISSING").when(F.col("missing_bars") == 1, "SINGLE_BAR_MISSING")
              .when(F.col("missing_bars").isNull(), "OUTSIDE_COVERAGE").otherwise("PARTIAL_WINDOW"))
    return missing.join(spans, ["instrument_id", "target_date", "context_id"], "left").select(
        "instrument_id", "target_date", "context_id", "expected_count", "observed_count", "missing_bars", "first_missing",
        "last_missing", reason.alias("reason"))


def market_context_levels(context: DataFrame, calendar: DataFrame, neutral_close: Sequence[str]) -> DataFrame:
    """Levels from available contexts: high UPPER, low LOWER, and the close NEUTRAL where it is a reference."""
    bounds = calendar.select(F.col("trading_date").alias("target_date"), F.col("open").alias("valid_from"), F.col("close").alias("valid_until"))
    rows = context.filter("is_available").join(F.broadcast(bounds), "target_date")
    fields = F.array_compact(F.array(
        F.struct(F.lit("high").alias("field"), F.lit("UPPER").alias("orientation"), F.col("observed_high").alias("level_ticks")),
        F.struct(F.lit("low").alias("field"), F.lit("LOWER").alias("orientation"), F.col("observed_low").alias("level_ticks")),
        F.when(F.col("context_id").isin(*neutral_close), F.struct(
            F.lit("close").alias("field"), F.lit("NEUTRAL").alias("orientation"), F.col("observed_close").alias("level_ticks")))))
    out = rows.select("instrument_id", "contract", "context_id", "target_date", "source_date", "available_at", "valid_from", "valid_until", F.inline(fields))
    return out.select(
        "instrument_id", "contract", F.lit("SPECIFIC").alias("contract_scope"), "target_date", F.col("source_date").alias("source_trading_date"),
        "available_at", "valid_from", "valid_until", "orientation", "level_ticks", F.concat_ws("_", "context_id", "field").alias("level_type"),
        F.concat_ws(":", "context_id", "field", F.col("target_date").cast("string"), "instrument_id").alias("level_id"))
