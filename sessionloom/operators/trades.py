"""Opening ranges, breakouts, candidates, exits and eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import half_up

SESSION = ["instrument_id", "trading_date"]
GROUP = ["instrument_id", "trading_date", "breakout_type"]


def _clock():
    return F.unix_timestamp("bar_start") - F.unix_timestamp(F.col("trading_date").cast("timestamp"))


def _levels(inside: DataFrame, keys: Sequence[str], expected) -> DataFrame:
    out = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("or_bars"), F.max("high").alias("or_high"),
                                    F.min("low").alias("or_low"), F.min_by("open", "bar_start").alias("or_open"),
                                    F.max_by("close", "bar_start").alias("or_close"), F.max("bar_end").alias("or_end"))
    return out.withColumns({
        "or_mid2": F.col("or_high") + F.col("or_low"),
        "valid": (F.col("or_bars") == expected) & (F.col("or_high") > F.col("or_low"))})


def opening_levels(bars: DataFrame, interval: int, range_clock: int, range_bars: int) -> DataFrame:
    """Range of the first ``range_bars`` bars from ``range_clock``; valid only when all are there."""
    clock = _clock()
    return _levels(bars.filter((clock >= range_clock) & (clock < range_clock + range_bars * interval)), SESSION, range_bars)


def opening_levels_by_length(bars: DataFrame, interval: int, range_clock: int, lengths: Sequence[int]) -> DataFrame:
    """``opening_levels`` of several range lengths (``duration``, in bars) from one scan of the bars of the longest."""
    clock = _clock()
    inside = bars.filter((clock >= range_clock) & (clock < range_clock + max(lengths) * interval))
    holds = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: clock < range_clock + k * interval)
    return _levels(inside.withColumn("duration", F.explode(holds)), [*SESSION, "duration"], F.col("duration"))


def _eligible(bars: DataFrame, levels: DataFrame, interval: int, range_clock: int, range_bars: int, cutoff: int) -> DataFrame:
    clock = F.unix_timestamp("bar_start") - F.unix_timestamp(F.col("trading_date").cast("timestamp"))
    late = bars.filter((clock >= range_clock + range_bars * interval) & (clock <= cutoff))
    return late.join(levels.filter("valid").select(*SESSION, "or_high", "or_low", "or_mid2"), SESSION)


def breakout_signals(bars: DataFrame, levels: DataFrame, *, interval: int, range_clock: int, range_bars: int,
                     cutoff: int) -> DataFrame:
    """First break per direction after the range, by trade (PRINT) and by close (CLOSE)."""
    return _first_breaks(_eligible(bars, levels, interval, range_clock, range_bars, cutoff), SESSION)


def breakout_signals_by_length(bars: DataFrame, levels: DataFrame, *, interval: int, range_clock: int, cutoff: int) -> DataFrame:
    """``breakout_signals`` of every range length of ``levels``, with its ``duration``."""
    valid = levels.filter("valid").select(*SESSION, "duration", "or_high", "or_low", "or_mid2")
    late = bars.withColumn("_clock", _clock()).filter(F.col("_clock") <= cutoff).join(valid, SESSION)
    return _first_breaks(late.filter(F.col("_clock") >= range_clock + F.col("duration") * interval), [*SESSION, "duration"])


def _first_breaks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    up, down = F.col("high") > F.col("or_high"), F.col("low") < F.col("or_low")
    first = lambda cond: F.min(F.when(cond, F.struct("slot", "bar_end", "contract")))
    found = rows.groupBy(*keys, "or_high", "or_low", "or_mid2").agg(
        first(up & ~down).alias("pl"), first(down & ~up).alias("ps"),
        first(F.col("close") > F.col("or_high")).alias("cl"), first(F.col("close") < F.col("or_low")).alias("cs"))
    long = found.select(*keys, "or_high", "or_low", "or_mid2", F.expr(
        "stack(4, 'PRINT', 'LONG', pl, 'PRINT', 'SHORT', ps, 'CLOSE', 'LONG', cl, 'CLOSE', 'SHORT', cs)"
        " as (breakout_type, direction, hit)")).filter("hit is not null")
    return long.select(*keys, F.col("hit.contract").alias("contract"), "breakout_type", "direction",
                       F.col("hit.slot").alias("signal_slot"), F.col("hit.bar_end").alias("signal_time"),
                       "or_high", "or_low", "or_mid2")


def two_sided_bars(bars: DataFrame, levels: DataFrame, signals: DataFrame, **kw) -> DataFrame:
    """PRINT bars that broke both sides, up to the bar at which both directions had been found."""
    rows = _eligible(bars, levels, kw["interval"], kw["range_clock"], kw["range_bars"], kw["cutoff"])
    both = rows.filter((F.col("high") > F.col("or_high")) & (F.col("low") < F.col("or_low")))
    done = signals.filter("breakout_type = 'PRINT'").groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("_n"), F.max("signal_slot").alias("_done"))
    return both.join(done, SESSION, "left").filter("_n is null or _n < 2 or slot < _done").select(
        *SESSION, "slot", "bar_end", "or_high", "or_low")


# The sweep axes.
STOP_FRACTIONS = (25, 50, 75, 90)
TARGET_MULTIPLES = (1.0, 1.5, 2.0, 2.5, 3.0)
STOP_POINTS = (20, 40, 60, 80, 100)
TARGET_POINTS = (50, 100, 150)
#: Sweeps over range lengths: 4 x 2 x 5 cells with targets in multiples of the risk, 3 x 5 x 5 with targets in points.
MULTIPLE_LENGTHS, MULTIPLE_FRACTIONS = (1, 2, 3, 4), (25, 50)
POINT_LENGTHS, POINT_TARGETS = (1, 2, 3), (40, 50, 75, 100, 150)
POINT_STOPS = (("OR_FRACTION", 50), ("OR_FRACTION", 25), ("FIXED_POINTS", 40), ("FIXED_POINTS", 60), ("FIXED_POINTS", 80))


def fraction_grid(fractions: Sequence[int] = STOP_FRACTIONS, multiples: Sequence[float] = TARGET_MULTIPLES):
    """Parameter cells as one literal array column, so the sweep explodes rows and needs no join."""
    cells = [F.struct(F.format_string("F%03d_R%03d", F.lit(f), F.lit(int(r * 100))).alias("config_id"),
                      F.lit(f).alias("stop_pct"), F.lit(r).cast("decimal(6,2)").alias("target_r"))
             for f in fractions for r in multiples]
    return F.array(*cells)


def point_grid(stops: Sequence[int] = STOP_POINTS, targets: Sequence[int] = TARGET_POINTS, scale: int = 100):
    """Fixed-point cells; points are scaled to ticks."""
    cells = [F.struct(F.format_string("S%03d_T%03d", F.lit(s), F.lit(t)).alias("config_id"),
                      F.lit(s).alias("stop_points"), F.lit(t).alias("target_points"),
                      F.lit(s * scale).cast("bigint").alias("stop_ticks"), F.lit(t * scale).cast("bigint").alias("target_ticks"))
             for s in stops for t in targets]
    return F.array(*cells)


def _with_entry(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry bar: the signal bar for PRINT, the bar exactly one interval later for CLOSE."""
    is_print = F.col("breakout_type") == "PRINT"
    wanted = signals.withColumn("_entry", F.when(is_print, F.col("signal_slot")).otherwise(F.col("signal_slot") + 1))
    entry = bars.select(*SESSION, F.col("slot").alias("_entry"), F.col("bar_end").alias("entry_time"),
                        F.col("open").alias("_open"))
    out = wanted.join(entry, [*SESSION, "_entry"], "left")
    boundary = F.when(F.col("direction") == "LONG", F.col("or_high")).otherwise(F.col("or_low"))
    found = F.col("entry_time").isNotNull()
    return out.withColumns({
        "entry_slot": F.when(found, F.col("_entry")),
        "entry_ticks": F.when(found, F.when(is_print, boundary).otherwise(F.col("_open")))}).drop("_entry", "_open")


def candidate_entries(signals: DataFrame, bars: DataFrame, grid=None) -> DataFrame:
    """Entry, stop, risk and target of every signal and grid cell; invalid candidates keep a reason."""
    grid = fraction_grid((50,), (2.0,)) if grid is None else grid
    out = _with_entry(signals, bars).select("*", F.inline(grid))
    sign = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    width = (F.col("or_high") - F.col("or_low")).cast("decimal(20,0)")
    base = F.when(F.col("direction") == "LONG", F.col("or_high")).otherwise(F.col("or_low"))
    stop = half_up(base.cast("decimal(20,0)") - sign * width * F.col("stop_pct").cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)"))
    out = out.withColumn("stop_ticks", stop)
    risk = sign * (F.col("entry_ticks") - F.col("stop_ticks"))
    out = out.withColumn("risk_ticks", F.when(risk > 0, risk))
    target = F.col("entry_ticks") + sign * half_up(F.col("target_r") * F.col("risk_ticks").cast("decimal(16,0)"))
    reason = (F.when(F.col("entry_time").isNull(), "MISSING_IMMEDIATE_NEXT_BAR")
              .when(risk <= 0, "INVALID_ENTRY_RELATIVE_TO_STOP").otherwise(""))
    return out.withColumns({"target_ticks": target, "invalid_reason": reason, "is_valid": reason == ""})


def fixed_point_candidates(signals: DataFrame, bars: DataFrame, grid=None) -> DataFrame:
    """Stop and target at fixed distances, with their ratios to the range width."""
    out = _with_entry(signals, bars).select("*", F.inline(point_grid() if grid is None else grid))
    sign = F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    found = F.col("entry_time").isNotNull()
    width = F.col("or_high") - F.col("or_low")
    out = out.withColumnsRenamed({"stop_ticks": "risk_ticks", "target_ticks": "_target"})
    return out.withColumns({
        "stop_ticks": F.col("entry_ticks") - sign * F.col("risk_ticks"),
        "target_ticks": F.col("entry_ticks") + sign * F.col("_target"),
        "risk_to_width": F.col("risk_ticks") / width, "target_to_width": F.col("_target") / width,
        "risk_ticks": F.when(found, F.col("risk_ticks")),
        "invalid_reason": F.when(found, "").otherwise("MISSING_IMMEDIATE_NEXT_BAR"), "is_valid": found}).drop("_target")


def stop_and_target_grid(stops: Sequence[tuple[str, int]] = POINT_STOPS, targets: Sequence[int] = POINT_TARGETS):
    """Cells of a stop (percent of the range width, or points) and a target in points."""
    cells = [F.struct(F.format_string("%s%03d_T%03d", F.lit(kind[0]), F.lit(v), F.lit(t)).alias("config_id"), F.lit(kind).alias("stop_kind"),
                      F.lit(v).alias("stop_value"), F.lit(t).alias("target_points")) for kind, v in stops for t in targets]
    return F.array(*cells)


def stop_and_target_candidates(signals: DataFrame, bars: DataFrame, grid=None, scale: int = 100) -> DataFrame:
    """Candidates whose stop lies a share of the width behind the broken boundary, or points behind the entry; the target
    lies points ahead of the entry.  Points are scaled to ticks; a stop that isn't behind the entry makes a candidate invalid."""
    out = _with_entry(signals, bars).select("*", F.inline(stop_and_target_grid() if grid is None else grid))
    long = F.col("direction") == "LONG"
    sign, width = F.when(long, 1).otherwise(-1), F.col("or_high") - F.col("or_low")
    base = F.when(long, F.col("or_high")).otherwise(F.col("or_low")).cast("decimal(20,0)")
    share = half_up(base - sign * width.cast("decimal(20,0)") * F.col("stop_value").cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)"))
    out = out.withColumn("stop_ticks", F.when(F.col("stop_kind") == "OR_FRACTION", share).otherwise(F.col("entry_ticks") - sign * F.col("stop_value") * scale))
    risk, ahead = sign * (F.col("entry_ticks") - F.col("stop_ticks")), F.col("target_points") * scale
    reason = (F.when(F.col("entry_time").isNull(), "MISSING_IMMEDIATE_NEXT_BAR")
              .when(risk <= 0, "INVALID_ENTRY_RELATIVE_TO_STOP").otherwise(""))
    return out.withColumns({
        "risk_ticks": F.when(risk > 0, risk), "target_ticks": F.col("entry_ticks") + sign * ahead, "risk_to_width": F.when(risk > 0, risk / width),
        "target_to_width": ahead / width, "invalid_reason": reason, "is_valid": reason == ""})


def with_length(candidates: DataFrame) -> DataFrame:
    """Cells of a sweep over range lengths: ``config_id`` starts with the length, so it stays the key of a cell."""
    return candidates.withColumn("config_id", F.concat(F.format_string("D%02d_", F.col("duration")), F.col("config_id")))


CANDIDATE = [*SESSION, "breakout_type", "direction", "config_id"]
CARRIED = ["contract", "signal_slot", "signal_time", "entry_slot", "entry_time", "entry_ticks", "stop_ticks",
           "risk_ticks", "target_ticks"]


def exit_barrier(candidates: DataFrame, bars: DataFrame, *, skip_entry_bar: bool = False) -> DataFrame:
    """Follow each valid candidate through the rest of its session to the first barrier it meets.

    Both barriers in one bar, and a stop in the entry bar of a PRINT, leave the order unknown.  The bars of a session,
    bounded by its slots, become one row; each candidate meets that row once and is followed inside the row.
    """
    bar = F.struct("slot", "bar_end", "high", "low", "close")
    path = bars.groupBy(*SESSION).agg(F.sort_array(F.collect_list(bar)).alias("_path"))
    rows = candidates.filter("is_valid").select(*CANDIDATE, *CARRIED).join(path, SESSION)
    rows = rows.withColumn("_path", F.filter("_path", lambda x: (x["slot"] > F.col("entry_slot")) if skip_entry_bar else (x["slot"] >= F.col("entry_slot"))))
    long = F.col("direction") == "LONG"

    def reason(x):
        stop = F.when(long, x["low"] <= F.col("stop_ticks")).otherwise(x["high"] >= F.col("stop_ticks"))
        target = F.when(long, x["high"] >= F.col("target_ticks")).otherwise(x["low"] <= F.col("target_ticks"))
        entry_bar = (F.col("breakout_type") == "PRINT") & (x["slot"] == F.col("entry_slot"))
        return (F.when(stop & target, "AMBIGUOUS_STOP_TARGET").when(stop & entry_bar, "AMBIGUOUS_ENTRY_STOP")
                .when(target, "TARGET").when(stop, "STOP"))

    rows = rows.filter(F.size("_path") > 0).withColumn("_hit", F.get(F.filter("_path", lambda x: reason(x).isNotNull()), F.lit(0)))
    rows = rows.withColumns({"_end": F.coalesce("_hit", F.element_at("_path", -1)), "exit_reason": F.coalesce(reason(F.col("_hit")), F.lit("SESSION_END"))})
    rows = rows.withColumn("_path", F.filter("_path", lambda x: x["slot"] <= F.col("_end.slot")))
    exit_ticks = (F.when(F.col("exit_reason") == "TARGET", F.col("target_ticks")).when(F.col("exit_reason") == "STOP", F.col("stop_ticks"))
                  .when(F.col("exit_reason") == "SESSION_END", F.col("_end.close")))
    done = rows.select(*CANDIDATE, *CARRIED, F.col("_end.bar_end").alias("exit_time"), "exit_reason", exit_ticks.alias("exit_ticks"),
                       F.size("_path").cast("bigint").alias("holding_bars"), F.array_max(F.transform("_path", lambda x: x["high"])).alias("_h"),
                       F.array_min(F.transform("_path", lambda x: x["low"])).alias("_l"))
    unclear = F.col("exit_reason").startswith("AMBIGUOUS")
    known = ~unclear
    gain = F.when(long, F.col("exit_ticks") - F.col("entry_ticks")).otherwise(F.col("entry_ticks") - F.col("exit_ticks"))
    best = F.greatest(F.lit(0), F.when(long, F.col("_h") - F.col("entry_ticks")).otherwise(F.col("entry_ticks") - F.col("_l")))
    worst = F.greatest(F.lit(0), F.when(long, F.col("entry_ticks") - F.col("_l")).otherwise(F.col("_h") - F.col("entry_ticks")))
    return done.withColumns({
        "is_ambiguous": unclear, "pnl_ticks": F.when(known, gain),
        "result_r": F.when(known, gain / F.col("risk_ticks")),
        "mfe_ticks": F.when(known, best), "mae_ticks": F.when(known, worst)}).drop("_h", "_l")


def session_trade_limit(candidates: DataFrame, trades: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One executed trade per (session, type, cell): the first valid and unambiguous candidate; others get a reason.

    ``extra`` names further key columns both inputs carry, such as a scenario.
    """
    keys = [*CANDIDATE, *extra]
    taken = trades.select(*keys, "exit_reason", "is_ambiguous", "result_r")
    rows = candidates.select(*keys, "signal_time", "entry_time", "is_valid", "invalid_reason").join(taken, keys, "left")
    fits = F.col("is_valid") & F.col("exit_reason").isNotNull() & ~F.coalesce("is_ambiguous", F.lit(False))
    order = Window.partitionBy(*GROUP, "config_id", *extra).orderBy(F.coalesce("entry_time", "signal_time"), "signal_time", "direction")
    before = F.sum(fits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reason = (F.when(~F.col("is_valid"), F.col("invalid_reason")).when(F.col("exit_reason").isNull(), "MISSING_COMPLETED_TRADE")
              .when(F.col("is_ambiguous"), F.col("exit_reason")).when(F.coalesce(before, F.lit(0)) > 0, "SESSION_TRADE_LIMIT").otherwise(""))
    return rows.withColumn("rejection_reason", reason).withColumn(
        "status", F.when(F.col("rejection_reason") == "", "EXECUTED").otherwise("REJECTED"))


def resolve_pessimistic(trades: DataFrame) -> DataFrame:
    """Count an unknown entry-bar stop as a full loss."""
    hit = F.col("exit_reason") == "AMBIGUOUS_ENTRY_STOP"
    return trades.withColumns({
        "result_r": F.when(hit, F.lit(-1.0)).otherwise(F.col("result_r")),
        "exit_ticks": F.when(hit, F.col("stop_ticks")).otherwise(F.col("exit_ticks")),
        "is_ambiguous": F.col("is_ambiguous") & ~hit,
        "exit_reason": F.when(hit, "STOP").otherwise(F.col("exit_reason"))})


def resolve_after_entry_bar(trades: DataFrame, candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Re-follow only the unknown entry-bar stops from the bar after entry; keep the other trades."""
    unclear = trades.filter("exit_reason = 'AMBIGUOUS_ENTRY_STOP'")
    again = candidates.join(unclear.select(*CANDIDATE), CANDIDATE, "left_semi")
    return trades.filter("exit_reason <> 'AMBIGUOUS_ENTRY_STOP'").unionByName(exit_barrier(again, bars, skip_entry_bar=True))


def entry_first(trades: DataFrame) -> DataFrame:
    """Assume the entry came before the stop in an unknown entry bar: the trade stops out in that bar."""
    hit = F.col("exit_reason") == "AMBIGUOUS_ENTRY_STOP"
    loss = -F.col("risk_ticks")
    return trades.withColumns({
        "exit_ticks": F.when(hit, F.col("stop_ticks")).otherwise(F.col("exit_ticks")),
        "pnl_ticks": F.when(hit, loss).otherwise(F.col("pnl_ticks")),
        "result_r": F.when(hit, F.lit(-1.0)).otherwise(F.col("result_r")),
        "is_ambiguous": F.col("is_ambiguous") & ~hit,
        "exit_reason": F.when(hit, "STOP").otherwise(F.col("exit_reason"))})


def excursions_from(anchors: DataFrame, bars: DataFrame, horizons: Sequence[int], last_slots: DataFrame | None = None) -> DataFrame:
    """Best and worst move after each anchor over horizons of bars of its session; null unless each bar is there.

    ``anchors`` have the session, ``slot``, ``anchor`` (a price) and ``direction`` among their columns.  The moves of all
    horizons are frames over the bars of one session, a bounded partition, so a bar stays one row and an anchor meets one
    row.  ``last_slots`` (trading_date, last_slot) adds the horizon to the end of the session, as horizon null.
    """
    session = Window.partitionBy(*SESSION).orderBy("slot")
    rows = bars.select(*SESSION, "slot", "high", "low")
    frame = lambda h: session.rangeBetween(1, h if h is not None else Window.unboundedFollowing)
    every = [*horizons, *([None] if last_slots is not None else [])]
    rows = rows.withColumns({f"_{i}": F.struct(F.lit(h).cast("int").alias("horizon"), F.count("slot").over(frame(h)).alias("bars"), F.max("high").over(frame(h)).alias("h"),
                                               F.min("low").over(frame(h)).alias("l")) for i, h in enumerate(every)})
    rows = rows.select(*SESSION, "slot", F.array(*[f"_{i}" for i in range(len(every))]).alias("_moves"))
    idle = F.array(*[F.struct(F.lit(h).cast("int").alias("horizon"), F.lit(0).cast("bigint").alias("bars"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("l")) for h in every])
    found = anchors.join(rows, [*SESSION, "slot"], "left").withColumn("_move", F.explode(F.coalesce("_moves", idle)))
    due = F.col("_move.horizon")
    if last_slots is not None:
        found = found.join(F.broadcast(last_slots), "trading_date", "left")
        due = F.coalesce(due, F.col("last_slot") - F.col("slot"))
    long, complete = F.col("direction") == "LONG", (F.col("_move.bars") == due) & (due > 0)
    high, low = F.col("_move.h") - F.col("anchor"), F.col("anchor") - F.col("_move.l")
    best, worst = F.greatest(F.lit(0), F.when(long, high).otherwise(low)), F.greatest(F.lit(0), F.when(long, low).otherwise(high))
    return found.select(*[c for c in anchors.columns], F.col("_move.horizon").alias("horizon"), F.col("_move.bars").alias("bars"), F.coalesce(complete, F.lit(False)).alias("is_complete"),
                        F.when(complete, best).alias("mfe_ticks"), F.when(complete, worst).alias("mae_ticks"))


def forward_excursion(signals: DataFrame, bars: DataFrame, horizons: Sequence[int], last_slots: DataFrame | None = None) -> DataFrame:
    """Excursions from the broken boundary after the signal bar."""
    anchor = F.when(F.col("direction") == "LONG", F.col("or_high")).otherwise(F.col("or_low"))
    anchors = signals.select(*SESSION, "breakout_type", "direction", F.col("signal_slot").alias("slot"), anchor.alias("anchor"))
    return excursions_from(anchors, bars, horizons, last_slots).drop("slot", "anchor")


def signal_bar_excursion(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Favourable and adverse move of the signal bar itself against the broken boundary."""
    bar = bars.select(*SESSION, F.col("slot").alias("signal_slot"), "high", "low")
    rows = signals.join(bar, [*SESSION, "signal_slot"])
    long = F.col("direction") == "LONG"
    anchor = F.when(long, F.col("or_high")).otherwise(F.col("or_low"))
    return rows.select(
        *SESSION, "breakout_type", "direction", "signal_time",
        F.greatest(F.lit(0), F.when(long, F.col("high") - anchor).otherwise(anchor - F.col("low"))).alias("favourable_ticks"),
        F.greatest(F.lit(0), F.when(long, anchor - F.col("low")).otherwise(F.col("high") - anchor)).alias("adverse_ticks"))
