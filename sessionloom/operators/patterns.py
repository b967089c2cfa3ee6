"""Swings, three-bar gap zones, their life cycles, touches and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.ids import natural_id, utc_text
from sessionloom.functions.ordered import HALO_BLOCK, halo_window, home_rows, running, with_halo
from sessionloom.functions.rangejoin import points_in_intervals
from sessionloom.functions.search import first_beyond

SEGMENT = ["instrument_id", "segment_id"]
SIDE = [*SEGMENT, "orientation"]
BASELINE = 14  # true ranges in the strength baseline


def sides(segmented: DataFrame) -> DataFrame:
    """One row per bar and side; lows are negated so that a single 'outer = larger' rule serves both."""
    return segmented.select(
        "instrument_id", "contract", "trading_date", "segment_id", "slot", "bar_start", "bar_end",
        F.expr("stack(2, 'UPPER', high, 'LOWER', -low) as (orientation, value)"))


def _plateau_rows(segmented: DataFrame, left: int, right: int) -> DataFrame:
    rows = with_halo(sides(segmented), "slot", max(left, 1), max(right, 1))
    window = halo_window(SIDE, "slot")
    before, after = window.rangeBetween(-left, -1), window.rangeBetween(1, right)
    bar = F.struct("slot", "value", "bar_end")
    flagged = rows.withColumns({
        "is_first": F.coalesce(F.lag("value").over(window) != F.col("value"), F.lit(True)),
        "is_last": F.coalesce(F.lead("value").over(window) != F.col("value"), F.lit(True)),
        "_before": F.collect_list(bar).over(before),
        "_after": F.collect_list(bar).over(after),
    })
    flagged = home_rows(flagged)
    return running(flagged, ["instrument_id", "orientation"], [["trading_date"]], ["slot"],
                   {"run_start": ("max", F.when(F.col("is_first"), F.col("slot")))})


def plateaus(segmented: DataFrame, left: int, right: int) -> DataFrame:
    """Maximal runs of equal extremes with the bars that decide whether they are swings."""
    rows = _plateau_rows(segmented, left, right).filter("is_first or is_last")
    first, last = F.col("is_first"), F.col("is_last")
    return rows.groupBy("instrument_id", "contract", "segment_id", "orientation", "run_start").agg(
        F.first("value").alias("value"), F.min("bar_end").alias("source_at"), F.max("bar_end").alias("source_end_at"),
        F.max("slot").alias("last_slot"), F.max(F.when(first, F.col("_before"))).alias("before"),
        F.max(F.when(last, F.col("_after"))).alias("after"))


def swing_points(segmented: DataFrame, left: int, right: int) -> DataFrame:
    """Plateaus with ``left`` bars before and ``right`` bars after, none of them strictly more extreme."""
    def beyond(side):
        return F.exists(side, lambda x: x["value"] > F.col("value"))
    found = plateaus(segmented, left, right).filter(
        (F.size("before") == left) & (F.size("after") == right) & ~beyond("before") & ~beyond("after"))
    price = F.when(F.col("orientation") == "UPPER", F.col("value")).otherwise(-F.col("value"))
    out = found.select(
        "instrument_id", "contract", "segment_id", "orientation", price.alias("price_ticks"), "source_at",
        "source_end_at", F.element_at("after", -1)["bar_end"].alias("available_at"),
        F.col("run_start").alias("first_slot"), "last_slot", (F.col("last_slot") + right).alias("available_slot"),
        F.lit(left).alias("left_depth"), F.lit(right).alias("right_depth"))
    return out.withColumn("swing_id", swing_id())


def swing_id():
    return natural_id("sw_", *[F.col(c) for c in ("instrument_id", "contract", "orientation", "left_depth", "right_depth")],
                      utc_text(F.col("source_at")), utc_text(F.col("source_end_at")))


def swing_candidates(segmented: DataFrame, breaks: DataFrame, left: int, right: int) -> DataFrame:
    """Every plateau with its status: confirmed, invalidated (which side, by how much) or undecidable."""
    rows = plateaus(segmented, left, right)
    ends = segmented.groupBy("instrument_id", "segment_id").agg(F.max("bar_end").alias("previous_bar_end"))
    reason = ends.join(breaks.select("instrument_id", "previous_bar_end", F.col("reason").alias("_break")),
                       ["instrument_id", "previous_bar_end"], "left").drop("previous_bar_end")
    rows = rows.join(reason, SEGMENT, "left")
    worse = lambda side: F.filter(side, lambda x: x["value"] > F.col("value"))
    left_hit = F.get(F.reverse(worse("before")), F.lit(0))
    right_hit = F.get(worse("after"), F.lit(0))
    rows = rows.withColumns({"_left": left_hit, "_right": right_hit})
    short_left, short_right = F.size("before") < left, F.size("after") < right
    status = (
        F.when(short_left, "INSUFFICIENT_LEFT_HISTORY")
        .when(F.col("_left").isNotNull() | F.col("_right").isNotNull(), "INVALIDATED_STRICT_EXCEED")
        .when(short_right & F.col("_break").isNull(), "INSUFFICIENT_FUTURE_COVERAGE")
        .when(short_right, "CONTINUITY_BREAK").otherwise("CONFIRMED"))
    rows = rows.withColumn("status", status)
    invalid = F.col("status") == "INVALIDATED_STRICT_EXCEED"
    hit = F.when(invalid, F.coalesce("_left", "_right"))
    return rows.select(
        "instrument_id", "contract", "segment_id", "orientation",
        F.when(F.col("orientation") == "UPPER", F.col("value")).otherwise(-F.col("value")).alias("price_ticks"),
        "source_at", "source_end_at", "status",
        F.when(invalid, F.when(F.col("_left").isNotNull(), "LEFT").otherwise("RIGHT")).alias("invalidating_side"),
        hit["bar_end"].alias("invalidating_bar_end"), (hit["value"] - F.col("value")).alias("invalidating_excess_ticks"),
        F.when(F.col("status") == "CONTINUITY_BREAK", F.col("_break")).alias("break_reason"),
        F.when(F.col("status") == "CONFIRMED", F.element_at("after", -1)["bar_end"]).alias("available_at"))


def bar_at(df: DataFrame, segmented: DataFrame, slot: str, **fields: str) -> DataFrame:
    """Fetch columns of the bar at ``slot`` of the row's series; absent slots give nulls."""
    bars = segmented.select("instrument_id", F.col("slot").alias(slot), *[F.col(c).alias(n) for n, c in fields.items()])
    return df.join(bars, ["instrument_id", slot], "left")


def first_close_beyond(swings: DataFrame, segmented: DataFrame) -> DataFrame:
    """First close strictly beyond each swing after its confirmation, inside its segment."""
    levels = swings.withColumn("_from", F.col("available_slot") + 1)
    found = first_beyond(levels, segmented, SEGMENT, ordinal="slot", above="close", below="close", start="_from",
                         threshold="price_ticks", side="orientation", out="break_slot").filter("break_slot is not null")
    found = bar_at(found, segmented, "break_slot", bar_start="bar_start", bar_end="bar_end", close_ticks="close")
    out = found.select(
        "swing_id", "instrument_id", "contract", "segment_id", "orientation", F.col("price_ticks").alias("level_ticks"),
        "bar_start", "bar_end", F.col("bar_end").alias("available_at"), "break_slot", "close_ticks",
        F.abs(F.col("close_ticks") - F.col("price_ticks")).alias("close_excess_ticks"))
    return out.withColumn("break_id", natural_id("sb_", F.col("swing_id"), utc_text(F.col("bar_end"))))


def true_range(segmented: DataFrame) -> DataFrame:
    """True range of each bar against the previous close of its segment (null on the first bar)."""
    rows = with_halo(segmented, "slot", 1, 0)
    previous = F.lag("close").over(halo_window(SEGMENT, "slot"))
    value = F.when(previous.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous),
                                                    F.abs(F.col("low") - previous)))
    return home_rows(rows.withColumn("true_range", value)).select(
        "instrument_id", "contract", "segment_id", "slot", "bar_end", "true_range")


def wick_gaps(segmented: DataFrame) -> DataFrame:
    """Every three-bar wick gap with its verdict: a zone, or the reason it is none."""
    rows = with_halo(segmented, "slot", BASELINE + 4, 0)
    window = halo_window(SEGMENT, "slot")
    past = lambda c, n: F.lag(c, n).over(window)
    previous = past("close", 1)
    rows = rows.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous),
                                             F.abs(F.col("low") - previous)))
    rows = rows.withColumns({
        "_h1": past("high", 2), "_l1": past("low", 2), "_o2": past("open", 1), "_c2": past("close", 1),
        "c1_start": past("bar_start", 2), "c1_end": past("bar_end", 2), "c2_end": past("bar_end", 1),
        "_sum": F.sum("_tr").over(window.rowsBetween(-BASELINE - 2, -3)),
    })
    rows = home_rows(rows).filter((F.col("low") > F.col("_h1")) | (F.col("high") < F.col("_l1")))
    bull = F.col("low") > F.col("_h1")
    rows = rows.withColumns({
        "direction": F.when(bull, "BULLISH").otherwise("BEARISH"),
        "lower_ticks": F.when(bull, F.col("_h1")).otherwise(F.col("high")),
        "upper_ticks": F.when(bull, F.col("low")).otherwise(F.col("_l1")),
    })
    directional = F.when(bull, F.col("_c2") > F.col("_o2")).otherwise(F.col("_c2") < F.col("_o2"))
    spans = F.when(bull, (F.col("_o2") <= F.col("_h1")) & (F.col("_c2") >= F.col("low"))).otherwise(
        (F.col("_o2") >= F.col("_l1")) & (F.col("_c2") <= F.col("high")))
    verdict = F.when(~directional, "C2_NOT_DIRECTIONAL").when(~spans, "C2_BODY_NOT_SPANNING").otherwise("ZONE")
    enough = (F.col("slot") - F.col("segment_id")) >= BASELINE + 3
    total = F.when(enough, F.col("_sum"))
    status = F.when(~enough, "INSUFFICIENT_HISTORY").when(F.col("_sum") > 0, "OK").otherwise("ZERO_BASELINE")
    width = F.col("upper_ticks") - F.col("lower_ticks")
    return rows.select(
        "instrument_id", "contract", "segment_id", "trading_date", "direction", "lower_ticks", "upper_ticks",
        (F.col("lower_ticks") + F.col("upper_ticks")).alias("mid2_ticks"), width.alias("width_ticks"),
        "c1_start", "c1_end", "c2_end", F.col("bar_end").alias("available_at"), F.col("slot").alias("available_slot"),
        verdict.alias("verdict"), total.alias("baseline_sum_ticks"), status.alias("normalization_status"),
        F.when(status == "OK", width * BASELINE / total).alias("strength"))


def zone_id():
    return natural_id("gz_", F.col("instrument_id"), F.col("contract"), F.col("direction"), utc_text(F.col("c1_end")),
                      utc_text(F.col("available_at")))


def gap_zones(segmented: DataFrame) -> DataFrame:
    return wick_gaps(segmented).filter("verdict = 'ZONE'").drop("verdict").withColumn("zone_id", zone_id())


def with_reset(rows: DataFrame, at: str, episodes: DataFrame) -> DataFrame:
    """Add ``reset_at`` and ``reset_reason`` of the episode whose bars an instant (the end of a bar) belongs to."""
    shift = F.expr("INTERVAL 1 MICROSECOND")
    spans = episodes.select("instrument_id", (F.col("first_bar_start") + shift).alias("_a"), (F.col("last_bar_end") + shift).alias("_b"), "reset_at", "reset_reason")
    return points_in_intervals(rows, spans, ["instrument_id"], at, "_a", "_b", how="left").drop("_a", "_b")


def zone_lifecycle(zones: DataFrame, segmented: DataFrame, episodes: DataFrame, *, tape: bool = False) -> DataFrame:
    """One row per zone: conversion (first close beyond), retirement (first close beyond the other side) or reset.

    With ``tape`` the episodes are those of finer bars than the zones', and that of the zone's instant counts.
    """
    bull = F.col("direction") == "BULLISH"
    levels = zones.withColumns({
        "_from": F.col("available_slot") + 1, "_side": F.when(bull, "LOWER").otherwise("UPPER"),
        "_level": F.when(bull, F.col("lower_ticks")).otherwise(F.col("upper_ticks"))})
    search = dict(ordinal="slot", above="close", below="close", start="_from", threshold="_level", side="_side")
    converted = first_beyond(levels, segmented, SEGMENT, out="conversion_slot", **search)
    converted = converted.withColumns({
        "_from": F.col("conversion_slot") + 1, "_side": F.when(bull, "UPPER").otherwise("LOWER"),
        "_level": F.when(bull, F.col("upper_ticks")).otherwise(F.col("lower_ticks"))})
    retired = first_beyond(converted, segmented, SEGMENT, out="retire_slot", **search).drop("_from", "_side", "_level")
    retired = bar_at(retired, segmented, "conversion_slot", converted_at="bar_end", conversion_close="close")
    retired = bar_at(retired, segmented, "retire_slot", retired_at="bar_end", retire_close="close")
    resets = episodes.select("instrument_id", "segment_id", "reset_at", "reset_reason")
    out = with_reset(retired, "available_at", episodes) if tape else retired.join(resets, SEGMENT, "left")
    exit_kind = F.when(F.col("retired_at").isNotNull(), "RETIRED").when(
        F.col("reset_reason") == "DATA_GAP", "TERMINATED").when(F.col("reset_reason").isNotNull(), "PENDING")
    return out.withColumn("exit_kind", exit_kind).withColumn("exit_at", F.coalesce("retired_at", "reset_at")).drop(
        "retired_at")


def flipped(direction):
    return F.when(direction == "BULLISH", "BEARISH").otherwise("BULLISH")


def zone_stages(life: DataFrame) -> DataFrame:
    """Stage intervals: the original zone, and the converted zone where a conversion happened."""
    first = F.struct(
        F.lit("FVG").alias("stage"), F.col("direction").alias("current_direction"),
        F.col("available_at").alias("stage_start"), F.col("available_slot").alias("start_slot"),
        F.coalesce("converted_at", "exit_at").alias("stage_end"), F.col("conversion_slot").alias("close_slot"),
        F.when(F.col("converted_at").isNotNull(), "CONVERTED").otherwise(F.col("exit_kind")).alias("end_kind"))
    second = F.struct(
        F.lit("IFVG").alias("stage"), flipped(F.col("direction")).alias("current_direction"),
        F.col("converted_at").alias("stage_start"), F.col("conversion_slot").alias("start_slot"),
        F.col("exit_at").alias("stage_end"), F.col("retire_slot").alias("close_slot"),
        F.col("exit_kind").alias("end_kind"))
    stages = F.filter(F.array(first, second), lambda s: s["stage_start"].isNotNull())
    frame = ["timeframe"] if "timeframe" in life.columns else []
    return life.select(*frame, "zone_id", "instrument_id", "contract", "segment_id", "lower_ticks", "upper_ticks", "mid2_ticks",
                       F.inline(stages))


def box_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], *, time: tuple[str, str], price: tuple[str, str],
                time_size: int, price_size: int, b_time=None, b_price=None) -> DataFrame:
    """Pairs of boxes (integer time x integer price, inclusive) that share at least a grid cell.

    Both sides are repeated per grid cell they cover and joined on the cell; each pair is kept in the
    first common cell only.  Callers add the exact overlap test.  Columns come back as structs a and b.
    """
    b_time, b_price = b_time or time, b_price or price

    def cells(df, t, p, name):
        span = lambda lo, hi, size: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
        packed = df.select(*keys, F.struct(*df.columns).alias(name), F.floor(F.col(t[0]) / time_size).alias(f"_{name}t"),
                           F.floor(F.col(p[0]) / price_size).alias(f"_{name}p"),
                           F.explode(span(t[0], t[1], time_size)).alias("_t"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(p)])
        return packed.withColumn("_p", F.explode(span("_c0", "_c1", price_size))).drop("_c0", "_c1")

    joined = cells(a, time, price, "a").join(cells(b, b_time, b_price, "b"), [*keys, "_t", "_p"])
    first = (F.col("_t") == F.greatest("_at", "_bt")) & (F.col("_p") == F.greatest("_ap", "_bp"))
    return joined.filter(first).select("a", "b")


def zone_touches(stages: DataFrame, segmented: DataFrame, *, time_size: int = 512, price_size: int = 4096) -> DataFrame:
    """Bars of each stage's life that trade inside the zone, with contact class and depth."""
    last = segmented.groupBy(*SEGMENT).agg(F.max("slot").alias("_end"))
    life = stages.join(last, SEGMENT).withColumns({
        "_t0": F.col("start_slot") + 1, "_t1": F.coalesce("close_slot", "_end")}).drop("_end").filter("_t1 >= _t0")
    bars = segmented.select(*SEGMENT, "slot", "bar_start", "bar_end", "open", "high", "low", "close").withColumn("_slot", F.col("slot"))
    pairs = box_overlap(life, bars, SEGMENT, time=("_t0", "_t1"), price=("lower_ticks", "upper_ticks"),
                        b_time=("slot", "_slot"), b_price=("low", "high"), time_size=time_size, price_size=price_size)
    pairs = pairs.filter((F.col("b.slot") >= F.col("a._t0")) & (F.col("b.slot") <= F.col("a._t1")))
    flat = pairs.select("a.zone_id", "a.stage", *[f"a.{c}" for c in ("instrument_id", "contract", "segment_id",
                        "current_direction", "lower_ticks", "upper_ticks", "mid2_ticks", "start_slot")],
                        *[f"b.{c}" for c in ("slot", "bar_end", "open", "high", "low", "close")])
    return contact_class(flat).filter("is_trade")


def contact_class(df: DataFrame) -> DataFrame:
    """Contact of a bar with a zone: trade, beyond, spanning, far contact, midpoint, full, depths."""
    lo, up, low, high = (F.col(c) for c in ("lower_ticks", "upper_ticks", "low", "high"))
    bull = F.col("current_direction") == "BULLISH"
    trade = F.when(bull, (low < up) & (high >= lo)).otherwise((high > lo) & (low <= up))
    covers = (low <= lo) & (high >= up)
    pick = lambda a, b: F.when(bull, a).otherwise(b)
    return df.withColumns({
        "is_trade": trade, "is_beyond": pick(high < lo, low > up), "is_spanning": trade & covers,
        "is_far": trade & pick(high == lo, low == up),
        "is_midpoint": trade & pick(2 * low <= F.col("mid2_ticks"), 2 * high >= F.col("mid2_ticks")),
        "is_full": trade & pick(low <= lo, high >= up),
        "depth_ticks": pick(up - low, high - lo),
        "in_zone_ticks": pick(up - F.greatest(low, lo), F.least(high, up) - lo),
    })


def mitigation_events(stages: DataFrame, touches: DataFrame, segmented: DataFrame) -> DataFrame:
    """First penetration / midpoint / full contact, every new depth, and gaps straight through the zone."""
    stage = Window.partitionBy("zone_id", "stage").orderBy("slot")
    deepest = F.max("depth_ticks").over(stage.rowsBetween(Window.unboundedPreceding, -1))
    rows = touches.withColumns({
        "_deeper": deepest.isNull() | (F.col("depth_ticks") > deepest),
        "_first": F.row_number().over(stage) == 1,
        "_mid": F.col("is_midpoint") & (F.sum(F.col("is_midpoint").cast("int")).over(stage) == 1),
        "_full": F.col("is_full") & (F.sum(F.col("is_full").cast("int")).over(stage) == 1),
    })
    kinds = F.array(
        F.when(F.col("_first"), F.lit("PENETRATION")), F.when(F.col("_mid"), F.lit("MIDPOINT")),
        F.when(F.col("_full"), F.lit("FULL")), F.when(F.col("_deeper"), F.lit("DEPTH")))
    observed = (F.when(F.col("is_spanning"), "SPANNING").when(F.col("is_far"), "FAR_CONTACT").otherwise("ZONE_TRADE"))
    events = rows.select("zone_id", "stage", F.explode(F.array_compact(kinds)).alias("event_kind"), "slot", "bar_end",
                         observed.alias("observation_class"), "depth_ticks", "in_zone_ticks")
    bull = F.col("current_direction") == "BULLISH"
    levels = stages.withColumns({
        "_from": F.col("start_slot") + 1, "_side": F.when(bull, "LOWER").otherwise("UPPER"),
        "_level": F.when(bull, F.col("lower_ticks")).otherwise(F.col("upper_ticks"))})
    # a bar lies wholly beyond when its near side is: highs below a bullish zone, lows above a bearish one
    gaps = first_beyond(levels, segmented, SEGMENT, ordinal="slot", above="low", below="high", start="_from",
                        threshold="_level", side="_side", out="slot", last="close_slot").filter("slot is not null")
    first = touches.groupBy("zone_id", "stage").agg(F.min("slot").alias("_first_touch"))
    gaps = gaps.join(first, ["zone_id", "stage"], "left").filter("_first_touch is null or slot < _first_touch")
    gaps = bar_at(gaps, segmented, "slot", bar_end="bar_end").select(
        "zone_id", "stage", F.lit("GAP_THROUGH").alias("event_kind"), "slot", "bar_end",
        F.lit("BEYOND").alias("observation_class"), F.lit(None).cast("bigint").alias("depth_ticks"),
        F.lit(None).cast("bigint").alias("in_zone_ticks"))
    return events.unionByName(gaps)


def zone_overlaps(stages: DataFrame, *, time_size: int = 7 * 86400, price_size: int = 4096) -> DataFrame:
    """Pairs of zones, of one or several timeframes, whose stages overlap strictly in time and by at least one tick in price.

    Segment and slot are those of the zone that moved last, on the bars of its own timeframe.
    """
    horizon = 4_102_444_800
    timed = stages.withColumns({
        "timeframe": F.col("timeframe") if "timeframe" in stages.columns else F.lit("BASE"),
        "_t0": F.unix_timestamp("stage_start"),
        "_t1": F.unix_timestamp("stage_end")})
    # open stages reach to the last instant known for their contract
    latest = timed.groupBy("instrument_id", "contract").agg(F.max(F.greatest("_t0", "_t1")).alias("_latest"))
    timed = timed.join(latest, ["instrument_id", "contract"]).withColumn("_t1", F.coalesce("_t1", "_latest")).drop("_latest")
    pairs = box_overlap(timed, timed, ["instrument_id", "contract"], time=("_t0", "_t1"),
                        price=("lower_ticks", "upper_ticks"), time_size=time_size, price_size=price_size)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    far = F.timestamp_seconds(F.lit(horizon))
    lower, upper = F.greatest(a("lower_ticks"), b("lower_ticks")), F.least(a("upper_ticks"), b("upper_ticks"))
    start = F.greatest(a("stage_start"), b("stage_start"))
    end = F.least(a("stage_end"), b("stage_end"))
    pairs = pairs.filter((a("zone_id") < b("zone_id")) & (upper - lower >= 1) & (start < F.coalesce(end, far)))
    moves_a, moves_b = a("stage_start") == start, b("stage_start") == start
    same = a("current_direction") == b("current_direction")
    ends_a, ends_b = a("stage_end").eqNullSafe(end), b("stage_end").eqNullSafe(end)
    exits_a = ends_a & (a("end_kind") != "CONVERTED")
    exits_b = ends_b & (b("end_kind") != "CONVERTED")
    reason = F.when(end.isNull(), F.lit(None)).when(exits_a, F.concat(F.lit("PARENT_"), a("end_kind"))).when(
        exits_b, F.concat(F.lit("PARENT_"), b("end_kind"))).otherwise("PARENT_STAGE_CHANGED")
    single_a, single_b = moves_a & ~moves_b, moves_b & ~moves_a
    label = F.when(same, "FVG_OVERLAP").when(a("timeframe") == b("timeframe"), "BPR").otherwise("MTF_BPR")
    return pairs.select(
        a("instrument_id").alias("instrument_id"), a("contract").alias("contract"), F.when(moves_a, a("segment_id")).otherwise(b("segment_id")).alias("segment_id"),
        a("zone_id").alias("zone_a"), a("stage").alias("stage_a"), b("zone_id").alias("zone_b"), b("stage").alias("stage_b"),
        a("timeframe").alias("timeframe_a"), b("timeframe").alias("timeframe_b"), label.alias("label"),
        F.when(same, a("current_direction")).when(single_a, a("current_direction")).when(single_b, b("current_direction"))
        .otherwise("UNDEFINED").alias("direction"),
        F.when(~same & single_a, a("timeframe")).when(~same & single_b, b("timeframe")).alias("governing_timeframe"),
        F.when(moves_a & moves_b, "BOTH").when(moves_a, "A").otherwise("B").alias("movers"),
        lower.alias("lower_ticks"), upper.alias("upper_ticks"), start.alias("created_at"),
        F.when(moves_a, a("start_slot")).otherwise(b("start_slot")).alias("created_slot"),
        end.alias("ended_at"), reason.alias("end_reason"))


def bpr_lifecycle(overlaps: DataFrame, segmented: DataFrame, episodes: DataFrame) -> DataFrame:
    """Opposite-direction overlaps followed to their first close beyond, else to the reset of their episode.

    Bars with a ``timeframe`` are searched in the governing one; the reset is then that of the episode (of the finest
    bars) at the instant the overlap began.
    """
    frames = "timeframe" in segmented.columns
    keys = ["timeframe", *SEGMENT] if frames else SEGMENT
    pairs = overlaps.filter("label <> 'FVG_OVERLAP'").drop("ended_at", "end_reason").withColumn("timeframe", F.coalesce("governing_timeframe", F.lit("NONE")))
    bull = F.col("direction") == "BULLISH"
    levels = pairs.withColumns({
        "_from": F.when(F.col("direction") != "UNDEFINED", F.col("created_slot") + 1),
        "_side": F.when(bull, "LOWER").otherwise("UPPER"),
        "_level": F.when(bull, F.col("lower_ticks")).otherwise(F.col("upper_ticks"))})
    found = first_beyond(levels, segmented, keys, ordinal="slot", above="close", below="close", start="_from",
                         threshold="_level", side="_side", out="retire_slot").drop("_from", "_side", "_level")
    ends = segmented.select(*[c for c in keys if c != "segment_id"], F.col("slot").alias("retire_slot"), F.col("bar_end").alias("_retired"))
    found = found.join(ends, [c for c in ends.columns if c != "_retired"], "left")
    found = with_reset(found, "created_at", episodes) if frames else found.join(episodes.select(*SEGMENT, "reset_at", "reset_reason"), SEGMENT, "left")
    state = (F.when(F.col("_retired").isNotNull(), "RETIRED").when(F.col("reset_reason") == "DATA_GAP", "TERMINATED")
             .when(F.col("reset_reason").isNotNull(), "PENDING"))
    return found.select(
        natural_id("bp_", F.col("zone_a"), F.col("stage_a"), F.col("zone_b"), F.col("stage_b")).alias("bpr_id"),
        "instrument_id", "contract", "segment_id", "label", "direction", "governing_timeframe", "zone_a", "stage_a",
        "zone_b", "stage_b", "lower_ticks", "upper_ticks", (F.col("upper_ticks") - F.col("lower_ticks")).alias("width_ticks"),
        F.col("created_at").alias("available_at"), state.alias("exit_state"),
        F.coalesce("_retired", "reset_at").alias("exit_at"))
