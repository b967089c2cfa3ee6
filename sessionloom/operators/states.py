"""Breakout events with their market state, and summaries of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6

from sessionloom.functions.scalars import percentile_band, ratio

DAY = ["instrument_id", "trading_date"]


def join_features_outcomes(events: DataFrame, features: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Many-to-one left join of events to day features, with a flag for unmatched events."""
    return events.join(features.withColumn("_hit", F.lit(True)), list(keys), "left").withColumn(
        "is_matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def directional_state(events: DataFrame) -> DataFrame:
    """Alignment of breakout and range direction, signed move and mirrored close location."""
    long = F.col("direction") == "LONG"
    with_move = F.when(long, F.col("or_direction") == "UP").otherwise(F.col("or_direction") == "DOWN")
    alignment = (F.when(F.col("or_direction") == "FLAT", "FLAT").when(with_move, "ALIGNED")
                 .when(F.col("or_direction").isNotNull(), "OPPOSED"))
    return events.withColumns({
        "alignment": alignment, "directional_net_ticks": F.when(long, F.col("or_net_ticks")).otherwise(-F.col("or_net_ticks")),
        "directional_location": F.round(F.when(long, F.col("or_close_location")).otherwise(1 - F.col("or_close_location")), 9)})


def half_labels(df: DataFrame, day: str = "trading_date") -> DataFrame:
    """FIRST or SECOND half of the sorted distinct dates (split at floor(n / 2)); the date list is one row per day."""
    dates = df.select(day).distinct()
    order = Window.orderBy(day)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = dates.select(day, F.row_number().over(order).alias("_k"), F.count(F.lit(1)).over(whole).alias("_n"))
    labels = numbered.select(day, F.when(F.col("_k") <= F.floor(F.col("_n") / 2), "FIRST").otherwise("SECOND").alias("half"))
    return df.join(F.broadcast(labels), day)


def width_band(events: DataFrame) -> DataFrame:
    band = F.when(F.col("hist_5_available"), percentile_band(F.col("hist_5_percentile")))
    return events.withColumn("band", F.coalesce(band, F.lit("UNAVAILABLE")))


def combined_state(band: Column, interval_no: Column) -> Column:
    """Three states from the width band and the efficiency interval."""
    narrow, wide = band.isin("P00_20", "P20_40"), band == "P80_100"
    return (F.when(band.isNull() | (band == "UNAVAILABLE") | interval_no.isNull(), F.lit(None))
            .when(narrow & (interval_no >= 4), "NARROW_EFFICIENT").when(wide & (interval_no <= 2), "WIDE_INEFFICIENT").otherwise("COMPARISON"))


def nearest_level_ahead(events: DataFrame, levels: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Nearest known level beyond the broken boundary; equal distances by fixed priority, ties flagged.

    Levels are a handful per instrument and day; each event meets only those of its own day.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("level_type"))
    known = levels.select("instrument_id", F.col("target_date").alias("trading_date"), "level_type", "level_ticks", "available_at",
                          rank.alias("_rank")).filter("_rank > 0")
    long = F.col("direction") == "LONG"
    boundary = F.when(long, F.col("or_high")).otherwise(F.col("or_low"))
    distance = F.when(long, F.col("level_ticks") - boundary).otherwise(boundary - F.col("level_ticks"))
    keys = [*DAY, "breakout_type", "direction", "signal_time", "or_high", "or_low", "or_mid2"]
    met = events.select(*keys).join(known, DAY, "left").withColumn(
        "_d", F.when(F.col("available_at") <= F.col("signal_time"), distance)).withColumn("_d", F.when(F.col("_d") > 0, F.col("_d")))
    best = met.groupBy(*keys).agg(
        F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "_rank", "level_type", "level_ticks"))).alias("_best"),
        F.sort_array(F.collect_list("_d")).alias("_all"))
    room = F.col("_best._d")
    return best.select(
        *DAY, "breakout_type", "direction", F.col("_best.level_type").alias("next_level_type"), F.col("_best.level_ticks").alias("next_level_ticks"),
        room.alias("room_ticks"), F.round(ratio(room, F.col("or_mid2") / 2), 9).alias("room_pct"),
        F.round(ratio(room, F.col("or_high") - F.col("or_low")), 9).alias("room_widths"), F.col("_best").isNull().alias("no_level_ahead"),
        (F.size(F.filter("_all", lambda x: x == room)) > 1).alias("is_tie"))


def relationship_patterns(summary: DataFrame, keys: Sequence[str], order: str, count: int) -> DataFrame:
    """Shape of the ordered medians of each slice: deterioration, monotonic, middle or none; rho of at most five points."""
    packed = summary.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "median_mfe", "median_mae"))).alias("_s"))
    mfe, mae = F.col("_s.median_mfe"), F.col("_s.median_mae")
    complete = (F.size("_s") == count) & ~F.exists(mfe, lambda x: x.isNull()) & ~F.exists(mae, lambda x: x.isNull())
    # average ranks of a short list: smaller values before, plus half of the equal ones
    ranks = F.transform(mfe, lambda x: F.size(F.filter(mfe, lambda y: y < x)) + (F.size(F.filter(mfe, lambda y: y == x)) + 1) / 2.0)
    places = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: i.cast("double"))
    center = (count + 1) / 2.0
    added = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    covariance = added(F.zip_with(ranks, places, lambda a, b: (a - center) * (b - center)))
    spread = added(F.transform(ranks, lambda a: (a - center) * (a - center)))
    fixed = sum((i + 1 - center) ** 2 for i in range(count))
    rho = F.when(complete & (spread > 0), covariance / F.sqrt(spread * fixed))
    rest = count - 1

    def middle(a):
        """Median of all but the last value."""
        ordered = F.sort_array(F.slice(a, 1, rest))
        return (F.element_at(ordered, (rest + 1) // 2) + F.element_at(ordered, rest // 2 + 1)) / 2

    worse = (F.element_at(mfe, count) < middle(mfe)) & (F.element_at(mae, count) > middle(mae))
    peak = F.array_position(mfe, F.array_max(mfe))
    inner = (peak > 1) & (peak < count) & (F.array_max(mfe) > F.element_at(mfe, 1)) & (F.array_max(mfe) > F.element_at(mfe, count))
    pattern = (F.when(~complete, "NO_CLEAR_PATTERN").when(worse, "EXTREME_DETERIORATION").when(rho >= 0.7, "MONOTONIC_MORE")
               .when(rho <= -0.7, "MONOTONIC_LESS").when(inner, "MIDDLE_RANGE_PREFERENCE").otherwise("NO_CLEAR_PATTERN"))
    return packed.select(*keys, pattern.alias("pattern"), r6(rho).alias("rho"))


def dominant_pattern(patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent clear pattern per key; needs two votes, ties by name."""
    votes = patterns.filter("pattern <> 'NO_CLEAR_PATTERN'").groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), "pattern")).alias("_b"))
    every = patterns.select(*keys).distinct().join(best, list(keys), "left")
    support = F.coalesce(-F.col("_b.n"), F.lit(0))
    return every.select(*keys, F.when(support >= 2, F.col("_b.pattern")).otherwise("NO_CLEAR_PATTERN").alias("dominant_pattern"), support.alias("support"))


def half_stability(patterns: DataFrame, counts: DataFrame, keys: Sequence[str], horizon) -> DataFrame:
    """Class of a relationship from its dominant pattern in the full period and both halves (``half``: FULL, FIRST, SECOND).

    ``counts`` holds ``n`` per key, half, state and horizon; states of a half with few events keep a pattern from being a candidate.
    The correlations of both halves are compared at one ``horizon``.
    """
    votes = dominant_pattern(patterns, [*keys, "half"])
    pick = lambda half, column: F.max(F.when(F.col("half") == half, F.col(column)))
    halves = [("FULL", "full"), ("FIRST", "first"), ("SECOND", "second")]
    rows = votes.groupBy(*keys).agg(*[pick(half, "dominant_pattern").alias(f"{to}_pattern") for half, to in halves], *[F.coalesce(pick(half, "support"), F.lit(0)).alias(f"{to}_support") for half, to in halves])
    rho = patterns.filter(F.col("horizon") == horizon).groupBy(*keys).agg(*[pick(half, "rho").alias(f"{to}_rho") for half, to in halves[1:]])
    least = counts.filter((F.col("half") != "FULL") & (F.col("horizon") == horizon)).groupBy(*keys).agg(F.min("n").alias("min_half_n"))
    rows = rows.join(rho, list(keys), "left").join(least, list(keys), "left")
    full, first, second = (F.coalesce(f"{to}_pattern", F.lit("NO_CLEAR_PATTERN")) for _, to in halves)
    full_n, first_n, second_n = (F.col(f"{to}_support") for _, to in halves)
    # Votes, correlation and events that the classes ask for.
    votes_wanted, votes_half, rho_wanted, events_wanted = 3, 2, 0.3, 10
    strong = (F.abs("first_rho") >= rho_wanted) & (F.abs("second_rho") >= rho_wanted)
    opposite = F.coalesce(strong & (F.signum("first_rho") != F.signum("second_rho")), F.lit(False))
    opposed = opposite | ((first_n >= votes_wanted) & (second_n >= votes_wanted) & (first != second))
    none = full == "NO_CLEAR_PATTERN"
    stable = (full == first) & (full == second) & (F.least(full_n, first_n, second_n) >= votes_wanted) & (F.col("min_half_n") >= events_wanted)
    half = ((first == full) & (first_n >= votes_half)) | ((second == full) & (second_n >= votes_half))
    kind = (F.when(none & (F.greatest(full_n, first_n, second_n) < votes_half), "NO_CLEAR_RELATIONSHIP")
            .when(none, F.when(opposed | (first != second), "WEAK_OR_UNSTABLE").otherwise("POTENTIALLY_INFORMATIVE"))
            .when(stable, "CONSISTENT_CANDIDATE_STATE").when(opposed, "WEAK_OR_UNSTABLE")
            .when((full_n >= votes_wanted) & half, "POTENTIALLY_INFORMATIVE").otherwise("WEAK_OR_UNSTABLE"))
    return rows.withColumns({"full_pattern": full, "first_pattern": first, "second_pattern": second, "classification": kind})


def orb_confirmation(events: DataFrame, signals: DataFrame) -> DataFrame:
    """First breakout after each level event of the day: same direction, opposite or none."""
    later = signals.select(*DAY, F.col("direction").alias("_dir"), F.col("signal_time").alias("_at"))
    met = events.join(later, DAY, "left").withColumn("_hit", F.when(F.col("_at") > F.col("event_at"), F.struct("_at", "_dir")))
    first = met.groupBy(*events.columns).agg(F.min("_hit").alias("_first"))
    relation = (F.when(F.col("_first").isNull(), "NONE").when(F.col("_first._dir") == F.col("event_direction"), "SAME").otherwise("OPPOSITE"))
    return first.select(*events.columns, F.col("_first._at").alias("confirmed_at"), relation.alias("confirmation"))
