"""Bar x level facts and first-touch joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.ordered import position, running
from sessionloom.functions.rangejoin import points_in_intervals
from sessionloom.functions.scalars import LOWER, NEUTRAL, UPPER, threshold_ticks
from sessionloom.functions.search import first_beyond
from sessionloom.session import written


def interaction_facts(pairs: DataFrame, interactions_only: bool = False) -> DataFrame:
    """Status, approach side and touch / trade / close / reject / sweep of (bar, level) rows.

    Expects bar columns, ``bar_contract`` and the level columns; ticks are integers on both sides.
    """
    level, o, h, lo, c = (F.col(n) for n in ("level_ticks", "open", "high", "low", "close"))
    pending = F.col("bar_start") < F.col("available_at")
    mismatch = (F.col("contract_scope") == "SPECIFIC") & (F.col("bar_contract") != F.col("level_contract"))
    below, above = o < level, o > level
    at = o == level
    upward = below | (at & (F.col("orientation") == UPPER))
    unclear = at & (F.col("orientation") == NEUTRAL)
    status = (F.when(pending, "PENDING_LEVEL").when(mismatch, "CONTRACT_MISMATCH").when(unclear, "AMBIGUOUS_APPROACH")
              .otherwise("EVALUATED"))
    out = pairs.withColumn("status", status)
    active = F.col("status").isin("EVALUATED", "AMBIGUOUS_APPROACH")
    evaluated = F.col("status") == "EVALUATED"
    touch = F.when(upward, h >= level).otherwise(lo <= level) | unclear
    trade = F.when(upward, h > level).otherwise(lo < level)
    through = F.when(upward, c > level).otherwise(c < level)
    back = F.when(upward, c <= level).otherwise(c >= level)
    origin = ((F.col("orientation") == UPPER) & upward) | ((F.col("orientation") == LOWER) & ~upward)
    relation = F.when(F.col("orientation") == NEUTRAL, F.lit(None)).when(origin, "ORIGINAL_SIDE").otherwise("FAR_SIDE")
    out = out.withColumns({
        "approach_side": F.when(active, F.when(below, "BELOW").when(above, "ABOVE").otherwise("AT")),
        "approach_relation": F.when(evaluated, relation),
        "touch": F.when(active, touch), "trade_through": F.when(evaluated, trade),
        "close_through": F.when(evaluated, through), "reject": F.when(evaluated, touch & back),
        "sweep": F.when(evaluated, trade & back),
        **{f"{n}_offset_ticks": F.when(active, F.col(n) - level) for n in ("open", "high", "low", "close")},
    })
    return out.filter("touch") if interactions_only else out


BAR_FACTS = ["instrument_id", "bar_start", "bar_end", "bar_contract", "level_id", "level_ticks", "orientation",
             "level_contract", "available_at", "valid_from", "valid_until", "status", "approach_side",
             "approach_relation", "touch", "trade_through", "close_through", "reject", "sweep", "open_offset_ticks",
             "high_offset_ticks", "low_offset_ticks", "close_offset_ticks"]


def bar_level_interactions(bars: DataFrame, levels: DataFrame, interactions_only: bool = False) -> DataFrame:
    """Facts for every bar inside a level's validity; the range join runs on (instrument, day) buckets."""
    left = bars.select("instrument_id", F.col("contract").alias("bar_contract"), "bar_start", "bar_end", "open", "high",
                       "low", "close")
    right = levels.select("instrument_id", "level_id", "level_ticks", "orientation", "contract_scope",
                          F.col("contract").alias("level_contract"), "available_at", "valid_from", "valid_until")
    pairs = points_in_intervals(left, right, ["instrument_id"], "bar_start", "valid_from", "valid_until")
    pairs = pairs.filter(F.col("bar_end") >= F.col("available_at"))
    return interaction_facts(pairs, interactions_only).select(*BAR_FACTS)


def window_level_interactions(windows: DataFrame, levels: DataFrame) -> DataFrame:
    """The same facts for one aggregated window per day (open, high, low, close over the window)."""
    right = levels.select("instrument_id", F.col("target_date").alias("trading_date"), "level_id", "level_type",
                          "level_ticks", "orientation", "contract_scope", F.col("contract").alias("level_contract"),
                          "available_at")
    left = windows.withColumnRenamed("contract", "bar_contract")
    facts = interaction_facts(left.join(right, ["instrument_id", "trading_date"]))
    return facts.select("instrument_id", "trading_date", "level_id", "level_type", "orientation", "level_ticks", "status",
                        "approach_side", "touch", "trade_through", "close_through", "reject", "sweep")


def first_touches(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """First touch and first trade-through of each level inside its validity."""
    facts = bar_level_interactions(bars, levels, interactions_only=True)
    return facts.groupBy("instrument_id", "level_id").agg(
        F.min("bar_end").alias("first_touch_at"),
        F.min(F.when(F.col("trade_through"), F.col("bar_end"))).alias("first_trade_through_at"),
        F.min(F.when(F.col("close_through"), F.col("bar_end"))).alias("first_close_through_at"),
        F.count(F.lit(1)).alias("touches"))


def first_consumption(versions: DataFrame, segmented: DataFrame, episodes: DataFrame) -> DataFrame:
    """First bar beyond price +/- tolerance of the version in force, else termination or still active.

    ``versions``: object_id, side, instrument_id, segment_id, from_slot (first slot the version governs),
    until_slot (last slot, null for the last version), price_ticks, tolerance_ticks, stop_at / stop_reason.
    """
    levels = versions.withColumn("_theta", threshold_ticks(F.col("side"), F.col("price_ticks"), F.col("tolerance_ticks")))
    hits = first_beyond(levels, segmented, ["instrument_id", "segment_id"], ordinal="slot", above="high", below="low",
                        start="from_slot", threshold="_theta", side="side", out="_hit", last="until_slot")
    best = hits.groupBy("object_id", "instrument_id", "segment_id", "side").agg(
        F.min("from_slot").alias("first_slot"), F.min("_hit").alias("hit_slot"),
        F.min(F.when(F.col("_hit").isNotNull(), F.struct("_hit", "_theta", "price_ticks"))).alias("_best"))
    bar = segmented.select("instrument_id", F.col("slot").alias("hit_slot"), F.col("bar_end").alias("consumed_at"),
                           F.col("open").alias("_o"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    out = best.join(bar, ["instrument_id", "hit_slot"], "left").join(
        episodes.select("instrument_id", "segment_id", "reset_at", "reset_reason"), ["instrument_id", "segment_id"], "left")
    theta, up = F.col("_best._theta"), F.col("side") == UPPER
    consumed = F.col("hit_slot").isNotNull()
    status = F.when(consumed, "CONSUMED").when(F.col("reset_at").isNotNull(), "TERMINATED").otherwise("ACTIVE")
    return out.select(
        "object_id", "instrument_id", "segment_id", "side", status.alias("status"),
        F.coalesce("consumed_at", F.when(~consumed, F.col("reset_at"))).alias("ended_at"),
        F.when(consumed, F.lit("CONSUMED")).otherwise(F.col("reset_reason")).alias("reason"),
        theta.alias("threshold_ticks"),
        F.when(up, F.col("_h") - theta).otherwise(theta - F.col("_l")).alias("excess_ticks"),
        F.when(up, F.col("_o") > theta).otherwise(F.col("_o") < theta).alias("gap_through"),
        "first_slot", "hit_slot")


def cross_timeframe_match(high_swings: DataFrame, low_swings: DataFrame) -> DataFrame:
    """Lower-timeframe swings of the same side and price inside the source span of a higher-timeframe swing."""
    keys = ["instrument_id", "orientation", "price_ticks"]
    high = high_swings.select(*keys, F.col("swing_id").alias("high_id"), F.col("span_start").alias("h0"),
                              F.col("span_end").alias("h1"), F.col("available_at").alias("high_at"))
    low = low_swings.select(*keys, F.col("swing_id").alias("low_id"), "source_end_at", F.col("available_at").alias("low_at"))
    inside = high.join(low, keys, "left").filter(
        F.col("low_id").isNull() | ((F.col("source_end_at") > F.col("h0")) & (F.col("source_end_at") <= F.col("h1"))))
    found = inside.groupBy("high_id").agg(F.count("low_id").alias("matches"), F.min("low_at").alias("first_low_at"))
    return high.join(found, "high_id", "left").select(
        "instrument_id", "orientation", "price_ticks", F.col("high_id").alias("swing_id"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
        (F.unix_timestamp("high_at") - F.unix_timestamp("first_low_at")).alias("lead_seconds"))


def latest_version(df: DataFrame, keys, order: str) -> DataFrame:
    """The last row per key."""
    columns = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in columns])


def separated_equal_pairs(swings: DataFrame, right: int) -> DataFrame:
    """Consecutive swings of one side at the same price, close together but not one plateau."""
    window = Window.partitionBy("instrument_id", "segment_id", "orientation").orderBy("first_slot")
    before = swings.withColumns({"_p": F.lag("price_ticks").over(window), "_s": F.lag("last_slot").over(window),
                                 "previous_swing_id": F.lag("swing_id").over(window)})
    return before.filter((F.col("_p") == F.col("price_ticks")) & (F.col("first_slot") - F.col("_s") <= right + 1)).select(
        "instrument_id", "orientation", "price_ticks", "previous_swing_id", "swing_id",
        (F.col("first_slot") - F.col("_s")).alias("slot_distance"))


def closest_earlier_above(days: DataFrame, price: str, reference: str, when: str, keys: list[str]) -> DataFrame:
    """For each row the nearest ``price`` above its ``reference`` among earlier rows of its series; the earliest on ties.

    Rows ordered by price form a series whose values are their dates.  The candidates above a reference start at one place
    of it, and the nearest earlier one is the first from there on whose date lies before: a first-beyond search on dates.
    Work is in proportion to the rows; no pairs of rows are built.
    """
    rows = days.select(*keys, when, F.col(price).alias("_price"), F.col(reference).alias("_reference"), F.unix_date(when).cast("long").alias("_day"))
    wide = 4096
    ordered = written(position(rows.withColumn("_chunk", F.floor(F.col("_price") / wide)), keys, [["_chunk"]], ["_price", when], "_place"), "by_price")
    marks = ordered.select(*keys, F.col("_price").alias("_at"), F.lit(0).alias("_kind"), when).unionByName(
        ordered.select(*keys, F.col("_reference").alias("_at"), F.lit(1).alias("_kind"), when))
    marks = running(marks.withColumn("_chunk", F.floor(F.col("_at") / wide)), keys, [["_chunk"]], ["_at", "_kind", when],
                    {"_start": ("count", F.when(F.col("_kind") == 0, 1).otherwise(0))})
    asked = marks.filter("_kind = 1").select(*keys, when, F.col("_at").alias("_reference"), "_start", F.unix_date(when).cast("long").alias("_before"), F.lit("LOWER").alias("_side"))
    found = first_beyond(asked, ordered, keys, ordinal="_place", above="_day", below="_day", start="_start", threshold="_before", side="_side", out="_place")
    nearest = ordered.select(*keys, "_place", F.col(when).alias("source_date"), F.col("_price").alias("source_price"))
    return found.join(nearest, [*keys, "_place"]).select(*keys, when, "source_date", (F.col("source_price") - F.col("_reference")).alias("distance_ticks"))
