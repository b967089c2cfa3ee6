"""Transition logs, as-of views and state at observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.ids import natural_id, utc_text
from sessionloom.functions.ordered import position
from sessionloom.functions.rangejoin import points_in_intervals


def zone_transitions(life: DataFrame) -> DataFrame:
    """Append-only log of zone states: FVG to IFVG, then to the exit state."""
    moves = F.array(
        F.struct(F.lit("FVG").alias("previous_state"), F.lit("IFVG").alias("new_state"), F.col("converted_at").alias("transition_at"), F.lit("CONVERTED").alias("reason_code")),
        F.struct(F.when(F.col("converted_at").isNotNull(), "IFVG").otherwise("FVG").alias("previous_state"), F.col("exit_kind").alias("new_state"),
                 F.col("exit_at").alias("transition_at"), F.col("exit_kind").alias("reason_code")))
    rows = life.select("zone_id", "instrument_id", "contract", F.inline(F.filter(moves, lambda t: t["transition_at"].isNotNull())))
    rows = rows.withColumnRenamed("zone_id", "entity_id").withColumn("available_at", F.col("transition_at"))
    return rows.withColumn("transition_id", natural_id("st_", F.col("entity_id"), F.col("previous_state"), F.col("new_state"), utc_text(F.col("transition_at"))))


def state_intervals(transitions: DataFrame, entities: DataFrame, initial: str) -> DataFrame:
    """One row per entity and state with the instants between which it is the latest known state."""
    start = entities.select("entity_id", "instrument_id", F.lit(initial).alias("state"), F.col("available_at").alias("from_at"), F.lit(None).cast("string").alias("transition_id"), F.lit(0).alias("_k"))
    moves = transitions.select("entity_id", "instrument_id", F.col("new_state").alias("state"), F.col("available_at").alias("from_at"), "transition_id", F.lit(1).alias("_k"))
    order = Window.partitionBy("entity_id").orderBy("from_at", "_k")
    return start.unionByName(moves).withColumn("until_at", F.lead("from_at").over(order)).drop("_k")


def state_as_of(transitions: DataFrame, entities: DataFrame, initial: str, at: Column) -> DataFrame:
    """State known strictly before ``at``; null state for entities not applicable then."""
    seen = transitions.filter(F.col("available_at") < at).groupBy("entity_id").agg(
        F.max_by(F.struct("new_state", "transition_id"), F.struct("available_at", "new_state")).alias("_s"))
    applicable = F.col("available_at") < at
    if "valid_until" in entities.columns:
        applicable = applicable & (F.col("valid_until").isNull() | (F.col("valid_until") > at))
    rows = entities.join(seen, "entity_id", "left").withColumn("applicable", applicable)
    return rows.select("entity_id", "applicable", F.when(F.col("applicable"), F.coalesce("_s.new_state", F.lit(initial))).alias("state"),
                       F.when(F.col("applicable"), F.col("_s.transition_id")).alias("transition_id"))


def state_at_points(intervals: DataFrame, points: DataFrame, point: str, *, strict: bool, closed: Sequence[str], seconds: int = 86400) -> DataFrame:
    """State of every live entity at each point of its instrument (bucketed range join).

    ``strict`` hides a state that becomes known exactly at the point; ``closed`` lists final states that end
    an entity's applicability.
    """
    live = intervals.filter(~F.col("state").isin(*closed)) if closed else intervals
    latest = points.groupBy("instrument_id").agg(F.max(point).alias("_latest"))
    live = live.join(latest, "instrument_id")
    shift = F.expr("INTERVAL 1 MICROSECOND")
    end = F.coalesce("until_at", F.col("_latest") + shift)
    bounds = live.withColumns({"_from": F.col("from_at") + shift if strict else F.col("from_at"),
                               "_until": F.when(F.col("until_at").isNotNull() & F.lit(strict), end + shift).otherwise(end)}).drop("_latest").filter("_until > _from")
    return points_in_intervals(points, bounds, ["instrument_id"], point, "_from", "_until", seconds=seconds).drop("_from", "_until")


def as_of(df: DataFrame, at: Column, available: str, ends: str, hidden: Sequence[str]) -> DataFrame:
    """Rows known at ``at``; end columns that lie in the future are nulled."""
    later = F.col(ends) > at
    return df.filter(F.col(available) <= at).withColumns({c: F.when(later, F.lit(None)).otherwise(F.col(c)) for c in hidden})


def active_zones(stages: DataFrame, zones: DataFrame, events: DataFrame, overlaps: DataFrame, at: Column) -> DataFrame:
    """Zones open at ``at`` with the first contacts of their stage, overlap count and priority rank."""
    open_now = as_of(stages, at, "stage_start", "stage_end", ("stage_end", "end_kind")).filter("stage_end is null")
    first = lambda k: F.min(F.when(F.col("event_kind") == k, F.col("bar_end")))
    seen = events.filter(F.col("bar_end") <= at).groupBy("zone_id", "stage").agg(
        first("PENETRATION").alias("first_mitigation_at"), first("MIDPOINT").alias("midpoint_reached_at"), first("FULL").alias("full_reached_at"),
        first("GAP_THROUGH").alias("gap_through_at"), F.max(F.when(F.col("event_kind") == "DEPTH", F.col("depth_ticks"))).alias("max_depth_ticks"))
    partners = as_of(overlaps.filter("label = 'FVG_OVERLAP'"), at, "created_at", "ended_at", ("ended_at", "end_reason")).filter("ended_at is null")
    counted = partners.select(F.explode(F.array("zone_a", "zone_b")).alias("zone_id")).groupBy("zone_id").agg(F.count(F.lit(1)).alias("overlap_contribution"))
    view = open_now.select("zone_id", "instrument_id", "contract", "stage", "current_direction", "stage_start").join(
        zones.select("zone_id", "lower_ticks", "upper_ticks", "width_ticks", "strength", "normalization_status", "available_at"), "zone_id").join(
        seen, ["zone_id", "stage"], "left").join(counted, "zone_id", "left")
    return view.withColumn("overlap_contribution", F.coalesce("overlap_contribution", F.lit(0)))


def rank_zones(view: DataFrame) -> DataFrame:
    """Priority inside each instrument: overlaps, known strength, width, then earlier and smaller id."""
    known = F.when(F.col("normalization_status") == "OK", F.col("strength").cast("double"))
    rows = view.withColumns({"_o": -F.col("overlap_contribution"), "_s": -F.coalesce(known, F.lit(-1e300)), "_w": -F.col("width_ticks")})
    rows = rows.withColumn("_k", F.floor(F.greatest(F.col("_s"), F.lit(-1e6)) * 16))
    return ranked(rows, ["instrument_id"], [["_o"], ["_k"]], ["_o", "_s", "_w", "available_at", "zone_id"], "priority_rank").drop("_o", "_s", "_w", "_k")


def ranked(rows: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[str]], order: Sequence[str], name: str) -> DataFrame:
    """Rank from 1 in ``order`` per key, from counts of ordered chunks; no key meets in one task."""
    return position(rows, keys, levels, order, name).withColumn(name, (F.col(name) + 1).cast("bigint"))


def reset_warnings(life: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per reset: how many zones it ended, and whether the contract changed."""
    ended = life.filter("exit_kind in ('TERMINATED', 'PENDING')").groupBy("instrument_id", "segment_id").agg(F.count(F.lit(1)).alias("ended_objects"))
    return episodes.filter("reset_at is not null").join(ended, ["instrument_id", "segment_id"], "left").select(
        "instrument_id", "contract", "reset_at", "reset_reason", F.coalesce("ended_objects", F.lit(0)).alias("ended_objects"))


def pending_across_contracts(stopped: DataFrame, episodes: DataFrame) -> DataFrame:
    """Objects that a contract change left open, with the contract that follows: prices of the two are compared unadjusted.

    ``stopped`` holds rows of ``instrument_id, segment_id`` and further columns; those of segments that end otherwise go.
    """
    following = episodes.select("instrument_id", (F.col("segment_id") - 1).alias("last_slot"), F.col("contract").alias("next_contract"))
    change = episodes.filter("reset_reason = 'CONTRACT_CHANGE'").select("instrument_id", "segment_id", "last_slot", F.col("reset_at").alias("since_at"), F.col("reset_reason").alias("reason"))
    change = change.join(following, ["instrument_id", "last_slot"], "left").drop("last_slot")
    return stopped.join(change, ["instrument_id", "segment_id"]).withColumn("comparison_scope", F.lit("CROSS_CONTRACT_RAW"))


def touch_visits(touches: DataFrame) -> DataFrame:
    """Runs of consecutive touching bars of one stage, numbered, with flags and maxima."""
    stage = Window.partitionBy("zone_id", "stage").orderBy("slot")
    rows = touches.withColumn("_new", (F.coalesce(F.lag("slot").over(stage) != F.col("slot") - 1, F.lit(True))).cast("int"))
    rows = rows.withColumn("visit_no", F.sum("_new").over(stage))
    return rows.groupBy("zone_id", "stage", "visit_no").agg(
        F.min("bar_end").alias("first_touch_at"), F.max("bar_end").alias("last_touch_at"), F.count(F.lit(1)).alias("bars"),
        F.bool_or("is_midpoint").alias("reached_midpoint"), F.bool_or("is_full").alias("reached_full"), F.max("depth_ticks").alias("max_depth_ticks"))


def review_queue(rows: DataFrame, rank: str, order: Sequence[str], size: int = 24) -> DataFrame:
    """The first ``size`` rows to look at: the first of each stratum, then the others, each in ``order`` (a distributed take)."""
    return rows.orderBy(F.when(F.col(rank) == 1, 0).otherwise(1), *order).limit(size)
