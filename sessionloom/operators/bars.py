"""Resampling, continuity segments and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.ordered import halo_window, home_rows, running, with_halo

SERIES = ["instrument_id"]


def resample_bars(bars: DataFrame, calendar: DataFrame, interval: int, timeframe: int | None) -> DataFrame:
    """Session-anchored bars of ``timeframe`` seconds; None gives one bar per session.

    One combinable aggregation; a bucket with several contracts keeps a null contract and its count.
    """
    dim = calendar.filter(F.col("open").isNotNull()).select(
        "trading_date", *[F.unix_timestamp(c).alias(f"_{c}") for c in ("open", "close", "regular_open", "regular_close")])
    joined = bars.select("instrument_id", "contract", "trading_date", "session_no", "bar_start", "bar_end", "open",
                         "high", "low", "close", "volume").join(F.broadcast(dim), "trading_date")
    start = F.unix_timestamp("bar_start")
    bucket = F.lit(0).cast("bigint") if timeframe is None else F.floor((start - F.col("_regular_open")) / F.lit(timeframe))
    length = (F.col("_regular_close") - F.col("_regular_open")) if timeframe is None else F.lit(timeframe)
    nominal = F.col("_regular_open") + bucket * length
    joined = joined.withColumns({
        "bucket": bucket, "_s": F.greatest(nominal, F.col("_open")),
        "_e": F.least(nominal + length, F.col("_close")), "_length": length})
    out = joined.groupBy("instrument_id", "trading_date", "session_no", "bucket", "_s", "_e", "_length").agg(
        F.min_by("open", "bar_end").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_end").alias("close"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("observed_bars"),
        F.min("contract").alias("_c0"), F.max("contract").alias("_c1"))
    expected = F.ceil((F.col("_e") - F.ceil(F.col("_s") / interval) * interval) / F.lit(interval))
    return out.select(
        "instrument_id", F.when(F.col("_c0") == F.col("_c1"), F.col("_c0")).alias("contract"), "trading_date",
        "session_no", "bucket", F.timestamp_seconds("_s").alias("bar_start"), F.timestamp_seconds("_e").alias("bar_end"),
        "open", "high", "low", "close", "volume", "observed_bars", expected.alias("expected_bars"),
        (F.col("observed_bars") == expected).alias("is_complete"),
        ((F.col("_e") - F.col("_s")) < F.col("_length")).alias("is_session_truncated"),
        (F.col("_c0") != F.col("_c1")).alias("is_mixed_contract"))


def with_schedule_slots(resampled: DataFrame, schedule: DataFrame) -> DataFrame:
    """Give resampled bars the ordinal of their bucket in the expected schedule.

    The schedule has one row per day and bucket; ordinals come from per-day counts.
    """
    numbered = running(schedule.select("trading_date", "session_no", "bucket").withColumn("_all", F.lit(1)), ["_all"],
                       [["trading_date"]], ["bucket"], {"slot": ("count", F.lit(1))}, exclusive=True)
    return resampled.join(numbered.select("trading_date", "bucket", "slot"), ["trading_date", "bucket"])


def continuity_flags(bars: DataFrame) -> DataFrame:
    """Mark the bars that open a segment: no bar of the same contract in the slot directly before."""
    blocks = with_halo(bars, "slot", 1, 0)
    window = halo_window(SERIES, "slot")
    flagged = blocks.withColumn(
        "starts_segment",
        ~F.coalesce((F.lag("slot").over(window) == F.col("slot") - 1) & (F.lag("contract").over(window) == F.col("contract")),
                    F.lit(False)))
    return home_rows(flagged)


def continuity_segments(bars: DataFrame) -> DataFrame:
    """Add ``segment_id``: the slot of the segment's first bar.  Incomplete bars must be dropped before."""
    return running(continuity_flags(bars), SERIES, [["trading_date"]], ["slot"],
                   {"segment_id": ("max", F.when(F.col("starts_segment"), F.col("slot")))}).drop("starts_segment")


def continuity_breaks(bars: DataFrame) -> DataFrame:
    """One row per break between two bars of a series, with the reason by fixed precedence."""
    flagged = continuity_flags(bars.filter("is_complete") if "is_complete" in bars.columns else bars)
    before = running(
        flagged, SERIES, [["trading_date"]], ["slot"],
        {"previous": ("last", F.struct("slot", "session_no", "contract", "bar_end"))}, exclusive=True)
    gaps = before.filter("starts_segment and previous is not null")
    missing = F.col("slot") - F.col("previous.slot") - 1
    sessions = F.greatest(F.col("session_no") - F.col("previous.session_no") - 1, F.lit(0))
    changed = F.col("contract") != F.col("previous.contract")
    return gaps.select(
        "instrument_id", F.col("previous.bar_end").alias("previous_bar_end"), F.col("bar_end").alias("next_bar_end"),
        F.when(sessions > 0, "MISSING_EXPECTED_SESSION").when(missing > 0, "MISSING_EXPECTED_BUCKET")
        .when(changed, "CONTRACT_CHANGE").alias("reason"),
        missing.alias("missing_buckets"), sessions.alias("missing_sessions"), changed.alias("contract_changed"))


def episodes(segmented: DataFrame, schedule: DataFrame, cutoff=None) -> DataFrame:
    """One row per segment with its reset instant and reason, up to an optional cutoff instant.

    A data gap resets at the end of the first missing expected bucket, a contract change at the end
    of the first new-contract bar.  The end of data (or the cutoff) resets nothing.
    """
    rows = segmented if cutoff is None else segmented.filter(F.col("bar_end") <= cutoff)
    slots = schedule if cutoff is None else schedule.filter(F.col("bar_end") <= cutoff)
    spans = rows.groupBy("instrument_id", "segment_id").agg(
        F.first("contract").alias("contract"), F.min("bar_start").alias("first_bar_start"),
        F.max("bar_end").alias("last_bar_end"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("bars"),
        F.min("trading_date").alias("first_date"))
    after = rows.select("instrument_id", (F.col("slot") - 1).alias("last_slot"), F.col("bar_end").alias("_next_end"))
    due = slots.select((F.col("slot") - 1).alias("last_slot"), F.col("bar_end").alias("_due_end"))
    joined = spans.join(after, ["instrument_id", "last_slot"], "left").join(due, "last_slot", "left")
    ordered = running(joined, SERIES, [["first_date"]], ["segment_id"],
                      {"_previous": ("last", F.struct("contract", "last_slot"))}, exclusive=True)
    cause = (F.when(F.col("_previous").isNull(), "DATA_START")
             .when(F.col("_previous.last_slot") == F.col("segment_id") - 1, "CONTRACT_CHANGE_REESTABLISHMENT")
             .otherwise("DATA_GAP_REESTABLISHMENT"))
    return ordered.select(
        "instrument_id", "segment_id", "contract", "first_bar_start", "last_bar_end", "last_slot", "bars",
        F.coalesce("_next_end", "_due_end").alias("reset_at"),
        F.when(F.col("_next_end").isNotNull(), "CONTRACT_CHANGE").when(F.col("_due_end").isNotNull(), "DATA_GAP")
        .alias("reset_reason"),
        cause.alias("opening_cause"), F.col("_previous.contract").alias("previous_contract"))


def timeframe_segments(bars: DataFrame, calendar: DataFrame, schedule: DataFrame, interval: int, timeframe: int) -> DataFrame:
    """Complete session-anchored bars of a timeframe, numbered by its expected schedule, with their continuity segment."""
    grid = resample_bars(bars, calendar, interval, timeframe).filter("is_complete and not is_mixed_contract")
    return continuity_segments(with_schedule_slots(grid, schedule))


def minute_tape(segmented: DataFrame, episode_rows: DataFrame) -> DataFrame:
    """Base bars with their episode and its reset."""
    info = episode_rows.select("instrument_id", "segment_id", "reset_at", "reset_reason")
    return segmented.join(info, ["instrument_id", "segment_id"])
