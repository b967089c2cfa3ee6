"""Streaming forms of bars, activity sessions, breakouts, level touches and first closes beyond.

The batch operators define the meaning; each stream run to the end of its input gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_ticks(source: DataFrame) -> DataFrame:
    """Event rows as ticks; the event value itself is the price (a running walk needs the whole past)."""
    return source.select(F.col("event_type").alias("instrument_id"), "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("price_ticks"))


def stream_bars(ticks: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Tumbling bars; a bar is emitted once the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument_id", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.min_by("price_ticks", order).alias("open"), F.max("price_ticks").alias("high"), F.min("price_ticks").alias("low"),
             F.max_by("price_ticks", order).alias("close"), F.count(F.lit(1)).alias("n"))
        .select("instrument_id", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "n"))


def stream_means(ticks: DataFrame, seconds: int, slide: int, lateness: str) -> DataFrame:
    """Sliding means over time."""
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument_id", F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("price_ticks").alias("total"))
        .select("instrument_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", r6(F.col("total") / F.col("n")).alias("mean_ticks")))


def stream_visits(ticks: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Activity sessions separated by a quiet gap."""
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("instrument_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("price_ticks").alias("high"))
        .select("instrument_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n", "high"))


def stream_dedupe(ticks: DataFrame, keys, lateness: str) -> DataFrame:
    """Drop repeats that arrive within the watermark; state is bounded by it."""
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


BREAKOUT_OUT = "instrument_id string, trading_date date, direction string, signal_slot bigint, signal_time timestamp"
BREAKOUT_STATE = "long_slot bigint, long_at timestamp, short_slot bigint, short_at timestamp"


def _merge_breakouts(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the earliest break per direction; emit once when the watermark passes the session."""
    best = list(state.get) if state.exists else [None] * 4
    if state.hasTimedOut:
        rows = [(*key, name, best[i], best[i + 1]) for i, name in ((0, "LONG"), (2, "SHORT")) if best[i] is not None and best[i] >= 0]
        state.remove()
        yield pd.DataFrame(rows, columns=["instrument_id", "trading_date", "direction", "signal_slot", "signal_time"])
        return
    latest = None
    for pdf in batches:
        latest = pdf["bar_end"].max() if latest is None else max(latest, pdf["bar_end"].max())
        for i, broke in ((0, pdf["close"] > pdf["or_high"]), (2, pdf["close"] < pdf["or_low"])):
            hits = pdf[broke]
            if len(hits):
                row = hits.loc[hits["slot"].idxmin()]
                if best[i] is None or best[i] < 0 or row["slot"] < best[i]:
                    best[i], best[i + 1] = int(row["slot"]), row["bar_end"].to_pydatetime()
    epoch = pd.Timestamp(0).to_pydatetime()
    state.update(tuple(v if v is not None else (-1 if i % 2 == 0 else epoch) for i, v in enumerate(best)))
    deadline = int(pd.Timestamp(latest).timestamp() * 1000)
    state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(columns=["instrument_id", "trading_date", "direction", "signal_slot", "signal_time"])


def stream_breakouts(bars: DataFrame, lateness: str) -> DataFrame:
    """First close beyond the opening range per direction and day (bars carry or_high / or_low)."""
    return bars.withWatermark("bar_end", lateness).groupBy("instrument_id", "trading_date").applyInPandasWithState(
        _merge_breakouts, BREAKOUT_OUT, BREAKOUT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_level_touch(bars: DataFrame, levels: DataFrame, lateness: str) -> DataFrame:
    """Touches of static levels: stream-static equi join on instrument and day, then the price test."""
    right = levels.select("instrument_id", F.col("target_date").alias("trading_date"), "level_id", "level_ticks")
    joined = bars.withWatermark("bar_end", lateness).join(right, ["instrument_id", "trading_date"])
    return joined.filter((F.col("high") >= F.col("level_ticks")) & (F.col("low") <= F.col("level_ticks"))).select("instrument_id", "level_id", "bar_end")


def stream_level_join(bars: DataFrame, levels: DataFrame, lateness: str, longest: str = "24 hours") -> DataFrame:
    """Touches of levels that are themselves a stream: both sides have a watermark and a level meets the bars of its validity.

    A level is valid for at most ``longest`` after ``valid_from``, so bars and levels leave the state once the watermarks
    have passed; neither side is kept whole.
    """
    left = bars.withWatermark("bar_end", lateness).alias("b")
    right = levels.select("instrument_id", "level_id", "level_ticks", "valid_from", "valid_until").withWatermark("valid_from", lateness).alias("l")
    in_time = F.expr(f"b.bar_end > l.valid_from AND b.bar_end <= l.valid_from + INTERVAL {longest} AND b.bar_end <= l.valid_until")
    touched = (F.col("b.high") >= F.col("l.level_ticks")) & (F.col("b.low") <= F.col("l.level_ticks"))
    return left.join(right, (F.col("b.instrument_id") == F.col("l.instrument_id")) & in_time & touched).select("b.instrument_id", "l.level_id", "b.bar_end")


LATEST_OUT = "entity_id string, new_state string, available_at timestamp"


def _latest(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The latest transition of an entity, emitted when it changes; of one instant, the greatest state."""
    best = before = tuple(state.get) if state.exists else None
    for pdf in batches:
        found = max((t.to_pydatetime(), s) for t, s in zip(pdf["available_at"], pdf["new_state"]))
        best = found if best is None else max(best, found)
    if best != before:
        state.update(best)
        yield pd.DataFrame([(*key, best[1], best[0])], columns=["entity_id", "new_state", "available_at"])


def stream_latest_state(transitions: DataFrame) -> DataFrame:
    """Changelog of the latest state per entity (update mode): one row of state per entity, whatever the log's length."""
    return transitions.groupBy("entity_id").applyInPandasWithState(
        _latest, LATEST_OUT, "available_at timestamp, new_state string", "update", GroupStateTimeout.NoTimeout)


def merge_changelog(changes: DataFrame, path: str) -> None:
    """Run a changelog over all available input into a table of changes, one folder per batch.

    A batch that is repeated after a failure replaces its own folder, so the merge is idempotent; a restart goes on from
    the checkpoint below ``path``.
    """
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    query = (changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def merged_state(spark, path: str) -> DataFrame:
    """The latest change of each entity."""
    changes = spark.read.schema(f"{LATEST_OUT}, batch bigint").parquet(f"{path}/changes")
    return changes.groupBy("entity_id").agg(F.max_by("new_state", "batch").alias("state"))


FIRST_OUT = "level_id string, hit_slot bigint, hit_at timestamp"


def stream_first_close_beyond(bars: DataFrame, levels: DataFrame, lateness: str) -> DataFrame:
    """First close beyond each open level of a day, by minimum over the matching bars until the watermark."""
    right = levels.select("instrument_id", F.col("target_date").alias("trading_date"), "level_id", "level_ticks", "orientation")
    joined = bars.withWatermark("bar_start", lateness).join(right, ["instrument_id", "trading_date"])
    hit = F.when(F.col("orientation") == "UPPER", F.col("close") > F.col("level_ticks")).otherwise(F.col("close") < F.col("level_ticks"))
    return joined.filter(hit).groupBy("level_id", F.window("bar_start", "1 day", "1 day", "18 hours").alias("w")).agg(
        F.min(F.struct("slot", "bar_end")).alias("_f")).select("level_id", F.col("_f.slot").alias("hit_slot"), F.col("_f.bar_end").alias("hit_at"))


def late_rows(progress: list) -> int:
    """Rows that came behind the watermark and were left out, over all batches of a run."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def drain(stream: DataFrame, path: str, progress: list | None = None) -> DataFrame:
    """Run a stream over all available input into parquet (exactly-once file sink) and read the result.

    ``progress`` receives the progress reports of the run.
    """
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if progress is not None:
        progress += query.recentProgress
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
