"""Streams drained to their end; the batch form is the counterpart."""
import uuid

from pyspark.sql import functions as F

from sessionloom.catalog.registry import query
from sessionloom.catalog.trades import or_levels
from sessionloom.operators import setops as H
from sessionloom.session import shared_folder
from sessionloom.streaming import bars as N

LATE = "1 hour"


def place(m):
    return f"{shared_folder(m.spark)}/sessionloom/{uuid.uuid4().hex}"


def events_stream(m):
    schema = m.spark.read.parquet(f"{m.sf_dir}/events.parquet").schema
    raw = m.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(m.sf_dir)
    return N.stream_ticks(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def bars_stream(m, df, name):
    path = place(m)
    df.write.parquet(f"{path}/{name}")
    return m.spark.readStream.schema(df.schema).parquet(f"{path}/{name}")


def slices_stream(m, slices, name):
    """A stream whose batches are the given tables, in this order."""
    path = f"{place(m)}/{name}"
    for rows in slices:
        rows.coalesce(1).write.mode("append").parquet(path)
    return m.spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


TICK = "SELECT event_type AS instrument_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS price_ticks FROM events"
# A window is emitted once the watermark (latest event minus one hour) has passed its end.
MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("N01_stream_bars", f"""
SELECT instrument_id, b AS bar_start, b + INTERVAL 1 HOUR AS bar_end, arg_min(price_ticks, (ts, event_id)) AS open, max(price_ticks) AS high, min(price_ticks) AS low, arg_max(price_ticks, (ts, event_id)) AS close, count(*) AS n
FROM (SELECT *, date_trunc('hour', ts) AS b FROM ({TICK})) WHERE b + INTERVAL 1 HOUR <= {MARK} GROUP BY 1, 2""")
def _(m):
    return N.drain(N.stream_bars(events_stream(m), 3600, LATE), place(m))


@query("N02_stream_sliding_means", f"""
SELECT instrument_id, w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n, round(sum(price_ticks) / count(*), 6) AS mean_ticks
FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM ({TICK})) WHERE w + INTERVAL 2 HOUR <= {MARK} GROUP BY 1, 2""")
def _(m):
    return N.drain(N.stream_means(events_stream(m), 7200, 3600, LATE), place(m))


@query("N03_stream_sessions", f"""
SELECT instrument_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS closed_at, count(*) AS n, max(price_ticks) AS high
FROM (SELECT *, sum(nw) OVER (PARTITION BY instrument_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY instrument_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, TRUE) THEN 1 ELSE 0 END AS nw FROM ({TICK})))
GROUP BY instrument_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= {MARK}""")
def _(m):
    return N.drain(N.stream_visits(events_stream(m), "30 minutes", LATE), place(m))


def ranged_bars(m):
    s = m.settings
    clock = F.unix_timestamp("bar_start") - F.unix_timestamp(F.col("trading_date").cast("timestamp"))
    rows = m.bars().filter((clock >= s.range_clock + s.range_bars * s.interval) & (clock <= s.cutoff_clock))
    levels = or_levels(m).filter("valid").select("instrument_id", "trading_date", "or_high", "or_low")
    return rows.join(levels, ["instrument_id", "trading_date"]).select("instrument_id", "trading_date", "slot", "bar_end", "close", "or_high", "or_low")


@query("N04_stream_breakouts", """
SELECT s.instrument_id, s.trading_date, s.direction, s.signal_slot, s.signal_time FROM signals s JOIN (SELECT instrument_id, trading_date, max(bar_end) AS z FROM eligible GROUP BY 1, 2) d USING (instrument_id, trading_date)
WHERE s.breakout_type = 'CLOSE' AND d.z < (SELECT max(bar_end) - INTERVAL 1 HOUR FROM eligible)""")
def _(m):
    return N.drain(N.stream_breakouts(bars_stream(m, ranged_bars(m), "ranged"), LATE), place(m))


def day_bars(m):
    return m.bars().select("instrument_id", "trading_date", "slot", "bar_start", "bar_end", "high", "low", "close")


@query("N05_stream_level_touch", """
SELECT b.instrument_id, l.level_id, b.bar_end FROM bars b JOIN levels l ON l.instrument_id = b.instrument_id AND l.target_date = b.trading_date AND b.high >= l.level_ticks AND b.low <= l.level_ticks""")
def _(m):
    return N.drain(N.stream_level_touch(bars_stream(m, day_bars(m), "bars"), m.levels(), LATE), place(m))


def in_thirds(rows, day):
    """The rows of three periods, by days since the first of 2024."""
    third = F.least(F.floor(F.datediff(F.col(day), F.lit("2024-01-01").cast("date")) / 10), F.lit(2))
    return [rows.filter(third == k) if k else rows.filter(third <= 0) for k in range(3)]


@query("N05_stream_level_join", """
SELECT b.instrument_id, l.level_id, b.bar_end FROM bars b JOIN levels l ON l.instrument_id = b.instrument_id AND b.bar_end > l.valid_from AND b.bar_end <= l.valid_until AND b.high >= l.level_ticks AND b.low <= l.level_ticks""")
def _(m):
    bars = slices_stream(m, in_thirds(day_bars(m), "trading_date"), "bars")
    levels = slices_stream(m, in_thirds(m.levels().select("instrument_id", "level_id", "level_ticks", "valid_from", "valid_until", "target_date"), "target_date"), "levels")
    return N.drain(N.stream_level_join(bars, levels, "2 hours"), place(m))


@query("N06_stream_first_close_beyond", """
SELECT level_id, slot AS hit_slot, bar_end AS hit_at FROM (SELECT l.level_id, b.slot, b.bar_start, b.bar_end FROM bars b JOIN levels l ON l.instrument_id = b.instrument_id AND l.target_date = b.trading_date
 AND l.orientation <> 'NEUTRAL' AND CASE l.orientation WHEN 'UPPER' THEN b.close > l.level_ticks ELSE b.close < l.level_ticks END QUALIFY row_number() OVER (PARTITION BY l.level_id ORDER BY b.slot) = 1)
WHERE CAST(bar_start - INTERVAL 18 HOUR AS DATE) + INTERVAL 42 HOUR <= (SELECT max(bar_start) - INTERVAL 1 HOUR FROM bars)""")
def _(m):
    levels = m.levels().filter("orientation <> 'NEUTRAL'")
    return N.drain(N.stream_first_close_beyond(bars_stream(m, day_bars(m), "bars"), levels, LATE), place(m))


@query("N07_stream_dedupe", "SELECT instrument_id, min_ts AS minute, count(*) AS n FROM (SELECT DISTINCT event_type AS instrument_id, date_trunc('minute', ts) AS min_ts FROM events) GROUP BY 1, 2")
def _(m):
    ticks = events_stream(m).withColumn("minute", F.date_trunc("minute", "ts"))
    once = N.drain(N.stream_dedupe(ticks, ("instrument_id", "minute"), LATE).select("instrument_id", "minute"), place(m))
    return once.groupBy("instrument_id", "minute").agg(F.count(F.lit(1)).alias("n"))


# Odd events follow the even ones in a third batch.  Rows are late by the watermark of the batch before the last.
_LATE = "SELECT e.*, event_id % 2 = 1 AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events WHERE event_id % 4 = 0) AS is_late FROM events e"


@query("N07_late_rows", f"""
SELECT count(*) AS rows_in, CAST(count_if(is_late) AS BIGINT) AS late, count(DISTINCT CASE WHEN NOT is_late THEN (event_type, date_trunc('minute', ts)) END) AS kept FROM ({_LATE})""")
def _(m):
    ticks = m.events.select(F.col("event_type").alias("instrument_id"), "ts", "event_id")
    batches = [ticks.filter(f"event_id % 4 = {k}") for k in (0, 2)] + [ticks.filter("event_id % 2 = 1")]
    stream = slices_stream(m, batches, "ticks").withColumn("minute", F.date_trunc("minute", "ts"))
    progress = []
    once = N.drain(N.stream_dedupe(stream, ("instrument_id", "minute"), LATE).select("instrument_id", "minute"), place(m), progress)
    return once.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(sum(p["numInputRows"] for p in progress)).cast("bigint").alias("rows_in"), F.lit(N.late_rows(progress)).cast("bigint").alias("late"), "kept")


@query("N08_replay_equality", "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM prm")
def _(m):
    columns = ["instrument_id", "level_id", "bar_end"]
    streamed = N.drain(N.stream_level_touch(bars_stream(m, day_bars(m), "bars"), m.levels(), LATE), place(m))
    batch = N.stream_level_touch(day_bars(m), m.levels(), LATE)
    return H.reconcile_counts(streamed.select(*columns), batch.select(*columns))


@query("N09_state_changelog", "SELECT entity_id, arg_max(new_state, (available_at, new_state)) AS state FROM transitions GROUP BY 1")
def _(m):
    from sessionloom.catalog.zquality import transitions
    log = N.drain(bars_stream(m, transitions(m), "log"), place(m))
    return log.groupBy("entity_id").agg(F.max_by("new_state", F.struct("available_at", "new_state")).alias("state"))


@query("N09_keyed_state", "SELECT entity_id, arg_max(new_state, (available_at, new_state)) AS state FROM transitions GROUP BY 1")
def _(m):
    from sessionloom.catalog.zquality import transitions
    log = transitions(m).select("entity_id", "new_state", "available_at")
    path, log_path = place(m), f"{place(m)}/log"
    # the run stops after the first half of the log and goes on from its checkpoint when the second half is there
    for half in (0, 1):
        log.filter(F.pmod(F.xxhash64("entity_id", "available_at"), F.lit(2)) == half).coalesce(1).write.mode("append").parquet(log_path)
        N.merge_changelog(N.stream_latest_state(m.spark.readStream.schema(log.schema).parquet(log_path)), path)
    return N.merged_state(m.spark, path)
