"""Session calendar, expected schedules, named windows, partitions and instruments as dimension tables.

All of them are bounded by the number of calendar days (or by a short literal list), which is why the
fact tables may broadcast them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SessionSpec:
    """Weekly session rule; clock values are seconds of the local day."""

    timezone: str = "UTC"
    open_clock: int = 18 * 3600
    close_clock: int = 17 * 3600
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)
    # (date, kind, close seconds or None): closures and shortened days
    overrides: tuple[tuple[str, str, int | None], ...] = field(default=())


# The exceptions of the test calendar.
TEST_SPEC = SessionSpec(overrides=(("2024-01-15", "CLOSED", None), ("2024-01-17", "MODIFIED", 13 * 3600)))


def local_time(instant: Column, spec: SessionSpec) -> Column:
    return instant if spec.timezone == "UTC" else F.from_utc_timestamp(instant, spec.timezone)


def to_instant(local: Column, spec: SessionSpec) -> Column:
    return local if spec.timezone == "UTC" else F.to_utc_timestamp(local, spec.timezone)


def clock_seconds(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def at_clock(day: Column, seconds: int | Column, spec: SessionSpec) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return to_instant(F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds), spec)


def session_day(instant: Column, spec: SessionSpec) -> Column:
    """Trading date an instant belongs to by the clock: at or after the open counts to the next day."""
    local = local_time(instant, spec)
    return F.date_add(F.to_date(local), (clock_seconds(local) >= spec.open_clock).cast("int"))


def override_table(spark: SparkSession, spec: SessionSpec) -> DataFrame:
    schema = "trading_date string, kind string, close_clock int"
    rows = list(spec.overrides)
    return spark.createDataFrame(rows, schema).withColumn("trading_date", F.to_date("trading_date"))


def with_overrides(spec: SessionSpec, overrides) -> SessionSpec:
    """The same weekly rule with other exceptions."""
    return replace(spec, overrides=tuple(overrides))


def session_calendar(span: DataFrame, spec: SessionSpec) -> DataFrame:
    """One row per weekday session between ``first_day`` and ``last_day`` of the one-row ``span``."""
    spark = span.sparkSession
    days = span.select(F.explode(F.sequence("first_day", "last_day")).alias("trading_date"))
    days = days.filter((F.weekday("trading_date")).isin(*spec.weekdays))
    days = days.join(F.broadcast(override_table(spark, spec)), "trading_date", "left")
    day = F.col("trading_date")
    is_open = F.coalesce(F.col("kind"), F.lit("REGULAR")) != "CLOSED"
    opened = at_clock(F.date_sub(day, 1), spec.open_clock, spec)
    regular_close = at_clock(day, spec.close_clock, spec)
    out = days.select(
        "trading_date",
        F.coalesce("kind", F.lit("REGULAR")).alias("kind"),
        F.when(is_open, opened).alias("open"),
        F.when(is_open, at_clock(day, F.coalesce(F.col("close_clock"), F.lit(spec.close_clock)), spec)).alias("close"),
        opened.alias("regular_open"),
        regular_close.alias("regular_close"),
        F.lit(True).alias("verified"),
    )
    # One row per calendar day: an unpartitioned window over this dimension is bounded.
    order = Window.orderBy("trading_date")
    opens = F.col("open").isNotNull()
    return (
        out.withColumn("session_no", F.when(opens, F.sum(opens.cast("bigint")).over(order)))
        .withColumn("previous_session", F.last(F.when(opens, day), True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("next_session", F.first(F.when(opens, day), True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    )


def with_slots(calendar: DataFrame, interval: int) -> DataFrame:
    """Open sessions with their first grid instant, number of expected bars and running slot offset."""
    grid = F.ceil(F.unix_timestamp("open") / F.lit(interval)) * F.lit(interval)
    count = F.ceil((F.unix_timestamp("close") - grid) / F.lit(interval))
    order = Window.orderBy("trading_date").rowsBetween(Window.unboundedPreceding, -1)
    return (
        calendar.filter(F.col("open").isNotNull())
        .withColumn("grid_start", grid)
        .withColumn("expected_bars", count)
        .withColumn("slot_offset", F.coalesce(F.sum("expected_bars").over(order), F.lit(0)))
    )


def expected_schedule(calendar: DataFrame, interval: int, timeframe: int | None = None) -> DataFrame:
    """Every expected bucket of each open session, empty ones included, clipped to the session.

    ``timeframe`` in seconds gives buckets anchored at the regular open; None gives the base grid.
    """
    if timeframe is None:
        slots = with_slots(calendar, interval)
        out = slots.select("trading_date", "session_no", "slot_offset", "grid_start",
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("expected_bars") - 1)).alias("bucket"))
        start = F.col("grid_start") + F.col("bucket") * interval
        return out.select("trading_date", "session_no", "bucket", (F.col("slot_offset") + F.col("bucket")).alias("slot"),
                          F.timestamp_seconds(start).alias("bar_start"),
                          F.timestamp_seconds(start + interval).alias("bar_end"))
    opened = calendar.filter(F.col("open").isNotNull())
    anchor, first, last = (F.unix_timestamp(c) for c in ("regular_open", "open", "close"))
    low = F.floor((first - anchor) / timeframe)
    high = F.ceil((last - anchor) / timeframe) - 1
    out = opened.withColumn("bucket", F.explode(F.sequence(low, high)))
    nominal = anchor + F.col("bucket") * timeframe
    start = F.greatest(nominal, first)
    end = F.least(nominal + timeframe, last)
    return (
        out.withColumns({"_s": start, "_e": end})
        .filter("_e > _s")
        .select("trading_date", "session_no", "bucket", F.timestamp_seconds("_s").alias("bar_start"),
                F.timestamp_seconds("_e").alias("bar_end"),
                F.floor((F.col("_e") - F.col("_s")) / F.lit(interval)).alias("expected_bars"),
                ((F.col("_e") - F.col("_s")) < timeframe).alias("is_session_truncated"))
    )


def session_status(df: DataFrame, calendar: DataFrame, spec: SessionSpec, instant: str = "bar_start",
                   end: str | None = None) -> DataFrame:
    """Add ``trading_date`` and ``status``: IN_SESSION, MAINTENANCE_BREAK, NON_TRADING_DAY or EXCHANGE_CLOSED."""
    local = local_time(F.col(instant), spec)
    clock = clock_seconds(local)
    in_break = (clock >= spec.close_clock) & (clock < spec.open_clock)
    both = F.weekday(local).isin(*spec.weekdays) & F.weekday(F.date_add(F.to_date(local), 1)).isin(*spec.weekdays)
    dim = calendar.select("trading_date", F.col("open").alias("_open"), F.col("close").alias("_close"))
    out = df.withColumn("trading_date", session_day(F.col(instant), spec))
    out = out.join(F.broadcast(dim), "trading_date", "left")
    inside = F.col("_open").isNotNull() & (F.col(instant) >= F.col("_open")) & (F.col(instant) < F.col("_close"))
    if end is not None:
        inside = inside & (F.col(end) <= F.col("_close"))
    status = (
        F.when(in_break & both, "MAINTENANCE_BREAK")
        .when(in_break, "NON_TRADING_DAY")
        .when(~F.weekday("trading_date").isin(*spec.weekdays), "NON_TRADING_DAY")
        .when(F.coalesce(inside, F.lit(False)), "IN_SESSION")
        .otherwise("EXCHANGE_CLOSED")
    )
    return out.withColumn("status", status).drop("_open", "_close")


WINDOW_SCHEMA = T.StructType([
    T.StructField("context_id", T.StringType(), False),
    T.StructField("start_day", T.IntegerType(), False),
    T.StructField("start_clock", T.IntegerType(), False),
    T.StructField("end_day", T.IntegerType(), False),
    T.StructField("end_clock", T.IntegerType(), False),
    T.StructField("source_session", T.StringType(), False),
])

# Named wall-clock windows (day offset and seconds of day for both ends).
TEST_WINDOWS = (
    ("overnight", -1, 18 * 3600, 0, 9 * 3600, "TARGET"),
    ("asia", -1, 20 * 3600, 0, 0, "TARGET"),
    ("london", 0, 3 * 3600, 0, 6 * 3600, "TARGET"),
    ("previous_rth", 0, 9 * 3600, 0, 16 * 3600, "PREVIOUS_EXPECTED"),
    ("previous_day", -1, 18 * 3600, 0, 17 * 3600, "PREVIOUS_EXPECTED"),
)


def context_windows(spark: SparkSession, rows=TEST_WINDOWS) -> DataFrame:
    return spark.createDataFrame(list(rows), WINDOW_SCHEMA)


# Research partitions by inclusive trading-date range.
TEST_PARTITIONS = (
    ("DEVELOPMENT", "2024-01-01", "2024-01-14"),
    ("VALIDATION", "2024-01-15", "2024-01-22"),
    ("RESERVED", "2024-01-23", "2024-01-31"),
)


def partition_table(spark: SparkSession, rows=TEST_PARTITIONS) -> DataFrame:
    out = spark.createDataFrame(list(rows), "partition string, first_date string, last_date string")
    return out.withColumns({"first_date": F.to_date("first_date"), "last_date": F.to_date("last_date")})


def assign_partition(df: DataFrame, partitions: DataFrame, day: str = "trading_date") -> DataFrame:
    """Attach the research partition whose inclusive date range holds ``day`` (null outside all)."""
    dim = F.broadcast(partitions.select("partition", "first_date", "last_date"))
    hit = (F.col(day) >= F.col("first_date")) & (F.col(day) <= F.col("last_date"))
    return df.join(dim, hit, "left").drop("first_date", "last_date")


def instruments(symbols: DataFrame, tick_size: str = "0.01", point_value: str = "2", currency: str = "USD") -> DataFrame:
    """Instrument rows with exact decimal tick size; ids are trimmed and upper-cased."""
    cleaned = symbols.select(F.upper(F.trim("instrument_id")).alias("instrument_id"))
    return (
        cleaned.filter(F.col("instrument_id") != "").distinct()
        .withColumns({
            "tick_size": F.lit(tick_size).cast("decimal(18,6)"),
            "point_value": F.lit(point_value).cast("decimal(18,6)"),
            "currency": F.lit(currency),
        })
    )
