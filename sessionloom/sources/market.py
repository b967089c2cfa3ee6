"""Bars, levels and the trade ledger derived from the driver tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.ordered import running
from sessionloom.operators.bars import continuity_segments
from sessionloom.session import written
from sessionloom.sources import calendar as cal


@dataclass(frozen=True)
class Settings:
    """Bar length in seconds, opening range (start, number of bars) and the last start of an entry bar; the same at every scale."""

    interval: int = 3_600
    range_clock: int = 9 * 3600
    range_bars: int = 3
    cutoff_clock: int = 13 * 3600


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def ticks(events: DataFrame) -> DataFrame:
    """Integer random walk per event type; the running sum is carried across hours, not one big window."""
    step = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1) * F.round(F.col("value") * 100).cast("bigint")
    base = events.select(F.col("event_type").alias("instrument_id"), "ts", "event_id", step.alias("_step"),
                         F.to_date("ts").alias("_day"), F.floor(F.unix_timestamp("ts") / 600).alias("_chunk"))
    walked = running(base, ["instrument_id"], [["_day"], ["_chunk"]], ["ts", "event_id"],
                     {"_walk": ("sum", F.col("_step"))})
    return walked.select("instrument_id", "ts", "event_id", (F.lit(1_000_000) + F.col("_walk")).alias("price_ticks"),
                         F.lit(1).cast("bigint").alias("size"))


def contract_of(day) -> F.Column:
    return F.when(day < F.lit("2024-01-16").cast("date"), "C1").otherwise("C2")


def bars_from_ticks(tick_rows: DataFrame, interval: int) -> DataFrame:
    """Bars on the UTC grid: open / close by (ts, event_id), combinable before the shuffle."""
    start = F.floor(F.unix_timestamp("ts") / F.lit(interval)) * F.lit(interval)
    order = F.struct("ts", "event_id")
    return (
        tick_rows.groupBy("instrument_id", start.alias("_start"))
        .agg(
            F.min_by("price_ticks", order).alias("open"), F.max("price_ticks").alias("high"),
            F.min("price_ticks").alias("low"), F.max_by("price_ticks", order).alias("close"),
            F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
        )
        .select("instrument_id", F.timestamp_seconds("_start").alias("bar_start"),
                F.timestamp_seconds(F.col("_start") + interval).alias("bar_end"),
                "open", "high", "low", "close", "volume", "n")
    )


def calendar_span(events: DataFrame) -> DataFrame:
    return events.agg(F.to_date(F.min("ts")).alias("first_day"), F.date_add(F.to_date(F.max("ts")), 1).alias("last_day"))


# Base tables that many queries of one application start from, written once per data folder.
_KEPT: dict[tuple, DataFrame] = {}


class Market:
    """Lazily built base tables of one data folder.

    Session bars and their segments are written once per application: every pattern, level and trade
    query starts from a scan of them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, spec: cal.SessionSpec = cal.TEST_SPEC, settings: Settings = Settings()):
        self.spark, self.sf_dir, self.spec, self.settings = spark, sf_dir, spec, settings
        self.events = read_table(spark, sf_dir, "events")

    def keep(self, name: str, build) -> DataFrame:
        """Write a shared table once per application and scan it afterwards."""
        key = (self.spark.sparkContext.applicationId, id(self.spark._jsparkSession), self.sf_dir, self.spec, self.settings, name)
        if key not in _KEPT:
            _KEPT[key] = written(build(), name)
        return _KEPT[key]

    @property
    def interval(self) -> int:
        return self.settings.interval

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def ticks(self) -> DataFrame:
        return ticks(self.events)

    def raw_bars(self) -> DataFrame:
        """All bars, in or out of session, with the clock trading date and contract."""
        return self.keep("raw_bars", self._raw_bars)

    def bars(self) -> DataFrame:
        """Bars that start inside an open session, with the ordinal of their expected slot."""
        return self.keep("bars", self._bars)

    def rejected_bars(self) -> DataFrame:
        """Bars in a break, on a closed day or outside the calendar, with the reason."""
        dim = self.calendar().select("trading_date", "kind", F.col("open").alias("_open"), F.col("close").alias("_close"))
        rows = self.raw_bars().join(F.broadcast(dim), "trading_date", "left")
        closed = F.col("kind").isNull() | (F.col("kind") == "CLOSED")
        outside = (F.col("bar_start") < F.col("_open")) | (F.col("bar_start") >= F.col("_close"))
        return rows.filter(closed | outside).select(
            "instrument_id", "trading_date", "bar_start", "bar_end", "volume", F.when(closed, "CLOSED_DAY").otherwise("SESSION_BREAK").alias("reason"))

    def segments(self) -> DataFrame:
        """Session bars with their continuity segment."""
        return self.keep("segments", lambda: continuity_segments(self.bars()))

    def schedule(self) -> DataFrame:
        return cal.expected_schedule(self.calendar(), self.interval)

    def _raw_bars(self) -> DataFrame:
        bars = bars_from_ticks(self.ticks(), self.interval)
        day = cal.session_day(F.col("bar_start"), self.spec)
        return bars.withColumn("trading_date", day).withColumn("contract", contract_of(F.col("trading_date")))

    def calendar(self) -> DataFrame:
        return cal.session_calendar(calendar_span(self.events), self.spec)

    def _bars(self) -> DataFrame:
        dim = cal.with_slots(self.calendar(), self.interval).select(
            "trading_date", "session_no", "grid_start", "slot_offset",
            F.unix_timestamp("open").alias("_open"), F.unix_timestamp("close").alias("_close"))
        start = F.unix_timestamp("bar_start")
        return (
            self.raw_bars().join(F.broadcast(dim), "trading_date")
            .filter((start >= F.col("_open")) & (start < F.col("_close")))
            .withColumn("slot", F.col("slot_offset") + F.floor((start - F.col("grid_start")) / F.lit(self.interval)))
            .select("instrument_id", "contract", "trading_date", "session_no", "slot", "bar_start", "bar_end",
                    "open", "high", "low", "close", "volume", "n")
        )

    def levels(self) -> DataFrame:
        """High, low and close of the previous expected session as levels of the next one."""
        daily = self.bars().groupBy("instrument_id", "trading_date").agg(
            F.first("contract").alias("contract"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "bar_end").alias("close"))
        dates = self.calendar().select("trading_date", F.col("close").alias("available_at"),
                                       F.col("next_session").alias("target_date"))
        target = self.calendar().select(F.col("trading_date").alias("target_date"), F.col("open").alias("valid_from"),
                                        F.col("close").alias("valid_until"))
        daily = daily.join(F.broadcast(dates), "trading_date").join(F.broadcast(target), "target_date")
        return daily.select(
            "instrument_id", "contract", F.col("trading_date").alias("source_trading_date"), "target_date",
            "available_at", "valid_from", "valid_until", F.lit("SPECIFIC").alias("contract_scope"),
            F.expr("stack(3, 'previous_day_high', 'UPPER', high, 'previous_day_low', 'LOWER', low,"
                   " 'previous_day_close', 'NEUTRAL', close) as (level_type, orientation, level_ticks)"),
        ).withColumn("level_id", F.concat_ws(":", "level_type", F.col("target_date").cast("string"), "instrument_id"))


LEDGER_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def ledger(lineitem: DataFrame) -> DataFrame:
    """Trades for the statistics: one per line item, with its ordering key and chunk columns."""
    leg = F.col("l_linenumber") % 3
    return lineitem.select(
        F.concat_ws("-", *[F.col(c).cast("bigint").cast("string") for c in LEDGER_ORDER[1:5]]).alias("trade_ref"),
        F.concat("l_returnflag", "l_linestatus").alias("variant"),
        F.to_date("l_shipdate").alias("session_date"),
        F.col("l_shipdate").alias("entry_time"),
        ((F.col("l_quantity") - 25) / 10).alias("result_r"),
        F.when(F.col("l_linenumber") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
        F.when(leg == 0, "TARGET").when(leg == 1, "STOP").otherwise("SESSION_END").alias("exit_reason"),
        (F.col("l_linenumber") * 5).alias("holding_minutes"),
        F.floor(F.col("l_orderkey") / 65536).alias("order_chunk"),
        *LEDGER_ORDER,
    )


# Chunk columns (coarse to fine) for ordered work on the ledger; monotone in LEDGER_ORDER.
LEDGER_LEVELS = (("session_date",), ("order_chunk",))
