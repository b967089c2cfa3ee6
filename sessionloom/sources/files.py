"""File sources and sinks: bar text, levels, dated ranges, derived-bar store, partitions and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_TEXT = "timestamp_et string, contract string, open double, high double, low double, close double, volume bigint"
BUILDER_VERSION = "bars-1"


def read_bars(spark: SparkSession, path, fmt: str = "csv", timezone: str = "America/New_York") -> DataFrame:
    """Scan bar files and type them; only the needed columns are read."""
    raw = spark.read.schema(BAR_TEXT).option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return typed_bars(raw.select("timestamp_et", "contract", "open", "high", "low", "close", "volume"), timezone)


def typed_bars(raw: DataFrame, timezone: str) -> DataFrame:
    """Offset timestamps to instants, plus exchange wall clock and its date."""
    instant = F.to_timestamp("timestamp_et", "yyyy-MM-dd HH:mm:ssXXX")
    local = F.from_utc_timestamp(instant, timezone)
    return raw.withColumns({"bar_end": instant, "local_end": local, "session_date": F.to_date(local)}).drop("timestamp_et")


def typed_levels(raw: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Level rows whose flags arrive as text."""
    from sessionloom.functions.scalars import yes
    return raw.withColumns({f: yes(F.col(f)) for f in flags})


def read_range(spark: SparkSession, paths: Sequence[str], day: str, first: str, last: str) -> DataFrame:
    """Rows of several same-schema files inside a date range; the range filter reaches the scan."""
    schemas = {spark.read.parquet(p).schema.simpleString() for p in paths}
    if len(schemas) > 1:
        raise ValueError(f"files do not share one schema: {sorted(schemas)}")
    return spark.read.parquet(*paths).filter((F.col(day) >= F.lit(first).cast("timestamp_ntz")) & (F.col(day) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Declared columns only; a missing one is an error before anything runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def scoped(df: DataFrame, partitions: Sequence[tuple[str, str, str]], name: str, allowed: Sequence[str], day: str = "trading_date") -> DataFrame:
    """Rows of one named period of a literal period table; other periods are refused.  The range filter reaches the scan."""
    if name not in allowed:
        raise ValueError(f"period {name!r} is not open for this analysis")
    (first, last), = [(a, b) for n, a, b in partitions if n == name]
    return df.filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def write_derived_bars(df: DataFrame, path: str, *, dataset: str, timeframe: str, session_fingerprint: str) -> None:
    """Parquet store of derived bars, partitioned for pruning, with provenance in every row."""
    df.withColumns({"dataset_id": F.lit(dataset), "timeframe": F.lit(timeframe), "builder_version": F.lit(BUILDER_VERSION),
                    "session_fingerprint": F.lit(session_fingerprint)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "timeframe").parquet(path)


def read_derived_bars(spark: SparkSession, path: str, *, dataset: str, timeframe: str, session_fingerprint: str) -> DataFrame:
    """Stored bars; rows built with another version or calendar are stale and fail the query."""
    rows = spark.read.parquet(path).filter((F.col("dataset_id") == dataset) & (F.col("timeframe") == timeframe))
    stale = (F.col("builder_version") != BUILDER_VERSION) | (F.col("session_fingerprint") != session_fingerprint)
    fresh = rows.filter(F.when(stale, F.raise_error(F.lit("stale derived bars")).cast("boolean")).otherwise(F.lit(True)))
    return fresh.drop("dataset_id", "timeframe", "builder_version", "session_fingerprint")


def write_partitions(df: DataFrame, path: str, column: str = "partition") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
