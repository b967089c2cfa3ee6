"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.catalog.sql import compose
from sessionloom.session import prepare
from sessionloom.sources.market import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def naive_times(df: DataFrame) -> DataFrame:
    """Instants as zone-free UTC timestamps, the form the parquet tables use."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}) if times else df


def query(name: str, sql: str | None = None):
    """Register ``fn(market) -> DataFrame``; ``sql`` may use any common table of ``catalog.sql``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_times(fn(Market(prepare(spark), sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register
