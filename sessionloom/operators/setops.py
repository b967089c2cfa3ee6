"""Differences, equality and reproduction checks between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) found on one side only.

    Each side is reduced to counts per distinct row before the tables meet, so identical copies of a
    row never travel together.
    """
    columns = left.columns
    a = left.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", F.lit(0).cast("bigint"))
    b = right.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_m")).withColumn("_n", F.lit(0).cast("bigint"))
    both = a.unionByName(b).groupBy(*columns).agg(F.sum("_n").alias("left_count"), F.sum("_m").alias("right_count"))
    return both.filter("left_count <> right_count")


def reconcile_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    extra = reconcile(left, right).withColumn("_d", F.col("left_count") - F.col("right_count"))
    return extra.agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("only_left"),
                     F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("only_right"))


def key_set_equality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return reconcile_counts(left.select(*keys).distinct(), right.select(*keys).distinct())


def control_reproduction(actual: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows whose values differ beyond the tolerance, or that exist on one side only."""
    a = actual.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    e = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in columns], F.lit(True).alias("_e"))
    off = F.lit(False)
    for c in columns:
        off = off | (F.abs(F.col(f"a_{c}") - F.col(f"e_{c}")) > tolerance) | (F.col(f"a_{c}").isNull() != F.col(f"e_{c}").isNull())
    return a.join(e, list(keys), "full").filter(F.col("_a").isNull() | F.col("_e").isNull() | off).drop("_a", "_e")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and a wrapping sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("hash"))
