"""Interval joins as equi joins on time buckets with a residual test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400


def bucket_of(instant: Column, seconds: int) -> Column:
    """Bucket number of an instant (timestamp column)."""
    return F.floor(F.unix_timestamp(instant) / F.lit(seconds))


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    end: str,
    *,
    seconds: int = DAY,
    how: str = "inner",
) -> DataFrame:
    """Join points to intervals with ``start <= point < end``.

    The intervals are repeated once per bucket they touch, so the join is an equi join on
    ``keys + bucket``; a point lies in exactly one bucket, so no pair appears twice.  ``how`` is
    inner, or left to keep points outside every interval.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    last = F.floor((F.unix_micros(F.col(end)) - 1) / F.lit(seconds * 1_000_000))
    buckets = F.sequence(bucket_of(F.col(start), seconds), F.greatest(last, bucket_of(F.col(start), seconds)))
    spread = intervals.withColumn("_bucket", F.explode(buckets))
    left = points.withColumn("_bucket", bucket_of(F.col(point), seconds)).alias("p")
    right = spread.alias("i")
    condition = F.col("p._bucket") == F.col("i._bucket")
    for key in keys:
        condition = condition & (F.col(f"p.{key}") == F.col(f"i.{key}"))
    condition = condition & (F.col(f"p.{point}") >= F.col(f"i.{start}")) & (F.col(f"p.{point}") < F.col(f"i.{end}"))
    joined = left.join(right, condition, how)
    keep = [F.col(f"p.{c}") for c in points.columns]
    keep += [F.col(f"i.{c}") for c in intervals.columns if c not in keys and c not in points.columns]
    return joined.select(*keep)
