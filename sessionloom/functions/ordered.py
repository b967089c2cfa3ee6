"""Order-dependent computations that never put a whole series into one task.

A plain ``Window.partitionBy(series)`` sends every row of a series to one task.  The helpers here
work on bounded pieces instead:

* ``running`` computes prefix aggregates in two (or more) levels: inside each ordered chunk, then
  over the much smaller table of chunk totals, and adds the carried value back.
* ``with_halo`` cuts a series into blocks of consecutive ordinals and copies only the few boundary
  rows a bounded frame needs into the neighbouring block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALO_BLOCK = "_halo_block"
BLOCK_ROWS = 4096


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "last":
        return F.coalesce(local, carried)
    raise ValueError(f"unknown running kind {kind!r}")


def _over(kind: str, name: str, window) -> Column:
    if kind == "sum":
        return F.sum(name).over(window)
    if kind == "count":
        return F.sum(name).over(window)
    if kind == "max":
        return F.max(name).over(window)
    if kind == "min":
        return F.min(name).over(window)
    return F.last(name, ignorenulls=True).over(window)


def _total(kind: str, name: str, order: Sequence[str]) -> Column:
    if kind in ("sum", "count"):
        return F.sum(name)
    if kind == "max":
        return F.max(name)
    if kind == "min":
        return F.min(name)
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*order)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[str]],
    order: Sequence[str],
    specs: Mapping[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Prefix aggregates per ``keys`` in ``order``, carried across ordered chunk ``levels``.

    ``levels`` lists the chunk columns from coarse to fine, each monotone in ``order``; ``specs``
    maps an output name to ``(kind, expression)`` with kind sum / count / max / min / last.
    ``exclusive`` leaves the current row out.  ``order`` must be unique inside a chunk.
    """
    inputs = {name: f"_in_{name}" for name in specs}
    df = df.withColumns({inputs[name]: (expr.cast("bigint") if kind == "count" else expr)
                         for name, (kind, expr) in specs.items()})
    chunk = [column for level in levels for column in level]
    part = [*keys, *chunk]
    end = -1 if exclusive else 0
    window = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = df.withColumns({name: _over(kind, inputs[name], window) for name, (kind, _) in specs.items()})
    if levels:
        totals = df.groupBy(*part).agg(
            *[_total(kind, inputs[name], order).alias(f"_tot_{name}") for name, (kind, _) in specs.items()])
        carried = running(
            totals, keys, levels[:-1], levels[-1],
            {f"_carry_{name}": (kind if kind != "count" else "sum", F.col(f"_tot_{name}"))
             for name, (kind, _) in specs.items()},
            exclusive=True,
        ).select(*part, *[f"_carry_{name}" for name in specs])
        local = local.join(carried, part, "left")
        local = local.withColumns({
            name: _combine(kind, F.col(f"_carry_{name}"), F.col(name)) for name, (kind, _) in specs.items()})
    else:
        local = local.withColumns({
            name: F.coalesce(F.col(name), F.lit(0)) for name, (kind, _) in specs.items() if kind in ("sum", "count")})
    return local.drop(*inputs.values(), *[f"_carry_{name}" for name in specs])


def position(df: DataFrame, keys: Sequence[str], levels, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Zero-based ordinal of every row in its series, computed from chunk counts."""
    return running(df, keys, levels, order, {name: ("count", F.lit(1))}, exclusive=True)


def with_halo(df: DataFrame, ordinal: str, before: int, after: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``size`` consecutive ordinals plus the rows within ``before`` / ``after`` of each block.

    Adds the block column and ``_home`` (true in the one block that owns the row).  A window over
    ``keys + [HALO_BLOCK]`` ordered by the ordinal then sees every row a bounded frame can reach.
    """
    lo = F.floor((F.col(ordinal) - F.lit(after)) / F.lit(size))
    hi = F.floor((F.col(ordinal) + F.lit(before)) / F.lit(size))
    return (
        df.withColumn(HALO_BLOCK, F.explode(F.sequence(lo, hi)))
        .withColumn("_home", F.col(HALO_BLOCK) == F.floor(F.col(ordinal) / F.lit(size)))
    )


def home_rows(df: DataFrame) -> DataFrame:
    """Drop halo copies after the windows were evaluated."""
    return df.filter("_home").drop(HALO_BLOCK, "_home")


def halo_window(keys: Sequence[str], ordinal: str):
    return Window.partitionBy(*keys, HALO_BLOCK).orderBy(ordinal)
