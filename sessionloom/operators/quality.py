"""Data-quality rules as counted violation queries; a check fails closed through ``require_clean``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One counter per rule; nulls in a rule count as no violation."""
    counters = [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *counters)


def violation_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The offending rows with the names of the rules they break."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("violations", names).filter(F.size("violations") > 0)


def require_clean(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Pass rows through; the query fails on the first row that breaks a rule."""
    out = df
    for name, rule in rules.items():
        guard = F.when(F.coalesce(rule, F.lit(False)), F.raise_error(F.lit(f"quality rule broken: {name}")).cast("boolean")).otherwise(F.lit(True))
        out = out.filter(guard)
    return out


def bar_rules() -> dict[str, Column]:
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    return {
        "missing_values": o.isNull() | h.isNull() | lo.isNull() | c.isNull() | F.col("volume").isNull(),
        "empty_contract": F.col("contract").isNull() | (F.trim("contract") == ""),
        "high_too_low": h < F.greatest(o, c), "low_too_high": lo > F.least(o, c),
    }


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Natural keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def validate_bars(df: DataFrame, key: Sequence[str]) -> DataFrame:
    counts = count_violations(df, bar_rules())
    repeats = duplicate_keys(df, key).agg(F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("duplicate_labels"))
    # both sides hold exactly one row
    return counts.withColumn("_one", F.lit(1)).join(repeats.withColumn("_one", F.lit(1)), "_one").drop("_one")


def tick_alignment(df: DataFrame, price: str, tick: str, tolerance: float = 1e-9) -> DataFrame:
    """Exact decimal test of the tick grid beside the relative floating test."""
    units = F.col(price) / F.lit(float(tick))
    exact = (F.col(price).cast("decimal(24,6)") % F.lit(tick).cast("decimal(24,6)")) == 0
    near = F.abs(units - F.round(units)) <= tolerance * F.greatest(F.lit(1.0), F.abs(units))
    return df.withColumns({"on_grid_exact": exact, "on_grid_near": near})


def partition_integrity(rows: DataFrame, partitions: DataFrame, day: str = "trading_date") -> DataFrame:
    """Coverage, exclusivity and unsplit sessions of a partitioned table, as one row per partition."""
    dim = F.broadcast(partitions)
    hits = rows.join(dim, (F.col(day) >= F.col("first_date")) & (F.col(day) <= F.col("last_date")), "left")
    per = hits.groupBy(F.coalesce("partition", F.lit("UNASSIGNED")).alias("partition")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(day).alias("sessions"), F.min(day).alias("first_session"), F.max(day).alias("last_session"),
        F.min("first_date").alias("_a"), F.max("last_date").alias("_b"))
    inside = (F.col("first_session") >= F.col("_a")) & (F.col("last_session") <= F.col("_b"))
    return per.withColumn("boundaries_ok", F.coalesce(inside, F.lit(False))).drop("_a", "_b")


def scope_guard(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Rows outside the allowed dates, counted."""
    outside = (F.col(day) < F.lit(first).cast("date")) | (F.col(day) > F.lit(last).cast("date"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(outside).alias("outside"))


def transition_rules(allowed: Sequence[tuple[str, str]], initial: str) -> dict[str, Column]:
    """Chain rules per entity: expects columns _previous_new and _previous_at from ``transition_chain``."""
    edge = F.concat_ws(">", "previous_state", "new_state")
    first = F.col("_previous_at").isNull()
    return {
        "first_leaves_initial": first & (F.col("previous_state") != initial),
        "previous_matches": ~first & (F.col("previous_state") != F.col("_previous_new")),
        "strict_order": ~first & (F.col("transition_at") <= F.col("_previous_at")),
        "edge_allowed": ~edge.isin(*[f"{a}>{b}" for a, b in allowed]),
        "available_after_entity": F.col("transition_at") <= F.col("entity_available_at"),
    }


def transition_chain(transitions: DataFrame, entities: DataFrame) -> DataFrame:
    order = Window.partitionBy("entity_id").orderBy("transition_at", "new_state")
    chained = transitions.withColumns({"_previous_new": F.lag("new_state").over(order), "_previous_at": F.lag("transition_at").over(order)})
    return chained.join(entities.select("entity_id", F.col("available_at").alias("entity_available_at")), "entity_id", "left")


def implication_rules() -> dict[str, Column]:
    touch, trade, close, reject, sweep = (F.col(c) for c in ("touch", "trade_through", "close_through", "reject", "sweep"))
    return {
        "trade_without_touch": trade & ~touch, "close_without_trade": close & ~trade, "sweep_without_trade": sweep & ~trade,
        "sweep_without_reject": sweep & ~reject, "close_and_reject": close & reject, "reject_without_touch": reject & ~touch,
    }


def tampered(df: DataFrame, on: str, faults: Sequence[tuple[str, str]]) -> DataFrame:
    """Copies of all rows with planted faults: fault k changes its column where ``on`` leaves k by the number of faults.

    Faults are (column, SQL expression); expressions see the values as given.
    """
    n = len(faults)
    changed = {}
    for k, (column, value) in enumerate(faults):
        changed[column] = F.when(F.expr(f"pmod({on}, {n}) = {k}"), F.expr(value)).otherwise(changed.get(column, F.col(column)))
    return df.withColumns({c: v.cast(df.schema[c].dataType) for c, v in changed.items()})


def tampered_sql(table: str, on: str, faults: Sequence[tuple[str, str]]) -> str:
    """The same rows in SQL."""
    changed: dict[str, str] = {}
    for k, (column, value) in enumerate(faults):
        changed[column] = f"CASE WHEN {on} % {len(faults)} = {k} THEN {value} ELSE {changed.get(column, column)} END"
    return f"SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in changed.items())}) FROM {table}"


def swing_violations(swings: DataFrame, segmented: DataFrame, left: int, right: int, again: Column) -> DataFrame:
    """Counters per side of what swings get wrong against the bars of their window; ``again`` recomputes an id.

    Each swing meets its own bars and the ``left`` and ``right`` ones beside them, so work follows the swings.
    """
    keys = ["instrument_id", "orientation", "first_slot"]
    end = F.greatest("first_slot", "last_slot")
    rows = swings.withColumns({"_again": again, "_end": end}).withColumn("slot", F.explode(F.sequence(F.col("first_slot") - left, F.col("_end") + right)))
    bars = segmented.select("instrument_id", "slot", F.col("segment_id").alias("_seg"), F.col("contract").alias("_contract"), F.col("bar_end").alias("_bar_end"), "high", "low")
    rows = rows.join(bars, ["instrument_id", "slot"], "left")
    upper = F.col("orientation") == "UPPER"
    price, mine = F.when(upper, F.col("high")).otherwise(F.col("low")), F.coalesce(F.col("_seg") == F.col("segment_id"), F.lit(False))
    at_first = F.max(F.when((F.col("slot") == F.col("first_slot")) & mine, price))
    inside = (F.col("slot") >= F.col("first_slot")) & (F.col("slot") <= F.col("_end"))
    before, after = F.col("slot") < F.col("first_slot"), F.col("slot") > F.col("_end")
    beside = (F.col("slot") == F.col("first_slot") - 1) | (F.col("slot") == F.col("_end") + 1)
    more = F.when(upper, price > F.col("price_ticks")).otherwise(price < F.col("price_ticks"))
    some = lambda rule: F.bool_or(F.coalesce(rule, F.lit(False)))
    ends = lambda slot: F.max(F.when((F.col("slot") == slot) & mine, F.col("_bar_end")))
    first = lambda c: F.first(c).alias(c)
    each = rows.groupBy(*keys).agg(
        *[first(c) for c in ("swing_id", "_again", "price_ticks", "source_at", "source_end_at", "available_at")],
        some(inside & ~mine).alias("span_outside_segment"), some(inside & mine & (price != F.col("price_ticks"))).alias("plateau_price_off"),
        F.collect_set(F.when(beside & mine, price)).alias("_beside"), at_first.alias("_price"),
        (F.count_if(before & mine) < left).alias("left_missing"), (F.count_if(after & mine) < right).alias("right_missing"),
        some((before | after) & mine & more).alias("window_exceeded"), some(mine & (F.col("_contract") != F.col("contract"))).alias("contract_mixed"),
        ends(F.col("first_slot")).alias("_first_end"), ends(F.col("_end")).alias("_last_end"), ends(F.col("_end") + right).alias("_known"))
    repeated = each.groupBy("swing_id").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    each = each.join(repeated, "swing_id")
    plain = ("span_outside_segment", "plateau_price_off", "left_missing", "right_missing", "window_exceeded", "contract_mixed")
    return count_violations(each, {
        **{c: F.col(c) for c in plain}, "plateau_not_maximal": F.array_contains("_beside", F.col("_price")), "missing_price": F.col("price_ticks").isNull(),
        "source_at_off": ~F.col("source_at").eqNullSafe(F.col("_first_end")), "source_end_off": ~F.col("source_end_at").eqNullSafe(F.col("_last_end")),
        "available_off": ~F.col("available_at").eqNullSafe(F.col("_known")), "time_order": ~((F.col("source_at") <= F.col("source_end_at")) & (F.col("source_end_at") < F.col("available_at"))),
        "id_mismatch": F.col("swing_id") != F.col("_again"), "id_repeated": F.col("_repeated")}, ["orientation"])
