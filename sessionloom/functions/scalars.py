"""Row-wise rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER, NEUTRAL = "UPPER", "LOWER", "NEUTRAL"


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Null when an operand is missing or the denominator is practically zero."""
    return F.when(F.abs(denominator) >= 1e-12, numerator.cast("double") / denominator)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def direction(value: Column) -> Column:
    return F.when(value > 0, "UP").when(value < 0, "DOWN").when(value == 0, "FLAT")


def interaction_state(took_high: Column, took_low: Column) -> Column:
    return (F.when(took_high & took_low, "BOTH").when(took_high, "HIGH_ONLY").when(took_low, "LOW_ONLY")
            .otherwise("NEITHER"))


def category_reject_first(touch, trade, close, reject, sweep) -> Column:
    """Sweep, then rejection, then close-through, then touch."""
    return (F.when(sweep, "SWEEP").when(reject, "REJECTION").when(close, "CLOSE_THROUGH").when(touch, "TOUCH_ONLY")
            .otherwise("NO_INTERACTION"))


def category_close_first(touch, trade, close, reject, sweep) -> Column:
    """Sweep, then close-through, then reject, then trade-through, then touch."""
    return (F.when(sweep, "SWEEP").when(close, "CLOSE_THROUGH").when(reject, "REJECT").when(trade, "TRADE_THROUGH")
            .when(touch, "TOUCH").otherwise("NONE"))


def threshold_ticks(side: Column, price: Column, tolerance: Column) -> Column:
    return F.when(side == UPPER, price + tolerance).otherwise(price - tolerance)


def half_up(value: Column) -> Column:
    """Nearest integer, halves away from zero, on exact decimals."""
    return F.round(value.cast("decimal(24,6)"), 0).cast("bigint")


def percentile_band(value: Column) -> Column:
    return (F.when(value < 0.2, "P00_20").when(value < 0.4, "P20_40").when(value < 0.6, "P40_60")
            .when(value < 0.8, "P60_80").when(value <= 1.0, "P80_100"))


def compare_causal(at_a, domain_a, seq_a, at_b, domain_b, seq_b) -> Column:
    """BEFORE / AFTER / EQUAL / INCOMPARABLE for two (instant, domain, sequence) keys."""
    comparable = seq_a.isNotNull() & seq_b.isNotNull() & domain_a.eqNullSafe(domain_b)
    return (
        F.when(at_a < at_b, "BEFORE").when(at_a > at_b, "AFTER")
        .when(seq_a.isNull() & seq_b.isNull(), "EQUAL")
        .when(~comparable, "INCOMPARABLE")
        .when(seq_a == seq_b, "EQUAL").when(seq_a < seq_b, "BEFORE").otherwise("AFTER")
    )


def yes(text: Column) -> Column:
    """Boolean from text: true / 1 / yes in any case, with blanks around."""
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def opposite(value: Column) -> Column:
    return F.when(value == "LONG", "SHORT").when(value == "SHORT", "LONG")


def signed(value: Column, side: Column) -> Column:
    return F.when(side == "LONG", value).when(side == "SHORT", -value)


def r6(value: Column | str) -> Column:
    """Six decimals; the offset, far above summation noise, settles exact halves the same way every run."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + 1e-10, 6)
