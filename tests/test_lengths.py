"""Sweeps over opening-range lengths: each length as if it were the only one; stops and targets by hand."""
import datetime as dt

from pyspark.sql import functions as F

from sessionloom.operators import stats as S
from sessionloom.operators import trades as T

HOUR, NINE, ONE = 3600, 9 * 3600, 13 * 3600


def bars(spark):
    """Three instruments; the second lacks a bar of the range, the third is flat in its first bar."""
    day, rows = dt.date(2024, 1, 3), []
    paths = {1: [(100, 90), (104, 92), (103, 95), (109, 96), (111, 80), (120, 100)], 2: [(50, 40), None, (52, 41), (60, 30), (61, 45), (48, 20)],
             3: [(70, 70), (75, 70), (76, 69), (74, 60), (90, 71), (95, 50)]}
    for instrument, path in paths.items():
        for i, hl in enumerate(path):
            if hl:
                start = dt.datetime(2024, 1, 3, 9 + i)
                rows.append((instrument, day, "c", i, start, start + dt.timedelta(hours=1), hl[0] - 1, hl[0], hl[1], hl[1] + 1))
    return spark.createDataFrame(rows, "instrument_id long, trading_date date, contract string, slot long, bar_start timestamp, bar_end timestamp, open long, high long, low long, close long")


def same(left, right):
    assert sorted(map(str, left.select(sorted(left.columns)).collect())) == sorted(map(str, right.select(sorted(left.columns)).collect()))


def test_each_length_as_if_alone(spark):
    rows = bars(spark)
    levels = T.opening_levels_by_length(rows, HOUR, NINE, (1, 2, 3, 4))
    signals = T.breakout_signals_by_length(rows, levels, interval=HOUR, range_clock=NINE, cutoff=ONE)
    assert levels.filter("instrument_id = 2 and duration > 1 and valid").count() == 0 and levels.filter("instrument_id = 3 and duration = 1 and valid").count() == 0
    for k in (1, 2, 3, 4):
        alone = T.opening_levels(rows, HOUR, NINE, k)
        same(alone, levels.filter(F.col("duration") == k).drop("duration"))
        same(T.breakout_signals(rows, alone, interval=HOUR, range_clock=NINE, range_bars=k, cutoff=ONE), signals.filter(F.col("duration") == k).drop("duration"))
    assert T.opening_levels_by_length(rows.limit(0), HOUR, NINE, (1, 2)).count() == 0


def test_cells_of_the_sweeps(spark):
    def cells(grid):
        return [r["config_id"] for r in spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in grid[0]])).alias("duration"), F.inline(grid[1])).transform(T.with_length).collect()]

    multiples, points = cells((T.MULTIPLE_LENGTHS, T.fraction_grid(T.MULTIPLE_FRACTIONS))), cells((T.POINT_LENGTHS, T.stop_and_target_grid()))
    assert len(multiples) == len(set(multiples)) == 40 and len(points) == len(set(points)) == 75


def test_stops_and_targets(spark):
    rows = bars(spark)
    levels = T.opening_levels_by_length(rows, HOUR, NINE, (1,))
    signals = T.breakout_signals_by_length(rows, levels, interval=HOUR, range_clock=NINE, cutoff=ONE).filter("instrument_id = 1")
    grid = T.stop_and_target_grid((("OR_FRACTION", 25), ("FIXED_POINTS", 4)), (6,))
    made = {(r["breakout_type"], r["direction"], r["stop_kind"]): r for r in T.stop_and_target_candidates(signals, rows, grid, scale=1).collect()}
    # The first range is 90 to 100: a quarter of its width is 2.5 ticks.
    r = made["PRINT", "LONG", "OR_FRACTION"]
    assert (r["entry_ticks"], r["stop_ticks"], r["risk_ticks"], r["target_ticks"], r["risk_to_width"], r["target_to_width"], r["is_valid"]) == (100, 98, 2, 106, 0.2, 0.6, True)
    r = made["PRINT", "LONG", "FIXED_POINTS"]
    assert (r["stop_ticks"], r["risk_ticks"], r["target_ticks"]) == (96, 4, 106)
    # Below 90 closes the bar of slot 4; the next one opens at 119: points behind it, and beyond the stop at a quarter of the width.
    r = made["CLOSE", "SHORT", "FIXED_POINTS"]
    assert (r["entry_ticks"], r["stop_ticks"], r["target_ticks"], r["is_valid"]) == (119, 123, 113, True)
    r = made["CLOSE", "SHORT", "OR_FRACTION"]
    assert (r["risk_ticks"], r["risk_to_width"], r["invalid_reason"], r["is_valid"]) == (None, None, "INVALID_ENTRY_RELATIVE_TO_STOP", False)


def test_metrics_count_every_fate(spark):
    rows = bars(spark)
    levels = T.opening_levels_by_length(rows, HOUR, NINE, (1, 2))
    signals = T.breakout_signals_by_length(rows, levels, interval=HOUR, range_clock=NINE, cutoff=ONE)
    candidates = T.with_length(T.stop_and_target_candidates(signals, rows, T.stop_and_target_grid((("FIXED_POINTS", 8),), (3, 9)), scale=1))
    audit = T.session_trade_limit(candidates, T.exit_barrier(candidates, rows))
    cell = ["breakout_type", "config_id"]
    out = S.sweep_metrics(audit, audit.filter("status = 'EXECUTED'"), cell, [["trading_date"]], ["entry_time", "instrument_id", "direction"]).collect()
    facts = audit.collect()
    for r in out:
        mine = [f for f in facts if (f["breakout_type"], f["config_id"]) == (r["breakout_type"], r["config_id"])]
        assert r["candidates"] == len(mine) and r["trades"] == sum(f["status"] == "EXECUTED" for f in mine) and r["limited"] == sum(f["rejection_reason"] == "SESSION_TRADE_LIMIT" for f in mine)
        assert r["ambiguous"] == sum(bool(f["is_ambiguous"]) for f in mine) and r["invalid"] == sum(not f["is_valid"] for f in mine)
    assert {r["config_id"][:3] for r in out} == {"D01", "D02"}
