"""Calendar with daylight saving, fail-closed checks, stale stores and guards."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from sessionloom.operators import patterns as P
from sessionloom.operators import quality as Q
from sessionloom.operators import setops as H
from sessionloom.operators import states as ST
from sessionloom.operators import stats as S
from sessionloom.session import shared_folder
from sessionloom.sources import calendar as cal
from sessionloom.sources import files as FS


def days(spark, first, last):
    return spark.createDataFrame([(dt.date.fromisoformat(first), dt.date.fromisoformat(last))], "first_day date, last_day date")


def test_session_bounds_follow_daylight_saving(spark):
    spec = cal.SessionSpec(timezone="America/New_York")
    rows = {r.trading_date: r for r in cal.session_calendar(days(spark, "2024-03-08", "2024-03-12"), spec).collect()}
    assert rows[dt.date(2024, 3, 8)].open == dt.datetime(2024, 3, 7, 23)
    assert rows[dt.date(2024, 3, 11)].open == dt.datetime(2024, 3, 10, 22)
    assert rows[dt.date(2024, 3, 11)].close == dt.datetime(2024, 3, 11, 21)
    assert rows[dt.date(2024, 3, 11)].previous_session == dt.date(2024, 3, 8)


def test_closed_and_short_days(spark):
    rows = {r.trading_date: r for r in cal.session_calendar(days(spark, "2024-01-12", "2024-01-17"), cal.TEST_SPEC).collect()}
    assert rows[dt.date(2024, 1, 15)].open is None and rows[dt.date(2024, 1, 15)].session_no is None
    assert rows[dt.date(2024, 1, 17)].close == dt.datetime(2024, 1, 17, 13)
    assert rows[dt.date(2024, 1, 16)].previous_session == dt.date(2024, 1, 12)


def test_require_clean_fails_closed(spark):
    rows = spark.createDataFrame([(1, 3, 0, 2, "C1", 5), (1, 0, 0, 2, "C1", 5)], "open int, high int, low int, close int, contract string, volume int")
    assert Q.require_clean(rows.limit(1), Q.bar_rules()).count() == 1
    with pytest.raises(Exception, match="high_too_low"):
        Q.require_clean(rows, Q.bar_rules()).collect()


def test_stale_store_is_an_error(spark):
    path = f"{shared_folder(spark)}/stale-test"
    FS.write_derived_bars(fx.segmented(spark, 1), path, dataset="d", timeframe="1m", session_fingerprint="a")
    assert FS.read_derived_bars(spark, path, dataset="d", timeframe="1m", session_fingerprint="a").count() > 0
    with pytest.raises(Exception, match="stale"):
        FS.read_derived_bars(spark, path, dataset="d", timeframe="1m", session_fingerprint="b").collect()


def test_guards(spark):
    parts = cal.partition_table(spark)
    with pytest.raises(ValueError, match="not open"):
        FS.scoped(spark.range(1), parts, "RESERVED", ("DEVELOPMENT",))
    with pytest.raises(ValueError, match="missing columns"):
        FS.project(spark.range(1), ["nope"])


def test_zones_mirror(spark):
    """Reflecting prices turns bullish zones into bearish ones and nothing else."""
    seg = fx.segmented(spark, 7, step=6)
    mirror = seg.withColumns({"open": 4000 - F.col("open"), "close": 4000 - F.col("close"), "high": 4000 - F.col("low"), "low": 4000 - F.col("high")})
    key = lambda r: (r.instrument_id, r.available_slot, r.width_ticks, r.baseline_sum_ticks)
    up = {key(r) for r in P.gap_zones(seg).filter("direction = 'BULLISH'").collect()}
    down = {key(r) for r in P.gap_zones(mirror).filter("direction = 'BEARISH'").collect()}
    assert up == down and up


def test_input_order_does_not_matter(spark):
    seg = fx.segmented(spark, 9)
    a = P.gap_zones(seg)
    b = P.gap_zones(seg.orderBy(F.rand(1)))
    assert H.reconcile(a, b).count() == 0


def test_ordinal_bins_formula(spark):
    for n in (1, 5, 7, 23):
        rows = spark.createDataFrame([("k", i, i // 3) for i in range(n)], "k string, v int, c int")
        got = [r.bin for r in S.ordinal_bins(rows, ["k"], ["v"], [["c"]], 5).orderBy("v").collect()]
        assert got == [1 if n == 1 else max(1, -(-5 * i // (n - 1))) for i in range(n)]


def test_relationship_patterns(spark):
    rows = [("up", i, float(i), 1.0) for i in range(5)] + [("bad", i, [3., 4., 5., 4., 0.][i], [1., 1., 1., 1., 9.][i]) for i in range(5)] + [("mid", i, [1., 3., 9., 3., 2.][i], 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "slice string, state int, median_mfe double, median_mae double")
    got = {r["slice"]: r.pattern for r in ST.relationship_patterns(df, ["slice"], "state", 5).collect()}
    assert got == {"up": "MONOTONIC_MORE", "bad": "EXTREME_DETERIORATION", "mid": "MIDDLE_RANGE_PREFERENCE"}
