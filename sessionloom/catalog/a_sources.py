"""Sources, schedules and dimensions (section A)."""
from pyspark.sql import functions as F

from sessionloom.catalog.registry import query
from sessionloom.operators import bars as B
from sessionloom.sources import calendar as cal


@query("A09_expected_schedule", "SELECT trading_date, session_no, bucket, slot, bar_start, bar_end FROM schedule")
def _(m):
    return cal.expected_schedule(m.calendar(), m.interval)


@query("A10_rejected_bars", """
SELECT r.instrument_id, r.trading_date, r.bar_start, r.bar_end, r.volume, CASE WHEN coalesce(c.kind, 'CLOSED') = 'CLOSED' THEN 'CLOSED_DAY' ELSE 'SESSION_BREAK' END AS reason
FROM raw_bars r LEFT JOIN calendar c USING (trading_date) WHERE coalesce(c.kind, 'CLOSED') = 'CLOSED' OR r.bar_start < c.open OR r.bar_start >= c.close""")
def _(m):
    return m.rejected_bars()


@query("E01_resample_bars", "SELECT * FROM resampled")
def _(m):
    return B.resample_bars(m.bars(), m.calendar(), m.interval, 14_400)


@query("F01_continuity_segments", "SELECT * EXCLUDE (brk) FROM seg")
def _(m):
    return B.continuity_segments(m.bars())


@query("F01_continuity_breaks", "SELECT * FROM breaks")
def _(m):
    return B.continuity_breaks(m.bars())


@query("F02_episodes", "SELECT * FROM episodes")
def _(m):
    return B.episodes(B.continuity_segments(m.bars()), cal.expected_schedule(m.calendar(), m.interval))


@query("A04_levels_check", "SELECT * FROM levels")
def _(m):
    return m.levels()
