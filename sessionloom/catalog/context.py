"""Context windows, gaps, history, alignment."""
from pyspark.sql import functions as F

from sessionloom.catalog.registry import query
from sessionloom.catalog.sql import CTES
from sessionloom.catalog.trades import or_levels
from sessionloom.operators import context as X
from sessionloom.operators import levels as L
from sessionloom.sources import calendar as cal

IDS = [w[0] for w in cal.TEST_WINDOWS]

CTES["instances"] = """
SELECT target_date, source_date, context_id, hi > lo AS is_scheduled, CASE WHEN hi > lo THEN lo ELSE w0 END AS t0, CASE WHEN hi > lo THEN hi ELSE w1 END AS t1,
       NOT (hi > lo) OR lo <> w0 OR hi <> w1 AS is_schedule_clipped
FROM (SELECT *, greatest(w0, epoch(s.open)::BIGINT) AS lo, least(w1, epoch(s.close)::BIGINT) AS hi
      FROM (SELECT *, epoch(source_date)::BIGINT + d0 * 86400 + c0 AS w0, epoch(source_date)::BIGINT + d1 * 86400 + c1 AS w1
            FROM (SELECT c.trading_date AS target_date, w.*, CASE w.src WHEN 'TARGET' THEN c.trading_date ELSE c.previous_session END AS source_date
                  FROM calendar c CROSS JOIN (VALUES %s) w(context_id, d0, c0, d1, c1, src) WHERE c.open IS NOT NULL)) x
      LEFT JOIN (SELECT trading_date AS sd, open, close FROM calendar) s ON s.sd = x.source_date)""" % ", ".join(map(str, cal.TEST_WINDOWS))
CTES["context"] = """
SELECT instrument_id, target_date, source_date, context_id, make_timestamp(t0 * 1000000) AS window_start, make_timestamp(t1 * 1000000) AS available_at,
       CASE WHEN k0 = k1 THEN k0 END AS contract, observed_open, observed_high, observed_low, observed_close, high_at, low_at, expected_count, observed_count,
       expected_count - observed_count AS missing_count, is_schedule_clipped, reason IS NULL AS is_available, reason AS unavailable_reason
FROM (SELECT *, CASE WHEN source_date IS NULL OR t0 < cov0 THEN 'INSUFFICIENT_HISTORY' WHEN t1 > cov1 THEN 'INSUFFICIENT_FUTURE_COVERAGE' WHEN NOT has THEN 'MISSING_EXPECTED_SESSION'
                     WHEN NOT is_scheduled THEN 'NOT_SCHEDULED' WHEN observed_count = 0 THEN 'NO_OBSERVATIONS' WHEN k0 <> k1 THEN 'MIXED_CONTRACT'
                     WHEN observed_count < expected_count THEN 'INCOMPLETE_WINDOW' END AS reason
      FROM (SELECT v.instrument_id, i.target_date, i.source_date, i.context_id, i.t0, i.t1, i.is_scheduled, i.is_schedule_clipped, v.cov0, v.cov1,
                   CASE WHEN i.is_scheduled THEN greatest(i.t1 // p.iv - CAST(ceil(i.t0 / p.iv) AS BIGINT), 0) ELSE 0 END AS expected_count,
                   EXISTS (SELECT 1 FROM bars x WHERE x.instrument_id = v.instrument_id AND x.trading_date = i.source_date) AS has,
                   count(b.slot) AS observed_count, min(b.contract) AS k0, max(b.contract) AS k1, arg_min(b.open, b.bar_end) AS observed_open, max(b.high) AS observed_high,
                   min(b.low) AS observed_low, arg_max(b.close, b.bar_end) AS observed_close, arg_min(b.bar_end, (-b.high, b.bar_end)) AS high_at, arg_min(b.bar_end, (b.low, b.bar_end)) AS low_at
            FROM (SELECT instrument_id, min(trading_date) AS d0, max(trading_date) AS d1, epoch(min(bar_start))::BIGINT AS cov0, epoch(max(bar_end))::BIGINT AS cov1 FROM bars GROUP BY 1) v
            JOIN instances i ON i.target_date BETWEEN v.d0 AND v.d1 CROSS JOIN prm p
            LEFT JOIN bars b ON b.instrument_id = v.instrument_id AND b.trading_date = i.source_date AND i.is_scheduled
             AND epoch(b.bar_start)::BIGINT >= i.t0 AND epoch(b.bar_end)::BIGINT <= i.t1
            GROUP BY ALL))"""


def context(m):
    return m.keep("context", lambda: X.market_context(m.bars(), m.calendar(), cal.TEST_WINDOWS, m.interval))


@query("E04_market_context", "SELECT * FROM context")
def _(m):
    return X.market_context(m.bars(), m.calendar(), cal.TEST_WINDOWS, m.interval)


@query("A10_context_windows", """
SELECT target_date, source_date, context_id, is_scheduled, is_schedule_clipped, make_timestamp(t0 * 1000000) AS window_start, make_timestamp(t1 * 1000000) AS window_end FROM instances""")
def _(m):
    return X.context_instances(m.calendar(), cal.TEST_WINDOWS).select(
        "target_date", "source_date", "context_id", "is_scheduled", "is_schedule_clipped",
        F.timestamp_seconds("_from").alias("window_start"), F.timestamp_seconds("_until").alias("window_end"))


@query("C38_valid_levels", """
SELECT * EXCLUDE (unavailable_reason, is_available, missing_count) RENAME (observed_open AS open, observed_high AS high, observed_low AS low, observed_close AS close)
FROM context WHERE is_available""")
def _(m):
    return X.valid_levels(context(m))


CTES["window_summary"] = """
SELECT instrument_id, target_date, context_id, available_at, ok AS feature_available, expected_count, observed_count,
       CASE WHEN ok THEN observed_open END AS open, CASE WHEN ok THEN observed_high END AS high, CASE WHEN ok THEN observed_low END AS low, CASE WHEN ok THEN observed_close END AS close,
       CASE WHEN ok THEN w END AS range_ticks, CASE WHEN ok THEN net END AS net_ticks, CASE WHEN ok AND observed_open <> 0 THEN round(net / observed_open, 9) END AS net_pct,
       CASE WHEN ok THEN CASE WHEN net > 0 THEN 'UP' WHEN net < 0 THEN 'DOWN' ELSE 'FLAT' END END AS direction, CASE WHEN ok AND w <> 0 THEN round(abs(net) / w, 9) END AS efficiency,
       CASE WHEN ok THEN high_at END AS high_at, CASE WHEN ok THEN low_at END AS low_at, CASE WHEN ok THEN '' ELSE 'INCOMPLETE_WINDOW' END AS missing_reason
FROM (SELECT *, expected_count > 0 AND observed_count = expected_count AS ok, observed_high - observed_low AS w, observed_close - observed_open AS net FROM context)"""


@query("E03_window_summary", "SELECT * FROM window_summary")
def _(m):
    return X.window_summary(context(m))


@query("C39_legacy_window_schema", """
SELECT instrument_id, target_date, max(CASE WHEN context_id = 'overnight' THEN high END) AS overnight_high, max(CASE WHEN context_id = 'overnight' THEN low END) AS overnight_low,
       max(CASE WHEN context_id = 'overnight' THEN range_ticks END) AS overnight_range_ticks, max(CASE WHEN context_id = 'london' THEN high END) AS london_high,
       max(CASE WHEN context_id = 'london' THEN low END) AS london_low, max(CASE WHEN context_id = 'london' THEN range_ticks END) AS london_range_ticks FROM window_summary GROUP BY 1, 2""")
def _(m):
    of = lambda w, c: F.max(F.when(F.col("context_id") == w, F.col(c)))
    return X.window_summary(context(m)).groupBy("instrument_id", "target_date").agg(
        *[of(w, c).alias(f"{w}_{c}") for w in ("overnight", "london") for c in ("high", "low", "range_ticks")])


CTES["or_context"] = """
SELECT instrument_id, trading_date, valid, or_bars, or_open, or_high, or_low, or_close, CASE WHEN valid THEN or_mid2 / 2.0::DOUBLE END AS or_mid, CASE WHEN valid THEN or_high - or_low END AS or_width_ticks,
       CASE WHEN valid THEN or_close - or_open END AS or_net_ticks,
       CASE WHEN valid THEN CASE WHEN or_close > or_open THEN 'UP' WHEN or_close < or_open THEN 'DOWN' ELSE 'FLAT' END END AS or_direction,
       CASE WHEN valid THEN round(abs(or_close - or_open) / (or_high - or_low), 9) END AS or_efficiency,
       CASE WHEN valid THEN round((or_close - or_low) / (or_high - or_low), 9) END AS or_close_location, or_end AS or_available_at FROM or_levels"""


def or_context(m):
    return X.opening_context(or_levels(m))


@query("E05_or_context", "SELECT * FROM or_context")
def _(m):
    return or_context(m)


@query("D06_previous_session", """
SELECT p.instrument_id, p.trading_date, c.previous_session AS previous_expected, lag(p.trading_date) OVER (PARTITION BY p.instrument_id ORDER BY p.trading_date) AS previous_present
FROM (SELECT DISTINCT instrument_id, trading_date FROM bars) p LEFT JOIN calendar c USING (trading_date)""")
def _(m):
    return X.previous_sessions(m.bars(), m.calendar())


CTES["reopen"] = """
SELECT d.instrument_id, d.trading_date, full_ok AS feature_available, CASE WHEN full_ok THEN pc END AS prior_close_ticks, CASE WHEN full_ok THEN ro END AS reopen_ticks, CASE WHEN full_ok THEN ro - pc END AS gap_ticks,
       CASE WHEN full_ok THEN CASE WHEN ro > pc THEN 'UP' WHEN ro < pc THEN 'DOWN' ELSE 'FLAT' END END AS gap_direction,
       CASE WHEN full_ok THEN CASE WHEN ro = pc THEN 'NO_GAP' WHEN ro > pc THEN CASE WHEN ll <= pc THEN 'FILLED' WHEN ll < ro THEN 'PARTIAL' ELSE 'OPEN' END
                                   ELSE CASE WHEN hh >= pc THEN 'FILLED' WHEN hh > ro THEN 'PARTIAL' ELSE 'OPEN' END END END AS fill_state,
       CASE WHEN ro IS NULL OR pc IS NULL THEN 'MISSING_PRIOR_CLOSE_OR_REOPEN' WHEN NOT full_ok THEN 'INCOMPLETE_GAP_OBSERVATION_WINDOW' ELSE '' END AS missing_reason
FROM (SELECT a.*, p.fc AS pc, a.ro IS NOT NULL AND p.fc IS NOT NULL AND a.seen = a.want AS full_ok
      FROM (SELECT b.instrument_id, b.trading_date, s.previous_session, max(CASE WHEN epoch(b.bar_start) = s.grid_start THEN b.open END) AS ro,
                   max(CASE WHEN b.bar_end <= b.trading_date + INTERVAL 9 HOUR THEN b.high END) AS hh, min(CASE WHEN b.bar_end <= b.trading_date + INTERVAL 9 HOUR THEN b.low END) AS ll,
                   CAST(count_if(b.bar_end <= b.trading_date + INTERVAL 9 HOUR) AS BIGINT) AS seen, any_value((epoch(b.trading_date)::BIGINT + 32400 - s.grid_start) // s.iv) AS want
            FROM bars b JOIN slots s USING (trading_date) GROUP BY 1, 2, 3) a
      LEFT JOIN (SELECT b.instrument_id, b.trading_date, max(CASE WHEN epoch(b.bar_start) + s.iv >= epoch(s.close) THEN b.close END) AS fc FROM bars b JOIN slots s USING (trading_date) GROUP BY 1, 2) p
        ON p.instrument_id = a.instrument_id AND p.trading_date = a.previous_session) d"""


def reopen(m):
    return X.reopen_gap(m.bars(), m.calendar(), 9 * 3600, m.interval)


@query("E06_reopen_gap", "SELECT * FROM reopen")
def _(m):
    return reopen(m)


CTES["open_gap"] = """
SELECT d.instrument_id, d.trading_date, p.pc AS prior_close_ticks, d.o AS open_ticks, d.o - p.pc AS gap_ticks,
       CASE WHEN d.o > p.pc THEN 'UP' WHEN d.o < p.pc THEN 'DOWN' WHEN d.o = p.pc THEN 'FLAT' END AS gap_direction, CASE WHEN p.pc <> 0 THEN round((d.o - p.pc) / p.pc, 9) END AS gap_pct,
       p.instrument_id IS NOT NULL AND p.pc IS NOT NULL AND d.o IS NOT NULL AS feature_available,
       CASE WHEN p.instrument_id IS NULL THEN 'NO_PRIOR_SESSION' WHEN p.pc IS NULL THEN 'MISSING_PRIOR_CLOSE_BAR' WHEN d.o IS NULL THEN 'MISSING_CURRENT_OPEN_BAR' ELSE '' END AS missing_reason
FROM (SELECT instrument_id, trading_date, max(CASE WHEN bar_start = trading_date + INTERVAL 9 HOUR THEN open END) AS o FROM bars GROUP BY 1, 2) d JOIN calendar c USING (trading_date)
LEFT JOIN (SELECT instrument_id, trading_date, max(CASE WHEN bar_end = trading_date + INTERVAL 16 HOUR THEN close END) AS pc FROM bars GROUP BY 1, 2) p
  ON p.instrument_id = d.instrument_id AND p.trading_date = c.previous_session"""


def open_gap(m):
    return X.open_gap(m.bars(), m.calendar(), 16 * 3600, 9 * 3600)


@query("E07_open_gap", "SELECT * FROM open_gap")
def _(m):
    return open_gap(m)


CTES["history"] = """
SELECT * EXCLUDE (p5, sd5, mean5), len(p5) AS hist_5_sample_count, len(p5) >= 5 AND or_width_ticks IS NOT NULL AS hist_5_available,
       CASE WHEN len(p5) >= 5 AND or_width_ticks IS NOT NULL THEN round((len(list_filter(p5, lambda x: x < or_width_ticks)) + 0.5::DOUBLE * len(list_filter(p5, lambda x: x = or_width_ticks))) / len(p5), 6) END AS hist_5_percentile,
       CASE WHEN len(p5) >= 5 AND or_width_ticks IS NOT NULL AND sd5 > 0 THEN round((or_width_ticks - mean5) / sd5, 6) END AS hist_5_zscore
FROM (SELECT instrument_id, trading_date, or_width_ticks, coalesce(list(or_width_ticks) FILTER (or_width_ticks IS NOT NULL) OVER w, []) AS p5, stddev_pop(or_width_ticks) OVER w AS sd5, avg(or_width_ticks) OVER w AS mean5
      FROM or_context WINDOW w AS (PARTITION BY instrument_id ORDER BY trading_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


def history(m):
    daily = or_context(m).select("instrument_id", "trading_date", "or_width_ticks")
    return X.causal_history(daily, ["instrument_id"], "trading_date", "or_width_ticks", (5,))


@query("F09_causal_history", "SELECT * FROM history")
def _(m):
    return history(m)


CTES["aligned"] = """
SELECT b.instrument_id, b.trading_date, b.bar_start, b.bar_end, c.context_id, CASE WHEN c.context_id IS NULL OR NOT c.is_available THEN 'UNAVAILABLE' WHEN c.available_at > b.bar_start THEN 'PENDING'
            WHEN c.contract <> b.contract THEN 'CONTRACT_MISMATCH' ELSE 'AVAILABLE' END AS status, c.observed_high, c.observed_low
FROM bars b LEFT JOIN context c ON c.instrument_id = b.instrument_id AND c.target_date = b.trading_date"""


@query("D07_align_context", """
SELECT instrument_id, trading_date, bar_start, bar_end, context_id, status, CASE WHEN status = 'AVAILABLE' THEN observed_high END AS context_high,
       CASE WHEN status = 'AVAILABLE' THEN observed_low END AS context_low FROM aligned""")
def _(m):
    return X.align_context(m.bars(), context(m))


@query("D07_align_context_wide", "SELECT instrument_id, bar_end, " + ", ".join(
    f"max(CASE WHEN context_id = '{c}' AND status = 'AVAILABLE' THEN observed_high END) AS {c}" for c in IDS) + " FROM aligned GROUP BY 1, 2")
def _(m):
    return X.align_context_wide(X.align_context(m.bars(), context(m)), IDS)


@query("C18_level_sweep_path", """
SELECT e.instrument_id, e.target_date, CASE WHEN l.observed_high > e.observed_high AND l.observed_low < e.observed_low THEN 'BOTH' WHEN l.observed_high > e.observed_high THEN 'HIGH_ONLY'
            WHEN l.observed_low < e.observed_low THEN 'LOW_ONLY' ELSE 'NEITHER' END AS path
FROM context e JOIN context l USING (instrument_id, target_date) WHERE e.context_id = 'asia' AND l.context_id = 'london' AND e.is_available AND l.is_available""")
def _(m):
    return X.sweep_path(context(m), "asia", "london")


@query("C20_expansion_ratios", "SELECT o.instrument_id, o.trading_date, " + ", ".join(
    f"round(max(CASE WHEN c.context_id = '{c}' AND c.observed_high > c.observed_low THEN (o.or_high - o.or_low) / (c.observed_high - c.observed_low) END), 9) AS or_to_{c}" for c in IDS)
    + " FROM or_levels o LEFT JOIN context c ON c.instrument_id = o.instrument_id AND c.target_date = o.trading_date AND c.is_available WHERE o.valid GROUP BY 1, 2")
def _(m):
    return X.expansion_ratios(or_levels(m), context(m), IDS)


@query("B13_availability_audit", """
SELECT c.instrument_id, c.target_date, c.context_id, c.expected_count, c.observed_count, g.n AS missing_bars, g.a AS first_missing, g.z AS last_missing,
       CASE WHEN c.observed_count = 0 THEN 'ENTIRE_WINDOW_MISSING' WHEN g.n = 1 THEN 'SINGLE_BAR_MISSING' WHEN g.n IS NULL THEN 'OUTSIDE_COVERAGE' ELSE 'PARTIAL_WINDOW' END AS reason
FROM context c LEFT JOIN (
  SELECT c.instrument_id, c.target_date, c.context_id, count(*) AS n, min(s.bar_end) AS a, max(s.bar_end) AS z
  FROM context c JOIN schedule s ON s.trading_date = c.source_date AND s.bar_start >= c.window_start AND s.bar_end <= c.available_at
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.instrument_id = c.instrument_id AND b.bar_start = s.bar_start) GROUP BY 1, 2, 3) g
 ON g.instrument_id = c.instrument_id AND g.target_date = c.target_date AND g.context_id = c.context_id
WHERE NOT c.is_available AND c.expected_count > 0""")
def _(m):
    return X.availability_audit(m.bars(), m.schedule(), context(m))


CTES["context_levels"] = """
SELECT c.instrument_id, c.contract, 'SPECIFIC' AS contract_scope, c.target_date, c.source_date AS source_trading_date, c.available_at, k.open AS valid_from, k.close AS valid_until,
       v.orientation, v.t AS level_ticks, c.context_id || '_' || v.f AS level_type, concat_ws(':', c.context_id, v.f, CAST(c.target_date AS VARCHAR), c.instrument_id) AS level_id
FROM context c JOIN calendar k ON k.trading_date = c.target_date
CROSS JOIN LATERAL (VALUES ('high', 'UPPER', c.observed_high), ('low', 'LOWER', c.observed_low), ('close', 'NEUTRAL', c.observed_close)) v(f, orientation, t)
WHERE c.is_available AND (v.f <> 'close' OR c.context_id IN ('previous_day', 'previous_rth'))"""


def context_levels(m):
    return X.market_context_levels(context(m), m.calendar(), ("previous_day", "previous_rth"))


@query("C29_market_context_levels", "SELECT * FROM context_levels")
def _(m):
    return context_levels(m)


@query("O08_context_level_interactions", """
SELECT l.level_type, b.contract <> l.contract AS is_mismatch, count(*) AS pairs, CAST(count_if(b.contract = l.contract AND b.high >= l.level_ticks AND b.low <= l.level_ticks) AS BIGINT) AS contained
FROM bars b JOIN context_levels l ON b.instrument_id = l.instrument_id AND b.bar_start >= l.valid_from AND b.bar_start < l.valid_until AND b.bar_end >= l.available_at AND b.bar_start >= l.available_at GROUP BY 1, 2""")
def _(m):
    facts = L.bar_level_interactions(m.bars(), context_levels(m)).filter("status <> 'PENDING_LEVEL'")
    kind = context_levels(m).select("level_id", "level_type")
    inside = (F.col("high_offset_ticks") >= 0) & (F.col("low_offset_ticks") <= 0)
    return facts.join(kind, "level_id").groupBy("level_type", (F.col("bar_contract") != F.col("level_contract")).alias("is_mismatch")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(inside).alias("contained"))
