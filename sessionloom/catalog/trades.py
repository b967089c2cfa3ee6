"""Opening ranges, breakouts, exits, eligibility and sweeps; bar x level facts."""
from pyspark.sql import functions as F

from sessionloom.catalog.patterns import episodes, swings
from sessionloom.catalog.registry import query
from sessionloom.catalog.sql import CTES
from sessionloom.operators import levels as L
from sessionloom.operators import trades as T
from sessionloom.sources import calendar as cal

CTES["or_levels"] = """
SELECT *, or_high + or_low AS or_mid2, or_bars = range_bars AND or_high > or_low AS valid
FROM (SELECT instrument_id, trading_date, count(*) AS or_bars, max(high) AS or_high, min(low) AS or_low,
             arg_min(open, bar_start) AS or_open, arg_max(close, bar_start) AS or_close, max(bar_end) AS or_end, any_value(range_bars) AS range_bars
      FROM bars CROSS JOIN prm
      WHERE bar_start >= trading_date + to_seconds(range_clock) AND bar_start < trading_date + to_seconds(range_clock + range_bars * iv)
      GROUP BY 1, 2)"""
CTES["eligible"] = """
SELECT b.*, l.or_high, l.or_low, l.or_mid2, b.high > l.or_high AS up, b.low < l.or_low AS down
FROM bars b JOIN or_levels l ON b.instrument_id = l.instrument_id AND b.trading_date = l.trading_date AND l.valid CROSS JOIN prm
WHERE bar_start >= b.trading_date + to_seconds(range_clock + prm.range_bars * iv) AND bar_start <= b.trading_date + to_seconds(cutoff_clock)"""
CTES["signals"] = """
SELECT instrument_id, trading_date, contract, breakout_type, direction, slot AS signal_slot, bar_end AS signal_time, or_high, or_low, or_mid2
FROM (SELECT *, 'PRINT' AS breakout_type, 'LONG' AS direction FROM eligible WHERE up AND NOT down
      UNION ALL SELECT *, 'PRINT', 'SHORT' FROM eligible WHERE down AND NOT up
      UNION ALL SELECT *, 'CLOSE', 'LONG' FROM eligible WHERE close > or_high
      UNION ALL SELECT *, 'CLOSE', 'SHORT' FROM eligible WHERE close < or_low)
QUALIFY row_number() OVER (PARTITION BY instrument_id, trading_date, breakout_type, direction ORDER BY slot) = 1"""
CTES["entered"] = """
SELECT s.*, e.bar_end AS entry_time, CASE WHEN e.slot IS NOT NULL THEN e.slot END AS entry_slot,
       CASE WHEN e.slot IS NULL THEN NULL WHEN s.breakout_type = 'CLOSE' THEN e.open WHEN s.direction = 'LONG' THEN s.or_high ELSE s.or_low END AS entry_ticks,
       CASE s.direction WHEN 'LONG' THEN 1 ELSE -1 END AS sgn
FROM signals s LEFT JOIN bars e ON e.instrument_id = s.instrument_id AND e.trading_date = s.trading_date
 AND e.slot = s.signal_slot + CASE s.breakout_type WHEN 'PRINT' THEN 0 ELSE 1 END"""
_CANDIDATES = """
SELECT * EXCLUDE (sgn), entry_ticks + sgn * CAST(round(target_r * CAST(risk_ticks AS DECIMAL(16,0)), 0) AS BIGINT) AS target_ticks,
       CASE WHEN entry_time IS NULL THEN 'MISSING_IMMEDIATE_NEXT_BAR' WHEN risk_ticks IS NULL THEN 'INVALID_ENTRY_RELATIVE_TO_STOP' ELSE '' END AS invalid_reason,
       entry_time IS NOT NULL AND risk_ticks IS NOT NULL AS is_valid
FROM (SELECT *, CASE WHEN sgn * (entry_ticks - stop_ticks) > 0 THEN sgn * (entry_ticks - stop_ticks) END AS risk_ticks
      FROM (SELECT e.*, g.*, CAST(round(CAST(CASE direction WHEN 'LONG' THEN or_high ELSE or_low END AS DECIMAL(20,0))
                     - sgn * CAST(or_high - or_low AS DECIMAL(16,0)) * CAST(stop_pct AS DECIMAL(5,0)) * 0.01, 0) AS BIGINT) AS stop_ticks
            FROM entered e CROSS JOIN (%s) g))"""
CTES["cand"] = _CANDIDATES % "SELECT 'F050_R200' AS config_id, 50 AS stop_pct, CAST(2 AS DECIMAL(6,2)) AS target_r"
CTES["cand_grid"] = _CANDIDATES % """SELECT printf('F%03d_R%03d', f, CAST(r * 100 AS INTEGER)) AS config_id, f AS stop_pct, CAST(r AS DECIMAL(6,2)) AS target_r
 FROM (VALUES (25), (50), (75), (90)) a(f), (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) b(r)"""
CTES["cand_points"] = """
SELECT * EXCLUDE (sgn, st, tt), entry_ticks - sgn * st AS stop_ticks, entry_ticks + sgn * tt AS target_ticks, CASE WHEN entry_time IS NOT NULL THEN st END AS risk_ticks,
       st / (or_high - or_low) AS risk_to_width, tt / (or_high - or_low) AS target_to_width,
       CASE WHEN entry_time IS NULL THEN 'MISSING_IMMEDIATE_NEXT_BAR' ELSE '' END AS invalid_reason, entry_time IS NOT NULL AS is_valid
FROM entered CROSS JOIN (SELECT printf('S%03d_T%03d', s, t) AS config_id, s AS stop_points, t AS target_points, CAST(s * 100 AS BIGINT) AS st, CAST(t * 100 AS BIGINT) AS tt
 FROM (VALUES (20), (40), (60), (80), (100)) a(s), (VALUES (50), (100), (150)) b(t))"""


def exits_sql(source: str, first: str = ">=") -> str:
    """Exit of each candidate by a running path over all later bars of its session."""
    return f"""
SELECT instrument_id, trading_date, breakout_type, direction, config_id, contract, signal_slot, signal_time, entry_slot, entry_time, entry_ticks, stop_ticks, risk_ticks, target_ticks,
       bar_end AS exit_time, reason AS exit_reason, exit_ticks, seen AS holding_bars, reason LIKE 'AMBIGUOUS%' AS is_ambiguous,
       CASE WHEN reason NOT LIKE 'AMBIGUOUS%' THEN sgn * (exit_ticks - entry_ticks) END AS pnl_ticks,
       CASE WHEN reason NOT LIKE 'AMBIGUOUS%' THEN sgn * (exit_ticks - entry_ticks) / risk_ticks END AS result_r,
       CASE WHEN reason NOT LIKE 'AMBIGUOUS%' THEN greatest(0, CASE sgn WHEN 1 THEN hh - entry_ticks ELSE entry_ticks - ll END) END AS mfe_ticks,
       CASE WHEN reason NOT LIKE 'AMBIGUOUS%' THEN greatest(0, CASE sgn WHEN 1 THEN entry_ticks - ll ELSE hh - entry_ticks END) END AS mae_ticks
FROM (SELECT *, CASE reason WHEN 'TARGET' THEN target_ticks WHEN 'STOP' THEN stop_ticks WHEN 'SESSION_END' THEN close END AS exit_ticks
      FROM (SELECT *, CASE WHEN sh AND th THEN 'AMBIGUOUS_STOP_TARGET' WHEN sh AND breakout_type = 'PRINT' AND slot = entry_slot THEN 'AMBIGUOUS_ENTRY_STOP'
                           WHEN th THEN 'TARGET' WHEN sh THEN 'STOP' WHEN slot = last_slot THEN 'SESSION_END' END AS reason
            FROM (SELECT c.*, CASE c.direction WHEN 'LONG' THEN 1 ELSE -1 END AS sgn, b.slot, b.bar_end, b.close,
                         CASE c.direction WHEN 'LONG' THEN b.low <= c.stop_ticks ELSE b.high >= c.stop_ticks END AS sh,
                         CASE c.direction WHEN 'LONG' THEN b.high >= c.target_ticks ELSE b.low <= c.target_ticks END AS th,
                         max(b.high) OVER w AS hh, min(b.low) OVER w AS ll, count(*) OVER w AS seen,
                         max(b.slot) OVER (PARTITION BY c.instrument_id, c.trading_date, c.breakout_type, c.direction, c.config_id) AS last_slot
                  FROM {source} c JOIN bars b ON b.instrument_id = c.instrument_id AND b.trading_date = c.trading_date AND b.slot {first} c.entry_slot
                  WHERE c.is_valid
                  WINDOW w AS (PARTITION BY c.instrument_id, c.trading_date, c.breakout_type, c.direction, c.config_id ORDER BY b.slot)))
      WHERE reason IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY instrument_id, trading_date, breakout_type, direction, config_id ORDER BY slot) = 1)"""


def audit_sql(candidates: str, trades: str) -> str:
    return f"""
SELECT *, CASE WHEN rejection_reason = '' THEN 'EXECUTED' ELSE 'REJECTED' END AS status
FROM (SELECT * EXCLUDE (fits, earlier), CASE WHEN NOT is_valid THEN invalid_reason WHEN exit_reason IS NULL THEN 'MISSING_COMPLETED_TRADE'
             WHEN is_ambiguous THEN exit_reason WHEN coalesce(earlier, 0) > 0 THEN 'SESSION_TRADE_LIMIT' ELSE '' END AS rejection_reason
      FROM (SELECT *, sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id, trading_date, breakout_type, config_id
                    ORDER BY coalesce(entry_time, signal_time), signal_time, direction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
            FROM (SELECT c.instrument_id, c.trading_date, c.breakout_type, c.direction, c.config_id, c.signal_time, c.entry_time, c.is_valid, c.invalid_reason,
                         t.exit_reason, t.is_ambiguous, t.result_r, c.is_valid AND t.exit_reason IS NOT NULL AND NOT coalesce(t.is_ambiguous, FALSE) AS fits
                  FROM {candidates} c LEFT JOIN {trades} t USING (instrument_id, trading_date, breakout_type, direction, config_id))))"""


CTES["exits"] = exits_sql("cand")
CTES["exits_grid"] = exits_sql("cand_grid")
CTES["exits_points"] = exits_sql("cand_points")
CTES["audit"] = audit_sql("cand", "exits")
CTES["audit_grid"] = audit_sql("cand_grid", "exits_grid")
CTES["audit_points"] = audit_sql("cand_points", "exits_points")


def shape(m):
    s = m.settings
    return dict(interval=s.interval, range_clock=s.range_clock, range_bars=s.range_bars)


def or_levels(m):
    return T.opening_levels(m.bars(), **shape(m))


def signals(m):
    return m.keep("signals", lambda: T.breakout_signals(m.bars(), or_levels(m), cutoff=m.settings.cutoff_clock, **shape(m)))


def candidates(m, grid=None):
    return T.candidate_entries(signals(m), m.bars(), grid)


def exits(m):
    return T.exit_barrier(candidates(m), m.bars())


def grid_candidates(m):
    return m.keep("grid_candidates", lambda: candidates(m, T.fraction_grid()))


def grid_exits(m):
    return m.keep("grid_exits", lambda: T.exit_barrier(grid_candidates(m), m.bars()))


def grid_audit(m):
    return m.keep("grid_audit", lambda: T.session_trade_limit(grid_candidates(m), grid_exits(m)))


def point_candidates(m):
    return m.keep("point_candidates", lambda: T.fixed_point_candidates(signals(m), m.bars()))


def point_exits(m):
    return m.keep("point_exits", lambda: T.exit_barrier(point_candidates(m), m.bars()))


def point_audit(m):
    return m.keep("point_audit", lambda: T.session_trade_limit(point_candidates(m), point_exits(m)))


@query("E02_opening_range", "SELECT * EXCLUDE (range_bars) FROM or_levels")
def _(m):
    return or_levels(m)


@query("F10_breakout_signals", "SELECT * FROM signals")
def _(m):
    return signals(m)


@query("F10_two_sided_bars", """
SELECT e.instrument_id, e.trading_date, e.slot, e.bar_end, e.or_high, e.or_low FROM eligible e
LEFT JOIN (SELECT instrument_id, trading_date, count(*) AS n, max(signal_slot) AS done FROM signals WHERE breakout_type = 'PRINT' GROUP BY 1, 2) d
  ON d.instrument_id = e.instrument_id AND d.trading_date = e.trading_date
WHERE up AND down AND (d.n IS NULL OR d.n < 2 OR e.slot < done)""")
def _(m):
    return T.two_sided_bars(m.bars(), or_levels(m), signals(m), cutoff=m.settings.cutoff_clock, **shape(m))


@query("C25_candidate_entry", "SELECT * REPLACE (CAST(target_r AS DOUBLE) AS target_r) FROM cand")
def _(m):
    return candidates(m).withColumn("target_r", F.col("target_r").cast("double"))


@query("C23_config_grid", "SELECT config_id, stop_pct, CAST(target_r AS DOUBLE) AS target_r, count(*) AS candidates, CAST(count_if(is_valid) AS BIGINT) AS valid FROM cand_grid GROUP BY 1, 2, 3")
def _(m):
    return grid_candidates(m).groupBy("config_id", "stop_pct", F.col("target_r").cast("double").alias("target_r")).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("is_valid").alias("valid"))


@query("C26_fixed_point_candidate", "SELECT * FROM cand_points")
def _(m):
    return point_candidates(m)


@query("D17_exit_barrier", "SELECT * FROM exits")
def _(m):
    return exits(m)


@query("D17_exit_barrier_grid", "SELECT * FROM exits_grid")
def _(m):
    return grid_exits(m)


@query("F11_session_trade_limit", "SELECT * FROM audit_grid")
def _(m):
    return grid_audit(m)


_AGAIN = exits_sql("(SELECT c.* FROM cand_grid c JOIN exits_grid x USING (instrument_id, trading_date, breakout_type, direction, config_id) WHERE x.exit_reason = 'AMBIGUOUS_ENTRY_STOP')", ">")
CTES["exits_again"] = f"SELECT * FROM exits_grid WHERE exit_reason <> 'AMBIGUOUS_ENTRY_STOP' UNION ALL {_AGAIN}"


@query("D18_exit_after_entry_bar", "SELECT * FROM exits_again")
def _(m):
    return T.resolve_after_entry_bar(grid_exits(m), grid_candidates(m), m.bars())


@query("C27_resolve_pessimistic", """
SELECT * REPLACE (CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN -1.0::DOUBLE ELSE result_r END AS result_r,
                  CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN stop_ticks ELSE exit_ticks END AS exit_ticks,
                  is_ambiguous AND exit_reason <> 'AMBIGUOUS_ENTRY_STOP' AS is_ambiguous,
                  CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN 'STOP' ELSE exit_reason END AS exit_reason) FROM exits_grid""")
def _(m):
    return T.resolve_pessimistic(grid_exits(m))


@query("C28_entry_first_trade", """
SELECT * REPLACE (CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN -1.0::DOUBLE ELSE result_r END AS result_r,
                  CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN stop_ticks ELSE exit_ticks END AS exit_ticks,
                  CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN -risk_ticks ELSE pnl_ticks END AS pnl_ticks,
                  is_ambiguous AND exit_reason <> 'AMBIGUOUS_ENTRY_STOP' AS is_ambiguous,
                  CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN 'STOP' ELSE exit_reason END AS exit_reason) FROM exits_points""")
def _(m):
    return T.entry_first(point_exits(m))


CTES["excursions"] = """
SELECT instrument_id, trading_date, breakout_type, direction, horizon, bars_n AS bars, bars_n = horizon AS is_complete,
       CASE WHEN bars_n = horizon THEN greatest(0, CASE direction WHEN 'LONG' THEN hh - anchor ELSE anchor - ll END) END AS mfe_ticks,
       CASE WHEN bars_n = horizon THEN greatest(0, CASE direction WHEN 'LONG' THEN anchor - ll ELSE hh - anchor END) END AS mae_ticks
FROM (SELECT s.instrument_id, s.trading_date, s.breakout_type, s.direction, h.horizon, any_value(CASE s.direction WHEN 'LONG' THEN s.or_high ELSE s.or_low END) AS anchor,
             count(b.slot) AS bars_n, max(b.high) AS hh, min(b.low) AS ll
      FROM signals s CROSS JOIN (VALUES (1), (3), (6)) h(horizon)
      LEFT JOIN bars b ON b.instrument_id = s.instrument_id AND b.trading_date = s.trading_date AND b.slot > s.signal_slot AND b.slot <= s.signal_slot + h.horizon
      GROUP BY 1, 2, 3, 4, 5)"""


def excursions(m):
    return m.keep("excursions", lambda: T.forward_excursion(signals(m), m.bars(), (1, 3, 6)))


@query("D19_forward_excursion", "SELECT * FROM excursions")
def _(m):
    return excursions(m)


def last_slots(m):
    """The last expected slot of each session."""
    return cal.with_slots(m.calendar(), m.interval).select("trading_date", (F.col("slot_offset") + F.col("expected_bars") - 1).cast("bigint").alias("last_slot"))


@query("D19_session_end_excursion", """
SELECT instrument_id, trading_date, breakout_type, direction, CAST(NULL AS INTEGER) AS horizon, bars_n AS bars, bars_n = due AND due > 0 AS is_complete,
       CASE WHEN bars_n = due AND due > 0 THEN greatest(0, CASE direction WHEN 'LONG' THEN hh - anchor ELSE anchor - ll END) END AS mfe_ticks,
       CASE WHEN bars_n = due AND due > 0 THEN greatest(0, CASE direction WHEN 'LONG' THEN anchor - ll ELSE hh - anchor END) END AS mae_ticks
FROM (SELECT s.instrument_id, s.trading_date, s.breakout_type, s.direction, any_value(CASE s.direction WHEN 'LONG' THEN s.or_high ELSE s.or_low END) AS anchor,
             any_value(c.slot_offset + c.expected_bars - 1 - s.signal_slot) AS due, count(b.slot) AS bars_n, max(b.high) AS hh, min(b.low) AS ll
      FROM signals s JOIN slots c USING (trading_date) LEFT JOIN bars b ON b.instrument_id = s.instrument_id AND b.trading_date = s.trading_date AND b.slot > s.signal_slot GROUP BY 1, 2, 3, 4)""")
def _(m):
    return T.forward_excursion(signals(m), m.bars(), (), last_slots(m))


@query("D19_anchored_excursion", """
SELECT swing_id, instrument_id, trading_date, direction, slot, anchor, horizon, bars_n AS bars, bars_n = horizon AS is_complete,
       CASE WHEN bars_n = horizon THEN greatest(0, CASE direction WHEN 'LONG' THEN hh - anchor ELSE anchor - ll END) END AS mfe_ticks,
       CASE WHEN bars_n = horizon THEN greatest(0, CASE direction WHEN 'LONG' THEN anchor - ll ELSE hh - anchor END) END AS mae_ticks
FROM (SELECT s.swing_id, s.instrument_id, t.trading_date, CASE s.orientation WHEN 'UPPER' THEN 'LONG' ELSE 'SHORT' END AS direction, s.break_slot AS slot, s.close_ticks AS anchor, h.horizon,
             count(b.slot) AS bars_n, max(b.high) AS hh, min(b.low) AS ll
      FROM swing_breaks s JOIN bars t ON t.instrument_id = s.instrument_id AND t.slot = s.break_slot CROSS JOIN (VALUES (2), (5)) h(horizon)
      LEFT JOIN bars b ON b.instrument_id = s.instrument_id AND b.trading_date = t.trading_date AND b.slot > s.break_slot AND b.slot <= s.break_slot + h.horizon GROUP BY 1, 2, 3, 4, 5, 6, 7)""")
def _(m):
    from sessionloom.catalog.patterns import breaks
    at = m.bars().select("instrument_id", F.col("slot").alias("break_slot"), "trading_date")
    broken = breaks(m).join(at, ["instrument_id", "break_slot"])
    anchors = broken.select("swing_id", "instrument_id", "trading_date", F.when(F.col("orientation") == "UPPER", "LONG").otherwise("SHORT").alias("direction"),
                            F.col("break_slot").alias("slot"), F.col("close_ticks").alias("anchor"))
    return T.excursions_from(anchors, m.bars(), (2, 5))


@query("C32_signal_bar_excursion", """
SELECT s.instrument_id, s.trading_date, s.breakout_type, s.direction, s.signal_time,
       greatest(0, CASE s.direction WHEN 'LONG' THEN b.high - s.or_high ELSE s.or_low - b.low END) AS favourable_ticks,
       greatest(0, CASE s.direction WHEN 'LONG' THEN s.or_high - b.low ELSE b.high - s.or_low END) AS adverse_ticks
FROM signals s JOIN bars b ON b.instrument_id = s.instrument_id AND b.slot = s.signal_slot""")
def _(m):
    return T.signal_bar_excursion(signals(m), m.bars())


CTES["facts"] = """
SELECT instrument_id, bar_start, bar_end, bar_contract, level_id, level_type, level_ticks, orientation, level_contract, available_at, valid_from, valid_until, status,
       CASE WHEN act THEN CASE WHEN open < level_ticks THEN 'BELOW' WHEN open > level_ticks THEN 'ABOVE' ELSE 'AT' END END AS approach_side,
       CASE WHEN status = 'EVALUATED' AND orientation <> 'NEUTRAL' THEN CASE WHEN (orientation = 'UPPER') = up THEN 'ORIGINAL_SIDE' ELSE 'FAR_SIDE' END END AS approach_relation,
       CASE WHEN act THEN touch OR status = 'AMBIGUOUS_APPROACH' END AS touch, CASE WHEN ev THEN trade END AS trade_through,
       CASE WHEN ev THEN CASE WHEN up THEN close > level_ticks ELSE close < level_ticks END END AS close_through,
       CASE WHEN ev THEN touch AND back END AS reject, CASE WHEN ev THEN trade AND back END AS sweep,
       CASE WHEN act THEN open - level_ticks END AS open_offset_ticks, CASE WHEN act THEN high - level_ticks END AS high_offset_ticks,
       CASE WHEN act THEN low - level_ticks END AS low_offset_ticks, CASE WHEN act THEN close - level_ticks END AS close_offset_ticks
FROM (SELECT *, status IN ('EVALUATED', 'AMBIGUOUS_APPROACH') AS act, status = 'EVALUATED' AS ev, CASE WHEN up THEN high >= level_ticks ELSE low <= level_ticks END AS touch,
             CASE WHEN up THEN high > level_ticks ELSE low < level_ticks END AS trade, CASE WHEN up THEN close <= level_ticks ELSE close >= level_ticks END AS back
      FROM (SELECT b.instrument_id, b.bar_start, b.bar_end, b.contract AS bar_contract, b.open, b.high, b.low, b.close, l.level_id, l.level_type, l.level_ticks, l.orientation,
                   l.contract AS level_contract, l.available_at, l.valid_from, l.valid_until,
                   b.open < l.level_ticks OR (b.open = l.level_ticks AND l.orientation = 'UPPER') AS up,
                   CASE WHEN b.bar_start < l.available_at THEN 'PENDING_LEVEL' WHEN b.contract <> l.contract THEN 'CONTRACT_MISMATCH'
                        WHEN b.open = l.level_ticks AND l.orientation = 'NEUTRAL' THEN 'AMBIGUOUS_APPROACH' ELSE 'EVALUATED' END AS status
            FROM bars b JOIN levels l ON b.instrument_id = l.instrument_id AND b.bar_start >= l.valid_from AND b.bar_start < l.valid_until AND b.bar_end >= l.available_at))"""


def facts(m):
    return m.keep("facts", lambda: L.bar_level_interactions(m.bars(), m.levels()))


@query("D08_bar_level_interactions", "SELECT * EXCLUDE (level_type) FROM facts")
def _(m):
    return L.bar_level_interactions(m.bars(), m.levels())


@query("D08_interactions_only", "SELECT * EXCLUDE (level_type) FROM facts WHERE touch")
def _(m):
    return L.bar_level_interactions(m.bars(), m.levels(), interactions_only=True)


@query("D12_first_touch", """
SELECT instrument_id, level_id, min(bar_end) AS first_touch_at, min(bar_end) FILTER (trade_through) AS first_trade_through_at,
       min(bar_end) FILTER (close_through) AS first_close_through_at, count(*) AS touches FROM facts WHERE touch GROUP BY 1, 2""")
def _(m):
    return L.first_touches(m.bars(), m.levels())


CTES["window_facts"] = """
SELECT instrument_id, trading_date, level_id, level_type, orientation, level_ticks, status,
       CASE WHEN act THEN CASE WHEN open < level_ticks THEN 'BELOW' WHEN open > level_ticks THEN 'ABOVE' ELSE 'AT' END END AS approach_side,
       CASE WHEN act THEN touch OR status = 'AMBIGUOUS_APPROACH' END AS touch, CASE WHEN ev THEN trade END AS trade_through,
       CASE WHEN ev THEN CASE WHEN up THEN close > level_ticks ELSE close < level_ticks END END AS close_through,
       CASE WHEN ev THEN touch AND back END AS reject, CASE WHEN ev THEN trade AND back END AS sweep
FROM (SELECT *, status IN ('EVALUATED', 'AMBIGUOUS_APPROACH') AS act, status = 'EVALUATED' AS ev, CASE WHEN up THEN high >= level_ticks ELSE low <= level_ticks END AS touch,
             CASE WHEN up THEN high > level_ticks ELSE low < level_ticks END AS trade, CASE WHEN up THEN close <= level_ticks ELSE close >= level_ticks END AS back
      FROM (SELECT w.instrument_id, w.trading_date, w.or_open AS open, w.or_high AS high, w.or_low AS low, w.or_close AS close, l.level_id, l.level_type, l.orientation, l.level_ticks,
                   w.or_open < l.level_ticks OR (w.or_open = l.level_ticks AND l.orientation = 'UPPER') AS up,
                   CASE WHEN c.contract <> l.contract THEN 'CONTRACT_MISMATCH' WHEN w.or_open = l.level_ticks AND l.orientation = 'NEUTRAL' THEN 'AMBIGUOUS_APPROACH' ELSE 'EVALUATED' END AS status
            FROM or_levels w JOIN daily c USING (instrument_id, trading_date)
            JOIN levels l ON w.instrument_id = l.instrument_id AND w.trading_date = l.target_date WHERE w.valid))"""


def window_facts(m):
    contract = m.bars().select("instrument_id", "trading_date", "contract").distinct()
    windows = or_levels(m).filter("valid").join(contract, ["instrument_id", "trading_date"]).select(
        "instrument_id", "trading_date", "contract", F.col("or_open").alias("open"), F.col("or_high").alias("high"),
        F.col("or_low").alias("low"), F.col("or_close").alias("close"), F.col("or_end").alias("bar_end"),
        (F.col("or_end") - F.expr(f"make_dt_interval(0, 0, 0, {m.interval * m.settings.range_bars})")).alias("bar_start"))
    return L.window_level_interactions(windows, m.levels())


@query("D09_window_level_interactions", "SELECT * FROM window_facts")
def _(m):
    return window_facts(m)


CTES["consumption"] = """
SELECT o.object_id, o.instrument_id, o.segment_id, o.side, CASE WHEN b.slot IS NOT NULL THEN 'CONSUMED' WHEN e.reset_at IS NOT NULL THEN 'TERMINATED' ELSE 'ACTIVE' END AS status,
       coalesce(b.bar_end, e.reset_at) AS ended_at, CASE WHEN b.slot IS NOT NULL THEN 'CONSUMED' ELSE e.reset_reason END AS reason,
       CASE WHEN b.slot IS NOT NULL THEN o.theta END AS threshold_ticks, CASE o.side WHEN 'UPPER' THEN b.high - o.theta ELSE o.theta - b.low END AS excess_ticks,
       CASE o.side WHEN 'UPPER' THEN b.open > o.theta ELSE b.open < o.theta END AS gap_through, o.first_slot, b.slot AS hit_slot
FROM (SELECT s.swing_id AS object_id, s.instrument_id, s.segment_id, s.orientation AS side, s.available_slot + 1 AS first_slot,
             s.price_ticks + CASE s.orientation WHEN 'UPPER' THEN 500 ELSE -500 END AS theta,
             (SELECT min(b.slot) FROM seg b WHERE b.instrument_id = s.instrument_id AND b.segment_id = s.segment_id AND b.slot > s.available_slot
              AND CASE s.orientation WHEN 'UPPER' THEN b.high > s.price_ticks + 500 ELSE b.low < s.price_ticks - 500 END) AS hit FROM swings s) o
LEFT JOIN seg b ON b.instrument_id = o.instrument_id AND b.slot = o.hit LEFT JOIN episodes e ON e.instrument_id = o.instrument_id AND e.segment_id = o.segment_id"""


@query("D11_first_consumption", "SELECT * FROM consumption")
def _(m):
    versions = swings(m).select(
        F.col("swing_id").alias("object_id"), "instrument_id", "segment_id", F.col("orientation").alias("side"),
        (F.col("available_slot") + 1).alias("from_slot"), F.lit(None).cast("bigint").alias("until_slot"), "price_ticks",
        F.lit(500).cast("bigint").alias("tolerance_ticks"))
    return L.first_consumption(versions, m.segments(), episodes(m))
