"""Common table expressions of the DuckDB counterparts.

``compose`` prefixes a query with exactly the common tables it (transitively) names.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["prm"] = """
SELECT 3600::BIGINT AS iv, 9 * 3600 AS range_clock, 3 AS range_bars, 13 * 3600 AS cutoff_clock"""

CTES["ticks"] = """
SELECT event_type AS instrument_id, ts, event_id,
       CAST(1000000 + SUM((CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * CAST(ROUND(value*100) AS BIGINT))
         OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS price_ticks,
       CAST(1 AS BIGINT) AS size
FROM events"""

CTES["raw_bars"] = """
SELECT *, make_timestamp(s * 1000000) AS bar_start, make_timestamp((s + iv) * 1000000) AS bar_end,
       CAST(make_timestamp(s * 1000000) AS DATE) + CASE WHEN s % 86400 >= 64800 THEN 1 ELSE 0 END AS trading_date,
       CASE WHEN CAST(make_timestamp(s * 1000000) AS DATE) + CASE WHEN s % 86400 >= 64800 THEN 1 ELSE 0 END
                 < DATE '2024-01-16' THEN 'C1' ELSE 'C2' END AS contract
FROM (SELECT instrument_id, (epoch_us(ts) // (iv * 1000000)) * iv AS s, iv,
             arg_min(price_ticks, (ts, event_id)) AS open, max(price_ticks) AS high, min(price_ticks) AS low,
             arg_max(price_ticks, (ts, event_id)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n
      FROM ticks CROSS JOIN prm GROUP BY ALL)"""

CTES["calendar"] = """
SELECT trading_date, kind, CASE WHEN kind <> 'CLOSED' THEN regular_open END AS open,
       CASE kind WHEN 'CLOSED' THEN NULL WHEN 'MODIFIED' THEN trading_date + INTERVAL 13 HOUR ELSE regular_close END AS close,
       regular_open, regular_close, TRUE AS verified,
       CASE WHEN kind <> 'CLOSED' THEN CAST(sum(CASE WHEN kind <> 'CLOSED' THEN 1 ELSE 0 END) OVER (ORDER BY trading_date) AS BIGINT) END AS session_no,
       max(CASE WHEN kind <> 'CLOSED' THEN trading_date END) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_session,
       min(CASE WHEN kind <> 'CLOSED' THEN trading_date END) OVER (ORDER BY trading_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_session
FROM (SELECT d AS trading_date, d - INTERVAL 6 HOUR AS regular_open, d + INTERVAL 17 HOUR AS regular_close,
             CASE d WHEN DATE '2024-01-15' THEN 'CLOSED' WHEN DATE '2024-01-17' THEN 'MODIFIED' ELSE 'REGULAR' END AS kind
      FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d
            FROM (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) + 1 AS b FROM events))
      WHERE isodow(d) <= 5)"""

CTES["slots"] = """
SELECT *, CAST(coalesce(sum(expected_bars) OVER (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS slot_offset
FROM (SELECT *, CAST(ceil((epoch(close) - grid_start) / iv) AS BIGINT) AS expected_bars
      FROM (SELECT calendar.*, iv, CAST(ceil(epoch(open) / iv) AS BIGINT) * iv AS grid_start
            FROM calendar CROSS JOIN prm WHERE open IS NOT NULL))"""

CTES["schedule"] = """
SELECT trading_date, session_no, bucket, slot_offset + bucket AS slot,
       make_timestamp((grid_start + bucket * iv) * 1000000) AS bar_start,
       make_timestamp((grid_start + (bucket + 1) * iv) * 1000000) AS bar_end
FROM (SELECT *, CAST(unnest(range(0, expected_bars)) AS BIGINT) AS bucket FROM slots)"""

CTES["bars"] = """
SELECT r.instrument_id, r.contract, r.trading_date, c.session_no, c.slot_offset + (r.s - c.grid_start) // r.iv AS slot,
       r.bar_start, r.bar_end, r.open, r.high, r.low, r.close, r.volume, r.n
FROM raw_bars r JOIN slots c ON r.trading_date = c.trading_date AND r.bar_start >= c.open AND r.bar_start < c.close"""

CTES["seg"] = """
SELECT *, max(CASE WHEN brk THEN slot END) OVER (PARTITION BY instrument_id ORDER BY slot) AS segment_id
FROM (SELECT *, NOT coalesce(lag(slot) OVER w = slot - 1 AND lag(contract) OVER w = contract, FALSE) AS brk
      FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY slot))"""

CTES["daily"] = """
SELECT instrument_id, trading_date, min(contract) AS contract, max(high) AS high, min(low) AS low,
       arg_max(close, bar_end) AS close FROM bars GROUP BY ALL"""

CTES["levels"] = """
SELECT instrument_id, contract, source_trading_date, target_date, available_at, valid_from, valid_until,
       'SPECIFIC' AS contract_scope, level_type, orientation, level_ticks,
       level_type || ':' || CAST(target_date AS VARCHAR) || ':' || instrument_id AS level_id
FROM (SELECT d.instrument_id, d.contract, d.trading_date AS source_trading_date, c.next_session AS target_date,
             c.close AS available_at, t.open AS valid_from, t.close AS valid_until, d.high, d.low, d.close
      FROM daily d JOIN calendar c ON d.trading_date = c.trading_date JOIN calendar t ON c.next_session = t.trading_date) x
CROSS JOIN LATERAL (VALUES ('previous_day_high', 'UPPER', x.high), ('previous_day_low', 'LOWER', x.low),
                           ('previous_day_close', 'NEUTRAL', x.close)) v(level_type, orientation, level_ticks)"""

CTES["resampled"] = """
SELECT instrument_id, CASE WHEN min(contract) = max(contract) THEN min(contract) END AS contract, trading_date, session_no, bucket,
       make_timestamp(s * 1000000) AS bar_start, make_timestamp(e * 1000000) AS bar_end,
       arg_min(open, bar_end) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_end) AS close,
       CAST(sum(volume) AS BIGINT) AS volume, count(*) AS observed_bars,
       CAST(ceil((e - CAST(ceil(s / iv) AS BIGINT) * iv) / iv) AS BIGINT) AS expected_bars,
       count(*) = CAST(ceil((e - CAST(ceil(s / iv) AS BIGINT) * iv) / iv) AS BIGINT) AS is_complete,
       (e - s) < 14400 AS is_session_truncated, min(contract) <> max(contract) AS is_mixed_contract
FROM (SELECT b.* EXCLUDE (open, close), b.open AS open, b.close AS close, iv,
             (CAST(epoch(b.bar_start) AS BIGINT) - CAST(epoch(c.regular_open) AS BIGINT)) // 14400 AS bucket,
             greatest(CAST(epoch(c.regular_open) AS BIGINT) + ((CAST(epoch(b.bar_start) AS BIGINT) - CAST(epoch(c.regular_open) AS BIGINT)) // 14400) * 14400, CAST(epoch(c.open) AS BIGINT)) AS s,
             least(CAST(epoch(c.regular_open) AS BIGINT) + ((CAST(epoch(b.bar_start) AS BIGINT) - CAST(epoch(c.regular_open) AS BIGINT)) // 14400 + 1) * 14400, CAST(epoch(c.close) AS BIGINT)) AS e
      FROM bars b JOIN calendar c USING (trading_date) CROSS JOIN prm)
GROUP BY instrument_id, trading_date, session_no, bucket, s, e, iv"""

CTES["breaks"] = """
SELECT instrument_id, p_end AS previous_bar_end, bar_end AS next_bar_end,
       CASE WHEN session_no - p_session - 1 > 0 THEN 'MISSING_EXPECTED_SESSION' WHEN slot - p_slot - 1 > 0 THEN 'MISSING_EXPECTED_BUCKET'
            WHEN contract <> p_contract THEN 'CONTRACT_CHANGE' END AS reason,
       slot - p_slot - 1 AS missing_buckets, greatest(session_no - p_session - 1, 0) AS missing_sessions,
       contract <> p_contract AS contract_changed
FROM (SELECT *, lag(slot) OVER w AS p_slot, lag(session_no) OVER w AS p_session, lag(contract) OVER w AS p_contract,
             lag(bar_end) OVER w AS p_end FROM seg WINDOW w AS (PARTITION BY instrument_id ORDER BY slot))
WHERE brk AND p_slot IS NOT NULL"""

CTES["episodes"] = """
SELECT e.instrument_id, e.segment_id, e.contract, e.first_bar_start, e.last_bar_end, e.last_slot, e.bars,
       coalesce(n.bar_end, d.bar_end) AS reset_at,
       CASE WHEN n.bar_end IS NOT NULL THEN 'CONTRACT_CHANGE' WHEN d.bar_end IS NOT NULL THEN 'DATA_GAP' END AS reset_reason,
       CASE WHEN e.p_last IS NULL THEN 'DATA_START' WHEN e.p_last = e.segment_id - 1 THEN 'CONTRACT_CHANGE_REESTABLISHMENT'
            ELSE 'DATA_GAP_REESTABLISHMENT' END AS opening_cause, e.previous_contract
FROM (SELECT *, lag(last_slot) OVER (PARTITION BY instrument_id ORDER BY segment_id) AS p_last,
             lag(contract) OVER (PARTITION BY instrument_id ORDER BY segment_id) AS previous_contract
      FROM (SELECT instrument_id, segment_id, min(contract) AS contract, min(bar_start) AS first_bar_start, max(bar_end) AS last_bar_end,
                   max(slot) AS last_slot, count(*) AS bars FROM seg GROUP BY 1, 2)) e
LEFT JOIN bars n ON n.instrument_id = e.instrument_id AND n.slot = e.last_slot + 1
LEFT JOIN schedule d ON d.slot = e.last_slot + 1"""


CTES["sides"] = """
SELECT instrument_id, contract, segment_id, slot, bar_end, o AS orientation, CASE o WHEN 'UPPER' THEN high ELSE -low END AS v
FROM seg CROSS JOIN (VALUES ('UPPER'), ('LOWER')) t(o)"""

CTES["plateaus"] = """
SELECT instrument_id, contract, segment_id, orientation, run_start, min(v) AS v, min(bar_end) AS source_at,
       max(bar_end) AS source_end_at, max(slot) AS last_slot,
       max(CASE WHEN st THEN bef END) AS bef, max(CASE WHEN en THEN aft END) AS aft
FROM (SELECT *, max(CASE WHEN st THEN slot END) OVER (PARTITION BY instrument_id, segment_id, orientation ORDER BY slot) AS run_start
      FROM (SELECT *, coalesce(lag(v) OVER w <> v, TRUE) AS st, coalesce(lead(v) OVER w <> v, TRUE) AS en,
                   coalesce(list({'s': slot, 'v': v, 'e': bar_end}) OVER (PARTITION BY instrument_id, segment_id, orientation ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS bef,
                   coalesce(list({'s': slot, 'v': v, 'e': bar_end}) OVER (PARTITION BY instrument_id, segment_id, orientation ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS aft
            FROM sides WINDOW w AS (PARTITION BY instrument_id, segment_id, orientation ORDER BY slot)))
GROUP BY 1, 2, 3, 4, 5"""

CTES["swings"] = """
SELECT *, 'sw_' || sha256(concat_ws('|', instrument_id, contract, orientation, '2', '2', strftime(source_at, '%Y-%m-%dT%H:%M:%SZ'),
                                     strftime(source_end_at, '%Y-%m-%dT%H:%M:%SZ'))) AS swing_id
FROM (SELECT instrument_id, contract, segment_id, orientation, CASE orientation WHEN 'UPPER' THEN v ELSE -v END AS price_ticks,
             source_at, source_end_at, aft[-1].e AS available_at, run_start AS first_slot, last_slot, last_slot + 2 AS available_slot,
             2 AS left_depth, 2 AS right_depth
      FROM plateaus WHERE len(bef) = 2 AND len(aft) = 2 AND len(list_filter(bef, lambda x: x.v > v)) = 0
                      AND len(list_filter(aft, lambda x: x.v > v)) = 0)"""

CTES["swing_breaks"] = """
SELECT *, 'sb_' || sha256(swing_id || '|' || strftime(bar_end, '%Y-%m-%dT%H:%M:%SZ')) AS break_id
FROM (SELECT s.swing_id, s.instrument_id, s.contract, s.segment_id, s.orientation, s.price_ticks AS level_ticks, b.bar_start, b.bar_end,
             b.bar_end AS available_at, b.slot AS break_slot, b.close AS close_ticks, abs(b.close - s.price_ticks) AS close_excess_ticks
      FROM swings s JOIN seg b ON b.instrument_id = s.instrument_id AND b.segment_id = s.segment_id AND b.bar_start >= s.available_at
       AND CASE s.orientation WHEN 'UPPER' THEN b.close > s.price_ticks ELSE b.close < s.price_ticks END
      QUALIFY row_number() OVER (PARTITION BY s.swing_id ORDER BY b.slot) = 1)"""

CTES["wick_gaps"] = """
SELECT instrument_id, contract, segment_id, trading_date, direction, lower_ticks, upper_ticks, lower_ticks + upper_ticks AS mid2_ticks,
       upper_ticks - lower_ticks AS width_ticks, c1_start, c1_end, c2_end, bar_end AS available_at, slot AS available_slot,
       CASE WHEN NOT directional THEN 'C2_NOT_DIRECTIONAL' WHEN NOT spans THEN 'C2_BODY_NOT_SPANNING' ELSE 'ZONE' END AS verdict,
       CASE WHEN slot - segment_id >= 17 THEN CAST(trs AS BIGINT) END AS baseline_sum_ticks,
       CASE WHEN slot - segment_id < 17 THEN 'INSUFFICIENT_HISTORY' WHEN trs > 0 THEN 'OK' ELSE 'ZERO_BASELINE' END AS normalization_status,
       CASE WHEN slot - segment_id >= 17 AND trs > 0 THEN (upper_ticks - lower_ticks) * 14 / CAST(trs AS DOUBLE) END AS strength
FROM (SELECT *, CASE WHEN low > h1 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN low > h1 THEN h1 ELSE high END AS lower_ticks,
             CASE WHEN low > h1 THEN low ELSE l1 END AS upper_ticks, CASE WHEN low > h1 THEN c2 > o2 ELSE c2 < o2 END AS directional,
             CASE WHEN low > h1 THEN o2 <= h1 AND c2 >= low ELSE o2 >= l1 AND c2 <= high END AS spans
      FROM (SELECT *, sum(tr) OVER (PARTITION BY instrument_id, segment_id ORDER BY slot ROWS BETWEEN 16 PRECEDING AND 3 PRECEDING) AS trs
            FROM (SELECT *, lag(high, 2) OVER w AS h1, lag(low, 2) OVER w AS l1, lag(open) OVER w AS o2, lag(close) OVER w AS c2,
                         lag(bar_start, 2) OVER w AS c1_start, lag(bar_end, 2) OVER w AS c1_end, lag(bar_end) OVER w AS c2_end,
                         greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
                  FROM seg WINDOW w AS (PARTITION BY instrument_id, segment_id ORDER BY slot)))
      WHERE low > h1 OR high < l1)"""

CTES["zones"] = """
SELECT * EXCLUDE (verdict), 'gz_' || sha256(concat_ws('|', instrument_id, contract, direction, strftime(c1_end, '%Y-%m-%dT%H:%M:%SZ'),
       strftime(available_at, '%Y-%m-%dT%H:%M:%SZ'))) AS zone_id FROM wick_gaps WHERE verdict = 'ZONE'"""

CTES["zone_conv"] = """
SELECT z.*, (SELECT min(b.slot) FROM seg b WHERE b.instrument_id = z.instrument_id AND b.segment_id = z.segment_id AND b.slot > z.available_slot
             AND CASE z.direction WHEN 'BULLISH' THEN b.close < z.lower_ticks ELSE b.close > z.upper_ticks END) AS conversion_slot
FROM zones z"""

CTES["zone_life"] = """
SELECT z.* EXCLUDE (reset_at, reset_reason), reset_at, reset_reason, c.bar_end AS converted_at, c.close AS conversion_close, r.close AS retire_close,
       CASE WHEN r.slot IS NOT NULL THEN 'RETIRED' WHEN reset_reason = 'DATA_GAP' THEN 'TERMINATED' WHEN reset_reason IS NOT NULL THEN 'PENDING' END AS exit_kind,
       coalesce(r.bar_end, reset_at) AS exit_at
FROM (SELECT z.*, e.reset_at, e.reset_reason,
             (SELECT min(b.slot) FROM seg b WHERE b.instrument_id = z.instrument_id AND b.segment_id = z.segment_id AND b.slot > z.conversion_slot
              AND CASE z.direction WHEN 'BULLISH' THEN b.close > z.upper_ticks ELSE b.close < z.lower_ticks END) AS retire_slot
      FROM zone_conv z LEFT JOIN episodes e ON e.instrument_id = z.instrument_id AND e.segment_id = z.segment_id) z
LEFT JOIN seg c ON c.instrument_id = z.instrument_id AND c.slot = z.conversion_slot
LEFT JOIN seg r ON r.instrument_id = z.instrument_id AND r.slot = z.retire_slot"""

CTES["stages"] = """
SELECT zone_id, instrument_id, contract, segment_id, lower_ticks, upper_ticks, mid2_ticks, 'FVG' AS stage, direction AS current_direction,
       available_at AS stage_start, available_slot AS start_slot, coalesce(converted_at, exit_at) AS stage_end, conversion_slot AS close_slot,
       CASE WHEN converted_at IS NOT NULL THEN 'CONVERTED' ELSE exit_kind END AS end_kind FROM zone_life
UNION ALL
SELECT zone_id, instrument_id, contract, segment_id, lower_ticks, upper_ticks, mid2_ticks, 'IFVG',
       CASE direction WHEN 'BULLISH' THEN 'BEARISH' ELSE 'BULLISH' END, converted_at, conversion_slot, exit_at, retire_slot, exit_kind
FROM zone_life WHERE converted_at IS NOT NULL"""

CTES["life_bars"] = """
SELECT *, CASE WHEN bull THEN low < upper_ticks AND high >= lower_ticks ELSE high > lower_ticks AND low <= upper_ticks END AS is_trade,
       CASE WHEN bull THEN high < lower_ticks ELSE low > upper_ticks END AS is_beyond
FROM (SELECT s.zone_id, s.stage, s.instrument_id, s.contract, s.segment_id, s.current_direction, s.lower_ticks, s.upper_ticks, s.mid2_ticks, s.start_slot,
             s.current_direction = 'BULLISH' AS bull, b.slot, b.bar_end, b.open, b.high, b.low, b.close
      FROM stages s JOIN seg b ON b.instrument_id = s.instrument_id AND b.segment_id = s.segment_id AND b.slot > s.start_slot
       AND (s.close_slot IS NULL OR b.slot <= s.close_slot))"""

CTES["touches"] = """
SELECT * EXCLUDE (bull), low <= lower_ticks AND high >= upper_ticks AS is_spanning, CASE WHEN bull THEN high = lower_ticks ELSE low = upper_ticks END AS is_far,
       CASE WHEN bull THEN 2 * low <= mid2_ticks ELSE 2 * high >= mid2_ticks END AS is_midpoint,
       CASE WHEN bull THEN low <= lower_ticks ELSE high >= upper_ticks END AS is_full,
       CASE WHEN bull THEN upper_ticks - low ELSE high - lower_ticks END AS depth_ticks,
       CASE WHEN bull THEN upper_ticks - greatest(low, lower_ticks) ELSE least(high, upper_ticks) - lower_ticks END AS in_zone_ticks
FROM life_bars WHERE is_trade"""

CTES["zone_pairs"] = """
SELECT instrument_id, contract, segment_id, zone_a, stage_a, zone_b, stage_b, 'BASE' AS timeframe_a, 'BASE' AS timeframe_b,
       CASE WHEN same THEN 'FVG_OVERLAP' ELSE 'BPR' END AS label,
       CASE WHEN same OR (ma AND NOT mb) THEN da WHEN mb AND NOT ma THEN db ELSE 'UNDEFINED' END AS direction,
       CASE WHEN NOT same AND ma <> mb THEN 'BASE' END AS governing_timeframe,
       CASE WHEN ma AND mb THEN 'BOTH' WHEN ma THEN 'A' ELSE 'B' END AS movers,
       lower_ticks, upper_ticks, created_at, created_slot, ended_at,
       CASE WHEN ended_at IS NULL THEN NULL WHEN ea IS NOT DISTINCT FROM ended_at AND ka <> 'CONVERTED' THEN 'PARENT_' || ka
            WHEN eb IS NOT DISTINCT FROM ended_at AND kb <> 'CONVERTED' THEN 'PARENT_' || kb ELSE 'PARENT_STAGE_CHANGED' END AS end_reason
FROM (SELECT a.instrument_id, a.contract, a.segment_id, a.zone_id AS zone_a, a.stage AS stage_a, b.zone_id AS zone_b, b.stage AS stage_b,
             a.current_direction AS da, b.current_direction AS db, a.current_direction = b.current_direction AS same,
             greatest(a.lower_ticks, b.lower_ticks) AS lower_ticks, least(a.upper_ticks, b.upper_ticks) AS upper_ticks,
             greatest(a.stage_start, b.stage_start) AS created_at, greatest(a.start_slot, b.start_slot) AS created_slot,
             CASE WHEN a.stage_end IS NULL THEN b.stage_end WHEN b.stage_end IS NULL THEN a.stage_end ELSE least(a.stage_end, b.stage_end) END AS ended_at,
             a.stage_start >= b.stage_start AS ma, b.stage_start >= a.stage_start AS mb, a.stage_end AS ea, b.stage_end AS eb, a.end_kind AS ka, b.end_kind AS kb
      FROM stages a JOIN stages b ON a.instrument_id = b.instrument_id AND a.contract = b.contract AND a.zone_id < b.zone_id
       AND least(a.upper_ticks, b.upper_ticks) - greatest(a.lower_ticks, b.lower_ticks) >= 1)
WHERE ended_at IS NULL OR created_at < ended_at"""


def _needed(text: str, limit: int, seen: set[str]) -> None:
    """Collect the tables ``text`` names; a table may only use tables registered before it."""
    for index, (name, body) in enumerate(CTES.items()):
        if index < limit and name not in seen and re.search(rf"\b{name}\b", text):
            seen.add(name)
            _needed(body, index, seen)


def compose(sql: str) -> str:
    # the same rounding offset as functions.scalars.r6
    sql = sql.replace(", 6)", " + 1e-10, 6)")
    names: set[str] = set()
    _needed(sql, len(CTES), names)
    order = [n for n in CTES if n in names]
    if not order:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n].replace(', 6)', ' + 1e-10, 6)')})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[5:]
    return head + "\n" + body
