"""Swings, gap zones, life cycles and overlaps, of one timeframe and across timeframes."""
import re

from pyspark.sql import functions as F

from sessionloom.catalog.registry import query
from sessionloom.catalog.sql import CTES
from sessionloom.operators import bars as B
from sessionloom.operators import patterns as P
from sessionloom.operators import state as K
from sessionloom.sources import calendar as cal

PRICE_CELL = 65_536  # ticks per price cell of the test walk, several bars wide


def swings(m):
    return m.keep("swings", lambda: P.swing_points(m.segments(), 2, 2))


def breaks(m):
    return m.keep("breaks", lambda: P.first_close_beyond(swings(m), m.segments()))


def episodes(m):
    return m.keep("episodes", lambda: B.episodes(m.segments(), m.schedule()))


def zones(m):
    return m.keep("zones", lambda: P.gap_zones(m.segments()))


def life(m):
    return m.keep("life", lambda: P.zone_lifecycle(zones(m), m.segments(), episodes(m)))


def stages(m):
    return P.zone_stages(life(m))


def touches(m):
    return m.keep("touches", lambda: P.zone_touches(stages(m), m.segments(), price_size=PRICE_CELL))


def overlaps(m):
    return m.keep("overlaps", lambda: P.zone_overlaps(stages(m), price_size=PRICE_CELL))


@query("F03_swing_points", "SELECT * FROM swings")
def _(m):
    return swings(m)


@query("F04_swing_candidates", """
SELECT instrument_id, contract, segment_id, orientation, CASE orientation WHEN 'UPPER' THEN v ELSE -v END AS price_ticks, source_at, source_end_at, status,
       CASE WHEN status = 'INVALIDATED_STRICT_EXCEED' THEN CASE WHEN lh IS NOT NULL THEN 'LEFT' ELSE 'RIGHT' END END AS invalidating_side,
       CASE WHEN status = 'INVALIDATED_STRICT_EXCEED' THEN coalesce(lh.e, rh.e) END AS invalidating_bar_end,
       CASE WHEN status = 'INVALIDATED_STRICT_EXCEED' THEN coalesce(lh.v, rh.v) - v END AS invalidating_excess_ticks,
       CASE WHEN status = 'CONTINUITY_BREAK' THEN reason END AS break_reason, CASE WHEN status = 'CONFIRMED' THEN aft[-1].e END AS available_at
FROM (SELECT *, CASE WHEN len(bef) < 2 THEN 'INSUFFICIENT_LEFT_HISTORY' WHEN lh IS NOT NULL OR rh IS NOT NULL THEN 'INVALIDATED_STRICT_EXCEED'
                     WHEN len(aft) < 2 AND reason IS NULL THEN 'INSUFFICIENT_FUTURE_COVERAGE' WHEN len(aft) < 2 THEN 'CONTINUITY_BREAK' ELSE 'CONFIRMED' END AS status
      FROM (SELECT p.*, k.reason, list_filter(bef, lambda x: x.v > p.v)[-1] AS lh, list_filter(aft, lambda x: x.v > p.v)[1] AS rh
            FROM plateaus p JOIN (SELECT instrument_id, segment_id, max(bar_end) AS last_end FROM seg GROUP BY 1, 2) g USING (instrument_id, segment_id)
            LEFT JOIN breaks k ON k.instrument_id = p.instrument_id AND k.previous_bar_end = g.last_end))""")
def _(m):
    return P.swing_candidates(m.segments(), B.continuity_breaks(m.bars()), 2, 2)


@query("D10_first_close_beyond", "SELECT * FROM swing_breaks")
def _(m):
    return P.first_close_beyond(swings(m), m.segments())


@query("J01_next_beyond_search", """
SELECT s.swing_id, s.instrument_id, min(b.slot) AS touch_slot
FROM swings s LEFT JOIN seg b ON b.instrument_id = s.instrument_id AND b.segment_id = s.segment_id AND b.slot > s.available_slot
 AND CASE s.orientation WHEN 'UPPER' THEN b.high > s.price_ticks ELSE b.low < s.price_ticks END GROUP BY 1, 2""")
def _(m):
    levels = swings(m).withColumn("_from", F.col("available_slot") + 1)
    found = P.first_beyond(levels, m.segments(), P.SEGMENT, ordinal="slot", above="high", below="low", start="_from",
                           threshold="price_ticks", side="orientation", out="touch_slot")
    return found.select("swing_id", "instrument_id", "touch_slot")


@query("F12_gap_zones", "SELECT * FROM zones")
def _(m):
    return P.gap_zones(m.segments())


@query("F12_rejected_gaps", "SELECT instrument_id, contract, direction, c1_end, available_at, verdict FROM wick_gaps WHERE verdict <> 'ZONE'")
def _(m):
    return P.wick_gaps(m.segments()).filter("verdict <> 'ZONE'").select(
        "instrument_id", "contract", "direction", "c1_end", "available_at", "verdict")


@query("F18_true_range", """
SELECT instrument_id, contract, segment_id, slot, bar_end,
       CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS true_range
FROM seg WINDOW w AS (PARTITION BY instrument_id, segment_id ORDER BY slot)""")
def _(m):
    return P.true_range(m.segments())


@query("D13_zone_lifecycle", "SELECT * FROM zone_life")
def _(m):
    return life(m)


@query("D13_zone_stages", "SELECT * FROM stages")
def _(m):
    return stages(m)


@query("D15_life_interval_touches", "SELECT zone_id, stage, slot, bar_end, is_spanning, is_far, is_midpoint, is_full, depth_ticks, in_zone_ticks FROM touches")
def _(m):
    return touches(m).select("zone_id", "stage", "slot", "bar_end", "is_spanning", "is_far", "is_midpoint", "is_full",
                             "depth_ticks", "in_zone_ticks")


@query("F13_mitigation_events", """
WITH t AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN is_midpoint THEN 1 ELSE 0 END) OVER w AS m, sum(CASE WHEN is_full THEN 1 ELSE 0 END) OVER w AS f,
                  max(depth_ticks) OVER (PARTITION BY zone_id, stage ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deep,
                  CASE WHEN is_spanning THEN 'SPANNING' WHEN is_far THEN 'FAR_CONTACT' ELSE 'ZONE_TRADE' END AS observation_class
           FROM touches WINDOW w AS (PARTITION BY zone_id, stage ORDER BY slot))
SELECT zone_id, stage, 'PENETRATION' AS event_kind, slot, bar_end, observation_class, depth_ticks, in_zone_ticks FROM t WHERE rn = 1
UNION ALL SELECT zone_id, stage, 'MIDPOINT', slot, bar_end, observation_class, depth_ticks, in_zone_ticks FROM t WHERE is_midpoint AND m = 1
UNION ALL SELECT zone_id, stage, 'FULL', slot, bar_end, observation_class, depth_ticks, in_zone_ticks FROM t WHERE is_full AND f = 1
UNION ALL SELECT zone_id, stage, 'DEPTH', slot, bar_end, observation_class, depth_ticks, in_zone_ticks FROM t WHERE deep IS NULL OR depth_ticks > deep
UNION ALL SELECT zone_id, stage, 'GAP_THROUGH', slot, bar_end, 'BEYOND', NULL, NULL
FROM (SELECT *, min(CASE WHEN is_trade THEN slot END) OVER (PARTITION BY zone_id, stage) AS ft, min(CASE WHEN is_beyond THEN slot END) OVER (PARTITION BY zone_id, stage) AS fb FROM life_bars)
WHERE slot = fb AND (ft IS NULL OR fb < ft)""")
def _(m):
    return P.mitigation_events(stages(m), touches(m), m.segments())


@query("D16_zone_overlap_pairs", "SELECT * FROM zone_pairs")
def _(m):
    return overlaps(m)


@query("D14_bpr_lifecycle", """
SELECT 'bp_' || sha256(concat_ws('|', zone_a, stage_a, zone_b, stage_b)) AS bpr_id, o.instrument_id, o.contract, o.segment_id, label, direction, governing_timeframe,
       zone_a, stage_a, zone_b, stage_b, lower_ticks, upper_ticks, upper_ticks - lower_ticks AS width_ticks, created_at AS available_at,
       CASE WHEN r.bar_end IS NOT NULL THEN 'RETIRED' WHEN reset_reason = 'DATA_GAP' THEN 'TERMINATED' WHEN reset_reason IS NOT NULL THEN 'PENDING' END AS exit_state,
       coalesce(r.bar_end, reset_at) AS exit_at
FROM (SELECT o.*, (SELECT min(b.slot) FROM seg b WHERE o.direction <> 'UNDEFINED' AND b.instrument_id = o.instrument_id AND b.segment_id = o.segment_id AND b.slot > o.created_slot
                   AND CASE o.direction WHEN 'BULLISH' THEN b.close < o.lower_ticks ELSE b.close > o.upper_ticks END) AS rs
      FROM zone_pairs o WHERE label <> 'FVG_OVERLAP') o
LEFT JOIN episodes e ON e.instrument_id = o.instrument_id AND e.segment_id = o.segment_id
LEFT JOIN seg r ON r.instrument_id = o.instrument_id AND r.slot = o.rs""")
def _(m):
    return P.bpr_lifecycle(overlaps(m), m.segments(), episodes(m))


# --- several timeframes ---------------------------------------------------------
# Base bars and session-anchored bars of four hours; zones of each live on their own bars, resets come from the base bars.
FRAMES = {"60m": None, "240m": 14_400}
AT = "TIMESTAMP '2024-01-18 22:00:00'"
_CHAIN = ("seg", "wick_gaps", "zones", "zone_conv", "zone_life", "stages")

CTES["schedule_h4"] = """
SELECT trading_date, bucket, row_number() OVER (ORDER BY trading_date, bucket) - 1 AS slot
FROM (SELECT trading_date, CAST(unnest(range(CAST(floor((epoch(open) - epoch(regular_open)) / 14400) AS BIGINT), CAST(ceil((epoch(close) - epoch(regular_open)) / 14400) AS BIGINT))) AS BIGINT) AS bucket
      FROM calendar WHERE open IS NOT NULL)"""
CTES["bars_h4"] = "SELECT r.*, s.slot FROM resampled r JOIN schedule_h4 s USING (trading_date, bucket) WHERE is_complete AND NOT is_mixed_contract"
for _name in _CHAIN:
    _body = re.sub(rf"\b(bars|{'|'.join(_CHAIN)})\b", r"\1_h4", CTES[_name])
    CTES[f"{_name}_h4"] = _body.replace("e.segment_id = z.segment_id) z", "z.available_at > e.first_bar_start AND z.available_at <= e.last_bar_end) z")
CTES["seg_mtf"] = " UNION ALL ".join(f"SELECT '{f}' AS timeframe, instrument_id, segment_id, slot, bar_end, close FROM {t}" for f, t in (("60m", "seg"), ("240m", "seg_h4")))
CTES["stages_mtf"] = " UNION ALL ".join(f"SELECT '{f}' AS timeframe, * REPLACE ('{f}:' || zone_id AS zone_id) FROM {t}" for f, t in (("60m", "stages"), ("240m", "stages_h4")))
CTES["zone_pairs_mtf"] = """
SELECT instrument_id, contract, segment_id, zone_a, stage_a, zone_b, stage_b, timeframe_a, timeframe_b,
       CASE WHEN da = db THEN 'FVG_OVERLAP' WHEN timeframe_a = timeframe_b THEN 'BPR' ELSE 'MTF_BPR' END AS label,
       CASE WHEN da = db THEN da WHEN sa > sb THEN da WHEN sb > sa THEN db ELSE 'UNDEFINED' END AS direction,
       CASE WHEN da <> db AND sa > sb THEN timeframe_a WHEN da <> db AND sb > sa THEN timeframe_b END AS governing_timeframe,
       CASE WHEN sa = sb THEN 'BOTH' WHEN sa > sb THEN 'A' ELSE 'B' END AS movers, lower_ticks, upper_ticks, created_at, created_slot, ended_at,
       CASE WHEN ended_at IS NULL THEN NULL WHEN ea IS NOT DISTINCT FROM ended_at AND ka <> 'CONVERTED' THEN 'PARENT_' || ka
            WHEN eb IS NOT DISTINCT FROM ended_at AND kb <> 'CONVERTED' THEN 'PARENT_' || kb ELSE 'PARENT_STAGE_CHANGED' END AS end_reason
FROM (SELECT a.instrument_id, a.contract, a.zone_id AS zone_a, a.stage AS stage_a, b.zone_id AS zone_b, b.stage AS stage_b, a.timeframe AS timeframe_a, b.timeframe AS timeframe_b,
             a.current_direction AS da, b.current_direction AS db, a.stage_start AS sa, b.stage_start AS sb, a.stage_end AS ea, b.stage_end AS eb, a.end_kind AS ka, b.end_kind AS kb,
             greatest(a.lower_ticks, b.lower_ticks) AS lower_ticks, least(a.upper_ticks, b.upper_ticks) AS upper_ticks, greatest(a.stage_start, b.stage_start) AS created_at,
             CASE WHEN a.stage_start >= b.stage_start THEN a.segment_id ELSE b.segment_id END AS segment_id, CASE WHEN a.stage_start >= b.stage_start THEN a.start_slot ELSE b.start_slot END AS created_slot,
             least(coalesce(a.stage_end, b.stage_end), coalesce(b.stage_end, a.stage_end)) AS ended_at
      FROM stages_mtf a JOIN stages_mtf b ON a.instrument_id = b.instrument_id AND a.contract = b.contract AND a.zone_id < b.zone_id
       AND least(a.upper_ticks, b.upper_ticks) - greatest(a.lower_ticks, b.lower_ticks) >= 1)
WHERE ended_at IS NULL OR created_at < ended_at"""
CTES["bprs_mtf"] = """
SELECT 'bp_' || sha256(concat_ws('|', zone_a, stage_a, zone_b, stage_b)) AS bpr_id, o.instrument_id, o.contract, o.segment_id, label, direction, governing_timeframe,
       zone_a, stage_a, zone_b, stage_b, lower_ticks, upper_ticks, upper_ticks - lower_ticks AS width_ticks, created_at AS available_at,
       CASE WHEN retired IS NOT NULL THEN 'RETIRED' WHEN reset_reason = 'DATA_GAP' THEN 'TERMINATED' WHEN reset_reason IS NOT NULL THEN 'PENDING' END AS exit_state,
       coalesce(retired, reset_at) AS exit_at
FROM (SELECT o.*, (SELECT min(b.bar_end) FROM seg_mtf b WHERE o.direction <> 'UNDEFINED' AND b.timeframe = o.governing_timeframe AND b.instrument_id = o.instrument_id AND b.segment_id = o.segment_id
                   AND b.slot > o.created_slot AND CASE o.direction WHEN 'BULLISH' THEN b.close < o.lower_ticks ELSE b.close > o.upper_ticks END) AS retired
      FROM zone_pairs_mtf o WHERE label <> 'FVG_OVERLAP') o
LEFT JOIN episodes e ON e.instrument_id = o.instrument_id AND o.created_at > e.first_bar_start AND o.created_at <= e.last_bar_end"""


def frame_segments(m, name):
    if FRAMES[name] is None:
        return m.segments()
    schedule = cal.expected_schedule(m.calendar(), m.interval, FRAMES[name])
    return m.keep(f"segments_{name}", lambda: B.timeframe_segments(m.bars(), m.calendar(), schedule, m.interval, FRAMES[name]))


def frame_life(m, name):
    zones_of = P.gap_zones(frame_segments(m, name)).withColumn("zone_id", F.concat(F.lit(f"{name}:"), "zone_id"))
    return P.zone_lifecycle(zones_of, frame_segments(m, name), episodes(m), tape=True).withColumn("timeframe", F.lit(name))


def mtf_stages(m):
    one, *more = [P.zone_stages(frame_life(m, name)) for name in FRAMES]
    for other in more:
        one = one.unionByName(other)
    return m.keep("mtf_stages", lambda: one)


def mtf_overlaps(m):
    return m.keep("mtf_overlaps", lambda: P.zone_overlaps(mtf_stages(m), price_size=PRICE_CELL))


def mtf_bars(m):
    columns = ["instrument_id", "segment_id", "slot", "bar_end", "close"]
    one, *more = [frame_segments(m, name).select(F.lit(name).alias("timeframe"), *columns) for name in FRAMES]
    for other in more:
        one = one.unionByName(other)
    return m.keep("mtf_bars", lambda: one)


def mtf_bprs(m):
    return m.keep("mtf_bprs", lambda: P.bpr_lifecycle(mtf_overlaps(m), mtf_bars(m), episodes(m)))


@query("F01_timeframe_segments", "SELECT instrument_id, contract, trading_date, bucket, slot, segment_id, bar_start, bar_end, open, high, low, close FROM seg_h4")
def _(m):
    return frame_segments(m, "240m").select("instrument_id", "contract", "trading_date", "bucket", "slot", "segment_id", "bar_start", "bar_end", "open", "high", "low", "close")


@query("D13_timeframe_stages", "SELECT * FROM stages_mtf")
def _(m):
    return mtf_stages(m)


@query("D16_mtf_overlap_pairs", "SELECT * FROM zone_pairs_mtf")
def _(m):
    return mtf_overlaps(m)


@query("D14_mtf_bpr_lifecycle", "SELECT * FROM bprs_mtf")
def _(m):
    return mtf_bprs(m)


@query("K05_active_bprs", f"SELECT bpr_id, instrument_id, label, direction, governing_timeframe, lower_ticks, upper_ticks, available_at FROM bprs_mtf WHERE available_at <= {AT} AND (exit_at IS NULL OR exit_at > {AT})")
def _(m):
    now = F.lit(AT.split("'")[1]).cast("timestamp")
    rows = K.as_of(mtf_bprs(m), now, "available_at", "exit_at", ("exit_at", "exit_state")).filter("exit_at is null")
    return rows.select("bpr_id", "instrument_id", "label", "direction", "governing_timeframe", "lower_ticks", "upper_ticks", "available_at")


@query("G02_rank_mtf_bprs", """
SELECT bpr_id, instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY CASE governing_timeframe WHEN '240m' THEN 0 ELSE 1 END, width_ticks DESC, available_at, bpr_id) AS bpr_rank
FROM bprs_mtf WHERE direction <> 'UNDEFINED'""")
def _(m):
    rows = mtf_bprs(m).filter("direction <> 'UNDEFINED'")
    rows = rows.withColumns({"_frame": F.when(F.col("governing_timeframe") == "240m", 0).otherwise(1), "_w": -F.col("width_ticks"), "_range": F.floor(-F.col("width_ticks") / 64)})
    return K.ranked(rows, ["instrument_id"], [["_frame"], ["_range"]], ["_w", "available_at", "bpr_id"], "bpr_rank").select("bpr_id", "instrument_id", "bpr_rank")
