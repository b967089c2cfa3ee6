"""Breakout events with market states, grouping-set summaries, patterns."""
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6

from sessionloom.catalog.context import context_levels, history, or_context
from sessionloom.catalog.registry import query
from sessionloom.catalog.sql import CTES
from sessionloom.catalog.sweeps import executed, migration, surface
from sessionloom.catalog.trades import excursions, facts, or_levels, signals, window_facts
from sessionloom.functions import scalars as C
from sessionloom.operators import states as ST
from sessionloom.operators import stats as S

PRIORITY = ("previous_day_high", "previous_day_low", "previous_day_close", "previous_rth_high", "previous_rth_low", "previous_rth_close",
            "overnight_high", "overnight_low", "asia_high", "asia_low", "london_high", "london_low")

CTES["joined"] = """
SELECT s.*, o.or_direction, o.or_net_ticks, o.or_efficiency, o.or_close_location, o.or_width_ticks, h.hist_5_percentile, h.hist_5_available, o.instrument_id IS NOT NULL AS is_matched
FROM signals s LEFT JOIN or_context o USING (instrument_id, trading_date) LEFT JOIN history h USING (instrument_id, trading_date)"""


def features(m):
    keep = ["instrument_id", "trading_date", "or_direction", "or_net_ticks", "or_efficiency", "or_close_location", "or_width_ticks"]
    return or_context(m).select(*keep).join(history(m).select("instrument_id", "trading_date", "hist_5_percentile", "hist_5_available"),
                                            ["instrument_id", "trading_date"])


def joined(m):
    return m.keep("joined", lambda: ST.join_features_outcomes(signals(m), features(m)))


@query("D01_join_features_outcomes", "SELECT * FROM joined")
def _(m):
    return joined(m)


CTES["dir_state"] = """
SELECT *, CASE WHEN or_direction = 'FLAT' THEN 'FLAT' WHEN (direction = 'LONG' AND or_direction = 'UP') OR (direction = 'SHORT' AND or_direction = 'DOWN') THEN 'ALIGNED' WHEN or_direction IS NOT NULL THEN 'OPPOSED' END AS alignment,
       CASE direction WHEN 'LONG' THEN or_net_ticks ELSE -or_net_ticks END AS directional_net_ticks, round(CASE direction WHEN 'LONG' THEN or_close_location ELSE 1 - or_close_location END, 9) AS directional_location FROM joined"""


@query("C12_directional_state", "SELECT * FROM dir_state")
def _(m):
    return ST.directional_state(joined(m))


CTES["halves"] = "SELECT trading_date, CASE WHEN row_number() OVER (ORDER BY trading_date) <= count(*) OVER () // 2 THEN 'FIRST' ELSE 'SECOND' END AS half FROM (SELECT DISTINCT trading_date FROM signals)"


@query("C17_half_labels", "SELECT instrument_id, s.trading_date, breakout_type, direction, half FROM signals s JOIN halves USING (trading_date)")
def _(m):
    return ST.half_labels(signals(m)).select("instrument_id", "trading_date", "breakout_type", "direction", "half")


BAND_SQL = "CASE WHEN hist_5_percentile < 0.2 THEN 'P00_20' WHEN hist_5_percentile < 0.4 THEN 'P20_40' WHEN hist_5_percentile < 0.6 THEN 'P40_60' WHEN hist_5_percentile < 0.8 THEN 'P60_80' WHEN hist_5_percentile <= 1 THEN 'P80_100' END"


@query("C14_percentile_band", f"SELECT instrument_id, trading_date, hist_5_percentile, {BAND_SQL} AS band FROM history")
def _(m):
    return history(m).select("instrument_id", "trading_date", "hist_5_percentile", C.percentile_band(F.col("hist_5_percentile")).alias("band"))


CTES["eff_edges"] = "SELECT list_distinct(quantile_cont(or_efficiency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS raw, list_sort(list_distinct(quantile_cont(or_efficiency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM joined WHERE or_efficiency IS NOT NULL"
CTES["eff_intervals"] = "SELECT CAST(i AS INTEGER) AS interval_no, e[i] AS lower, e[i + 1] AS upper, i = len(e) - 1 AS is_last FROM (SELECT e, unnest(range(1, len(e))) AS i FROM eff_edges)"
CTES["eff_assigned"] = """
SELECT j.*, i.interval_no FROM joined j LEFT JOIN eff_intervals i ON j.or_efficiency >= i.lower AND (j.or_efficiency < i.upper OR (i.is_last AND j.or_efficiency <= i.upper))"""


def intervals(m):
    return S.quantile_edges(joined(m).withColumn("_all", F.lit(1)), ["_all"], "or_efficiency", 5)


def assigned(m):
    return S.assign_interval(joined(m).withColumn("_all", F.lit(1)), intervals(m), ["_all"], "or_efficiency").drop("_all")


@query("C15_quantile_intervals", "SELECT interval_no, round(lower, 9) AS lower, round(upper, 9) AS upper, is_last FROM eff_intervals")
def _(m):
    return intervals(m).select("interval_no", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "is_last")


@query("C15_assign_interval", "SELECT instrument_id, trading_date, breakout_type, direction, or_efficiency, interval_no FROM eff_assigned")
def _(m):
    return assigned(m).select("instrument_id", "trading_date", "breakout_type", "direction", "or_efficiency", "interval_no")


CTES["combined"] = f"""
SELECT *, CASE WHEN band IS NULL OR interval_no IS NULL THEN NULL WHEN band IN ('P00_20', 'P20_40') AND interval_no >= 4 THEN 'NARROW_EFFICIENT' WHEN band = 'P80_100' AND interval_no <= 2 THEN 'WIDE_INEFFICIENT' ELSE 'COMPARISON' END AS state
FROM (SELECT *, CASE WHEN hist_5_available THEN {BAND_SQL} END AS band FROM eff_assigned)"""


def combined(m):
    rows = ST.width_band(assigned(m))
    return rows.withColumn("state", ST.combined_state(F.col("band"), F.col("interval_no")))


@query("C16_combined_state", "SELECT instrument_id, trading_date, breakout_type, direction, state FROM combined")
def _(m):
    return combined(m).select("instrument_id", "trading_date", "breakout_type", "direction", "state")


CTES["known_levels"] = "SELECT *, CASE level_type " + " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(PRIORITY)) + " END AS prio FROM context_levels"
CTES["room"] = """
SELECT instrument_id, trading_date, breakout_type, direction, b.t AS next_level_type, b.p AS next_level_ticks, b.d AS room_ticks, CASE WHEN mid2 > 0 THEN round(b.d / (mid2 / 2.0::DOUBLE), 9) END AS room_pct,
       CASE WHEN w > 0 THEN round(b.d / w, 9) END AS room_widths, b IS NULL AS no_level_ahead, coalesce(len(list_filter(ds, lambda x: x = b.d)), 0) > 1 AS is_tie
FROM (SELECT instrument_id, trading_date, breakout_type, direction, any_value(or_mid2) AS mid2, any_value(or_high - or_low) AS w, min({'d': d, 'r': prio, 't': level_type, 'p': level_ticks}) FILTER (d > 0) AS b, list(d) FILTER (d > 0) AS ds
      FROM (SELECT s.*, l.prio, l.level_type, l.level_ticks, CASE WHEN l.available_at <= s.signal_time THEN CASE s.direction WHEN 'LONG' THEN l.level_ticks - s.or_high ELSE s.or_low - l.level_ticks END END AS d
            FROM signals s LEFT JOIN known_levels l ON l.instrument_id = s.instrument_id AND l.target_date = s.trading_date AND l.prio IS NOT NULL) GROUP BY 1, 2, 3, 4)"""


def room(m):
    return m.keep("room", lambda: ST.nearest_level_ahead(signals(m), context_levels(m), PRIORITY))


@query("C13_nearest_level_ahead", "SELECT * FROM room")
def _(m):
    return room(m)


SCOPES, TOTALS = ("half", "direction"), {"half": "FULL", "direction": "ALL"}
_STATS = ", ".join(f"round(avg({v}) FILTER (is_complete), 6) AS mean_{n}, round(quantile_cont({v}, 0.5) FILTER (is_complete), 6) AS median_{n}, round(quantile_cont({v}, 0.25) FILTER (is_complete), 6) AS p25_{n}, round(quantile_cont({v}, 0.75) FILTER (is_complete), 6) AS p75_{n}"
                   for v, n in (("mfe", "mfe"), ("mae", "mae")))


def summary_sql(source: str) -> str:
    return f"""
SELECT *, round(n / sum(n) OVER (PARTITION BY horizon, half, direction), 6) AS share
FROM (SELECT state, horizon, CASE WHEN grouping(half) = 1 THEN 'FULL' ELSE half END AS half, CASE WHEN grouping(direction) = 1 THEN 'ALL' ELSE direction END AS direction,
             count(*) AS n, CAST(count_if(is_complete) AS BIGINT) AS complete_n, {_STATS}
      FROM (SELECT x.state, h.half, e.direction, e.horizon, e.is_complete, e.mfe_ticks::DOUBLE AS mfe, e.mae_ticks::DOUBLE AS mae
            FROM ({source}) x JOIN excursions e USING (instrument_id, trading_date, breakout_type, direction) JOIN halves h USING (trading_date))
      GROUP BY GROUPING SETS ((state, horizon), (state, horizon, half), (state, horizon, direction), (state, horizon, half, direction)))"""


def summary(m, states):
    rows = excursions(m).select("instrument_id", "trading_date", "breakout_type", "direction", "horizon", "is_complete",
                                F.col("mfe_ticks").cast("double").alias("mfe"), F.col("mae_ticks").cast("double").alias("mae"))
    # halves split the dates of all breakouts, whatever states are kept
    joined_rows = states.select("instrument_id", "trading_date", "breakout_type", "direction", "state").join(
        ST.half_labels(rows), ["instrument_id", "trading_date", "breakout_type", "direction"])
    return S.state_summary(joined_rows, "state", SCOPES, TOTALS)


KEYCOLS = "instrument_id, trading_date, breakout_type, direction"
BAND_STATE = f"SELECT {KEYCOLS}, coalesce(CASE WHEN hist_5_available THEN {BAND_SQL} END, 'UNAVAILABLE') AS state FROM joined"
ROOM_STATE = f"SELECT {KEYCOLS}, CASE WHEN no_level_ahead THEN 'NO_LEVEL_AHEAD' WHEN room_widths < 0.5 THEN 'NEAR' WHEN room_widths < 1.5 THEN 'MIDDLE' ELSE 'FAR' END AS state FROM room"
CTES["band_summary"] = summary_sql(BAND_STATE)


def band_summary(m):
    return m.keep("band_summary", lambda: summary(m, ST.width_band(joined(m)).withColumn("state", F.col("band"))))


@query("E28_state_characterization_width", "SELECT * FROM band_summary")
def _(m):
    return band_summary(m)


@query("E28_state_characterization_structure", summary_sql(f"SELECT {KEYCOLS}, alignment AS state FROM dir_state"))
def _(m):
    return summary(m, ST.directional_state(joined(m)).withColumn("state", F.col("alignment")))


def room_state(m):
    state = F.when(F.col("no_level_ahead"), "NO_LEVEL_AHEAD").when(F.col("room_widths") < 0.5, "NEAR").when(F.col("room_widths") < 1.5, "MIDDLE").otherwise("FAR")
    return room(m).withColumn("state", state)


@query("E28_state_characterization_room", summary_sql(ROOM_STATE))
def _(m):
    return summary(m, room_state(m))


COMBINED_STATE = f"SELECT {KEYCOLS}, state FROM combined WHERE state IS NOT NULL"


@query("E28_state_characterization_combined", summary_sql(COMBINED_STATE))
def _(m):
    return summary(m, combined(m).filter("state is not null"))


_CAT = "CASE WHEN sweep THEN 'SWEEP' WHEN reject THEN 'REJECTION' WHEN close_through THEN 'CLOSE_THROUGH' WHEN touch THEN 'TOUCH_ONLY' ELSE 'NO_INTERACTION' END"
_CAT2 = "CASE WHEN sweep THEN 'SWEEP' WHEN close_through THEN 'CLOSE_THROUGH' WHEN reject THEN 'REJECT' WHEN trade_through THEN 'TRADE_THROUGH' WHEN touch THEN 'TOUCH' ELSE 'NONE' END"


@query("C09_interaction_category", f"SELECT instrument_id, trading_date, level_id, {_CAT} AS reject_first, {_CAT2} AS close_first FROM window_facts")
def _(m):
    cols = [F.coalesce(F.col(c), F.lit(False)) for c in ("touch", "trade_through", "close_through", "reject", "sweep")]
    return window_facts(m).select("instrument_id", "trading_date", "level_id", C.category_reject_first(*cols).alias("reject_first"), C.category_close_first(*cols).alias("close_first"))


@query("E28_state_characterization_key_level", summary_sql(f"SELECT s.instrument_id, s.trading_date, s.breakout_type, s.direction, w.level_type || ':' || {_CAT} AS state FROM signals s JOIN window_facts w USING (instrument_id, trading_date)"))
def _(m):
    cols = [F.coalesce(F.col(c), F.lit(False)) for c in ("touch", "trade_through", "close_through", "reject", "sweep")]
    state = F.concat_ws(":", "level_type", C.category_reject_first(*cols))
    days = window_facts(m).select("instrument_id", "trading_date", state.alias("state"))
    return summary(m, signals(m).join(days, ["instrument_id", "trading_date"]))


@query("E29_next_level_type_description", """
SELECT scope, next_level_type, horizon, count(*) AS n, round(quantile_cont(mfe_ticks, 0.5) FILTER (is_complete), 6) AS median_mfe
FROM (SELECT r.*, 'ALL' AS scope FROM room r UNION ALL SELECT r.*, 'WITHOUT_TIES' FROM room r WHERE NOT is_tie) x JOIN excursions e USING (instrument_id, trading_date, breakout_type, direction)
WHERE next_level_type IS NOT NULL GROUP BY 1, 2, 3""")
def _(m):
    keys = ["instrument_id", "trading_date", "breakout_type", "direction"]
    rows = room(m).filter("next_level_type is not null").join(excursions(m), keys)
    scopes = F.when(F.col("is_tie"), F.array(F.lit("ALL"))).otherwise(F.array(F.lit("ALL"), F.lit("WITHOUT_TIES")))
    rows = rows.withColumn("scope", F.explode(scopes)).withColumn("mfe", F.when(F.col("is_complete"), F.col("mfe_ticks")))
    part = ["scope", "next_level_type", "horizon"]
    medians = S.exact_percentiles(rows, part, "mfe", {"median_mfe": 0.5}).withColumn("median_mfe", r6("median_mfe"))
    return rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).join(medians, part, "left")


def patterns(m):
    rows = band_summary(m).filter("state <> 'UNAVAILABLE'")
    found = ST.relationship_patterns(rows, ["half", "direction", "horizon"], "state", 5)
    return found


CTES["pattern_rows"] = """
SELECT half, direction, horizon, CASE WHEN NOT ok THEN 'NO_CLEAR_PATTERN' WHEN f[5] < (sf[2] + sf[3]) / 2 AND e[5] > (se[2] + se[3]) / 2 THEN 'EXTREME_DETERIORATION' WHEN rho >= 0.7 THEN 'MONOTONIC_MORE' WHEN rho <= -0.7 THEN 'MONOTONIC_LESS'
       WHEN list_position(f, list_max(f)) BETWEEN 2 AND 4 AND list_max(f) > f[1] AND list_max(f) > f[5] THEN 'MIDDLE_RANGE_PREFERENCE' ELSE 'NO_CLEAR_PATTERN' END AS pattern, round(rho, 6) AS rho
FROM (SELECT *, CASE WHEN ok AND list_sum(list_transform(r, lambda x: (x - 3) * (x - 3))) > 0 THEN ((r[1] - 3) * -2 + (r[2] - 3) * -1 + (r[4] - 3) + (r[5] - 3) * 2) / sqrt(list_sum(list_transform(r, lambda x: (x - 3) * (x - 3))) * 10) END AS rho
      FROM (SELECT *, list_transform(f, lambda x: len(list_filter(f, lambda y: y < x)) + (len(list_filter(f, lambda y: y = x)) + 1) / 2.0::DOUBLE) AS r, list_sort(f[1:4]) AS sf, list_sort(e[1:4]) AS se
            FROM (SELECT half, direction, horizon, list(median_mfe ORDER BY state) AS f, list(median_mae ORDER BY state) AS e, count(*) = 5 AND count(median_mfe) = 5 AND count(median_mae) = 5 AS ok FROM band_summary WHERE state <> 'UNAVAILABLE' GROUP BY 1, 2, 3)))"""


@query("E30_relationship_patterns", "SELECT * FROM pattern_rows")
def _(m):
    return patterns(m)


@query("E30_dominant_pattern", """
SELECT half, direction, CASE WHEN coalesce(n, 0) >= 2 THEN pattern ELSE 'NO_CLEAR_PATTERN' END AS dominant_pattern, coalesce(n, 0) AS support
FROM (SELECT DISTINCT half, direction FROM pattern_rows) k LEFT JOIN (SELECT half, direction, pattern, count(*) AS n FROM pattern_rows WHERE pattern <> 'NO_CLEAR_PATTERN' GROUP BY 1, 2, 3
 QUALIFY row_number() OVER (PARTITION BY half, direction ORDER BY count(*) DESC, pattern) = 1) v USING (half, direction)""")
def _(m):
    return ST.dominant_pattern(patterns(m), ["half", "direction"])


STABILITY_HORIZON = 3


@query("E30_half_stability", f"""
WITH v AS (SELECT half, direction, pattern, count(*) AS n FROM pattern_rows WHERE pattern <> 'NO_CLEAR_PATTERN' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY half, direction ORDER BY count(*) DESC, pattern) = 1),
d AS (SELECT k.half, k.direction, CASE WHEN v.n >= 2 THEN v.pattern ELSE 'NO_CLEAR_PATTERN' END AS p, coalesce(v.n, 0) AS s FROM (SELECT DISTINCT half, direction FROM pattern_rows) k LEFT JOIN v USING (half, direction)),
w AS (SELECT direction, {", ".join(f"coalesce(max(p) FILTER (half = '{h}'), 'NO_CLEAR_PATTERN') AS {t}_pattern, coalesce(max(s) FILTER (half = '{h}'), 0) AS {t}_support" for h, t in (("FULL", "full"), ("FIRST", "first"), ("SECOND", "second")))} FROM d GROUP BY 1),
r AS (SELECT direction, max(rho) FILTER (half = 'FIRST') AS first_rho, max(rho) FILTER (half = 'SECOND') AS second_rho FROM pattern_rows WHERE horizon = {STABILITY_HORIZON} GROUP BY 1),
c AS (SELECT direction, min(n) AS min_half_n FROM band_summary WHERE state <> 'UNAVAILABLE' AND half <> 'FULL' AND horizon = {STABILITY_HORIZON} GROUP BY 1),
x AS (SELECT *, coalesce(abs(first_rho) >= 0.3 AND abs(second_rho) >= 0.3 AND sign(first_rho) <> sign(second_rho), FALSE) OR (first_support >= 3 AND second_support >= 3 AND first_pattern <> second_pattern) AS opposed
      FROM w LEFT JOIN r USING (direction) LEFT JOIN c USING (direction))
SELECT * EXCLUDE (opposed), CASE
  WHEN full_pattern = 'NO_CLEAR_PATTERN' AND greatest(full_support, first_support, second_support) < 2 THEN 'NO_CLEAR_RELATIONSHIP'
  WHEN full_pattern = 'NO_CLEAR_PATTERN' AND (opposed OR first_pattern <> second_pattern) THEN 'WEAK_OR_UNSTABLE'
  WHEN full_pattern = 'NO_CLEAR_PATTERN' THEN 'POTENTIALLY_INFORMATIVE'
  WHEN full_pattern = first_pattern AND full_pattern = second_pattern AND least(full_support, first_support, second_support) >= 3 AND min_half_n >= 10 THEN 'CONSISTENT_CANDIDATE_STATE'
  WHEN opposed THEN 'WEAK_OR_UNSTABLE'
  WHEN full_support >= 3 AND ((first_pattern = full_pattern AND first_support >= 2) OR (second_pattern = full_pattern AND second_support >= 2)) THEN 'POTENTIALLY_INFORMATIVE'
  ELSE 'WEAK_OR_UNSTABLE' END AS classification FROM x""")
def _(m):
    counts = band_summary(m).filter("state <> 'UNAVAILABLE'")
    return ST.half_stability(patterns(m), counts, ["direction"], STABILITY_HORIZON)


@query("E31_hypothesis_assessment", f"""
WITH s AS ({summary_sql(COMBINED_STATE)})
SELECT horizon, half, direction, c.median_mfe AS comparison_mfe, e.median_mfe AS efficient_mfe, round(e.median_mfe - c.median_mfe, 6) AS contrast,
       CASE WHEN e.n IS NULL OR e.n < 5 THEN 'INSUFFICIENT' WHEN e.median_mfe > c.median_mfe AND e.median_mae <= c.median_mae THEN 'PROMOTE' ELSE 'NOT_PROMOTED' END AS assessment
FROM (SELECT * FROM s WHERE state = 'COMPARISON') c LEFT JOIN (SELECT * FROM s WHERE state = 'NARROW_EFFICIENT') e USING (horizon, half, direction)""")
def _(m):
    keys = ["horizon", "half", "direction"]
    rows = summary(m, combined(m).filter("state is not null"))
    side = lambda s, p: rows.filter(F.col("state") == s).select(*keys, F.col("median_mfe").alias(f"{p}_mfe"), F.col("median_mae").alias(f"{p}_mae"), F.col("n").alias(f"{p}_n"))
    both = side("COMPARISON", "comparison").join(side("NARROW_EFFICIENT", "efficient"), keys, "left")
    better = (F.col("efficient_mfe") > F.col("comparison_mfe")) & (F.col("efficient_mae") <= F.col("comparison_mae"))
    label = F.when(F.col("efficient_n").isNull() | (F.col("efficient_n") < 5), "INSUFFICIENT").when(better, "PROMOTE").otherwise("NOT_PROMOTED")
    return both.select(*keys, "comparison_mfe", "efficient_mfe", r6(F.col("efficient_mfe") - F.col("comparison_mfe")).alias("contrast"), label.alias("assessment"))


CTES["level_events"] = """
SELECT instrument_id, CAST(bar_start AS DATE) + CASE WHEN hour(bar_start) >= 18 THEN 1 ELSE 0 END AS trading_date, level_id, level_type, min(bar_end) AS event_at, CASE level_type WHEN 'previous_day_high' THEN 'LONG' ELSE 'SHORT' END AS event_direction
FROM facts WHERE close_through AND level_type <> 'previous_day_close' GROUP BY ALL"""


def level_events(m):
    day = m.levels().select("level_id", "level_type", F.col("target_date").alias("trading_date"))
    rows = facts(m).filter("close_through").join(day, "level_id").filter("level_type <> 'previous_day_close'")
    return rows.groupBy("instrument_id", "trading_date", "level_id", "level_type").agg(F.min("bar_end").alias("event_at")).withColumn(
        "event_direction", F.when(F.col("level_type") == "previous_day_high", "LONG").otherwise("SHORT"))


@query("C40_level_direction_map", "SELECT *, CASE event_direction WHEN 'LONG' THEN 'SHORT' ELSE 'LONG' END AS rejection_direction FROM level_events")
def _(m):
    return level_events(m).withColumn("rejection_direction", C.opposite(F.col("event_direction")))


CTES["confirmed"] = """
SELECT e.*, f.a AS confirmed_at, CASE WHEN f.a IS NULL THEN 'NONE' WHEN f.d = e.event_direction THEN 'SAME' ELSE 'OPPOSITE' END AS confirmation
FROM level_events e LEFT JOIN (SELECT e.level_id, min(s.signal_time) AS a, arg_min(s.direction, (s.signal_time, s.direction)) AS d FROM level_events e JOIN signals s
 ON s.breakout_type = 'CLOSE' AND s.instrument_id = e.instrument_id AND s.trading_date = e.trading_date AND s.signal_time > e.event_at GROUP BY 1) f USING (level_id)"""


def confirmed(m):
    return ST.orb_confirmation(level_events(m), signals(m).filter("breakout_type = 'CLOSE'"))


@query("D29_orb_confirmation", "SELECT * FROM confirmed")
def _(m):
    return confirmed(m)


@query("E32_anchor_outcomes", """
SELECT level_type, confirmation, count(*) AS events, count(DISTINCT trading_date) AS days, round(avg(epoch(confirmed_at - event_at)), 6) AS mean_wait_seconds FROM confirmed GROUP BY 1, 2""")
def _(m):
    return confirmed(m).groupBy("level_type", "confirmation").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("trading_date").alias("days"),
        r6(F.avg(F.unix_timestamp("confirmed_at") - F.unix_timestamp("event_at"))).alias("mean_wait_seconds"))


FEATURES = ("or_width_ticks", "or_net_ticks", "or_efficiency", "or_close_location", "hist_5_percentile")


@query("E26_feature_distributions", " UNION ALL ".join(f"""
SELECT breakout_type, '{f}' AS feature, count({f}) AS n, CAST(count_if({f} IS NULL) AS BIGINT) AS missing, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std, CAST(min({f}) AS DOUBLE) AS minimum,
 round(quantile_cont({f}, 0.25), 6) AS p25, round(quantile_cont({f}, 0.5), 6) AS median, round(quantile_cont({f}, 0.75), 6) AS p75, CAST(max({f}) AS DOUBLE) AS maximum FROM joined GROUP BY 1""" for f in FEATURES))
def _(m):
    return S.feature_distributions(joined(m), ["breakout_type"], FEATURES)


@query("E27_feature_correlations", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM joined WHERE {a} IS NOT NULL AND {b} IS NOT NULL HAVING count(*) > 0"
                                                      for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]))
def _(m):
    return S.feature_correlations(joined(m), FEATURES)


@query("E40_hypothesis_classifications", """
WITH p AS (SELECT CAST(count_if(sign_persistence = 'POSITIVE_DEV_NEGATIVE_VAL') AS DOUBLE) / nullif(count_if(dev_average_r > 0), 0) AS flip, quantile_cont(average_r_delta, 0.5) AS md FROM surface),
     g AS (SELECT avg(CASE WHEN migration <> 'STABLE_REGION' THEN 1.0 ELSE 0.0 END::DOUBLE) AS shifted FROM migration)
SELECT 'BROAD_EDGE_DETERIORATION' AS hypothesis, CASE WHEN flip >= 0.6 AND md < 0 THEN 'SUPPORTS' WHEN flip >= 0.6 OR md < 0 THEN 'PARTIAL' ELSE 'DOES_NOT_SUPPORT' END AS classification FROM p
UNION ALL SELECT 'PARAMETER_INSTABILITY_MIGRATION', CASE WHEN shifted >= 0.6 THEN 'SUPPORTS' WHEN shifted >= 0.4 THEN 'PARTIAL' ELSE 'DOES_NOT_SUPPORT' END FROM g""")
def _(m):
    flips = F.count_if(F.col("sign_persistence") == "POSITIVE_DEV_NEGATIVE_VAL") / F.nullif(F.count_if(F.col("dev_average_r") > 0), F.lit(0))
    p = surface(m).agg(flips.alias("flip"), F.percentile("average_r_delta", F.lit(0.5)).alias("md"))
    high, falls = F.coalesce(F.col("flip") >= 0.6, F.lit(False)), F.col("md") < 0
    broad = p.select(F.lit("BROAD_EDGE_DETERIORATION").alias("hypothesis"), F.when(high & falls, "SUPPORTS").when(high | falls, "PARTIAL").otherwise("DOES_NOT_SUPPORT").alias("classification"))
    g = migration(m).agg(S.share(F.col("migration") != "STABLE_REGION").alias("shifted"))
    moved = g.select(F.lit("PARAMETER_INSTABILITY_MIGRATION").alias("hypothesis"), F.when(F.col("shifted") >= 0.6, "SUPPORTS").when(F.col("shifted") >= 0.4, "PARTIAL").otherwise("DOES_NOT_SUPPORT").alias("classification"))
    return broad.unionByName(moved)


#: Lower edges of all initial width bins but the first, the least rows of a merged bin, and how many bins are left at least.
WIDTH_MARKS, LEAST_ROWS, LEAST_BINS = tuple(10_000 * i for i in range(1, 8)), 200, 3


def sparse_bins_merged(bins):
    """One merging step on an array of ``(low, high, n)``: the emptiest bin joins its emptier neighbour, the lower one of equals."""
    sizes = F.transform(bins, lambda b: b["n"])
    least, count = F.array_min(sizes), F.size(bins)
    k = F.array_position(sizes, least).cast("int")
    lower = F.when(k == 1, 1).when((k == count) | (F.get(sizes, k - 2) <= F.get(sizes, k)), k - 1).otherwise(k)
    pair = F.struct(F.get(bins, lower - 1)["low"].alias("low"), F.get(bins, lower)["high"].alias("high"), (F.get(sizes, lower - 1) + F.get(sizes, lower)).alias("n"))
    merged = F.concat(F.slice(bins, F.lit(1), lower - 1), F.array(pair), F.slice(bins, lower + 2, F.greatest(count - lower - 1, F.lit(0))))
    return F.when((count <= LEAST_BINS) | (least >= LEAST_ROWS), bins).otherwise(merged)


_BIN = "CASE " + " ".join(f"WHEN or_width < {x} THEN {i}" for i, x in enumerate(WIDTH_MARKS)) + f" ELSE {len(WIDTH_MARKS)} END"
CTES["merged_bins"] = f"""
WITH RECURSIVE counts AS (SELECT i, count(e.b) AS n FROM range({len(WIDTH_MARKS) + 1}) r(i) LEFT JOIN (SELECT {_BIN} AS b FROM executed) e ON e.b = r.i GROUP BY 1),
 fold AS (SELECT 0 AS step, (SELECT list({{'low': i, 'high': i, 'n': n}} ORDER BY i) FROM counts) AS b
  UNION ALL
  SELECT step + 1, b[1:l - 1] || [{{'low': b[l].low, 'high': b[l + 1].high, 'n': b[l].n + b[l + 1].n}}] || b[l + 2:]
  FROM (SELECT *, CASE WHEN k = 1 THEN 1 WHEN k = len(b) OR b[k - 1].n <= b[k + 1].n THEN k - 1 ELSE k END AS l
        FROM (SELECT *, list_position(list_transform(b, lambda x: x.n), m) AS k FROM (SELECT *, list_min(list_transform(b, lambda x: x.n)) AS m FROM fold)))
  WHERE len(b) > {LEAST_BINS} AND m < {LEAST_ROWS})
SELECT unnest(b, recursive := true) FROM (SELECT b FROM fold ORDER BY step DESC LIMIT 1)"""


@query("E37_merge_sparse_bins", f"""
SELECT CAST(rank AS BIGINT) AS bin, count(*) AS n, min(or_width) AS lower, max(or_width) AS upper, round(avg(result_r), 6) AS average_r
FROM (SELECT *, {_BIN} AS b FROM executed) e JOIN (SELECT *, row_number() OVER (ORDER BY low) - 1 AS rank FROM merged_bins) m ON e.b BETWEEN m.low AND m.high GROUP BY 1""")
def _(m):
    first = F.aggregate(F.array(*[F.lit(x) for x in WIDTH_MARKS]), F.lit(0), lambda s, x: s + (F.col("or_width") >= x).cast("int"))
    rows = executed(m).withColumn("_b", first)
    # One row with a number per initial bin; the fold is part of the plan.
    counts = rows.agg(*[F.count_if(F.col("_b") == i).alias(f"n{i}") for i in range(len(WIDTH_MARKS) + 1)])
    bins = F.array(*[F.struct(F.lit(i).alias("low"), F.lit(i).alias("high"), F.col(f"n{i}").alias("n")) for i in range(len(WIDTH_MARKS) + 1)])
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(len(WIDTH_MARKS))), bins, lambda b, _: sparse_bins_merged(b))
    merged = counts.select(F.posexplode(folded).alias("bin", "_m")).select(F.col("bin").cast("bigint"), F.explode(F.sequence("_m.low", "_m.high")).alias("_b"))
    return rows.join(F.broadcast(merged), "_b").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("or_width").alias("lower"), F.max("or_width").alias("upper"), r6(F.avg("result_r")).alias("average_r"))
