"""Parameter sweeps, width bins, two-period comparison and market states of breakouts."""
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6

from sessionloom.catalog.context import context_levels, history, or_context
from sessionloom.catalog.ledger import CORE
from sessionloom.catalog.registry import query
from sessionloom.catalog.sql import CTES
from sessionloom.catalog.trades import (audit_sql, excursions, exits_sql, grid_candidates, grid_exits, or_levels, point_audit,
                                        point_candidates, point_exits, signals, window_facts)
from sessionloom.functions import scalars as C
from sessionloom.operators import states as ST
from sessionloom.operators import stats as S
from sessionloom.operators import trades as T
from sessionloom.sources.calendar import TEST_PARTITIONS

CELL = ["breakout_type", "config_id"]
PERIOD_SQL = """CASE WHEN trading_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14' THEN 'DEVELOPMENT' WHEN trading_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-22' THEN 'VALIDATION'
 WHEN trading_date BETWEEN DATE '2024-01-23' AND DATE '2024-01-31' THEN 'RESERVED' ELSE 'UNASSIGNED' END"""
#: Two-period queries read these; reserved days are for a later test and must not be looked at.
OPEN_PERIODS = ("DEVELOPMENT", "VALIDATION")
OPEN_SQL = "period IN ('DEVELOPMENT', 'VALIDATION')"


def period():
    """The research partition of a trading date, from the literal partition table."""
    day, out = F.col("trading_date"), F.lit("UNASSIGNED")
    for name, first, last in reversed(TEST_PARTITIONS):
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return out


def open_trades(m):
    return executed(m).filter(F.col("period").isin(*OPEN_PERIODS))


CTES["executed"] = f"""
SELECT a.instrument_id, a.trading_date, a.breakout_type, a.direction, a.config_id, a.entry_time, a.exit_reason, a.result_r, c.stop_points, c.target_points,
       c.or_high - c.or_low AS or_width, {PERIOD_SQL} AS period
FROM audit_points a JOIN cand_points c USING (instrument_id, trading_date, breakout_type, direction, config_id) WHERE a.status = 'EXECUTED'"""


def executed(m):
    def build():
        extra = point_candidates(m).select(*T.CANDIDATE, "stop_points", "target_points", (F.col("or_high") - F.col("or_low")).alias("or_width"))
        done = point_audit(m).filter("status = 'EXECUTED'").select(*T.CANDIDATE, "entry_time", "exit_reason", "result_r")
        return done.join(extra, T.CANDIDATE).withColumn("period", period())
    return m.keep("executed", build)


ORDER = ["entry_time", "instrument_id", "direction"]


@query("D03_enrich_trades", "SELECT * FROM executed")
def _(m):
    return executed(m)


def sweep_sql(done: str, audit: str) -> str:
    return f"""
SELECT t.*, a.candidates, a.invalid, a.ambiguous, a.limited, d.max_drawdown_r, coalesce(s.k, 0) AS max_losing_streak, r.rolling_20_min, mm.positive_months, mm.months
FROM (SELECT breakout_type, config_id, {CORE} FROM {done} GROUP BY 1, 2) t
JOIN (SELECT breakout_type, config_id, count(*) AS candidates, CAST(count_if(NOT is_valid) AS BIGINT) AS invalid, CAST(count_if(is_ambiguous) AS BIGINT) AS ambiguous,
             CAST(count_if(rejection_reason = 'SESSION_TRADE_LIMIT') AS BIGINT) AS limited FROM {audit} GROUP BY 1, 2) a USING (breakout_type, config_id)
JOIN (SELECT breakout_type, config_id, round(max(p - e), 6) AS max_drawdown_r FROM (SELECT *, greatest(0, max(e) OVER (PARTITION BY breakout_type, config_id ORDER BY entry_time, instrument_id, direction)) AS p
      FROM (SELECT *, sum(result_r) OVER (PARTITION BY breakout_type, config_id ORDER BY entry_time, instrument_id, direction) AS e FROM {done})) GROUP BY 1, 2) d USING (breakout_type, config_id)
LEFT JOIN (SELECT breakout_type, config_id, max(n) AS k FROM (SELECT breakout_type, config_id, g, count(*) AS n FROM (SELECT *, sum(CASE WHEN result_r >= 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY breakout_type, config_id ORDER BY entry_time, instrument_id, direction) AS g FROM {done}) WHERE result_r < 0 GROUP BY 1, 2, 3) GROUP BY 1, 2) s USING (breakout_type, config_id)
LEFT JOIN (SELECT breakout_type, config_id, min(r) AS rolling_20_min FROM (SELECT breakout_type, config_id, CASE WHEN count(*) OVER w = 20 THEN round(avg(result_r) OVER w, 6) END AS r
      FROM {done} WINDOW w AS (PARTITION BY breakout_type, config_id ORDER BY entry_time, instrument_id, direction ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2) r USING (breakout_type, config_id)
JOIN (SELECT breakout_type, config_id, CAST(count_if(x > 0) AS BIGINT) AS positive_months, count(*) AS months FROM (SELECT breakout_type, config_id, strftime(trading_date, '%Y-%m'), sum(result_r) AS x FROM {done} GROUP BY 1, 2, 3) GROUP BY 1, 2) mm USING (breakout_type, config_id)"""


@query("E14_sweep_metrics", sweep_sql("executed", "audit_points"))
def _(m):
    return S.sweep_metrics(point_audit(m), executed(m), CELL, [["trading_date"]], ORDER)


# --- sweeps over opening-range lengths, on development days -----------------
CTES["or_lengths"] = """
SELECT *, or_high + or_low AS or_mid2, or_bars = duration AND or_high > or_low AS valid
FROM (SELECT instrument_id, trading_date, k.duration, count(*) AS or_bars, max(high) AS or_high, min(low) AS or_low,
             arg_min(open, bar_start) AS or_open, arg_max(close, bar_start) AS or_close, max(bar_end) AS or_end
      FROM bars CROSS JOIN prm CROSS JOIN (VALUES (1), (2), (3), (4)) k(duration)
      WHERE bar_start >= trading_date + to_seconds(range_clock) AND bar_start < trading_date + to_seconds(range_clock + k.duration * iv)
      GROUP BY 1, 2, 3)"""
CTES["length_bars"] = """
SELECT b.*, l.duration, l.or_high, l.or_low, l.or_mid2, b.high > l.or_high AS up, b.low < l.or_low AS down
FROM bars b JOIN or_lengths l ON b.instrument_id = l.instrument_id AND b.trading_date = l.trading_date AND l.valid CROSS JOIN prm
WHERE bar_start >= b.trading_date + to_seconds(range_clock + l.duration * iv) AND bar_start <= b.trading_date + to_seconds(cutoff_clock)"""
CTES["length_signals"] = """
SELECT instrument_id, trading_date, duration, contract, breakout_type, direction, slot AS signal_slot, bar_end AS signal_time, or_high, or_low, or_mid2
FROM (SELECT *, 'PRINT' AS breakout_type, 'LONG' AS direction FROM length_bars WHERE up AND NOT down
      UNION ALL SELECT *, 'PRINT', 'SHORT' FROM length_bars WHERE down AND NOT up
      UNION ALL SELECT *, 'CLOSE', 'LONG' FROM length_bars WHERE close > or_high
      UNION ALL SELECT *, 'CLOSE', 'SHORT' FROM length_bars WHERE close < or_low)
QUALIFY row_number() OVER (PARTITION BY instrument_id, trading_date, duration, breakout_type, direction ORDER BY slot) = 1"""
CTES["length_entered"] = f"""
SELECT s.*, e.bar_end AS entry_time, e.slot AS entry_slot,
       CASE WHEN e.slot IS NULL THEN NULL WHEN s.direction = 'LONG' THEN s.or_high ELSE s.or_low END AS entry_ticks, CASE s.direction WHEN 'LONG' THEN 1 ELSE -1 END AS sgn
FROM (SELECT * FROM length_signals WHERE breakout_type = 'PRINT' AND {PERIOD_SQL} = 'DEVELOPMENT') s
LEFT JOIN bars e ON e.instrument_id = s.instrument_id AND e.trading_date = s.trading_date AND e.slot = s.signal_slot"""
_STOP_AT_SHARE = """CAST(round(CAST(CASE direction WHEN 'LONG' THEN or_high ELSE or_low END AS DECIMAL(20,0)) - sgn * CAST(or_high - or_low AS DECIMAL(16,0)) * CAST(%s AS DECIMAL(5,0)) * 0.01, 0) AS BIGINT)"""
CTES["length_multiples"] = f"""
SELECT * EXCLUDE (sgn), printf('D%02d_F%03d_R%03d', duration, stop_pct, CAST(target_r * 100 AS INTEGER)) AS config_id, entry_ticks + sgn * CAST(round(CAST(target_r AS DECIMAL(6,2)) * CAST(risk_ticks AS DECIMAL(16,0)), 0) AS BIGINT) AS target_ticks,
       CASE WHEN entry_time IS NULL THEN 'MISSING_IMMEDIATE_NEXT_BAR' WHEN risk_ticks IS NULL THEN 'INVALID_ENTRY_RELATIVE_TO_STOP' ELSE '' END AS invalid_reason, entry_time IS NOT NULL AND risk_ticks IS NOT NULL AS is_valid
FROM (SELECT *, CASE WHEN sgn * (entry_ticks - stop_ticks) > 0 THEN sgn * (entry_ticks - stop_ticks) END AS risk_ticks
      FROM (SELECT *, {_STOP_AT_SHARE % "stop_pct"} AS stop_ticks FROM length_entered CROSS JOIN (VALUES (25), (50)) a(stop_pct) CROSS JOIN (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) b(target_r)))"""
CTES["length_points"] = f"""
SELECT * EXCLUDE (sgn), printf('D%02d_%s%03d_T%03d', duration, left(stop_kind, 1), stop_value, target_points) AS config_id, entry_ticks + sgn * target_points * 100 AS target_ticks,
       risk_ticks / (or_high - or_low) AS risk_to_width, target_points * 100 / (or_high - or_low) AS target_to_width,
       CASE WHEN entry_time IS NULL THEN 'MISSING_IMMEDIATE_NEXT_BAR' WHEN risk_ticks IS NULL THEN 'INVALID_ENTRY_RELATIVE_TO_STOP' ELSE '' END AS invalid_reason, entry_time IS NOT NULL AND risk_ticks IS NOT NULL AS is_valid
FROM (SELECT *, CASE WHEN sgn * (entry_ticks - stop_ticks) > 0 THEN sgn * (entry_ticks - stop_ticks) END AS risk_ticks
      FROM (SELECT *, CASE stop_kind WHEN 'OR_FRACTION' THEN {_STOP_AT_SHARE % "stop_value"} ELSE entry_ticks - sgn * stop_value * 100 END AS stop_ticks
            FROM (SELECT * FROM length_entered WHERE duration <= 3)
            CROSS JOIN (VALUES ('OR_FRACTION', 50), ('OR_FRACTION', 25), ('FIXED_POINTS', 40), ('FIXED_POINTS', 60), ('FIXED_POINTS', 80)) a(stop_kind, stop_value)
            CROSS JOIN (VALUES (40), (50), (75), (100), (150)) b(target_points)))"""
for _name, _axes in (("multiples", "c.duration, c.stop_pct, CAST(c.target_r AS DOUBLE) AS target_r"), ("points", "c.duration, c.stop_kind, c.stop_value, c.target_points, c.risk_to_width, c.target_to_width")):
    CTES[f"length_{_name}_exits"] = exits_sql(f"length_{_name}")
    CTES[f"length_{_name}_audit"] = audit_sql(f"length_{_name}", f"length_{_name}_exits")
    CTES[f"length_{_name}_done"] = f"""SELECT a.*, {_axes} FROM length_{_name}_audit a
 JOIN length_{_name} c USING (instrument_id, trading_date, breakout_type, direction, config_id) WHERE a.status = 'EXECUTED'"""


def length_signals(m):
    s = m.settings
    shape = dict(interval=s.interval, range_clock=s.range_clock)
    levels = T.opening_levels_by_length(m.bars(), lengths=T.MULTIPLE_LENGTHS, **shape)
    return m.keep("length_signals", lambda: T.breakout_signals_by_length(m.bars(), levels, cutoff=s.cutoff_clock, **shape))


def length_sweep(m, name):
    """Audit and executed trades of one sweep over range lengths: breaks by trade, development days only."""
    signals = length_signals(m).filter((F.col("breakout_type") == "PRINT") & (period() == "DEVELOPMENT"))
    if name == "multiples":
        axes, made = ["duration", "stop_pct", F.col("target_r").cast("double").alias("target_r")], T.candidate_entries(signals, m.bars(), T.fraction_grid(T.MULTIPLE_FRACTIONS))
    else:
        axes, made = ["duration", "stop_kind", "stop_value", "target_points", "risk_to_width", "target_to_width"], T.stop_and_target_candidates(signals.filter(F.col("duration").isin(*T.POINT_LENGTHS)), m.bars())
    candidates = m.keep(f"length_{name}", lambda: T.with_length(made))
    audit = m.keep(f"length_{name}_audit", lambda: T.session_trade_limit(candidates, T.exit_barrier(candidates, m.bars())))
    return audit, audit.filter("status = 'EXECUTED'").join(candidates.select(*T.CANDIDATE, *axes), T.CANDIDATE)


@query("F10_breakouts_by_length", "SELECT * FROM length_signals")
def _(m):
    return length_signals(m)


@query("E02_opening_range_by_length", "SELECT * FROM or_lengths")
def _(m):
    return T.opening_levels_by_length(m.bars(), m.settings.interval, m.settings.range_clock, T.MULTIPLE_LENGTHS)


_NEAR = """
SELECT a.config_id, count(b.average_r) AS neighbour_count, round(avg(b.average_r) + 1e-10, 4) AS neighbour_mean,
       round(avg(CASE WHEN b.average_r > 0 THEN 1.0 WHEN b.average_r IS NOT NULL THEN 0.0 END::DOUBLE), 6) AS neighbour_positive_share, round(a.average_r - round(avg(b.average_r) + 1e-10, 4), 4) AS minus_neighbour_mean
FROM near a LEFT JOIN near b ON a.stop = b.stop AND abs(a.d - b.d) + abs(a.t - b.t) = 1 GROUP BY a.config_id, a.average_r"""


def length_sweep_sql(name: str, axes: str, stop: str, target: str, more: str = "") -> str:
    done = f"length_{name}_done"
    return f"""
WITH near AS (SELECT config_id, {stop} AS stop, round(avg(result_r) + 1e-10, 5) AS average_r, dense_rank() OVER (PARTITION BY {stop} ORDER BY duration) AS d, dense_rank() OVER (PARTITION BY {stop} ORDER BY {target}) AS t
              FROM {done} GROUP BY config_id, {stop}, duration, {target})
SELECT m.*, x.* EXCLUDE (config_id), n.* EXCLUDE (config_id) FROM ({sweep_sql(done, f"length_{name}_audit")}) m
JOIN (SELECT config_id, {axes}{more} FROM {done} GROUP BY ALL) x USING (config_id) JOIN ({_NEAR}) n USING (config_id)"""


def length_metrics(m, name, stop, target, extra=()):
    """Metrics of each cell with its neighbours in length and target on the same stop."""
    audit, done = length_sweep(m, name)
    axes = ["duration", *stop, target]
    cells = done.groupBy("config_id", *axes).agg(F.round(F.avg("result_r") + 1e-10, 5).alias("average_r"), *extra)
    near = S.grid_neighbours(cells.select(*axes, "average_r"), stop, ["duration", target], "average_r").drop("average_r")
    return S.sweep_metrics(audit, done, CELL, [["trading_date"]], ORDER).join(cells.drop("average_r").join(near, axes), "config_id")


@query("O02_length_sweep", length_sweep_sql("multiples", "duration, stop_pct, target_r", "stop_pct", "target_r"))
def _(m):
    return length_metrics(m, "multiples", ["stop_pct"], "target_r")


@query("O03_length_sweep", length_sweep_sql("points", "duration, stop_kind, stop_value, target_points", "(stop_kind, stop_value)", "target_points",
                                            ", round(avg(risk_to_width), 6) AS risk_to_width, round(avg(target_to_width), 6) AS target_to_width"))
def _(m):
    return length_metrics(m, "points", ["stop_kind", "stop_value"], "target_points", [r6(F.avg("risk_to_width")).alias("risk_to_width"), r6(F.avg("target_to_width")).alias("target_to_width")])


@query("C23_length_grid", " UNION ALL ".join(f"SELECT '{n}' AS sweep, config_id, duration, count(*) AS candidates, CAST(count_if(is_valid) AS BIGINT) AS valid FROM length_{n} GROUP BY 1, 2, 3" for n in ("multiples", "points")))
def _(m):
    parts = []
    for name in ("multiples", "points"):
        audit, _ = length_sweep(m, name)
        parts.append(audit.groupBy(F.lit(name).alias("sweep"), "config_id", F.substring("config_id", 2, 2).cast("int").alias("duration")).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_valid").alias("valid")))
    return parts[0].unionByName(parts[1])


# --- chronology scenarios -------------------------------------------------
_PESSIMISTIC = """SELECT * REPLACE (CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN -1.0::DOUBLE ELSE result_r END AS result_r, is_ambiguous AND exit_reason <> 'AMBIGUOUS_ENTRY_STOP' AS is_ambiguous,
 CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN 'STOP' ELSE exit_reason END AS exit_reason) FROM exits_grid"""
CTES["scenario_audit"] = " UNION ALL ".join(f"SELECT *, '{n}' AS scenario FROM ({audit_sql('cand_grid', src)})" for n, src in (
    ("EXCLUDED", "exits_grid"), ("PESSIMISTIC", f"({_PESSIMISTIC})"), ("AFTER_ENTRY", "exits_again")))
CTES["scenario_metrics"] = f"SELECT breakout_type, config_id, scenario, {CORE} FROM scenario_audit WHERE status = 'EXECUTED' GROUP BY 1, 2, 3"
SCENARIOS = ("EXCLUDED", "PESSIMISTIC", "AFTER_ENTRY")


def scenario_metrics(m):
    def build():
        keep = [*T.CANDIDATE, "exit_reason", "is_ambiguous", "result_r"]
        tables = (grid_exits(m), T.resolve_pessimistic(grid_exits(m)), T.resolve_after_entry_bar(grid_exits(m), grid_candidates(m), m.bars()))
        trades = None
        for name, table in zip(SCENARIOS, tables):
            part = table.select(*keep, F.lit(name).alias("scenario"))
            trades = part if trades is None else trades.unionByName(part)
        wanted = grid_candidates(m).withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])))
        audit = T.session_trade_limit(wanted, trades, ["scenario"])
        return audit.filter("status = 'EXECUTED'").groupBy(*CELL, "scenario").agg(*S.core_metrics())
    return m.keep("scenario_metrics", build)


@query("E15_scenario_metrics", "SELECT * FROM scenario_metrics")
def _(m):
    return scenario_metrics(m)


CTES["scenario_bounds"] = """
SELECT breakout_type, config_id, max(average_r) FILTER (scenario = 'EXCLUDED') AS excluded, max(average_r) FILTER (scenario = 'PESSIMISTIC') AS pessimistic,
       max(average_r) FILTER (scenario = 'AFTER_ENTRY') AS after_entry, round(max(average_r) - min(average_r), 6) AS average_range, count(*) = 3 AND min(average_r) > 0 AS all_positive FROM scenario_metrics GROUP BY 1, 2"""


def scenario_bounds(m):
    wide = scenario_metrics(m).groupBy(*CELL).pivot("scenario", list(SCENARIOS)).agg(F.max("average_r")).withColumnsRenamed(
        {s: s.lower() for s in SCENARIOS})
    names = [s.lower() for s in SCENARIOS]
    values = [F.col(n) for n in names]
    known = F.array_compact(F.array(*values))
    return wide.withColumns({"average_range": r6(F.array_max(known) - F.array_min(known)),
                             "all_positive": (F.size(known) == 3) & (F.array_min(known) > 0)})


@query("E16_scenario_bounds", "SELECT * FROM scenario_bounds")
def _(m):
    return scenario_bounds(m)


@query("O04_ambiguity_sensitivity", "SELECT b.*, m.trades FROM scenario_bounds b JOIN scenario_metrics m USING (breakout_type, config_id) WHERE m.scenario = 'PESSIMISTIC'")
def _(m):
    trades = scenario_metrics(m).filter("scenario = 'PESSIMISTIC'").select(*CELL, "trades")
    return scenario_bounds(m).join(trades, CELL)


# --- width bins -----------------------------------------------------------
CTES["width_obs"] = """
SELECT duration, instrument_id, trading_date, or_width FROM (
 SELECT k.duration, b.instrument_id, b.trading_date, max(b.high) - min(b.low) AS or_width, count(*) AS n FROM bars b CROSS JOIN prm CROSS JOIN (VALUES (1), (2), (3)) k(duration)
 WHERE b.bar_start >= b.trading_date + to_seconds(range_clock) AND b.bar_start < b.trading_date + to_seconds(range_clock + k.duration * iv) GROUP BY 1, 2, 3)
WHERE n = duration AND or_width > 0"""
CTES["width_bins"] = """
SELECT * EXCLUDE (i, n), CASE WHEN n = 1 THEN 1 ELSE greatest(1, (5 * i + n - 2) // (n - 1)) END AS bin
FROM (SELECT *, row_number() OVER (PARTITION BY duration ORDER BY or_width, trading_date, instrument_id) - 1 AS i, count(*) OVER (PARTITION BY duration) AS n FROM width_obs)"""


#: Opening-range lengths in bars whose widths are binned.
DURATIONS = (1, 2, 3)


def width_obs(m):
    s, out = m.settings, None
    for k in DURATIONS:
        part = T.opening_levels(m.bars(), s.interval, s.range_clock, k).filter("valid").select(
            F.lit(k).alias("duration"), "instrument_id", "trading_date", (F.col("or_high") - F.col("or_low")).alias("or_width"))
        out = part if out is None else out.unionByName(part)
    return out


def width_bins(m):
    rows = width_obs(m).withColumn("_range", F.floor(F.col("or_width") / 1000))
    return m.keep("width_bins", lambda: S.ordinal_bins(rows, ["duration"], ["or_width", "trading_date", "instrument_id"], [["_range"]], 5).drop("_range"))


@query("E17_width_distribution", """
SELECT duration, count(*) AS n, round(avg(or_width), 6) AS mean_width, round(stddev_samp(or_width), 6) AS std_width, round(quantile_cont(or_width, 0.5), 6) AS median_width,
       round(quantile_cont(or_width, 0.9), 6) AS p90_width FROM width_obs GROUP BY 1""")
def _(m):
    rows = width_obs(m).dropDuplicates(["duration", "instrument_id", "trading_date"])
    base = rows.groupBy("duration").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("or_width")).alias("mean_width"), r6(F.stddev_samp("or_width")).alias("std_width"))
    points = S.exact_percentiles(rows, ["duration"], "or_width", {"median_width": 0.5, "p90_width": 0.9})
    return base.join(points.select("duration", r6("median_width").alias("median_width"), r6("p90_width").alias("p90_width")), "duration")


CTES["binned"] = """SELECT e.*, k.duration, b.bin FROM executed e CROSS JOIN (VALUES (1), (2), (3)) k(duration)
LEFT JOIN width_bins b ON b.duration = k.duration AND b.instrument_id = e.instrument_id AND b.trading_date = e.trading_date"""


@query("D02_add_width_bin", "SELECT * FROM binned")
def _(m):
    return with_bin(m)


def with_bin(m):
    """Every trade with the bin of its session's width at each opening-range length."""
    rows = executed(m).withColumn("duration", F.explode(F.array(*[F.lit(k) for k in DURATIONS])))
    return rows.join(width_bins(m).select("duration", "instrument_id", "trading_date", "bin"), ["duration", "instrument_id", "trading_date"], "left")


@query("E18_bin_boundaries", "SELECT duration, bin, count(*) AS n, min(or_width) AS lower, max(or_width) AS upper, round(quantile_cont(or_width, 0.5), 6) AS median FROM width_bins GROUP BY 1, 2")
def _(m):
    medians = S.exact_percentiles(width_bins(m), ["duration", "bin"], "or_width", {"median": 0.5}).withColumn("median", r6("median"))
    base = width_bins(m).groupBy("duration", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("or_width").alias("lower"), F.max("or_width").alias("upper"))
    return base.join(medians, ["duration", "bin"])


CTES["conditional"] = f"""
SELECT g.breakout_type, g.config_id, g.duration, CAST(g.bin AS BIGINT) AS bin, coalesce(x.trades, 0) AS trades, x.average_r, x.total_r, coalesce(x.trades, 0) < 10 AS low_sample
FROM (SELECT * FROM (SELECT DISTINCT breakout_type, config_id FROM executed) CROSS JOIN (VALUES (1), (2), (3)) k(duration) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(bin)) g
LEFT JOIN (SELECT breakout_type, config_id, duration, bin, {CORE} FROM binned GROUP BY 1, 2, 3, 4) x ON x.breakout_type = g.breakout_type AND x.config_id = g.config_id AND x.duration = g.duration AND x.bin = g.bin"""


def conditional(m):
    cells = executed(m).select(*CELL).distinct().withColumn("duration", F.explode(F.array(*[F.lit(k) for k in DURATIONS])))
    cells = cells.withColumn("bin", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(1, 6)])))
    seen = with_bin(m).groupBy(*CELL, "duration", "bin").agg(*S.core_metrics())
    out = cells.join(seen, [*CELL, "duration", "bin"], "left")
    trades = F.coalesce("trades", F.lit(0))
    return out.select(*CELL, "duration", "bin", trades.alias("trades"), "average_r", "total_r", (trades < 10).alias("low_sample"))


@query("E19_conditional_performance", "SELECT * FROM conditional")
def _(m):
    return conditional(m)


@query("E20_width_correlations", """
SELECT breakout_type, config_id, count(*) AS n, round(CASE WHEN stddev_pop(or_width) > 0 AND stddev_pop(result_r) > 0 THEN corr(or_width, result_r) END, 6) AS pearson, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS spearman
FROM (SELECT *, rank() OVER (PARTITION BY breakout_type, config_id ORDER BY or_width) + (count(*) OVER (PARTITION BY breakout_type, config_id, or_width) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY breakout_type, config_id ORDER BY result_r) + (count(*) OVER (PARTITION BY breakout_type, config_id, result_r) - 1) / 2.0::DOUBLE AS ry FROM executed) GROUP BY 1, 2""")
def _(m):
    return S.correlations(executed(m), CELL, "or_width", "result_r")


@query("E21_ambiguity_by_bin", """
SELECT t.config_id, b.duration, b.bin, count(*) AS candidates, CAST(count_if(t.exit_reason = 'AMBIGUOUS_ENTRY_STOP') AS BIGINT) AS entry_stop, CAST(count_if(t.exit_reason = 'AMBIGUOUS_STOP_TARGET') AS BIGINT) AS stop_target,
       round(avg(CASE WHEN t.is_ambiguous THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS ambiguity_rate
FROM exits_points t JOIN width_bins b ON b.instrument_id = t.instrument_id AND b.trading_date = t.trading_date GROUP BY 1, 2, 3""")
def _(m):
    rows = point_exits(m).join(width_bins(m).select("duration", "instrument_id", "trading_date", "bin"), ["instrument_id", "trading_date"])
    return rows.groupBy("config_id", "duration", "bin").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("exit_reason") == "AMBIGUOUS_ENTRY_STOP").alias("entry_stop"),
        F.count_if(F.col("exit_reason") == "AMBIGUOUS_STOP_TARGET").alias("stop_target"), r6(S.share(F.col("is_ambiguous"))).alias("ambiguity_rate"))


@query("E22_expectancy_bins", """
SELECT c.*, b.median_width FROM conditional c LEFT JOIN (SELECT duration, bin, round(quantile_cont(or_width, 0.5), 6) AS median_width FROM width_bins GROUP BY 1, 2) b USING (duration, bin)""")
def _(m):
    medians = S.exact_percentiles(width_bins(m), ["duration", "bin"], "or_width", {"median_width": 0.5}).withColumn("median_width", r6("median_width"))
    return conditional(m).join(F.broadcast(medians), ["duration", "bin"], "left")  # five bins of three lengths


CTES["ratio_sessions"] = """
SELECT breakout_type, config_id, instrument_id, trading_date, quantile_cont(stop_points * 100 / or_width, 0.5) AS stop_ratio, any_value(result_r) AS result_r FROM executed GROUP BY 1, 2, 3, 4"""
CTES["ratio_bins"] = """
SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, (5 * i + n - 2) // (n - 1)) END AS bin
FROM (SELECT *, row_number() OVER (PARTITION BY breakout_type, config_id ORDER BY stop_ratio, trading_date, instrument_id) - 1 AS i, count(*) OVER (PARTITION BY breakout_type, config_id) AS n FROM ratio_sessions)"""


@query("E23_ratio_analysis", """
SELECT breakout_type, config_id, bin, count(*) AS n, round(min(stop_ratio), 6) AS lower, round(max(stop_ratio), 6) AS upper, round(avg(result_r), 6) AS average_r FROM ratio_bins GROUP BY 1, 2, 3""")
def _(m):
    keys = [*CELL, "instrument_id", "trading_date"]
    rows = executed(m).withColumn("_q", F.col("stop_points") * 100 / F.col("or_width"))
    sessions = rows.groupBy(*keys).agg(F.percentile("_q", F.lit(0.5)).alias("stop_ratio"), F.min("result_r").alias("result_r"))
    sessions = sessions.withColumn("_range", F.floor(F.col("stop_ratio") * 10))
    bins = S.ordinal_bins(sessions, CELL, ["stop_ratio", "trading_date", "instrument_id"], [["_range"]], 5)
    return bins.groupBy(*CELL, "bin").agg(F.count(F.lit(1)).alias("n"), r6(F.min("stop_ratio")).alias("lower"), r6(F.max("stop_ratio")).alias("upper"),
                                          r6(F.avg("result_r")).alias("average_r"))


CTES["scenario_bins"] = """
SELECT s.breakout_type, s.config_id, b.duration, b.bin, s.scenario, round(avg(s.result_r), 6) AS average_r FROM scenario_audit s
JOIN width_bins b ON b.instrument_id = s.instrument_id AND b.trading_date = s.trading_date WHERE s.status = 'EXECUTED' GROUP BY 1, 2, 3, 4, 5"""


def scenario_audit(m):
    return m.keep("scenario_audit", lambda: scenarios_of(m, grid_candidates(m), grid_exits(m)))


def scenarios_of(m, candidates, exits):
    """The audit of all candidates in each scenario of unknown order."""
    keep = [*T.CANDIDATE, "exit_reason", "is_ambiguous", "result_r"]
    tables = (exits, T.resolve_pessimistic(exits), T.resolve_after_entry_bar(exits, candidates, m.bars()))
    parts = [t.select(*keep, F.lit(n).alias("scenario")) for n, t in zip(SCENARIOS, tables)]
    wanted = candidates.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])))
    return T.session_trade_limit(wanted, parts[0].unionByName(parts[1]).unionByName(parts[2]), ["scenario"])


def width_sensitivity(m):
    bins = width_bins(m).select("duration", "instrument_id", "trading_date", "bin")
    rows = scenario_audit(m).filter("status = 'EXECUTED'").join(bins, ["instrument_id", "trading_date"])
    wide = rows.groupBy(*CELL, "duration", "bin").pivot("scenario", list(SCENARIOS)).agg(r6(F.avg("result_r"))).withColumnsRenamed({s: s.lower() for s in SCENARIOS})
    known = F.array_compact(F.array(*[F.col(s.lower()) for s in SCENARIOS]))
    return wide.withColumn("scenario_range", r6(F.array_max(known) - F.array_min(known)))


SENSITIVITY_SQL = """
SELECT breakout_type, config_id, duration, bin, max(average_r) FILTER (scenario = 'EXCLUDED') AS excluded, max(average_r) FILTER (scenario = 'PESSIMISTIC') AS pessimistic,
       max(average_r) FILTER (scenario = 'AFTER_ENTRY') AS after_entry, round(max(average_r) - min(average_r), 6) AS scenario_range FROM scenario_bins GROUP BY 1, 2, 3, 4"""


@query("E24_width_sensitivity", SENSITIVITY_SQL)
def _(m):
    return width_sensitivity(m)


@query("O05_chronology_robustness", f"SELECT config_id, breakout_type, duration, count(*) AS bins, round(avg(scenario_range), 6) AS mean_range, max(scenario_range) AS max_range FROM ({SENSITIVITY_SQL}) GROUP BY 1, 2, 3")
def _(m):
    return width_sensitivity(m).groupBy("config_id", "breakout_type", "duration").agg(
        F.count(F.lit(1)).alias("bins"), r6(F.avg("scenario_range")).alias("mean_range"), F.max("scenario_range").alias("max_range"))


@query("E25_width_descriptors", """
SELECT breakout_type, config_id, duration, CASE WHEN hi - lo <= 0.25 AND pos >= 4 THEN 'RELATIVELY_STABLE' WHEN (a[1] + a[5]) / 2 > (a[2] + a[3] + a[4]) / 3 + 0.10 THEN 'U_SHAPED'
       WHEN (a[2] + a[3] + a[4]) / 3 > (a[1] + a[5]) / 2 + 0.10 AND list_position(a, hi) IN (2, 3, 4) THEN 'HUMP_SHAPED' ELSE 'MIXED_NONLINEAR' END || CASE WHEN top2 >= 0.8 THEN '_CONCENTRATED' ELSE '' END AS dependency,
       round(hi - lo, 6) AS average_r_range, CAST(pos AS INTEGER) AS positive_bins, CAST(list_position(a, hi) AS BIGINT) AS best_bin, CAST(list_position(a, lo) AS BIGINT) AS worst_bin, round(top2, 6) AS top_two_share
FROM (SELECT *, list_max(a) AS hi, list_min(a) AS lo, len(list_filter(a, lambda x: x > 0)) AS pos, CASE WHEN len(g) > 0 THEN list_sum(g[1:2]) / list_sum(g) END AS top2
      FROM (SELECT breakout_type, config_id, duration, list(average_r ORDER BY bin) AS a, list_sort(list_filter(list(total_r), lambda x: x > 0), 'DESC') AS g, count(average_r) AS n FROM conditional WHERE average_r IS NOT NULL GROUP BY 1, 2, 3) WHERE n = 5)""")
def _(m):
    return S.width_shape(conditional(m).filter("average_r is not null"), [*CELL, "duration"])


# --- two periods ----------------------------------------------------------
CTES["period_cells"] = f"SELECT breakout_type, config_id, stop_points, target_points, period, {CORE} FROM executed WHERE {OPEN_SQL} GROUP BY 1, 2, 3, 4, 5"
CTES["surface"] = """
SELECT d.breakout_type, d.config_id, d.stop_points, d.target_points, d.average_r AS dev_average_r, d.profit_factor AS dev_profit_factor, d.trades AS dev_trades, d.win_rate AS dev_win_rate,
       v.average_r AS val_average_r, v.profit_factor AS val_profit_factor, v.trades AS val_trades, v.win_rate AS val_win_rate, round(v.average_r - d.average_r, 6) AS average_r_delta,
       CASE WHEN abs(d.average_r) > 1e-12 THEN round((v.average_r - d.average_r) / abs(d.average_r), 6) END AS relative_average_r_change, round(v.profit_factor - d.profit_factor, 6) AS profit_factor_delta,
       CASE WHEN d.average_r > 0 AND v.average_r > 0 THEN 'POSITIVE_DEV_POSITIVE_VAL' WHEN d.average_r > 0 THEN 'POSITIVE_DEV_NEGATIVE_VAL' WHEN v.average_r > 0 THEN 'NEGATIVE_DEV_POSITIVE_VAL' ELSE 'NEGATIVE_DEV_NEGATIVE_VAL' END AS sign_persistence
FROM period_cells d JOIN period_cells v USING (breakout_type, config_id, stop_points, target_points) WHERE d.period = 'DEVELOPMENT' AND v.period = 'VALIDATION'"""
FULL = [*CELL, "stop_points", "target_points"]


def period_cells(m):
    return open_trades(m).groupBy(*FULL, "period").agg(*S.core_metrics())


def surface(m):
    return m.keep("surface", lambda: S.compare_periods(period_cells(m), FULL, ("average_r", "profit_factor", "trades", "win_rate"), "DEVELOPMENT", "VALIDATION"))


@query("D05_surface_comparison", "SELECT * FROM surface")
def _(m):
    return surface(m)


@query("D24_grid_neighbours", """
WITH c AS (SELECT breakout_type, stop_points, target_points, round(avg(result_r) + 1e-10, 5) AS average_r, dense_rank() OVER (PARTITION BY breakout_type ORDER BY stop_points) AS s, dense_rank() OVER (PARTITION BY breakout_type ORDER BY target_points) AS t FROM executed GROUP BY 1, 2, 3)
SELECT a.breakout_type, a.stop_points, a.target_points, a.average_r, count(b.average_r) AS neighbour_count, round(avg(b.average_r) + 1e-10, 4) AS neighbour_mean,
       round(avg(CASE WHEN b.average_r > 0 THEN 1.0 WHEN b.average_r IS NOT NULL THEN 0.0 END::DOUBLE), 6) AS neighbour_positive_share, round(a.average_r - round(avg(b.average_r) + 1e-10, 4), 4) AS minus_neighbour_mean
FROM c a LEFT JOIN c b ON a.breakout_type = b.breakout_type AND abs(a.s - b.s) + abs(a.t - b.t) = 1 GROUP BY 1, 2, 3, 4""")
def _(m):
    cells = executed(m).groupBy("breakout_type", "stop_points", "target_points").agg(F.round(F.avg("result_r") + 1e-10, 5).alias("average_r"))
    return S.grid_neighbours(cells, ["breakout_type"], ["stop_points", "target_points"], "average_r")


SIMILAR = 0.15  # fixed value: neighbours within this mean result support a cell
SIGNS = ("POSITIVE_DEV_POSITIVE_VAL", "POSITIVE_DEV_NEGATIVE_VAL", "NEGATIVE_DEV_POSITIVE_VAL", "NEGATIVE_DEV_NEGATIVE_VAL")
_POINTS_AGAIN = exits_sql("(SELECT c.* FROM cand_points c JOIN exits_points x USING (instrument_id, trading_date, breakout_type, direction, config_id) WHERE x.exit_reason = 'AMBIGUOUS_ENTRY_STOP')", ">")
CTES["points_again"] = f"SELECT * FROM exits_points WHERE exit_reason <> 'AMBIGUOUS_ENTRY_STOP' UNION ALL {_POINTS_AGAIN}"
CTES["point_scenarios"] = f"SELECT breakout_type, config_id, period, scenario, {CORE} FROM (SELECT *, {PERIOD_SQL} AS period FROM (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS scenario FROM ({audit_sql('cand_points', src)})" for n, src in (
        ("EXCLUDED", "exits_points"), ("PESSIMISTIC", "(" + _PESSIMISTIC.replace("exits_grid", "exits_points") + ")"), ("AFTER_ENTRY", "points_again"))) + f")) WHERE status = 'EXECUTED' AND {OPEN_SQL} GROUP BY 1, 2, 3, 4"
CTES["point_robustness"] = """
SELECT breakout_type, config_id, period, round(max(average_r) - min(average_r), 6) AS scenario_range, count(*) = 3 AND min(average_r) > 0 AND min(coalesce(profit_factor, 9.99)) > 1 AS robust,
       max(average_r) FILTER (scenario = 'PESSIMISTIC') AS entry_first_r FROM point_scenarios GROUP BY 1, 2, 3"""


def point_scenarios(m):
    """Metrics of the fixed-point cells in each scenario of unknown order and each open period."""
    def build():
        audit = scenarios_of(m, point_candidates(m), point_exits(m)).withColumn("period", period())
        done = audit.filter((F.col("status") == "EXECUTED") & F.col("period").isin(*OPEN_PERIODS))
        return done.groupBy(*CELL, "period", "scenario").agg(*S.core_metrics())
    return m.keep("point_scenarios", build)


def point_robustness(m):
    first = point_scenarios(m).filter("scenario = 'PESSIMISTIC'").select(*CELL, "period", F.col("average_r").alias("entry_first_r"))
    return S.scenario_robustness(point_scenarios(m), [*CELL, "period"], len(SCENARIOS)).join(first, [*CELL, "period"], "left")


@query("E15_point_scenarios", "SELECT * FROM point_scenarios")
def _(m):
    return point_scenarios(m)


@query("E16_point_robustness", "SELECT * FROM point_robustness")
def _(m):
    return point_robustness(m)


CTES["support_cells"] = """
SELECT s.*, coalesce(p.robust, FALSE) AS robust, p.entry_first_r, dense_rank() OVER (PARTITION BY s.breakout_type ORDER BY stop_points) AS s, dense_rank() OVER (PARTITION BY s.breakout_type ORDER BY target_points) AS t
FROM surface s LEFT JOIN point_robustness p ON p.breakout_type = s.breakout_type AND p.config_id = s.config_id AND p.period = 'DEVELOPMENT'"""
CTES["support"] = f"""
SELECT breakout_type, config_id, val_average_r, CASE WHEN robust AND on_stop AND on_target THEN 'STRONG' WHEN robust AND (on_stop OR on_target) THEN 'MODERATE' ELSE 'WEAK' END AS neighbour_support
FROM (SELECT a.breakout_type, a.config_id, any_value(a.val_average_r) AS val_average_r, bool_or(a.robust) AS robust, coalesce(bool_or(b.robust AND a.t = b.t), FALSE) AS on_stop, coalesce(bool_or(b.robust AND a.s = b.s), FALSE) AS on_target
      FROM support_cells a LEFT JOIN support_cells b ON a.breakout_type = b.breakout_type AND abs(a.s - b.s) + abs(a.t - b.t) = 1
       AND round(abs(a.entry_first_r - b.entry_first_r), 6) <= {SIMILAR} GROUP BY 1, 2)"""


def support(m):
    known = point_robustness(m).filter("period = 'DEVELOPMENT'").select(*CELL, "robust", "entry_first_r")
    cells = surface(m).join(known, CELL, "left").withColumn("robust", F.coalesce("robust", F.lit(False)))
    near = S.neighbour_support(cells, ["breakout_type"], ["stop_points", "target_points"], "entry_first_r", SIMILAR)
    return surface(m).join(near, ["breakout_type", "stop_points", "target_points"]).select(*CELL, "val_average_r", "neighbour_support")


@query("E33_neighbour_support", "SELECT * FROM support")
def _(m):
    return support(m)


def _rank_sql(x: str) -> str:
    return f"rank() OVER (PARTITION BY breakout_type ORDER BY {x}) + (count(*) OVER (PARTITION BY breakout_type, {x}) - 1) / 2.0::DOUBLE"


CTES["persistence"] = f"""
SELECT a.*, f.spearman_profit_factor, w.strong_cells, w.strong_cells_val_positive
FROM (SELECT breakout_type, round(corr(rx, ry), 6) AS spearman_average_r, round(quantile_cont(average_r_delta, 0.5), 6) AS median_average_r_delta, CAST(count_if(dev_average_r > 0) AS BIGINT) AS dev_positive_cells,
             CAST(count_if(sign_persistence = 'POSITIVE_DEV_NEGATIVE_VAL') AS BIGINT) AS flips, count(*) AS cells,
             CASE WHEN count_if(dev_average_r > 0) > 0 THEN round(count_if(sign_persistence = 'POSITIVE_DEV_NEGATIVE_VAL') / count_if(dev_average_r > 0), 6) END AS flip_rate,
             {", ".join(f"CAST(count_if(sign_persistence = '{n}') AS BIGINT) AS {n.lower()}" for n in SIGNS)}
      FROM (SELECT *, {_rank_sql("dev_average_r")} AS rx, {_rank_sql("val_average_r")} AS ry FROM surface) GROUP BY 1) a
LEFT JOIN (SELECT breakout_type, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS spearman_profit_factor
           FROM (SELECT breakout_type, {_rank_sql("dev_profit_factor")} AS rx, {_rank_sql("val_profit_factor")} AS ry FROM surface WHERE dev_profit_factor IS NOT NULL AND val_profit_factor IS NOT NULL) GROUP BY 1) f USING (breakout_type)
JOIN (SELECT breakout_type, CAST(count_if(neighbour_support = 'STRONG') AS BIGINT) AS strong_cells, CAST(count_if(neighbour_support = 'STRONG' AND val_average_r > 0) AS BIGINT) AS strong_cells_val_positive FROM support GROUP BY 1) w USING (breakout_type)"""


def persistence(m):
    key, sign = ["breakout_type"], F.col("sign_persistence")
    rho = lambda x: S.correlations(surface(m), key, f"dev_{x}", f"val_{x}").select(*key, F.col("spearman").alias(f"spearman_{x}"))
    flips, gains = F.count_if(sign == "POSITIVE_DEV_NEGATIVE_VAL"), F.count_if(F.col("dev_average_r") > 0)
    agg = surface(m).groupBy(*key).agg(
        r6(F.percentile("average_r_delta", F.lit(0.5))).alias("median_average_r_delta"), gains.alias("dev_positive_cells"), flips.alias("flips"), F.count(F.lit(1)).alias("cells"),
        r6(F.try_divide(flips, gains)).alias("flip_rate"), *[F.count_if(sign == n).alias(n.lower()) for n in SIGNS])
    strong = F.col("neighbour_support") == "STRONG"
    held = support(m).groupBy(*key).agg(F.count_if(strong).alias("strong_cells"), F.count_if(strong & (F.col("val_average_r") > 0)).alias("strong_cells_val_positive"))
    # Not defined for ranks that are all equal: NaN for the mean result, null for the profit factor.
    means = rho("average_r").fillna(float("nan"), ["spearman_average_r"])
    return agg.join(means, key).join(rho("profit_factor"), key, "left").join(held, key)


@query("E33_persistence_statistics", "SELECT * FROM persistence")
def _(m):
    return persistence(m)


def migration(m):
    def peak(group, axis, name):
        best = lambda v: F.max_by(axis, F.struct(F.col(v), -F.col(axis)))
        got = surface(m).groupBy("breakout_type", F.col(group).alias("fixed")).agg(best("dev_average_r").alias("dev_peak"), best("val_average_r").alias("val_peak"))
        move = F.when(F.col("dev_peak") == F.col("val_peak"), "STABLE_REGION").when(F.col("val_peak") > F.col("dev_peak"), "SHIFTED_LARGER").otherwise("SHIFTED_SMALLER")
        return got.select(F.lit(name).alias("comparison_axis"), "breakout_type", "fixed", "dev_peak", "val_peak", move.alias("migration"))
    return peak("stop_points", "target_points", "TARGET_REGION").unionByName(peak("target_points", "stop_points", "STOP_FAMILY"))


CTES["migration"] = " UNION ALL ".join(f"""
SELECT '{n}' AS comparison_axis, breakout_type, fixed, dev_peak, val_peak, CASE WHEN dev_peak = val_peak THEN 'STABLE_REGION' WHEN val_peak > dev_peak THEN 'SHIFTED_LARGER' ELSE 'SHIFTED_SMALLER' END AS migration
FROM (SELECT breakout_type, {g} AS fixed, arg_max({a}, (dev_average_r, -{a})) AS dev_peak, arg_max({a}, (val_average_r, -{a})) AS val_peak FROM surface GROUP BY 1, 2)""" for n, g, a in (
    ("TARGET_REGION", "stop_points", "target_points"), ("STOP_FAMILY", "target_points", "stop_points")))


@query("E34_parameter_migration", "SELECT * FROM migration")
def _(m):
    return migration(m)


CTES["neighbourhood"] = """
SELECT a.breakout_type, a.config_id, round(avg(CASE WHEN b.val_average_r > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS positive_share, round(avg(b.val_average_r) + 1e-10, 4) AS neighbour_val_mean, round(avg(b.dev_average_r) + 1e-10, 4) AS neighbour_dev_mean,
       any_value(a.dev_average_r) AS dev_average_r, any_value(a.val_average_r) AS val_average_r
FROM (SELECT *, dense_rank() OVER (PARTITION BY breakout_type ORDER BY stop_points) AS s, dense_rank() OVER (PARTITION BY breakout_type ORDER BY target_points) AS t FROM surface) a
JOIN (SELECT *, dense_rank() OVER (PARTITION BY breakout_type ORDER BY stop_points) AS s, dense_rank() OVER (PARTITION BY breakout_type ORDER BY target_points) AS t FROM surface) b
 ON a.breakout_type = b.breakout_type AND abs(a.s - b.s) + abs(a.t - b.t) = 1 GROUP BY 1, 2"""


def neighbourhood(m):
    cells = surface(m)
    val = S.grid_neighbours(cells.select("breakout_type", "stop_points", "target_points", "val_average_r"), ["breakout_type"], ["stop_points", "target_points"], "val_average_r")
    dev = S.grid_neighbours(cells.select("breakout_type", "stop_points", "target_points", "dev_average_r"), ["breakout_type"], ["stop_points", "target_points"], "dev_average_r")
    keys = ["breakout_type", "stop_points", "target_points"]
    return cells.select(*keys, "config_id", "dev_average_r", "val_average_r").join(
        val.select(*keys, F.col("neighbour_positive_share").alias("positive_share"), F.col("neighbour_mean").alias("neighbour_val_mean")), keys).join(
        dev.select(*keys, F.col("neighbour_mean").alias("neighbour_dev_mean")), keys).drop("stop_points", "target_points").filter("neighbour_val_mean is not null")


@query("E35_candidate_neighborhoods", """
SELECT n.*, CASE WHEN p.flip_rate >= 0.6 AND p.median_average_r_delta < 0 AND positive_share <= 0.5 THEN 'BROAD_SURFACE_DETERIORATION' WHEN positive_share > 0.5 AND neighbour_val_mean > 0 THEN 'LOCAL_FAILURE'
 ELSE 'NEIGHBORHOOD_DETERIORATION' END AS classification FROM neighbourhood n JOIN persistence p USING (breakout_type)""")
def _(m):
    broad = persistence(m).select("breakout_type", "flip_rate", "median_average_r_delta")
    return neighbourhood(m).join(broad, "breakout_type").withColumn("classification", S.neighbourhood_class(
        F.col("positive_share"), F.col("neighbour_val_mean"), F.col("flip_rate"), F.col("median_average_r_delta"))).drop("flip_rate", "median_average_r_delta")


@query("E36_temporal_diagnostics", """
SELECT breakout_type, stop_points, trading_date, n, result_r, CASE WHEN count(*) OVER w = 5 THEN round(avg(raw) OVER w, 6) END AS rolling_5
FROM (SELECT breakout_type, stop_points, trading_date, count(*) AS n, avg(result_r) AS raw, round(avg(result_r), 6) AS result_r FROM executed GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY breakout_type, stop_points ORDER BY trading_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(m):
    daily = executed(m).groupBy("breakout_type", "stop_points", "trading_date").agg(F.count(F.lit(1)).alias("n"), F.avg("result_r").alias("raw"))
    w = S.Window.partitionBy("breakout_type", "stop_points").orderBy("trading_date").rowsBetween(-4, 0)
    return daily.select("breakout_type", "stop_points", "trading_date", "n", r6("raw").alias("result_r"),
                        F.when(F.count(F.lit(1)).over(w) == 5, r6(F.avg("raw").over(w))).alias("rolling_5"))


@query("E39_observability_comparison", f"""
SELECT stop_points, period, count(*) AS eligible, round(sum(CASE WHEN exit_reason = 'AMBIGUOUS_ENTRY_STOP' THEN 1 ELSE 0 END) / count(*), 6) AS entry_stop_rate, round(sum(CASE WHEN is_ambiguous THEN 1 ELSE 0 END) / count(*), 6) AS exclusion_rate
FROM (SELECT x.*, c.stop_points, {PERIOD_SQL.replace('trading_date', 'x.trading_date')} AS period FROM exits_points x JOIN cand_points c USING (instrument_id, trading_date, breakout_type, direction, config_id)) WHERE {OPEN_SQL} GROUP BY 1, 2""")
def _(m):
    rows = point_exits(m).join(point_candidates(m).select(*T.CANDIDATE, "stop_points"), T.CANDIDATE).withColumn("period", period()).filter(F.col("period").isin(*OPEN_PERIODS))
    return rows.groupBy("stop_points", "period").agg(
        F.count(F.lit(1)).alias("eligible"), r6(F.count_if(F.col("exit_reason") == "AMBIGUOUS_ENTRY_STOP") / F.count(F.lit(1))).alias("entry_stop_rate"),
        r6(F.count_if("is_ambiguous") / F.count(F.lit(1))).alias("exclusion_rate"))


@query("E38_width_two_period", f"""
SELECT period, bucket, count(*) AS n, round(avg(result_r), 6) AS average_r FROM (SELECT *, CASE WHEN or_width < 20000 THEN 'NARROW' WHEN or_width < 40000 THEN 'MIDDLE' ELSE 'WIDE' END AS bucket FROM executed WHERE {OPEN_SQL}) GROUP BY 1, 2""")
def _(m):
    bucket = F.when(F.col("or_width") < 20000, "NARROW").when(F.col("or_width") < 40000, "MIDDLE").otherwise("WIDE")
    return open_trades(m).groupBy("period", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("result_r")).alias("average_r"))


# --- decisions -----------------------------------------------------------
#: Fixed values of the observability class: an ambiguity rate, its increase, a range of mean results over the scenarios and its multiple of
#: the development range that call for caution.
HIGH_AMBIGUITY, AMBIGUITY_RISE, MATERIAL_RANGE, RANGE_MULTIPLE = 0.15, 0.05, 0.15, 1.5

CTES["entry_first"] = f"""
SELECT breakout_type, config_id, {CORE} FROM ({audit_sql("cand_points", "(" + _PESSIMISTIC.replace("exits_grid", "exits_points") + ")")})
WHERE status = 'EXECUTED' AND trading_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-22' GROUP BY 1, 2"""
CTES["daily_labels"] = f"""
SELECT breakout_type, config_id, CASE WHEN fh + sh <= 0 OR (fh > 0 AND sh < 0 AND abs(sh) >= 0.5 * fh) THEN 'UNSTABLE' WHEN pos >= 50 AND conc <= 0.6 THEN 'BROAD' ELSE 'CONCENTRATED' END AS temporal
FROM (SELECT breakout_type, config_id, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) * 100, 6) AS pos, round(max(CASE WHEN r > 0 THEN r END) / sum(CASE WHEN r > 0 THEN r END), 6) AS conc,
             round(sum(CASE WHEN k * 2 <= n THEN r ELSE 0 END), 6) AS fh, round(sum(CASE WHEN k * 2 > n THEN r ELSE 0 END), 6) AS sh
      FROM (SELECT *, row_number() OVER (PARTITION BY breakout_type, config_id ORDER BY trading_date) AS k, count(*) OVER (PARTITION BY breakout_type, config_id) AS n
            FROM (SELECT breakout_type, config_id, trading_date, round(sum(result_r), 6) AS r FROM executed WHERE period = 'VALIDATION' GROUP BY 1, 2, 3)) GROUP BY 1, 2)"""
CTES["ambiguity"] = f"""
SELECT breakout_type, config_id, avg(CASE WHEN is_ambiguous THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (period = 'VALIDATION') AS val_rate, avg(CASE WHEN is_ambiguous THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (period = 'DEVELOPMENT') AS dev_rate
FROM (SELECT *, {PERIOD_SQL} AS period FROM exits_points) GROUP BY 1, 2"""
CTES["decisions"] = f"""
SELECT breakout_type, config_id, edge, degradation, temporal, observability,
       CASE WHEN edge = 'FAILED' OR observability = 'FAILED' THEN 'REJECT' WHEN edge = 'STRONG' AND degradation IN ('LOW', 'MODERATE') AND temporal = 'BROAD' AND observability = 'STRONG' THEN 'PASS' ELSE 'REVISE' END AS overall
FROM (SELECT *, CASE WHEN val_average_r <= 0 OR vpf <= 1 THEN 'FAILED' WHEN ear <= 0 OR epf <= 1 THEN 'MIXED' WHEN least(val_average_r, ear) < 0.02 OR least(vpf, epf) - 1 < 0.05 THEN 'MIXED' ELSE 'STRONG' END AS edge,
             CASE WHEN val_average_r <= 0 THEN 'SIGN_REVERSAL' WHEN val_average_r / dev_average_r >= 0.75 - 1e-12 THEN 'LOW' WHEN val_average_r / dev_average_r >= 0.5 - 1e-12 THEN 'MODERATE' ELSE 'HIGH' END AS degradation,
             CASE WHEN ear <= 0 OR epf <= 1 THEN 'FAILED' WHEN NOT robust OR val_rate >= {HIGH_AMBIGUITY} OR val_rate - coalesce(dev_rate, 0) >= {AMBIGUITY_RISE} OR scenario_range > greatest({MATERIAL_RANGE}, {RANGE_MULTIPLE} * coalesce(dev_range, 0)) THEN 'CAUTION' ELSE 'STRONG' END AS observability
      FROM (SELECT s.*, coalesce(s.val_profit_factor, 9.99) AS vpf, e.average_r AS ear, coalesce(e.profit_factor, 9.99) AS epf, t.temporal, a.val_rate, a.dev_rate, rv.robust, rv.scenario_range, rd.scenario_range AS dev_range
            FROM surface s JOIN entry_first e USING (breakout_type, config_id) JOIN daily_labels t USING (breakout_type, config_id) JOIN ambiguity a USING (breakout_type, config_id)
            JOIN point_robustness rv ON rv.breakout_type = s.breakout_type AND rv.config_id = s.config_id AND rv.period = 'VALIDATION'
            LEFT JOIN point_robustness rd ON rd.breakout_type = s.breakout_type AND rd.config_id = s.config_id AND rd.period = 'DEVELOPMENT'))"""


def decisions(m):
    """Edge, degradation, temporal and observability class of each cell from its validation results.

    The edge must also hold if unknown entry-bar stops count as losses; the temporal label is that of daily totals; the
    observability comes from that scenario, from whether all scenarios gain, the range of their means against development,
    the share of ambiguous exits and its rise since development.
    """
    def build():
        held = F.col("period") == "VALIDATION"
        resolved = T.session_trade_limit(point_candidates(m), T.resolve_pessimistic(point_exits(m))).withColumn("period", period())
        entry = resolved.filter((F.col("status") == "EXECUTED") & held).groupBy(*CELL).agg(*S.core_metrics()).select(*CELL, F.col("average_r").alias("_e"), F.col("profit_factor").alias("_epf"))
        days = executed(m).filter(held).groupBy(*CELL, F.col("trading_date").alias("month")).agg(r6(F.sum("result_r")).alias("total_r"))
        label = S.temporal_consistency(days, CELL).select(*CELL, F.col("label").alias("temporal"))
        rates = point_exits(m).withColumn("period", period()).groupBy(*CELL).agg(F.try_divide(S.share(F.col("is_ambiguous") & (F.col("period") == "VALIDATION")), S.share(F.col("period") == "VALIDATION")).alias("_rate"), F.coalesce(F.try_divide(S.share(F.col("is_ambiguous") & (F.col("period") == "DEVELOPMENT")), S.share(F.col("period") == "DEVELOPMENT")), F.lit(0.0)).alias("_dev"))
        spread = lambda p: point_robustness(m).filter(F.col("period") == p)
        rows = surface(m).join(entry, CELL).join(label, CELL).join(rates, CELL).join(spread("VALIDATION").select(*CELL, "robust", "scenario_range"), CELL)
        rows = rows.join(spread("DEVELOPMENT").select(*CELL, F.col("scenario_range").alias("_dev_range")), CELL, "left")
        wide = F.col("scenario_range") > F.greatest(F.lit(MATERIAL_RANGE), RANGE_MULTIPLE * F.coalesce("_dev_range", F.lit(0.0)))
        d, v, pf, e, epf = (F.col(c) for c in ("dev_average_r", "val_average_r", "val_profit_factor", "_e", "_epf"))
        careful = ~F.col("robust") | (F.col("_rate") >= HIGH_AMBIGUITY) | (F.col("_rate") - F.col("_dev") >= AMBIGUITY_RISE) | wide
        seen = F.when((e <= 0) | (F.coalesce(epf, F.lit(9.99)) <= 1), "FAILED").when(careful, "CAUTION").otherwise("STRONG")
        rows = rows.withColumns({"edge": S.edge_class(v, pf, e, epf), "degradation": S.degradation_class(v, d), "observability": seen})
        return rows.select(*CELL, "edge", "degradation", "temporal", "observability",
                           S.overall_class(F.col("edge"), F.col("degradation"), F.col("temporal"), F.col("observability")).alias("overall"))
    return m.keep("decisions", build)


@query("C34_decision_classifiers", "SELECT * FROM decisions")
def _(m):
    return decisions(m)


@query("C33_price_normalization", f"""
SELECT instrument_id, period, round(quantile_cont(stop_points * 100 / mid, 0.5), 6) AS median_stop_pct, round(quantile_cont(or_width / mid, 0.5), 6) AS median_width_pct
FROM (SELECT e.*, (l.or_high + l.or_low) / 2.0::DOUBLE AS mid FROM executed e JOIN or_levels l USING (instrument_id, trading_date) WHERE {OPEN_SQL}) GROUP BY 1, 2""")
def _(m):
    mid = or_levels(m).select("instrument_id", "trading_date", (F.col("or_mid2") / 2.0).alias("mid"))
    rows = open_trades(m).join(mid, ["instrument_id", "trading_date"]).withColumns({
        "stop_pct": F.col("stop_points") * 100 / F.col("mid"), "width_pct": F.col("or_width") / F.col("mid")})
    keys = ["instrument_id", "period"]
    a = S.exact_percentiles(rows, keys, "stop_pct", {"median_stop_pct": 0.5}).withColumn("median_stop_pct", r6("median_stop_pct"))
    b = S.exact_percentiles(rows, keys, "width_pct", {"median_width_pct": 0.5}).withColumn("median_width_pct", r6("median_width_pct"))
    return a.join(b, keys)


@query("D04_evidence_table", """
SELECT s.*, n.positive_share, n.neighbour_val_mean, d.edge, d.overall FROM surface s LEFT JOIN neighbourhood n USING (breakout_type, config_id) LEFT JOIN decisions d USING (breakout_type, config_id)""")
def _(m):
    rows = surface(m).join(decisions(m).select(*CELL, "edge", "overall"), CELL, "left")
    return rows.join(neighbourhood(m).select(*CELL, "positive_share", "neighbour_val_mean"), CELL, "left")
