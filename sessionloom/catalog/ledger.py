"""Statistics over the trade ledger (one trade per line item)."""
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6

from sessionloom.catalog.registry import query
from sessionloom.catalog.sql import CTES
from sessionloom.functions.ordered import position, running
from sessionloom.operators import stats as S
from sessionloom.sources.market import LEDGER_LEVELS, LEDGER_ORDER, ledger

ORDER = ", ".join(LEDGER_ORDER)
CTES["ledger"] = f"""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS trade_ref,
       l_returnflag || l_linestatus AS variant, CAST(l_shipdate AS DATE) AS session_date, l_shipdate AS entry_time, (l_quantity - 25) / 10 AS result_r,
       CASE WHEN l_linenumber % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE l_linenumber % 3 WHEN 0 THEN 'TARGET' WHEN 1 THEN 'STOP' ELSE 'SESSION_END' END AS exit_reason,
       l_linenumber * 5 AS holding_minutes, {ORDER} FROM lineitem"""
W = f"PARTITION BY variant ORDER BY {ORDER}"
CORE = """count(result_r) AS trades, CAST(count_if(result_r > 0) AS BIGINT) AS wins, CAST(count_if(result_r < 0) AS BIGINT) AS losses, CAST(count_if(result_r = 0) AS BIGINT) AS flats,
 round(avg(CASE WHEN result_r > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS win_rate, round(avg(result_r), 6) AS average_r, round(sum(result_r), 6) AS total_r,
 round(CASE WHEN sum(CASE WHEN result_r < 0 THEN result_r ELSE 0 END) < 0 THEN sum(CASE WHEN result_r > 0 THEN result_r ELSE 0 END) / abs(sum(CASE WHEN result_r < 0 THEN result_r ELSE 0 END)) END, 6) AS profit_factor"""
KEYS = ["variant"]


def book(m):
    return ledger(m.table("lineitem"))


def exit_counts():
    return ", ".join(f"CAST(count_if(exit_reason = '{k}') AS BIGINT) AS {k.lower()}_exits" for k in ("TARGET", "STOP", "SESSION_END"))


@query("E08_variant_metrics", f"SELECT variant, {CORE}, {exit_counts()} FROM ledger GROUP BY 1")
def _(m):
    return S.variant_metrics(book(m), KEYS)


CTES["drawdown"] = f"""
SELECT variant, round(max(peak - equity), 6) AS max_drawdown_r
FROM (SELECT variant, equity, greatest(0, max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS peak
      FROM (SELECT *, sum(result_r) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM ledger)) GROUP BY 1"""
CTES["streaks"] = f"""
SELECT variant, max(n) AS max_losing_streak FROM (SELECT variant, g, count(*) AS n
 FROM (SELECT *, sum(CASE WHEN result_r >= 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM ledger) WHERE result_r < 0 GROUP BY 1, 2) GROUP BY 1"""


@query("F07_max_drawdown", "SELECT * FROM drawdown")
def _(m):
    return S.max_drawdown(book(m), KEYS, LEDGER_LEVELS, LEDGER_ORDER)


@query("F07_equity", f"SELECT variant, {ORDER}, round(sum(result_r) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS equity FROM ledger")
def _(m):
    return running(book(m), KEYS, LEDGER_LEVELS, LEDGER_ORDER, {"equity": ("sum", F.col("result_r"))}).select(
        "variant", *LEDGER_ORDER, r6("equity").alias("equity"))


@query("F08_max_losing_streak", "SELECT * FROM streaks")
def _(m):
    return S.max_losing_streak(book(m), KEYS, LEDGER_LEVELS, LEDGER_ORDER)


@query("F19_trade_number", f"SELECT variant, {ORDER}, row_number() OVER ({W}) AS trade_number FROM ledger")
def _(m):
    return position(book(m), KEYS, LEDGER_LEVELS, LEDGER_ORDER).select("variant", *LEDGER_ORDER, (F.col("pos") + 1).alias("trade_number"))


@query("F06_rolling_expectancy", f"""
SELECT variant, {ORDER}, pos, CASE WHEN count(*) OVER w = 50 THEN round(avg(result_r) OVER w, 6) END AS rolling_50
FROM (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM ledger) WINDOW w AS ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def _(m):
    out = S.rolling_mean(book(m), KEYS, LEDGER_LEVELS, LEDGER_ORDER, 50)
    return out.select("variant", *LEDGER_ORDER, "pos", "rolling_50")


@query("E09_trade_summary", f"""
SELECT *, coalesce(s.max_losing_streak, 0) AS max_losing_streak FROM (SELECT variant, {CORE}, CAST(count_if(exit_reason = 'SESSION_END') AS BIGINT) AS session_end_exits, round(avg(holding_minutes), 6) AS average_holding_minutes,
 CAST(count_if(direction = 'LONG') AS BIGINT) AS long_trades, round(avg(result_r) FILTER (direction = 'LONG'), 6) AS long_average_r, CAST(count_if(direction = 'SHORT') AS BIGINT) AS short_trades,
 round(avg(result_r) FILTER (direction = 'SHORT'), 6) AS short_average_r, round(quantile_cont(result_r, 0.5), 6) AS median_r FROM ledger GROUP BY 1)
JOIN drawdown USING (variant) LEFT JOIN (SELECT variant, max_losing_streak FROM streaks) s USING (variant)""".replace(
    "SELECT *, coalesce(s.max_losing_streak, 0) AS max_losing_streak FROM", "SELECT * EXCLUDE (max_losing_streak), coalesce(max_losing_streak, 0) AS max_losing_streak FROM"))
def _(m):
    return S.trade_summary(book(m), KEYS, LEDGER_LEVELS, LEDGER_ORDER)


CTES["monthly"] = """
SELECT variant, strftime(session_date, '%Y-%m') AS month, count(*) AS trades, round(sum(result_r), 6) AS total_r, round(avg(result_r), 6) AS average_r,
       round(avg(CASE WHEN result_r > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS win_rate FROM ledger GROUP BY 1, 2"""


@query("E10_monthly_summary", "SELECT * FROM monthly")
def _(m):
    return S.monthly_summary(book(m), KEYS)


@query("E11_monthly_dense", """
SELECT d.variant, d.month, coalesce(x.trades, 0) AS trades, coalesce(x.total_r, 0) AS total_r, x.average_r
FROM (SELECT variant, strftime(unnest(generate_series(date_trunc('month', min(session_date)), date_trunc('month', max(session_date)), INTERVAL 1 MONTH)), '%Y-%m') AS month
      FROM ledger GROUP BY variant) d
LEFT JOIN (SELECT variant, strftime(session_date, '%Y-%m') AS month, count(*) AS trades, round(sum(result_r), 6) AS total_r, round(avg(result_r), 6) AS average_r
           FROM ledger GROUP BY 1, 2) x USING (variant, month)""")
def _(m):
    return S.monthly_dense(book(m), KEYS)


@query("E12_month_statistics", """
SELECT variant, CAST(count_if(total_r > 0) AS BIGINT) AS positive_months, CAST(count_if(total_r < 0) AS BIGINT) AS negative_months, CAST(count_if(total_r = 0) AS BIGINT) AS flat_months,
       max(total_r) AS best_month_r, min(total_r) AS worst_month_r, round(avg(total_r), 6) AS mean_month_r, round(quantile_cont(total_r, 0.5), 6) AS median_month_r FROM monthly GROUP BY 1""")
def _(m):
    return S.month_statistics(S.monthly_summary(book(m), KEYS), KEYS)


@query("E13_r_distribution", """
SELECT variant, count(*) AS n, round(avg(result_r), 6) AS mean_r, round(stddev_samp(result_r), 6) AS std_r, min(result_r) AS min_r, max(result_r) AS max_r,
       CAST(count_if(abs(result_r + 1) <= 1e-9) AS BIGINT) AS near_minus_one, CAST(count_if(abs(result_r - 2) <= 1e-9) AS BIGINT) AS near_plus_two, CAST(count_if(abs(result_r) <= 1e-9) AS BIGINT) AS near_zero,
       round(quantile_cont(result_r, 0.1), 6) AS p10, round(quantile_cont(result_r, 0.25), 6) AS p25, round(quantile_cont(result_r, 0.5), 6) AS p50,
       round(quantile_cont(result_r, 0.75), 6) AS p75, round(quantile_cont(result_r, 0.9), 6) AS p90 FROM ledger GROUP BY 1""")
def _(m):
    return S.r_distribution(book(m), KEYS)


@query("F05_ordinal_bins", f"""
SELECT variant, {ORDER}, CASE WHEN n = 1 THEN 1 ELSE greatest(1, (5 * i + n - 2) // (n - 1)) END AS bin
FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY l_extendedprice, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i,
             count(*) OVER (PARTITION BY variant) AS n FROM ledger)""")
def _(m):
    rows = book(m).withColumn("_kilo", F.floor(F.col("l_extendedprice") / 1000)).withColumn("_unit", F.floor("l_extendedprice"))
    order = ["l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return S.ordinal_bins(rows, KEYS, order, [["_kilo"], ["_unit"]], 5).select("variant", *LEDGER_ORDER, "bin")


@query("E20_correlations", """
SELECT variant, count(*) AS n, round(corr(l_extendedprice, result_r), 6) AS pearson, round(corr(rx, ry), 6) AS spearman
FROM (SELECT *, rank() OVER (PARTITION BY variant ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY variant, l_extendedprice) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY variant ORDER BY result_r) + (count(*) OVER (PARTITION BY variant, result_r) - 1) / 2.0::DOUBLE AS ry FROM ledger) GROUP BY 1""")
def _(m):
    return S.correlations(book(m), KEYS, "l_extendedprice", "result_r")


@query("D22_full_outer_align", """
SELECT session_date, variant, round(sum(coalesce(r, 0)) OVER (PARTITION BY variant ORDER BY session_date), 6) AS equity
FROM (SELECT DISTINCT variant FROM ledger) CROSS JOIN (SELECT DISTINCT session_date FROM ledger) LEFT JOIN (SELECT variant, session_date, sum(result_r) AS r FROM ledger GROUP BY 1, 2) USING (variant, session_date)""")
def _(m):
    return S.equity_curves(book(m), "variant")


@query("E41_temporal_consistency", """
SELECT *, CASE WHEN first_half_r + second_half_r <= 0 OR (first_half_r > 0 AND second_half_r < 0 AND abs(second_half_r) >= 0.5 * first_half_r) THEN 'UNSTABLE'
               WHEN positive_month_percentage >= 50 AND concentration <= 0.6 THEN 'BROAD' ELSE 'CONCENTRATED' END AS label
FROM (SELECT variant, round(avg(CASE WHEN total_r > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) * 100, 6) AS positive_month_percentage,
             round(max(CASE WHEN total_r > 0 THEN total_r END) / sum(CASE WHEN total_r > 0 THEN total_r END), 6) AS concentration,
             round(sum(CASE WHEN k * 2 <= n THEN total_r ELSE 0 END), 6) AS first_half_r, round(sum(CASE WHEN k * 2 > n THEN total_r ELSE 0 END), 6) AS second_half_r
      FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY month) AS k, count(*) OVER (PARTITION BY variant) AS n FROM monthly) GROUP BY 1)""")
def _(m):
    return S.temporal_consistency(S.monthly_summary(book(m), KEYS), KEYS)


@query("E45_distinct", "SELECT variant, count(DISTINCT session_date) AS sessions, count(DISTINCT l_orderkey) AS orders FROM ledger GROUP BY 1")
def _(m):
    # distinct pairs first, so that no task gathers one variant's values
    pairs = book(m)
    days = pairs.select("variant", "session_date").distinct().groupBy("variant").agg(F.count(F.lit(1)).alias("sessions"))
    orders = pairs.select("variant", "l_orderkey").distinct().groupBy("variant").agg(F.count(F.lit(1)).alias("orders"))
    return days.join(orders, "variant")
