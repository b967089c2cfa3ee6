"""Extension points: transforms, ordered replay, keyed online state, trade aggregates and SQL reach."""
from pyspark.sql import functions as F

from sessionloom.catalog.ledger import book
from sessionloom.catalog.registry import query
from sessionloom.catalog.trades import signals
from sessionloom.catalog.zzstreaming import bars_stream, place, ranged_bars
from sessionloom.functions.replay import replay
from sessionloom.functions.scalars import r6
from sessionloom.operators import stats as S
from sessionloom.sources.market import LEDGER_LEVELS, LEDGER_ORDER
from sessionloom.streaming import bars as N


@query("M01_transform_chain", "SELECT instrument_id, trading_date, count(*) AS up_bars, max(high) AS high FROM bars WHERE close > open GROUP BY 1, 2")
def _(m):
    rising = lambda df: df.filter("close > open")
    daily = lambda df: df.groupBy("instrument_id", "trading_date").agg(F.count(F.lit(1)).alias("up_bars"), F.max("high").alias("high"))
    return m.bars().transform(rising).transform(daily)


class _NewHighs:
    """Counts new session highs; the rows of one session arrive in order."""

    def __init__(self, key):
        self.key, self.top, self.count = key, None, 0

    def step(self, row):
        if self.top is None or row.high > self.top:
            self.top, self.count = row.high, self.count + 1
        return []

    def finish(self):
        return [(*self.key, self.count, self.top)]


@query("M02_ordered_replay", """
SELECT instrument_id, trading_date, CAST(count_if(p IS NULL OR high > p) AS BIGINT) AS new_highs, max(high) AS session_high
FROM (SELECT *, max(high) OVER (PARTITION BY instrument_id, trading_date ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM bars) GROUP BY 1, 2""")
def _(m):
    rows = m.bars().select("instrument_id", "trading_date", "slot", "high")
    return replay(rows, ["instrument_id", "trading_date"], ["slot"], _NewHighs, "instrument_id string, trading_date date, new_highs bigint, session_high bigint")


@query("M03_keyed_online_state", """
SELECT direction, count(*) AS breakouts FROM (SELECT s.* FROM signals s JOIN (SELECT instrument_id, trading_date, max(bar_end) AS z FROM eligible GROUP BY 1, 2) d USING (instrument_id, trading_date)
WHERE s.breakout_type = 'CLOSE' AND d.z < (SELECT max(bar_end) - INTERVAL 1 HOUR FROM eligible)) GROUP BY 1""")
def _(m):
    out = N.drain(N.stream_breakouts(bars_stream(m, ranged_bars(m), "ranged"), "1 hour"), place(m))
    return out.groupBy("direction").agg(F.count(F.lit(1)).alias("breakouts"))


@query("M04_trade_aggregates", """
SELECT variant, direction, round(max(peak - equity), 6) AS max_drawdown_r, any_value(pf) AS profit_factor FROM (
 SELECT variant, direction, equity, pf, greatest(0, max(equity) OVER (PARTITION BY variant, direction ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)) AS peak
 FROM (SELECT *, sum(result_r) OVER (PARTITION BY variant, direction ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS equity,
   round(sum(CASE WHEN result_r > 0 THEN result_r ELSE 0 END) OVER (PARTITION BY variant, direction) / abs(sum(CASE WHEN result_r < 0 THEN result_r ELSE 0 END) OVER (PARTITION BY variant, direction)), 6) AS pf FROM ledger)) GROUP BY 1, 2""")
def _(m):
    keys = ["variant", "direction"]
    fall = S.max_drawdown(book(m), keys, LEDGER_LEVELS, LEDGER_ORDER)
    return fall.join(book(m).groupBy(*keys).agg(r6(S.profit_factor()).alias("profit_factor")), keys)


@query("M05_sql_reach", "SELECT breakout_type, count(*) AS signals, count(DISTINCT trading_date) AS days, CAST(avg(or_high - or_low) AS BIGINT) AS mean_width FROM signals GROUP BY 1")
def _(m):
    signals(m).createOrReplaceTempView("breakout_signals")
    return m.spark.sql("""SELECT breakout_type, count(*) AS signals, count(DISTINCT trading_date) AS days, CAST(round(avg(or_high - or_low)) AS BIGINT) AS mean_width
                          FROM breakout_signals GROUP BY breakout_type""")
