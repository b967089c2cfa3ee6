"""Trade statistics, exact order statistics, bins, correlations and state summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6

from sessionloom.functions.ordered import halo_window, home_rows, position, running, with_halo


def result() -> Column:
    return F.col("result_r")


def profit_factor(value: Column | None = None) -> Column:
    """Gross profit over gross loss; null without a loss."""
    value = result() if value is None else value
    loss = F.abs(F.sum(F.when(value < 0, value).otherwise(0)))
    return F.when(loss > 0, F.sum(F.when(value > 0, value).otherwise(0)) / loss)


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def core_metrics(value: Column | None = None) -> list[Column]:
    value = result() if value is None else value
    return [
        F.count(value).alias("trades"), F.count_if(value > 0).alias("wins"), F.count_if(value < 0).alias("losses"),
        F.count_if(value == 0).alias("flats"), r6(share(value > 0)).alias("win_rate"), r6(F.avg(value)).alias("average_r"),
        r6(F.sum(value)).alias("total_r"), r6(profit_factor(value)).alias("profit_factor"),
    ]


def variant_metrics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, win rate, mean, total, profit factor and exits per variant; one combinable aggregation."""
    exits = [F.count_if(F.col("exit_reason") == k).alias(f"{k.lower()}_exits") for k in ("TARGET", "STOP", "SESSION_END")]
    return trades.groupBy(*keys).agg(*core_metrics(), *exits)


def value_range(value: str) -> Column:
    """Range number of a value, monotone and fine (0.07 %) at every magnitude: the chunks of value-ordered work."""
    v = F.col(value).cast("double")
    return F.floor(F.signum(v) * F.log2(1 + F.abs(v) * 1e6) * 1024)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles from counts per distinct value.

    Counting per value combines before the shuffle; ranks come from running counts carried across value
    ranges, so neither a hot key nor many distinct values meet in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_range", value_range(value))
    ranked = running(counts, keys, [["_range"]], [value], {"_before": ("sum", F.col("_n"))}, exclusive=True)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = ranked.join(totals, list(keys))
    picks = []
    for name, q in quantiles.items():
        target = (F.col("_total") - 1) * F.lit(q)
        low, high = F.floor(target), F.ceil(target)
        inside = lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_n"))
        picks += [F.max(F.when(inside(low), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when(inside(high), F.col(value))).alias(f"_hi_{name}"),
                  F.max(target - low).alias(f"_f_{name}")]
    got = ranked.groupBy(*keys).agg(*picks)
    return got.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in quantiles])


def max_drawdown(df: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[str]], order: Sequence[str],
                 value: str = "result_r") -> DataFrame:
    """Largest fall of the running sum from its peak (starting at 0).

    Each chunk is folded to (sum, highest and lowest running sum, worst fall); chunk rows fold the same
    way into coarser ones, so the longest window is over chunks, never over all trades.
    """
    units = df.select(*keys, *[c for level in levels for c in level], *order, F.col(value).alias("_s"),
                      F.col(value).alias("_peak"), F.col(value).alias("_low"), F.lit(0.0).alias("_dd"))
    depth = len(levels)
    while True:
        part = [*keys, *[c for level in levels[:depth] for c in level]]
        window = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        units = units.withColumn("_off", F.coalesce(F.sum("_s").over(window), F.lit(0.0)))
        high = F.max(F.col("_off") + F.col("_peak")).over(window)
        units = units.withColumn("_top", F.greatest(high, F.lit(0.0)) if depth == 0 else high)
        fall = F.greatest(F.col("_dd"), F.col("_top") - (F.col("_off") + F.col("_low")))
        units = units.groupBy(*part).agg(
            F.sum("_s").alias("_s"), F.max(F.col("_off") + F.col("_peak")).alias("_peak"),
            F.min(F.col("_off") + F.col("_low")).alias("_low"), F.max(fall).alias("_dd"))
        if depth == 0:
            return units.select(*keys, r6(F.col("_dd")).alias("max_drawdown_r"))
        depth -= 1
        order = levels[depth]


def max_losing_streak(df: DataFrame, keys: Sequence[str], levels, order, value: str = "result_r") -> DataFrame:
    """Longest run of losses: losses that share the count of non-losses before them form one run."""
    runs = running(df.select(*keys, *[c for level in levels for c in level], *order, value), keys, levels, order,
                   {"_other": ("count", F.when(F.col(value) >= 0, 1).otherwise(0))})
    sizes = runs.filter(F.col(value) < 0).groupBy(*keys, "_other").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*keys).agg(F.max("_n").alias("max_losing_streak"))


def order_risk(df: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[str]], order: Sequence[str], value: str = "result_r") -> DataFrame:
    """``max_drawdown_r`` and ``max_losing_streak`` (0 without a loss) from one pass over the trades.

    A chunk is folded to (sum, highest and lowest running sum, worst fall) and (rows, losses at its start, losses at its
    end, longest run of losses); chunk rows fold the same way into coarser ones.
    """
    lost = F.when(F.col(value) < 0, 1).otherwise(0).cast("bigint")
    v = F.col(value)
    units = df.select(*keys, *[c for level in levels for c in level], *order, v.alias("_s"), v.alias("_peak"), v.alias("_low"), F.lit(0.0).alias("_dd"),
                      F.lit(1).cast("bigint").alias("_n"), lost.alias("_pre"), lost.alias("_suf"), lost.alias("_run"))
    for depth in range(len(levels), -1, -1):
        part = [*keys, *[c for level in levels[:depth] for c in level]]
        window = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        units = units.withColumns({"_off": F.coalesce(F.sum("_s").over(window), F.lit(0.0)), "_start": F.coalesce(F.sum("_n").over(window), F.lit(0))})
        high = F.max(F.col("_off") + F.col("_peak")).over(window)
        # Where the last row that was no loss ended, before this unit and in it.
        edge = F.when(F.col("_suf") < F.col("_n"), F.col("_start") + F.col("_n") - F.col("_suf"))
        units = units.withColumns({"_top": high if depth else F.greatest(high, F.lit(0.0)), "_own": edge})
        units = units.withColumn("_edge", F.max("_own").over(window))
        entering = F.col("_start") - F.coalesce("_edge", F.lit(0))
        fall = F.greatest(F.col("_dd"), F.col("_top") - (F.col("_off") + F.col("_low")))
        units = units.groupBy(*part).agg(
            F.sum("_s").alias("_s"), F.max(F.col("_off") + F.col("_peak")).alias("_peak"), F.min(F.col("_off") + F.col("_low")).alias("_low"), F.max(fall).alias("_dd"),
            F.sum("_n").alias("_n"), F.max(F.when(F.col("_edge").isNull(), F.col("_start") + F.col("_pre"))).alias("_pre"),
            (F.sum("_n") - F.coalesce(F.max("_own"), F.lit(0))).alias("_suf"), F.max(F.greatest(F.col("_run"), entering + F.col("_pre"))).alias("_run"))
        order = levels[depth - 1] if depth else order
    return units.select(*keys, r6(F.col("_dd")).alias("max_drawdown_r"), F.col("_run").alias("max_losing_streak"))


def trade_summary(trades: DataFrame, keys: Sequence[str], levels, order) -> DataFrame:
    """Variant metrics with median, long / short split, drawdown, losing streak and holding time."""
    long, short = F.col("direction") == "LONG", F.col("direction") == "SHORT"
    base = trades.groupBy(*keys).agg(
        *core_metrics(), F.count_if(F.col("exit_reason") == "SESSION_END").alias("session_end_exits"),
        r6(F.avg("holding_minutes")).alias("average_holding_minutes"),
        F.count_if(long).alias("long_trades"), r6(F.avg(F.when(long, result()))).alias("long_average_r"),
        F.count_if(short).alias("short_trades"), r6(F.avg(F.when(short, result()))).alias("short_average_r"))
    median = exact_percentiles(trades, keys, "result_r", {"median_r": 0.5}).withColumn("median_r", r6(F.col("median_r")))
    return base.join(median, list(keys), "left").join(order_risk(trades, keys, levels, order), list(keys), "left")


def month_of(day: str = "session_date") -> Column:
    return F.date_format(day, "yyyy-MM")


def monthly_summary(trades: DataFrame, keys: Sequence[str], day: str = "session_date") -> DataFrame:
    return trades.groupBy(*keys, month_of(day).alias("month")).agg(
        F.count(result()).alias("trades"), r6(F.sum(result())).alias("total_r"), r6(F.avg(result())).alias("average_r"), r6(share(result() > 0)).alias("win_rate"))


def monthly_dense(trades: DataFrame, keys: Sequence[str], day: str = "session_date") -> DataFrame:
    """Monthly totals with zero rows for months without a trade between a key's first and last month."""
    monthly = monthly_summary(trades, keys, day)
    spans = trades.groupBy(*keys).agg(F.trunc(F.min(day), "month").alias("_a"), F.trunc(F.max(day), "month").alias("_b"))
    months = spans.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias("_m"))
    months = months.select(*keys, F.date_format("_m", "yyyy-MM").alias("month"))
    return months.join(monthly, [*keys, "month"], "left").select(
        *keys, "month", F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("total_r", F.lit(0.0)).alias("total_r"), "average_r")


def month_statistics(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.col("total_r")
    return monthly.groupBy(*keys).agg(
        F.count_if(total > 0).alias("positive_months"), F.count_if(total < 0).alias("negative_months"),
        F.count_if(total == 0).alias("flat_months"), F.max(total).alias("best_month_r"), F.min(total).alias("worst_month_r"),
        r6(F.avg(total)).alias("mean_month_r"), r6(F.percentile(total, F.lit(0.5))).alias("median_month_r"))


def r_distribution(trades: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    near = lambda k: F.count_if(F.abs(result() - k) <= tolerance)
    base = trades.groupBy(*keys).agg(
        F.count(result()).alias("n"), r6(F.avg(result())).alias("mean_r"), r6(F.stddev_samp(result())).alias("std_r"), F.min(result()).alias("min_r"),
        F.max(result()).alias("max_r"), near(-1).alias("near_minus_one"), near(2).alias("near_plus_two"), near(0).alias("near_zero"))
    points = exact_percentiles(trades, keys, "result_r", {"p10": .1, "p25": .25, "p50": .5, "p75": .75, "p90": .9})
    return base.join(points.select(*keys, *[r6(F.col(p)).alias(p) for p in ("p10", "p25", "p50", "p75", "p90")]), list(keys))


def ordinal_bins(df: DataFrame, keys: Sequence[str], order: Sequence[str], levels, bins: int, name: str = "bin") -> DataFrame:
    """Equal-count bins by position (not ntile): greatest(1, ceil(bins * i / (n - 1)))."""
    ranked = position(df, keys, levels, order, "_i")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bin_of = F.when(F.col("_n") == 1, 1).otherwise(
        F.greatest(F.lit(1), F.floor((bins * F.col("_i") + F.col("_n") - 2) / (F.col("_n") - 1))))
    return ranked.join(totals, list(keys)).withColumn(name, bin_of.cast("bigint")).drop("_i", "_n")


def rolling_mean(df: DataFrame, keys: Sequence[str], levels, order, size: int, value: str = "result_r") -> DataFrame:
    """Mean of the last ``size`` rows, null until there are enough; blocks with a halo, never a whole series."""
    ranked = position(df, keys, levels, order, "pos")
    blocks = with_halo(ranked, "pos", size - 1, 0)
    window = halo_window(keys, "pos").rowsBetween(-(size - 1), 0)
    out = blocks.withColumns({"_n": F.count(value).over(window), "_avg": F.avg(value).over(window)})
    return home_rows(out).withColumn(f"rolling_{size}", F.when(F.col("_n") == size, r6(F.col("_avg")))).drop("_n", "_avg")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties averaged, from counts per distinct value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", value_range(value))
    ranked = running(counts, keys, [["_range"]], [value], {"_before": ("sum", F.col("_n"))}, exclusive=True)
    ranks = ranked.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])


def pearson(x: str, y: str) -> Column:
    """Pearson correlation, null where a side is constant: ``corr`` itself divides by zero there, whatever guards its result."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / sx / sy)


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation per key."""
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(clean, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r6(pearson(x, y)).alias("pearson"), r6(pearson("_rx", "_ry")).alias("spearman"))


def equity_curves(trades: DataFrame, key: str, day: str = "session_date") -> DataFrame:
    """Equity of every key on the union of all dates, carried forward; one row per key and date, one window per key."""
    # One column per key that there is, and back to rows: dates on which a key has no trade come out as nulls.
    daily = trades.groupBy(day).pivot(key).agg(F.sum("result_r")).unpivot([day], None, key, "_sum")
    order = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(day, key, r6(F.sum(F.coalesce("_sum", F.lit(0.0))).over(order)).alias("equity"))


def sweep_metrics(audit: DataFrame, trades: DataFrame, cell: Sequence[str], levels: Sequence[Sequence[str]], order: Sequence[str], window: int = 20) -> DataFrame:
    """One row per cell that traded: its trades, its candidates by fate, order risk, worst rolling mean and months."""
    counts = audit.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if("is_ambiguous").alias("ambiguous"),
        F.count_if(F.col("rejection_reason") == "SESSION_TRADE_LIMIT").alias("limited"))
    rolled = rolling_mean(trades, cell, levels, order, window).groupBy(*cell).agg(F.min(f"rolling_{window}").alias(f"rolling_{window}_min"))
    months = monthly_summary(trades, cell, "trading_date").groupBy(*cell).agg(F.count_if(F.col("total_r") > 0).alias("positive_months"), F.count(F.lit(1)).alias("months"))
    out = trades.groupBy(*cell).agg(*core_metrics())
    for other in (counts, order_risk(trades, cell, levels, order), rolled, months):
        out = out.join(other, list(cell), "left")
    return out


def grid_neighbours(cells: DataFrame, group: Sequence[str], axes: Sequence[str], value: str) -> DataFrame:
    """Mean and positive share of the adjacent cells on each axis (others equal); one row per cell."""
    ranked = cells
    for axis in axes:
        ranked = ranked.withColumn(f"_{axis}", F.dense_rank().over(Window.partitionBy(*group).orderBy(axis)))
    shifts = F.array(*[F.struct(*[F.lit(d if a == axis else 0).alias(a) for a in axes]) for axis in axes for d in (-1, 1)])
    probes = ranked.withColumn("_d", F.explode(shifts)).select(
        *group, *axes, F.col(value), *[(F.col(f"_{a}") + F.col(f"_d.{a}")).alias(f"_{a}") for a in axes])
    other = ranked.select(*group, *[f"_{a}" for a in axes], F.col(value).alias("_other"))
    met = probes.join(other, [*group, *[f"_{a}" for a in axes]], "left")
    return met.groupBy(*group, *axes, value).agg(
        F.count("_other").alias("neighbour_count"), F.round(F.avg("_other") + 1e-10, 4).alias("neighbour_mean"),
        r6(F.avg(F.when(F.col("_other") > 0, 1.0).when(F.col("_other").isNotNull(), 0.0))).alias("neighbour_positive_share")
    ).withColumn("minus_neighbour_mean", F.round(F.col(value) - F.col("neighbour_mean"), 4))


def scenario_robustness(metrics: DataFrame, keys: Sequence[str], scenarios: int) -> DataFrame:
    """Range of the mean result over the scenarios of a cell, and whether each of them is there, gains and has a profit factor over 1."""
    avg, factor = F.col("average_r"), F.coalesce("profit_factor", F.lit(9.99))
    return metrics.groupBy(*keys).agg(
        r6(F.max(avg) - F.min(avg)).alias("scenario_range"),
        ((F.count(F.lit(1)) == scenarios) & (F.min(avg) > 0) & (F.min(factor) > 1)).alias("robust"))


def neighbour_support(cells: DataFrame, group: Sequence[str], axes: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """How far adjacent cells support a robust cell: on both axes (STRONG), on one (MODERATE), or not (WEAK).

    A neighbour supports a cell if it is robust itself and its ``value`` lies within the tolerance.
    """
    ranked = cells.withColumns({f"_{a}": F.dense_rank().over(Window.partitionBy(*group).orderBy(a)) for a in axes})
    shifts = F.array(*[F.struct(F.lit(axis).alias("on"), *[F.lit(d if a == axis else 0).alias(a) for a in axes]) for axis in axes for d in (-1, 1)])
    probes = ranked.withColumn("_d", F.explode(shifts)).withColumns({f"_{a}": F.col(f"_{a}") + F.col(f"_d.{a}") for a in axes})
    other = ranked.select(*group, *[f"_{a}" for a in axes], F.col("robust").alias("_robust"), F.col(value).alias("_value"))
    met = probes.join(other, [*group, *[f"_{a}" for a in axes]], "left")
    near = F.coalesce(F.col("_robust") & (F.round(F.abs(F.col("_value") - F.col(value)), 6) <= tolerance), F.lit(False))
    out = met.groupBy(*group, *axes, "robust").agg(*[F.max(near & (F.col("_d.on") == a)).alias(f"_{a}") for a in axes])
    both, one = F.lit(True), F.lit(False)
    for a in axes:
        both, one = both & F.col(f"_{a}"), one | F.col(f"_{a}")
    return out.select(*group, *axes, F.when(F.col("robust") & both, "STRONG").when(F.col("robust") & one, "MODERATE").otherwise("WEAK").alias("neighbour_support"))


def neighbourhood_class(share_positive: Column, mean: Column, flip_rate: Column, median_delta: Column) -> Column:
    """Whether a cell failed alone, with its neighbours, or with the whole surface."""
    # Fixed values of the classes.
    broad = (flip_rate >= 0.6) & (median_delta < 0)
    return (F.when(F.coalesce(broad, F.lit(False)) & (share_positive <= 0.5), "BROAD_SURFACE_DETERIORATION")
            .when((share_positive > 0.5) & (mean > 0), "LOCAL_FAILURE").otherwise("NEIGHBORHOOD_DETERIORATION"))


def state_summary(events: DataFrame, state: str, scopes: Sequence[str], totals: Mapping[str, str], horizon: str = "horizon") -> DataFrame:
    """Outcomes per state under every combination of scopes or their total label.

    Each row counts once for its own scope value and once for the total of each scope; the share is taken
    against all states of the slice.
    """
    rows = events.withColumns({"mfe": F.when(F.col("is_complete"), F.col("mfe")), "mae": F.when(F.col("is_complete"), F.col("mae"))})
    for scope in scopes:
        rows = rows.withColumn(scope, F.explode(F.array(F.col(scope), F.lit(totals[scope]))))
    keys = [state, horizon, *scopes]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_complete").alias("complete_n"),
                                  r6(F.avg("mfe")).alias("mean_mfe"), r6(F.avg("mae")).alias("mean_mae"))
    for name in ("mfe", "mae"):
        points = exact_percentiles(rows, keys, name, {"median": 0.5, "p25": 0.25, "p75": 0.75})
        out = out.join(points.select(*keys, *[r6(F.col(q)).alias(f"{q}_{name}") for q in ("median", "p25", "p75")]), keys, "left")
    whole = Window.partitionBy(horizon, *scopes)
    return out.withColumn("share", r6(F.col("n") / F.sum("n").over(whole)))


def feature_distributions(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Count, missing, mean, spread and quartiles of each feature."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))
    v, part = F.col("value"), [*keys, "feature"]
    base = long.groupBy(*part).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), r6(F.avg(v)).alias("mean"),
                                   r6(F.stddev_samp(v)).alias("std"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    points = exact_percentiles(long, part, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return base.join(points.select(*part, *[r6(F.col(q)).alias(q) for q in ("p25", "median", "p75")]), part, "left")


def feature_correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation with paired counts, NaN for a constant feature; pairs are built inside each row."""
    pairs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
             for i, a in enumerate(features) for b in features[i + 1:]]
    long = df.select(F.inline(F.array(*pairs))).filter("x is not null and y is not null")
    return long.groupBy("feature_a", "feature_b").agg(F.count(F.lit(1)).alias("n"), F.coalesce(r6(pearson("x", "y")), F.lit(float("nan"))).alias("correlation"))


def quantile_edges(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Full-sample quantile edges, equal neighbours collapsed; intervals closed left, the last closed."""
    marks = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = exact_percentiles(df, keys, value, marks).select(*keys, F.array_distinct(F.array(*marks)).alias("_e"))
    size = F.size("_e")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.struct(
        i.alias("interval_no"), F.element_at("_e", i).alias("lower"), F.coalesce(F.get("_e", i), F.element_at("_e", i)).alias("upper"),
        (i >= size - 1).alias("is_last")))
    return edges.select(*keys, F.inline(pairs))


def assign_interval(df: DataFrame, edges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number of the interval a value falls into; the edges are one row per key of the analysis."""
    packed = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("interval_no", "lower", "upper", "is_last"))).alias("_edges"))
    joined = df.join(packed, list(keys), "left")
    v = F.col(value)
    hit = F.filter("_edges", lambda e: (v >= e["lower"]) & ((v < e["upper"]) | (e["is_last"] & (v <= e["upper"]))))
    return joined.withColumn("interval_no", F.get(hit, F.lit(0))["interval_no"]).drop("_edges")


def islands(spans: DataFrame, keys: Sequence[str], start: str, end: str, chunk: str) -> DataFrame:
    """Number of disjoint groups of overlapping spans per key; the running end is carried across chunks."""
    seen = running(spans, keys, [[chunk]], [start, end, *[c for c in spans.columns if c not in (*keys, start, end, chunk)]],
                   {"_reach": ("max", F.col(end))}, exclusive=True)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    return seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("spans"), F.count_if(opens).alias("groups"))


def compare_periods(cells: DataFrame, keys: Sequence[str], metrics: Sequence[str], first: str, second: str) -> DataFrame:
    """Two periods side by side with deltas and the sign class of the mean result."""
    side = lambda p, n: cells.filter(F.col("period") == p).select(*keys, *[F.col(m).alias(f"{n}_{m}") for m in metrics])
    out = side(first, "dev").join(side(second, "val"), list(keys))
    d, v = F.col("dev_average_r"), F.col("val_average_r")
    sign = (F.when((d > 0) & (v > 0), "POSITIVE_DEV_POSITIVE_VAL").when(d > 0, "POSITIVE_DEV_NEGATIVE_VAL")
            .when(v > 0, "NEGATIVE_DEV_POSITIVE_VAL").otherwise("NEGATIVE_DEV_NEGATIVE_VAL"))
    return out.withColumns({
        "average_r_delta": r6(v - d), "relative_average_r_change": r6(F.when(F.abs(d) > 1e-12, (v - d) / F.abs(d))),
        "profit_factor_delta": r6(F.col("val_profit_factor") - F.col("dev_profit_factor")), "sign_persistence": sign})


def edge_class(avg: Column, pf: Column, entry_avg: Column, entry_pf: Column, margin: float = 0.02, pf_margin: float = 0.05) -> Column:
    pf, entry_pf = F.coalesce(pf, F.lit(9.99)), F.coalesce(entry_pf, F.lit(9.99))
    thin = (F.least(avg, entry_avg) < margin) | (F.least(pf, entry_pf) - 1 < pf_margin)
    return F.when((avg <= 0) | (pf <= 1), "FAILED").when((entry_avg <= 0) | (entry_pf <= 1), "MIXED").when(thin, "MIXED").otherwise("STRONG")


def degradation_class(validation: Column, development: Column) -> Column:
    """What validation keeps of the development mean; any gain is without bound against a mean of zero."""
    kept = F.when(development == 0, F.lit(float("inf"))).otherwise(F.try_divide(validation, development))
    return (F.when(validation <= 0, "SIGN_REVERSAL").when(kept >= 0.75 - 1e-12, "LOW").when(kept >= 0.5 - 1e-12, "MODERATE").otherwise("HIGH"))


def overall_class(edge: Column, degradation: Column, temporal: Column, observability: Column) -> Column:
    good = (edge == "STRONG") & degradation.isin("LOW", "MODERATE") & (temporal == "BROAD") & (observability == "STRONG")
    return F.when((edge == "FAILED") | (observability == "FAILED"), "REJECT").when(good, "PASS").otherwise("REVISE")


def temporal_consistency(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of positive months, concentration of gains, totals of both halves and a label."""
    order = Window.partitionBy(*keys).orderBy("month")
    rows = monthly.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    total, first = F.col("total_r"), F.col("_k") * 2 <= F.col("_n")
    gain = F.when(total > 0, total)
    out = rows.groupBy(*keys).agg(
        r6(share(total > 0) * 100).alias("positive_month_percentage"), r6(F.max(gain) / F.sum(gain)).alias("concentration"),
        r6(F.sum(F.when(first, total).otherwise(0.0))).alias("first_half_r"), r6(F.sum(F.when(~first, total).otherwise(0.0))).alias("second_half_r"))
    a, b = F.col("first_half_r"), F.col("second_half_r")
    unstable = (a + b <= 0) | ((a > 0) & (b < 0) & (F.abs(b) >= 0.5 * a))
    broad = (F.col("positive_month_percentage") >= 50) & (F.col("concentration") <= 0.6)
    return out.withColumn("label", F.when(unstable, "UNSTABLE").when(broad, "BROAD").otherwise("CONCENTRATED"))


def width_shape(cells: DataFrame, keys: Sequence[str], bins: int = 5, stable: float = 0.25, share_limit: float = 0.8) -> DataFrame:
    """Shape of the mean result over five width bins: stable, U, hump or mixed; concentrated or not."""
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "average_r", "total_r"))).alias("_c"))
    packed = packed.filter(F.size("_c") == bins)
    avg, tot = F.col("_c.average_r"), F.col("_c.total_r")
    at = lambda i: F.element_at(avg, i)
    gains = F.sort_array(F.filter(tot, lambda x: x > 0), asc=False)
    added = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    top2 = F.when(F.size(gains) > 0, added(F.slice(gains, 1, 2)) / added(gains))
    spread = F.array_max(avg) - F.array_min(avg)
    positive = F.size(F.filter(avg, lambda x: x > 0))
    ends, middle = (at(1) + at(5)) / 2, (at(2) + at(3) + at(4)) / 3
    best, worst = F.array_position(avg, F.array_max(avg)), F.array_position(avg, F.array_min(avg))
    shape = (F.when((spread <= stable) & (positive >= 4), "RELATIVELY_STABLE").when(ends > middle + 0.10, "U_SHAPED")
             .when((middle > ends + 0.10) & best.isin(2, 3, 4), "HUMP_SHAPED").otherwise("MIXED_NONLINEAR"))
    return packed.select(*keys, F.concat(shape, F.when(top2 >= share_limit, "_CONCENTRATED").otherwise("")).alias("dependency"),
                         r6(spread).alias("average_r_range"), positive.alias("positive_bins"), best.alias("best_bin"),
                         worst.alias("worst_bin"), r6(top2).alias("top_two_share"))
