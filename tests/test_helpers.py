"""Ordered helpers, search and range join against direct computation."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import ordered, search
from sessionloom.functions.rangejoin import points_in_intervals


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    rows = [("hot", i, rnd.randint(-9, 9)) for i in range(3000)] + [(f"k{i % 50}", i, rnd.randint(-9, 9)) for i in range(1500)]
    return spark.createDataFrame(rows, "key string, pos bigint, value bigint").withColumn("chunk", F.floor(F.col("pos") / 100)).withColumn("day", F.floor(F.col("pos") / 1000)).cache()


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_one_window(series, exclusive):
    got = ordered.running(series, ["key"], [["day"], ["chunk"]], ["pos"], {
        "total": ("sum", F.col("value")), "top": ("max", F.col("value")), "seen": ("count", F.when(F.col("value") > 0, 1).otherwise(0)),
        "latest": ("last", F.when(F.col("value") > 5, F.col("pos")))}, exclusive=exclusive)
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = series.select("key", "pos", F.coalesce(F.sum("value").over(w), F.lit(0)).alias("total"), F.max("value").over(w).alias("top"),
                         F.coalesce(F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).over(w), F.lit(0)).alias("seen"),
                         F.last(F.when(F.col("value") > 5, F.col("pos")), True).over(w).alias("latest"))
    columns = ["key", "pos", "total", "top", "seen", "latest"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)


def test_halo_frames_equal_one_window(series):
    blocks = ordered.with_halo(series, "pos", 4, 3, size=64)
    w = ordered.halo_window(["key"], "pos")
    got = ordered.home_rows(blocks.withColumn("s", F.sum("value").over(w.rangeBetween(-4, 3)))).select("key", "pos", "s")
    plain = Window.partitionBy("key").orderBy("pos").rangeBetween(-4, 3)
    want = series.select("key", "pos", F.sum("value").over(plain).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("fan", [4, 512])
def test_first_beyond_is_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(search, "FAN", fan)
    rnd = random.Random(fan)
    data = {"hot": [rnd.randint(0, 60) for _ in range(700)], "cold": [rnd.randint(0, 60) for _ in range(90)]}
    rows = [(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)]
    levels = [(n, k, rnd.randint(0, len(data[k]) + 3), rnd.randint(0, 62), rnd.choice(["UPPER", "LOWER"]), rnd.choice([None, rnd.randint(0, 700)]))
              for n, k in enumerate(rnd.choices(list(data), weights=[5, 1], k=800))]
    got = search.first_beyond(
        spark.createDataFrame(levels, "id int, key string, start bigint, level bigint, side string, stop bigint"),
        spark.createDataFrame(rows, "key string, pos bigint, value bigint"), ["key"], ordinal="pos", above="value", below="value",
        start="start", threshold="level", side="side", last="stop").collect()
    for r in got:
        hits = [i for i, v in enumerate(data[r.key]) if i >= r.start and (v > r.level if r.side == "UPPER" else v < r.level)]
        want = hits[0] if hits and (r.stop is None or hits[0] <= r.stop) else None
        assert r.hit == want, r
    assert len(got) == len(levels)


def test_tree_of_one_long_segment(spark, monkeypatch):
    """Ten million slots of one segment: three levels, no array beyond the fan-out, one build for several searches."""
    import numpy as np

    n, built = 10_000_000, []
    real = search.ExtremesTree.__init__
    monkeypatch.setattr(search.ExtremesTree, "__init__", lambda self, *a, **b: built.append(1) or real(self, *a, **b))
    wave = lambda i: (i * 7919) % 10_007 + i // 100_000  # noqa: E731 - rises slowly, so that some hits are far away
    bars = spark.range(n).select(F.lit("x").alias("key"), F.col("id").alias("slot"), F.expr("(id * 7919) % 10007 + id div 100000").alias("high"),
                                 F.expr("(id * 7919) % 10007 + id div 100000 - 3").alias("low"))
    rnd = random.Random(9)
    wanted = [(i, "x", rnd.randrange(n), rnd.choice([10_010, 10_050, 10_104, 10_105, 10_200, 10, 40]), rnd.choice(["UPPER", "LOWER"])) for i in range(300)]
    levels = spark.createDataFrame([(*w[:3], w[3] if w[4] == "UPPER" else w[3] % 100 - 3, w[4]) for w in wanted], "id int, key string, start bigint, level bigint, side string")
    search_for = dict(ordinal="slot", above="high", below="low", start="start", threshold="level", side="side")
    got = search.first_beyond(levels, bars, ["key"], **search_for).collect()
    again = search.first_beyond(levels, bars, ["key"], **search_for, last="start").collect()
    high = wave(np.arange(n))
    far = 0
    for r in got:
        hits = (high[r.start :] > r.level) if r.side == "UPPER" else (high[r.start :] - 3 < r.level)
        k = int(hits.argmax())
        assert r.hit == (r.start + k if hits[k] else None), r
        far += k > search.FAN**2
    assert far and {r.id: r.hit for r in again} == {r.id: (r.hit if r.hit == r.start else None) for r in got}
    tree = search.tree_of(bars, ["key"], "slot", ["high"])
    assert len(built) == 1 and len(tree.levels) == 3
    assert all(t.agg(F.max(F.size("kid"))).first()[0] <= search.FAN for t in tree.levels)


def test_points_in_intervals(spark):
    rnd = random.Random(5)
    points = [("a" if rnd.random() < .7 else "b", i, rnd.randint(0, 400_000)) for i in range(200)]
    spans = [("a" if rnd.random() < .7 else "b", i, s := rnd.randint(0, 400_000), s + rnd.randint(1, 200_000)) for i in range(60)]
    p = spark.createDataFrame(points, "k string, p int, t bigint").withColumn("t", F.timestamp_seconds("t"))
    s = spark.createDataFrame(spans, "k string, s int, t0 bigint, t1 bigint").withColumns({"t0": F.timestamp_seconds("t0"), "t1": F.timestamp_seconds("t1")})
    got = sorted((r.p, r.s) for r in points_in_intervals(p, s, ["k"], "t", "t0", "t1").collect())
    want = sorted((b, d) for a, b, t in points for c, d, x, y in spans if a == c and x <= t < y)
    assert got == want
