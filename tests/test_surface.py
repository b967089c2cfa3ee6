"""Scenario robustness, support by neighbours and the class of a neighbourhood, by hand."""
from pyspark.sql import functions as F

from sessionloom.operators import stats as S


def test_robustness_needs_every_scenario(spark):
    rows = [("a", "X", 0.5, 2.0), ("a", "Y", 0.1, None), ("a", "Z", 0.3, 1.2), ("b", "X", 0.5, 2.0), ("b", "Y", 0.4, 2.0),
            ("c", "X", 0.5, 2.0), ("c", "Y", -0.1, 0.9), ("c", "Z", 0.2, 1.5), ("d", "X", 0.1, 1.0), ("d", "Y", 0.1, 1.1), ("d", "Z", 0.1, 1.1)]
    df = spark.createDataFrame(rows, "cell string, scenario string, average_r double, profit_factor double")
    out = {r["cell"]: (r["scenario_range"], r["robust"]) for r in S.scenario_robustness(df, ["cell"], 3).collect()}
    assert out == {"a": (0.4, True), "b": (0.1, False), "c": (0.6, False), "d": (0.0, False)}


def test_support_on_one_axis_and_on_both(spark):
    # A surface of three stops and two targets; the middle stop with the far target is not robust.
    value = {(20, 50): 0.30, (20, 100): 0.42, (40, 50): 0.20, (40, 100): 0.10, (60, 50): 0.90, (60, 100): None}
    rows = [("g", s, t, v, (s, t) != (40, 100)) for (s, t), v in value.items()] + [("h", 20, 50, 0.3, True)]
    df = spark.createDataFrame(rows, "g string, s int, t int, v double, robust boolean")
    out = {(r["g"], r["s"], r["t"]): r["neighbour_support"] for r in S.neighbour_support(df, ["g"], ["s", "t"], "v", 0.15).collect()}
    assert out == {("g", 20, 50): "STRONG", ("g", 20, 100): "MODERATE", ("g", 40, 50): "MODERATE", ("g", 40, 100): "WEAK",
                   ("g", 60, 50): "WEAK", ("g", 60, 100): "WEAK", ("h", 20, 50): "WEAK"}
    assert S.neighbour_support(df.limit(0), ["g"], ["s", "t"], "v", 0.15).count() == 0


def test_class_of_a_neighbourhood(spark):
    rows = [(1, 0.5, 0.1, 0.6, -0.1), (2, 0.6, 0.1, 0.6, -0.1), (3, 0.5, 0.1, 0.59, -0.1), (4, 0.5, 0.1, 0.6, 0.0), (5, 0.8, 0.0, 0.9, -1.0), (6, 0.5, 0.1, None, -0.1)]
    df = spark.createDataFrame(rows, "i int, share double, mean double, flips double, delta double")
    kind = S.neighbourhood_class(F.col("share"), F.col("mean"), F.col("flips"), F.col("delta"))
    assert [r["k"][:5] for r in df.orderBy("i").select(kind.alias("k")).collect()] == ["BROAD", "LOCAL", "NEIGH", "NEIGH", "NEIGH", "NEIGH"]
