"""Quotients without a value: constant columns, a development mean of zero."""
import math

from sessionloom.operators import stats as S


def test_correlation_of_constant_columns(spark):
    rows = [(1, 5.0, 2.0), (1, 5.0, 3.0), (2, 1.0, 1.0), (2, 2.0, 5.0), (2, 4.0, 1.5), (3, 1.0, 1.0), (4, 1.0, 7.0), (4, 2.0, 7.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {r.k: (r.n, r.pearson, r.spearman) for r in S.correlations(df, ["k"], "x", "y").collect()}
    assert got == {1: (2, None, None), 2: (3, -0.075094, 0.5), 3: (1, None, None), 4: (2, None, None)}
    by = {(r.feature_a, r.feature_b): r.correlation for r in S.feature_correlations(df.filter("k = 4"), ["x", "y"]).collect()}
    assert math.isnan(by["x", "y"])


def test_degradation_against_a_mean_of_zero(spark):
    rows = [(0.1, 0.0, "LOW"), (-0.1, 0.0, "SIGN_REVERSAL"), (0.0, 0.0, "SIGN_REVERSAL"), (0.1, -0.2, "HIGH"), (0.1, 0.1, "LOW"), (0.06, 0.1, "MODERATE"), (0.04, 0.1, "HIGH")]
    df = spark.createDataFrame(rows, "v double, d double, want string")
    assert df.filter(S.degradation_class(df.v, df.d) != df.want).count() == 0
    assert df.filter(S.degradation_class(df.v, df.d).isNull()).count() == 0
