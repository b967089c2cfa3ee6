"""Classes of relationships on planted patterns of the full period and its halves."""
from sessionloom.operators import states as ST

MORE, LESS, NONE = "MONOTONIC_MORE", "MONOTONIC_LESS", "NO_CLEAR_PATTERN"
CASES = {  # patterns of three horizons in FULL, FIRST, SECOND; correlations of the halves; fewest events; class
    "stable": ([MORE] * 3, [MORE] * 3, [MORE] * 3, 0.9, 0.8, 10, "CONSISTENT_CANDIDATE_STATE"),
    "few": ([MORE] * 3, [MORE] * 3, [MORE] * 3, 0.9, 0.8, 9, "POTENTIALLY_INFORMATIVE"),
    "contrary": ([MORE] * 3, [MORE] * 3, [LESS] * 3, 0.9, 0.1, 50, "WEAK_OR_UNSTABLE"),
    "opposite": ([MORE] * 3, [MORE] * 3, [NONE] * 3, 0.9, -0.5, 50, "WEAK_OR_UNSTABLE"),
    "one_half": ([MORE] * 3, [MORE, MORE, NONE], [NONE] * 3, 0.9, -0.2, 50, "POTENTIALLY_INFORMATIVE"),
    "single": ([MORE, MORE, NONE], [MORE] * 3, [NONE] * 3, 0.9, None, 50, "WEAK_OR_UNSTABLE"),
    "nothing": ([NONE] * 3, [MORE, NONE, NONE], [NONE] * 3, 0.9, -0.9, 50, "NO_CLEAR_RELATIONSHIP"),
    "same_halves": ([NONE] * 3, [MORE, MORE, NONE], [MORE, MORE, NONE], 0.9, 0.9, 50, "POTENTIALLY_INFORMATIVE"),
    "halves_differ": ([NONE] * 3, [MORE, MORE, NONE], [NONE] * 3, 0.2, 0.2, 50, "WEAK_OR_UNSTABLE"),
}


def test_half_stability(spark):
    rows, counts = [], []
    for key, (full, first, second, a, b, n, _) in CASES.items():
        for half, found, rho in (("FULL", full, 0.0), ("FIRST", first, a), ("SECOND", second, b)):
            rows += [(key, half, h, p, rho) for h, p in zip((1, 3, 6), found)]
            counts += [(key, half, 3, n), (key, half, 3, n + 5)]
    patterns = spark.createDataFrame(rows, "direction string, half string, horizon int, pattern string, rho double")
    counts = spark.createDataFrame(counts, "direction string, half string, horizon int, n long")
    got = {r.direction: r.classification for r in ST.half_stability(patterns, counts, ["direction"], 3).collect()}
    assert got == {key: case[-1] for key, case in CASES.items()}
