"""Suites with planted faults: clean on what was given, and every counter finds its faults."""
from pyspark.sql import functions as F

from sessionloom.catalog import load
from sessionloom.operators import quality as Q

FOLDER = "/root/testdata/sf0.01"


def test_swing_suite(spark):
    rows = load()[0]["L01_swing_suite"](spark, FOLDER).collect()
    counters = [c for c in rows[0].asDict() if c not in ("input", "orientation", "rows")]
    assert len(counters) == 14 and {(r.input, r.orientation) for r in rows} == {(i, o) for i in ("GIVEN", "TAMPERED") for o in ("UPPER", "LOWER")}
    assert all(r[c] == 0 for r in rows if r.input == "GIVEN" for c in counters)
    # Only bars could be changed so that a plateau has an equal neighbour.
    assert {c for c in counters if not sum(r[c] for r in rows if r.input == "TAMPERED")} <= {"plateau_not_maximal"}


def test_a_shortened_plateau_is_not_maximal(spark):
    bars = [("x", 0, "C1", k, h, h - 5) for k, h in enumerate([10, 11, 15, 15, 15, 12, 11, 10])]
    seg = spark.createDataFrame(bars, "instrument_id string, segment_id long, contract string, slot long, high long, low long").withColumn("bar_end", F.timestamp_seconds(F.col("slot") * 3600))
    swing = spark.createDataFrame([("s", "x", 0, "C1", "UPPER", 15, 2, 4), ("t", "x", 0, "C1", "UPPER", 15, 3, 4)], "swing_id string, instrument_id string, segment_id long, contract string, orientation string, price_ticks long, first_slot long, last_slot long")
    at = lambda slot: F.timestamp_seconds(slot * 3600)
    swing = swing.withColumns({"source_at": at(F.col("first_slot")), "source_end_at": at(F.col("last_slot")), "available_at": at(F.col("last_slot") + 2)})
    (r,) = Q.swing_violations(swing, seg, 2, 2, F.col("swing_id")).collect()
    assert r.rows == 2 and r.plateau_not_maximal == 1 and all(v == 0 for c, v in r.asDict().items() if c not in ("orientation", "rows", "plateau_not_maximal"))
