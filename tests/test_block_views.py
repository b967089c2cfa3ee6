"""Views of blocks at an instant against plain loops over their lives and the episodes."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sessionloom.catalog import patterns as PC
from sessionloom.catalog import zzstructure as C
from sessionloom.operators import state as K
from sessionloom.operators import structure as J
from sessionloom.session import prepare
from sessionloom.sources.market import Market


@pytest.fixture(scope="module")
def market(spark):
    return Market(prepare(spark), "/root/testdata/sf0.01")


def plain_stages(market):
    ends = {r.slot: r.bar_end for r in market.schedule().collect()}
    resets = {(r.instrument_id, r.segment_id): r for r in PC.episodes(market).collect()}
    out = {}
    for b in C.block_life(market).collect():
        reset = resets[b.instrument_id, b.segment_id]
        steps = [("ORDINARY", b.admission_slot, b.failed_slot, "FAILED"), ("FAILED_AWAITING", b.failed_slot, b.resolved_slot, "RESOLVED")]
        if b.outcome in ("BREAKER", "MITIGATION", "FAILED_FINAL"):
            steps.append((b.outcome, b.resolved_slot, None if b.outcome == "FAILED_FINAL" else b.retired_slot, "RETIRED"))
        for stage, start, end, why in steps:
            if start is None:
                continue
            if end is not None:
                last = (ends[end], why)
            elif stage != "FAILED_FINAL" and reset.reset_at is not None:
                last = (reset.reset_at, "TERMINATED" if reset.reset_reason == "DATA_GAP" else "PENDING")
            else:
                last = (None, None)
            out[b.swing_id, stage] = (ends[start], *last)
    return out


def test_block_stages_and_history(market):
    want = plain_stages(market)
    rows = C.block_stages(market)
    assert {(r.swing_id, r.stage): (r.started_at, r.ended_at, r.end_reason) for r in rows.collect()} == want
    assert len({k[1] for k in want}) >= 3 and rows.count() == len(want)
    cut = sorted(w[0] for w in want.values())[len(want) // 2]
    got = {(r.swing_id, r.stage): (r.ended_at, r.end_reason) for r in J.stages_known_at(rows, F.lit(cut)).collect()}
    assert got == {k: w[1:] if w[1] is not None and w[1] <= cut else (None, None) for k, w in want.items() if w[0] <= cut}


def test_pending_across_contracts(spark):
    day = lambda n: datetime(2024, 1, n)
    episodes = spark.createDataFrame(
        [("a", 0, 9, "H", day(2), "CONTRACT_CHANGE"), ("a", 10, 19, "M", day(3), "DATA_GAP"), ("a", 25, 30, "M", None, None), ("b", 0, 4, "H", day(5), "CONTRACT_CHANGE")],
        "instrument_id string, segment_id long, last_slot long, contract string, reset_at timestamp, reset_reason string")
    stopped = spark.createDataFrame([("a", 0, "z1"), ("a", 0, "z2"), ("a", 10, "z3"), ("a", 25, "z4"), ("b", 0, "z5")], "instrument_id string, segment_id long, zone_id string")
    got = {r.zone_id: (r.next_contract, r.since_at, r.comparison_scope) for r in K.pending_across_contracts(stopped, episodes).collect()}
    assert got == {"z1": ("M", day(2), "CROSS_CONTRACT_RAW"), "z2": ("M", day(2), "CROSS_CONTRACT_RAW"), "z5": (None, day(5), "CROSS_CONTRACT_RAW")}
