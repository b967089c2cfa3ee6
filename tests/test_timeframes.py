"""Zones of two timeframes: overlaps and their own life against plain loops over the stages and bars."""
from sessionloom.catalog import patterns as C
from sessionloom.session import prepare
from sessionloom.sources.market import Market


def test_overlaps_and_bprs_across_timeframes(spark):
    m = Market(prepare(spark), "/root/testdata/sf0.01")
    stages = C.mtf_stages(m).collect()
    want = {}
    for a in stages:
        for b in stages:
            if a.zone_id >= b.zone_id or (a.instrument_id, a.contract) != (b.instrument_id, b.contract):
                continue
            low, up = max(a.lower_ticks, b.lower_ticks), min(a.upper_ticks, b.upper_ticks)
            start = max(a.stage_start, b.stage_start)
            end = min((e for e in (a.stage_end, b.stage_end) if e is not None), default=None)
            if up - low < 1 or (end is not None and start >= end):
                continue
            mover = a if a.stage_start > b.stage_start else b if b.stage_start > a.stage_start else None
            same = a.current_direction == b.current_direction
            label = "FVG_OVERLAP" if same else "BPR" if a.timeframe == b.timeframe else "MTF_BPR"
            direction = a.current_direction if same else mover.current_direction if mover else "UNDEFINED"
            want[a.zone_id, a.stage, b.zone_id, b.stage] = (label, direction, None if same or not mover else mover.timeframe, low, up, start, end, mover)
    got = {(r.zone_a, r.stage_a, r.zone_b, r.stage_b): r for r in C.mtf_overlaps(m).collect()}
    assert got.keys() == want.keys() and {w[0] for w in want.values()} == {"FVG_OVERLAP", "BPR", "MTF_BPR"}
    for key, r in got.items():
        assert (r.label, r.direction, r.governing_timeframe, r.lower_ticks, r.upper_ticks, r.created_at, r.ended_at) == want[key][:7]
    bars = C.mtf_bars(m).collect()
    episodes = C.episodes(m).collect()
    bprs = C.mtf_bprs(m).collect()
    assert len(bprs) == sum(w[0] != "FVG_OVERLAP" for w in want.values())
    for r in bprs:
        label, direction, frame, low, up, start, _, mover = want[r.zone_a, r.stage_a, r.zone_b, r.stage_b]
        # Bars of the governing timeframe in the segment of the zone that moved, after the instant of the move.
        beyond = sorted(b.bar_end for b in bars if mover and (b.timeframe, b.instrument_id, b.segment_id) == (frame, r.instrument_id, mover.segment_id)
                        and b.bar_end > start and (b.close < low if direction == "BULLISH" else b.close > up))
        episode = next(e for e in episodes if e.instrument_id == r.instrument_id and e.first_bar_start < start <= e.last_bar_end)
        state = {"DATA_GAP": "TERMINATED", None: None}.get(episode.reset_reason, "PENDING")
        assert (r.exit_state, r.exit_at) == (("RETIRED", beyond[0]) if beyond else (state, episode.reset_at))
