"""Small random bar series with many ties, gaps and a contract change."""
import datetime as dt
import random

EPOCH = dt.datetime(2024, 1, 1)
BAR = ("instrument_id string, contract string, trading_date date, session_no bigint, segment_id bigint, slot bigint, bar_start timestamp, "
       "bar_end timestamp, open bigint, high bigint, low bigint, close bigint, volume bigint")


def rows(seed, count=160, names=("AA", "BB"), gap=0.03, step=3):
    rnd = random.Random(seed)
    out = []
    for name in names:
        price, segment, previous = 1000, None, None
        for slot in range(count):
            if rnd.random() < gap:
                previous = None
                continue
            contract = "C1" if slot < count * 2 // 3 else "C2"
            if previous is None or previous != contract:
                segment = slot
            previous = contract
            o = price + rnd.randint(-1, 1)
            c = o + rnd.randint(-step, step)
            h, lo = max(o, c) + rnd.randint(0, 2), min(o, c) - rnd.randint(0, 2)
            price = c
            start = EPOCH + dt.timedelta(minutes=slot)
            out.append((name, contract, (EPOCH + dt.timedelta(days=slot // 40)).date(), slot // 40, segment, slot, start,
                        start + dt.timedelta(minutes=1), o, h, lo, c, 1))
    return out


def segmented(spark, seed, **kw):
    return spark.createDataFrame(rows(seed, **kw), BAR)


def segments_of(data):
    """Plain lists of bars per (instrument, segment)."""
    groups = {}
    for r in data:
        groups.setdefault((r[0], r[4]), []).append(dict(slot=r[5], o=r[8], h=r[9], l=r[10], c=r[11]))
    return groups


def episode_frame(spark, data):
    """Episodes of the fixture: contract change resets at the next bar, a gap at the next slot, the last one never."""
    groups, out = segments_of(data), []
    last = max(r[5] for r in data)
    for (name, seg), bars in groups.items():
        end = bars[-1]["slot"]
        after = any(n == name and b[0]["slot"] == end + 1 for (n, _), b in groups.items())
        reason = "CONTRACT_CHANGE" if after else "DATA_GAP" if end < last else None
        at = None if reason is None else EPOCH + dt.timedelta(minutes=end + 2)
        out.append((name, seg, end, at, reason))
    return spark.createDataFrame(out, "instrument_id string, segment_id bigint, last_slot bigint, reset_at timestamp, reset_reason string")


def plain_swings(bars, left, right):
    """Direct plateau scan of one segment: (orientation, price, first, last) by bar position."""
    found = []
    for side in ("UPPER", "LOWER"):
        v = [b["h"] if side == "UPPER" else -b["l"] for b in bars]
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if i >= left and j + right < len(v) and max(v[i - left:i] or [-10**9]) <= v[i] and max(v[j + 1:j + right + 1] or [-10**9]) <= v[i]:
                found.append((side, v[i] if side == "UPPER" else -v[i], i, j))
            i = j + 1
    return found
