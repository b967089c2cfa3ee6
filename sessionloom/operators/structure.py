"""Market structure, equal-level clusters, internal levels, ranges and order blocks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.graph import components, merge_history
from sessionloom.functions.ids import natural_id, utc_text
from sessionloom.functions.ordered import running
from sessionloom.functions.replay import replay
from sessionloom.functions.search import first_beyond
from sessionloom.operators.patterns import SEGMENT, _plateau_rows, bar_at
from sessionloom.session import written

BULL, BEAR = "BULLISH", "BEARISH"


# --- J02 -------------------------------------------------------------------------------------------------
class _Side:
    """One direction seen as rising: prices are mirrored for the falling one, so that every rule is written once."""

    def __init__(self, name: str, sign: int, origin: str, goal: str):
        self.name, self.sign, self.origin, self.goal = name, sign, origin, goal
        self.low, self.high = ("LOWER", "UPPER") if sign > 0 else ("UPPER", "LOWER")

    def above(self, a, b) -> bool:
        return self.sign * a.price > self.sign * b.price


class _Swing(NamedTuple):
    first: int
    last: int
    price: int
    id: str


class _Role(NamedTuple):
    """A swing in a role under a parent (the anchor or leg that it belongs to)."""

    swing: _Swing
    parent: tuple


SIDES = (_Side(BULL, 1, "BULL_ANCHOR", "BULL_TARGET"), _Side(BEAR, -1, "BEAR_ANCHOR", "BEAR_TARGET"))


class _Structure:
    """Direction and roles of one episode, from admissions and breaks of swings alone.

    Rules.  Without a direction, each side has an origin (its most extreme low-side swing since the last change of character)
    and a goal (the most extreme high-side swing after it).  Breaking a goal while exactly one side has an unbroken pullback
    above its origin, newer than the last change of character, establishes that direction; the pullback is protected.
    With a direction, breaking the target goes on (and protects a higher pullback), breaking the protected swing ends it.
    """

    def __init__(self, key):
        self.key, self.slot, self.rows = key, None, []
        self.live = {"UPPER": {}, "LOWER": {}}
        self.side, self.ended, self.since, self.turned = None, False, -1, None
        self.roles, self.protected, self.leg = {}, None, None

    def step(self, row):
        if row.slot == self.slot:
            self.rows.append(row)
            return []
        done = self.finish()
        self.slot, self.rows = row.slot, [row]
        return done

    def finish(self):
        if not self.rows:
            return []
        actions = {k: [r for r in self.rows if r.action == k] for k in ("ADMIT", "BREACH", "RESET")}
        return self.reset() if actions["RESET"] else self.advance(actions["ADMIT"], {r.swing_id for r in actions["BREACH"]})

    def state(self):
        return "RESET" if self.ended else self.side.name if self.side else "UNDEFINED"

    def line(self, kind, pre, post, swing=None, role=None):
        return (*self.key, self.slot, kind, pre, post, swing.id if swing else None, role)

    def reset(self):
        closed = [self.line("ROLE_END", None, "ENDED", self.roles[r].swing, r) for r in sorted(self.roles)]
        closed.append(self.line("RESET", self.state(), "RESET"))
        self.roles, self.side, self.ended = {}, None, True
        return closed

    def extreme(self, kind, first=None, last=None):
        """The outermost live swing of a kind in bounds; the earliest of equals."""
        sign = 1 if kind == "UPPER" else -1
        fits = [x for x in self.live[kind].values() if (first is None or x.first >= first) and (last is None or x.last >= last)]
        return max(fits, key=lambda x: (sign * x.price, -x.first), default=None)

    def advance(self, admitted, broken):
        why, before, pre = {}, self.roles, self.state()
        event = self.judge({r for r, v in before.items() if v.swing.id in broken}, why)
        for kind, swings in self.live.items():
            for swing in broken:
                swings.pop(swing, None)
        for r in admitted:
            self.live[r.orientation][r.swing_id] = _Swing(r.first_slot, r.last_slot, r.price_ticks, r.swing_id)
        if event and event[1] is not None:
            event[1]()
        self.roles = self.assigned()
        lines = []
        for role in sorted(before):
            old, new = before[role], self.roles.get(role)
            if new != old:
                lines.append(self.line("ROLE_END", None, why.get(role) or self.fate(role, old, new), old.swing, role))
        lines += [self.line("ROLE_START", None, "ACTIVE", v.swing, r) for r, v in sorted(self.roles.items()) if before.get(r) != v]
        if event:
            kind, _, swing = event
            at_end = kind == "DUAL_ESTABLISHMENT"
            lines.insert(0 if at_end else len(lines), self.line(kind, pre, self.state(), swing))
        return lines

    def fate(self, role, old, new):
        """A role passes on only under the same parent and to a swing further out."""
        if new is None or new.parent != old.parent:
            return "ENDED"
        outer = {"PROTECTION": self.side and -self.side.sign, "TARGET": self.side and self.side.sign}
        sign = outer.get(role) or next(x.sign * (-1 if role == x.origin else 1) for x in SIDES if role in (x.origin, x.goal))
        return "SUPERSEDED" if sign * new.swing.price > sign * old.swing.price else "ENDED"

    def judge(self, hit, why):
        """What the broken roles mean: an event with the change it makes, or nothing."""
        if self.ended:
            return None
        if self.side is None:
            ready = []
            for x in SIDES:
                if x.origin in hit:
                    why[x.origin] = "BROKEN"
                elif x.goal in hit:
                    why[x.goal] = "RETIRED"
                    pull = self.extreme(x.low, first=self.roles[x.goal].swing.last + 1)
                    if pull and x.above(pull, self.roles[x.origin].swing) and (self.turned is None or pull.first > self.turned):
                        ready.append((x, pull))
            if len(ready) == 2:
                return "DUAL_ESTABLISHMENT", None, None
            if not ready:
                return None
            (x, pull), = ready
            why[x.goal] = "CONSUMED"
            goal = self.roles[x.goal].swing
            return "ESTABLISHMENT", lambda: self.go(x, pull, goal), goal
        x, guard = self.side, self.protected
        if "PROTECTION" in hit:
            why["PROTECTION"] = "BROKEN"
            return "CHOCH", lambda: self.turn(guard), guard
        if "TARGET" in hit:
            why["TARGET"] = "CONSUMED"
            goal = self.roles["TARGET"].swing
            pull = self.extreme(x.low, first=goal.last + 1)
            if pull and x.above(pull, guard):
                why["PROTECTION"], guard = "REPLACED", pull
            return "BOS", lambda: self.go(x, guard, goal), goal
        return None

    def go(self, side, protected, broken):
        self.side, self.protected, self.leg = side, protected, (broken, self.slot)

    def turn(self, broken):
        self.since, self.turned = broken.first, self.slot
        self.side = self.protected = self.leg = None

    def assigned(self):
        if self.ended:
            return {}
        found = {}
        if self.side is None:
            for x in SIDES:
                origin = self.extreme(x.low, first=self.since)
                goal = origin and self.extreme(x.high, first=origin.last + 1)
                found[x.origin] = origin and _Role(origin, (self.since,))
                found[x.goal] = goal and _Role(goal, (origin.id,))
        else:
            start, slot = self.leg
            goal = self.extreme(self.side.high, first=start.last + 1, last=slot)
            found["PROTECTION"] = _Role(self.protected, (start.id,))
            found["TARGET"] = _Role(goal, (start.id,)) if goal and self.side.above(goal, start) else None
        return {role: v for role, v in found.items() if v}


STRUCTURE_SCHEMA = ("instrument_id string, segment_id bigint, slot bigint, kind string, pre_state string, post_state string, "
                    "swing_id string, role string")


def market_structure(swings: DataFrame, breaks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Direction events (establishment, break of structure, change of character, reset) and role changes."""
    keep = ["instrument_id", "segment_id", "swing_id", "orientation", "price_ticks", "first_slot", "last_slot"]
    admit = swings.select(*keep, F.col("available_slot").alias("slot"), F.lit("ADMIT").alias("action"))
    breach = swings.select(*keep).join(breaks.select("swing_id", F.col("break_slot").alias("slot")), "swing_id").select(
        *keep, "slot", F.lit("BREACH").alias("action"))
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    reset = episodes.filter("reset_at is not null").select(
        "instrument_id", "segment_id", null("swing_id", "string"), null("orientation", "string"), F.lit(0).cast("bigint").alias("price_ticks"),
        F.lit(0).cast("bigint").alias("first_slot"), F.lit(0).cast("bigint").alias("last_slot"), (F.col("last_slot") + 1).alias("slot"),
        F.lit("RESET").alias("action"))
    rows = admit.unionByName(breach).unionByName(reset)
    return replay(rows, SEGMENT, ["slot", "action", "swing_id"], _Structure, STRUCTURE_SCHEMA)


# --- J03 / J04 -------------------------------------------------------------------------------------------
def level_links(atoms: DataFrame, tolerance: int) -> DataFrame:
    """Links between near-equal swings with no more extreme one between.

    ``atoms``: instrument_id, segment_id, orientation, slot, value (outer = larger), member_id.  Each
    swing is linked to the latest earlier swing at every price within the tolerance: an older one at the
    same price is already linked to that latest one, or blocked for both, so at most 2 * tolerance + 1
    links per swing carry the same components.
    """
    keys = [*SEGMENT, "orientation"]
    probes = atoms.select(*keys, "slot", "member_id", F.col("value").alias("_v"),
                          F.explode(F.sequence(F.col("value") - tolerance, F.col("value") + tolerance)).alias("_at"))
    stored = atoms.select(*keys, "slot", F.col("value").alias("_at"), F.struct("slot", "member_id", "value").alias("_mine"))
    both = probes.unionByName(stored, allowMissingColumns=True)
    before = Window.partitionBy(*keys, "_at").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    pairs = both.withColumn("_prior", F.last("_mine", True).over(before)).filter("member_id is not null and _prior is not null")
    pairs = pairs.select(*keys, F.col("slot").alias("later_slot"), F.col("member_id").alias("later_id"), F.col("_v").alias("later_value"),
                         F.col("_prior.slot").alias("earlier_slot"), F.col("_prior.member_id").alias("earlier_id"), F.col("_prior.value").alias("earlier_value"))
    pairs = pairs.withColumns({"_from": F.col("earlier_slot") + 1, "_top": F.greatest("earlier_value", "later_value"), "_side": F.lit("UPPER"),
                               "_last": F.col("later_slot") - 1})
    checked = first_beyond(pairs, atoms, keys, ordinal="slot", above="value", below="value", start="_from", threshold="_top", side="_side",
                           out="blocked_slot", last="_last")
    return checked.drop("_from", "_top", "_side", "_last").withColumn("is_blocked", F.col("blocked_slot").isNotNull())


def equal_level_clusters(links: DataFrame) -> DataFrame:
    """Versions of the sets of equal (EQ: one price) and nearly equal (REQ: at least two prices) levels, by what they add.

    Each later swing joins all sets that it is linked to into a new version; a REQ set without a second price has none
    yet.  One row per version and member that no earlier version had; the row of the swing that made the version
    (``member_id = last_member_id``) stands for it.  Sets and the order they grow in come from the merge history of the
    links, so the result is linear in them and no set is gathered anywhere.
    """
    open_links = links.filter("not is_blocked").withColumn("structure_type", F.explode(
        F.when(F.col("earlier_value") == F.col("later_value"), F.array(F.lit("EQ"), F.lit("REQ"))).otherwise(F.array(F.lit("REQ")))))
    node = lambda name: F.concat_ws("|", "structure_type", name)
    step = F.struct("structure_type", "later_slot", "later_id", "earlier_slot", "earlier_id")
    events, joined = merge_history(open_links.select(node("earlier_id").alias("a"), node("later_id").alias("b"), step.alias("step")), "step")
    ends = [open_links.select(node(f"{e}_id").alias("node"), F.col(f"{e}_id").alias("member_id"), F.col(f"{e}_value").alias("value")) for e in ("earlier", "later")]
    joined = joined.join(ends[0].unionByName(ends[1]).distinct(), "node")

    # Members and prices up to each event of a stage, from counts per step.
    members = joined.groupBy("stage", "at").agg(F.count(F.lit(1)).alias("members"))
    prices = joined.groupBy("stage", "value").agg(F.min("at").alias("at")).groupBy("stage", "at").agg(F.count(F.lit(1)).alias("prices"))
    rows = members.unionByName(prices, allowMissingColumns=True).unionByName(events.select("stage", "at", "until", F.lit(True).alias("is_event")), allowMissingColumns=True)
    rows = rows.groupBy("stage", "at").agg(F.sum("members").alias("_m"), F.sum("prices").alias("_p"), F.max("until").alias("until"), F.max("is_event").alias("is_event"))
    rows = running(rows.withColumn("_chunk", F.floor(F.col("at.later_slot") / 4096)), ["stage"], [["_chunk"]], ["at"], {
        "members": ("sum", F.coalesce("_m", F.lit(0))), "prices": ("sum", F.coalesce("_p", F.lit(0))), "latest": ("last", F.when(F.col("is_event"), F.col("at")))})
    before = running(rows.filter("is_event"), ["stage"], [["_chunk"]], ["at"], {"previous": ("last", F.col("at"))}, exclusive=True)
    events = written(before.select("stage", "at", "until", "members", "prices", "previous", F.struct("at.structure_type", "at.later_slot", "at.later_id").alias("maker")), "events")

    versions = events.groupBy("maker").agg(F.max(F.struct("at", "members", "prices")).alias("_v")).select("maker", "_v.*")
    versions = versions.filter("maker.structure_type = 'EQ' or prices > 1")
    versions = written(versions.withColumn("version_id", F.concat(F.col("maker.structure_type"), F.lit(":"), F.col("maker.later_id"), F.lit("@"), F.col("members").cast("string"))), "versions")
    # The set before an event: the previous event of its stage, and the last ones of the stages that end by it.
    ended = events.groupBy("stage").agg(F.max("at").alias("old"), F.max("until").alias("new")).filter("new is not null").select("old", "new")
    pairs = events.filter("previous is not null").select(F.col("previous").alias("old"), F.col("at").alias("new")).unionByName(ended)
    pairs = pairs.join(versions.select(F.col("at").alias("old"), F.col("version_id").alias("_old"), F.col("maker").alias("_made")), "old")
    pairs = pairs.join(events.select(F.col("at").alias("new"), "maker"), "new").filter("maker <> _made")
    supersedes = pairs.groupBy("maker").agg(F.sort_array(F.collect_set("_old")).alias("supersedes"))

    # A member's first version: that of its first event, else the first of the stage, else of the event that ends the stage.
    made = events.join(versions.select("maker", F.lit(True).alias("is_version")), "maker", "left")
    first = made.filter("is_version").groupBy("stage").agg(F.min("at").alias("_first"))
    onward = written(made.join(first, "stage", "left").select("at", F.when(F.col("is_version"), F.col("at")).otherwise(F.coalesce("_first", "until")).alias("then")), "onward")
    added = joined.groupBy("node", "member_id").agg(F.min("at").alias("at"))
    for _ in range(events.agg(F.max("stage.level")).first()[0] or 1):
        added = added.join(onward, "at").select("node", "member_id", F.col("then").alias("at")).filter("at is not null")
    added = added.join(events.select("at", "maker"), "at").select("member_id", "maker")

    change = F.when(F.size("supersedes") == 0, "FORMED").when(F.size("supersedes") == 1, "EXTENDED").otherwise("MERGED")
    out = versions.join(supersedes, "maker", "left").withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<string>")))
    out = out.join(added, "maker").withColumn("change_kind", change)
    out = out.select("version_id", "maker.structure_type", F.col("maker.later_slot").alias("available_slot"), F.col("maker.later_id").alias("last_member_id"), "change_kind",
                     F.col("members").alias("member_count"), F.col("prices").alias("price_count"), "supersedes", "member_id")
    places = links.select(*SEGMENT, "orientation", F.col("later_id").alias("last_member_id")).distinct()
    return out.join(places, "last_member_id").select(*SEGMENT, "orientation", *out.columns)


def cluster_versions(clusters: DataFrame) -> DataFrame:
    """One row per version."""
    return clusters.filter("member_id = last_member_id").drop("member_id", "last_member_id")


def superseded_totals(versions: DataFrame, counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sums of ``counts`` (per version, of what it adds) over each version and all that it supersedes, directly or not.

    A version is superseded once, so each passes its sum on to the version 1, 2, 4, ... steps ahead: as many rounds as the
    longest chain has binary digits, and no member list is written out.
    """
    sums = [F.sum(n).alias(n) for n in names]
    totals = written(versions.select("version_id").join(counts, "version_id", "left").fillna(0, list(names)), "totals")
    ahead = written(versions.select(F.explode("supersedes").alias("version_id"), F.col("version_id").alias("next")), "ahead")
    while not ahead.isEmpty():
        passed = ahead.join(totals, "version_id").groupBy(F.col("next").alias("version_id")).agg(*sums)
        totals = written(totals.unionByName(passed).groupBy("version_id").agg(*sums), "totals")
        ahead = written(ahead.join(ahead.select(F.col("version_id").alias("next"), F.col("next").alias("_then")), "next").select("version_id", F.col("_then").alias("next")), "ahead")
    return totals


def cluster_lineages(versions: DataFrame) -> DataFrame:
    """Versions to lineages: an extension continues its lineage, a merge starts one and stops the absorbed.

    The chains of extensions are connected sets, each named by the one version in it that extends nothing.
    """
    keys = [*SEGMENT, "orientation"]
    named = versions.select(*keys, "version_id", "available_slot", "change_kind", "supersedes", F.concat_ws("|", *keys, "version_id").alias("_node"))
    chains = components(named.filter("change_kind = 'EXTENDED'").select("_node", F.concat_ws("|", *keys, F.col("supersedes")[0]).alias("_before")).toDF("a", "b"))
    rows = named.join(chains, named["_node"] == chains["node"], "left").withColumn("_chain", F.coalesce("root", "_node"))
    heads = rows.filter("change_kind <> 'EXTENDED'").select(F.col("_chain"), F.concat(F.lit("lineage_"), "version_id").alias("lineage_id"))
    rows = written(rows.join(heads, "_chain").select(*keys, "lineage_id", "version_id", "available_slot", "change_kind", "supersedes"), "lineages")
    absorbed = rows.filter("change_kind = 'MERGED'").select(*keys, "version_id", "available_slot", F.explode("supersedes").alias("_old"))
    absorbed = absorbed.join(rows.select(*keys, F.col("version_id").alias("_old"), "lineage_id"), [*keys, "_old"])
    stops = absorbed.groupBy(*keys, "lineage_id").agg(F.min(F.struct("available_slot", "version_id")).alias("_at"))
    stops = stops.select(*keys, "lineage_id", "_at.version_id", "_at.available_slot", F.lit("STOPPED").alias("change_kind"))
    return rows.drop("supersedes").unionByName(stops)


# --- J05 -------------------------------------------------------------------------------------------------
def internal_levels(evidence: DataFrame, segmented: DataFrame, tolerance: int) -> DataFrame:
    """One live level per side and price.

    Evidence arriving while a level lives shares the level's first bar beyond the threshold, so a level
    is simply the evidence of one (side, price, consuming bar): one aggregation, no replay.
    """
    sided = evidence.withColumns({"_from": F.col("available_slot") + 1,
                                  "_theta": F.when(F.col("side") == "UPPER", F.col("price_ticks") + tolerance).otherwise(F.col("price_ticks") - tolerance)})
    found = first_beyond(sided, segmented, SEGMENT, ordinal="slot", above="high", below="low", start="_from", threshold="_theta", side="side", out="consumed_slot")
    keys = ["instrument_id", "contract", "segment_id", "side", "price_ticks", "consumed_slot"]
    levels = found.groupBy(*keys).agg(
        F.min("available_slot").alias("from_slot"), F.min("available_at").alias("available_at"), F.count(F.lit(1)).alias("evidence_count"),
        F.max("grade_rank").alias("grade_rank"), F.max_by("family", F.struct("grade_rank", "evidence_id")).alias("primary_family"),
        F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))
    levels = bar_at(levels, segmented, "consumed_slot", consumed_at="bar_end")
    return levels.withColumn("level_id", natural_id("il_", F.col("instrument_id"), F.col("contract"), F.col("side"), F.col("price_ticks"), utc_text(F.col("available_at"))))


def level_versions(levels: DataFrame, evidence: DataFrame) -> DataFrame:
    """One version per evidence of a level, with the best grade so far."""
    member = levels.select("level_id", F.explode("evidence_ids").alias("evidence_id"))
    order = Window.partitionBy("level_id").orderBy("available_at", "evidence_id")
    rows = member.join(evidence.select("evidence_id", "available_at", "grade_rank"), "evidence_id")
    return rows.select("level_id", "evidence_id", "available_at", F.row_number().over(order).cast("bigint").alias("version_no"),
                       F.max("grade_rank").over(order).alias("grade_rank"), F.when(F.row_number().over(order) == 1, "CREATED").otherwise("EVIDENCE_ADDED").alias("change_kind"))


# --- J06 -------------------------------------------------------------------------------------------------
class _Book:
    """Live boundaries of one side, from the inside out; prices are mirrored below, so that outwards is upwards."""

    def __init__(self, sign: int):
        self.sign, self.rows = sign, []

    def add(self, price, slot, name):
        insort(self.rows, (self.sign * price, slot, name))

    def drop(self, price, slot, name):
        at = bisect_left(self.rows, (self.sign * price, slot, name))
        del self.rows[at]

    def first(self, price, beyond=False):
        """The innermost boundary at or outside a price, or strictly outside."""
        at = bisect_left(self.rows, (self.sign * price + beyond,))
        return self.rows[at] if at < len(self.rows) else None


class _Ranges:
    """Trading range of one episode between the closest live boundaries.

    A range starts at the first close not below all lower boundaries.  A side whose boundary died moves outwards; then the
    other side moves inwards if a boundary nearer to the close is there.  Without a lower boundary the range ends.
    """

    def __init__(self, key):
        self.key, self.number, self.held = key, 0, None
        self.books, self.ends = {"UPPER": _Book(1), "LOWER": _Book(-1)}, []

    def finish(self):
        return []

    def step(self, row):
        if row.action == "A":  # eligible at the end of its bar, before that bar's close is judged
            self.books[row.side].add(row.price_ticks, row.slot, row.object_id)
            if row.death_slot == row.death_slot:
                insort(self.ends, (row.death_slot, row.side, row.price_ticks, row.slot, row.object_id))
            return []
        gone = {}
        while self.ends and self.ends[0][0] <= row.slot:
            _, side, *spot = self.ends.pop(0)
            self.books[side].drop(*spot)
            gone.setdefault(side, set()).add(spot[2])
        lost = {s for s, v in (self.held or {}).items() if v and v[2] in gone.get(s, ())}
        if self.held is None:
            return self.start(row)
        return self.moved(row, lost) if lost else []

    def start(self, row):
        outer = self.books["LOWER"].rows
        if not outer or -row.close > outer[-1][0]:
            return []
        self.number += 1
        self.held = {s: b.first(row.close) for s, b in self.books.items()}
        return [self.line(row.slot, "ESTABLISHED")]

    def moved(self, row, lost):
        was = self.held
        outward = {s: self.books[s].first(self.books[s].sign * was[s][0], beyond=True) for s in lost}
        if "LOWER" in lost and outward["LOWER"] is None:
            ended = self.line(row.slot, "TERMINATED")
            self.held = None
            return [ended, *self.start(row)]
        self.held = {**was, **outward}
        kind = "BOTH_ADVANCED"
        if len(lost) == 1:
            (side,) = lost
            other = "LOWER" if side == "UPPER" else "UPPER"
            kind, near = f"{side}_ADVANCED", self.books[other].first(row.close)
            if near and (was[other] is None or near[0] < was[other][0]):
                self.held[other], kind = near, kind + "+OPPOSITE_RESELECTED"
        return [self.line(row.slot, kind)]

    def line(self, slot, kind):
        up, low = self.held["UPPER"], self.held["LOWER"]
        return (*self.key, self.number, slot, kind, up and up[0], low and -low[0], up and up[2], low and low[2])


RANGE_SCHEMA = ("instrument_id string, segment_id bigint, range_no bigint, slot bigint, change_kind string, upper_ticks bigint, lower_ticks bigint, "
                "upper_id string, lower_id string")


def range_tracking(boundaries: DataFrame, segmented: DataFrame, tolerance: int) -> DataFrame:
    """Range versions of each episode.  ``boundaries``: object_id, side, price_ticks, available_slot in a segment."""
    sided = boundaries.withColumns({"_from": F.col("available_slot") + 1,
                                    "_theta": F.when(F.col("side") == "UPPER", F.col("price_ticks") + tolerance).otherwise(F.col("price_ticks") - tolerance)})
    known = first_beyond(sided, segmented, SEGMENT, ordinal="slot", above="high", below="low", start="_from", threshold="_theta", side="side", out="death_slot")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    a = known.select(*SEGMENT, F.col("available_slot").alias("slot"), F.lit("A").alias("action"), "side", "price_ticks", "object_id", "death_slot", F.lit(0).cast("bigint").alias("close"))
    b = segmented.select(*SEGMENT, "slot", F.lit("B").alias("action"), none("side", "string"), F.lit(0).cast("bigint").alias("price_ticks"), none("object_id", "string"), none("death_slot", "bigint"), "close")
    return replay(a.unionByName(b), SEGMENT, ["slot", "action", "object_id"], _Ranges, RANGE_SCHEMA)


def memberships(levels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Levels strictly inside a range version while both live; touching version intervals are merged."""
    order = Window.partitionBy(*SEGMENT).orderBy("slot", "range_no")
    versions = ranges.withColumn("until", F.lead("slot").over(order)).filter("change_kind <> 'TERMINATED'").select(
        *SEGMENT, "range_no", F.col("slot").alias("v_from"), "until", "upper_ticks", "lower_ticks")
    rows = levels.select(*SEGMENT, "level_id", "price_ticks", F.col("from_slot").alias("l_from"), F.col("consumed_slot").alias("l_until")).join(versions, SEGMENT)
    inside = (F.col("price_ticks") > F.col("lower_ticks")) & (F.col("upper_ticks").isNull() | (F.col("price_ticks") < F.col("upper_ticks")))
    start, end = F.greatest("l_from", "v_from"), F.least("l_until", "until")
    rows = rows.filter(inside).withColumns({"from_slot": start, "until_slot": end}).filter("until_slot is null or from_slot < until_slot")
    w = Window.partitionBy("level_id", "range_no").orderBy("from_slot")
    rows = rows.withColumn("_new", (~F.coalesce(F.lag("until_slot").over(w) == F.col("from_slot"), F.lit(False))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    last = F.max_by("until_slot", "from_slot")
    return rows.groupBy(*SEGMENT, "level_id", "range_no", "_island").agg(F.min("from_slot").alias("from_slot"), last.alias("until_slot")).drop("_island")


# --- D28 -------------------------------------------------------------------------------------------------
def first_zone_in_leg(zones: DataFrame, swings: DataFrame) -> DataFrame:
    """Zone to the swing its leg starts from, and whether it is the first zone of that leg.

    The leg origin is the most extreme same-side swing since the last opposite swing before the zone's
    middle bar.  Swings and zones are merged in order; the count of opposite swings numbers the stretches.
    """
    out = None
    for direction, own, other in ((BULL, "LOWER", "UPPER"), (BEAR, "UPPER", "LOWER")):
        value = F.col("price_ticks") if own == "LOWER" else -F.col("price_ticks")
        s = swings.select(*SEGMENT, F.col("last_slot").alias("slot"), "orientation", value.alias("value"), "swing_id", F.col("available_at").alias("swing_at"))
        z = zones.filter(F.col("direction") == direction).select(*SEGMENT, (F.col("available_slot") - 1).alias("slot"), "zone_id", F.col("available_at").alias("zone_at"))
        rows = s.unionByName(z, allowMissingColumns=True).withColumns({
            "_turn": F.coalesce((F.col("orientation") == other), F.lit(False)), "_rank": F.when(F.col("zone_id").isNotNull(), 2).when(F.col("orientation") == other, 0).otherwise(1),
            "_id": F.coalesce("swing_id", "zone_id"), "_chunk": F.floor(F.col("slot") / 4096)})
        rows = running(rows, SEGMENT, [["_chunk"]], ["slot", "_rank", "_id"], {"_leg": ("count", F.when(F.col("_turn"), 1).otherwise(0))})
        leg = Window.partitionBy(*SEGMENT, "_leg").orderBy("slot", "_rank", "_id")
        origin = F.min(F.when(F.col("orientation") == own, F.struct("value", "slot", "swing_id", "swing_at"))).over(leg)
        got = rows.withColumn("_origin", origin).filter("zone_id is not null and _origin is not null")
        first = Window.partitionBy("_origin.swing_id").orderBy("zone_at", "zone_id")
        part = got.select("instrument_id", "segment_id", "zone_id", F.lit(direction).alias("direction"), F.col("_origin.swing_id").alias("leg_origin_swing_id"),
                          (F.row_number().over(first) == 1).alias("is_first"), F.greatest("zone_at", "_origin.swing_at").alias("association_available_at"))
        out = part if out is None else out.unionByName(part)
    return out


# --- J07 / J08 -------------------------------------------------------------------------------------------
def _next_after(df: DataFrame, at: str, events: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """First later event of each kind in the row's segment, found in one ordered merge.

    Rows and events are read backwards in time, so the latest event seen so far is the next one; at equal
    slots the row comes first and sees later events only.
    """
    merged = df.withColumns({"_s": F.col(at), "_tie": F.lit(0)})
    for prefix, (table, fields) in events.items():
        one = table.select(*SEGMENT, F.col("slot").alias("_s"), F.struct("slot", *fields).alias(f"_event_{prefix}"), F.lit(1).alias("_tie"))
        merged = merged.unionByName(one, allowMissingColumns=True)
    merged = merged.withColumns({"_chunk": -F.floor(F.col("_s") / 4096), "_o": -F.col("_s")})
    seen = running(merged, SEGMENT, [["_chunk"]], ["_o", "_tie"], {f"_{p}": ("last", F.col(f"_event_{p}")) for p in events})
    found = [F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p, (_, fields) in events.items() for c in ["slot", *fields]]
    return seen.filter("_tie = 0").select(*df.columns, *found)


def block_discovery(swings: DataFrame, zones: DataFrame, segmented: DataFrame, episodes: DataFrame, left: int, right: int, body_min: int) -> DataFrame:
    """One row per swing: its source bar, window, departure zone, validating close, admission and status.

    The window ends at the next opposite swing or just before the next same-side swing; the departure zone
    and the first close beyond the source bar must both lie inside, and nothing is admitted before the swing
    runs that could still move the window are decided.
    """
    last = segmented.groupBy(*SEGMENT).agg(F.max("slot").alias("last_bar"))
    bars = segmented.select("instrument_id", F.col("slot").alias("last_slot"), F.col("open").alias("so"), F.col("high").alias("sh"), F.col("low").alias("sl"), F.col("close").alias("sc"))
    base = swings.join(bars, ["instrument_id", "last_slot"]).join(last, SEGMENT).withColumn("direction", F.when(F.col("orientation") == "LOWER", BULL).otherwise(BEAR))
    # neighbours in the merged swing order of a segment
    parts = []
    for own, other in (("LOWER", "UPPER"), ("UPPER", "LOWER")):
        mine = base.filter(F.col("orientation") == own)
        opp = swings.filter(F.col("orientation") == other).select(*SEGMENT, F.col("first_slot").alias("slot"), F.col("last_slot").alias("end"))
        same = swings.filter(F.col("orientation") == own).select(*SEGMENT, F.col("first_slot").alias("slot"))
        z = zones.filter(F.col("direction") == (BULL if own == "LOWER" else BEAR)).select(*SEGMENT, (F.col("available_slot") - 1).alias("slot"), "zone_id")
        parts.append(_next_after(mine, "last_slot", {"opp": (opp, ["end"]), "same": (same, []), "zone": (z, ["zone_id"])}))
    rows = parts[0].unionByName(parts[1])
    bull = F.col("direction") == BULL
    rows = rows.withColumns({
        "lower_ticks": F.when(bull, F.col("sl")).otherwise(F.col("so")), "upper_ticks": F.when(bull, F.col("so")).otherwise(F.col("sh")),
        "window_end": F.least(F.col("last_bar"), F.col("opp_end"), F.col("same_slot") - 1),
        "_from": F.col("last_slot") + 1, "_wick": F.when(bull, F.col("sh")).otherwise(F.col("sl")), "_side": F.when(bull, "UPPER").otherwise("LOWER")})
    rows = first_beyond(rows, segmented, SEGMENT, ordinal="slot", above="close", below="close", start="_from", threshold="_wick", side="_side", out="valid_slot", last="window_end")
    rows = rows.withColumns({"zone_slot": F.when(F.col("zone_slot") <= F.col("window_end"), F.col("zone_slot"))})
    rows = rows.withColumn("zone_id", F.when(F.col("zone_slot").isNotNull(), F.col("zone_zone_id"))).drop("zone_zone_id")
    rows = rows.withColumn("evidence_slot", F.when(F.col("zone_slot").isNotNull() & F.col("valid_slot").isNotNull(), F.greatest("zone_slot", "valid_slot")))
    # used twice below: write it once instead of planning and running the chain above twice
    rows = _with_deadline(written(rows, "block_evidence"), segmented, left, right)
    admission = F.greatest(F.col("last_slot") + right, F.col("zone_slot") + 1, F.col("valid_slot"), F.col("deadline_slot"))
    rows = rows.withColumn("admission_slot", F.when(F.col("evidence_slot").isNotNull() & (admission <= F.col("last_bar")), admission))
    rows = rows.withColumns({"_adverse": F.when(bull, F.col("lower_ticks")).otherwise(F.col("upper_ticks")), "_aside": F.when(bull, "LOWER").otherwise("UPPER")})
    rows = first_beyond(rows, segmented, SEGMENT, ordinal="slot", above="close", below="close", start="_from", threshold="_adverse", side="_aside", out="adverse_slot", last="admission_slot")
    rows = rows.withColumn("adverse_slot", F.when(F.col("admission_slot").isNotNull(), F.col("adverse_slot")))
    rows = rows.join(episodes.select(*SEGMENT, "reset_at", "reset_reason"), SEGMENT, "left")
    small = F.abs(F.col("sc") - F.col("so")) < body_min
    colour = F.when(bull, F.col("sc") < F.col("so")).otherwise(F.col("sc") > F.col("so"))
    superseded = F.col("same_slot").isNotNull() & (F.col("opp_end").isNull() | (F.col("same_slot") - 1 < F.col("opp_end")))
    closed = (F.col("opp_end").isNotNull() | superseded) & (F.col("window_end") + right <= F.col("last_bar"))
    missing = F.col("evidence_slot").isNull()
    status = (
        F.when(small | ~colour, "REJECTED").when(F.col("adverse_slot").isNotNull(), "REJECTED").when(F.col("admission_slot").isNotNull(), "ADMITTED")
        .when(missing & closed & superseded, "SUPERSEDED").when(missing & closed, "REJECTED").when(F.col("reset_at").isNotNull(), "TERMINATED").otherwise("WAITING"))
    reason = (
        F.when(small, "SOURCE_BODY_TOO_SMALL").when(~colour, "SOURCE_DIRECTION_MISMATCH").when(F.col("adverse_slot").isNotNull(), "ALREADY_INVALID_BEFORE_ADMISSION")
        .when(F.col("admission_slot").isNotNull(), F.lit(None)).when(missing & closed & superseded, "NEW_SAME_SIDE_SWING")
        .when(missing & closed & F.col("zone_slot").isNull(), "NO_DEPARTURE_ZONE_IN_WINDOW").when(missing & closed, "NOT_VALIDATED_IN_WINDOW").otherwise(F.col("reset_reason")))
    return rows.select("instrument_id", "contract", "segment_id", "swing_id", "direction", "price_ticks", "first_slot", "last_slot", "lower_ticks", "upper_ticks", "zone_id", "zone_slot",
                       "valid_slot", "window_end", "deadline_slot", F.when(status == "ADMITTED", F.col("admission_slot")).alias("admission_slot"), status.alias("status"), reason.alias("reason"))


def _with_deadline(rows: DataFrame, segmented: DataFrame, left: int, right: int) -> DataFrame:
    """Bar at which the ownership of the evidence bar is settled.

    A run of equal extremes can delay it only if it ends within ``right`` bars before the evidence, so each
    candidate looks at the few bars around its evidence (an equi join on slots), not at its whole window.
    """
    per_bar = _plateau_rows(segmented, left, right)
    worse = lambda side: F.filter(side, lambda x: x["value"] > F.col("value"))
    runs = per_bar.groupBy(*SEGMENT, "orientation", "run_start").agg(
        F.max("slot").alias("run_end"), F.max(F.when(F.col("is_first"), (F.size("_before") == left) & (F.size(worse("_before")) == 0))).alias("qualified"),
        F.max(F.when(F.col("is_last"), F.get(worse("_after"), F.lit(0))["slot"])).alias("denied"))
    runs = runs.filter("qualified").withColumn("decided", F.coalesce("denied", F.col("run_end") + right))
    member = per_bar.select(*SEGMENT, "orientation", "slot", "run_start").join(runs, [*SEGMENT, "orientation", "run_start"])
    near = rows.filter("evidence_slot is not null").select(*SEGMENT, "swing_id", "orientation", "last_slot", "evidence_slot",
                                                           F.explode(F.sequence(F.col("evidence_slot") - right, F.col("evidence_slot"))).alias("slot"))
    member = member.withColumnRenamed("orientation", "run_side")
    met = near.join(member, [*SEGMENT, "slot"]).filter(
        (F.col("run_start") > F.col("last_slot")) & (F.col("run_start") <= F.col("evidence_slot"))
        & ((F.col("run_side") == F.col("orientation")) | ((F.col("run_end") <= F.col("evidence_slot") - 1) & (F.col("run_start") <= F.col("evidence_slot") - 1))))
    late = met.groupBy("swing_id").agg(F.max("decided").alias("_late"))
    return rows.join(late, "swing_id", "left").withColumn("deadline_slot", F.greatest("evidence_slot", "_late")).drop("_late")


def block_lifecycle(blocks: DataFrame, swings: DataFrame, segmented: DataFrame, episodes: DataFrame, right: int) -> DataFrame:
    """Failure of each admitted block, its successor (BREAKER, MITIGATION or none) by the A-B-C swings, and its end."""
    admitted = blocks.filter("status = 'ADMITTED'")
    bull = F.col("direction") == BULL
    rows = admitted.withColumns({"_from": F.col("admission_slot") + 1, "_level": F.when(bull, F.col("lower_ticks")).otherwise(F.col("upper_ticks")), "_side": F.when(bull, "LOWER").otherwise("UPPER")})
    rows = first_beyond(rows, segmented, SEGMENT, ordinal="slot", above="close", below="close", start="_from", threshold="_level", side="_side", out="failed_slot")
    rows = written(rows, "block_failures")
    opp = swings.select(*SEGMENT, F.when(F.col("orientation") == "UPPER", BULL).otherwise(BEAR).alias("direction"), F.col("first_slot").alias("o_first"), F.col("last_slot").alias("o_last"),
                        F.col("swing_id").alias("o_id"), F.when(F.col("orientation") == "UPPER", F.col("price_ticks")).otherwise(-F.col("price_ticks")).alias("o_value"))
    # A: last opposite swing before the anchor, by an ordered merge; C: the most extreme one between anchor and failure
    before = opp.select(*SEGMENT, "direction", F.col("o_last").alias("_s"), F.struct("o_last", "o_value", "o_id").alias("_event"))
    mine = rows.withColumn("_s", F.col("first_slot"))
    merged = mine.unionByName(before, allowMissingColumns=True).withColumns({"_chunk": F.floor(F.col("_s") / 4096), "_tie": F.when(F.col("swing_id").isNotNull(), 0).otherwise(1)})
    merged = running(merged, [*SEGMENT, "direction"], [["_chunk"]], ["_s", "_tie"], {"_a": ("last", F.col("_event"))})
    rows = merged.filter("swing_id is not null").drop("_s", "_event", "_chunk", "_tie")
    failed = rows.filter("failed_slot is not null").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("last_slot") / 256), F.floor(F.col("failed_slot") / 256))))
    cells = opp.withColumn("_cell", F.floor(F.col("o_first") / 256))
    between = failed.join(cells, [*SEGMENT, "direction", "_cell"]).filter((F.col("o_first") > F.col("last_slot")) & (F.col("o_last") < F.col("failed_slot")))
    best = between.groupBy("swing_id").agg(F.max(F.struct(F.col("o_value").alias("v"), (-F.col("o_first")).alias("f"), F.col("o_id").alias("i"))).alias("_c"))
    rows = rows.join(best, "swing_id", "left")
    # raid: first bar after the anchor beyond A, up to the failure
    rows = rows.withColumns({"_from": F.when(F.col("_a").isNotNull() & F.col("failed_slot").isNotNull(), F.col("last_slot") + 1),
                             "_level": F.when(bull, F.col("_a.o_value")).otherwise(-F.col("_a.o_value")), "_side": F.when(bull, "UPPER").otherwise("LOWER")})
    rows = first_beyond(rows, segmented, SEGMENT, ordinal="slot", above="high", below="low", start="_from", threshold="_level", side="_side", out="raid_slot", last="failed_slot")
    last = segmented.groupBy(*SEGMENT).agg(F.max("slot").alias("last_bar"))
    rows = rows.join(last, SEGMENT).join(episodes.select(*SEGMENT, "reset_at", "reset_reason"), SEGMENT, "left")
    resolve = F.greatest(F.col("failed_slot"), F.col("failed_slot") - 1 + right)
    a, c = F.col("_a.o_value"), F.col("_c.v")
    known = F.col("failed_slot").isNotNull() & (resolve <= F.col("last_bar"))
    kind = F.when(known & a.isNotNull() & c.isNotNull(), F.when(c > a, "BREAKER").when((c < a) & F.col("raid_slot").isNull(), "MITIGATION"))
    why = (F.when(~known, F.lit(None)).when(a.isNull(), "NO_PRIOR_EXTREME").when(c.isNull(), "NO_REVERSAL_SWING")
           .when((c == a) & F.col("raid_slot").isNull(), "EQUAL_EXTREME").when(c == a, "EQUAL_EXTREME_WITH_RAID").when((c < a) & F.col("raid_slot").isNotNull(), "RAID_WITH_LESS_EXTREME_C"))
    rows = rows.withColumns({"resolved_slot": F.when(known, resolve), "classification": kind, "motif_reason": why})
    # the successor must survive until it is known, then lives to the first close beyond its far side
    rows = rows.withColumns({"_from": F.when(F.col("classification").isNotNull(), F.col("failed_slot") + 1), "_level": F.when(bull, F.col("upper_ticks")).otherwise(F.col("lower_ticks")),
                             "_side": F.when(bull, "UPPER").otherwise("LOWER")})
    rows = first_beyond(rows, segmented, SEGMENT, ordinal="slot", above="close", below="close", start="_from", threshold="_level", side="_side", out="_beyond")
    early = F.col("_beyond") <= F.col("resolved_slot")
    outcome = (F.when(F.col("failed_slot").isNull(), F.lit(None)).when(F.col("resolved_slot").isNull(), "FAILED_AWAITING").when(F.col("classification").isNull(), "FAILED_FINAL")
               .when(early, "FAILED_FINAL").otherwise(F.col("classification")))
    rows = rows.withColumns({"outcome": outcome, "retired_slot": F.when(~F.coalesce(early, F.lit(False)), F.col("_beyond"))})
    live = F.col("outcome").isNull() | F.col("outcome").isin("FAILED_AWAITING") | (F.col("outcome").isin("BREAKER", "MITIGATION") & F.col("retired_slot").isNull())
    final = (F.when(F.col("retired_slot").isNotNull(), "RETIRED").when(F.col("outcome") == "FAILED_FINAL", "FAILED_FINAL")
             .when(live & (F.col("reset_reason") == "DATA_GAP"), "TERMINATED").when(live & F.col("reset_reason").isNotNull(), "PENDING")
             .otherwise(F.coalesce("outcome", F.lit("ORDINARY"))))
    return rows.select("instrument_id", "contract", "segment_id", "swing_id", "direction", "lower_ticks", "upper_ticks", "admission_slot", "failed_slot", F.col("_a.o_id").alias("a_swing_id"),
                       F.col("_c.i").alias("c_swing_id"), "raid_slot", "resolved_slot", "outcome", "motif_reason", "retired_slot", final.alias("final_state"))


def block_stages(life: DataFrame, episodes: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per stage of a block: ORDINARY, FAILED_AWAITING, then BREAKER, MITIGATION or FAILED_FINAL, with start, end and the reason of the end.

    A stage starts when the one before ends; the reset of the episode ends what is still open then (FAILED_FINAL has no end).
    """
    stage = lambda kind, start, end, why: F.struct(kind.alias("stage"), F.col(start).alias("start_slot"), end.cast("long").alias("end_slot"), F.lit(why).alias("end_reason"))
    settled = F.when(F.col("outcome").isin("BREAKER", "MITIGATION", "FAILED_FINAL"), F.col("outcome"))
    rows = life.filter("admission_slot is not null").withColumn("_s", F.explode(F.array(
        stage(F.lit("ORDINARY"), "admission_slot", F.col("failed_slot"), "FAILED"),
        stage(F.lit("FAILED_AWAITING"), "failed_slot", F.col("resolved_slot"), "RESOLVED"),
        stage(settled, "resolved_slot", F.when(settled != "FAILED_FINAL", F.col("retired_slot")), "RETIRED"))))
    rows = rows.select("instrument_id", "contract", "segment_id", "swing_id", "direction", "lower_ticks", "upper_ticks", "_s.*").filter("stage is not null and start_slot is not null")
    ends = schedule.select("slot", "bar_end")
    rows = rows.join(ends.select(F.col("slot").alias("start_slot"), F.col("bar_end").alias("started_at")), "start_slot")
    rows = rows.join(ends.select(F.col("slot").alias("end_slot"), F.col("bar_end").alias("ended_at")), "end_slot", "left")
    rows = rows.join(episodes.select(*SEGMENT, "reset_at", "reset_reason"), SEGMENT, "left")
    reset = F.when(F.col("end_slot").isNull() & (F.col("stage") != "FAILED_FINAL"), F.col("reset_at"))
    why = F.when(F.col("end_slot").isNotNull(), F.col("end_reason")).when(reset.isNotNull(), F.when(F.col("reset_reason") == "DATA_GAP", "TERMINATED").otherwise("PENDING"))
    return rows.select("instrument_id", "contract", "segment_id", "swing_id", "stage", "direction", "lower_ticks", "upper_ticks", (F.col("lower_ticks") + F.col("upper_ticks")).alias("mid2_ticks"),
                       "started_at", F.coalesce("ended_at", reset).alias("ended_at"), why.alias("end_reason"))


def stages_known_at(stages: DataFrame, instant) -> DataFrame:
    """Stages that had started at an instant; ends after it are hidden."""
    known = F.col("ended_at") <= instant
    return stages.filter(F.col("started_at") <= instant).withColumns({"end_reason": F.when(known, F.col("end_reason")), "ended_at": F.when(known, F.col("ended_at"))})
