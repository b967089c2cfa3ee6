"""Clusters, levels, ranges, structure and blocks; composite jobs."""
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions.scalars import r6

from sessionloom.catalog import patterns as PC
from sessionloom.catalog.registry import query
from sessionloom.catalog.sql import CTES
from sessionloom.catalog.trades import exits
from sessionloom.catalog.zquality import at
from sessionloom.operators import bars as B
from sessionloom.operators import patterns as P
from sessionloom.operators import quality as Q
from sessionloom.operators import setops as H
from sessionloom.operators import state as K
from sessionloom.operators import stats as S
from sessionloom.operators import structure as J

UNIT, TOL = 500, 2   # swing prices are compared in units of 500 ticks of the test walk
SEG = ["instrument_id", "segment_id"]

# --- J02 ----------------------------------------------------------------------


def structure(m):
    return m.keep("structure", lambda: J.market_structure(PC.swings(m), PC.breaks(m), PC.episodes(m)))


@query("J02_market_structure")
def _(m):
    return structure(m)


@query("O13_market_structure_events")
def _(m):
    return structure(m).filter("kind in ('ESTABLISHMENT', 'BOS', 'CHOCH', 'RESET')").groupBy("instrument_id", "kind").agg(
        F.count(F.lit(1)).alias("events"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


@query("L02_structure_invariants")
def _(m):
    """Counters that must be zero: chain of directions, and every break at its swing's first close beyond."""
    events = structure(m).filter("kind in ('ESTABLISHMENT', 'BOS', 'CHOCH', 'RESET')")
    order = Window.partitionBy(*SEG).orderBy("slot")
    chained = events.withColumn("_prior", F.coalesce(F.lag("post_state").over(order), F.lit("UNDEFINED")))
    chained = chained.join(PC.breaks(m).select("swing_id", "break_slot"), "swing_id", "left")
    return Q.count_violations(chained, {
        "pre_state_chain": F.col("pre_state") != F.col("_prior"), "break_missing": (F.col("kind") != "RESET") & F.col("break_slot").isNull(),
        "break_elsewhere": F.col("break_slot") != F.col("slot"), "bos_changes_direction": (F.col("kind") == "BOS") & (F.col("pre_state") != F.col("post_state"))})


# --- J03 / J04 ------------------------------------------------------------------
CTES["atoms"] = f"""
SELECT instrument_id, segment_id, orientation, first_slot AS slot, CASE orientation WHEN 'UPPER' THEN CAST(floor(price_ticks / {UNIT}.0) AS BIGINT) ELSE -CAST(floor(price_ticks / {UNIT}.0) AS BIGINT) END AS value, swing_id AS member_id FROM swings"""
CTES["links"] = f"""
SELECT *, blocked_slot IS NOT NULL AS is_blocked FROM (SELECT j.instrument_id, j.segment_id, j.orientation, j.slot AS later_slot, j.member_id AS later_id, j.value AS later_value, i.slot AS earlier_slot, i.member_id AS earlier_id, i.value AS earlier_value,
 (SELECT min(k.slot) FROM atoms k WHERE k.instrument_id = j.instrument_id AND k.segment_id = j.segment_id AND k.orientation = j.orientation AND k.slot > i.slot AND k.slot < j.slot AND k.value > greatest(i.value, j.value)) AS blocked_slot
FROM atoms j JOIN atoms i ON i.instrument_id = j.instrument_id AND i.segment_id = j.segment_id AND i.orientation = j.orientation AND i.slot < j.slot AND abs(i.value - j.value) <= {TOL}
QUALIFY row_number() OVER (PARTITION BY j.member_id, i.value ORDER BY i.slot DESC) = 1)"""


def atoms(m):
    unit = F.floor(F.col("price_ticks") / UNIT)
    return PC.swings(m).select(*SEG, "orientation", F.col("first_slot").alias("slot"), F.when(F.col("orientation") == "UPPER", unit).otherwise(-unit).alias("value"), F.col("swing_id").alias("member_id"))


def links(m):
    return m.keep("links", lambda: J.level_links(atoms(m), TOL))


@query("J03_equal_level_pairs", "SELECT * FROM links")
def _(m):
    return links(m)


def clusters(m):
    return m.keep("clusters", lambda: J.equal_level_clusters(links(m)))


CTES["clusters"] = """
WITH RECURSIVE l AS (SELECT *, unnest(CASE WHEN earlier_value = later_value THEN ['EQ', 'REQ'] ELSE ['REQ'] END) AS ty FROM links WHERE NOT is_blocked),
 ev AS (SELECT DISTINCT ty, instrument_id, segment_id, orientation, later_slot AS js, later_id AS j FROM l),
 now AS (SELECT ty, js, j, j AS m FROM ev UNION SELECT n.ty, n.js, n.j, CASE WHEN l.later_id = n.m THEN l.earlier_id ELSE l.later_id END
   FROM now n JOIN l ON l.ty = n.ty AND (l.later_id = n.m OR l.earlier_id = n.m) AND (l.later_slot, l.later_id) <= (n.js, n.j)),
 old AS (SELECT ty, later_slot AS js, later_id AS j, earlier_id AS e, earlier_id AS m FROM l UNION SELECT o.ty, o.js, o.j, o.e, CASE WHEN l.later_id = o.m THEN l.earlier_id ELSE l.later_id END
   FROM old o JOIN l ON l.ty = o.ty AND (l.later_id = o.m OR l.earlier_id = o.m) AND (l.later_slot, l.later_id) < (o.js, o.j)),
 ver AS (SELECT ty, js, j, count(*) AS n, count(DISTINCT a.value) AS p, ty || ':' || j || '@' || CAST(count(*) AS VARCHAR) AS v FROM now JOIN atoms a ON a.member_id = now.m GROUP BY 1, 2, 3 HAVING ty = 'EQ' OR p > 1),
 prior AS (SELECT o.ty, o.j, o.e, max_by(x.j, (x.js, x.j)) AS xj FROM old o JOIN ev x ON x.ty = o.ty AND x.j = o.m GROUP BY 1, 2, 3),
 sup AS (SELECT prior.ty, prior.j, list_sort(list(DISTINCT ver.v)) AS v FROM prior JOIN ver ON ver.ty = prior.ty AND ver.j = prior.xj GROUP BY 1, 2),
 added AS (SELECT now.m, min_by(ver.v, (ver.js, ver.j)) AS v FROM now JOIN ver USING (ty, js, j) GROUP BY now.ty, now.m)
SELECT ev.instrument_id, ev.segment_id, ev.orientation, ver.v AS version_id, ver.ty AS structure_type, ver.js AS available_slot, ver.j AS last_member_id,
       CASE WHEN sup.v IS NULL THEN 'FORMED' WHEN len(sup.v) = 1 THEN 'EXTENDED' ELSE 'MERGED' END AS change_kind, n AS member_count, p AS price_count,
       coalesce(sup.v, CAST([] AS VARCHAR[])) AS supersedes, added.m AS member_id
FROM ver JOIN ev USING (ty, js, j) LEFT JOIN sup ON sup.ty = ver.ty AND sup.j = ver.j LEFT JOIN added ON added.v = ver.v"""
CTES["cluster_rows"] = "SELECT * EXCLUDE (member_id, last_member_id) FROM clusters WHERE member_id = last_member_id"


def cluster_rows(m):
    return J.cluster_versions(clusters(m))


@query("J03_equal_level_clusters", "SELECT * FROM cluster_rows")
def _(m):
    return cluster_rows(m)


@query("J03_cluster_members", "SELECT structure_type, version_id, member_id FROM clusters")
def _(m):
    return clusters(m).select("structure_type", "version_id", "member_id")


CTES["lineages"] = """
WITH RECURSIVE f AS (SELECT version_id, 'lineage_' || version_id AS lineage_id FROM cluster_rows WHERE change_kind <> 'EXTENDED'
 UNION ALL SELECT c.version_id, f.lineage_id FROM cluster_rows c JOIN f ON c.change_kind = 'EXTENDED' AND c.supersedes[1] = f.version_id)
SELECT c.*, f.lineage_id FROM cluster_rows c JOIN f USING (version_id)"""


@query("J04_cluster_lineages", """
SELECT instrument_id, segment_id, orientation, lineage_id, version_id, available_slot, change_kind FROM lineages
UNION ALL SELECT * FROM (SELECT n.instrument_id, n.segment_id, n.orientation, o.lineage_id, min_by(n.version_id, (n.available_slot, n.version_id)) AS version_id, min(n.available_slot) AS available_slot, 'STOPPED' AS change_kind
 FROM (SELECT *, unnest(supersedes) AS old FROM lineages WHERE change_kind = 'MERGED') n JOIN lineages o ON o.version_id = n.old GROUP BY 1, 2, 3, 4)""")
def _(m):
    return J.cluster_lineages(cluster_rows(m))


_CHECKED = """SELECT '{name}' AS input, (SELECT count(*) FROM {t} m LEFT JOIN swings s ON s.swing_id = m.member_id WHERE s.swing_id IS NULL) AS unknown_member,
 (SELECT count(*) FROM {t} m JOIN swings s ON s.swing_id = m.member_id WHERE s.orientation <> m.orientation) AS side_mismatch,
 (SELECT count(*) FROM (SELECT unnest(supersedes) AS old FROM {v}) WHERE old NOT IN (SELECT version_id FROM cluster_rows)) AS unknown_superseded"""


# Every version with all of its members, not only those it adds.
CTES["memberships"] = CTES["clusters"].rsplit("SELECT ev.instrument_id", 1)[0] + "SELECT ver.v AS version_id, now.m AS member_id FROM ver JOIN now USING (ty, js, j)"


@query("B08_validate_structures", f"""
WITH bad AS (SELECT version_id, available_slot, CASE WHEN available_slot % 5 = 1 THEN CASE orientation WHEN 'UPPER' THEN 'LOWER' ELSE 'UPPER' END ELSE orientation END AS orientation,
  CASE WHEN available_slot % 2 = 0 THEN supersedes || ['ghost'] ELSE supersedes END AS supersedes FROM cluster_rows),
 m1 AS (SELECT v.orientation, p.member_id FROM memberships p JOIN cluster_rows v USING (version_id)), v1 AS (SELECT supersedes FROM cluster_rows),
 m2 AS (SELECT v.orientation, p.member_id FROM memberships p JOIN bad v USING (version_id) UNION ALL SELECT orientation, 'ghost' FROM bad WHERE available_slot % 3 = 0)
{_CHECKED.format(name="GIVEN", t="m1", v="v1")} UNION ALL {_CHECKED.format(name="TAMPERED", t="m2", v="bad")}""")
def _(m):
    """Faults over the whole member list of every version: a list is counted by side from what its versions add."""
    slot, other = F.col("available_slot"), F.when(F.col("orientation") == "UPPER", "LOWER").otherwise("UPPER")
    given, names = cluster_rows(m), ["unknown_member", "upper", "lower"]
    # planted faults: another side, a member and a superseded version that don't exist
    tampered = given.withColumns({
        "orientation": F.when(slot % 5 == 1, other).otherwise(F.col("orientation")),
        "supersedes": F.when(slot % 2 == 0, F.concat("supersedes", F.array(F.lit("ghost")))).otherwise(F.col("supersedes"))})
    ghosts = given.filter(slot % 3 == 0).select("version_id", F.lit("ghost").alias("member_id"))
    known = given.select(F.col("version_id").alias("old"))

    def by_side(members):
        found = members.select("version_id", "member_id").join(atoms(m).select("member_id", F.col("orientation").alias("_side")), "member_id", "left")
        return found.groupBy("version_id").agg(
            F.count_if(F.col("_side").isNull()).alias("unknown_member"), F.count_if(F.col("_side") == "UPPER").alias("upper"), F.count_if(F.col("_side") == "LOWER").alias("lower"))

    def violations(members, versions, name):
        counts = versions.select("version_id", "orientation").join(members, "version_id").agg(
            F.sum("unknown_member").alias("unknown_member"), F.sum(F.when(F.col("orientation") == "UPPER", F.col("lower")).otherwise(F.col("upper"))).alias("side_mismatch"),
            F.lit(0).cast("bigint").alias("unknown_superseded"))
        older = versions.select(F.explode("supersedes").alias("old")).join(known, "old", "left_anti").agg(
            F.lit(0).cast("bigint").alias("unknown_member"), F.lit(0).cast("bigint").alias("side_mismatch"), F.count(F.lit(1)).alias("unknown_superseded"))
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unknown_member", "side_mismatch", "unknown_superseded")]
        return counts.unionByName(older).agg(*sums).withColumn("input", F.lit(name))

    lists = J.superseded_totals(given, by_side(clusters(m)), names)
    return violations(lists, given, "GIVEN").unionByName(violations(lists.unionByName(by_side(ghosts)), tampered, "TAMPERED"))


# --- J05 / J06 ---------------------------------------------------------------------
CTES["evidence"] = f"""
SELECT instrument_id, contract, segment_id, orientation AS side, CAST(floor(price_ticks / {UNIT}.0) AS BIGINT) * {UNIT} AS price_ticks, available_slot, available_at, swing_id AS evidence_id, 'SWING' AS family, 2 AS grade_rank FROM swings
UNION ALL SELECT b.instrument_id, b.contract, b.segment_id, d.orientation, CAST(floor(d.price_ticks / {UNIT}.0) AS BIGINT) * {UNIT}, b.slot, b.bar_end, d.instrument_id || ':' || CAST(d.trading_date AS VARCHAR) || ':' || d.orientation, 'CANDLE', 1
 FROM daily_members d JOIN (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY instrument_id, trading_date ORDER BY slot DESC) = 1) b ON b.instrument_id = d.instrument_id AND b.trading_date = d.trading_date"""
CTES["int_levels"] = f"""
SELECT l.*, b.bar_end AS consumed_at, 'il_' || sha256(concat_ws('|', l.instrument_id, l.contract, l.side, CAST(l.price_ticks AS VARCHAR), strftime(l.available_at, '%Y-%m-%dT%H:%M:%SZ'))) AS level_id
FROM (SELECT instrument_id, contract, segment_id, side, price_ticks, consumed_slot, min(available_slot) AS from_slot, min(available_at) AS available_at, count(*) AS evidence_count, max(grade_rank) AS grade_rank,
             arg_max(family, (grade_rank, evidence_id)) AS primary_family, list_sort(list(evidence_id)) AS evidence_ids
      FROM (SELECT e.*, (SELECT min(b.slot) FROM seg b WHERE b.instrument_id = e.instrument_id AND b.segment_id = e.segment_id AND b.slot > e.available_slot
                         AND CASE e.side WHEN 'UPPER' THEN b.high > e.price_ticks + 1000 ELSE b.low < e.price_ticks - 1000 END) AS consumed_slot FROM evidence e) GROUP BY ALL) l
LEFT JOIN seg b ON b.instrument_id = l.instrument_id AND b.slot = l.consumed_slot"""


def day_end_members(m):
    """High and low of each session, known at its last bar."""
    day = m.segments().groupBy("instrument_id", "contract", "trading_date").agg(
        F.max("high").alias("UPPER"), F.min("low").alias("LOWER"), F.max_by(F.struct("segment_id", "slot", "bar_end"), "slot").alias("_b"))
    rows = day.select("instrument_id", "contract", "trading_date", F.col("_b.segment_id").alias("segment_id"), F.col("_b.slot").alias("available_slot"), F.col("_b.bar_end").alias("available_at"),
                      F.expr("stack(2, 'UPPER', UPPER, 'LOWER', LOWER) as (side, price_ticks)"))
    return rows.withColumn("object_id", F.concat_ws(":", "instrument_id", F.col("trading_date").cast("string"), "side"))


def evidence(m):
    unit = lambda c: (F.floor(F.col(c) / UNIT) * UNIT).alias("price_ticks")
    cols = ["instrument_id", "contract", "segment_id"]
    s = PC.swings(m).select(*cols, F.col("orientation").alias("side"), unit("price_ticks"), "available_slot", "available_at", F.col("swing_id").alias("evidence_id"), F.lit("SWING").alias("family"), F.lit(2).alias("grade_rank"))
    d = day_end_members(m).select(*cols, "side", unit("price_ticks"), "available_slot", "available_at", F.col("object_id").alias("evidence_id"), F.lit("CANDLE").alias("family"), F.lit(1).alias("grade_rank"))
    return s.unionByName(d)


def int_levels(m):
    return m.keep("int_levels", lambda: J.internal_levels(evidence(m), m.segments(), 1000))


@query("J05_internal_levels", "SELECT * EXCLUDE (evidence_ids), array_to_string(evidence_ids, ',') AS evidence_ids FROM int_levels")
def _(m):
    return int_levels(m).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("J05_level_versions", """
SELECT level_id, evidence_id, available_at, row_number() OVER w AS version_no, max(grade_rank) OVER w AS grade_rank, CASE WHEN row_number() OVER w = 1 THEN 'CREATED' ELSE 'EVIDENCE_ADDED' END AS change_kind
FROM (SELECT l.level_id, e.evidence_id, e.available_at, e.grade_rank FROM (SELECT level_id, unnest(evidence_ids) AS evidence_id FROM int_levels) l JOIN evidence e USING (evidence_id)) WINDOW w AS (PARTITION BY level_id ORDER BY available_at, evidence_id)""")
def _(m):
    return J.level_versions(int_levels(m), evidence(m))


def ranges(m):
    return m.keep("ranges", lambda: J.range_tracking(day_end_members(m), m.segments(), 0))


@query("J06_range_tracking")
def _(m):
    return ranges(m)


@query("D27_memberships")
def _(m):
    return J.memberships(int_levels(m), ranges(m))


@query("L03_level_invariants", """
SELECT count(*) AS rows, CAST(count_if(consumed_slot <= from_slot) AS BIGINT) AS ends_before_start, CAST(count_if(evidence_count < 1) AS BIGINT) AS no_evidence, count(*) - count(DISTINCT level_id) AS duplicate_levels FROM int_levels""")
def _(m):
    rows = int_levels(m)
    one = lambda d: d.withColumn("_one", F.lit(1))
    repeats = Q.duplicate_keys(rows, ["level_id"]).agg(F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("duplicate_levels"))
    rules = {"ends_before_start": F.col("consumed_slot") <= F.col("from_slot"), "no_evidence": F.col("evidence_count") < 1}
    return one(Q.count_violations(rows, rules)).join(one(repeats), "_one").drop("_one")


LINKS_SQL = """
SELECT instrument_id, contract, side, price_ticks, 'LEVEL' AS kind, level_id AS object_id, available_at AS from_at, consumed_at AS until_at FROM int_levels
UNION ALL SELECT instrument_id, contract, orientation, CAST(floor(price_ticks / 500.0) AS BIGINT) * 500, 'DAILY', instrument_id || ':' || CAST(trading_date AS VARCHAR) || ':' || orientation, available_at, NULL FROM daily_members"""
CTES["record_links"] = LINKS_SQL


def record_links(m):
    from sessionloom.catalog.zquality import daily_members
    a = int_levels(m).select("instrument_id", "contract", "side", "price_ticks", F.lit("LEVEL").alias("kind"), F.col("level_id").alias("object_id"), F.col("available_at").alias("from_at"), F.col("consumed_at").alias("until_at"))
    d = daily_members(m)
    b = d.select("instrument_id", "contract", F.col("orientation").alias("side"), (F.floor(F.col("price_ticks") / UNIT) * UNIT).alias("price_ticks"), F.lit("DAILY").alias("kind"),
                 F.concat_ws(":", "instrument_id", F.col("trading_date").cast("string"), "orientation").alias("object_id"), F.col("available_at").alias("from_at"), F.lit(None).cast("timestamp").alias("until_at"))
    return a.unionByName(b)


@query("D26_price_record_links", "SELECT * FROM record_links")
def _(m):
    return record_links(m)


@query("E43_price_records", """
SELECT instrument_id, contract, side, price_ticks, at_time, CAST(sum(started) OVER w AS BIGINT) - CAST(sum(ended) OVER w AS BIGINT) AS live, CAST(sum(ended) OVER w AS BIGINT) AS ended
FROM (SELECT instrument_id, contract, side, price_ticks, at_time, sum(s) AS started, sum(e) AS ended FROM (SELECT instrument_id, contract, side, price_ticks, from_at AS at_time, 1 AS s, 0 AS e FROM record_links
 UNION ALL SELECT instrument_id, contract, side, price_ticks, until_at, 0, 1 FROM record_links WHERE until_at IS NOT NULL) GROUP BY 1, 2, 3, 4, 5) WINDOW w AS (PARTITION BY instrument_id, contract, side, price_ticks ORDER BY at_time)""")
def _(m):
    keys = ["instrument_id", "contract", "side", "price_ticks"]
    moves = F.array(F.struct(F.col("from_at").alias("at_time"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("until_at").alias("at_time"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    rows = record_links(m).select(*keys, F.inline(moves)).filter("at_time is not null").groupBy(*keys, "at_time").agg(F.sum("s").alias("_s"), F.sum("e").alias("_e"))
    w = Window.partitionBy(*keys).orderBy("at_time")
    return rows.select(*keys, "at_time", (F.sum("_s").over(w) - F.sum("_e").over(w)).alias("live"), F.sum("_e").over(w).alias("ended"))


@query("K07_active_levels", "SELECT level_id, side, price_ticks, grade_rank, evidence_count FROM int_levels WHERE available_at <= TIMESTAMP '2024-01-17 08:00:00' AND (consumed_at IS NULL OR consumed_at > TIMESTAMP '2024-01-17 08:00:00')")
def _(m):
    at = F.lit("2024-01-17 08:00:00").cast("timestamp")
    return K.as_of(int_levels(m), at, "available_at", "consumed_at", ("consumed_at",)).filter("consumed_at is null").select("level_id", "side", "price_ticks", "grade_rank", "evidence_count")


# --- F15, D28 ---------------------------------------------------------------------------
@query("F15_grade_versions", """
SELECT zone_id, at_time, partners FROM (SELECT zone_id, at_time, CAST(sum(d) OVER (PARTITION BY zone_id ORDER BY at_time) AS BIGINT) AS partners, CAST(d AS BIGINT) AS d FROM (SELECT zone_id, at_time, sum(d) AS d FROM (
 SELECT unnest([zone_a, zone_b]) AS zone_id, created_at AS at_time, 1 AS d FROM zone_pairs WHERE label = 'FVG_OVERLAP' UNION ALL SELECT unnest([zone_a, zone_b]), ended_at, -1 FROM zone_pairs WHERE label = 'FVG_OVERLAP' AND ended_at IS NOT NULL) GROUP BY 1, 2)) WHERE d <> 0""")
def _(m):
    pairs = PC.overlaps(m).filter("label = 'FVG_OVERLAP'")
    moves = F.array(F.struct(F.col("created_at").alias("at_time"), F.lit(1).alias("d")), F.struct(F.col("ended_at").alias("at_time"), F.lit(-1).alias("d")))
    rows = pairs.select(F.explode(F.array("zone_a", "zone_b")).alias("zone_id"), moves.alias("_m")).select("zone_id", F.inline("_m")).filter("at_time is not null")
    net = rows.groupBy("zone_id", "at_time").agg(F.sum("d").alias("_d")).withColumn("partners", F.sum("_d").over(Window.partitionBy("zone_id").orderBy("at_time")))
    return net.filter("_d <> 0").select("zone_id", "at_time", "partners")


def legs(m):
    return J.first_zone_in_leg(PC.zones(m), PC.swings(m))


_LEG = """
SELECT z.instrument_id, z.segment_id, z.zone_id, z.direction, o.swing_id AS leg_origin_swing_id, greatest(z.available_at, o.available_at) AS association_available_at, z.available_at AS zone_at
FROM zones z JOIN swings o ON o.instrument_id = z.instrument_id AND o.segment_id = z.segment_id AND o.orientation = CASE z.direction WHEN 'BULLISH' THEN 'LOWER' ELSE 'UPPER' END AND o.last_slot <= z.available_slot - 1
LEFT JOIN (SELECT z.zone_id, max(t.last_slot) AS t FROM zones z JOIN swings t ON t.instrument_id = z.instrument_id AND t.segment_id = z.segment_id AND t.orientation = CASE z.direction WHEN 'BULLISH' THEN 'UPPER' ELSE 'LOWER' END AND t.last_slot <= z.available_slot - 1 GROUP BY 1) k ON k.zone_id = z.zone_id
WHERE k.t IS NULL OR o.last_slot >= k.t QUALIFY row_number() OVER (PARTITION BY z.zone_id ORDER BY CASE z.direction WHEN 'BULLISH' THEN o.price_ticks ELSE -o.price_ticks END, o.last_slot) = 1"""


@query("D28_first_zone_in_leg", f"SELECT * EXCLUDE (zone_at), row_number() OVER (PARTITION BY leg_origin_swing_id ORDER BY zone_at, zone_id) = 1 AS is_first FROM ({_LEG})")
def _(m):
    return legs(m)


# --- J07 / J08 -----------------------------------------------------------------------------
def blocks(m):
    return m.keep("blocks", lambda: J.block_discovery(PC.swings(m), PC.zones(m), m.segments(), PC.episodes(m), 2, 2, 400))


def block_life(m):
    return m.keep("block_life", lambda: J.block_lifecycle(blocks(m), PC.swings(m), m.segments(), PC.episodes(m), 2))


@query("J07_block_discovery")
def _(m):
    return blocks(m)


@query("J08_block_lifecycle")
def _(m):
    return block_life(m)


@query("L05_block_invariants")
def _(m):
    return Q.count_violations(block_life(m), {
        "fails_before_admission": F.col("failed_slot") <= F.col("admission_slot"), "resolves_before_failure": F.col("resolved_slot") < F.col("failed_slot"),
        "raid_after_failure": F.col("raid_slot") > F.col("failed_slot"), "retires_before_resolution": F.col("retired_slot") <= F.col("resolved_slot"), "empty_region": F.col("upper_ticks") < F.col("lower_ticks")})


@query("K06_active_blocks")
def _(m):
    # the last expected slot that has ended at the instant
    now = m.schedule().filter(F.col("bar_end") <= at()).agg(F.max("slot").alias("now_slot"))
    rows = block_life(m).join(F.broadcast(now), F.col("admission_slot") <= F.col("now_slot"))
    return rows.filter(F.col("failed_slot").isNull() | (F.col("failed_slot") > F.col("now_slot"))).select("instrument_id", "swing_id", "direction", "lower_ticks", "upper_ticks", "admission_slot")


def block_stages(m):
    return m.keep("block_stages", lambda: J.block_stages(block_life(m), PC.episodes(m), m.schedule()))


@query("K06_block_history")
def _(m):
    return J.stages_known_at(block_stages(m), at())


@query("K06_pending_blocks")
def _(m):
    stopped = block_stages(m).filter((F.col("end_reason") == "PENDING") & (F.col("ended_at") <= at())).select("instrument_id", "contract", "segment_id", "swing_id", "stage")
    return K.pending_across_contracts(stopped, PC.episodes(m)).drop("segment_id")


def block_touches(m):
    life = block_life(m).filter("admission_slot is not null").select(
        F.col("swing_id").alias("zone_id"), F.lit("ORDINARY").alias("stage"), "instrument_id", "contract", "segment_id", F.col("direction").alias("current_direction"), "lower_ticks", "upper_ticks",
        (F.col("lower_ticks") + F.col("upper_ticks")).alias("mid2_ticks"), F.col("admission_slot").alias("start_slot"), F.col("failed_slot").alias("close_slot"))
    return P.zone_touches(life, m.segments(), price_size=PC.PRICE_CELL)


@query("O12_block_visits")
def _(m):
    return K.touch_visits(block_touches(m)).withColumnsRenamed({"zone_id": "block_id"})


@query("K06_first_return_candidates")
def _(m):
    return block_life(m).join(block_touches(m).select(F.col("zone_id").alias("swing_id")).distinct(), "swing_id", "left_anti").select("swing_id", "direction", "admission_slot", "final_state")


# --- O composites --------------------------------------------------------------------------
@query("O01_breakout_variants", """
SELECT breakout_type, instrument_id, count(*) AS candidates, CAST(count_if(is_ambiguous) AS BIGINT) AS ambiguous, count(result_r) AS trades, CAST(count_if(result_r > 0) AS BIGINT) AS wins, round(avg(result_r), 6) AS average_r, round(sum(result_r), 6) AS total_r,
       CAST(count_if(exit_reason = 'TARGET') AS BIGINT) AS target_exits, CAST(count_if(exit_reason = 'STOP') AS BIGINT) AS stop_exits, CAST(count_if(exit_reason = 'SESSION_END') AS BIGINT) AS session_end_exits FROM exits GROUP BY 1, 2""")
def _(m):
    n = lambda k: F.count_if(F.col("exit_reason") == k)
    return exits(m).groupBy("breakout_type", "instrument_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("is_ambiguous").alias("ambiguous"), F.count("result_r").alias("trades"), F.count_if(F.col("result_r") > 0).alias("wins"),
        r6(F.avg("result_r")).alias("average_r"), r6(F.sum("result_r")).alias("total_r"), n("TARGET").alias("target_exits"), n("STOP").alias("stop_exits"), n("SESSION_END").alias("session_end_exits"))


@query("O02_multiple_sweep", """
SELECT a.breakout_type, a.config_id, count(*) AS candidates, CAST(count_if(a.status = 'EXECUTED') AS BIGINT) AS trades, round(avg(a.result_r) FILTER (a.status = 'EXECUTED'), 6) AS average_r, CAST(count_if(a.rejection_reason = 'SESSION_TRADE_LIMIT') AS BIGINT) AS limited FROM audit_grid a GROUP BY 1, 2""")
def _(m):
    from sessionloom.catalog.trades import grid_audit
    done = F.col("status") == "EXECUTED"
    return grid_audit(m).groupBy("breakout_type", "config_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(done).alias("trades"), r6(F.avg(F.when(done, F.col("result_r")))).alias("average_r"), F.count_if(F.col("rejection_reason") == "SESSION_TRADE_LIMIT").alias("limited"))


@query("O03_fixed_point_sweep", "SELECT breakout_type, stop_points, target_points, count(*) AS trades, round(avg(result_r), 6) AS average_r, round(avg(stop_points * 100 / or_width), 6) AS stop_to_width FROM executed GROUP BY 1, 2, 3")
def _(m):
    from sessionloom.catalog.sweeps import executed
    return executed(m).groupBy("breakout_type", "stop_points", "target_points").agg(F.count(F.lit(1)).alias("trades"), r6(F.avg("result_r")).alias("average_r"), r6(F.avg(F.col("stop_points") * 100 / F.col("or_width"))).alias("stop_to_width"))


@query("O06_two_period_validation", "SELECT edge, degradation, overall, count(*) AS cells FROM decisions GROUP BY 1, 2, 3")
def _(m):
    from sessionloom.catalog.sweeps import decisions
    return decisions(m).groupBy("edge", "degradation", "overall").agg(F.count(F.lit(1)).alias("cells"))


CTES["feature_table"] = """
SELECT o.*, h.hist_5_percentile, h.hist_5_zscore, r.fill_state, r.gap_ticks AS reopen_gap_ticks, g.gap_ticks AS open_gap_ticks, w.overnight_range_ticks, w.london_range_ticks
FROM or_context o LEFT JOIN history h USING (instrument_id, trading_date) LEFT JOIN reopen r USING (instrument_id, trading_date) LEFT JOIN open_gap g USING (instrument_id, trading_date)
LEFT JOIN (SELECT instrument_id, target_date AS trading_date, max(CASE WHEN context_id = 'overnight' THEN range_ticks END) AS overnight_range_ticks, max(CASE WHEN context_id = 'london' THEN range_ticks END) AS london_range_ticks FROM window_summary GROUP BY 1, 2) w USING (instrument_id, trading_date)"""


@query("O07_feature_table", "SELECT * FROM feature_table")
def _(m):
    from sessionloom.catalog import context as CX
    from sessionloom.operators import context as X
    keys = ["instrument_id", "trading_date"]
    of = lambda w: F.max(F.when(F.col("context_id") == w, F.col("range_ticks"))).alias(f"{w}_range_ticks")
    windows = X.window_summary(CX.context(m)).groupBy("instrument_id", F.col("target_date").alias("trading_date")).agg(of("overnight"), of("london"))
    out = CX.or_context(m).join(CX.history(m).select(*keys, "hist_5_percentile", "hist_5_zscore"), keys, "left")
    out = out.join(CX.reopen(m).select(*keys, "fill_state", F.col("gap_ticks").alias("reopen_gap_ticks")), keys, "left")
    return out.join(CX.open_gap(m).select(*keys, F.col("gap_ticks").alias("open_gap_ticks")), keys, "left").join(windows, keys, "left")


# The same chain on swings of three bars on either side.
CTES["plateaus_3"] = CTES["plateaus"].replace("2 PRECEDING AND 1 PRECEDING", "3 PRECEDING AND 1 PRECEDING").replace("1 FOLLOWING AND 2 FOLLOWING", "1 FOLLOWING AND 3 FOLLOWING")
CTES["swings_3"] = re.sub(r"\bplateaus\b", "plateaus_3", CTES["swings"]).replace("'2', '2'", "'3', '3'").replace("= 2", "= 3").replace("last_slot + 2", "last_slot + 3").replace("2 AS left_depth, 2 AS right_depth", "3 AS left_depth, 3 AS right_depth")
for _name in ("atoms", "links", "clusters", "cluster_rows"):
    CTES[f"{_name}_3"] = re.sub(r"\b(swings|atoms|links|clusters)\b", r"\1_3", CTES[_name])


@query("O09_external_liquidity", "SELECT * FROM cluster_rows_3")
def _(m):
    external = P.swing_points(m.segments(), 3, 3).select(*SEG, "orientation", F.col("first_slot").alias("slot"), F.when(F.col("orientation") == "UPPER", F.floor(F.col("price_ticks") / UNIT)).otherwise(-F.floor(F.col("price_ticks") / UNIT)).alias("value"), F.col("swing_id").alias("member_id"))
    return J.cluster_versions(J.equal_level_clusters(J.level_links(external, TOL)))


@query("O10_internal_liquidity", "SELECT instrument_id, side, primary_family, count(*) AS levels, CAST(count_if(consumed_slot IS NOT NULL) AS BIGINT) AS consumed, CAST(sum(evidence_count) AS BIGINT) AS evidence FROM int_levels GROUP BY 1, 2, 3")
def _(m):
    return int_levels(m).groupBy("instrument_id", "side", "primary_family").agg(F.count(F.lit(1)).alias("levels"), F.count_if(F.col("consumed_slot").isNotNull()).alias("consumed"), F.sum("evidence_count").alias("evidence"))


@query("O11_gap_zone_chain", f"""
SELECT z.instrument_id, z.direction, count(*) AS zones, CAST(count_if(l.converted_at IS NOT NULL) AS BIGINT) AS converted, CAST(count_if(a.zone_id IS NOT NULL) AS BIGINT) AS in_leg
FROM zones z JOIN zone_life l USING (zone_id) LEFT JOIN ({_LEG}) a USING (zone_id) GROUP BY 1, 2""")
def _(m):
    rows = PC.life(m).join(legs(m).select("zone_id", F.lit(1).alias("_leg")), "zone_id", "left")
    return rows.groupBy("instrument_id", "direction").agg(F.count(F.lit(1)).alias("zones"), F.count_if(F.col("converted_at").isNotNull()).alias("converted"), F.count_if(F.col("_leg").isNotNull()).alias("in_leg"))


# --- timeframe union: overlaps across two timeframes ------------------------------------------
@query("F20_truncated_swings", """
SELECT s.swing_id, bool_or(r.is_session_truncated) AS is_truncated FROM swings s JOIN resampled r ON r.instrument_id = s.instrument_id AND s.source_at > r.bar_start AND s.source_at <= r.bar_end GROUP BY 1""")
def _(m):
    grid = B.resample_bars(m.bars(), m.calendar(), m.interval, 14_400)
    shift = F.expr("INTERVAL 1 MICROSECOND")
    from sessionloom.functions.rangejoin import points_in_intervals
    spans = grid.select("instrument_id", (F.col("bar_start") + shift).alias("_a"), (F.col("bar_end") + shift).alias("_b"), "is_session_truncated")
    return points_in_intervals(PC.swings(m).select("instrument_id", "swing_id", "source_at"), spans, ["instrument_id"], "source_at", "_a", "_b").groupBy("swing_id").agg(F.bool_or("is_session_truncated").alias("is_truncated"))
