"""Whole member lists of cluster versions: chains, merges and the checks over them."""
from sessionloom.catalog import load
from sessionloom.catalog import zzstructure as Z
from sessionloom.operators import structure as J
from sessionloom.sources.market import Market


def lists_of(older, added):
    """Members of each version by following what it supersedes."""
    def all_of(v):
        return added.get(v, 0) + sum(all_of(o) for o in older[v])
    return {v: all_of(v) for v in older}


def test_totals_over_chains_and_merges(spark):
    older = {"a0": [], **{f"a{i}": [f"a{i - 1}"] for i in range(1, 12)}, "b0": [], "b1": ["b0"], "c0": [], "m": ["a11", "b1", "c0"], "n": ["m"]}
    added = {v: 1 + i % 3 for i, v in enumerate(older)} | {"b1": 0}
    versions = spark.createDataFrame(list(older.items()), "version_id string, supersedes array<string>")
    counts = spark.createDataFrame([(v, n, 2 * n) for v, n in added.items() if n], "version_id string, x bigint, y bigint")
    got = {r.version_id: (r.x, r.y) for r in J.superseded_totals(versions, counts, ["x", "y"]).collect()}
    assert got == {v: (n, 2 * n) for v, n in lists_of(older, added).items()}


def test_every_member_of_every_version_is_checked(spark):
    folder = "/root/testdata/sf0.1"
    rows = Z.clusters(Market(spark, folder)).collect()
    versions = {r.version_id: r for r in rows}
    members = lists_of({v: r.supersedes for v, r in versions.items()}, {v: sum(r.version_id == v for r in rows) for v in versions})
    assert sum(members.values()) > len(rows) and members == {v: r.member_count for v, r in versions.items()}
    got = {r.input: r for r in load()[0]["B08_validate_structures"](spark, folder).collect()}
    assert (got["GIVEN"].unknown_member, got["GIVEN"].side_mismatch, got["GIVEN"].unknown_superseded) == (0, 0, 0)
    assert got["TAMPERED"].side_mismatch == sum(n for v, n in members.items() if versions[v].available_slot % 5 == 1)
    assert got["TAMPERED"].unknown_member == sum(r.available_slot % 3 == 0 for r in versions.values())
    assert got["TAMPERED"].unknown_superseded == sum(r.available_slot % 2 == 0 for r in versions.values())
