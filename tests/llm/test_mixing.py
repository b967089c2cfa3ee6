"""Mixing: targets and taken words by hand and in the awkward cases."""
from sessionloom.llm import mixing


def mixed(df, **options):
    return mixing.mix(df, **options).collect()


def test_targets_and_words(table):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(300)]
    out, again = mixed(table(rows)), mixed(table(rows).repartition(7))
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    words = {s: sum(1 + i % 7 for i, _, t in rows if t == s) for s in "abc"}
    total, source = sum(words.values()), {i: s for i, _, s in rows}
    # Weights 3, 1, 2: the first source stops at twice its size, the rest is shared 1 to 2, the last stops too.
    rest = 1.5 * total - 2 * words["a"]
    want = {"a": 2 * words["a"], "b": rest - min(2 * words["c"], rest * 2 / 3), "c": min(2 * words["c"], rest * 2 / 3)}
    for s in "abc":
        mine = [r for r in out if source[r["doc_id"]] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 and mine[0]["source_size"] == words[s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1 and all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(mine[0]["rate"] * words[s] - want[s]) < 1e-6 * total


def test_newton_meets_targets(session):
    df = session.createDataFrame([(100, 150.0), (100, 3.0), (7, 0.0), (0, 0.0), (10**9, 1.9e9)], "source_size long, target double")
    for r in mixing.balance(df).collect():
        assert abs(r["rate"] * r["source_size"] - r["target"]) <= 1e-9 * max(1.0, r["target"])


def test_awkward_rows(table, awkward):
    out = mixed(table(awkward))
    assert len(out) == len(awkward) and all(r["taken"] == 0 for r in out if r["doc_id"] in (1, 2, 3)) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixed(table([])) == [] and all(r["taken"] == 0 and r["target"] == 0 for r in mixed(table([(1, None), (2, "")])))


def test_applied_mix(table, awkward):
    docs = table([*awkward, *((100 + i, f"one two  three\n{i}", "z") for i in range(50))])
    got = mixing.apply_mix(docs)
    taken = {}
    for r in mixed(docs):
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    seen = {}
    for r in got.collect():
        n = len([w for w in r["text"].translate({c: " " for c in range(9, 14)}).split(" ") if w])
        assert n and (r["n_chars"] == len(r["text"]))
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + n
    assert got.columns == docs.columns and seen == {k: v for k, v in taken.items() if v}
    assert mixing.apply_mix(table([])).count() == 0
