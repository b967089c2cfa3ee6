"""Near-duplicate lines: edit distance, classes by brute force, awkward rows."""
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4:
            out.insert(at, rng.choice("abcdé "))
        elif out and kind < 0.7:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice("abcdé ")
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(session, edits):
    rng = random.Random(edits)
    first = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    pairs = [(a, b, distance(a, b)) for a in first for b in [edited(rng, a, 4)]]
    df = session.createDataFrame(pairs, "a string, b string, d int")
    assert df.where((F.col("d") <= edits) != L.within_edits(F.col("a"), F.col("b"), edits)).count() == 0


def test_classes(table):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde fghij") for _ in range(rng.randint(18, 60))).strip() for _ in range(40)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), 3) for _ in range(rng.randint(0, 5)))) for i in range(80)]
    got = {(r["doc_id"], r["line"]): (r["class_doc"], r["class_line"], r["class_size"], r["kept"]) for r in L.line_classes(table(rows)).collect()}
    places = {(d, k): x.strip(" \t") for d, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" \t")}
    parent = {x: x for x in places.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in list(parent):
        for b in list(parent):
            if a < b and min(len(a), len(b)) >= L.SHORTEST and abs(len(a) - len(b)) <= L.EDITS and distance(a, b) <= L.EDITS:
                parent[root(a)] = root(b)
    groups = {}
    for p, x in sorted(places.items()):
        groups.setdefault(root(x), []).append(p)
    assert any(len({places[p] for p in g}) > 2 for g in groups.values())
    want = {p: (*g[0], len(g), p == g[0]) for g in groups.values() for p in g}
    assert got == want
    left = {r["doc_id"]: r["text"] for r in L.without_repeated_lines(table(rows)).collect()}
    assert left == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if want.get((d, k), (0, 0, 0, False))[3]) for d, t in rows}


def test_short_lines(table):
    """Lines of every length against brute force: one edit per five characters of the shorter, two at most."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in range(1, 25) for _ in range(4)]
    known = ["The, thertion.", "The thertion.", "Ertionnt.", "Ertionat.", "a" + "k" * 18, "k" * 20, "No", "Na", "Yess", "Yes", "wordy", "wordly"]
    content = known + [edited(rng, rng.choice(base), 2).strip() or "z" for _ in range(400)]
    rows = list(enumerate(content))
    parent = list(range(len(content)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(content):
        for j, b in enumerate(content[:i]):
            most = min(2, min(len(a), len(b)) // 5)
            if abs(len(a) - len(b)) <= most and (a == b or (most and distance(a, b) <= most)):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r["doc_id"]: r["class_doc"] for r in L.line_classes(table(rows)).collect()}
    assert got == {i: root(i) for i in range(len(content))}
    assert got[1] == 0 and got[3] == 2 and got[5] == 4 and got[7] == 7 and got[9] == 9 and got[11] == 10


def test_awkward_rows(table, awkward):
    rows = L.line_classes(table(awkward)).collect()
    assert all(r["doc_id"] not in (1, 2, 3) for r in rows)
    same = [r for r in rows if r["doc_id"] in (4, 5)]
    assert len(same) == 3 and {r["class_doc"] for r in same} == {4} and sum(r["kept"] for r in same) == 1
    assert L.line_classes(table([])).count() == 0 and L.line_classes(table([(1, None), (2, " \n ")])).count() == 0
    assert L.without_repeated_lines(table(awkward)).count() == len(awkward)


def test_frequent_lines_make_keys_once(table, monkeypatch):
    """Copies above the bound change neither keys nor candidates."""
    rows = [(i, "\n".join(["the same line in every text", f"another line number {i % 4}", f"other {'x' * i}"])) for i in range(12)]
    lines = L.lines_of(table(rows)).select("content")
    sets = lambda: [sorted(map(tuple, found.select(*cols).collect())) for found, cols in zip(L._candidates(lines), (["content"], ["key", "own"]))]
    plain = sets()
    monkeypatch.setattr(L, "FREQUENT", 1)
    assert sets() == plain and ("another line number 3",) in plain[0]


def test_texts_are_hashed_once(table):
    """The hash of a text is worked out before its lines are made, and lines don't carry the text."""
    plan = L.lines_of(table([(1, "a\nb")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64")


def test_lines_are_trimmed_at_either_end(table):
    """Only lines with a blank at an end are trimmed; inner and other blanks stay."""
    lines = ["a", " a", "a\t", "\x0b\x0c a b\r", " a ", " \t", "", "a \x0b"]
    got = {(r["line"], r["content"]) for r in L.lines_of(table([(1, "\n".join(lines))])).collect()}
    assert got == {(i, s.strip(" \t\n\x0b\x0c\r")) for i, s in enumerate(lines) if s.strip(" \t\n\x0b\x0c\r")}
