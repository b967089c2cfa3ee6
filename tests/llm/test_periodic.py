"""Periodic runs: random words against brute force, any way of appending, whole documents, awkward rows."""
import random

import numpy as np
import pytest
from brute import run_digests, runs

from sessionloom.llm import periodic
from sessionloom.llm.queries import QUERIES


def scraps(seed):
    """Words of a few letters: stretches repeated up to eight times, some cut off."""
    rng, out = random.Random(seed), []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 12))]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 90)]
    return out


@pytest.mark.parametrize("seed", range(300))
def test_random_words(seed):
    words, rng = scraps(seed), random.Random(-seed)
    want = runs(words)
    whole, pieces, single = periodic.Catchers(), periodic.Catchers(), periodic.Catchers(longest=len(words))
    whole.append(np.array(words, np.int64))
    i = 0
    while i < len(words):
        k = rng.choice([1, 2, 3, 17])
        pieces.append(np.array(words[i : i + k]))
        i += k
    for w in words:
        single.append(np.array([w]))
    assert whole.runs() == pieces.runs() == single.runs() == want


def test_runs_known_while_words_arrive():
    words, catchers = scraps(11) + [7] * 9 + scraps(12), periodic.Catchers()
    for n, w in enumerate(words, 1):
        catchers.append(np.array([w]))
        assert catchers.runs() == runs(words[:n])


def test_many_texts_and_structured_words():
    many = [np.array(scraps(s), np.int64) for s in range(200)]
    assert periodic.runs_of(many) == [runs(list(m)) for m in many] and periodic.runs_of([]) == []
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 1500:
        fibonacci, before = fibonacci + before, fibonacci
    assert periodic.runs_of([np.array(fibonacci)], exponent=4, length=1) == [runs(fibonacci, 4, 1)]
    for n, period in ((300_000, 1), (300_000, 7), (300_000, 70_001)):
        assert periodic.runs_of([np.arange(n) % period]) == [[(0, n, period)]]


def test_collisions_start_over(monkeypatch):
    """A hash that never tells words apart at first: the words themselves find out."""
    real, calls = periodic._mixed, []
    monkeypatch.setattr(periodic, "_mixed", lambda a: calls.append(1) or (a * np.uint64(0) if len(calls) < 3 else real(a)))
    words = [1, 2, 3, 4, 5, 6, 7] + [8, 9] * 6
    assert periodic.runs_of([np.array(words)]) == [runs(words)] and len(calls) > 3


def test_query_against_brute_force(session, small_docs):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_periodic_runs"](session, "/root/testdata/sf0.001").collect()}
    want = {d: run_digests(d, t) for d, t in small_docs.select("doc_id", "text").collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 10


def test_awkward_rows(table, awkward):
    rows = [*awkward, (20, "a b c " * 3 + "a b c"), (21, "go " * 5), (22, "go\tgo\ngo\x0bgo\x0cgo\rgo"), (23, "x x " * 6)]
    out = periodic.periodic_runs(table(rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert [tuple(x) for x in by[20]["runs"]] == [(0, 12, 3)] and by[20]["collapsed"] == "a b c"
    assert by[21]["runs"] == [] and by[21]["collapsed"] == "go go go go go" and by[22]["collapsed"] == "go" and by[23]["collapsed"] == "x x"
    assert all(r["n_words"] == 0 and r["runs"] == [] and r["collapsed"] == "" for r in out if r["doc_id"] in (1, 2, 3))
    digests = sorted(map(str, map(tuple, periodic.digests(periodic.periodic_runs(periodic.with_planted_period(table(rows)))).collect())))
    assert digests == sorted(str((d, *run_digests(d, t))) for d, t, *_ in rows)
    assert periodic.digests(periodic.periodic_runs(periodic.with_planted_period(table([])))).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(table([]), exponent=3)
