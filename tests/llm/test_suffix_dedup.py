"""Removal of repeated byte strings against brute force; the merge against sorting."""
import hashlib
import random

import numpy as np
import pytest

from brute import without_repeats
from sessionloom.llm import suffix_dedup as S


def result(df, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df, **options).collect()}


def mixed_rows(n=60, seed=3):
    """Texts pasted from shared passages, with small edits, copies and a run of one byte."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde fgh\n") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 40) :] if rng.random() < 0.6 else "".join(rng.choice("xyz uvwé") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(1, 5))]
        rows.append((i * 3, "".join(parts)))
    return [*rows, (500, "q" * 350), (501, rows[0][1]), (502, rows[0][1]), (503, "q" * 100)]


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 3000}, {"max_core_bytes": 400}])
def test_against_brute_force(table, options, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 700)
    rows = mixed_rows()
    assert result(table(rows), **options) == without_repeats([(d, t.encode()) for d, t in rows])


def test_documents(small_docs):
    rows = sorted((d["doc_id"], (d["text"] or "").encode()) for d in small_docs.collect())
    assert result(small_docs) == without_repeats(rows)


def test_merge_equals_sorting():
    rng = random.Random(7)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 140))) for _ in range(9)] * 2 + [b"c" * 130]
    piece, offset, block = S.owners(pieces, shard_bytes=500)
    groups = {}
    for p, o, b in zip(piece.tolist(), offset.tolist(), block.tolist()):
        groups.setdefault(b, set()).add(pieces[p][o : o + 100])
    assert len(piece) == sum(len(p) - 99 for p in pieces) and all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({p[o : o + 100] for p in pieces for o in range(len(p) - 99)})


def test_common_prefixes_of_the_merge():
    texts = [b"banana__bananb__", b"banana__banacc__"]
    sym, begins = S.symbols(texts)
    before = np.concatenate([np.zeros(4, sym.dtype), sym[:-4]])
    before[np.arange(len(sym)) - np.repeat(begins[:-1], np.diff(begins)) < 4] = 0
    shards, places = [], []
    for a, b in zip(begins, begins[1:]):
        order = S.suffix_order(sym[a:b]) + a
        shards.append((before[order], 4))
        places.append(order)
    source, _, common = S.merge_blocks(shards, 4)
    at = np.empty(len(source), int)
    at[np.argsort(source, kind="stable")] = np.concatenate(places)
    strings = [[int(x) for x in sym[i : begins[1] if i < begins[1] else begins[2] : 4]] for i in at]
    for i in range(9, len(at)):
        n = 0
        while n < 4 and strings[i][n] and strings[i][n] == strings[i - 1][n]:
            n += 1
        assert common[i] == n


def test_awkward_rows(table, awkward):
    rows = [r for r in awkward if r[0] is not None and r[0] != 11]
    got = result(table([*rows, (11, "short"), (12, "z" * 250)]))
    assert got[1] == got[2] == (0, 0, 0, got[1][3]) and got[5][1] == 0 and got[8][1] > 100_000 and got[9][1] == 149_999 and got[9][2] == 1
    assert S.remove_repeats(table(awkward)).count() == len(awkward)
    assert S.remove_repeats(table([])).count() == 0
    two = S.remove_repeats(table([(1, "a" * 120 + "b" * 120), (1, "a" * 120 + "c" * 120), (2, "b" * 110)])).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in two) == [(1, 240), (1, 240), (2, 110)] and [r["n_removed"] for r in two if r["doc_id"] == 2] == [110]


def test_missing_and_repeated_ids(table):
    """Texts without an id come first, texts of one id in the order of their digests: every row as by brute force."""
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(130)) for _ in range(40)]
    text = lambda: "".join(rng.choice(shared)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 3))) + "".join(rng.choice("uvwxyz") for _ in range(30))
    rows = [(None, text()) for _ in range(20)] + [(5, text()) for _ in range(300)] + [(-(1 << 63), text()), (0, text()), (6, text()), (1 << 62, text())]
    rows += [rows[0], (7, rows[0][1]), (7, rows[30][1]), (None, rows[25][1])]
    by = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    distinct = sorted(set(rows), key=by)
    brute = without_repeats([(r, r[1].encode()) for r in distinct])
    want = sorted(((r[0] is not None, r[0] or 0), *brute[r]) for r in rows)
    found = S.remove_repeats(table(rows), bucket_bytes=20_000).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == want
