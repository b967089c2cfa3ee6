"""Near-duplicate classes against brute force; sketches; alignment."""
import random

import numpy as np
import pytest

from brute import near_classes
from sessionloom.llm import near_dedup as N
from sessionloom.functions.graph import components


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df).collect()}


def test_documents(larger_docs):
    assert classes(larger_docs) == near_classes([(d["doc_id"], d["text"]) for d in larger_docs.collect()])


@pytest.mark.parametrize("block, rounds", [(256, 3), (16, 0), (16, 1)])
def test_large_groups(table, monkeypatch, block, rounds):
    """A group of edited copies, and texts that share half of their words; small cells, and few rounds before them."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "STAR_ROUNDS", rounds)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for i in range(150):
        w = list(base)
        w[rng.randrange(200)] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:100], *(word() for _ in range(100))])) for i in range(60)]
    rows += [(2000 + i, " ".join(word() for _ in range(30))) for i in range(40)]
    got, want = classes(table(rows)), near_classes(rows)
    assert got == want


def test_repeats_do_not_hide_links(table):
    """Pairs with the same shingles but for a few, one of which repeats a line very often."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(30):
        base, line = [word() for _ in range(200)], [word() for _ in range(8)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, *line * 250]))]
    want = near_classes(rows)
    assert all(want[2 * i + 1] == 2 * i for i in range(30))
    assert classes(table(rows)) == want


def test_order_matters_to_the_sketch():
    words, counts = N.word_hashes(["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "i j k l m n o p a b c d e f g h", "A, b; C d e f g h i j k l m n o p!"])
    keys = N.order_minhash(*N.shingle_hashes(words, counts))
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[3]).all() and not (keys[0] == keys[2]).all()


def test_alignment():
    a = np.arange(300)
    b = np.delete(a, [50, 120])
    b[200] = -1
    assert N.edits_within(a, a, 0) == 0 and N.edits_within(a, b, 10) == 4 and N.edits_within(a, b, 3) is None and N.edits_within(a, a[:100], 50) is None
    assert N.similar(a, b) and not N.similar(a, np.concatenate([a[:150], -a[:150] - 1])) and N.similar(np.concatenate([a[150:], a[:150]]), a)


def test_components(session):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["root"] for r in components(session.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_awkward_rows(table, awkward):
    rows = N.near_duplicates(table(awkward)).collect()
    assert len(rows) == len(awkward)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["class_id"] == by[2]["class_id"] == by[3]["class_id"] == 1 and by[1]["class_size"] == 3
    assert by[4]["class_id"] == by[5]["class_id"] == by[6]["class_id"] == 4 and by[4]["class_size"] == 4 and by[8]["class_id"] == 7
    assert N.near_duplicates(table([])).count() == 0


def test_repeated_and_missing_ids(table):
    """Two texts under one id keep their own links; texts without an id are classes by equality."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two = text(120), text(120)
    rows = [(5, one), (5, two), (6, one + " tail"), (7, two + " end"), (None, one), (None, text(50)), (None, text(50))]
    got = {(r["doc_id"], r["n_words"], r["class_id"], r["class_size"]) for r in N.near_duplicates(table(rows)).collect()}
    assert got == {(5, 120, 5, 3), (6, 121, 5, 3), (None, 120, 5, 3), (5, 120, 5, 2), (7, 121, 5, 2), (None, 50, None, 1)}


def test_cells_return_a_forest(monkeypatch):
    monkeypatch.setattr(N, "POSTINGS", 500)
    import pyarrow as pa

    base = np.arange(100, dtype="<u4")
    docs = [base] * 30 + [base + 1000] * 10 + [base + 5000 + 100 * k for k in range(5)]
    n = len(docs)
    table = pa.table({"minor": [True] * n + [False] * n, "rep": [*range(n)] * 2, "comp": [*range(n)] * 2, "words": [d.astype("<u4").tobytes() for d in docs] * 2})
    links = N._cell_links(table).to_pylist()
    assert len(links) == 29 + 9 and all((x["a"] < 30) == (x["b"] < 30) and x["a"] < 40 and x["b"] < 40 for x in links)
