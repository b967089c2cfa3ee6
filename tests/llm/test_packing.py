"""Best-fit packing against the vocabulary's own library and the rules of a packing."""
import numpy as np
import pytest
from tokenizers import Tokenizer

from brute import pieces
from sessionloom.llm import packing
from sessionloom.llm.queries import tokenizer_path


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) <= capacity
    return len(by)


def test_ids_are_those_of_the_library():
    coder, library = packing.ByteBpe(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ["", "  two  spaces ", "a\n\n b\t", "<|endoftext|> in <|endoftext|>", "日本語 🙂 é I'm you'LL 12.5", "x" * 5000]:
        assert coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(small_docs):
    rows = packing.pack_documents(small_docs, tokenizer_path()).collect()
    library, want = Tokenizer.from_file(tokenizer_path()), []
    for d in small_docs.collect():
        want += [(d["doc_id"], *p) for p in pieces(library.encode(d["text"] or "", add_special_tokens=False).ids)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    full = sum(r["length"] for r in rows) / packing.CAPACITY
    assert check(rows, packing.CAPACITY) <= full * 1.02 + 1


def test_awkward_rows(table, awkward):
    rows = packing.pack_documents(table(awkward), tokenizer_path()).collect()
    check(rows, packing.CAPACITY)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) < len(rows)  # repeated ids are rows of their own
    firsts = [r for r in rows if r["piece"] == 0]
    assert len(firsts) == len(awkward) and [r["length"] for r in firsts if r["doc_id"] == 1] == [1]
    assert packing.pack_documents(table([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("group_items", [40, 1_000_000])
def test_tree_of_rounds(session, group_items):
    sizes = np.random.default_rng(5).integers(1, 100, 600).tolist() + [60] * 300
    df = session.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES).repartition(8)
    rows = packing.pack(df, 100, group_items=group_items).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    least = max(-(-sum(sizes) // 100), sum(n > 50 for n in sizes))
    assert check(rows, 100) <= least * (1.15 if group_items == 40 else 1.06)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([60, 50, 40, 50, 1]), 100)
    assert fills.tolist() == [100, 100, 1] and bins.tolist() == [0, 1, 0, 1, 2] and offsets.tolist() == [0, 0, 60, 50, 0]


def test_long_white_space():
    """Runs that the fast encoder refuses get the ids of the vocabulary's own library."""
    from tokenizers import Tokenizer

    coder, library = packing.ByteBpe(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in (" " * 100_000, "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x \t\n" * 250_000, " \n" * 500_000 + "end"):
        assert coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
