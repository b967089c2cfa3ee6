"""Document fingerprints: edited texts by brute force, equality, likeness, located edits."""
import hashlib

from pyspark.sql import functions as F

from sessionloom.llm import fingerprints


def test_report(small_docs):
    rows = {r["doc_id"]: r for r in fingerprints.edit_report(small_docs).collect()}
    docs = sorted((d["doc_id"], d["text"] or "") for d in small_docs.collect())
    for i, (doc, text) in enumerate(docs):
        after, half, r = docs[(i + 1) % len(docs)][1], len(text) // 2, rows[doc]
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        assert (r["near_edited"] == 1) == (text == edited) and (r["near_next"] == 1) == (text == after)
    texts = {}
    for doc, text in docs:
        texts.setdefault(text, set()).add(rows[doc]["fingerprint"])
    assert all(len(v) == 1 for v in texts.values()) and len({min(v) for v in texts.values()}) == len(texts)
    far = [r for r in rows.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in far) / len(far) > 0.35 and sum(r["near_next"] for r in far) / len(far) < 0.1


def test_sparse_ids_and_chunks(session):
    ids = [-5000, -1, 0, 255, 256, 257, 70_000, 1 << 40]
    df = session.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df).collect()}
    assert got == {a: f"text {b}" for a, b in zip(ids, [*ids[1:], ids[0]])}


def test_changed_spans_locate_an_edit(session):
    a = "First sentence here. Second one stands there. Third is last.\nNew paragraph, with words. The end."
    df = session.createDataFrame([(a, a.replace("Second", "Another"))], "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, F.col("a"), "fa"), F.col("b"), "fb")
    r = df.select(fingerprints.changed_spans(F.col("fa"), F.col("fb")).alias("spans"), fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near")).first()
    assert [a[s["start"] : s["end"]] for s in r["spans"]] == ["Second one stands there. "] and 0.5 < r["near"] < 1


def test_awkward_rows(table, awkward):
    rows = fingerprints.edit_report(table(awkward)).collect()
    assert len(rows) == len(awkward)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.edit_report(table([])).count() == 0
    one = fingerprints.edit_report(table([(1, "ab")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aa").hexdigest() and one["near_next"] == 1
