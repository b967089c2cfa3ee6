"""Exact dedup over the persistent index: batches, ties, awkward rows."""
from sessionloom.llm import exact_dedup as E


def test_batches(session, table):
    index = E.DigestIndex(session, buckets=4)
    first = E.deduplicate(table([(1, "a b"), (2, "ab"), (3, "a  b"), (4, "c")]), index)
    assert sorted(r["doc_id"] for r in first.collect()) == [3, 4]
    again = E.DigestIndex(session, path=index.path, buckets=4)
    second = E.deduplicate(table([(5, "a\tb"), (6, "d"), (7, "d")]), again)
    assert [r["doc_id"] for r in second.collect()] == [6]
    assert again.read().count() == 3 and E.deduplicate(table([]), again).count() == 0


def test_lookup_moves_no_index(session, table):
    index = E.DigestIndex(session, buckets=4)
    index.append(index.unseen(E.survivors(table([(1, "a"), (2, "b")]))))
    plan = index.unseen(E.survivors(table([(3, "c")])))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan.replace("\n", " ")


def test_awkward_rows(session, table, awkward):
    docs, index = table(awkward), E.DigestIndex(session)
    index.append(index.unseen(E.survivors(docs)))
    rows = E.memberships(docs, index).collect()
    assert len(rows) == len(awkward)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["keep_id"] == by[2]["keep_id"] == 3 and by[3]["group_size"] == 3
    assert by[4]["keep_id"] == by[5]["keep_id"] == by[6]["keep_id"] == 6 and by[6]["group_size"] == 4
    kept = E.deduplicate(docs, E.DigestIndex(session))
    assert kept.columns == docs.columns and kept.count() == len({r["text_sha256"] for r in rows})
    assert E.deduplicate(table([(5, "x"), (5, "x"), (5, "x")]), E.DigestIndex(session)).count() == 1


def test_buckets_follow_the_number_of_digests():
    assert [E.buckets_for(n) for n in (0, 1, 8_000_000, 8_000_001, 10**10)] == [8, 8, 8, 16, 16384]
