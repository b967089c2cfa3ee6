"""The pipeline: registration, each stage's rows, and the whole against plain Python."""
import os
import sys

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from brute import near_classes, pieces  # noqa: E402
from sessionloom.llm.common import no_links  # noqa: E402
from sessionloom.llm.queries import ORACLES, QUERIES, tokenizer_path  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLES) <= set(QUERIES) <= set(names) and "pipeline" in names


def test_whole_pipeline(session, small_docs):
    docs, kept = small_docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = session.createDataFrame(stage(session, docs, SMALL).collect(), small_docs.schema)
        assert docs.columns == small_docs.columns
        kept.append({(r["doc_id"], r["text"]) for r in docs.collect()})
    clean, exact, near, mixed = kept
    texts = {}
    for d, t in sorted(clean):
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best = texts.setdefault(key, (d, t))
        if len(t) > len(best[1]):
            texts[key] = (d, t)
    assert exact == set(texts.values())
    roots = near_classes(exact)
    assert near == {(d, t) for d, t in exact if roots[d] == d}
    assert {d for d, _ in mixed} <= {d for d, _ in near}
    library = Tokenizer.from_file(tokenizer_path())
    want = [(d["doc_id"], *p) for d in docs.collect() for p in pieces(library.encode(d["text"], add_special_tokens=False).ids)]
    out = corpus_pipeline.run(session, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(session, table, awkward, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = table(awkward, clashing=stage < 4)
    out = run(session, docs, SMALL)
    if stage < 4:
        assert out.columns == docs.columns
    assert out.count() > 0 and run(session, table([]), SMALL).count() == 0


def test_batches_are_bounded(session, table):
    """Python workers get Arrow batches of about ``BATCH_BYTES``, however many rows these are."""
    docs = table([(i, "x" * 4000) for i in range(6000)])
    seen = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    corpus_pipeline.prepare(session)
    assert max(r.n for r in seen.collect()) <= 1.1 * corpus_pipeline.BATCH_BYTES


def test_links_start_without_python(session):
    """The empty table of links is known to the optimizer; it starts no workers."""
    links = no_links(session)
    assert links.dtypes == [("a", "bigint"), ("b", "bigint")]
    assert "LocalRelation <empty>" in links._jdf.queryExecution().optimizedPlan().toString()
