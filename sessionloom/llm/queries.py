"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import (
    exact_dedup, fingerprints, html_text, language, licenses, line_dedup, mixing, near_dedup, packing, periodic, suffix_dedup, toxicity, whitening,
)
from sessionloom.llm.common import prepare, read_table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the given vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def _(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_license_scan")
def _(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query("op3_document_fingerprints")
def _(spark, sf_dir):
    return fingerprints.edit_report(read_table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.scores(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op5_suffix_array_dedup")
def _(spark, sf_dir):
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op6_line_dedup")
def _(spark, sf_dir):
    return line_dedup.line_classes(read_table(spark, sf_dir, "documents")).drop("version")


OP7 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query("op7_exact_dedup", OP7)
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    batch = written(exact_dedup.survivors(docs), "survivors")
    index = exact_dedup.DigestIndex(spark, buckets=exact_dedup.buckets_for(batch.count()))
    index.append(index.unseen(batch))
    return exact_dedup.memberships(docs, index)


@query("op8_html_extraction")
def _(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages"))


OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1) + 1e-9)::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (whole * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM c
"""


@query("op9_mix_to_target_weights", OP9)
def _(spark, sf_dir):
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op10_order_minhash_near_dedup")
def _(spark, sf_dir):
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def _(spark, sf_dir):
    out = whitening.components_of(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_language_id")
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op13_periodic_runs")
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return periodic.digests(periodic.periodic_runs(periodic.with_planted_period(docs)))
