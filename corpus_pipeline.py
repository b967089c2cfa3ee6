"""Corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept and returns the columns of ``documents``; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import common, mixing, near_dedup, packing, toxicity
from sessionloom.llm.common import fresh_path, read_table
from sessionloom.llm.exact_dedup import DigestIndex, buckets_for, deduplicate
from sessionloom.llm.queries import tokenizer_path


#: Workers of all stages live side by side in an executor; this bounds what each holds of a table at a time.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the settings of the operators and Arrow batches of a bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return common.prepare(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half stay."""
    prepare(spark)
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepare(spark)
    return deduplicate(docs, DigestIndex(spark, buckets=buckets_for(docs.count())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest id."""
    prepare(spark)
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources have their target weights."""
    prepare(spark)
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenised, as pieces of packed sequences."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokens, learned weights and component labels are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table to packed sequences."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage_{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
