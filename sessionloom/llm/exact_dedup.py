"""Exact deduplication over a persistent digest index.

The index is one Parquet table, bucketed and sorted by digest, with a row for each distinct normalised text ever
seen: its digest, the document that stays, that document's length and the number of rows seen.  A batch is reduced to
one row per digest (partial aggregation first, so that a text with a third of all rows costs one row per task),
deduplicated against the index by a sort-merge anti-join that reads the index without a shuffle, and appended.

Null texts count as empty; empty texts form one group.  Of equal texts the one with the most code points stays, then
the smallest id.  Repeated ids are rows of their own group like any other.  An empty batch appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import blank, free_name, fresh_path, written

SPACES = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    """The text without any ASCII white space."""
    return F.regexp_replace(blank(text), SPACES, "")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def survivors(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per distinct text: ``digest``, ``keep_id``, ``keep_chars``, ``seen``."""
    rows = docs.select(
        text_digest(F.col(text)).alias("digest"),
        F.struct(F.length(blank(text)).cast("long").alias("n"), (-F.col(id_col)).alias("id")).alias("rank"),
    )
    groups = rows.groupBy("digest").agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("seen"))
    return groups.select("digest", (-F.col("best.id")).alias("keep_id"), F.col("best.n").alias("keep_chars"), "seen")


def buckets_for(digests: int) -> int:
    """Buckets for an expected number of digests: a power of two, at most a million digests (about 100 MB) each, eight at least."""
    return max(8, 1 << max(0, (-(-digests // 1_000_000) - 1).bit_length()))


class DigestIndex:
    """A persistent index of text digests: a table bucketed and sorted by digest.

    ``buckets`` fixes the layout for the life of the index; choose it for the digests expected in the end
    (``buckets_for``), so that one bucket fits a task.  All batches and all readers use the same number, so lookups join bucket by
    bucket without moving the index.  A later application opens the same index by giving the same ``path``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 8) -> None:
        self.spark, self.buckets = spark, buckets
        self.path = path or fresh_path(spark, "digest_index")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, keep_chars BIGINT, seen BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        """The index as a bucketed table."""
        return self.spark.table(self.table)

    def files(self) -> DataFrame:
        """The index as plain files, so that a skewed lookup may be split as Spark likes."""
        return self.spark.read.schema(self.read().schema).parquet(self.path)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch of survivors whose digest the index doesn't hold: a sort-merge anti-join on the buckets."""
        return batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Add survivors that ``unseen`` let through, as sorted bucket files."""
        new.select("digest", "keep_id", "keep_chars", "seen").repartition(self.buckets, "digest").write.insertInto(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay: the best of each text that no earlier batch held; the index then holds them too.

    Columns as given.  Of rows equal in id and text one stays.
    """
    new = written(index.unseen(survivors(docs, text, id_col)), "unseen")
    index.append(new)
    digest = free_name(docs, "digest_of_text")
    chosen = new.select(F.col("digest").alias(digest), F.col("keep_id").alias(f"{digest}_id"))
    marked = docs.withColumn(digest, text_digest(F.col(text)))
    same = (marked[digest] == chosen[digest]) & F.col(id_col).eqNullSafe(F.col(f"{digest}_id"))
    kept = marked.join(chosen, same, "left_semi")
    place = free_name(kept, "place")
    once = Window.partitionBy(digest, id_col).orderBy(digest)
    return kept.withColumn(place, F.row_number().over(once)).where(F.col(place) == 1).drop(digest, place)


def memberships(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its digest and what the index says about its group."""
    marked = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text)).alias("text_sha256"))
    out = marked.join(index.files().withColumnRenamed("digest", "text_sha256"), "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", F.col("seen").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
