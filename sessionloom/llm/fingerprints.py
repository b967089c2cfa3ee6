"""Merkle fingerprints of documents: pieces, paragraphs, sections, root.

A text is cut into paragraphs at line ends, a paragraph into pieces at sentence ends or after ``PIECE`` code points,
and paragraphs are gathered into sections: a section ends after a paragraph whose digest falls into one of
``1/SECTION`` of all values, so that an edit moves no boundary but its own.  The digest of a paragraph covers those of
its pieces, that of a section those of its paragraphs, the root those of the sections and the length.

A fingerprint is the string ``root/sections/pieces``: the root's digest, then ``digest.paragraphs`` for each section,
then for each piece 12 hex digits of its digest and 2 of its length, paragraphs separated by ``;`` and pieces by ``,``.
Equal texts have equal fingerprints; different roots mean different texts.  Where roots differ, pieces only one side
has locate the edit (``changed_spans``), and the share of common pieces by length is the likeness.

Everything is built from Spark's own functions.  Null texts count as empty; the empty text has one empty piece.  Equal
ids are ordered by text digest.  Texts are never cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import blank

PIECE = 64
SECTION = 4
PIECES = rf"[^.!?]{{0,{PIECE - 1}}}[.!?]{{1,{PIECE}}} {{0,16}}|[^.!?]{{1,{PIECE}}}"
DIGITS = 12


def _label(piece: Column) -> Column:
    size = F.lpad(F.hex(F.length(piece)), 2, "0")
    return F.concat(F.substring(F.sha2(piece.cast("binary"), 256), 1, DIGITS), F.lower(size))


def paragraph_labels(text: Column) -> Column:
    """One string per paragraph: the labels of its pieces, comma-joined."""
    paragraphs = F.split(blank(text), "(?<=\n)", -1)
    paragraphs = F.when(blank(text) == "", F.array(F.lit(""))).otherwise(F.filter(paragraphs, lambda p: p != ""))
    return F.transform(paragraphs, lambda p: F.array_join(F.transform(_pieces(p), _label), ","))


def _pieces(paragraph: Column) -> Column:
    return F.when(paragraph == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(paragraph, F.lit(PIECES), F.lit(0)))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the fingerprint of a text as column ``name``."""
    labels, digests, ends = f"{name}_labels", f"{name}_digests", f"{name}_ends"
    df = df.withColumn(labels, paragraph_labels(text))
    df = df.withColumn(digests, F.transform(labels, lambda p: F.sha2(p.cast("binary"), 256)))
    # The paragraphs that end a section, and the last one.
    last = F.size(digests)
    cut = lambda d: F.pmod(F.conv(F.substring(d, 1, 4), 16, 10).cast("int"), F.lit(SECTION)) == 0
    places = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | cut(F.element_at(F.col(digests), i)))
    df = df.withColumn(ends, places)
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    parts = F.zip_with(F.col(ends), starts, lambda e, s: F.slice(F.col(digests), s + 1, e - s))
    sections = F.transform(parts, lambda p: F.concat(F.substring(F.sha2(F.array_join(p, "").cast("binary"), 256), 1, 16), F.lit("."), F.size(p)))
    joined = F.array_join(sections, ",")
    root = F.sha2(F.concat_ws("|", joined, F.array_join(digests, ""), F.length(text).cast("string")).cast("binary"), 256)
    out = F.concat(root, F.lit("/"), joined, F.lit("/"), F.array_join(labels, ";"))
    return df.withColumn(name, out).drop(labels, digests, ends)


def _label_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.split(F.substring_index(fingerprint, "/", -1), "[,;]"))


def _weight(labels: Column) -> Column:
    # Empty pieces weigh 1, so that two empty texts compare.
    size = lambda x: F.greatest(F.conv(F.substring(x, DIGITS + 1, 2), 16, 10).cast("long"), F.lit(1))
    return F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + size(x))


def likeness(a: Column, b: Column) -> Column:
    """From 0 (no common piece) to 1 (equal roots): twice the weight of common pieces over the weight of both."""
    x, y = _label_set(a), _label_set(b)
    both = F.lit(2.0) * _weight(F.array_intersect(x, y)) / (_weight(x) + _weight(y))
    # Different texts may have the same pieces in another order; only equal roots give 1.
    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), F.lit(1.0)).otherwise(F.least(both, F.lit(0.999999)))


def changed_spans(a: Column, b: Column) -> Column:
    """Where ``a`` differs from ``b``: an array of ``(start, end)`` code points of the pieces that ``b`` doesn't have."""
    labels, other = F.split(F.substring_index(a, "/", -1), "[,;]"), _label_set(b)
    size = lambda x: F.conv(F.substring(x, DIGITS + 1, 2), 16, 10).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + size(x)
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        new = F.when(F.array_contains(other, x), state["spans"]).otherwise(F.concat(state["spans"], span))
        return F.struct(end.alias("at"), new.alias("spans"))

    return F.aggregate(labels, start, step, lambda s: s["spans"])


def with_next(docs: DataFrame, chunk_bits: int = 8) -> DataFrame:
    """Adds ``next_text``, the text of the next row by id, after the last that of the first.

    ``docs``: ``doc_id`` and ``text``.  Ids are cut into chunks of ``2**chunk_bits`` consecutive values, one shuffle deals
    the rows out by chunk, and a window inside each chunk looks ahead by one row.  The last row of a chunk gets the first
    row of the next chunk that has rows, by a join of one row per chunk.  Chunks are ordered in two levels, so no task
    sees more than 4096 chunks, or one row per 4096 chunks.
    """
    lowest = F.lit(-(1 << 62)).cast("long")
    rows = docs.withColumn("chunk", F.coalesce(F.shiftright(F.col("doc_id").cast("long"), chunk_bits), lowest))
    order = Window.partitionBy("chunk").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    seen = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("last", F.lead(F.lit(True), 1, False).over(order) == F.lit(False))
    seen = seen.withColumn("first", F.lag(F.lit(True), 1, False).over(order) == F.lit(False))

    chunks = rows.select("chunk").groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.shiftright("chunk", 12))
    inside = Window.partitionBy("block").orderBy("chunk")
    blocks = chunks.groupBy("block").agg(F.min("chunk").alias("head"))
    across = Window.orderBy("block")
    follow = F.coalesce(F.lead("head").over(across), F.min("head").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    blocks = blocks.select("block", follow.alias("next_head"))
    links = chunks.withColumn("inner", F.lead("chunk").over(inside)).join(blocks, "block")
    links = links.select("chunk", F.coalesce("inner", "next_head").alias("next_chunk"))

    heads = seen.where("first").select(F.col("chunk").alias("next_chunk"), F.col("text").alias("head_text"))
    tails = seen.where("last").drop("next_text", "first", "last").join(links, "chunk").join(heads, "next_chunk")
    tails = tails.withColumn("next_text", F.col("head_text"))
    keep = [*docs.columns, "next_text"]
    return seen.where(~F.col("last")).select(keep).unionByName(tails.select(keep))


def edit_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of the text with its second half overwritten by the next document, and likenesses."""
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), blank(text).alias("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.withColumn("edited", edited)
    for name, of in (("fingerprint", "text"), ("edited_fingerprint", "edited"), ("next_fingerprint", "next_text")):
        rows = with_fingerprint(rows, F.col(of), name)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
