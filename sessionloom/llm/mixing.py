"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of copies, such that the words of each source meet its target and the
rates stay as close to 1 as they can in relative entropy.  The convex dual of that problem has one multiplier per
source; the rates are ``exp(multiplier)``.  Damped Newton steps on the dual run as DataFrame expressions over the word
sums of the sources, which partial aggregation reduces to one row per source and task, so a source with a third of all
rows is no hot spot.

Rounding: every document of a source gets ``floor(rate)`` copies, and documents in the order of a hash of their id get
one more until the words meet the target; the document at the boundary gives only its first words.  The boundary is
found from sums over ranges of the hash, so only one range per source is ever ordered.  The order depends on ids
alone: reruns agree.

Null or blank texts have size 0 and are taken 0 times; a null source is a source of its own; a source without words has
target 0.  Repeated ids are rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import blank, free_name, written

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 25


def words(text: Column) -> Column:
    return F.regexp_count(blank(text), F.lit(WORD)).cast("long")


def weighted_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """Targets by weight: ``share`` of all words, at most ``most`` times a source's own, the excess reshared by weight.

    ``sources``: one row per source with ``unnamed`` (null name), ``name`` and ``source_size``.  Weights repeat in the
    order of the names.  Sources reach their ceiling in the order of ceiling over weight, so one running sum over the
    sources finds where resharing ends.  The table has one row per source.
    """
    rank = F.row_number().over(Window.orderBy("unnamed", "name"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sources.withColumn("weight", weight).withColumn("ceiling", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "unnamed", "name")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    table = table.withColumn("level", left / F.sum("weight").over(after))
    # The level rises while sources reach their ceiling and falls afterwards.
    target = F.least("ceiling", F.col("weight") * F.max("level").over(whole))
    return table.select("unnamed", "name", "source_size", target.cast("double").alias("target"))


def balance(sources: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds ``rate`` to rows with ``source_size`` and ``target``: Newton iterations on the dual of entropy balancing.

    The dual is the sum over sources of ``size * exp(x) - target * x``; its Hessian is diagonal.  Steps are cut to 1 in
    either direction, so that ``steps`` iterations reach any target up to e^15 times or e^-15 of the size.
    """
    x = F.lit(0.0)
    mass = F.greatest(F.col("source_size").cast("double"), F.lit(1.0))
    out = sources.withColumn("x", x)
    for _ in range(steps):
        tilted = mass * F.exp("x")
        out = out.withColumn("x", F.col("x") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - tilted) / tilted)))
    positive = (F.col("target") > 0) & (F.col("source_size") > 0)
    return out.withColumn("rate", F.when(positive, F.exp("x")).otherwise(0.0)).drop("x")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", share: float = 1.5, most: float = 2.0,
        weights: tuple[float, ...] = (3, 1, 2), range_bits: int = 12) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, rate, taken, copies``.

    ``copies`` counts whole and partial ones.  ``range_bits`` sets into how many ranges of the hash a source is cut;
    only the boundary range of each source is ordered, 1/4096 of it by default.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).isNull().alias("unnamed"), blank(source).alias("name"),
        words(F.col(text)).alias("size"), F.conv(F.substring(key, 1, 8), 16, 10).cast("long").alias("h"),
    )
    rows = written(rows.withColumn("part", F.shiftright("h", 32 - range_bits).cast("int")), "sizes")
    parts = rows.groupBy("unnamed", "name", "part").agg(F.sum("size").alias("words"))
    sums = written(parts, "parts")
    sources = balance(weighted_targets(sums.groupBy("unnamed", "name").agg(F.sum("words").alias("source_size")), share, most, weights))
    # Words of the last, partly given copy: what the whole copies leave of the target.
    whole = F.floor(F.col("rate") + 1e-9)
    sources = sources.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    sources = written(sources, "sources")
    upto = Window.partitionBy("unnamed", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(sources, ["unnamed", "name"])
    edges = edges.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edges = edges.select("unnamed", "name", F.col("part").alias("edge"), "before")
    sources = written(sources.join(edges, ["unnamed", "name"], "left"), "edges")
    named = rows.join(sources, ["unnamed", "name"])
    inside = Window.partitionBy("unnamed", "name", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = named.where(F.col("part") == F.col("edge"))
    extra = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_edge = at_edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), extra)))
    # Without an edge the boundary falls between ranges: sums before it tell on which side a range lies.
    side = sums.withColumn("before_part", F.coalesce(F.sum("words").over(upto), F.lit(0))).select("unnamed", "name", "part", "before_part")
    clear = named.where(F.col("edge").isNull() | (F.col("part") != F.col("edge")))
    with_edge = clear.where(F.col("edge").isNotNull()).withColumn("extra", F.when(F.col("part") < F.col("edge"), F.col("size")).otherwise(0))
    no_edge = clear.where(F.col("edge").isNull()).join(side, ["unnamed", "name", "part"])
    no_edge = no_edge.withColumn("extra", F.when(F.col("before_part") < F.col("rest"), F.col("size")).otherwise(0)).drop("before_part")
    out = at_edge.unionByName(with_edge).unionByName(no_edge)
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.ceil(taken / F.greatest("size", F.lit(1)))).cast("long")
    return out.select("doc_id", "size", "source_size", "target", "rate", taken.alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", n_chars: str = "n_chars", **options) -> DataFrame:
    """The documents as the mix takes them: repeated, dropped, and one of each source cut after its last taken word.

    Columns as given; ``n_chars`` follows the text where a document is cut.
    """
    nth, left, copy, size, taken = (free_name(docs, n) for n in ("nth_row", "left_words", "copy_number", "all_words", "taken_words"))
    # Rows that share an id are paired one by one; both windows use the partitioning of the join.
    mixed = mix(docs, text, source, id_col, **options).select(F.col("doc_id").alias("mix_id"), F.col("size").alias(size), F.col("taken").alias(taken))
    mixed = mixed.withColumn("mix_nth", F.row_number().over(Window.partitionBy("mix_id").orderBy(size, taken)))
    rows = docs.withColumn(nth, F.row_number().over(Window.partitionBy(id_col).orderBy(words(F.col(text)))))
    # Written as two comparisons so that the id alone is the key of the join.
    same = rows[id_col].eqNullSafe(mixed["mix_id"]) & (rows[nth] <= mixed["mix_nth"]) & (rows[nth] >= mixed["mix_nth"])
    rows = rows.join(mixed.where(F.col(taken) > 0), same).withColumn(copy, F.explode(F.sequence(F.lit(0), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    rows = rows.withColumn(left, F.col(taken) - F.col(copy) * F.col(size)).where(F.col(left) > 0)
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(left).cast("int")), "")
    whole = F.col(left) >= F.col(size)
    out = {c: F.col(c) for c in docs.columns}
    out[text] = F.when(whole, F.col(text)).otherwise(cut)
    if n_chars in out:
        out[n_chars] = F.when(whole, F.col(n_chars)).otherwise(F.length(cut).cast(docs.schema[n_chars].dataType))
    return rows.select(*[c.alias(name) for name, c in out.items()])
