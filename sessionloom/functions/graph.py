"""Connected components by alternating star contraction, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and its smallest connected node ``root`` for every node of ``links`` (columns ``a``, ``b``).

    Each round links every neighbour of a node to the smallest of them, first the larger then the smaller neighbours,
    until nothing changes: about log^2 of the longest path rounds, few where links are stars already.  Minima are
    aggregated before they are shuffled and joins may be split, so a node with very many links is no hot spot.
    Each round is a written table.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"labels still change after {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merge_history(links: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """How the connected sets grow when links (``a``, ``b``, unique ``order``) are added one after the other.

    Returns ``events``, one row per link that joins two sets: ``at`` (its order), the ``stage`` the joined set belongs to
    and ``until`` (the link that ends the stage by joining it to a larger one, null for the last); and ``joined``: the
    order ``at`` which a ``node`` became part of a ``stage``.  The set made by an event consists of the nodes that joined
    its stage up to then.  The next event of a stage, or else its ``until``, is the next change of the set.

    Boruvka rounds: every set picks its first outgoing link, and sets joined by picks form a stage of the next round.
    Picks come earlier towards the middle of a stage, so a stage grows from its first link by one set at a time, in the
    order of the picks; a set that has picked a later link joins with whatever it consists of then.  Links inside a stage
    are dropped.  Sets at least halve per round, and everything is joins and minima.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select("a", "b", F.col(order).alias("w")), "links")
    picks, top = [], 0
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        first = written(both.groupBy("a").agg(F.min_by("b", "w").alias("b"), F.min("w").alias("w")), "picks")
        stage = components(first.select("a", "b"))
        up = written(first.select(F.col("a").alias("set"), "w").join(stage.select(F.col("node").alias("set"), F.col("root").alias("into")), "set"), "stages")
        picks.append(up)
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("set").alias(end), F.col("into").alias(f"_{end}")), end).drop(end)
        edges = written(edges.where("_a <> _b").groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("w").alias("w")), "links")
        top += 1
    name = lambda level, column: F.struct(F.lit(level).alias("level"), F.col(column).alias("id"))
    done = links.sparkSession.createDataFrame([], edges.select(F.col("w").alias("at"), name(1, "a").alias("stage"), F.col("w").alias("until")).schema)
    climbing, nodes, joined = None, None, None
    for level, up in enumerate(picks, 1):
        new = up.select(F.col("w").alias("at"), F.col("into").alias("id")).distinct()
        here = new if climbing is None else climbing.unionByName(new)
        nodes = up.select(F.col("set").alias("node"), F.col("w").alias("at"), F.col("into").alias("id")) if nodes is None else nodes.join(
            up, nodes["id"] == up["set"]).select("node", F.greatest("at", "w").alias("at"), F.col("into").alias("id"))
        nodes = written(nodes, "joined")
        rows = nodes.select("node", "at", name(level, "id").alias("stage"))
        joined = rows if joined is None else joined.unionByName(rows)
        if level < top:
            after = picks[level].select(F.col("set").alias("id"), F.col("w").alias("until"), "into")
            here = written(here.join(after, "id", "left"), "events")
            climbing = here.where("until < at").select("at", F.col("into").alias("id"))
            done = done.unionByName(here.where("until is null or until >= at").select("at", name(level, "id").alias("stage"), "until"))
        else:
            done = done.unionByName(here.select("at", name(level, "id").alias("stage"), F.lit(None).cast(edges.schema["w"].dataType).alias("until")))
    if joined is None:
        joined = edges.select(F.col("a").alias("node"), F.col("w").alias("at"), name(1, "a").alias("stage"))
    return written(done, "events"), joined
