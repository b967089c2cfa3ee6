"""First row at or after a position whose value lies strictly beyond a level, by a tree of extremes.

The ordinals of a series are the leaves of a tree with a fixed fan-out.  A node is one row: the numbers of its children,
at most ``FAN`` of them, with the largest and smallest value of each column below each child.  A level first climbs: it
looks at the later children of its own node, then at the later siblings of that node, and so on; then it descends from
the first child that goes beyond it.  Every step is an equi join on (series, node), so work and shuffle stay in
proportion to the number of levels; no level x row pairs are built, no series is gathered in one task, and no array is
longer than the fan-out however long a series is.  The tree of a table is written once and scanned by later searches.
"""

from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.session import written

FAN = 512
#: Copies of each node above the leaves; the levels of one series are dealt over them.
SALTS = 8
#: Columns that a tree has besides those asked for, so that one tree serves all searches over a table of bars.
USUAL = ("high", "low", "close")


class ExtremesTree:
    """Written node tables of a table of series, from the leaves up; the last has one node per series."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], ordinal: str, columns: Sequence[str], fan: int | None = None):
        self.keys, self.columns, self.fan = list(keys), list(columns), fan or FAN
        self.levels: list[DataFrame] = []
        below = rows.select(*keys, F.col(ordinal).cast("long").alias("kid"), *[
            F.col(c).alias(f"{c}_{end}") for c in columns for end in ("most", "least")])
        while True:
            nodes = self._nodes(below)
            self.levels.append(nodes)
            widest = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            if (widest or 1) <= 1:
                break
            below = nodes.select(*keys, F.col("node").alias("kid"), *[
                end(f"{c}_{name}").alias(f"{c}_{name}") for c in columns for name, end in (("most", F.array_max), ("least", F.array_min))])

    def _nodes(self, below: DataFrame) -> DataFrame:
        ends = [f"{c}_{end}" for c in self.columns for end in ("most", "least")]
        kids = F.sort_array(F.collect_list(F.struct("kid", *ends)))
        nodes = below.groupBy(*self.keys, F.floor(F.col("kid") / self.fan).alias("node")).agg(kids.alias("kids"))
        return written(nodes.select(*self.keys, "node", *[F.col(f"kids.{c}").alias(c) for c in ("kid", *ends)]), f"extremes_{len(self.levels)}")


_TREES: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def tree_of(rows: DataFrame, keys: Sequence[str], ordinal: str, columns: Sequence[str]) -> ExtremesTree:
    """The tree of a table, built when it is first asked for and kept as long as the table's object is."""
    trees = _TREES.setdefault(rows, {})
    key = (tuple(keys), ordinal, FAN)
    if key not in trees or not set(columns) <= set(trees[key].columns):
        usual = [c for c in USUAL if c in rows.columns]
        known = trees[key].columns if key in trees else []
        trees[key] = ExtremesTree(rows, keys, ordinal, list(dict.fromkeys([*usual, *known, *columns])))
    return trees[key]


def first_beyond(
    levels: DataFrame,
    rows: DataFrame | ExtremesTree,
    keys: Sequence[str],
    *,
    ordinal: str,
    above: str,
    below: str,
    start: str,
    threshold: str,
    side: str,
    upper: str = "UPPER",
    out: str = "hit",
    last: str | None = None,
) -> DataFrame:
    """Add ``out``: the smallest ordinal >= ``start`` with value beyond ``threshold``, else null.

    Rows with ``side`` = ``upper`` look for ``above > threshold``, the others for ``below <
    threshold``.  A null ``start`` or threshold gives null.  ``last`` names an optional inclusive
    upper bound: the first hit counts only when it is not after it.
    """
    keys = list(keys)
    tree = rows if isinstance(rows, ExtremesTree) else tree_of(rows, keys, ordinal, dict.fromkeys([above, below]))
    is_up = F.col(side) == F.lit(upper)
    beyond = lambda high, low: F.when(is_up, high > F.col(threshold)).otherwise(low < F.col(threshold))
    spread = F.xxhash64(F.col(start), F.col(threshold))
    # Rows that have nothing to look up point at nodes that don't exist, many of them, so that no task gets them all.
    nowhere = F.lit(-(2**40)) - F.pmod(spread, F.lit(4096))
    top = len(tree.levels) - 1

    def look(df: DataFrame, level: int, node: Column, least: Column, name: str) -> DataFrame:
        """The first child beyond, from ``least`` on, of a node; at the top, of the only node of the series."""
        table = tree.levels[level].select(*keys, F.col("node").alias("_fb_node"), F.col("kid").alias("_fb_kid"),
                                          F.col(f"{above}_most").alias("_fb_most"), F.col(f"{below}_least").alias("_fb_least"))
        on = [*keys, "_fb_node"]
        if level == top:
            node = F.when(node.isNotNull(), F.lit(0))
            table = table.withColumn("_fb_node", F.lit(0).cast("long"))
        df = df.withColumn("_fb_node", F.coalesce(node, nowhere).cast("long"))
        if level:
            table = table.withColumn("_fb_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
            df, on = df.withColumn("_fb_salt", F.pmod(spread, F.lit(SALTS)).cast("int")), [*on, "_fb_salt"]
        found = F.filter(F.arrays_zip("_fb_kid", "_fb_most", "_fb_least"),
                         lambda x: (x["_fb_kid"] >= least) & beyond(x["_fb_most"], x["_fb_least"]))
        df = df.join(table, on, "left").withColumn(name, F.get(found, F.lit(0))["_fb_kid"])
        return df.drop("_fb_node", "_fb_salt", "_fb_kid", "_fb_most", "_fb_least")

    found = levels.withColumn("_fb_at", F.when(F.col(threshold).isNotNull(), F.col(start)))
    for k in range(top + 1):
        found = look(found, k, F.floor(F.col("_fb_at") / tree.fan), F.col("_fb_at"), f"_fb_up{k}")
        # Where nothing was found here, the search goes on behind this node, one level up.
        found = found.withColumn("_fb_at", F.when(F.col(f"_fb_up{k}").isNull(), F.floor(F.col("_fb_at") / tree.fan) + 1))
    hit = found.drop("_fb_at")
    for k in range(top, 0, -1):
        hit = look(hit, k - 1, F.col(f"_fb_up{k}"), F.lit(-(2**62)), "_fb_down")
        hit = hit.withColumn(f"_fb_up{k - 1}", F.coalesce(f"_fb_up{k - 1}", "_fb_down")).drop("_fb_down")
    slot = F.col("_fb_up0")
    if last is not None:
        slot = F.when(F.col(last).isNull() | (slot <= F.col(last)), slot)
    return hit.select(*levels.columns, slot.alias(out))
