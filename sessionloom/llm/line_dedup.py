"""Near-duplicate lines by a segment-partition edit join.

Lines are trimmed pieces between line ends; blank ones don't take part.  Two lines are similar within one edit per
``PER_EDIT`` (5) code points of the shorter one, ``EDITS`` (2) at most: two edits from ``SHORTEST`` (10) code points, one from 5;
under 5 an edit is more than a fifth of the line, and only equal lines are similar.  Similar lines form classes (connected components), and the first
line of a class, by document id and place, stays.

* Each line is split into one segment more than it may have edits.  Segments are indexed by a hash of length, number and content; a line
  probes the indexes of its own length and of as many code points less as the shorter line may have edits, with the few substrings at places that the edits
  left and right of a segment allow.  Two similar lines share one such key.
* Keys are shuffled once, without the lines: a key stays if it is an index key of one line and belongs to a line with another
  hash.  Only lines with such a key (a small part) are read with their content, and numbered; equal hashes of different lines add candidates, never links.
* Key groups are compared with one leader per line and round; verified links are contracted to components.  After
  ``STAR_ROUNDS`` rounds all untested pairs of index and probe whose lines still lie in different components follow.
* Letter counts that differ by more than the edits allow rule most pairs out; a bit-parallel edit distance decides on the others: one integer
  holds the band of five (one edit: three) cells of a column, and a handful of bit operations moves it on by one character.
* Equal lines are one row per digest and task before they are shuffled, and lines with over ``FREQUENT`` copies
  make keys once, so a line in a third of all documents is no hot spot.  Lines without copy or
  link take no further part.

All of it is built-in functions.  Null texts have no lines.  Repeated ids are ordered by text digest and place; rows equal in id and
text share one result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.graph import components
from sessionloom.llm.common import blank, no_links, written

EDITS, PER_EDIT = 2, 5
BLANKS = " \t\n\x0b\x0c\r"
#: From this length on lines may have all ``EDITS`` edits.
SHORTEST = EDITS * PER_EDIT
STAR_ROUNDS = 2
#: Lines with more copies than this make keys once only; others once per copy.
FREQUENT = 1000


def lines_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc, version, line, content``: all lines that aren't blank, numbered from 0 among all lines of the text."""
    # The text is hashed before it is taken apart, else it would be once per line.
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(blank(text)).alias("version"), blank(text).alias("content"))
    rows = rows.select("doc", "version", F.posexplode(F.split("content", "\n", -1)).alias("line", "content"))
    # Few lines have blanks at an end; a look at both ends is far cheaper than trimming.
    ends = [at(F.lit(c)) for at in (F.col("content").startswith, F.col("content").endswith) for c in BLANKS]
    rows = rows.withColumn("content", F.when(reduce(or_, ends), F.btrim("content", F.lit(BLANKS))).otherwise(F.col("content")))
    return rows.where("content != ''")


def allowed(n: Column) -> Column:
    """Edits that a line of ``n`` code points may have."""
    steps = F
    for edits in range(EDITS, 0, -1):
        steps = steps.when(n >= edits * PER_EDIT, F.lit(edits))
    return steps.otherwise(F.lit(0))


def _cases(edits: int) -> list[Column]:
    """Length difference, segment and shift of the probes for a shorter line of so many edits."""
    cases = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                cases.append(F.struct(F.lit(edits).alias("most"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")))
    return cases


def segment_rows(lines: DataFrame) -> DataFrame:
    """``id, key, own``: keys of each line's own segments, and of the substrings that probe lines of its length and somewhat less.

    Segments are even, the later ones longer.  Edits before the i-th are at most i, after it at most ``most - i``, which
    bounds the shift of a probe.  Each case is a row, so the key is one small expression.
    """
    every, n = [_cases(edits) for edits in range(1, EDITS + 1)], F.length("content")
    cases = F.when(n >= SHORTEST + EDITS, F.array(*every[-1])).otherwise(F.array(*sum(every, [])))
    rows = lines.where(n >= PER_EDIT).select("id", "content", n.alias("n"), F.explode(cases).alias("c"))
    rows = rows.select("id", "content", "n", "c.*").withColumn("other", F.col("n") - F.col("less")).where(allowed(F.col("other")) == F.col("most"))
    rows = rows.withColumns({"short": F.expr("int(other div (most + 1))"), "more": F.col("most") + 1 - F.col("other") % (F.col("most") + 1)})
    rows = rows.withColumns({
        "at": F.col("short") * F.col("i") + F.greatest(F.lit(0), F.col("i") - F.col("more")) + 1 + F.col("shift"),
        "size": F.col("short") + (F.col("i") >= F.col("more")).cast("int")})
    rows = rows.where((F.col("at") >= 1) & (F.col("at") + F.col("size") <= F.col("n") + 1))
    key = F.xxhash64("other", "i", F.substring("content", F.col("at"), F.col("size")))
    return rows.select("id", key.alias("key"), ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"))


def letter_counts(content: Column) -> Column:
    """How often each lower-case letter, the space, comma and full stop stand in a line."""
    return F.array(*[F.length(content) - F.length(F.replace(content, F.lit(c), F.lit(""))) for c in "etaoinsrhldcumfpgwybvkjxqz ,."])


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are within so many edits: a band of ``2 * edits + 1`` cells in one integer, moved down the diagonal.

    Bit ``i`` of a column's integers stands for row ``column - edits + i``.  The cell in the top bit is followed down its
    diagonal, then along the last row.  Strings no longer than the band are compared in full.
    """
    band, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    top = 1 << (band - 1)
    upside = lambda v: F.lit(full) - v
    start = F.struct(F.lit(full ^ (full >> (edits + 1))).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))

    def distance(s: Column) -> Column:
        x, y, n = s["x"], s["y"], s["n"]

        def step(s: Column, j: Column) -> Column:
            vp, vn, d = s["vp"], s["vn"], s["d"]

            def match(c: Column) -> Column:
                return sum((F.when(F.coalesce(F.get(x, F.when(j - edits + i >= 1, j - edits + i - 1).otherwise(-1)) == c, F.lit(False)), 1 << i).otherwise(0) for i in range(band)), F.lit(0))

            def with_match(hit: Column) -> Column:
                d0 = (((hit.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(hit).bitwiseOR(vn)).bitwiseAND(full)
                return _with(d0, lambda z: _moved(z, vp, vn, d, j, n, edits, full, top, upside))

            return _with(_with(F.get(y, j - 1), match), with_match)

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), start, step, lambda s: s["d"])

    # Characters and length are taken apart once, not once per column.
    end = _with(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("n")), distance)
    n, m = F.length(a), F.length(b)
    return F.when(F.abs(n - m) > edits, False).when(F.least(n, m) <= band, F.levenshtein(a, b) <= edits).otherwise(end <= edits)


def _with(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _moved(d0: Column, vp: Column, vn: Column, d: Column, j: Column, n: Column, edits: int, full: int, top: int, upside) -> Column:
    hp = vn.bitwiseOR(upside(d0.bitwiseOR(vp)))
    hn = d0.bitwiseAND(vp)
    # Up to the last row the followed cell goes down its diagonal, then along the row, one bit lower in each column.
    down = F.when(d0.bitwiseAND(top) != 0, 0).otherwise(1)
    bit = F.lit(edits) + n - j
    at = lambda v: F.when(bit >= 0, F.call_function("shiftright", v, F.greatest(bit, F.lit(0))).bitwiseAND(1)).otherwise(0)
    change = F.when(j + edits <= n, down).otherwise(at(hp) - at(hn))
    low = F.shiftright(d0, 1)
    return F.struct((hn.bitwiseOR(upside(low.bitwiseOR(hp)))).bitwiseAND(full).alias("vp"), low.bitwiseAND(hp).alias("vn"), (d + change).alias("d"))


def _may_match(p: str, q: str, most: Column) -> Column:
    """Whether letter counts allow two lines to be within ``most`` edits: each changes at most two counts by one."""
    apart = F.aggregate(F.zip_with(p, q, lambda u, v: F.abs(u - v)), F.lit(0), lambda s, v: s + v)
    return apart <= 2 * most


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``a, b, linked`` for pairs of distinct lines."""
    left = lines.select(F.col("id").alias("a"), F.col("content").alias("x"), F.col("letters").alias("p"))
    right = lines.select(F.col("id").alias("b"), F.col("content").alias("y"), F.col("letters").alias("q"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    most = allowed(F.least(F.length("x"), F.length("y")))
    linked = F.lit(False)
    for edits in range(1, EDITS + 1):
        linked = F.when(most == edits, within_edits(F.col("x"), F.col("y"), edits)).otherwise(linked)
    return both.select("a", "b", F.when(_may_match("p", "q", most), linked).otherwise(False).alias("linked"))


def _candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, content, letters`` of the different lines that share a key with another, and ``key, id, own, leader`` of their keys.

    Before lines have ids a 64-bit hash of the content stands for them.
    """
    hashed = lines.select(F.xxhash64("content").alias("id"), "content")
    copied = written(hashed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT).select("id"), "frequent")
    # There is at most one such hash per FREQUENT lines; their copies go before they make keys.
    rare = hashed.join(F.broadcast(copied), "id", "left_anti")
    keyed = segment_rows(rare.unionByName(hashed.join(F.broadcast(copied), "id", "left_semi").distinct()))
    same = Window.partitionBy("key")
    keyed = keyed.withColumns({"_any": F.max("own").over(same), "_low": F.min("id").over(same), "_high": F.max("id").over(same)})
    members = written(keyed.where("_any AND _low != _high").select("key", F.col("id").alias("hash"), "own").distinct(), "members")
    # The hint keeps small tables on the path of large ones; the few hashes of a partition are looked up, so the lines needn't be sorted.
    found = hashed.withColumnRenamed("id", "hash").join(members.select("hash").distinct().hint("shuffle_hash"), "hash", "left_semi").distinct()
    # Ids are fixed by the written table.
    found = written(found.select(F.monotonically_increasing_id().alias("id"), "hash", "content", letter_counts(F.col("content")).alias("letters")), "candidates")
    members = written(members.join(found.select("hash", "id"), "hash").select("key", "id", "own"), "members")
    leaders = members.where("own").groupBy("key").agg(F.min("id").alias("leader"))
    return found.select("id", "content", "letters"), members.join(leaders, "key")


def similar_links(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links ``a, b`` whose components are those of all similar lines (``content``, repeats allowed), and the ``id, content, letters`` they speak of."""
    lines, members = _candidates(lines)
    members = written(members, "led")
    links = tested = no_links(lines.sparkSession)
    current = members.withColumn("comp", F.col("id")).withColumn("leader_comp", F.col("leader"))
    for step in range(STAR_ROUNDS):
        pairs = current.where(F.col("comp") != F.col("leader_comp")).select(F.col("leader").alias("a"), F.col("id").alias("b"))
        pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti") if step else pairs
        pairs = pairs.groupBy("b").agg(F.min("a").alias("a"))
        done = written(_verified(pairs, lines), f"star_{step}")
        new = done.where("linked").select("a", "b")
        tested, links = tested.unionByName(done.select("a", "b")), links.unionByName(new)
        if not new.head(1):
            break
        label = written(components(links), "label")
        mine = label.select(F.col("node").alias("id"), F.col("root").alias("comp"))
        theirs = label.select(F.col("node").alias("leader"), F.col("root").alias("leader_comp"))
        current = members.join(mine, "id", "left").join(theirs, "leader", "left")
        current = current.withColumn("comp", F.coalesce("comp", "id")).withColumn("leader_comp", F.coalesce("leader_comp", "leader"))
    # The letter counts are part of the join's condition, so pairs that they rule out never become rows.
    current = current.join(lines.select("id", "letters", allowed(F.length("content")).alias("most")), "id")
    # A line that probes is never shorter than the one whose own segment it meets.
    own = current.where("own").select("key", F.col("id").alias("a"), F.col("comp").alias("a_comp"), F.col("letters").alias("p"), "most")
    rest = own.join(current.select("key", F.col("id").alias("b"), "comp", F.col("letters").alias("q"), F.col("own").alias("b_own")), "key")
    # Two own segments meet in either order: one is enough.
    rest = rest.where((F.col("a_comp") != F.col("comp")) & ~(F.col("b_own") & (F.col("a") > F.col("b"))) & _may_match("p", "q", F.col("most")))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ordered = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(_verified(rest.join(ordered, ["a", "b"], "left_anti"), lines), "rest")
    return links.unionByName(rest.where("linked").select("a", "b")), lines


def line_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per line: ``doc_id, line, class_doc, class_line, class_size, kept``; the class is named by its first line."""
    rows = lines_of(docs, text, id_col)
    links, candidates = similar_links(rows.select("content"))
    digest, place = F.unhex(F.sha2("content", 256)).alias("digest"), F.struct("doc", "version", "line")
    label = components(links).select(F.col("node").alias("id"), "root")
    linked = written(candidates.select("id", digest).join(label, "id").select("digest", "root"), "linked")
    placed = rows.select("doc", "version", "line", digest)
    copies = placed.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    copies = written(copies.join(linked, "digest", "left").where("copies > 1 OR root IS NOT NULL"), "copies")
    sizes = copies.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    named = copies.join(sizes, "root", "left").select("digest", F.coalesce("head", "first").alias("head"), F.coalesce("class_size", "copies").alias("class_size"))
    out = placed.join(written(named, "named"), "digest", "left").withColumn("head", F.coalesce("head", place))
    kept = place.eqNullSafe(F.col("head"))
    return out.select(F.col("doc").alias("doc_id"), "line", F.col("head.doc").alias("class_doc"), F.col("head.line").alias("class_line"),
                      F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), kept.alias("kept"), "version")


def without_repeated_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``text`` with the lines that stay; texts that lose all their lines become empty."""
    classes = line_classes(docs, text, id_col).where("kept").select(F.col("doc_id").alias("doc"), "version", "line").distinct()
    kept = classes.groupBy("doc", "version").agg(F.collect_set("line").alias("lines")).withColumnRenamed("doc", "kept_doc").withColumnRenamed("version", "kept_version")
    rows = docs.select(F.col(id_col).alias("doc_id"), blank(text).alias("text")).withColumn("v", F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_doc")) & (F.col("v") == F.col("kept_version")), "left")
    left = F.filter(F.split("text", "\n", -1), lambda s, i: F.array_contains(F.col("lines"), i))
    return rows.select("doc_id", F.coalesce(F.array_join(left, "\n"), F.lit("")).alias("text"))
