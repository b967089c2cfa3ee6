"""Near-duplicate classes by Order MinHash.

* **Words** are runs of ASCII letters and digits (lower-cased) and of all other non-ASCII characters.  Documents with the
  same words are collapsed first; one of them, the representative, stands for all.
* **Sketch.** Five-word shingles are labelled with their occurrence number.  Each of ``BANDS * ROWS`` hash functions takes the
  two smallest labelled shingles and keeps them in text order.  ``ROWS`` of these make one band key.  In the last ``BANDS -
  LABELLED_BANDS`` (20) bands all functions sample first occurrences, because the classes are judged by sets of shingles:
  at a set similarity of 0.8 some of them agrees with probability 0.998, at 0.3 with 0.015, however often a text repeats
  its lines.  In the ``LABELLED_BANDS`` before, one function of each samples all labels, so that repeats count as well.
* **Candidates.** Bucket members are compared with a leader, one leader per document and round, so the pairs of a round
  are at most as many as documents.  Verified links are contracted to components, and buckets with several components get
  another leader, ``STAR_ROUNDS`` times at most.  What is left is done exactly: in buckets whose members still lie in
  different components, those outside the largest one are compared with all members, in cells of about ``BLOCK`` by
  ``BLOCK`` documents and ``BLOCK_WORDS`` words on a side.  A cell counts common shingles for all its pairs, a bounded number
  of postings at a time, and returns a spanning forest of its components, so pairs never become rows.
* **Verification** aligns the two word sequences in a band of diagonals that widens with each edit.  If the aligned
  words prove a shingle similarity of 0.8 the pair is linked; if they don't, the exact Jaccard similarity of the shingle
  sets decides.
* **Classes** are the connected components of the links.

Null texts count as empty; texts without words form one class.  Texts of fewer than five words have one shingle.  The id
of a class is its smallest id.  Distinct texts are numbered, so repeated ids are rows of their own; texts without an id
are compared for equality only.  Whole texts are sketched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import blank, no_links, written
from sessionloom.functions.graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 3
#: Bands, the first ones, of which one function samples repeats too.
LABELLED_BANDS = 20
STAR_ROUNDS = 4
#: Documents and words on either side of a cell of the exact stage, and postings that it counts at a time.
BLOCK, BLOCK_WORDS, POSTINGS = 256, 400_000, 1_000_000
#: Documents sketched at a time; their words are the memory that a task needs.
AT_ONCE_CHARS = 750_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_KIND = np.zeros(256, np.uint64)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KIND[_c] = _c
for _c in range(65, 91):
    _KIND[_c] = _c + 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A strong mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(_BASE))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many each text has.

    A word's hash is the difference of two running sums of byte times power, divided by the power at its start; powers
    are modulo 2^64, where an odd base has an inverse.
    """
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    c = _KIND[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    up, down = np.full(len(c), _BASE, np.uint64), np.full(len(c), _INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * up)])
    inside = np.concatenate([[False], c != 0, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts in order, and how many each has (one for 1 to 4 words)."""
    n = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(first, n)
    end = np.repeat(first + counts, n)
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = at + k < end
        out = out * np.uint64(_BASE) + np.where(there, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(0))
    return _mixed(out), n


def _starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's shingles begin, whose each shingle is, and how many each has."""
    return np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n), n


def order_minhash(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Band keys, one row per text: the hashed Order MinHash sketch of its shingles.  All ``n`` must be positive."""
    begin, owner, n = _starts(n)
    # Occurrence labels: the rank of a shingle among the equal ones of its text.
    key = shingles ^ _mixed(owner.astype(np.uint64) + np.uint64(77))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    place = np.arange(len(key))
    rank = place - np.maximum.accumulate(np.where(same, 0, place))
    label = np.zeros(len(key), np.uint64)
    label[order] = rank.astype(np.uint64)
    elements = _mixed(shingles + label * np.uint64(0xD1342543DE82EF95))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    firsts = label == 0
    views = [(elements, begin, owner, n), (elements[firsts], *_starts(np.bincount(owner[firsts], minlength=len(n))))]
    out, keys = np.zeros((BANDS, len(n)), np.uint64), None
    for j, seed in enumerate(_SEEDS):
        elements, begin, owner, n = views[j % ROWS > 0 or j // ROWS >= LABELLED_BANDS]
        v = (elements ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(32)
        least = np.minimum.reduceat(v, begin)
        first = np.flatnonzero(v == np.repeat(least, n))
        first = first[np.concatenate([[True], owner[first][1:] != owner[first][:-1]])]
        v[first] = top
        second_value = np.minimum.reduceat(v, begin)
        second = np.flatnonzero(v == np.repeat(second_value, n))
        second = second[np.concatenate([[True], owner[second][1:] != owner[second][:-1]])]
        # In text order; a text of one shingle has it alone.
        second = np.where(n > 1, second, first)
        a, b = elements[np.minimum(first, second)], elements[np.maximum(first, second)]
        keys = _mixed(a + (b << np.uint64(1)) + np.uint64(j)) if j % ROWS == 0 else _mixed(keys * np.uint64(_BASE) + a + (b << np.uint64(1)))
        if j % ROWS == ROWS - 1:
            out[j // ROWS] = keys
    return _mixed(out + np.arange(BANDS, dtype=np.uint64)[:, None]).T


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of a bounded number of characters, one text at least."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE_CHARS:
            yield low, i
            low, size = i, 0
        size += len(t)
    if texts:
        yield low, len(texts)


def _digest(words: np.ndarray) -> str:
    return hashlib.blake2b(words.tobytes(), digest_size=16).hexdigest()


def sketches(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, digest, n_words, bands`` of every document; no bands for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in _portions(texts):
                words, counts = word_hashes(texts[low:high])
                edges = np.concatenate([[0], np.cumsum(counts)])
                digests = [_digest(words[a:b]) for a, b in zip(edges, edges[1:])]
                bands = np.zeros((len(counts), BANDS), np.int64)
                some = counts > 0
                if some.any():
                    shingles, n = shingle_hashes(words, counts[some])
                    bands[some] = order_minhash(shingles, n).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(bands[some].ravel()))
                columns = [batch.column("doc_id").slice(low, high - low), pa.array(digests), pa.array(counts.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_words", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest string, n_words long, bands array<long>")


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions and deletions that turn ``a`` into ``b``, or None above ``most``: furthest points on widening diagonals."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    far = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = far.get(k + 1, -1) if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)) else far.get(k - 1, -1) + 1
            y = x - k
            # Follow equal words in doubling strides.
            stride = 16
            while x < n and y < m:
                size = min(stride, n - x, m - y)
                differ = np.flatnonzero(a[x : x + size] != b[y : y + size])
                if len(differ):
                    x, y = x + int(differ[0]), y + int(differ[0])
                    break
                x, y, stride = x + size, y + size, stride * 2
            far[k] = x
            if x >= n and y >= m:
                return d
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences share enough shingles: by alignment if it proves so, else by their exact sets."""
    n, m = len(a), len(b)
    shorter, longer = sorted((max(n - SHINGLE + 1, 1), max(m - SHINGLE + 1, 1)))
    # Each edit touches at most five shingles of either text.
    most = int((1 - least) * longer / (2 * SHINGLE)) + 1
    if min(n, m) >= SHINGLE and (d := edits_within(a, b, min(most, 200))) is not None:
        aligned = (n + m - d) // 2 - (SHINGLE - 1) * (d + 1)
        sa, sb = _shingle_set(a), _shingle_set(b)
        # Repeated shingles could make the bound too good; it holds where both texts have none.
        if len(sa) == n - SHINGLE + 1 and len(sb) == m - SHINGLE + 1 and aligned >= least * (len(sa) + len(sb) - aligned):
            return True
    else:
        sa, sb = _shingle_set(a), _shingle_set(b)
    if min(len(sa), len(sb)) < least * max(len(sa), len(sb)):
        return False
    both = len(np.intersect1d(sa, sb, assume_unique=True))
    return both >= least * (len(sa) + len(sb) - both)


def _shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(words.astype(np.uint64), np.array([len(words)]))[0])


def _with_words(docs: DataFrame, chosen: DataFrame, text: str, id_col: str) -> DataFrame:
    """``rep`` and its words as packed 32-bit hashes, for the distinct texts in ``chosen`` (``rep, doc, digest``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in _portions(texts):
                words, counts = word_hashes(texts[low:high])
                small, edges = words.astype("<u4"), np.concatenate([[0], np.cumsum(counts)])
                digests = pa.array([_digest(words[a:b]) for a, b in zip(edges, edges[1:])])
                packed = pa.array([small[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, packed], names=["digest", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), blank(text).alias("text")).join(chosen.select("doc").distinct(), "doc", "left_semi")
    return rows.select("text").mapInArrow(run, "digest string, words binary").join(chosen.select("digest", "rep"), "digest").drop("digest").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``a, b, linked`` for pairs of representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    left = words.select(F.col("rep").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("rep").alias("b"), F.col("words").alias("wb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, linked boolean")


def near_links(docs: DataFrame, reps: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Verified links whose components are those of all similar candidate pairs; ``reps``: ``rep, doc, digest, n_words, bands``."""
    keyed = reps.select("rep", "n_words", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(keyed.join(shared, "key"), "members")
    chosen = reps.select("rep", "doc", "digest").join(members.select("rep").distinct(), "rep", "left_semi")
    words = written(_with_words(docs, chosen, text, id_col), "words")
    links = tested = no_links(docs.sparkSession)
    current = members.withColumn("comp", F.col("rep"))
    for step in range(STAR_ROUNDS):
        rank = F.xxhash64("rep", F.lit(step)).alias("rank")
        leaders = current.groupBy("key").agg(F.min(F.struct(rank, "rep", "comp")).alias("leader"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        pairs = current.join(leaders.where("low <> high").select("key", "leader"), "key").where("comp <> leader.comp")
        pairs = pairs.select(F.col("leader.rep").alias("a"), F.col("rep").alias("b"), F.col("leader.rank").alias("rank"))
        pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti") if step else pairs
        pairs = pairs.groupBy("b").agg(F.min(F.struct("rank", "a")).alias("first")).select(F.col("first.a").alias("a"), "b")
        done = written(_verified(pairs, words), f"star_{step}")
        new = done.where("linked").select("a", "b")
        tested, links = tested.unionByName(done.select("a", "b")), links.unionByName(new)
        if not new.head(1):
            break
        label = written(components(links), "label")
        current = members.join(label.select(F.col("node").alias("rep"), F.col("root").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # The rest, exactly: members outside a bucket's largest component against all members of other components.
    sizes = current.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "w")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_WORDS), F.lit(1)).cast("int")
    largest = largest.select("key", F.col("most.comp").alias("major"), blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("x_blocks"),
                             blocks(F.col("n"), F.col("w")).alias("y_blocks"))
    mixed = written(current.join(largest, "key").select("key", "rep", "comp", "major", "x_blocks", "y_blocks"), "mixed")
    place = lambda blocks: F.pmod(F.xxhash64("rep", "key"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    keep = ["key", "rep", "comp"]
    minor = mixed.where(F.col("comp") != F.col("major")).select(*keep, F.lit(True).alias("minor"), place("x_blocks").alias("x"), every("y_blocks").alias("y"))
    member = mixed.select(*keep, F.lit(False).alias("minor"), every("x_blocks").alias("x"), place("y_blocks").alias("y"))
    cells = minor.unionByName(member).join(words, "rep")
    rest = cells.groupBy("key", "x", "y").applyInArrow(_cell_links, "a long, b long")
    return links.unionByName(written(rest, "rest"))


def _cell_links(table: pa.Table) -> pa.Table:
    """Links between the minor documents and the members of one cell that join its components: at most one per document.

    Shingles in common are counted for many pairs at once, ``POSTINGS`` of them at a time.
    """
    minor = table.column("minor").to_numpy(zero_copy_only=False).astype(bool)
    rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
    docs = [np.frombuffer(w, "<u4") for w in table.column("words").to_pylist()]
    counts = np.array([len(d) for d in docs], np.int64)
    hashes, n = shingle_hashes(np.concatenate(docs).astype(np.uint64), counts)
    owner = np.repeat(np.arange(len(docs)), n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
    hashes, owner = hashes[fresh], owner[fresh]
    size = np.bincount(owner, minlength=len(docs))
    # Postings of the members, then one count for each (minor, member) pair that shares a shingle.
    xs, ys = np.flatnonzero(minor), np.flatnonzero(~minor)
    local = np.empty(len(docs), np.int64)
    local[xs], local[ys] = np.arange(len(xs)), np.arange(len(ys))
    of_x = minor[owner]
    posting = np.argsort(hashes[~of_x], kind="stable")
    member, where = local[owner[~of_x]][posting], hashes[~of_x][posting]
    low, high = np.searchsorted(where, hashes[of_x]), np.searchsorted(where, hashes[of_x], side="right")
    width, row = high - low, local[owner[of_x]]
    shared, upto = np.zeros(len(xs) * len(ys), np.int64), np.cumsum(width)
    begin = 0
    while begin < len(width):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + POSTINGS, side="right")))
        w = width[begin:end]
        at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[begin:end], w)
        shared += np.bincount(np.repeat(row[begin:end], w) * len(ys) + member[at], minlength=len(shared))
        begin = end
    shared = shared.reshape(len(xs), len(ys))
    close = shared >= SIMILARITY * (size[xs][:, None] + size[ys][None] - shared)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = parent[c]
        return c

    a, b = [], []
    for i, j in zip(*np.nonzero(close & (comp[xs][:, None] != comp[ys][None]))):
        x, y = root(int(comp[xs[i]])), root(int(comp[ys[j]]))
        if x != y:
            parent[x] = y
            a.append(rep[xs[i]])
            b.append(rep[ys[j]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, n_words, kept``; the smallest id of a class is kept."""
    rows = written(sketches(docs, text, id_col), "sketches")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    # A number for each distinct text; the written table keeps it.
    groups = written(groups.withColumn("rep", F.monotonically_increasing_id()), "groups")
    # Bands of one row per text: any copy has the same.  Texts without an id are only compared for equality.
    first = groups.where("doc is not null").select("rep", "doc", "digest")
    reps = rows.select(F.col("doc_id").alias("doc"), "digest", "n_words", "bands").join(first, ["doc", "digest"]).dropDuplicates(["rep"])
    label = written(components(near_links(docs, reps, text, id_col)), "label")
    classes = groups.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class_of", F.coalesce("root", "rep"))
    sizes = classes.groupBy("class_of").agg(F.sum("copies").alias("class_size"), F.min("doc").alias("class_id"))
    classes = written(classes.select("digest", "class_of").join(sizes, "class_of").select("digest", "class_id", "class_size"), "classes")
    out = rows.select("doc_id", "digest", "n_words").join(classes, "digest")
    return out.select("doc_id", "class_id", "class_size", "n_words", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
