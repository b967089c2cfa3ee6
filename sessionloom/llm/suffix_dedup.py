"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every byte that lies in a string of ``LENGTH`` (100) bytes which also starts earlier goes: earlier means a smaller id, or
the same document and an earlier start.  Strings never cross documents and are judged on the input.

* **Windows.** The start positions of all 100-byte strings are grouped by their minimizer, the core of ``CORE`` bytes with
  the smallest hash.  Equal strings have the same core at the same place, so only fragments (runs of windows with one
  core) whose core occurs twice can hold repeats.  Counts and fragments are plain aggregations and joins by hash:
  equal fragments fold into one row before they are shuffled, so a passage in a third of all documents stays small.
* **Merge.** Distinct fragments that share a core go to the same bucket.  Each shard of a bucket gets its own
  Burrows-Wheeler transform, over symbols of four bytes.  The transforms are merged by refining an interleave: step ``h``
  moves, symbol by symbol, the interleave for prefixes of ``h - 1`` symbols to that for ``h`` symbols, without looking at
  the suffixes again.  A border that first shows in step ``h`` is a common prefix of ``h - 1`` symbols; after 25 steps the
  blocks between borders are the repeated intervals of 100 bytes, and the earliest member of each is its owner.
* **Large cores.** Buckets are bounded: a core with more than ``MAX_CORE_BYTES`` of distinct fragments is split into its
  windows, which are counted by a hash of their 100 bytes, again exactly and without a hot key.
* **Removal.** A window that isn't its owner marks its bytes; marks are joined by document and cut out.

Documents equal to an earlier one fold into it first (all their bytes go if they have at least 100).  Rows equal in id
and text get the same result.  Different texts are numbered in the order of id, then digest, and the number stands for the
document from there on: texts that share an id are ordered by digest, and texts without an id come before all others.  Null
texts count as empty, texts shorter than 100 bytes lose nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import blank, written, written_dense

LENGTH, CORE, SYMBOL = 100, 40, 4
#: Bytes of fragments in one merge, in one of its shards, and of one core before it is split.
BUCKET_BYTES, SHARD_BYTES, MAX_CORE_BYTES = 1_500_000, 500_000, 8_000_000
AT_ONCE_BYTES = 1_500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_OTHER = _mixed(np.arange(301, 557, dtype=np.uint64) * _U(_BASE))


class _Hasher:
    """Hashes of any stretch of bytes from running sums of byte times power (modulo 2^64)."""

    def __init__(self, raw: np.ndarray, table: np.ndarray = _BYTE) -> None:
        up, self.down = np.full(len(raw) + 1, _BASE, np.uint64), np.full(len(raw) + 1, _INVERSE, np.uint64)
        up[0] = self.down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(self.down)
        self.sums = np.concatenate([[_U(0)], np.cumsum(table[raw] * up[:-1])])

    def all(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def fragments(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: owner, first window, windows, offset of the core, hash of the core, hash of the fragment."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sizes = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    if len(raw) < LENGTH:
        return none
    ends, span = np.cumsum(sizes), LENGTH - CORE + 1
    sums = _Hasher(raw)
    core = sums.all(CORE)
    # Smallest hash in a sliding window, equal ones by place; places take the low bits.
    bits = _U((1 << max(22, int(len(raw)).bit_length())) - 1)
    least, width = (core & ~bits) | np.arange(len(core), dtype=np.uint64), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & bits).astype(np.int64)
    inside = np.flatnonzero(np.repeat(ends, sizes)[: len(at)] - np.arange(len(at)) >= LENGTH)
    if not len(inside):
        return none
    at = at[inside]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    low, high = inside[first], inside[np.concatenate([first[1:], [len(inside)]]) - 1]
    at = at[first]
    owner = np.searchsorted(ends, low, side="right")
    whole = _mixed(sums.of(low, high + LENGTH) + (at - low).astype(np.uint64) * _U(_BASE))
    return owner, low - (ends - sizes)[owner], high - low + 1, at - low, core[at], whole


def _portions(data: list[bytes]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, d in enumerate(data):
        if size and size + len(d) > AT_ONCE_BYTES:
            yield low, i
            low, size = i, 0
        size += len(d)
    if data:
        yield low, len(data)


#: place: first window, offset of the core, windows, packed so that order by place is order by start.
_START, _OFFSET = 16, 8


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``core, whole, doc, place`` of every fragment of every text."""
    for batch in batches:
        data = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        docs = batch.column("doc")
        for low, high in _portions(data):
            owner, start, windows, offset, core, whole = fragments(data[low:high])
            place = (start << _START) | (offset << _OFFSET) | windows
            columns = [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), docs.take(pa.array(low + owner)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["core", "whole", "doc", "place"])


def _release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------------------------------------------------------------
# Merging


def symbols(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte symbols at every position of every piece (0: the end is nearer), and where pieces begin.

    A piece of n bytes has n + 1 positions, and from each the next symbol is four positions on: four strings, each with one end.
    """
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0" * SYMBOL, np.uint8).astype(np.uint32)
    n = int(sizes.sum())
    four = (raw[:n] << 24) | (raw[1 : n + 1] << 16) | (raw[2 : n + 2] << 8) | raw[3 : n + 3]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(begins[1:] - 1, sizes) - np.arange(n)
    _, ids = np.unique(np.where(left >= SYMBOL, four, 0), return_inverse=True)
    return np.where(left >= SYMBOL, ids + 1, 0), begins


def suffix_order(sym: np.ndarray) -> np.ndarray:
    """Positions of one shard in the order of their strings, ends first and by place (prefix doubling; no two strings tie in the end)."""
    n = len(sym)
    rank, reach = sym.astype(np.int64), SYMBOL
    # Ends differ from each other by place.
    rank = np.where(sym == 0, np.cumsum(sym == 0) - 1, rank + (sym == 0).sum())
    order = np.argsort(rank)
    while True:
        r = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate([[0], r[1:] != r[:-1]]))
        if dense.max(initial=0) == n - 1 or reach > 8 * LENGTH:
            return order
        ahead = np.minimum(np.arange(n) + reach, n - 1)
        # Past an end nothing is compared: ranks of strings that reached their end are already final.
        rank = dense * (n + 1) + dense[ahead]
        order, reach = np.argsort(rank), 2 * reach


def merge_blocks(shards: list[tuple[np.ndarray, np.ndarray]], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``steps`` symbols.

    ``shards``: for each its transform (the symbol before each suffix, in suffix order; 0 at the start of a string) and
    the number of its ends (suffixes of no symbol).  Returns the shard of each merged suffix, its block, and the common prefix in
    symbols with the suffix before it (``steps`` inside a block).
    """
    sizes = [len(b) for b, _ in shards]
    ends = [int(e) for _, e in shards]
    all_bwt = np.concatenate([b for b, _ in shards])
    all_bwt = all_bwt.astype(np.uint16 if all_bwt.max(initial=0) < 1 << 16 else np.uint32)
    kind = np.uint8 if len(shards) < 256 else np.uint16
    source = np.repeat(np.arange(len(shards)), sizes).astype(kind)
    head = np.repeat(np.arange(len(shards)), ends).astype(kind)
    n, k = len(source), len(head)
    block, common = np.zeros(n, np.int32), np.zeros(n, np.uint8)
    for _ in range(steps):
        before = np.empty(n, all_bwt.dtype)
        before[np.argsort(source, kind="stable")] = all_bwt
        order = np.argsort(before, kind="stable")[k:]  # strings' starts have no suffix before them
        b, g = before[order], block[order]
        source = np.concatenate([head, source[order]])
        border = np.concatenate([np.ones(min(k + 1, n), bool), (b[1:] != b[:-1]) | (g[1:] != g[:-1])])
        common += ~border  # a border stays one: this counts the steps before it
        block = np.cumsum(border, dtype=np.int32) - 1
    return source, block, common


def owners(pieces: list[bytes], shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All positions where a 100-byte string starts, as piece and offset, with the block of equal strings each is in."""
    sym, begins = symbols(pieces)
    before = np.concatenate([np.zeros(SYMBOL, sym.dtype), sym[:-SYMBOL]])
    start_of = np.repeat(begins[:-1], np.diff(begins))
    before[np.arange(len(sym)) - start_of < SYMBOL] = 0
    cuts, shards, orders = [0], [], []
    for i in range(1, len(pieces) + 1):
        if i == len(pieces) or begins[i] - begins[cuts[-1]] >= shard_bytes:
            cuts.append(i)
    for a, b in zip(cuts, cuts[1:]):
        order = suffix_order(sym[begins[a] : begins[b]])
        orders.append(order + begins[a])
        shards.append((before[orders[-1]], 4 * (b - a)))
    source, block, _ = merge_blocks(shards, LENGTH // SYMBOL)
    at = np.empty(len(source), np.int64)
    at[np.argsort(source, kind="stable")] = np.concatenate(orders)
    piece = np.repeat(np.arange(len(pieces)), np.diff(begins))[at]
    offset = at - begins[piece]
    ok = offset + LENGTH <= begins[piece + 1] - 1 - begins[piece]
    return piece[ok], offset[ok], block[ok]


_RUNS = "core long, whole long, low int, high int, owner_doc long, owner_place long"


def _merge_bucket(table: pa.Table) -> pa.Table:
    """Runs of repeated windows of the distinct fragments of one bucket, each with the earliest occurrence."""
    col = {c: table.column(c).to_numpy() for c in ("core", "whole", "doc", "place", "n")}
    # Cores one after the other, so that shards hold whole cores where they can.
    order = np.lexsort((col["whole"], col["core"]))
    col = {c: v[order] for c, v in col.items()}
    data = table.column("data").to_pylist()
    piece, offset, block = owners([data[i] for i in order])
    # Rank of a fragment's first occurrence by the place of its core: equal strings have the same offset from it.
    start = (col["place"] >> _START) + ((col["place"] >> _OFFSET) & 0xFF)
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((start, col["doc"]))] = np.arange(len(order))
    back = np.argsort(rank)
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    size = np.diff(np.concatenate([edge, [len(block)]]))
    best = np.repeat(np.minimum.reduceat(rank[piece], edge), size) if len(edge) else np.zeros(0, np.int64)
    again = (np.repeat(size, size) > 1) | (col["n"][piece] > 1)
    piece, offset, best = piece[again], offset[again], back[best[again]]
    by = np.argsort((piece << 8) + offset)
    piece, offset, best = piece[by], offset[by], best[by]
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1) | (best[1:] != best[:-1])])[: len(piece)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(piece)]]) - 1 if len(first) else first
    p, o = piece[first], best[first]
    # Start of the owner's window that equals the run's first one.
    core_at = lambda i: (col["place"][i] >> _OFFSET) & 0xFF
    begin = (col["place"][o] >> _START) + core_at(o) - core_at(p) + offset[first]
    return pa.table({"core": col["core"][p], "whole": col["whole"][p], "low": offset[first].astype(np.int32), "high": offset[last].astype(np.int32),
                     "owner_doc": col["doc"][o], "owner_place": begin})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the fragments of large cores, by two hashes of its 100 bytes."""
    for batch in batches:
        place, data = batch.column("place").to_numpy(), batch.column("data").to_pylist()
        sizes = np.array([len(d) for d in data], np.int64)
        windows = sizes - LENGTH + 1
        raw = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(data)), windows)
        low = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = low + (np.cumsum(sizes) - sizes)[row]
        keys = [pa.array(_Hasher(raw, t).of(at, at + LENGTH).view(np.int64)) for t in (_BYTE, _OTHER)]
        index = pa.array(row)
        columns = [*keys, *(batch.column(c).take(index) for c in ("core", "whole", "doc", "n")), pa.array((place >> _START)[row] + low), pa.array(low.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "core", "whole", "doc", "n", "begin", "low"])


# ---------------------------------------------------------------------------------------------------------------------
# The operator


#: An id as two columns that are never null; texts without an id come first.
_ID = ("present", "doc")


def _unique_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``present, doc, text``: each different text with its first id and its number (``digest, present, doc, number``),
    and the long ones themselves (``doc``: the number, ``text``)."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    groups = rows.groupBy(digest.alias("digest")).agg(F.min(F.struct(*_ID)).alias("first")).select("digest", "first.*")
    # A range sort, so the numbers rise with id and digest; written, so they stay.
    groups = written(groups.orderBy(*_ID, "digest").withColumn("number", F.monotonically_increasing_id()), "groups")
    texts = rows.withColumn("digest", digest).join(groups, ["digest", *_ID]).where(F.octet_length("text") >= LENGTH)
    once = Window.partitionBy("digest", *_ID).orderBy("digest")
    return groups, texts.withColumn("r", F.row_number().over(once)).where("r = 1").select(F.col("number").alias("doc"), "text")


def repeated_runs(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_core_bytes: int = MAX_CORE_BYTES) -> DataFrame:
    """Of ``doc, text``: ``doc, start, end``, stretches of bytes in 100-byte strings that start earlier elsewhere."""
    spark = texts.sparkSession
    schema = "core long, whole long, doc long, place long"
    cores = texts.mapInArrow(_occurrences, schema).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    cores = written(cores, "cores")
    _release(spark)
    found = written_dense(texts.mapInArrow(_occurrences, schema).join(cores, "core"), "occurrences")
    _release(spark)
    first = F.min(F.struct("doc", "place"))
    kinds = found.groupBy("core", "whole").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = written(kinds.select("core", "whole", "first.doc", "first.place", "n"), "fragments")
    windows = lambda place: place.bitwiseAND(0xFF)
    per_core = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum(windows(F.col("place")) + LENGTH - 1).alias("size"))
    kinds = written_dense(kinds.join(per_core, "core"), "kinds")
    _release(spark)
    # One distinct fragment: there is nothing to merge, its first occurrence owns all its windows.
    start = F.shiftright("place", _START)
    alone = kinds.where((F.col("kinds") == 1) & (F.col("n") > 1)).select(
        "core", "whole", F.lit(0).alias("low"), (windows(F.col("place")) - 1).cast("int").alias("high"), F.col("doc").alias("owner_doc"), start.alias("owner_place"))
    several = kinds.where("kinds > 1")
    data = written_dense(_with_bytes(texts, several), "data")
    _release(spark)
    total = data.where(F.col("size") <= max_core_bytes).agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("core"), F.lit(max(1, -(-int(total) // bucket_bytes))))
    merged = data.where(F.col("size") <= max_core_bytes).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_merge_bucket, _RUNS)
    large = data.where(F.col("size") > max_core_bytes).mapInArrow(_windows, "k1 long, k2 long, core long, whole long, doc long, n long, begin long, low int")
    best = large.groupBy("k1", "k2").agg(F.min(F.struct("doc", "begin")).alias("best"), F.sum("n").alias("n")).where("n > 1")
    split = large.drop("n", "doc", "begin").join(best, ["k1", "k2"]).select("core", "whole", "low", F.col("low").alias("high"), F.col("best.doc").alias("owner_doc"), F.col("best.begin").alias("owner_place"))
    runs = written(alone.unionByName(merged).unionByName(split), "runs")
    _release(spark)
    hits = found.join(runs, ["core", "whole"]).withColumn("begin", F.shiftright("place", _START) + F.col("low"))
    hits = hits.where((F.col("doc") != F.col("owner_doc")) | (F.col("begin") != F.col("owner_place")))
    return written_dense(hits.select("doc", F.col("begin").alias("start"), (F.col("begin") + F.col("high") - F.col("low") + LENGTH).alias("end")), "hits")


def _with_bytes(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds ``data``, the bytes of the first occurrence of each fragment."""
    start = F.shiftright("place", _START).cast("int")
    size = (F.col("place").bitwiseAND(0xFF) + LENGTH - 1).cast("int")
    return kinds.join(texts, "doc").select("core", "whole", "doc", "place", "n", "size", F.substring(F.col("text").cast("binary"), start + 1, size).alias("data"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        rows = []
        for text, marked in zip(texts, spans):
            data, kept, at, removed, n = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
            end = -1
            for s in sorted(marked or (), key=lambda s: s["start"]):
                if s["start"] > end:
                    kept.append(data[at : s["start"]])
                    n, removed = n + 1, removed + s["end"] - s["start"]
                elif s["end"] > end:
                    removed += s["end"] - end
                end = max(end, s["end"])
                at = end
            kept.append(data[at:])
            rows.append((len(data), removed, n, b"".join(kept)))
        sizes, removed, n, kept = zip(*rows) if rows else ((), (), (), ())
        columns = [batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, max_core_bytes: int = MAX_CORE_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    spark = docs.sparkSession
    own_id = F.col(id_col).cast("long")
    rows = docs.select(own_id.isNotNull().alias("present"), F.coalesce(own_id, F.lit(0)).cast("long").alias("doc"), blank(text).alias("text"))
    groups, texts = _unique_texts(rows)
    texts = written_dense(texts, "texts")
    _release(spark)
    hits = repeated_runs(texts, bucket_bytes, max_core_bytes)
    _release(spark)
    spans = hits.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = texts.join(spans, "doc", "left").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    cut = written(cut.select("digest", "text", "spans").mapInArrow(_cut, "digest string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "cut")
    _release(spark)
    # Short texts keep all; copies of an earlier document lose all.
    own = rows.select(*_ID, F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    firsts = groups.select("digest", F.struct(*_ID).alias("first")).join(cut, "digest", "left")
    out = own.join(firsts, "digest")
    long_enough, copy = F.col("size") >= LENGTH, F.struct(*_ID) != F.col("first")
    gone = long_enough & copy
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.when(F.col("present"), F.col("doc")).alias("doc_id"), F.col("size").alias("n_bytes"),
        F.when(gone, F.col("size")).when(long_enough, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, 1).when(long_enough, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, empty).when(long_enough, F.col("kept_sha256")).otherwise(F.col("digest")).alias("kept_sha256"),
    )
