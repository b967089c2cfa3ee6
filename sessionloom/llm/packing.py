"""Best-fit packing of token pieces into sequences of a fixed capacity.

Texts are tokenised in Arrow batches; each document's ids end with one separator id.  Documents longer than the
capacity are cut into pieces of exactly the capacity, the first of them shorter.  Packing moves sizes only, never ids:

* Each partition packs its pieces by best fit (longest first) on its own.  Nearly full bins are final.
* Underfull bins become the items of the next round: they are dealt into fewer groups, packed again whole, and so on up
  a tree, until one group holds all that is left.
* A group passes on at most half of the items it got, its emptiest bins; fuller ones are final.  So a group never holds
  more than ``group_items`` items, rounds are at most the logarithm of the rows, and no row is ever left out.

Every round is a written table, so ids of bins stay as they are when an executor is lost.  Null texts count as empty:
they have the separator only.  Repeated ids are rows of their own.  An empty table packs into nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import blank, written

CAPACITY = 2048
SEPARATOR = 0
#: Bins at least this full are final at once.
NEARLY_FULL = 0.99
GROUP_ITEMS = 100_000

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary file (``tokenizers`` JSON whose ids are the merge ranks).

    The ids are those of the file's own library, special tokens included; the encoder is built from the file's
    vocabulary because it is several times faster on one thread.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        # Such files write each byte as one printable character: itself, or the next free one from 256 on.
        as_byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern engine refuses runs of several hundred thousand white-space characters
            return np.array(_library(self.path).encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place, length and checksum; ``item`` numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer)
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, owners = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(coder.ids(text), SEPARATOR).astype("<u4")
                n = len(ids)
                starts = [0, *range(n % capacity or min(n, capacity), n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((item, k, a, b - a, zlib.crc32(ids[a:b])))
                    owners.append(row)
                    item += 1
            if rows:
                item_ids, piece, start, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows))
                names = ["item", "doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([item_ids, batch.column("doc_id").take(pa.array(owners)), piece.cast(pa.int32()), start, length, crc], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(text).alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and offset, and the fill of each bin."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set while a bin with r places left exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left - size:
            room[left - size].append(b)
            free |= 1 << (left - size)
    return bins, offsets, np.array(fills, dtype=np.int64)


def _pack_partition(capacity: int, level: int, final: bool, nearly: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        bins, offsets, fills = best_fit(rows["length"].to_numpy(), capacity)
        open_bins = np.flatnonzero(fills < nearly * capacity)
        most = 0 if final else len(rows) // 2
        passed = np.zeros(len(fills), bool)
        passed[open_bins[np.argsort(fills[open_bins], kind="stable")[:most]]] = True
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        rows["bin"], rows["shift"], rows["fill"], rows["done"] = base + bins, offsets, fills[bins], ~passed[bins]
        yield rows

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``item`` (unique) and ``length``."""
    extra = "bin long, shift long, fill long, done boolean"
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    first = written(pieces.mapInPandas(_pack_partition(capacity, 0, False, nearly_full), f"{schema}, {extra}"), "round_0")
    place = lambda df: df.select(*columns, F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
    done, level, held = [place(first.where("done"))], 0, first.where(~F.col("done"))
    bins = held.groupBy("bin").agg(F.max("fill").alias("length"))
    while left := bins.count():
        level += 1
        final = left <= group_items
        groups = bins.repartition(1 if final else -(-left // group_items))
        packed = groups.withColumnRenamed("bin", "old").mapInPandas(_pack_partition(capacity, level, final, nearly_full), f"old long, length long, {extra}")
        moved = written(packed, f"round_{level}")
        steps = moved.select("old", F.col("bin").alias("into"), F.col("shift").alias("by"), F.col("fill").alias("total"), F.col("done").alias("closed"))
        held = held.join(steps, held["bin"] == steps["old"]).select(
            *columns, F.col("into").alias("bin"), (F.col("shift") + F.col("by")).alias("shift"), F.col("total").alias("fill"), F.col("closed").alias("done"))
        held = written(held, f"held_{level}")
        done.append(place(held.where("done")))
        held = held.where(~F.col("done"))
        bins = held.groupBy("bin").agg(F.max("fill").alias("length"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All pieces of all documents with their sequence and offset."""
    pieces = written(token_pieces(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity).drop("item")
