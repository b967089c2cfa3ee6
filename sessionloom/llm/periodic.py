"""Periodic runs of words by online dyadic square catching.

Words are appended to a text; for every power of two ``size`` each completed block of that many words, two of them per
``size`` words, becomes a catcher for periods from over ``size / 2`` to ``size``.  Every appended word completes one
suffix per size, and exactly one catcher of that size lies at a distance of its periods: the suffix is compared with it
by a 64-bit hash that doubles from level to level.  The first match closes the catcher: its distance is the period of a
square, which is extended to the left once and to the right by every further word that repeats the one a period before.
Squares of one period that meet are one run.

Why nothing is missed: a run of four periods contains a block, not shorter than the period, whose copy a period later
lies in the run as well, and such a block occurs in the run at multiples of the period only.  So its first match is the
period itself.  Squares whose first half is a power of a shorter word belong to the run of that word and are left out.
Runs of fewer than four periods may be seen too, but not all of them are, so they aren't returned.

A match is extended by the words themselves; should a hash ever agree where words differ, the text starts over with
another seed.  Texts of a batch are appended one after the other with a symbol of its own between any two, so no run
crosses texts.  Memory is that of some 100,000 words or of the longest text.

Null and blank texts have no words and no runs.  Repeated ids are rows of their own; null ids stay null.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import blank

WORD = r"[^\x20\x09-\x0D]+"
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Words that are searched together.
BATCH_WORDS = 100_000

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split_words(text: str) -> list[str]:
    """The stretches of a text without blanks and the controls from tab to carriage return."""
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def _agreeing(text: np.ndarray, start: int, stop: int, period: int) -> int:
    """How many words from ``start`` on, up to ``stop``, are those a period later; read in growing stretches."""
    at, step = start, 64
    while at < stop:
        end = min(stop, at + step)
        differ = text[at:end] != text[at + period : end + period]
        if differ.any():
            return at + int(differ.argmax()) - start
        at, step = end, step * 4
    return stop - start


def _agreeing_back(text: np.ndarray, start: int, period: int) -> int:
    """How many words before ``start`` are those a period later."""
    at, step = start, 64
    while at > 0:
        low = max(0, at - step)
        differ = (text[low:at] != text[low + period : at + period])[::-1]
        if differ.any():
            return start - at + int(differ.argmax())
        at, step = low, step * 4
    return start


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


class Catchers:
    """Runs of a text of integers that grows at its end; ``longest`` bounds the length of a run, where it is known."""

    def __init__(self, longest: int | None = None, seed: int = 1) -> None:
        self.longest, self.seed = longest, seed
        self.text = np.zeros(0, np.int64)
        self.hashes: list[np.ndarray] = []
        self.closed: list[int] = []  # by level, the last catcher that caught
        self.seen: dict[int, list] = {}  # by period, its last run: start, end, whether the period is the smallest
        self.done: list[tuple[int, int, int]] = []
        self.open: list[list] = []  # runs that reach the end: start, period, smallest

    def append(self, words: np.ndarray) -> None:
        """All levels after these words; appending them one by one gives the same runs."""
        old, self.text = len(self.text), np.concatenate([self.text, np.asarray(words, np.int64)])
        n = len(self.text)
        self._extend(old)
        level = 0
        while True:
            size = 1 << level
            half = max(1, size // 2)
            far = 1 if level == 0 else half + 1  # the shortest period of this level
            if n < size + far or (self.longest is not None and LEAST_EXPONENT * far > self.longest):
                break
            if level == len(self.hashes):
                self.hashes.append(np.zeros(0, np.uint64))
                self.closed.append(-1)
            self._hash(level, size)
            new = np.arange(max(far, old - size + 1), n - size + 1)
            catcher = (new - far) // half * half
            h = self.hashes[level]
            hit = np.flatnonzero(h[new] == h[catcher])
            if len(hit):
                self._caught(level, size, half, catcher[hit], new[hit])
            level += 1

    def _hash(self, level: int, size: int) -> None:
        have = self.hashes[level]
        low, high = len(have), len(self.text) - size + 1
        if level == 0:
            new = _mixed(self.text[low:high].astype(np.uint64) + np.uint64(self.seed * 0x632BE59BD9B4E019 % 2**64))
        else:
            below, half = self.hashes[level - 1], size // 2
            new = _mixed(below[low:high] * np.uint64(0xD6E8FEB86659FD93) + below[low + half : high + half])
        self.hashes[level] = np.concatenate([have, new]) if low else new

    def _caught(self, level: int, size: int, half: int, catcher: np.ndarray, at: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[catcher[0] != self.closed[level]], catcher[1:] != catcher[:-1]]))
        self.closed[level] = int(catcher[-1])
        catcher, period = catcher[first], (at - catcher)[first]
        # Neighbouring catchers with one distance are of one run; the first of them finds all of it.
        lead = np.ones(len(catcher), bool)
        lead[1:] = (period[1:] != period[:-1]) | (catcher[1:] != catcher[:-1] + half)
        for s, p in zip(catcher[lead].tolist(), period[lead].tolist()):
            last = self.seen.get(p)
            if last is not None and last[0] <= s and s + p + size <= last[1]:
                continue
            more = _agreeing(self.text, s, len(self.text) - p, p)
            if more < size:
                raise _Collision
            start, end = s - _agreeing_back(self.text, s, p), s + p + more
            if last is not None and last[0] == start:
                continue
            run = self.seen[p] = [start, end, self._primitive(s, p)]
            if end == len(self.text):
                self.open.append([start, p, run])
            elif run[2]:
                self.done.append((start, end - start, p))

    def _primitive(self, s: int, p: int) -> bool:
        word = self.text[s : s + p]
        return not any((word[: p - p // q] == word[p // q :]).all() for q in _primes(p))

    def _extend(self, old: int) -> None:
        still = []
        for start, p, run in self.open:
            more = _agreeing(self.text, old - p, len(self.text) - p, p)
            run[1] = old + more
            if run[1] == len(self.text):
                still.append([start, p, run])
            elif run[2]:
                self.done.append((start, run[1] - start, p))
        self.open = still

    def runs(self, exponent: int = LEAST_EXPONENT, length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start and period."""
        every = self.done + [(start, run[1] - start, p) for start, p, run in self.open if run[2]]
        return sorted((r for r in every if r[1] >= max(length, exponent * r[2])), key=lambda r: (r[0], r[2]))


class _Collision(Exception):
    pass


def runs_of(texts: list[np.ndarray], exponent: int = LEAST_EXPONENT, length: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts of non-negative integers."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    joined = [x for k, t in enumerate(texts) for x in (t, [-1 - k])]
    longest, seed = max(map(len, texts), default=0), 1
    while True:
        catchers = Catchers(longest, seed)
        try:
            catchers.append(np.concatenate(joined) if joined else np.zeros(0, np.int64))
            break
        except _Collision:
            seed += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, n, period in catchers.runs(exponent, length):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[k].append((start - int(starts[k]), n, period))
    return out


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    if not runs:
        return " ".join(words)
    gone = bytearray(len(words))
    for start, n, period in runs:
        gone[start + period : start + n] = b"\1" * (n - period)
    return " ".join(w for w, g in zip(words, gone) if not g)


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", exponent: int = LEAST_EXPONENT, length: int = LEAST_LENGTH) -> DataFrame:
    """Per row its number of words, its runs, and the text without what repeats in a run after the first period.

    ``exponent`` (periods in a run) may not be below 4, ``length`` is in words.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"runs of fewer than {LEAST_EXPONENT} periods aren't all found")

    def searched(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        number: dict[str, int] = {}
        found = runs_of([np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in texts], exponent, length)
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in rows] for rows in found]
        columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.array(runs, _RUNS), pa.array(list(map(_collapsed, texts, found)), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, value in zip(batch.column("doc_id"), batch.column("text")):
                words = split_words(value.as_py())
                if texts and size + len(words) > BATCH_WORDS:
                    yield searched(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc.as_py())
                texts.append(words)
                size += len(words) + 1
        if texts:
            yield searched(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(text).alias("text")).mapInArrow(run, FOUND)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``: every tenth document, by the checksum of its id, repeats some of its words to its end.

    With h the crc32 of the id as text and g = floor(h / 10), where h is a multiple of 10 each word i >= a = g % n becomes
    word a + (i - a) % p, for p = 1 + floor((n - a) / (3 + g % 8)).  Null ids and texts without words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", blank("text").alias("text"), h.alias("h")).withColumn("words", words)
    rows = rows.withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    a = F.expr("g % n")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run with most periods, and checksums of all runs and of the collapsed text."""
    better = lambda a, b: (b["length"] * a["period"]) > (a["length"] * b["period"])  # noqa: E731 - runs come by start and period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    line: Column = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
