"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of one to five letters, in the order of their frequency.  Words are stretches of
letters in lower case between boundary marks.  The profile of a language comes from all its labelled texts: each task
counts words by language, Spark adds them up, cuts them into n-grams and ranks these.  A document's own profile is
compared with each language's by the out-of-place distance: for each n-gram of the document the difference of its two
ranks, or the size of a profile where the language lacks it.  The nearest language is predicted, the first by name on ties.

The score is one minus the ratio of the smallest distance to the second smallest: 0 where two languages are equally near,
towards 1 where only one is.  With one language, the distance of a text without any common n-gram takes the second's place.

Null texts, texts without letters, and all texts where nothing was learned are ``und`` with score 0.  Equal counts are
ordered by the n-gram in languages and by a 64-bit hash of it in documents, so reruns agree.  Whole texts of any length
are read.  Repeated ids are rows of their own; a null id has the checksum of the empty text.  The profiles are collected:
``PROFILE`` rows for each language, of which there may be ``MOST_LANGUAGES``; more are an error, never dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import blank, free_name

PROFILE = 400
LONGEST_GRAM = 5
MOST_LANGUAGES = 5_000
UNKNOWN = "und"
#: Words a task counts before it hands them on.
HELD_WORDS = 300_000

_WORD, _BETWEEN = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]+")
_PREDICTED = "lang_pred string, score double"


def letter_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(word: str, longest: int = LONGEST_GRAM) -> list[str]:
    """All n-grams of a word with its boundaries, but for the boundary alone."""
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, longest + 1) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


def _grams_column(word: str, longest: int) -> Column:
    """The same n-grams as a column expression, in time proportional to the length of the word."""
    chars = f"split(concat('_', {word}, '_'), '')"
    n_grams = "transform(sequence(1, size(c) + 1 - n), i -> array_join(slice(c, i, n), ''))"
    every = f"flatten(transform(sequence(1, {longest}), n -> if(size(c) < n, array(), {n_grams})))"
    # A transform over one array names the characters once.
    return F.expr(f"filter(transform(array({chars}), c -> {every})[0], g -> g <> '_')")


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """How often each word stands in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def held() -> Iterator[pa.RecordBatch]:
            for language, words in counts.items():
                columns = [pa.array([language] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for language, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counts.setdefault(language, Counter()).update(letter_words(value.as_py()))
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield from held()
        yield from held()

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE, longest: int = LONGEST_GRAM) -> DataFrame:
    """The first ``size`` n-grams of each language with their rank from 0."""
    counted = word_counts(docs, text, lang).select("lang", F.explode(_grams_column("word", longest)).alias("gram"), "n")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Each task passes on its own first rows only.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that are one character longer."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes
    return h ^ (h >> np.uint64(32))


def _number(gram: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in _codes(gram):
        h = _longer(h, c)
    return int(h.view(np.int64)[0])


def gram_numbers(text: str, longest: int = LONGEST_GRAM) -> np.ndarray:
    """64-bit hashes of all n-grams of all words of a text; none where it has no word."""
    words = _BETWEEN.sub("_", text.lower()).strip("_")
    if not words:
        return np.zeros(0, np.int64)
    codes = _codes(f"_{words}_")
    mark, h, out = codes == ord("_"), np.zeros(len(codes), np.uint64), []
    whole = ~mark  # a boundary alone is no n-gram, longer ones may have it at their ends only
    for n in range(1, min(longest, len(codes)) + 1):
        h = _longer(h[: len(codes) - n + 1], codes[n - 1 :])
        if n == 2:
            whole = np.ones(len(h), bool)
        elif n > 2:
            whole = whole[: len(h)] & ~mark[n - 2 : len(codes) - 1]
        out.append(h[whole])
    return np.concatenate(out).view(np.int64)


class Model:
    """Ranks of n-grams by language; small and the same for every task."""

    def __init__(self, rows: list[tuple[str, str, int]], size: int = PROFILE, longest: int = LONGEST_GRAM) -> None:
        self.languages, self.size, self.longest = sorted({lang for lang, _, _ in rows}), size, longest
        self.known = np.array(sorted({_number(gram) for _, gram, _ in rows}), np.int64)
        self.ranks = np.full((len(self.languages), len(self.known)), -1, np.int32)
        if rows:
            place = {lang: k for k, lang in enumerate(self.languages)}
            at = np.searchsorted(self.known, np.array([_number(gram) for _, gram, _ in rows], np.int64))
            self.ranks[[place[lang] for lang, _, _ in rows], at] = [rank for _, _, rank in rows]

    def distances(self, text: str) -> tuple[np.ndarray, int]:
        """Out-of-place distance to each language, and the largest there could be."""
        every = gram_numbers(text, self.longest)
        if not len(every):
            return np.zeros(len(self.languages)), 0
        every.sort()
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        number, count = every[starts], np.diff(np.append(starts, len(every)))
        if len(number) > self.size:
            # All n-grams as frequent as the last one of the profile, then by count; the sort is stable in the hash.
            least = -np.partition(-count, self.size - 1)[self.size - 1]
            number, count = number[count >= least], count[count >= least]
        number = number[np.argsort(-count, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.known, number), len(self.known) - 1)
        theirs = self.ranks[:, at]
        absent = (theirs < 0) | (self.known[at] != number)
        return np.where(absent, self.size, np.abs(theirs - np.arange(len(number)))).sum(axis=1), self.size * len(number)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        distance, most = self.distances(text)
        if not most:
            return self.languages[0], 0.0  # letters that make no word, such as those of joined signs
        best = int(distance.argmin())
        second = np.delete(distance, best).min() if len(distance) > 1 else most
        return self.languages[best], float(1 - distance[best] / second) if second else 0.0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE, longest: int = LONGEST_GRAM) -> Model:
    """Profiles of all non-null languages of the given documents."""
    rows = profiles(docs, text, lang, size, longest).limit(MOST_LANGUAGES * size + 1).collect()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"over {MOST_LANGUAGES} languages: the column doesn't hold language names")
    return Model([tuple(r) for r in rows], size, longest)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept = docs.drop("lang_pred", "score")
    name = free_name(kept, "text_to_read")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(value.as_py()) for value in batch.column(name)]
            columns = [batch.column(c) for c in names] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.withColumn(name, blank(text)).mapInArrow(run, f"{schema}, {_PREDICTED}" if schema else _PREDICTED)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
