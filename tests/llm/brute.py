"""Plain single-process versions that the operators are held against."""
import collections
import fractions
import hashlib
import itertools
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base_report(text):
    w, places, labels = words(text), [], set()
    for phrase, label in BASE.items():
        p = phrase.split(" ")
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def without_repeats(rows, size=100):
    """(doc_id, bytes) in order of doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    seen, out = set(), {}
    for doc, data in rows:
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            w = data[k : k + size]
            if w in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def near_classes(rows):
    """(doc_id, text) -> smallest id of the connected class at five-word Jaccard similarity 0.8."""
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where, common, parent = collections.defaultdict(list), collections.Counter(), {d: d for d in sets}
    for d, s in sets.items():
        for x in s or {()}:
            where[x].append(d)
    for docs in where.values():
        common.update(itertools.combinations(sorted(docs), 2))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a] or {()}) + len(sets[b] or {()}) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def pieces(ids, capacity=2048):
    """Token ids without the separator -> (piece, start, length, crc32)."""
    import numpy as np

    ids = [*ids, 0]
    first = len(ids) % capacity or min(len(ids), capacity)
    starts = [0, *range(first, len(ids), capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def runs(w, exponent=4, least=6):
    """Maximal stretches with smallest period q and at least max(least, exponent * q) words: (start, length, period)."""
    import numpy as np

    number, out = {}, []
    ids = np.array([number.setdefault(x, len(number)) for x in w])
    for p in range(1, len(w) // exponent + 1):
        # Words that are not those a period later, with one before the first and one after the last.
        breaks = np.concatenate([[-1], np.flatnonzero(ids[:-p] != ids[p:]), [len(ids) - p]])
        for k in np.flatnonzero(np.diff(breaks) - 1 + p >= max(least, exponent * p)).tolist():
            i, n = int(breaks[k]) + 1, int(breaks[k + 1] - breaks[k]) - 1 + p
            x = list(w[i : i + p])
            if not any(p % q == 0 and x == x[:q] * (p // q) for q in range(1, p)):
                out.append((i, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_digests(doc, text):
    """The digest columns of periodic runs after the planted edit."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found, gone = runs(w), set()
    for s, m, p in found:
        gone.update(range(s + p, s + m))
    best = max(found, key=lambda r: (fractions.Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def language_profiles(rows, size=400, longest=5):
    """(lang, text) -> lang -> n-gram -> rank, counted one by one."""
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = "_" + w + "_"
            counts[lang].update(g for k in range(1, longest + 1) for i in range(len(w) - k + 1) if (g := w[i : i + k]) != "_")
    return {lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:size])} for lang, c in counts.items()}
