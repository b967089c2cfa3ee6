"""Whitening: components against a library solver, exact deviations, constructed spectra, awkward rows."""
import math

import numpy as np
import pytest

from sessionloom.llm import whitening
from sessionloom.llm.queries import QUERIES


def reference(vectors):
    """Integers, mean and covariance in plain Python and long double."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    return n, exact, centred, centred.T @ centred / n


def test_query(session):
    rows = QUERIES["op11_embedding_whitening"](session, "/root/testdata/sf0.01").toPandas()
    table = session.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    n, exact, centred, v = reference([r["embedding"] for r in table])
    assert len(rows) == 8 * n and (rows.n == n).all() and rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    assert rows.dtypes["deviation"] == np.int64 and rows.dtypes["component"] == np.int32
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    rows = rows.sort_values(["component", "vec_id"])
    assert rows.deviation[rows.component == 1].tolist() == exact
    for k in range(8):
        mine = rows[rows.component == k + 1]
        want = centred @ vectors[:, k] / math.sqrt(values[k])
        got = mine.whitened.to_numpy()
        assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9 and abs(abs(got @ want) / n - 1) < 1e-9
        assert np.allclose(mine.explained, values[k] / np.trace(v), rtol=1e-10)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_spectra(d):
    rng = np.random.default_rng(d)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    m = rng.standard_normal((d, 2 * d))
    spectra = [np.logspace(0, -14, d), np.r_[np.full(d // 2, 5.0), np.full(d - d // 2, 1.0)], np.r_[1.0, np.zeros(d - 1)], 1 + 1e-13 * np.arange(d), np.zeros(d), -np.arange(d)]
    for a in [m @ m.T, np.eye(d), np.diag(np.arange(d, 0, -1.0)), *((turn * s) @ turn.T for s in spectra)]:
        a = (a + a.T) / 2
        values, vectors = whitening.eigen(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-14 * d
        assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * d * size and (np.diff(values) <= 1e-14 * size).all()
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * d * size


def test_polar_factor():
    a = np.diag([3.0, 1e-9, -2.0, -1e-13])
    assert np.allclose(whitening.polar_factor(a), np.diag([1, 1, -1, -1]), atol=1e-14)


def vectors_of(session, rows):
    return session.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, deviation int, entries int")


def test_awkward_rows(session):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 7), float(k * k % 11) / 3, 1.0]) for k in range(40)] + [(None, [1.0, 2.0, 1.0]), (5, [0.5, -2.0, 1.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [nan, 1.0, 1.0]), (94, [1.0, inf, 1.0]), (95, [1.0, -inf, 1.0]), (96, [1.0, 2.0]), (97, [3e30, 0.0, 0.0])]
    df = vectors_of(session, [(*r, "w", 1, 2) for r in good + bad])
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    rows = out.collect()
    assert len(rows) == len(good) and out.columns == ["vec_id", "embedding", "entries", "whitened", "deviation"] and model.n == len(good)
    n, exact, _, v = reference([r[1] for r in good])
    assert sorted(int(r["deviation"]) for r in rows) == sorted(exact) and np.allclose(model.covariance, v)
    # The third dimension never varies: its component has no whitened value.
    assert all(len(r["whitened"]) == 3 and r["whitened"][2] is None and r["whitened"][1] is not None for r in rows)
    assert whitening.identity_error(out, model) < 1e-9 and abs(sum(model.explained) - 1) < 1e-12
    every = whitening.components_of(df).collect()
    assert len(every) == 3 * len(good) and {r["component"] for r in every} == {1, 2, 3}
    assert sum(r["whitened"] is None for r in every) == len(good) and all(r["explained"] == 0 for r in every if r["component"] == 3)


def test_sizes(session):
    assert whitening.components_of(vectors_of(session, [])).count() == 0 and whitening.fit(vectors_of(session, [(1, None, "", 1, 1)])) is None
    one = whitening.components_of(vectors_of(session, [(1, [0.25], "", 1, 1)])).collect()
    assert [tuple(r)[:4] for r in one] == [(1, 1, 1, 0)] and one[0]["whitened"] is None and one[0]["explained"] == 0
    # Entries too large for double products stay exact.
    big = [(k, [float((-1) ** k * 2**35 + k * 2**20), float(k)], "", 1, 1) for k in range(9)]
    df = vectors_of(session, big)
    _, exact, _, _ = reference([r[1] for r in big])
    assert sorted(int(r["deviation"]) for r in whitening.whiten(df, whitening.fit(df)).collect()) == sorted(exact)
