"""Operators on vectors against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from linkpulse.llm import near_vectors, vector_codes, whitening
from linkpulse.llm.common import table
from linkpulse.llm.queries import llm_queries

SF_DIR = "/root/testdata/sf0.001"
EXTRA = "code string, n long, component int, kept boolean, p int, x string, codes string, node long"
SCHEMA = f"vec_id long, embedding array<float>, label int, {EXTRA}"
NAN, INF = float("nan"), float("inf")


def rows_of(n: int = 60, width: int = 16) -> list[tuple]:
    """(vec_id, embedding, label): random vectors, near and exact copies, ties, and all that may go wrong."""
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(n)]
    rows = [(i * 3, v, i % 4 or None) for i, v in enumerate(vectors)]
    rows += [(1000 + i, [x + rng.gauss(0, 0.01) for x in vectors[i % 5]], 1) for i in range(40)]
    rows += [(2000 + i, vectors[7], 2) for i in range(30)]
    rows += [(3000, [0.0] * width, 1), (3001, None, 1), (3002, [1.0, None] * (width // 2), 1), (3003, [NAN] * width, 1)]
    rows += [(3004, [INF] + [0.0] * (width - 1), None), (3005, [], 1), (None, vectors[3], 3), (None, None, None)]
    rows += [(9, vectors[3], 3), (9, vectors[11], None), (3006, [0.25] * (width - 5), 1), (3007, [2.0] * width, 9), (3008, [-x for x in vectors[1]], 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, False, 3, "x", "y", 4) for r in rows], SCHEMA).repartition(3)


def usable(rows):
    return [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]


def padded(rows, width=None):
    width = width or max(len(r[1]) for r in rows)
    return np.array([list(map(np.float32, r[1])) + [0.0] * (width - len(r[1])) for r in rows], np.float64)


def given(spark):
    got = table(spark, SF_DIR, "embeddings").select("vec_id", "embedding", "label").collect()
    return [tuple(r) for r in got]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = usable(rows)
    width = -(-max(len(r[1]) for r in rows) // parts) * parts
    q = np.floor(padded(rows, width) * 4096).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, q[i].tolist()))[:entries]
    cut = q.reshape(len(rows), parts, -1)
    books = [cut[order, p].copy() for p in range(parts)]

    def assign(p):
        far = ((cut[:, p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            e, _ = assign(p)
            for k in range(len(books[p])):
                if (e == k).any():
                    own = cut[e == k, p]
                    books[p][k] = [int(s) // len(own) for s in own.sum(axis=0)]
    found = [assign(p) for p in range(parts)]
    error = sum(f[1] for f in found)
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    codes = ["".join(f"{f[0][i]:02x}" for f in found) for i in range(len(rows))]
    return sorted((str(r[0]), c, int(e), total[r[2]], sha) for r, c, e in zip(rows, codes, error, strict=True))


def coded(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_of_odd_rows(spark):
    assert coded(vector_codes.code_digest(frame(spark, rows_of()))) == brute_codes(rows_of())


def test_codes_of_few_rows(spark):
    rows = rows_of()[:5] + [(70, rows_of()[0][1], None)]
    assert coded(vector_codes.code_digest(frame(spark, rows))) == brute_codes(rows)


def test_codes_of_the_given_table(spark):
    assert coded(llm_queries()["op13_vector_codes"](spark, SF_DIR)) == brute_codes(given(spark))
    rows = vector_codes.code_digest(table(spark, SF_DIR, "embeddings")).collect()
    # pivots leave distances out
    assert sum(r.tried for r in rows) < 0.9 * len(rows) * vector_codes.PARTS * vector_codes.ENTRIES


def test_nearest_keeps_the_lower_index_of_ties():
    rng = np.random.default_rng(3)
    parts, book = rng.integers(-3, 4, (500, 4)), rng.integers(-3, 4, (16, 4))
    pivots = vector_codes.choose_pivots(book, 4)
    entry, best, tried = vector_codes.nearest(parts, vector_codes.pivot_distances(parts, pivots), book, vector_codes.pivot_distances(book, pivots))
    far = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and tried < 500 * 16


def test_too_large_components(spark):
    with pytest.raises(ValueError, match="exact up to"):
        vector_codes.code_digest(frame(spark, [(1, [1e30, 0.0], 1)]))


def check_whitened(rows, got, most=16):
    rows = usable(rows)
    c = padded(rows)
    x = np.floor(c * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(rows) * k
    by_row = {}
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 * r.explained + 1e-15
        assert r.identity_error < 1e-8
        by_row.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for r, own in zip(rows, x, strict=True):
        deviation = int(((n * own.astype(object) - sums) ** 2).sum())
        found = by_row[str(r[0]), deviation]
        for j in range(k):
            want = (n * own - sums) / n @ axes[:, j] / np.sqrt(values[j])
            near = min(found[j + 1], key=lambda w: abs(abs(w) - abs(want)))
            assert abs(abs(near) - abs(want)) < 1e-7 * max(1, abs(want))
            if abs(want) > 1e-3:
                signs.setdefault(j, set()).add(near * want > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_ROWS", 9)  # many spectra, a tree of three levels
    monkeypatch.setattr(whitening, "FAN", 3)
    check_whitened(rows_of(), whitening.whiten(frame(spark, rows_of())).collect())


def test_whitening_of_the_given_table(spark):
    got = llm_queries()["op12_whitening"](spark, SF_DIR).collect()
    check_whitened(given(spark), got)


def test_spectra_without_the_last_step():
    """Rank-one updates and merges alone, held against the eigendecomposition of the whole."""
    rng = np.random.default_rng(0)
    rows = np.floor(rng.standard_normal((120, 12)) * 10)
    rows[:40, 3] = 2
    rows[60] = rows[0]
    parts = []
    for own in np.array_split(rows, 5):
        parts.append(whitening.Spectrum(12))
        for r in own:
            parts[-1].add(r)
    for other in parts[1:]:
        parts[0].merge(other)
    centred = rows - rows.mean(axis=0)
    scatter = centred.T @ centred
    s = parts[0]
    assert s.n == 120 and np.allclose(s.mean, rows.mean(axis=0))
    assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - scatter).max() < 1e-10 * np.abs(scatter).max()
    assert np.abs(s.basis.T @ s.basis - np.eye(12)).max() < 1e-12


def test_secular_roots():
    d, z2 = np.array([0.0, 1e-9, 1.0, 1.5]), np.array([0.2, 0.3, 1e-12, 0.5])
    origin, mu = whitening.secular_roots(d, z2, 2.0)
    want = np.linalg.eigvalsh(np.diag(d) + 2.0 * np.sqrt(np.outer(z2, z2)))
    assert np.allclose(d[origin] + mu, want, atol=1e-14) and (d[origin] + mu > d - 1e-15).all()


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [], 1)]])
def test_empty_vectors(spark, rows):
    assert vector_codes.code_digest(frame(spark, rows)).count() == 0
    assert whitening.whiten(frame(spark, rows)).count() == 0


def test_whitening_without_spread(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0


def brute_links(rows, threshold=0.9):
    """(id, links, least id reachable) of every row."""
    good = [i for i, r in enumerate(rows) if r[0] is not None and r in usable([r]) and any(r[1])]
    x = padded([rows[i] for i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    same = {}
    for a, i in enumerate(good):
        same.setdefault(tuple(x[a]), []).append(a)
        linked[a, a] = False
    for group in same.values():  # rounding must not part equal vectors
        linked[np.ix_(group, group)] = ~np.eye(len(group), dtype=bool)
    least = np.array([rows[i][0] for i in good])
    while True:
        near = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(least, near)
        if (new == least).all():
            break
        least = new
    out = [(r[0], 0, r[0], True) for r in rows]
    for a, i in enumerate(good):
        out[i] = (rows[i][0], int(linked[a].sum()), int(least[a]), rows[i][0] == least[a])
    return sorted(out, key=str)


def linked(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_links_of_odd_rows(spark):
    assert linked(near_vectors.near_vectors(frame(spark, rows_of()))) == brute_links(rows_of())


def families(width=24, noise=0.02, sizes=(70, 40, 3), singles=150):
    """Groups of near copies, larger than a list, among single vectors."""
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for size in sizes:
        centre = rng.standard_normal(width)
        for _ in range(size):
            rows.append((at, (centre + noise * rng.standard_normal(width)).tolist(), 1))
            at += 1
    return rows + [(at + i, v.tolist(), 2) for i, v in enumerate(rng.standard_normal((singles, width)))]


def test_large_groups_are_folded(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "LIST", 6)
    folded = []
    fold = near_vectors._Graph.fold
    monkeypatch.setattr(near_vectors._Graph, "fold", lambda self, full: folded.append(fold(self, full)) or folded[-1])
    assert linked(near_vectors.near_vectors(frame(spark, families()))) == brute_links(families())
    assert sum(x[0] for x in folded) > 80


def chain(n=400, width=8):
    """Vectors along a circle: each links with its neighbours only, none is linked with all, lists stay saturated."""
    turn = np.arange(n) * (2 * np.pi / n)
    rows = np.zeros((n, width))
    rows[:, 0], rows[:, 1] = np.cos(turn), np.sin(turn)
    return [(int((i * 37) % 1000 + 1000 * (i // 1000)), rows[i].tolist(), 1) for i in range(n)]


def test_lists_grow_and_balls_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "LIST", 5)
    monkeypatch.setattr(near_vectors, "BLOCK", 3)
    monkeypatch.setattr(near_vectors, "HUB", 8)
    rows = chain(40)
    got = near_vectors.near_vectors(frame(spark, rows))
    assert linked(got) == brute_links(rows)


def test_links_of_the_given_table(spark):
    got = llm_queries()["op11_near_vectors"](spark, SF_DIR).collect()
    want = brute_links(given(spark))
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == want
    assert {r.audited_recall for r in got} == {1.0}


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (None, [1.0, 2.0], 1), (2, [0.0, 0.0], 1)]])
def test_no_links_without_vectors(spark, rows):
    assert linked(near_vectors.near_vectors(frame(spark, rows))) == sorted(((i, 0, i, True) for i, *_ in rows), key=str)
