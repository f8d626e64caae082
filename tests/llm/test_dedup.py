"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from linkpulse.llm import common, near_dedup, repeats
from linkpulse.llm.components import components
from linkpulse.llm.words import LOWER, flat, word_hashes
from tests.llm.conftest import changed, frame, odd_rows, prose

import pyarrow as pa


def shingles(text, width):
    words = (text or "").encode().translate(LOWER.tobytes()).split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def brute_components(rows, width):
    """Least id reachable, by id; rows of one id and text count once."""
    sets = {i: shingles(t, width) for i, t, *_ in rows if i is not None}
    least = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {i: (len(sets[i]), least[i]) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, odd, width):
    got = near_dedup.near_duplicates(odd, width=width).collect()
    assert len(got) == len(odd_rows())
    want = brute_components(odd_rows(), width)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    rows = []
    for family in range(3):
        base = prose(200 + family, 120, 5000)
        rows += [(family * 1000 + i, changed(base, 10 * i + family, 0.02 + 0.12 * (i % 5) / 4), "en", "s") for i in range(60)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), width=2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2).items()}


def test_a_block_returns_a_forest():
    """Thousands of mutually near sets of labels of their own in one block: fewer links than labels."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 60)
    sets = []
    for _ in range(1500):
        own = base.copy()
        own[rng.integers(0, 60)] = rng.integers(0, 1 << 40)
        sets.append(np.unique(own))
    n = len(sets)
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))
    one = {"node": pa.array(range(n), pa.int64()), "label": pa.array(range(n), pa.int64()), "s": lists}
    t = pa.concat_tables([pa.table({"side": pa.array([side] * n, pa.int32()), **one}) for side in (0, 1)]).combine_chunks()
    got = near_dedup._block(80)(t)
    assert len(got) == n - 1
    least = list(range(n))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True):
        least[max(root(a), root(b))] = min(root(a), root(b))
    assert {root(x) for x in range(n)} == {0}


def test_keep_one(spark, odd):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    want = brute_components(odd_rows(), 5)
    assert {i for i in ids if i is not None} == {i for i, (_, c) in want.items() if i == c}
    assert max(n for i, n in ids.items() if i is not None) == 1 and ids[None] == 3


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)] + [(500, 500 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 103)} | {500 + i: 500 for i in range(40)}


def test_words_are_split_and_hashed_alike(monkeypatch):
    from linkpulse.llm import words

    texts = [t for _, t, *_ in odd_rows()]
    whole = word_hashes(*flat(pa.array(texts)))
    monkeypatch.setattr(words, "PIECE", 64)
    cut = word_hashes(*flat(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    lists = [(t or "").encode().split() for t in texts]
    assert np.diff(whole[1]).tolist() == [len(x) for x in lists]
    named = {}
    for h, w in zip(whole[0].tolist(), [w for x in lists for w in x], strict=True):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        kept = np.frombuffer(r, np.uint8)[~gone[1:-1]].tobytes()
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "most"), [(200, 20_000), (60, 2), (25, 1)])
def test_repeats(spark, odd, length, most):
    got = repeats.digest(repeats.remove_repeats(odd, length, most)).collect()
    rows = odd_rows()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], length), strict=True))
    assert Counter(tuple(r) for r in got) == want


def test_long_rows_in_pieces(monkeypatch):
    data, offsets = flat(pa.array([prose(1, 3000), "", prose(2, 50), prose(1, 3000)]))
    whole = repeats.anchors(data, offsets, 60)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    for a, b in zip(whole, repeats.anchors(data, offsets, 60), strict=True):
        assert (a == b).all()


def test_drop_repeats_keeps_columns_and_text(spark, odd):
    out = repeats.drop_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows())
    by_id = {r.doc_id: r for r in out.filter("doc_id IN (0, 8, 10, 100)").collect()}
    assert by_id[0].text == "" and by_id[0].n_chars == 0
    assert by_id[8].text is None and by_id[10].text == "one" and by_id[100].text == prose(50, 120)


def test_empty_tables(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(x in line for line in plan.split("Initial Plan")[0].splitlines() for x in ("ArrowEvalPython", "MapInArrow"))


def test_dropping_repeats_takes_one_worker_a_task(spark):
    """No Python function reads another's output: each would keep a worker of its own for every core."""
    passage = "é" + "ü" * 120 + prose(3, 60)
    rows = [(i, prose(70 + i, 30) + " x" * i + passage + prose(90 + i, 30), "en", "s") for i in range(4)] + [(9, prose(1, 50), "en", "s")]
    out = repeats.drop_repeats(frame(spark, rows))
    assert python_nodes(out) == 1
    raws = {i: t.encode() for i, t, *_ in rows}
    seen = Counter(r[i : i + 200] for r in raws.values() for i in range(len(r) - 199))
    got = {r.doc_id: r for r in out.collect()}
    for i, raw in raws.items():
        gone = {at + k for at in range(len(raw) - 199) if seen[raw[at : at + 200]] > 1 for k in range(200)}
        want = bytes(x for k, x in enumerate(raw) if k not in gone).decode("utf-8", "ignore")
        assert (got[i].text, got[i].n_chars) == (want, len(want)) and bool(gone) == (i != 9)


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 20_000)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows, b.nbytes])], ["n"]) for b in batches)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 3000, 1, 1).selectExpr("if(id < 1500, repeat('text ', 400), 'x') AS text")
    seen = [r.n for r in common.stored(texts.mapInArrow(sizes, "n long"), "sizes", small_batches=True).collect()]
    assert spark.conf.get(key) == before
    rows, most = seen[::2], max(seen[1::2])
    assert sum(rows) == 3000 and max(rows) <= common.BATCH_ROWS and most < 20_000 + 2_100
    spark.conf.set(key, "5000b")
    try:
        assert common._batch_limits(spark)[key] == "5000b"
    finally:
        spark.conf.set(key, before)
