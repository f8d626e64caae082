"""Quality rules, mixing and packing."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkpulse.llm import mixing, packing, quality_rules
from linkpulse.llm.tokens import byte_bpe, default_path
from tests.llm.conftest import frame, odd_rows, prose


def test_rules_on_odd_rows(spark, odd):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].n_words == 0 and by_id[8].base_failed and by_id[7].base_failed
    assert by_id[14].n_repeat_words == 120 and by_id[14].base_failed
    assert by_id[26].n_dup_lines == 2 and by_id[17].word_chars == 300
    assert by_id[23].n_symbols == 640 and not by_id[23].kept
    assert by_id[100].kept and by_id[0].kept


def test_keep_good_returns_the_rows(spark, odd):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    want = sorted(str(r.doc_id) for r in quality_rules.quality_rules(odd).filter("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_sketches_merge(spark, odd):
    m = quality_rules.measure(odd).drop("text").cache()
    whole = quality_rules.sketches(m)
    parts = quality_rules.sketches(m.filter("pmod(coalesce(doc_id, 0), 2) = 0")).unionByName(quality_rules.sketches(m.filter("pmod(coalesce(doc_id, 0), 2) = 1")))
    keys = ["lang", "source", "measure", "bin"]
    merged = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(str, whole.select(*keys, "n").collect())) == sorted(map(str, merged.select(*keys, "n").collect()))


def filled(sizes, weights, share=1.5):
    """Targets by resharing the excess again and again."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 2 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def check_mix(rows, got):
    sources, texts = {r[0]: r[3] for r in rows}, {r[0]: len((r[1] or "").encode().split()) for r in rows}
    size = lambda t: len((t or "").encode().split())
    own = defaultdict(int)
    for r in rows:
        own[r[3]] += size(r[1])
    order = sorted(own, key=lambda s: (s is None, s))
    want = dict(zip(order, filled([own[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        s = sources[r.doc_id] if r.doc_id is not None else next(k for k, v in own.items() if v == r.source_size)
        assert r.source_size == own[s] and r.target == pytest.approx(want[s])
        assert r["size"] == texts[r.doc_id] if r.doc_id is not None else True
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.taken == r["size"] * len([x for x in r.shards.split(",") if x])
        taken[s] += r.taken
    return {s: (want[s], taken[s]) for s in order}


def test_mix_of_odd_rows(spark, odd):
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = odd.filter("doc_id IS NOT NULL")
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    check_mix([r for r in rows], [r for r in got if r.doc_id != 3])
    again = mixing.mix_sizes(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_are_met(spark):
    rows = [(i, prose(i, 20 + i % 60), "en", f"s{i % 7}" if i % 3 else "s0") for i in range(500)]
    result = check_mix(rows, mixing.mix_sizes(frame(spark, rows)).collect())
    for want, taken in result.values():
        assert abs(want - taken) <= 5


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 120)
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 4)
    rows = [(i, prose(i, 10 + i % 40), "en", f"s{i % 4}" if i % 2 else "s0") for i in range(600)]
    docs = frame(spark, rows)
    for want, taken in check_mix(rows, mixing.mix_sizes(docs).collect()).values():
        assert abs(want - taken) <= 40
    out = mixing.mix(docs, shards=4)
    # the shards that the sizes name are those that the documents are in
    named = sorted((r.doc_id, x) for r in mixing.mix_sizes(docs, shards=4).collect() for x in r.shards.split(",") if x)
    assert named == sorted((r.doc_id, str(r["__shard"])) for r in out.collect())
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    sizes = {r.doc_id: r for r in mixing.mix_sizes(docs).collect()}
    assert {i: r.taken // r["size"] for i, r in sizes.items() if r.taken} == counts
    assert out.select("__shard").distinct().count() == 4 and out.drop("__shard").columns == docs.columns


def test_sizes_come_from_the_tree(spark, monkeypatch):
    """A tree that loses a block loses its words."""
    rows = [(i, prose(i, 30), "en", "s0") for i in range(40)]
    whole = mixing.mix_sizes(frame(spark, rows)).agg(F.sum("taken")).first()[0]
    places = mixing.places
    monkeypatch.setattr(mixing, "places", lambda quotas, parts: places(quotas, parts).filter("place > 0"))
    assert mixing.mix_sizes(frame(spark, rows)).agg(F.sum("taken")).first()[0] < whole


def test_splitting_keeps_quotas(spark):
    goal = spark.createDataFrame([("a", 3, 10, 1, 0.0, 50), ("b", 0, 7, 2, 1.0, 9), (None, 1, 4, 0, 0.0, 5)], "source string, passes long, blocks long, cut long, missing double, source_size long")
    parts = mixing.split_tree(goal, 8).collect()
    total = defaultdict(int)
    for p in parts:
        assert p.k >= 0
        total[p.key] += p.k
    assert total == {"sa": 31, "sb": 3, "~": 4}
    shard = defaultdict(int)
    for p in parts:
        shard[p.shard] += p.k
    assert max(shard.values()) - min(shard.values()) <= 1


def test_hypergeometric(spark):
    draws = spark.range(20_000).select(
        mixing.hypergeometric(F.lit(60).cast("long"), F.lit(18).cast("long"), F.lit(20).cast("long"), (F.col("id") + 0.5) / 20_000).alias("x")
    )
    got = {r.x: r["count"] / 20_000 for r in draws.groupBy("x").count().collect()}
    from math import comb

    for x in range(19):
        assert got.get(x, 0) == pytest.approx(comb(18, x) * comb(42, 20 - x) / comb(60, 20), abs=2e-4)


def check_packed(rows, got, capacity=2048):
    bpe = byte_bpe(default_path())
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(bpe.whole(r[1] or "") + b"\0\0\0\0")
    pieces, bins = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        bins[p.sequence_id].append((p.offset, p.length))
    for doc, encoded in texts.items():
        want = sorted(
            (k, a, b - a, zlib.crc32(e[4 * a : 4 * b]))
            for e in encoded
            for n in [len(e) // 4]
            for edges in [[0, *range((n - 1) % capacity + 1, n + 1, capacity)]]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        )
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces[doc]) == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(p.length for p in got)
    return len(bins), -(-total // capacity)


def test_packing_odd_rows(spark, odd):
    check_packed(odd_rows(), packing.digest(packing.pack(odd)).collect())


def test_packing_over_many_partitions(spark):
    rows = [(i, prose(i, 1 + (i * 37) % 300), "en", "s") for i in range(400)]
    bins, least = check_packed(rows, packing.digest(packing.pack(frame(spark, rows).repartition(70))).collect())
    assert bins <= least * 1.1 + 1  # six documents a partition: bins are all that meet


def test_bins_over_half_full_do_not_gather_in_one_task(spark, monkeypatch):
    rows = [(i, "a " * (257 + i * 7 % 180), "en", "s") for i in range(900)] + [(900 + i, "a " * (30 + 3 * i), "en", "s") for i in range(12)]
    largest, stored = [], packing.stored

    def spied(df, name, *args):
        out = stored(df, name, *args)
        if name == "moves":
            largest.append(out.groupBy("node").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(packing, "stored", spied)
    got = packing.digest(packing.pack(frame(spark, rows).repartition(20), capacity=512)).collect()
    bins, _ = check_packed(rows, got, 512)
    assert bins == 900  # the short ones find room beside the others
    assert len(largest) > 1 and max(largest) <= packing.FAN_IN * (packing.FAN_IN**2 + 1)


def test_best_fit():
    sizes = np.random.default_rng(1).integers(1, 100, 500).tolist()
    bins, offsets, free = packing.best_fit(sorted(sizes, reverse=True), 100)
    assert all(f >= 0 for f in free) and sum(free) == len(free) * 100 - sum(sizes) and len(offsets) == 500 == len(bins)


def test_empty_tables(spark, empty):
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.keep_good(empty).count() == 0
    assert mixing.mix_sizes(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.pack(empty).count() == 0
