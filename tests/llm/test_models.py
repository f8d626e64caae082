"""Classifiers on held-out rows, license scans, token rollups and exact search."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkpulse.llm import exact_search, licenses, quality_model, token_rollup, toxicity
from linkpulse.llm.common import new_folder, table
from linkpulse.llm.held_out import labelled_sample
from linkpulse.llm.tokens import byte_bpe, default_path
from tests.llm.conftest import odd_rows

SF = "/root/testdata/sf0.01"


def joined(spark, scored, label):
    labels = table(spark, SF, "labels").groupBy("doc_id").agg(F.max(label).alias("y"))
    return scored.join(labels, "doc_id").filter("held_out AND y IS NOT NULL").toPandas()


def test_quality_held_out(spark):
    got = joined(spark, quality_model.score_quality(table(spark, SF, "documents"), table(spark, SF, "labels")), "quality")
    assert (got.predicted == got.y).mean() > 0.95
    assert got.score[got.y == 1].median() > 0.9 > 0.1 > got.score[got.y == 0].median()


def test_toxicity_held_out(spark):
    got = joined(spark, toxicity.score_toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")), "toxic")
    assert got.severity[got.y == 1].mean() > 5 * got.severity[got.y == 0].mean()
    assert got.toxic[got.y == 0].mean() < 0.05 and ((got.severity >= 0) & (got.severity <= 3)).all()


@pytest.mark.parametrize("score", [quality_model.score_quality, toxicity.score_toxicity])
def test_models_on_odd_rows(spark, odd, empty, score):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] + [(3, None, 1), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = score(odd, labels).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 3 == 1) and 0 <= r.score <= 1
    assert score(empty, labels).count() == 0
    none = labels.filter("doc_id < 0")
    assert score(odd, none).count() == len(odd_rows())
    assert score(odd, labels.filter("quality = 1 AND toxic = 0")).count() == len(odd_rows())


def test_no_label_of_a_held_out_row_is_learned(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = labelled_sample(labels, "quality", 40).collect()
    assert Counter(r.y for r in got) == {0: 40, 1: 40}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)


def test_samples_keep_the_shares_of_the_classes(spark):
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(600)], "doc_id long, quality int")
    learned = Counter(int(i % 5 > 0) for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1)
    for most in (40, 100, 1000):
        got = Counter()
        for r in labelled_sample(labels, "quality", most).collect():
            got[r.y] += r.weight
        assert got == pytest.approx(learned)


def thinned(seed):
    """Overlapping classes, nine tenths of label 1; places of as many rows of each class, and what each stands for."""
    rng = np.random.default_rng(seed)
    y = (rng.random(8000) < 0.9).astype(int)
    some = np.sort(np.concatenate([np.flatnonzero(y == 0), np.flatnonzero(y == 1)[: (y == 0).sum()]]))
    return rng, y, some, np.where(y[some] == 1, y.sum() / (y == 0).sum(), 1.0)


def test_quality_scores_do_not_depend_on_the_cap():
    rng, y, some, weight = thinned(2)
    x = y[:, None] + rng.normal(0, 1, (len(y), 2))
    score = lambda m: (1 / (1 + np.exp(-quality_model.logits(m, x)))).mean()
    whole = score(quality_model.train(x, y))
    assert abs(score(quality_model.train(x[some], y[some], weight=weight)) - whole) < 0.03
    assert score(quality_model.train(x[some], y[some])) < whole - 0.1


def test_toxicity_scores_do_not_depend_on_the_cap():
    rng, y, some, weight = thinned(3)
    y, n = 1 - y, len(y)
    ids = np.where(rng.random((n, 6)) < np.where(y == 1, 0.4, 0.15)[:, None], rng.integers(0, 20, (n, 6)), rng.integers(20, 60, (n, 6)))

    def sparse(rows):
        return np.repeat(np.arange(len(rows)), 6), ids[rows].ravel(), np.ones(6 * len(rows), int)

    score = lambda m: m.chances(n, *sparse(np.arange(n)))[:, 0].mean()
    words = np.full(n, 50)
    whole = score(toxicity.fit_ordinal(*sparse(np.arange(n)), words, y))
    assert abs(score(toxicity.fit_ordinal(*sparse(some), words[some], y[some], weight)) - whole) < 0.03
    assert score(toxicity.fit_ordinal(*sparse(some), words[some], y[some])) > whole + 0.05


def test_vectors_do_not_depend_on_the_partitions(spark, odd):
    one, many = (quality_model.word_vectors(odd.repartition(n)) for n in (1, 5))
    assert np.array_equal(one, many)


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(3)
    n = 600
    toxic = np.arange(n) % 3 == 0
    strength = np.where(toxic, rng.integers(1, 9, n), 0)
    row = np.concatenate([np.repeat(np.arange(n), 5), np.flatnonzero(toxic)])
    ids = np.concatenate([rng.integers(10, 400, 5 * n), np.full(toxic.sum(), 1)])
    count = np.concatenate([np.ones(5 * n, int), strength[toxic]])
    m = toxicity.fit_ordinal(row, ids, count, np.full(n, 50), toxic.astype(int))
    assert (np.diff(m.thresholds) > 0).all()
    p = m.chances(n, row, ids, count)
    assert (np.diff(p, axis=1) <= 0).all()
    severity = p.sum(axis=1)
    assert severity[strength >= 7].mean() > severity[(strength >= 1) & (strength <= 2)].mean() > severity[strength == 0].mean()


def test_licenses_on_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(odd).collect() if r.doc_id is not None}
    assert got[24].base_labels == "reserved" and got[24].labels == "apache-2.0,reserved" and got[24].n_base == 1
    assert [b.line for b in got[24].blocks] == [0] and got[24].first_word == 8
    assert (got[25].n_base, got[25].first_word, got[25].last_word, got[25].base_labels) == (2, 0, 2, "cc-by")
    assert got[8].n_words == 0 and got[8].first_word is None and got[8].labels == "" and got[8].score == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(odd, templates={}, phrases={}).filter("labels <> ''").count() == 0


def test_wrapped_notices_are_found(spark):
    bsd = licenses.TEMPLATES["bsd"].replace("without modification", "without\nmodification")
    cc0 = licenses.TEMPLATES["cc0"].replace("law the", "law the\n * ").replace("rights to", "rights\n * to")
    texts = ["intro\n\n" + bsd + "\n\nend", cc0, licenses.TEMPLATES["mit"].replace("the mit", "the\n\nmit"), licenses.TEMPLATES["bsd"]]
    texts += [cc0.replace("law", "law\n\n" + "other words " * 40 + "\n\n"), licenses.TEMPLATES["bsd"].replace("permitted", "\npermitted")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[i].labels for i in range(6)] == ["bsd", "cc0", "mit", "bsd", "", "bsd"]
    assert [[(b.line, b.containment) for b in got[i].blocks] for i in (0, 1, 2, 3)] == [[(2, 1.0)], [(0, 1.0)], [(0, 1.0)], [(0, 1.0)]]
    assert [(b.line, b.containment) for b in got[5].blocks] == [(0, 12 / 13), (0, 1.0)] and got[5].score == 1


def test_runs_are_the_best_windows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    for _ in range(300):
        index = licenses.TemplateIndex({"t": " ".join(rng.sample(words, 5))}, {}, 80)
        text = [w.encode() for w in rng.choices(words, k=rng.randrange(30))]
        windows = [len(set(index.ordered[0]) & set(text[i : i + index.span[0]])) for i in range(len(text))]
        best = max([n for n in windows if n >= index.needed[0]], default=None)
        assert max([held for _, _, held in index.runs(text, 0)], default=None) == best


def test_filters_lose_no_match():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    templates = {f"t{i}": " ".join(rng.sample(words, rng.randrange(3, 12))) for i in range(25)}
    frequency = {w.encode(): rng.randrange(100) for w in words}
    sets = licenses.template_words(templates)
    for percent in (60, 80, 90, 100):
        index = licenses.TemplateIndex(templates, frequency, percent)
        for _ in range(300):
            block = {w.encode() for w in rng.sample(words, rng.randrange(0, 20))}
            got = {index.names[t]: held for t, held in index.matches(block).items()}
            assert got == {n: len(s & block) for n, s in sets.items() if 100 * len(s & block) >= percent * len(s)}


def test_too_many_template_words():
    with pytest.raises(ValueError):
        licenses.template_words({"x": " ".join(f"w{i}" for i in range(licenses.MOST_TEMPLATE_WORDS + 1))})


def brute_totals(state, bpe):
    out = defaultdict(lambda: [0, 0])
    for source, lang, text in state:
        for name, n in (("byte_bpe_50k", len(bpe.whole(text or "")) // 4), ("space_words_1", len((text or "").encode().split()))):
            out[source, lang, name][0] += 1
            out[source, lang, name][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_rollup(spark, odd, empty):
    bpe, rows = byte_bpe(default_path()), odd_rows()
    state = {r[0]: (r[3], r[2], r[1]) for r in rows if r[0] is not None and r[0] != 3}
    state[3] = max(((r[3], r[2], r[1]) for r in rows if r[0] == 3), key=lambda x: (x[0] is not None, x[0]))
    loose = [(r[3], r[2], r[1]) for r in rows if r[0] is None]
    roll = token_rollup.Rollup(spark, new_folder(spark, "test"))
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in roll.totals().collect()}
    assert roll.totals().count() == 0
    assert roll.commit("1", token_rollup.upserts(odd))
    assert totals() == brute_totals([*state.values(), *loose], bpe)
    assert roll.commit("2", token_rollup.deletions(spark.createDataFrame([(0,), (6,), (999,)], "doc_id long")))
    assert roll.commit("3", token_rollup.upserts(spark.createDataFrame([(1, "new text", "en", "src9"), (0, "back", "de", None)], "doc_id long, text string, lang string, source string")))
    del state[6]
    state |= {1: ("src9", "en", "new text"), 0: (None, "de", "back")}
    want = brute_totals([*state.values(), *loose], bpe)
    assert totals() == want
    assert not roll.commit("2", token_rollup.deletions(odd)) and totals() == want
    assert roll.commit("4", token_rollup.upserts(empty)) and totals() == want


def test_broken_off_batch_counts_for_nothing(spark, odd):
    roll = token_rollup.Rollup(spark, new_folder(spark, "test"), {"words": token_rollup.size_of})
    roll.commit("1", token_rollup.upserts(odd))
    want = sorted(map(str, roll.totals().collect()))
    spark.range(1).selectExpr("1L doc_id", "'s' source", "'l' lang", "'words' tokenizer", "5L docs", "5L tokens").write.parquet(f"{roll.folder}/ledger/2")
    assert sorted(map(str, roll.totals().collect())) == want
    assert roll.commit("2", token_rollup.deletions(odd.filter("doc_id IS NOT NULL"))) and roll.totals().filter("docs < 0").count() == 0


def test_rollup_inputs(spark, odd):
    assert {r.doc_id for r in token_rollup.exact_copies(odd).collect()} == {1}
    cut = {r.doc_id: r.text for r in token_rollup.without_repeated_lines(odd).collect()}
    assert cut[26] == "line\nother"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, q int")


def brute_search(rows, k):
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = set()
    for i, v in {i: v for i, v in sorted(good, key=lambda x: (x[0], tuple(x[1])), reverse=True) if i % 50 == 0}.items():
        best = sorted(((-int(v @ w), j) for j, w in good if j != i))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [(1_024, 8_192), (2, 7)])
def test_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(exact_search, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6).astype(np.float32)]) for i in range(160)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(160, 230)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [1.0] * 6), (500, []), (550, [2.0]), (7, [9.0] * 6)]
    q = exact_search.quantized(vectors(spark, rows))
    got = exact_search.top_k(q.filter("id % 50 = 0"), q).collect()
    assert {tuple(r) for r in got} == brute_search(rows, 5) and len(got) == len({tuple(r) for r in got})


def test_search_of_few(spark):
    rows = [(0, [1.0, 2.0]), (50, [-3.0, 1.0]), (51, [-1.0, -1.0])]
    q = exact_search.quantized(vectors(spark, rows))
    assert {tuple(r) for r in exact_search.top_k(q.filter("id % 50 = 0"), q).collect()} == brute_search(rows, 5)
    none = q.filter("id < 0")
    assert exact_search.top_k(none, q).count() == 0 and exact_search.top_k(none, none).count() == 0


def test_many_places_in_a_long_text():
    """Each place counts, in time that grows with the text only."""
    import time

    from linkpulse.llm import licenses

    phrases = [(b" cc by ", "cc-by"), (b" all rights reserved ", "reserved")]
    index = licenses.TemplateIndex({}, {}, 80)
    n, began = 1_000_000, time.perf_counter()
    got = licenses.scan_text(b"x cc by " * n, index, phrases)
    assert time.perf_counter() - began < 20
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (3 * n, n, 1, 3 * n - 2)
