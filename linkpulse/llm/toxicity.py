"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings (4 to 8 bytes), as log(1 + count), counts
up to two. Grades run from 0 (clean) to 3. The labels say
only toxic or not, so a toxic training document gets its grade from how large a share of its words has a feature that is
frequent in toxic and rare in clean training documents: below the first third of toxic documents 1, below the
second 2, else 3. One weight vector serves all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with
theta_0 < theta_1 < theta_2. Expected severity is the sum of these three chances; a document is called toxic where
P(grade > 0) is 0.5 or more.

The model is fitted by numpy on at most `SAMPLE` labelled documents of each class, none of them held out.

Defined results: null and empty texts have no features; their severity is what the thresholds alone give. Repeated rows get equal
results. An empty table gives an empty result; without labels of both classes no document is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_of
from .held_out import held_out, labelled_sample
from .pieces import pieces, word_ranges
from .words import LOWER, flat, prefix_hashes, range_hashes

FEATURE_BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
GRADES = 3
SAMPLE = 4_000
#: Features kept: most telling first, each in at least so many toxic training documents, and so many times likelier there.
MOST_FEATURES, LEAST_DOCS, LEAST_RATIO = 16_384, 2, 3
#: A feature counts up to so many times in a document, so that a word said over and over weighs little.
MOST_TIMES = 2
EPOCHS, RATE, DECAY = 400, 0.05, 2e-3

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of every word and beginning, and the number of words of each row."""
    low = LOWER[data]
    start, end, at = word_ranges(_IN_WORD[data], offsets)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if not len(start):
        return row, start.astype(np.int64), np.diff(at)
    prefix = prefix_hashes(low)
    shift = np.uint64(64 - FEATURE_BITS)
    ids, rows = [range_hashes(prefix, start, end) >> shift], [row]
    for n in BEGINNINGS:
        long = end - start > n
        ids.append((range_hashes(prefix, start[long], start[long] + n) * np.uint64(2 * n + 1)) >> shift)
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(ids).astype(np.int64), np.diff(at)


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with counts, and words per row, of a whole column."""
    keys, words = [np.zeros(0, np.int64)], np.zeros(len(offsets) - 1, np.int64)
    for first, part, at in pieces(data, offsets):
        row, ids, n = features(part, at)
        words[first : first + len(n)] += n
        keys.append(((row + first) << FEATURE_BITS) | ids)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1), count, words


_SPARSE = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("words", T.LongType())])


@F.arrow_udf(_SPARSE)
def _sparse(texts: pa.Array) -> pa.Array:
    row, ids, count, words = counted(*flat(texts))
    at = np.searchsorted(row, np.arange(len(words) + 1))
    ids, count = ids.astype(np.uint32), np.minimum(count, 65535).astype(np.uint16)
    own = list(zip(at[:-1], at[1:], strict=True))
    return pa.StructArray.from_arrays(
        [pa.array([ids[a:b].tobytes() for a, b in own], pa.binary()), pa.array([count[a:b].tobytes() for a, b in own], pa.binary()), pa.array(words)],
        ["ids", "counts", "words"],
    )


class Ordinal:
    """Weights of the kept features and ordered thresholds."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.kept, self.weights, self.thresholds = kept, weights, thresholds

    def chances(self, rows: int, row: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row for k = 0, 1, 2."""
        value = np.zeros(rows)
        if len(self.kept) and len(ids):
            at = np.minimum(np.searchsorted(self.kept, ids), len(self.kept) - 1)
            hit = self.kept[at] == ids
            np.add.at(value, row[hit], self.weights[at[hit]] * np.log1p(np.minimum(count[hit], MOST_TIMES)))
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds[None, :], -50, 50)))


def fit_ordinal(row: np.ndarray, ids: np.ndarray, count: np.ndarray, words: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None) -> Ordinal:
    """Selects features, sets grades and fits weights and thresholds by gradient descent on the ordinal likelihood.

    `weight`: how many documents each of the rows stands for.
    """
    n, positive = len(toxic), toxic.astype(bool)
    if not n or positive.all() or not positive.any():
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.array([3.0, 5.0, 7.0]))
    size = 1 << FEATURE_BITS
    with_toxic, with_clean = (np.bincount(ids[of[row]], minlength=size) for of in (positive, ~positive))
    kept, strong = telling(np.arange(size), with_toxic, with_clean, int(positive.sum()), int((~positive).sum()))
    use = np.isin(ids, kept)
    return fit_kept(kept, strong, row[use], ids[use], count[use], words, toxic, weight)


def telling(names: np.ndarray, with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """The MOST_FEATURES most telling features in order, and which of them are frequent in toxic and rare in clean documents.

    `names` in order, with the number of toxic and of clean training documents that each is in.
    """
    p, q = (with_toxic + 0.5) / (toxic + 1), (with_clean + 0.5) / (clean + 1)
    tell = np.where(with_toxic >= LEAST_DOCS, p * np.log(p / q), -1)
    good = np.flatnonzero((tell > 0) & (p / q > LEAST_RATIO))
    good = np.sort(good[np.argsort(-tell[good], kind="stable")[:MOST_FEATURES]])
    return names[good], (p / q > 8)[good]


def fit_kept(kept: np.ndarray, strong: np.ndarray, row: np.ndarray, ids: np.ndarray, count: np.ndarray, words: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None) -> Ordinal:
    """Grades, weights and thresholds from the kept features of each row."""
    n, positive = len(toxic), toxic.astype(bool)
    r, c, v = row, np.searchsorted(kept, ids), np.log1p(np.minimum(count, MOST_TIMES))
    share = np.bincount(r, weights=np.minimum(count, 50) * strong[c], minlength=n) / np.maximum(words, 1)
    cuts = np.quantile(share[positive], [1 / 3, 2 / 3])
    grade = np.where(positive, 1 + (share[:, None] > cuts[None, :]).sum(axis=1), 0)
    above = (grade[:, None] > np.arange(GRADES)[None, :]).astype(float)
    weight = np.ones(n) if weight is None else np.asarray(weight, np.float64)
    total, of_positive = weight.sum(), weight[positive].sum()
    balance = np.where(positive, 0.5 / (of_positive / total), 0.5 / ((total - of_positive) / total))[:, None] ** 0.5 * weight[:, None]
    size = len(kept)
    w, base, gaps = np.zeros(size), 1.0, np.zeros(GRADES - 1)
    state = [np.zeros(size + GRADES) for _ in range(2)]
    for step in range(1, EPOCHS + 1):
        theta = base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(r, weights=w[c] * v, minlength=n)
        g = (1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -50, 50))) - above) * balance / total
        gw = np.bincount(c, weights=g.sum(axis=1)[r] * v, minlength=size) + DECAY * w / max(1, size) ** 0.5
        gt = -g.sum(axis=0)
        grad = np.concatenate((gw, [gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * np.exp(gaps)))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, base, gaps = w - move[:size], base - move[size], gaps - move[size + 1 :]
    return Ordinal(kept, w, base + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean documents of a task each feature is; at most 2**FEATURE_BITS rows."""
    found = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    for b in batches:
        for ids, y in zip(b["ids"].to_pylist(), b["y"].to_pylist(), strict=True):
            found[y][np.frombuffer(ids, np.uint32)] += 1
    names = np.flatnonzero(found.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found[1][names]), pa.array(found[0][names])], ["name", "toxic", "clean"])


def _only(kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's kept features alone."""
        for b in batches:
            out = []
            for ids, counts in zip(b["ids"].to_pylist(), b["counts"].to_pylist(), strict=True):
                ids, counts = np.frombuffer(ids, np.uint32), np.frombuffer(counts, np.uint16)
                use = np.isin(ids, kept)
                out.append((ids[use].tobytes(), counts[use].tobytes()))
            lists = [pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *lists, b["words"], b["y"], b["weight"]], ["doc_id", "ids", "counts", "words", "y", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model of at most `sample` labelled documents of each class.

    Their features stay in Spark: document frequencies are added up there, and only the kept features come to the driver.
    """
    chosen = labelled_sample(labels, "toxic", sample)
    own = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))
    rows = stored(own.select("doc_id", _sparse("text").alias("x"), "y", "weight").select("doc_id", "x.*", "y", "weight"), "features")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return fit_ordinal(*[np.zeros(0, np.int64)] * 5)
    each = rows.select("ids", "y").mapInArrow(_frequencies, "name long, toxic long, clean long").groupBy("name")
    likely = each.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= LEAST_DOCS).toArrow().sort_by("name")
    kept, strong = telling(*(likely[c].to_numpy() for c in ("name", "toxic", "clean")), toxic, clean)
    kind = dict(rows.dtypes)["doc_id"]
    slim = rows.mapInArrow(_only(kept), f"doc_id {kind}, ids binary, counts binary, words long, y int, weight double").collect()
    slim.sort(key=lambda r: r["doc_id"])
    ids = [np.frombuffer(r["ids"], np.uint32).astype(np.int64) for r in slim]
    row = np.repeat(np.arange(len(slim)), [len(x) for x in ids])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in slim]).astype(np.int64)
    words, y, weight = (np.array([r[c] for r in slim]) for c in ("words", "y", "weight"))
    return fit_kept(kept, strong, row, np.concatenate(ids), counts, words, y, weight)


_RESULT = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("grade", T.IntegerType())])


def _grade_udf(model: Ordinal):
    @F.arrow_udf(_RESULT)
    def grade(texts: pa.Array) -> pa.Array:
        row, ids, count, words = counted(*flat(texts))
        p = model.chances(len(words), row, ids, count)
        return pa.StructArray.from_arrays(
            [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))], ["severity", "score", "grade"]
        )

    return grade


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, severity (0 to 3, expected), score (chance of any), grade and toxic."""
    model = fit(docs, labels, sample)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), _grade_udf(model)(text_of(docs)).alias("x"))
    return scored.select("doc_id", "held_out", "x.*", (F.col("x.score") >= 0.5).alias("toxic"))
