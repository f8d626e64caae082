"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word falls into one of `BUCKETS` by its hash, and every word shape (case, symbols, digits, length, whether its
pair of words came before in the text) into one of 256. Each bucket has a fixed sparse index vector of +1 and -1. A word's vector is the sum
of the index vectors of its neighbours over the whole corpus: tasks add up their part in whole numbers, the
parts are added by bucket, and a table of BUCKETS + 256 rows remains, whatever the corpus. A document is the mean of its
words' vectors, rare words counting more, and of its shapes' vectors. On top is a network with one hidden
layer, trained by numpy on at most `SAMPLE` labelled documents of each class, each weighted by how many it stands for, whose logits are divided by a temperature
fitted on a part left out of training. Labels, language, source and id are no inputs.

Defined results: null and empty texts have the zero vector and are scored as such. Repeated rows get equal scores. An empty
table gives an empty result; without labels of both classes every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .held_out import held_out, labelled_sample
from .pieces import pieces, word_ranges
from .words import LOWER, SPACE, flat, mix, prefix_hashes, range_hashes

BUCKETS, SHAPES, DIMS, NONZERO, REACH = 4096, 256, 32, 4, 2
ROWS = BUCKETS + SHAPES
SAMPLE = 6_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 3e-3, 1e-4
RARE = 1e-3

_SYMBOL, _DIGIT, _UPPER, _LETTER, _LOUD = (np.zeros(256, bool) for _ in range(5))
_LOUD[33] = True
_SYMBOL[list(b"#*$%&|<>@=_~^/\\[]{}")] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def index_vectors() -> np.ndarray:
    """One sparse vector of +1 and -1 for each bucket and shape."""
    rng = np.random.Generator(np.random.PCG64(11))
    out = np.zeros((ROWS, DIMS), np.int16)
    for row in out:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.permutation([1, -1] * (NONZERO // 2))
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of every word, and where each row's words begin."""
    start, end, at = word_ranges(~SPACE[data], offsets)
    if not len(start):
        return start, start, at
    hashes = range_hashes(prefix_hashes(LOWER[data]), start, end)
    sums = []
    for flags in (_UPPER, _LETTER, _SYMBOL, _DIGIT, _LOUD):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags[data], out=total[1:])
        sums.append(total[end] - total[start])
    upper, letters, symbols, digits, loud = sums
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where((upper > 1) & (upper * 2 > letters), 3, 2)))
    marks = np.where(symbols > 0, 2, np.where(loud > 0, 3, np.where(letters + digits < end - start, 1, 0)))
    size = np.digitize(end - start, (3, 6, 10))
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pair = mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))
    pair[1:] = mix(pair[1:] + np.uint64(3) * hashes[:-1])
    first = np.zeros(len(pair), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    shape = case | (marks << 2) | (size << 4) | ((digits > 0) << 6) | (~first << 7)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape.astype(np.int64), at


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of all word vectors and counts."""
    index = index_vectors()
    vectors, counts = np.zeros((ROWS, DIMS), np.int64), np.zeros(ROWS, np.int64)
    for batch in batches:
        for _, data, offsets in pieces(*flat(batch.column(0))):
            word, shape, at = _tokens(data, offsets)
            if not len(word):
                continue
            own = index[word] + index[shape]
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            near = np.zeros_like(own)
            for d in range(1, REACH + 1):
                same = (row[d:] == row[:-d])[:, None]
                near[d:] += own[:-d] * same
                near[:-d] += own[d:] * same
            for kind in (word, shape):
                order = np.argsort(kind, kind="stable")
                ordered = kind[order]
                begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                vectors[ordered[begin]] += np.add.reduceat(near[order].astype(np.int32), begin, axis=0)
                counts += np.bincount(kind, minlength=ROWS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array([vectors[b].tobytes() for b in used], pa.binary())],
        ["bucket", "n", "v"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of the buckets that fell to this task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, n, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            part = np.concatenate(([n], np.frombuffer(v, np.int64)))
            sums[b] = sums[b] + part if b in sums else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([int(x[0]) for x in sums.values()], pa.int64()), pa.array([x[1:].tobytes() for x in sums.values()], pa.binary())],
        ["bucket", "n", "v"],
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vectors of all buckets and shapes from all texts, centred, of length 1 and scaled by rarity."""
    kind = "bucket int, n long, v binary"
    parts = docs.select(text_of(docs, text).alias("text")).mapInArrow(_gather, kind)
    rows = parts.repartition(F.col("bucket")).mapInArrow(_add, kind).collect()
    vectors, counts = np.zeros((ROWS, DIMS)), np.zeros(ROWS)
    for r in rows:
        vectors[r["bucket"]], counts[r["bucket"]] = np.frombuffer(r["v"], np.int64), r["n"]
    out = np.zeros((ROWS, DIMS), np.float32)
    for part in (slice(0, BUCKETS), slice(BUCKETS, ROWS)):
        n = counts[part][:, None]
        mean = vectors[part] / np.maximum(n, 1)
        mean -= (mean * n).sum(axis=0) / max(n.sum(), 1)
        length = np.linalg.norm(mean, axis=1, keepdims=True)
        share = n / max(n.sum(), 1)
        scale = RARE / (RARE + share) if part.start == 0 else 1.0
        out[part] = np.where(n > 0, mean / np.maximum(length, 1e-9) * scale, 0)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per row, the mean vector of its words and that of its shapes."""
    rows = len(offsets) - 1
    sums, words = np.zeros((rows, 2 * DIMS)), np.zeros(rows)
    for first, part, at in pieces(data, offsets):
        word, shape, begin = _tokens(part, at)
        counts = np.diff(begin)
        full = np.flatnonzero(counts)
        if len(full):
            heads = begin[:-1][full]
            both = np.concatenate([np.add.reduceat(vectors[k], heads, axis=0) for k in (word, shape)], axis=1)
            sums[first + full] += both
            words[first + full] += counts[full]
    return (sums / np.maximum(words, 1)[:, None]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, seed: int = 5, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Two layers by Adam on the weighted log loss, then the temperature on a fifth that was left out."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        bias = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
        zero = np.zeros((x.shape[1] if x.ndim == 2 else 2 * DIMS, HIDDEN))
        return {"mean": np.zeros(len(zero)), "std": np.ones(len(zero)), "w1": zero, "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.array(bias), "t": np.array(1.0)}
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64) / np.mean(weight)
    order = rng.permutation(len(y))
    hold, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = (x - mean) / std
    p = {
        "w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(()),
    }
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        fit = rng.permutation(fit)
        for i in range(0, len(fit), 128):
            part = fit[i : i + 128]
            h = np.tanh(z[part] @ p["w1"] + p["b1"])
            g = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[part]) * weight[part] / len(part)
            gh = np.outer(g, p["w2"]) * (1 - h * h)
            grads = {"w1": z[part].T @ gh + DECAY * p["w1"], "b1": gh.sum(axis=0), "w2": h.T @ g + DECAY * p["w2"], "b2": g.sum()}
            step += 1
            for k, gk in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    p |= {"mean": mean, "std": std, "t": np.array(1.0)}
    if len(hold):
        logit = logits(p, x[hold])
        loss = lambda t: np.mean(weight[hold] * (np.logaddexp(0, logit / t) - y[hold] * logit / t))
        p["t"] = np.array(min(np.geomspace(0.3, 10, 80), key=loss))
    return p


def logits(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = (x - p["mean"]) / p["std"]
    return (np.tanh(z @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]) / p["t"]


def _pool_udf(vectors: np.ndarray):
    @F.arrow_udf(T.BinaryType())
    def pool(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in pooled(*flat(texts), vectors)], pa.binary())

    return pool


def _score_udf(vectors: np.ndarray, model: dict[str, np.ndarray]):
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        out = logits(model, pooled(*flat(texts), vectors).astype(np.float64))
        return pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))), pa.float64())

    return score


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Word vectors of all texts, and the network fitted on at most 2 * `sample` labelled documents."""
    vectors = word_vectors(docs)
    chosen = labelled_sample(labels, "quality", sample)
    own = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))
    rows = own.select("doc_id", _pool_udf(vectors)("text").alias("x"), "y", "weight").toPandas()
    rows = rows.sort_values("doc_id") if len(rows) else pd.DataFrame({"x": [], "y": [], "weight": []})
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]]) if len(rows) else np.zeros((0, 2 * DIMS))
    return vectors, train(x, rows["y"].to_numpy(), weight=rows["weight"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score (likelihood of label 1) and predicted."""
    vectors, model = fit(docs, labels, sample)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), _score_udf(vectors, model)(text_of(docs)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
