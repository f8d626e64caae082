"""Vector code compression: product codes in whole numbers, with LAESA pivots.

A vector of whole components floor(SCALE * x) is cut into `PARTS` equal parts; each part position has a codebook of at most
`ENTRIES` entries, which starts as the parts of the vectors with the smallest ids. A round assigns every part to the nearest
entry (squared Euclidean distance, ties to the lower index) and moves each entry to floor(sum / count) of its parts.

The distances of every part to `PIVOTS` fixed pivots are computed once and stored with the rows. In each round the
distances of the entries to the same pivots give, by the triangle inequality, a lower bound of the distance of each part and
entry: the largest difference over the pivots. Entries are tried in the order of their bounds, and a part is done with
when the next bound is above the best distance found. Bounds only decide what is left out; every distance that counts is evaluated
in whole numbers, so codes, sums and errors are exact. The pivots are those start entries of a part position that lie
farthest from each other, chosen greedily.

A round is one pass over the stored rows that returns sums by part and entry, `PARTS * ENTRIES` rows a task, added up by Spark.
Only the codebooks, whose size is fixed, pass the driver. A lost executor costs its own tasks of the round.

Defined results: a vector that is null, empty, or holds a null, NaN or infinite component takes no part. Shorter vectors end in
zeros; so do all where the length is no multiple of `PARTS`. Rows without an id are coded like others but come last in the
order of ids; rows of one id are ordered by their vectors. Repeated rows count as often as they come. Fewer than `ENTRIES` vectors give
smaller codebooks. Null labels are one label. An empty table gives an empty result. Components beyond 2**13 raise an
error, because their squared distances need not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import bounds, floored, lists, matrix, usable

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Rows whose distances a task holds at a time.
STRIPE = 4_096
#: Part of a bound that its rounding may be off by, many times over.
SLACK = 1e-9


@dataclass
class Codes:
    """Codebooks, one matrix of entries for each part position, and the coded rows `(vec_id, label, codes, error, tried)`."""

    books: np.ndarray
    rows: DataFrame

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part to the entry in the same row."""
    apart = parts - entries
    return np.einsum("nd,nd->n", apart, apart)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every row to every pivot; exact sums under the root."""
    return np.sqrt(np.stack([squared(parts, np.broadcast_to(p, parts.shape)) for p in pivots], axis=1).astype(np.float64))


def choose_pivots(book: np.ndarray, most: int) -> np.ndarray:
    """Start entries that lie far from each other: the first, then always the one farthest from those taken."""
    taken, near = [0], squared(book, np.broadcast_to(book[0], book.shape))
    while len(taken) < most and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, squared(book, np.broadcast_to(book[taken[-1]], book.shape)))
    return book[taken + [0] * (most - len(taken))]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, book_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each part's nearest entry, its squared distance, and how many distances were evaluated for that."""
    n, tried = len(parts), 0
    bound = np.abs(to_pivots[:, None, :] - book_to_pivots[None, :, :]).max(axis=2)
    bound = np.maximum(bound - SLACK * (1 + to_pivots.max(axis=1, initial=0.0)[:, None] + book_to_pivots.max()), 0.0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best, entry = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book))
    open_rows = np.arange(n)
    for step in range(len(book)):
        # an entry may win, or tie, only if its bound is not above the best distance
        open_rows = open_rows[bound[open_rows, step] <= best[open_rows]]
        if not len(open_rows):
            break
        tried += len(open_rows)
        e = order[open_rows, step]
        d = squared(parts[open_rows], book[e])
        better = (d < best[open_rows]) | ((d == best[open_rows]) & (e < entry[open_rows]))
        best[open_rows[better]], entry[open_rows[better]] = d[better], e[better]
    return entry, best, tried


def _stripes(batches: Iterator[pa.RecordBatch], width: int, books: np.ndarray, book_to_pivots: np.ndarray):
    """(rows, parts, entry of each part, distances, evaluations) by stripes of a task's rows."""
    count, pivots = len(books), book_to_pivots.shape[2]
    for batch in batches:
        for i in range(0, len(batch), STRIPE):
            rows = batch.slice(i, STRIPE)
            parts = matrix(rows["q"], width).reshape(len(rows), count, -1)
            near = matrix(rows["to_pivots"], count * pivots, np.float64).reshape(len(rows), count, pivots)
            found = [nearest(parts[:, p], near[:, p], books[p], book_to_pivots[p]) for p in range(count)]
            yield rows, parts, [f[0] for f in found], [f[1] for f in found], sum(f[2] for f in found)


def _sums(width: int, books: np.ndarray, book_to_pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and component sums of a task's parts by part position and entry."""
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for _, parts, entries, _, _ in _stripes(batches, width, books, book_to_pivots):
            for p, e in enumerate(entries):
                np.add.at(sums[p], e, parts[:, p])
                counts[p] += np.bincount(e, minlength=books.shape[1])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), lists(sums[p, e])], ["p", "e", "n", "total"])

    return run


def _coded(width: int, books: np.ndarray, book_to_pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, entries, errors, tried in _stripes(batches, width, books, book_to_pivots):
            share = np.full(len(rows), tried // max(1, len(rows)))
            share[: tried - int(share.sum())] += 1
            columns = [rows["vec_id"], rows["label"], lists(np.stack(entries, axis=1).astype(np.int32)), pa.array(sum(errors)), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "codes", "error", "tried"])

    return run


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> Codes | None:
    """Codebooks and codes of all usable vectors; None if there are none."""
    each = vectors.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("x")).filter(usable("x"))
    n, width = bounds(each, "x")
    if not n:
        return None
    width = -(-width // PARTS) * PARTS
    whole = stored(each.select("vec_id", "label", floored("x", SCALE).alias("q")), "vectors")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    start = np.array([list(r.q) + [0] * (width - len(r.q)) for r in first], np.int64).reshape(len(first), PARTS, -1)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    pivots = np.stack([choose_pivots(b, PIVOTS) for b in books])

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts = matrix(rows["q"], width).reshape(len(rows), PARTS, -1)
            far = np.concatenate([pivot_distances(parts[:, p], pivots[p]) for p in range(PARTS)], axis=1)
            yield pa.RecordBatch.from_arrays([*rows.columns, lists(far)], [*rows.schema.names, "to_pivots"])

    kinds = dict(whole.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<long>, to_pivots array<double>"
    ready = stored(whole.mapInArrow(with_distances, schema), "pivots")
    entry_distances = lambda now: np.stack([pivot_distances(b, v) for b, v in zip(now, pivots, strict=True)])
    for _ in range(ROUNDS):
        parts = ready.select("q", "to_pivots").mapInArrow(_sums(width, books, entry_distances(books)), "p long, e long, n long, total array<long>")
        sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width // PARTS)]
        books = books.copy()
        for r in parts.groupBy("p", "e").agg(F.sum("n").alias("n"), *sums).collect():
            books[r.p, r.e] = [int(r[f"t{i}"]) // r.n for i in range(width // PARTS)]
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long, tried long"
    return Codes(books, stored(ready.mapInArrow(_coded(width, books, entry_distances(books)), schema), "codes"))


def code_digest(vectors: DataFrame) -> DataFrame:
    """Per usable row: vec_id, code, error, label_error, codebooks_sha256, and `tried`, the distances evaluated for it at last."""
    found = compress(vectors)
    if found is None:
        kinds = dict(vectors.dtypes)
        empty = f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string, tried long"
        return vectors.sparkSession.createDataFrame([], empty)
    totals = stored(found.rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = totals.select(F.col("label").alias("of_label"), "label_error")
    joined = found.rows.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"), "tried")
