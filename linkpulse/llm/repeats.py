"""Exact repeated passages: every byte that a string of `length` bytes covers which also starts somewhere else.

The corpus is too large for one suffix array, so it is cut where equal passages must meet. In every window of `length` bytes the
k-mer with the least hash is its anchor; equal windows have equal anchors at equal places. Around each anchor lies
the segment with all windows that it can anchor. Anchors seen once are done: nothing there repeats. Equal segments
are counted, not copied. Where an anchor has different segments, they are indexed:

The index is the Burrows-Wheeler transform of the segments, aligned at their anchors and kept apart by anchor (a
positional transform): at each column, from right to left, the segments stand in the order of what follows. The
column's letters in that order form runs. Inside a run the match length with the neighbour above is the one of the column to the right plus one;
only at run heads, where the sampled segments are, two segments are compared. So matching statistics stream
from column to column, and comparisons fall with the number of runs. Nothing is stored compressed: a task holds its segments whole, and
orders all of them at every column. A window repeats if its match with a neighbour
above or below reaches `length`.

Anchors with more than `MOST_SEGMENTS` different segments (a passage in a large part of all documents, each time in other
words) go another, also exact, way, which needs no group in one task: their windows are hashed and counted by key.

Defined results: null and empty texts have no bytes and lose none. Rows with equal texts are repeats of each other. Rows without an id,
or with equal ids, are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_of
from .words import flat, mix, prefix_hashes, range_hashes

LENGTH = 200
MOST_SEGMENTS = 20_000
#: Segments that a task indexes at once, besides what completes the last anchor.
INDEX_ROWS = 8_192
CHUNK = 1 << 20
_PAD = 0xFF  # in no UTF-8 text


def anchor_size(length: int) -> int:
    return max(1, length * 8 // 25)


def _chunks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (row from, row to, byte from, byte to) of about CHUNK bytes; a longer row comes in overlapping pieces."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        if j == i + 1 and offsets[j] - offsets[i] > CHUNK:
            for a in range(int(offsets[i]), int(offsets[j]) - length + 1, CHUNK):
                yield i, j, a, min(a + CHUNK + length - 1, int(offsets[j]))
        else:
            yield i, min(j, n), int(offsets[i]), int(offsets[min(j, n)])
        i = min(j, n)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All anchors: row, place in the row, anchor hash, segment hash, bytes of the segment before and after the place."""
    k = anchor_size(length)
    w = length - k + 1
    out: list[tuple[np.ndarray, ...]] = []
    for i, j, a, b in _chunks(offsets, length):
        if b - a < length:
            continue
        lo_edge, hi_edge = max(int(offsets[i]), a - w + 1), min(int(offsets[j]), b + w - 1)
        part = data[lo_edge:hi_edge]
        prefix = prefix_hashes(part)
        at = np.arange(len(part) - k + 1)
        kmer = range_hashes(prefix, at, at + k)
        least = (kmer & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        size, step = 1, 1
        while size < w:
            step = min(size, w - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        starts = np.arange(len(least))
        own = offsets[i : j + 1] - lo_edge
        row_of = np.searchsorted(own, starts, "right") - 1
        valid = (starts + length <= own[np.minimum(row_of + 1, len(own) - 1)]) & (starts >= a - lo_edge) & (starts <= b - lo_edge - length)
        place = np.unique(least[valid] & np.uint64(0xFFFFFF)).astype(np.int64)
        row = np.searchsorted(own, place, "right") - 1
        begin, end = np.maximum(own[row], place - (w - 1)), np.minimum(own[row + 1], place + length)
        segment = mix(range_hashes(prefix, begin, end) + (place - begin).astype(np.uint64))
        out.append((row + i, place - own[row], kmer[place], segment, place - begin, end - place))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    merged = [np.concatenate(x) for x in zip(*out, strict=True)]
    _, once = np.unique(merged[0] * (1 << 40) + merged[1], return_index=True)
    return tuple(x[once] for x in merged)


def _find(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rid, t1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                row, place, anchor, segment, left, right = anchors(*flat(batch.column(2)), length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid[row], pa.int64()), pa.array(t1[row], pa.int64()), pa.array(place, pa.int64()),
                        pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)),
                        pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
                    ],
                    ["rid", "t1", "place", "a", "s", "l", "r"],
                )

    return find


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that each document was asked for."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows = {c: [] for c in ("a", "s", "n", "d", "l", "r", "bytes")}
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for x in wanted:
                    for c in ("a", "s", "n", "d", "l", "r"):
                        rows[c].append(x[c])
                    rows["bytes"].append(raw[x["place"] - x["l"] : x["place"] + x["r"]])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))


def _matrix(parts: list[bytes], left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """One row for each segment, its anchor at the same column, padded on both sides."""
    w = length - anchor_size(length)
    m = np.full((len(parts), w + length), _PAD, np.uint8)
    joined = np.frombuffer(b"".join(parts), np.uint8)
    sizes = (left + right).astype(np.int64)
    row = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    m[row, inside + np.repeat(w - left, sizes)] = joined
    return m


def matching_statistics(m: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Streams, from the rightmost column to the first, each segment's longest match (up to `length`) from there on.

    `group` numbers the anchors, ascending; only segments of one group match. Yields the column, the
    segments in the column's order, and the match length of each with the nearer of its neighbours.
    """
    n, columns = m.shape
    group = group.astype(np.uint16)
    order = np.arange(n)
    above = np.zeros(n, np.int64)  # match with the neighbour above
    for c in range(columns - 1, -1, -1):
        letters = m[order, c]
        by_letter = np.argsort(letters, kind="stable")
        new = by_letter[np.argsort(group[order[by_letter]], kind="stable")]
        same = np.zeros(n, bool)
        moved, kept = order[new], letters[new]
        same[1:] = (kept[1:] == kept[:-1]) & (group[moved[1:]] == group[moved[:-1]])
        in_run = same.copy()
        in_run[1:] &= new[1:] == new[:-1] + 1
        fresh = np.zeros(n, np.int64)
        fresh[in_run] = np.minimum(above[new[in_run]] + 1, length)
        heads = np.flatnonzero(same & ~in_run)
        if len(heads):
            end = min(columns, c + length)
            for h in range(0, len(heads), 4096):
                at = heads[h : h + 4096]
                differ = m[moved[at], c:end] != m[moved[at - 1], c:end]
                first = differ.argmax(axis=1)
                fresh[at] = np.where(differ[np.arange(len(at)), first], first, end - c)
        order, above = moved, fresh
        below = np.zeros(n, np.int64)
        below[:-1] = above[1:]
        yield c, order, np.maximum(above, below)


def _indexer(length: int):
    w = length - anchor_size(length)

    def index(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        a, s, left, right = (t[c].to_numpy() for c in ("a", "s", "l", "r"))
        group = np.concatenate(([0], np.cumsum(a[1:] != a[:-1])))
        m = _matrix(t["bytes"].to_pylist(), left, right, length)
        first, last = np.full(len(a), w + 1), np.full(len(a), -1)
        for c, order, match in matching_statistics(m, group, length):
            if c <= w:
                hit = order[match >= length]
                hit = hit[(c >= w - left[hit]) & (c + length <= w + right[hit])]
                first[hit] = c
                last[hit] = np.maximum(last[hit], c)
        found = last >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(a[found]), pa.array(s[found]), pa.array((first[found] - w).astype(np.int64)), pa.array((last[found] - w + length).astype(np.int64))],
            ["a", "s", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last, groups = 0, None, 0
        for whole in batches:
            a = whole.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if last is not None and a[x] != last:
                    groups += 1
                    if count >= INDEX_ROWS or groups > 60_000:
                        yield index(held)
                        held, count, groups = [], 0, 0
                held.append(whole.slice(x, y - x))
                count, last = count + y - x, a[x]
        if held:
            yield index(held)

    return run


def _window_keys(length: int):
    """Every window of a segment: its place before the anchor and its hash."""
    w = length - anchor_size(length)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                left, right, n = (b.column(c).to_numpy() for c in (4, 5, 2))
                data, offsets = flat(b.column(6))
                prefix = prefix_hashes(data)
                counts = left + right - length + 1
                row = np.repeat(np.arange(len(counts)), counts)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = offsets[:-1][row] + inside
                value = range_hashes(prefix, start, start + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.column(0).to_numpy()[row]), pa.array(b.column(1).to_numpy()[row]),
                        pa.array((left[row] - inside).astype(np.int64)), pa.array(value.view(np.int64)), pa.array(n[row]),
                    ],
                    ["a", "s", "before", "h", "n"],
                )

    assert w >= 0
    return keys


def _row_id(docs: DataFrame):
    text = text_of(docs)
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.lit(1), text)).alias("rid"), F.xxhash64(text).alias("t1")


def spans(docs: DataFrame, length: int = LENGTH, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """Byte ranges to remove, `(rid, t1, spans)`: one row for each row id and text hash that has any; ranges may overlap."""
    keyed = docs.select(*_row_id(docs), text_of(docs).alias("text"))
    found = stored(
        keyed.filter(F.octet_length("text") >= length).mapInArrow(
            _find(length), "rid long, t1 long, place long, a long, s long, l int, r int"
        ),
        "anchors", small_batches=True,
    )
    twice = found.groupBy("a").agg(F.count("*").alias("total")).filter("total >= 2").select("a")
    again = stored(found.join(twice, "a"), "repeated-anchors")
    segments = stored(
        again.groupBy("a", "s").agg(
            F.count("*").alias("n"), F.min(F.struct("rid", "t1", "place")).alias("one"), F.min("l").alias("l"), F.min("r").alias("r")
        ),
        "segments",
    )
    mixed = segments.groupBy("a").agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("alone")).filter("d >= 2 AND alone >= 1")
    asked = (
        segments.join(mixed.select("a", "d"), "a")
        .groupBy("one.rid", "one.t1")
        .agg(F.collect_list(F.struct("a", "s", "n", "d", "l", "r", F.col("one.place").alias("place"))).alias("asked"))
    )
    cut = stored(
        keyed.join(asked, ["rid", "t1"]).select("text", "asked")
        .mapInArrow(_cut_segments, "a long, s long, n long, d long, l int, r int, bytes binary"),
        "segment-bytes", small_batches=True,
    )
    kind = "a long, s long, lo long, hi long"
    indexed = (
        cut.filter(F.col("d") <= most_segments).repartition(F.col("a")).sortWithinPartitions("a").mapInArrow(_indexer(length), kind)
    )
    windows = cut.filter(F.col("d") > most_segments).dropDuplicates(["a", "s"]).mapInArrow(
        _window_keys(length), "a long, s long, before long, h long, n long"
    )
    common = windows.groupBy("a", "before", "h").agg(F.sum("n").alias("m")).filter("m >= 2").drop("m")
    counted = (
        windows.join(common, ["a", "before", "h"]).groupBy("a", "s")
        .agg((-F.max("before")).alias("lo"), (F.lit(length) - F.min("before")).alias("hi"))
    )
    equal = segments.filter("n >= 2").select("a", "s", (-F.col("l")).cast("long").alias("lo"), F.col("r").cast("long").alias("hi"))
    cover = indexed.unionByName(counted).unionByName(equal)
    placed = again.select("rid", "t1", "place", "a", "s").join(cover, ["a", "s"])
    ranges = placed.select("rid", "t1", F.struct((F.col("place") + F.col("lo")).alias("lo"), (F.col("place") + F.col("hi")).alias("hi")).alias("x"))
    return stored(ranges.groupBy("rid", "t1").agg(F.collect_set("x").alias("spans")), "spans")


_KEPT = T.StructType(
    [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
)


_CLEAN = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])


def _cut(texts: pa.Array, ranges: pa.Array) -> tuple[list[int], list[int], list[bytes]]:
    """Per text: bytes removed, maximal removed runs, and the bytes that are kept."""
    removed, runs, kept = [], [], []
    for text, own in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
        raw, parts, at, gone, n = text.encode(), [], 0, 0, 0
        for lo, hi in sorted((x["lo"], x["hi"]) for x in own):
            if n == 0 or lo > at:
                n += 1
                parts.append(raw[at:lo])
                gone += hi - lo
                at = hi
            elif hi > at:
                gone += hi - at
                at = hi
        parts.append(raw[at:])
        removed.append(gone)
        runs.append(n)
        kept.append(b"".join(parts))
    return removed, runs, kept


@F.arrow_udf(_KEPT)
def _removed(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    removed, runs, kept = _cut(texts, ranges)
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "n_spans", "kept"])


@F.arrow_udf(_CLEAN)
def _cleaned(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """What is left as text; a character cut in half goes whole."""
    removed, _, kept = _cut(texts, ranges)
    clean = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), clean], ["n_removed", "text"])


def _with_spans(docs: DataFrame, length: int, most_segments: int) -> tuple[DataFrame, DataFrame]:
    """Every row of `docs` as the struct `row` with its `text`: those without spans, and those with their `spans`."""
    found = spans(docs, length, most_segments)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_row_id(docs), text_of(docs).alias("text"))
    joined = rows.join(found, ["rid", "t1"], "left")
    return joined.filter("spans IS NULL"), joined.filter("spans IS NOT NULL")


def remove_repeats(docs: DataFrame, length: int = LENGTH, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """Every row of `docs` as the struct `row`, with n_bytes, n_removed, n_spans and the bytes that are `kept`.

    The first place of a passage goes like all others: strings are judged on the input, none of them is the original.
    """
    none, some = _with_spans(docs, length, most_segments)
    some = some.withColumn("x", _removed("text", "spans"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    return none.select(
        "row", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept")
    ).unionByName(some.select("row", size, "x.n_removed", "x.n_spans", "x.kept"))


def digest(removed: DataFrame) -> DataFrame:
    """The counts and a hash instead of the bytes."""
    return removed.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """`docs` with the repeats cut from its texts, `n_chars` counted anew; a character cut in half goes whole.

    One Python function does both: a task with two of them in a row keeps two workers, and Spark hands all workers round to
    later tasks, so that each comes to hold what those load. Rows that lose nothing stay out of Python.
    """
    none, some = _with_spans(docs, length, most_segments)
    some = some.withColumn("x", _cleaned("text", "spans"))
    whole = F.col("row.text").isNull() | (F.col("x.n_removed") == 0)
    new = {"text": F.when(whole, F.col("row.text")).otherwise(F.col("x.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("x.text").cast("long"))
    same = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return none.select(*same).unionByName(some.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
