"""Packing documents into sequences by hierarchical residual best fit.

Every input partition tokenizes its documents, cuts those that are longer than a sequence, and packs its pieces by
best fit, longest first. Bins become items, each with the pieces it holds, and
meet those of other partitions in a tree: `FAN_IN` groups at a time, packed again by best fit, until one group is left.

Of each group go on at most one bin that is half full or less, as two of them never both survive a best fit, and the
`MOST_HOSTS` fuller bins with the most room; the rest is done. Two bins over half full never fit one
sequence, so all that can still be merged are the bins at most half full: at most `FAN_IN` of them meet in a group, and use up as many
fuller bins at most. A group thus has at most FAN_IN * (MOST_HOSTS + 1) items, whatever the corpus and its lengths.

Only bin numbers and lengths move between tasks; token ids are written once, beside their first bin.

Defined results: a null text is empty; an empty text gives one piece, the end mark alone. Rows without an id, with equal ids or
equal in all columns are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .tokens import byte_bpe, default_path

LENGTH = 2048
END_ID = 0
FAN_IN = 8
#: Bins over half full that go on from a group. Each level uses up FAN_IN of them at most, so they last FAN_IN levels.
MOST_HOSTS = FAN_IN * FAN_IN
#: Bytes of token ids that a task holds and packs at once.
WINDOW_BYTES = 32 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids binary, bin string, offset long, free int, open boolean"


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, taken in the given order, and each bin's free space.

    A size goes to the open bin with the least free space that holds it. Bins are kept by free space, one list
    for each amount, with the amounts in use in order.
    """
    by_free: dict[int, list[int]] = {}
    amounts: list[int] = []
    free: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        at = bisect.bisect_left(amounts, size)
        if at < len(amounts):
            room = amounts[at]
            b = by_free[room].pop()
            if not by_free[room]:
                del by_free[room]
                amounts.pop(at)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins.append(b)
        offsets.append(capacity - room)
        left = free[b] = room - size
        if left:
            if left not in by_free:
                by_free[left] = []
                bisect.insort(amounts, left)
            by_free[left].append(b)
    return bins, offsets, free


def goes_on(free: np.ndarray, capacity: int) -> np.ndarray:
    """Which of a group's packed bins can still be merged with those of other groups."""
    free = np.asarray(free, np.int64)
    light = 2 * (capacity - free) <= capacity
    hosts = np.flatnonzero(~light & (free > 0))
    light[hosts[np.argsort(-free[hosts], kind="stable")[:MOST_HOSTS]]] = True
    return light


def _packer(capacity: int, path: str, run: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, end = byte_bpe(path), np.array([END_ID], "<u4").tobytes()
        task, turn = TaskContext.get().partitionId(), 0
        docs, pieces, starts, ids = [], [], [], []
        held = 0

        def flush():
            nonlocal turn, held
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            order = np.argsort(-lengths, kind="stable")
            bins, offsets, free = best_fit(lengths[order].tolist(), capacity)
            place, at = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            place[order], at[order] = bins, offsets
            room, open_ = np.array(free, np.int32), goes_on(free, capacity)
            order = np.lexsort((at, place))
            for i in range(0, len(order), 2000):
                part = order[i : i + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[k] for k in part], pa.int64()), pa.array([pieces[k] for k in part], pa.int32()),
                        pa.array([starts[k] for k in part], pa.int64()), pa.array(lengths[part]),
                        pa.array([ids[k] for k in part], pa.binary()),
                        pa.array([f"{run}-{task}-{turn}-{place[k]}" for k in part]),
                        pa.array(at[part]), pa.array(room[place[part]]), pa.array(open_[place[part]]),
                    ],
                    ["doc_id", "piece", "start", "length", "ids", "bin", "offset", "free", "open"],
                )
            turn, held = turn + 1, 0
            for kept in (docs, pieces, starts, ids):
                kept.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                encoded = bpe.encode_many(part.column(1).to_pylist())
                for doc, own in zip(part.column(0).to_pylist(), encoded, strict=True):
                    all_ids = own + end
                    held += len(all_ids)
                    n = len(all_ids) // 4
                    first = (n - 1) % capacity + 1
                    edges = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        docs.append(doc)
                        pieces.append(k)
                        starts.append(a)
                        ids.append(all_ids[4 * a : 4 * b])
                if held >= WINDOW_BYTES:
                    yield from flush()
        if ids:
            yield from flush()

    return pack


def _merger(capacity: int):
    """Packs a group's items anew; returns where each went, and the free space of that bin."""

    def merge(table: pa.Table) -> pa.Table:
        t = table.sort_by([("free", "ascending"), ("item", "ascending")])
        used = (capacity - t["free"].to_numpy()).tolist()
        bins, offsets, free = best_fit(used, capacity)
        on = goes_on(free, capacity)
        items = t["item"].to_pylist()
        first: dict[int, str] = {}
        for b, item in zip(bins, items, strict=True):
            first.setdefault(b, item)
        return pa.table(
            {
                "item": pa.array(items, pa.string()),
                "into": pa.array([first[b] for b in bins], pa.string()),
                "shift": pa.array(offsets, pa.int64()),
                "free": pa.array([free[b] for b in bins], pa.int32()),
                "open": pa.array([bool(on[b]) for b in bins]),
                "node": t["node"],
            }
        )

    return merge


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian),
    sequence (text) and offset. Every sequence is filled from 0 without gaps, and holds at most `capacity` tokens."""
    spark, path = docs.sparkSession, tokenizer or default_path()
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    pieces = stored(texts.mapInArrow(_packer(capacity, path, uuid.uuid4().hex[:8]), _PIECES), "pieces", small_batches=True)
    opened = pieces.filter("open").groupBy("bin").agg(F.first("free").alias("free"))
    task, turn = (F.split("bin", "-")[i].cast("long").alias(name) for i, name in ((1, "task"), (2, "turn")))
    items = stored(opened.select(F.col("bin").alias("item"), task, turn, "free"), "items")
    tasks, turns = items.agg(F.max("task") + 1, F.max("turn") + 1).first()
    items = items.withColumn("node", F.col("turn") * F.lit(tasks) + F.col("task"))  # what was packed at once is a node
    moves, top = None, None if tasks is None else tasks * turns - 1
    while top is not None:
        last = top < FAN_IN
        grouped = items.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        moved = stored(
            grouped.groupBy("node").applyInArrow(
                _merger(capacity), "item string, into string, shift long, free int, open boolean, node long"
            ),
            "moves",
        )
        if moves is None:
            moves = moved.select("item", "into", "shift")
        else:
            step = moved.select(F.col("item").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = stored(
                moves.join(step, "into", "left").select(
                    "item", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
                ),
                "moved",
            )
        if last:
            break
        items = stored(
            moved.filter(F.col("open") & (F.col("item") == F.col("into"))).select("item", "node", "free"), "items"
        )
        top = items.agg(F.max("node")).first()[0]
    out = pieces.select("doc_id", "piece", "start", "length", "ids", "offset", F.col("bin").alias("sequence"), "open")
    if moves is not None:
        own = moves.withColumnRenamed("item", "sequence")
        open_ = out.filter("open").join(own, "sequence", "left")
        open_ = open_.withColumns(
            {"offset": F.col("offset") + F.coalesce("shift", F.lit(0)), "sequence": F.coalesce("into", "sequence")}
        )
        out = out.filter("NOT open").unionByName(open_.select(*out.columns))
    return out.drop("open")




def digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with a number for each sequence and a checksum instead of the ids."""
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.xxhash64("sequence").alias("sequence_id"), "offset",
    )
