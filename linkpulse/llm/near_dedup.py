"""Near-duplicate documents by HyperMinHash.

A document's shingle hashes are dealt to `REGISTERS` registers by their leading bits; a register keeps its least value in 16
bits: the count of leading zeros and `MANTISSA` bits after them. Registers that got nothing borrow from others in a
fixed order, so that short texts match as long ones do. Bands of `BAND` registers give the candidates. The estimate
over all registers, corrected for values that agree by chance in so few bits, sorts out the bulk of false ones; what is
left is confirmed on the full sets.

At similarity 0.8 a pair misses all 42 bands with a chance of 3e-6, and a true pair falls below `LEAST_ESTIMATE`
with a chance below 1e-8.

Groups are not expanded into pairs. Texts with equal sets are one class from the start. Each bucket compares its
members with one of them only. Buckets that then still hold several components are looked at again, without those members that
share too few shingles with any other to be linked at all. A member outside its bucket's largest component is compared
with all of that component and with the bucket's other such members, in blocks: tasks hold bounded blocks of full
sets, bounded in shingles and in rows, and return a spanning forest of the components that they found linked, fewer links
than a block has components. No candidate that could be a link is dropped.

Defined results: texts without words and null texts have an empty set and link with nothing. A row without an id links with nothing,
has no component and is kept. Repeated rows fall into one class. Rows of one id with different texts link as one document;
`keep_one` then keeps one row of each text of an id that stays. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_among, stored, text_of
from .components import components
from .words import LOWER, flat, mix, row_chunks, word_hashes

REGISTERS, BAND, MANTISSA = 256, 6, 10
LEAST_ESTIMATE = 0.65
PERCENT = 80
WIDTH = 5
#: Shingles that one side of a block holds, about.
BLOCK_SHINGLES = 400_000
#: Sets that one side of a block holds, about.
BLOCK_ROWS = 8_192

_VALUE_BITS = 64 - int(np.log2(REGISTERS))
_PROBES = np.random.Generator(np.random.PCG64(7)).integers(0, REGISTERS, (512, REGISTERS))
_SKETCH = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()), T.StructField("registers", T.BinaryType()),
    ]
)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, and where each row begins."""
    hashes, at = word_hashes(data, offsets, LOWER)
    counts = np.diff(at)
    out = []
    acc = hashes[: max(0, len(hashes) - width + 1)]
    for j in range(1, width):
        acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + hashes[j : len(hashes) - width + 1 + j])
    for i, n in enumerate(counts):
        a = at[i]
        if n >= width:
            own = np.sort(acc[a : a + n - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = np.array([n], np.uint64)
            for h in hashes[a : a + n]:
                own = mix(own * np.uint64(0x2545F4914F6CDD1D) + h)
        else:
            own = hashes[:0]
        out.append(own)
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else hashes[:0]), np.concatenate(([0], np.cumsum(sizes)))


def registers_of(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Compressed registers of each row, borrowed where empty; 0 throughout for an empty set."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    slot = (sets >> np.uint64(_VALUE_BITS)).astype(np.int64)
    own = np.zeros((rows, REGISTERS), np.uint16)
    place = row * REGISTERS + slot
    first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
    value = sets[first] & np.uint64((1 << _VALUE_BITS) - 1)
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    shift = length - MANTISSA - 1
    up, down = np.maximum(-shift, 0).astype(np.uint64), np.maximum(shift, 0).astype(np.uint64)
    tail = ((value >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    zeros = np.maximum(_VALUE_BITS - length, 0)
    own.reshape(-1)[place[first]] = ((zeros << MANTISSA) + tail.astype(np.int64) + 1).astype(np.uint16)
    filled = own.copy()
    r, s = np.nonzero((own == 0) & (np.diff(at) > 0)[:, None])
    for probe in _PROBES:
        if not len(r):
            break
        got = own[r, probe[s]]
        filled[r, s] = got
        r, s = r[got == 0], s[got == 0]
    for i, j in zip(r, s, strict=True):  # a handful: sets of one or two shingles
        filled[i, j] = own[i][own[i] > 0][0]
    return filled


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.dtype.itemsize * rows.shape[1]
    at = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _sketch_udf(width: int):
    @F.arrow_udf(_SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        parts = []
        for i, j in row_chunks(offsets):
            sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            keys = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(mix(sets ^ np.uint64(salt)), out=total[1:])
                keys.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            parts.append((np.diff(at), *keys, registers_of(sets, at)))
        if not parts:
            return pa.array([], pa.struct([("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("registers", pa.binary())]))
        n, k1, k2, regs = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(k1), pa.array(k2), _binary(regs)], list(_SKETCH.names))

    return sketch


def _set_udf(width: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def full_set(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        values, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for i, j in row_chunks(offsets):
            sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            values.append(sets)
            ends.append(at[1:] + ends[-1][-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(values).view(np.int64)))

    return full_set


@F.arrow_udf(T.DoubleType())
def _estimate_udf(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    """Estimated similarity: the share of equal registers, less what chance gives in so few bits."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (a, b))
    equal = (x == y).mean(axis=1)
    edge = np.concatenate((2.0 ** -np.arange(0, 60), [0.0]))
    chance = np.zeros(len(equal))
    per = [np.maximum(np.asarray(c, np.float64) / REGISTERS, 1.0)[:, None] for c in (n_a, n_b)]
    within = [(1 - edge[None, 1:]) ** p - (1 - edge[None, :-1]) ** p for p in per]
    chance = (within[0] * within[1]).sum(axis=1) / (1 << MANTISSA)
    return pa.array((equal - chance) / (1 - chance))


class _Classes:
    """One row per distinct shingle set, led by its smallest document id, and the buckets with more than one."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        each = docs.select("doc_id", _sketch_udf(width)(text_of(docs)).alias("s")).select("doc_id", "s.*")
        self.each = stored(each, "sketches", small_batches=True)
        self.classes = stored(
            self.each.filter("n_shingles > 0 AND doc_id IS NOT NULL")
            .groupBy("k1", "k2")
            .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.max("registers").alias("registers")),
            "classes",
        )
        bands = F.transform(
            F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
            lambda i: F.xxhash64(i, F.substring("registers", i * (2 * BAND) + 1, F.lit(2 * BAND))),
        )
        rows = self.classes.select(F.explode(bands).alias("bucket"), "node", "n")
        shared = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("hi")).filter("centre <> hi")
        # stored, so that both sides of the join are plain and a hot bucket can be split
        shared = stored(shared.select("bucket", "centre"), "shared")
        self.buckets = stored(maybe_among(rows, "bucket", shared).join(shared, "bucket"), "buckets")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """The full sets of some nodes, stored."""
        docs = self.docs.select(F.col("doc_id").alias("node"), text_of(self.docs).alias("text"))
        docs = maybe_among(docs, "node", nodes).join(nodes, "node")
        return stored(docs.select("node", _set_udf(self.width)("text").alias("s")), "sets", small_batches=True)

    def centre_links(self) -> DataFrame:
        """Links (a, b) of members with the smallest id of a bucket of theirs: first the registers decide, then the sets."""
        pairs = self.buckets.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
        pairs = stored(pairs, "pairs")
        of = lambda x: self.classes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "registers")])
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        likely = both.filter(_estimate_udf("registers_a", "registers_b", "n_a", "n_b") >= LEAST_ESTIMATE)
        likely = stored(likely.select("a", "b").distinct(), "likely")
        sets = self.sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        of = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"))
        size = lambda x: F.size(f"s_{x}").cast("long")
        common = F.size(F.array_intersect("s_a", "s_b"))
        similar = common * 100 >= (size("a") + size("b") - common) * self.percent
        return stored(likely.join(of("a"), "a").join(of("b"), "b").filter(similar).select("a", "b"), "links")

    def mixed(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, each with its label."""
        rows = rows.select("bucket", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rows = stored(rows, "labelled")
        several = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        return rows.join(several.select("bucket"), "bucket")

    def eligible(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """The rows whose node shares enough shingles with other nodes of `rows` to be linked at all, with that number as `c`."""
        each = sets.join(rows.select("node").distinct(), "node").select("node", F.explode("s").alias("x"))
        alone = each.groupBy("x").agg(F.max("node").alias("hi"), F.min("node").alias("node")).filter("node = hi")
        alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
        with_c = rows.join(alone, "node", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
        return with_c.filter(F.col("c") * 100 >= F.col("n") * self.percent)

    def labels(self) -> DataFrame:
        """`(node, label)` of all classes that are linked with another."""
        links = self.centre_links()
        labels = stored(components(links), "labels")
        rows = stored(self.mixed(self.buckets, labels), "mixed")
        sets = self.sets_of(rows.select("node").distinct())
        rows = stored(self.eligible(rows, sets).drop("c"), "eligible")
        more = stored(self.open_links(rows, sets), "links")
        return stored(components(links.unionByName(more)), "labels")

    def open_links(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different components of a bucket, enough to connect what is linked."""
        sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("k"))
        major = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("major"), F.count("*").alias("labels"))
        minor = stored(rows.join(major, "bucket").filter("label <> major"), "minor")
        inside = minor.filter("labels > 2").select(F.col("bucket").alias("key"), "node", "n", "label")
        against = minor.select(F.col("major").alias("key"), "node", "n", "label").distinct()
        members = rows.join(minor.select(F.col("major").alias("label")).distinct(), "label", "left_semi")
        members = members.select(F.col("label").alias("key"), "node", "n", "label").distinct()
        return self.block_links(inside, inside, sets).unionByName(self.block_links(against, members, sets))

    def block_links(self, left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) that connect the labels of left and right rows of one key that are linked.

        Each side of a key is cut into blocks of about BLOCK_SHINGLES or BLOCK_ROWS; a task takes one block of each side.
        """
        cuts = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)).cast("int")
        blocks = lambda df, name: df.groupBy("key").agg(cuts.alias(name))
        counts = stored(blocks(left, "nl").join(blocks(right, "nr"), "key"), "block-counts")

        def dealt(df, own, other, side):
            x = df.join(counts, "key").join(sets.select("node", "s"), "node")
            mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
            x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            i, j = (mine, F.col("o")) if side == 0 else (F.col("o"), mine)
            return x.select("key", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "node", "label", "s")

        both = dealt(left, "nl", "nr", 0).unionByName(dealt(right, "nr", "nl", 1))
        return both.groupBy("key", "i", "j").applyInArrow(_block(self.percent), "a long, b long")


def _block(percent: int):
    def links(t: pa.Table) -> pa.Table:
        """Similar pairs of a left and a right set, one for each two labels that nothing before has joined."""
        side = t["side"].to_numpy()
        node, label = t["node"].to_numpy(), t["label"].to_numpy()
        lists = t["s"].combine_chunks()
        at, flat_sets = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [flat_sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        if len(left) and len(right):
            # the group each row is in so far: rows of one label are one from the start
            group = np.unique(label, return_inverse=True)[1]
            sizes = np.array([len(sets[i]) for i in left])
            all_left = np.concatenate([sets[i] for i in left])
            order = np.argsort(all_left, kind="stable")
            ordered, owner = all_left[order], np.repeat(np.arange(len(left)), sizes)[order]
            for j in right:
                lo, hi = np.searchsorted(ordered, sets[j], "left"), np.searchsorted(ordered, sets[j], "right")
                runs = hi - lo
                places = np.repeat(lo - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
                common = np.bincount(owner[places], minlength=len(left))
                good = (common * 100 >= (sizes + len(sets[j]) - common) * percent) & (group[left] != group[j])
                near, first = np.unique(group[left[good]], return_index=True)
                if len(near):
                    out += [(node[i], node[j]) for i in left[good][first]]
                    group[np.isin(group, near)] = group[j]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return links


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (least id reachable over links) and kept."""
    found = _Classes(docs, width, percent)
    labels = found.labels()
    of_class = (
        found.classes.join(labels, "node", "left")
        .select("k1", "k2", F.coalesce("label", "node").alias("component_id"))
    )
    own = found.each.select("doc_id", "n_shingles", "k1", "k2")
    joined = own.join(of_class, ["k1", "k2"], "left")
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each group of near duplicates, all input columns as they were."""
    kept = near_duplicates(docs, width, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL"))
