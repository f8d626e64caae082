"""Quality rules with thresholds that the corpus sets itself.

Per language and source, mergeable quantile sketches of four measures say what is usual there. A document is
rejected where a measure lies far above the usual. The sketch is a histogram with logarithmic bins: counts of values cut
to their `SIGNIFICANT_BITS` leading bits. Two sketches merge by adding counts, its size does not depend on the
number of documents, every quantile is exact to one part in 2**(SIGNIFICANT_BITS - 1), and a rerun gives the same
numbers because only whole numbers are added.

Defined results: a null or empty text has no words, fails the base rule and is rejected. Null languages and sources
form groups of their own. Repeated rows are judged row by row, alike. An empty table gives an empty result.
Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_of, without
from .words import SPACE, flat, mix, row_chunks, row_sums, word_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SIGNIFICANT_BITS = 8
#: A group with fewer documents than this is judged by its language's sketch, a rare language by that of all.
MIN_GROUP_DOCS = 100
#: Fence above the upper quartile, in interquartile ranges.
FENCE = 3
#: Measures, in 1/1000 of the words (or lines); each with the least range its fence takes as the usual spread.
MEASURES = {"symbol_rate": 50, "upper_rate": 50, "dup_line_rate": 120, "repeat_rate": 100}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")
OUTPUTS = (*COUNTS, *MEASURES, "base_failed", "kept")
_COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True


def _repeats(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row, how many words lie in a 3-word window that the row has twice or more."""
    n, rows = len(hashes), np.repeat(np.arange(len(at) - 1), np.diff(at))
    if n < 3:
        return np.zeros(len(at) - 1, np.int64)
    salt = mix(rows.astype(np.uint64) + np.uint64(1))
    three = mix(hashes[:-2] + np.uint64(3) * mix(hashes[1:-1] + np.uint64(5) * mix(hashes[2:] + salt[:-2])))
    whole = rows[:-2] == rows[2:]
    ordered = np.sort(three[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    inside = np.zeros(n, bool)
    if len(twice):
        found = np.minimum(np.searchsorted(twice, three), len(twice) - 1)
        hit = whole & (twice[found] == three)
        inside[:-2] |= hit
        inside[1:-1] |= hit
        inside[2:] |= hit
    return row_sums(inside, at)


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    hashes, at = word_hashes(data, offsets)
    inside = ~SPACE[data]
    chars = row_sums(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = row_sums(_SYMBOL[data], offsets)
    lines, repeated = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
    raw = data.tobytes()
    for i in range(len(at) - 1):
        own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(own), len(own) - len(set(own))
    return [np.diff(at), chars, symbols, repeated, _repeats(hashes, at), lines, _upper_words(data, offsets, inside)]


def _upper_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Per row, the words with two capital letters or more and no small letter."""
    n = len(data)
    if n == 0:
        return np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    upper, lower = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    np.cumsum(_UPPER[data], out=upper[1:])
    np.cumsum(_LOWER[data], out=lower[1:])
    shout = (upper[e] - upper[s] >= 2) & (lower[e] == lower[s])
    return row_sums(shout, np.searchsorted(s, offsets))


@F.arrow_udf(_COUNT_TYPE)
def _count_udf(texts: pa.Array) -> pa.Array:
    data, offsets = flat(texts)
    parts = [_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_chunks(offsets)]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(COUNTS))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the counts, the measures and `base_failed`. Whole texts, one Python pass."""
    own = without(docs, OUTPUTS)
    counted = own.withColumn("__counts", _count_udf(text_of(own, text))).select(*own.columns, "__counts.*")
    return counted.withColumns(
        {
            "symbol_rate": _rate("n_symbols", "n_words"),
            "upper_rate": _rate("n_upper_words", "n_words"),
            "dup_line_rate": _rate("n_dup_lines", "n_lines"),
            "repeat_rate": _rate("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        }
    )


def bin_of(value: Column) -> Column:
    """The lower end of a value's histogram bin: its leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - SIGNIFICANT_BITS, F.lit(0))
    size = F.pow(F.lit(2.0), drop).cast("long")
    return (value - value % size).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Histogram rows `(lang, source, measure, bin, n)` of the documents that pass the base rule.

    Counted before the shuffle: a row per task, group and bin at most, however many documents a source has.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in MEASURES])
    return (
        measured.filter(~F.col("base_failed"))
        .select("lang", "source", F.explode(pairs).alias("p"))
        .groupBy("lang", "source", "p.measure", "p.bin")
        .agg(F.count("*").alias("n"))
    )


def _fences(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of `keys`: its documents, and a struct of one fence for each measure."""
    merged = histogram.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    over = ", ".join([*keys, "measure"])
    ranked = merged.selectExpr(
        *keys, "measure", "bin",
        f"sum(n) OVER (PARTITION BY {over} ORDER BY bin) AS upto",
        f"sum(n) OVER (PARTITION BY {over}) AS total",
    )
    quartiles = ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
    )
    least = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in MEASURES.items()])
    fence = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    wide = [F.max(F.when(F.col("measure") == m, fence)).alias(m) for m in MEASURES]
    return quartiles.groupBy(*keys).agg(F.max("docs").alias("docs"), *wide)


def thresholds(histogram: DataFrame) -> DataFrame:
    """Fences `(lang, source, max_<measure>...)` for every group that has a document.

    A small group takes its language's sketch, a rare language that of all documents; both are sums of the groups'.
    """
    each, by_lang = _fences(histogram, ["lang", "source"]), _fences(histogram, ["lang"])
    by_lang = by_lang.select(*[F.col(c).alias(f"l_{c}") for c in by_lang.columns])
    overall = _fences(histogram, []).select(F.struct(*MEASURES)).scalar()
    joined = each.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang"))).withColumn("overall", overall)
    pick = {
        f"max_{m}": F.when(F.col("docs") >= MIN_GROUP_DOCS, F.col(m))
        .when(F.col("l_docs") >= MIN_GROUP_DOCS, F.col(f"l_{m}"))
        .otherwise(F.col(f"overall.{m}"))
        for m in MEASURES
    }
    return joined.select("lang", "source", *[v.alias(k) for k, v in pick.items()])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """`measured` with `kept`: the base rule holds and no measure lies above its group's fence."""
    t = limits.select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"),
        *[F.col(f"max_{m}").alias(f"__max_{m}") for m in MEASURES],
    )
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    above = F.lit(False)
    for m in MEASURES:
        above = above | F.coalesce(F.col(m) > F.col(f"__max_{m}"), F.lit(False))
    judged = measured.join(t, on, "left").withColumn("kept", ~F.col("base_failed") & ~above)
    return judged.drop("__lang", "__source", *[f"__max_{m}" for m in MEASURES])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document's measures and verdict, without its text. Measures are stored once and read twice."""
    narrow = stored(measure(docs).drop("text"), "measures", small_batches=True)
    return judge(narrow, thresholds(sketches(narrow)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all input columns as they were.

    Measured once: the rows are stored with their counts, thresholds and verdicts are taken from there.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(F.lit(0).alias("__none"), *[docs[c] for c in others]).alias("__row"), "text", "lang", "source")
    measured = stored(measure(packed), "measured", small_batches=True)
    limits = stored(thresholds(sketches(measured)), "limits")
    kept = judge(measured, limits).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])
