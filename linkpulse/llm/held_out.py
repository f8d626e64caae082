"""Bounded labelled samples, and the rows that no label is learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id) -> Column:
    """True for the third of ids whose labels are only for measuring: crc32 of the id as text, modulo 3, is 1."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """`(doc_id, y, weight)`: at most `per_class` ids of each label value, the least by hash, from rows that may be learned from.

    An id with several label rows counts once, with the larger label. `weight` is how many such ids of its class a sampled one
    stands for, so that what is learned keeps the classes' shares, whichever of them the cap thins out.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    weight = {y: max(1.0, ids.get(y, 0) / max(per_class, 1)) for y in (0, 1)}
    parts = [own.filter(F.col("y") == y).orderBy(*order).limit(per_class).withColumn("weight", F.lit(weight[y])) for y in (0, 1)]
    return parts[0].unionByName(parts[1])
