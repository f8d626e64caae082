"""From raw documents to packed training sequences, stage by stage.

Each stage takes `(spark, docs, sf_dir)`, works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read back for the next one. All but the last return the columns of `documents`.

A stage drops the scratch tables of the stage before it, whose rows are written by then: hand it the rows read back, and write
what a stage returns before the next one is called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkpulse.llm import mixing, near_dedup, packing, repeats
from linkpulse.llm.common import drop_scratch, scratch, stored, table
from linkpulse.llm.quality_rules import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage called last, by application.
_LEFT: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, after the scratch tables of its predecessor are gone."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_scratch(spark, _LEFT.pop(app, []))
        before = set(scratch(spark))
        out = stage(spark, docs, sf_dir)
        _LEFT[app] = [f for f in scratch(spark) if f not in before]
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return near_dedup.keep_one(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur twice are cut out of the texts."""
    return repeats.drop_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs).drop("__shard")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", _tidy(quality)), ("near_duplicates", _tidy(one_of_each)), ("repeats", _tidy(no_repeats)), ("mixing", _tidy(mixed)),
    ("packing", _tidy(packed)),
]

#: Suffix matching, hashed permutations and tokenization have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`. What a stage has kept is dropped once the next one's rows are stored."""
    docs, kept = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, kept)
        kept = scratch(spark)[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
