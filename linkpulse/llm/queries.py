"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import exact_search, licenses, mixing, near_dedup, packing, quality_model, repeats, token_rollup, toxicity, vector_codes
from . import near_vectors, whitening
from . import quality_rules as rules
from .common import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.score_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token sequences of at most 2048."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, over sets of two-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches: all documents, minus exact copies, with repeated lines taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.Rollup(spark, new_folder(spark, "rollup"))
    copies = token_rollup.exact_copies(docs)
    rollup.commit("0001-insert", token_rollup.upserts(docs))
    rollup.commit("0002-copies", token_rollup.deletions(copies))
    revised = token_rollup.without_repeated_lines(docs.join(copies, "doc_id", "left_anti"))
    rollup.commit("0003-lines", token_rollup.upserts(revised))
    rollup.commit("0002-copies", token_rollup.deletions(copies))  # comes again: no effect
    return rollup.totals()


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 200 bytes that occur twice."""
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of every document."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = exact_search.quantized(table(spark, sf_dir, "embeddings"))
    return exact_search.top_k(vectors.filter(F.col("id") % 50 == 0), vectors)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    names = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *rules.MEASURES, "base_failed", "kept"]
    return rules.quality_rules(docs).select("doc_id", "n_words", *names)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9 or more."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened principal components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every vector."""
    return vector_codes.code_digest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("tried")


def llm_queries() -> dict[str, Query]:
    own = (
        op1_quality_classifier, op2_packing, op3_near_duplicates, op4_token_counts, op5_toxicity, op6_licenses, op7_repeats,
        op8_mixing, op9_exact_search, op10_quality_rules, op11_near_vectors, op12_whitening, op13_vector_codes,
    )
    return {q.__name__: q for q in own} | {"pipeline": corpus_pipeline.run}


def llm_oracles() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
