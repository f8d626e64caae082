"""The pipeline's stages, one after the other, on odd rows and on a given table."""

from __future__ import annotations

import corpus_pipeline
from linkpulse.llm.common import stored, table
from tests.llm.test_dedup import brute_components
from tests.llm.test_shaping import check_packed


def test_stages(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            want = brute_components(before, 5)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "packing":
            bins, least = check_packed(before, docs.collect())
            assert bins <= least * 1.02 + 1


def test_odd_rows(spark, odd, empty):
    for first in (odd, empty):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, ""), name)
            if name != "packing":
                assert docs.columns == odd.columns
        docs.count()
