"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import twins
from tidemark.llm.embedding_dedup import op13_embedding_dedup
from tidemark.llm.licenses import op4_license_scan
from tidemark.llm.merkle import op12_merkle_manifest
from tidemark.llm.mixing import op6_mixing
from tidemark.llm.ngram_join import op9_ngram_join
from tidemark.llm.packing import op3_best_fit_packing
from tidemark.llm.quality import op10_quality_rules
from tidemark.llm.spelling import op11_spelling_variants
from tidemark.llm.substrings import op5_passage_dedup, op5_substring_dedup
from tidemark.llm.token_files import op7_token_files
from tidemark.llm.tool_calls import op8_tool_calls
from tidemark.llm.toxicity import op1_toxicity
from tidemark.llm.vector_search import op2_exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_exact_top_k, op3_best_fit_packing, op4_license_scan, op5_substring_dedup, op5_passage_dedup,
        op6_mixing, op7_token_files, op8_tool_calls, op9_ngram_join, op10_quality_rules,
        op11_spelling_variants, op12_merkle_manifest, op13_embedding_dedup)
}
ORACLES: dict[str, str] = {name: sql for name, sql in twins.SQL.items() if name in QUERIES}
