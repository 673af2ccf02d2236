"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from riskflow.llm import alignment, exact, grading, html, lines, mixing, packing, pii, quality, runs, search, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_perplexity_rules": quality.op7_perplexity_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_grades": grading.op9_quality_grades,
    "op10_personal_data": pii.op10_personal_data,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_top_k": search.op12_top_k,
    "op13_cross_tokenizer": alignment.op13_cross_tokenizer,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op1_line_dedup": lines.OP1_SQL, "op5_exact_dedup": exact.OP5_SQL, "op6_source_mixing": mixing.OP6_SQL,
                       "op12_top_k": search.OP12_SQL}
