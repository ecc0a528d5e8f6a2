"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from editlore.llm import exact_topk, line_dedup, merkle, sharded_lloyd, spelling
from editlore.llm.chosen_path import op8_chosen_path_join
from editlore.llm.decontamination import op6_winnowing
from editlore.llm.exact_topk import op10_exact_topk
from editlore.llm.line_dedup import op13_line_dedup
from editlore.llm.link_trust import op2_link_trust
from editlore.llm.merkle import op1_merkle_audit
from editlore.llm.packing import op3_best_fit_packing
from editlore.llm.page_text import op5_page_differencing
from editlore.llm.quality import op9_crf_quality
from editlore.llm.sharded_lloyd import op12_sharded_lloyd
from editlore.llm.spelling import op11_spelling_variants
from editlore.llm.token_codes import op4_token_codes
from editlore.llm.toxicity import op7_compression_toxicity


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_merkle_audit, op2_link_trust, op3_best_fit_packing, op4_token_codes, op5_page_differencing, op6_winnowing,
        op7_compression_toxicity, op8_chosen_path_join, op9_crf_quality, op10_exact_topk, op11_spelling_variants, op12_sharded_lloyd, op13_line_dedup)} | {"pipeline": corpus_pipeline.run}


def statements() -> dict[str, str]:
    return {
        "op1_merkle_audit": merkle.SQL, "op10_exact_topk": exact_topk.SQL, "op11_spelling_variants": spelling.SQL,
        "op12_sharded_lloyd": sharded_lloyd.SQL, "op13_line_dedup": line_dedup.SQL}
