"""The registered queries of this subpackage, in the order of their numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanframe.llm.ann import op6_additive_ann
from spanframe.llm.byte_bpe import op1_byte_bpe
from spanframe.llm.fingerprint import op8_fingerprints
from spanframe.llm.html_extract import op4_html_text
from spanframe.llm.infilling import OP12_SQL, op12_fill_in_middle
from spanframe.llm.jaccard import op5_jaccard_join
from spanframe.llm.langid import op10_language_id
from spanframe.llm.lm import op7_lm_scores
from spanframe.llm.minhash import OP11_SQL, op11_minhash_dedup
from spanframe.llm.packing import op3_best_fit_packing
from spanframe.llm.substring_dedup import op2_substring_dedup
from spanframe.llm.token_alignment import op13_token_alignment
from spanframe.llm.token_counts import op9_token_counts

QUERIES = (
    op1_byte_bpe,
    op2_substring_dedup,
    op3_best_fit_packing,
    op4_html_text,
    op5_jaccard_join,
    op6_additive_ann,
    op7_lm_scores,
    op8_fingerprints,
    op9_token_counts,
    op10_language_id,
    op11_minhash_dedup,
    op12_fill_in_middle,
    op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can say; each of the others is tested against a brute-force version or its library."""
    return {"op11_minhash_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
