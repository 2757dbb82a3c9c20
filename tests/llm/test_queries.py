"""Every registered query runs over the smallest tables and gives the columns and rows it should."""

import pytest

import corpus_pipeline
from spanframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"), "op2": ("documents", "doc_id text n_chars n_removed n_spans"), "op3": (None, "doc_id piece start length ids_crc32 sequence_id offset"),
    "op4": ("pages", "page_id url text n_chars"), "op5": ("documents", "doc_id n_shingles component_id"), "op6": (None, "query_id rank vec_id score"), "op7": ("documents", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    "op8": ("documents", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"), "op9": ("documents", "doc_id n_bytes n_tokens over_limit"), "op10": ("documents", "doc_id held_out lang_pred score"),
    "op11": ("documents", "doc_id n_shingles component_id kept"),
    "op13": ("documents", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
    "op12": ("documents", "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256"),
}


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_query(spark, query):
    rows = query(spark, SF)
    table, columns = COLUMNS[query.__name__.split("_")[0]]
    assert rows.columns[: len(columns.split())] == columns.split()
    n = rows.count()
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if table else n > 0


def test_pipeline(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "best_fit_packing"]
