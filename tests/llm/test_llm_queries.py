"""The subpackage's queries with SQL against DuckDB; all of them return their contract's columns."""

import compare
import pytest

from gridwise.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_output": "doc_id start n_tokens ids_crc32",
    "op2_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_jaccard_join": "doc_id n_shingles component_id",
    "op4_pii": "doc_id text n_replaced",
    "op5_quality_classifier": "doc_id held_out score predicted",
    "op6_decontaminate": "doc_id item_id similarity",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9_source_mixing": "doc_id size source_size target taken",
    "op10_url_filter": "page_id host path rule verdict",
    "op11_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op13_importance_resampling": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert compare.differences(spark, compare.connection(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, whole = docs.columns, docs.count()
    for name, f in cp.STAGES[:3]:
        docs = f(spark, docs, SF)
        assert docs.columns == columns and 0 < docs.count() <= whole, name
    assert cp.run(spark, SF).columns == COLUMNS["op1_token_output"].split()
