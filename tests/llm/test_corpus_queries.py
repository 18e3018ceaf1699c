"""Registered corpus queries on whole small tables, and the pipeline stage by stage."""

import pytest
from check_queries import compare, connect

import corpus_pipeline
from edgeloom.llm.registry import corpus_queries, corpus_sql
from edgeloom.session import cut_lineage

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"], "op2": ["vec_id", "n_links", "component_id", "kept"],
    "op3": ["doc_id", "held_out", "score", "predicted"], "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op9": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]}


@pytest.mark.parametrize("name", sorted(corpus_sql()))
def test_query_matches_sql(spark, name):
    assert compare(corpus_queries()[name](spark, SF), connect(SF).sql(corpus_sql()[name])) is None


def test_every_operator_has_its_columns(spark):
    names = corpus_queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    for name in ("op1_cross_parsing", "op5_byte_bpe", "op7_bwt_expansion", "op10_bootstrapped_pii", "op13_basic_factors"):
        rows = names[name](spark, SF)
        assert rows.columns[:len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]
        assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() <= kept, name
        kept = docs.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == kept and tokens.where("not lossless").count() == 0
