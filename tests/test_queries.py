"""Registered queries agree with their SQL twins on the smallest tables."""

import pytest
from check_queries import compare, connect

from edgeloom.queries import all_queries, all_sql

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "S1_node_scan_label_merge", "S4_article_dates_from_xml", "P1_priority_type", "P5_flexible_date", "P7_pathway_tags",
    "P11_regex_category", "J1_reindex_edges", "J3_inductive_routing", "J5_named_pair_resolution", "J6_edge_dating",
    "A3_degree", "A7_auroc", "A13_expression_profile", "W1_dense_ids", "W3_stratified_split", "T1_top_pairs_per_edge_type",
    "K8_first_epoch_rotate", "F7_two_layer_inference", "F5_pca_audit", "F2_token_information", "S12_feature_tables", "S4_article_files", "W5_raw_rank",
    "G10_global_ranking", "G2_cascade_summary", "K4_rotate_scores", "F8_attention_per_edge", "E2_nes", "F1_entity_summary",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    assert compare(all_queries()[name](spark, SF), con.sql(all_sql()[name])) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
