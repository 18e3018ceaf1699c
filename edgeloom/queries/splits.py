"""Temporal and stratified splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions.scalar import parse_date
from edgeloom.operators import splits as S
from edgeloom.queries.registry import query
from edgeloom.queries.views import TRAIN_END, WINDOWS

ROUTED_SQL = f"""
    SELECT e.*, CASE WHEN e.split <> 'test' THEN e.split
        WHEN COALESCE(CAST(a.pub_date AS DATE), DATE '1900-01-01') <= DATE '{TRAIN_END}'
         AND COALESCE(CAST(b.pub_date AS DATE), DATE '1900-01-01') <= DATE '{TRAIN_END}'
        THEN 'test' ELSE 'inductive' END AS route
    FROM g_split e LEFT JOIN g_nodes a ON a.node_type = e.src_type AND a.idx = e.src
    LEFT JOIN g_nodes b ON b.node_type = e.dst_type AND b.idx = e.dst"""
STRAT_SQL = """
    SELECT *, CASE WHEN n < 10 OR pos < n - nv - nt THEN 'train' WHEN pos < n - nt THEN 'val'
              ELSE 'test' END AS fold
    FROM (SELECT src_type, rel, dst_type, src, dst,
            row_number() OVER (PARTITION BY src_type, rel, dst_type
                ORDER BY md5(concat_ws('|', '42', src, dst)), src, dst) - 1 AS pos,
            COUNT(*) OVER (PARTITION BY src_type, rel, dst_type) AS n,
            greatest(1, CAST(floor(COUNT(*) OVER (PARTITION BY src_type, rel, dst_type)
                 * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS nv,
            greatest(1, CAST(floor(COUNT(*) OVER (PARTITION BY src_type, rel, dst_type)
                 * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS nt
          FROM (SELECT DISTINCT src_type, rel, dst_type, src, dst FROM g_edges))"""


@query("P5_flexible_date", """
    SELECT pmid, CAST(d AS VARCHAR) AS parsed FROM g_article_dates""")
def flexible_date(t):
    return t.articles.select("pmid", parse_date(F.col("pub_date")).cast("string").alias("parsed"))


@query("W8_temporal_split", """
    SELECT src_type, rel, dst_type, src, dst, split FROM g_split""")
def temporal(t):
    return S.temporal_split(t.edges, WINDOWS).select(*S.PAIR, "split")


@query("J3_inductive_routing", f"""
    SELECT src_type, rel, dst_type, src, dst, route AS split FROM ({ROUTED_SQL}) r""")
def routing(t):
    split = S.temporal_split(t.edges, WINDOWS).select(*S.PAIR, "split")
    return S.route_inductive(split, t.nodes, TRAIN_END)


@query("A5_temporal_report", f"""
    SELECT COUNT(*) FILTER (route = 'train') AS train_edges, COUNT(*) FILTER (route = 'val') AS val_edges,
           COUNT(*) FILTER (route = 'test') AS test_edges,
           COUNT(*) FILTER (route = 'inductive') AS inductive_edges,
           COUNT(DISTINCT concat(src_type, rel, dst_type)) FILTER (route = 'train') AS train_edge_types,
           COUNT(DISTINCT concat(src_type, rel, dst_type)) FILTER (route = 'test') AS test_edge_types,
           COUNT(*) FILTER (route = 'test') > 0 AS has_temporal_info,
           round(COUNT(*) FILTER (route = 'test')
                 / COUNT(*) FILTER (route IN ('test', 'inductive')), 6) AS transductive_fraction
    FROM ({ROUTED_SQL}) r""")
def temporal_report(t):
    split = S.temporal_split(t.edges, WINDOWS).select(*S.PAIR, "split")
    return S.temporal_report(S.route_inductive(split, t.nodes, TRAIN_END))


@query("W3_stratified_split", f"""
    SELECT src_type, rel, dst_type, src, dst, fold AS split FROM ({STRAT_SQL})""")
def stratified(t):
    return S.stratified_split(t.edges)


@query("A6_stratified_report", f"""
    SELECT CAST(SUM(tr) AS BIGINT) AS train_edges, CAST(SUM(va) AS BIGINT) AS val_edges,
           CAST(SUM(te) AS BIGINT) AS test_edges, COUNT(*) FILTER (tr > 0) AS train_edge_types,
           COUNT(*) FILTER (va > 0) AS val_edge_types, COUNT(*) FILTER (te > 0) AS test_edge_types,
           COUNT(*) FILTER (va = 0 AND te = 0) AS edge_types_without_split
    FROM (SELECT src_type, rel, dst_type, COUNT(*) FILTER (fold = 'train') AS tr,
                 COUNT(*) FILTER (fold = 'val') AS va, COUNT(*) FILTER (fold = 'test') AS te
          FROM ({STRAT_SQL}) GROUP BY src_type, rel, dst_type)""")
def stratified_report(t):
    return S.stratified_report(S.stratified_split(t.edges))


PAIRS = [("train", "val"), ("train", "test"), ("val", "test"), ("test", "inductive")]


@query("J15_leakage_audit", f"""
    WITH r AS ({ROUTED_SQL}),
    p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test'),
                                ('test', 'inductive')) v(split_a, split_b))
    SELECT split_a, split_b,
           (SELECT COUNT(DISTINCT (src_type, rel, dst_type, src, dst)) FROM r WHERE route = split_a) AS n_a,
           (SELECT COUNT(DISTINCT (src_type, rel, dst_type, src, dst)) FROM r WHERE route = split_b) AS n_b,
           (SELECT COUNT(*) FROM (SELECT src_type, rel, dst_type, src, dst FROM r WHERE route = split_a
                INTERSECT SELECT src_type, rel, dst_type, src, dst FROM r WHERE route = split_b)) AS overlap
    FROM p""")
def leakage(t):
    split = S.temporal_split(t.edges, WINDOWS).select(*S.PAIR, "split")
    return S.leakage_audit(S.route_inductive(split, t.nodes, TRAIN_END), PAIRS)


@query("U1_known_true_set", """
    SELECT DISTINCT src_type, rel, dst_type, src, dst FROM g_split
    WHERE split IN ('train', 'val', 'test') AND rel IN ('BUYS', 'SUPPLIES')""")
def known_true(t):
    return S.known_true(S.temporal_split(t.edges, WINDOWS), ["train", "val", "test"], ["BUYS", "SUPPLIES"])


@query("U2_message_graph", """
    SELECT src_type, rel, dst_type, src, dst, split FROM g_split WHERE split IN ('train', 'val')""")
def message_graph(t):
    return S.message_graph(S.temporal_split(t.edges, WINDOWS)).select(*S.PAIR, "split")
