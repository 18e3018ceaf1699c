"""Graph loading, typing, indexing and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.operators import graph as G
from edgeloom.queries.registry import query
from edgeloom.queries.views import TYPE_CODES, TYPE_PRIORITY

ALLOWED = [("Customer", "BUYS", "Part"), ("Supplier", "SUPPLIES", "Part"),
           ("Nation", "PART_OF", "Region"), ("Part", "MADE_OF", "Material")]
ANCHORS = ["red widget", "nation_7", "asia", "supplier#000000003", "customer#000000001", "unicorn"]
CATEGORIES = {"BUYS": "Trade", "SUPPLIES": "Trade", "LOCATED_IN": "Place", "PART_OF": "Place"}
TAU = [("BUYS", 0.5), ("SUPPLIES", 0.7), ("LOCATED_IN", 2.0), ("BUYS", 4.0)]
CODE_SQL = ("CASE node_type WHEN 'Customer' THEN 0 WHEN 'Supplier' THEN 1 WHEN 'Part' THEN 2 "
            "WHEN 'Nation' THEN 3 ELSE 4 END")
MERGED_SQL = """
    SELECT node_id, list_sort(list(DISTINCT label)) AS labels,
           COALESCE(MIN(name), CAST(node_id AS VARCHAR)) AS name
    FROM g_labels GROUP BY node_id"""
TYPE_SQL = ("CASE " + " ".join(f"WHEN list_contains(labels, '{t}') THEN '{t}'" for t in TYPE_PRIORITY)
            + " ELSE COALESCE(labels[1], 'Entity') END")


def with_ids(t):
    """Typed nodes with ids that are unique over all types."""
    code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    return t.nodes.withColumn("node_id", F.col("idx") * 8 + code[F.col("node_type")])


def id_edges(t):
    """Edges whose endpoints are the all-type ids."""
    code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    return t.edges.withColumn("src", F.col("src") * 8 + code[F.col("src_type")]).withColumn(
        "dst", F.col("dst") * 8 + code[F.col("dst_type")])


@query("S1_node_scan_label_merge", f"""
    SELECT node_id, array_to_string(labels, '|') AS labels, name FROM ({MERGED_SQL})""")
def node_scan(t):
    return G.merge_labels(t.labels).withColumn("labels", F.concat_ws("|", "labels"))


@query("S2_edge_scan", """
    SELECT src_type, rel, dst_type, src, dst,
           CAST(COALESCE(CASE WHEN weight > 1 THEN weight END, 1) AS BIGINT) AS weight FROM g_edges""")
def edge_scan(t):
    raw = t.edges.withColumn("pmid_count", F.when(F.col("weight") > 1, F.col("weight")))
    return G.edge_scan(raw).select("src_type", "rel", "dst_type", "src", "dst", "weight")


@query("S3_label_counts", """
    SELECT label, COUNT(DISTINCT node_id) AS n_nodes FROM g_labels GROUP BY label""")
def label_counts(t):
    return G.label_counts(G.merge_labels(t.labels))


@query("P1_priority_type", f"SELECT node_id, {TYPE_SQL} AS node_type FROM ({MERGED_SQL})")
def priority_type(t):
    return G.merge_labels(t.labels).select(
        "node_id", G.assign_type(F.col("labels"), TYPE_PRIORITY).alias("node_type"))


@query("P2_edge_allow_list", """
    SELECT src_type, rel, dst_type, src, dst FROM g_edges
    WHERE concat(src_type, '__', rel, '__', dst_type) IN
          ('Customer__BUYS__Part', 'Supplier__SUPPLIES__Part', 'Nation__PART_OF__Region',
           'Part__MADE_OF__Material')
      AND src_type IN (SELECT node_type FROM g_nodes) AND dst_type IN (SELECT node_type FROM g_nodes)""")
def allow_list(t):
    return G.allowed_edges(t.edges, t.nodes, ALLOWED).select("src_type", "rel", "dst_type", "src", "dst")


@query("P3_nonempty_types", """
    SELECT node_type, COUNT(*) AS n_nodes FROM g_nodes
    WHERE node_type IN ('Customer', 'Supplier', 'Part', 'Material', 'Region') GROUP BY node_type""")
def nonempty(t):
    return G.nonempty_types(t.nodes, ["Customer", "Supplier", "Part", "Material", "Region"])


@query("P4_display_name", """
    SELECT node_type, idx, CASE WHEN nm IS NULL OR nm = '' THEN concat(node_type, '_', idx) ELSE nm END
           AS display FROM (SELECT node_type, idx, CASE WHEN idx % 7 = 0 THEN NULL
           WHEN idx % 7 = 1 THEN '' ELSE name END AS nm FROM g_nodes)""")
def display_name(t):
    holes = F.when(F.col("idx") % 7 == 1, "").when(F.col("idx") % 7 != 0, F.col("name"))
    return t.nodes.select("node_type", "idx", G.display_name(
        holes, F.col("node_type"), F.col("idx")).alias("display"))


@query("P17_temperature_lookup", """
    SELECT DISTINCT src_type, rel, dst_type,
           CAST(CASE rel WHEN 'BUYS' THEN 4.0 WHEN 'SUPPLIES' THEN 0.7 WHEN 'LOCATED_IN' THEN 2.0
                ELSE 1.0 END AS DOUBLE) AS tau FROM g_edges""")
def temperature(t):
    return G.temperatures(t.edges, TAU)


@query("P19_hub_flag", """
    SELECT n.node_type, n.idx, n.name, COALESCE(d.degree, 0) AS degree,
           COALESCE(d.degree, 0) >= 100 OR n.name IN ('ASIA', 'NATION_7') AS is_hub
    FROM g_nodes n LEFT JOIN g_degree d ON n.node_type = d.node_type AND n.idx = d.idx""")
def hub_flag(t):
    return G.hub_flags(t.nodes, t.edges, 100, ["ASIA", "NATION_7"])


IDS_SQL = f"""
    SELECT node_type, node_id, row_number() OVER (PARTITION BY node_type ORDER BY node_id) - 1 AS local_idx,
           row_number() OVER (ORDER BY node_type, node_id) - 1 AS global_id
    FROM (SELECT node_type, idx * 8 + {CODE_SQL} AS node_id FROM g_nodes)"""


@query("W1_dense_ids", IDS_SQL)
def dense_ids(t):
    return G.dense_ids(with_ids(t).select("node_type", "node_id")).select(
        "node_type", "node_id", "local_idx", "global_id")


@query("W1_relation_ids", """
    SELECT src_type, rel, dst_type, relation, row_number() OVER (ORDER BY relation) - 1 AS relation_id
    FROM (SELECT DISTINCT src_type, rel, dst_type, concat(src_type, '__', rel, '__', dst_type) AS relation
          FROM g_edges)""")
def relation_ids(t):
    return G.relation_ids(t.edges)


@query("J1_reindex_edges", f"""
    WITH ids AS (SELECT * FROM ({IDS_SQL}) WHERE node_type <> 'Region'),
    m AS (SELECT e.src_type, e.rel, e.dst_type, a.local_idx AS src_idx, b.local_idx AS dst_idx
          FROM (SELECT src_type, rel, dst_type, src * 8 + {CODE_SQL.replace('node_type', 'src_type')} AS s,
                       dst * 8 + {CODE_SQL.replace('node_type', 'dst_type')} AS d FROM g_edges) e
          LEFT JOIN ids a ON a.node_type = e.src_type AND a.node_id = e.s
          LEFT JOIN ids b ON b.node_type = e.dst_type AND b.node_id = e.d)
    SELECT src_type, rel, dst_type, src_idx, dst_idx
    FROM (SELECT *, bool_or(src_idx IS NULL OR dst_idx IS NULL) OVER (PARTITION BY src_type, rel, dst_type) AS broken FROM m)
    WHERE NOT broken""")
def reindex(t):
    ids = G.dense_ids(with_ids(t).where("node_type <> 'Region'").select("node_type", "node_id"))
    return G.reindex_edges(id_edges(t), ids).select("src_type", "rel", "dst_type", "src_idx", "dst_idx")


@query("J2_discover_edge_types", """
    SELECT src_type, rel, dst_type, COUNT(*) AS n_edges FROM g_edges GROUP BY src_type, rel, dst_type""")
def discover(t):
    return G.discover_edge_types(id_edges(t), with_ids(t))


@query("A1_type_distribution", "SELECT node_type, COUNT(*) AS n_nodes FROM g_nodes GROUP BY node_type")
def type_distribution(t):
    return G.type_distribution(t.nodes)


@query("A2_category_stats", """
    SELECT category, COUNT(DISTINCT concat(src_type, '__', rel, '__', dst_type)) AS n_relations,
           COUNT(*) AS n_edges
    FROM (SELECT *, CASE rel WHEN 'BUYS' THEN 'Trade' WHEN 'SUPPLIES' THEN 'Trade'
                 WHEN 'LOCATED_IN' THEN 'Place' WHEN 'PART_OF' THEN 'Place' ELSE 'Other' END AS category
          FROM g_edges) GROUP BY category""")
def category_stats(t):
    return G.category_stats(t.edges, CATEGORIES)


@query("A3_degree", """
    SELECT n.node_type, n.idx, COALESCE(o.c, 0) AS out_degree, COALESCE(i.c, 0) AS in_degree,
           COALESCE(o.c, 0) + COALESCE(i.c, 0) AS degree
    FROM g_nodes n
    LEFT JOIN (SELECT src_type, src, COUNT(*) c FROM g_edges GROUP BY 1, 2) o
           ON o.src_type = n.node_type AND o.src = n.idx
    LEFT JOIN (SELECT dst_type, dst, COUNT(*) c FROM g_edges GROUP BY 1, 2) i
           ON i.dst_type = n.node_type AND i.dst = n.idx""")
def degree(t):
    return G.node_degrees(t.nodes, t.edges)


@query("A4_anchor_connectivity", """
    WITH anchors AS (SELECT unnest(['red widget', 'nation_7', 'asia', 'supplier#000000003',
                                    'customer#000000001', 'unicorn']) AS anchor),
    hit AS (SELECT a.anchor, n.node_type, n.idx,
                   row_number() OVER (PARTITION BY a.anchor ORDER BY n.node_type, n.idx) AS rn
            FROM anchors a JOIN g_nodes n ON contains(lower(n.name), lower(a.anchor)))
    SELECT a.anchor, h.node_type, h.idx, COALESCE(d.degree, 0) AS degree,
           CASE WHEN h.idx IS NULL THEN 'NOT FOUND' WHEN COALESCE(d.degree, 0) > 0 THEN 'CONNECTED'
                ELSE 'ISOLATED' END AS status
    FROM anchors a LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h ON h.anchor = a.anchor
    LEFT JOIN g_degree d ON d.node_type = h.node_type AND d.idx = h.idx""")
def anchors(t):
    return G.anchor_check(t.nodes, t.edges, ANCHORS)


@query("U6_reverse_closure", """
    SELECT src_type, rel, dst_type, src, dst FROM g_edges
    UNION ALL SELECT dst_type, concat('rev_', rel), src_type, dst, src FROM g_edges""")
def reverse(t):
    return G.with_reverse(t.edges)


@query("W2_first_occurrence", """
    SELECT src, dst, l_orderkey, l_linenumber FROM (
      SELECT o_custkey AS src, l_partkey AS dst, l_orderkey, l_linenumber,
             row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS rn
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""")
def first_occurrence(t):
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    orders = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return G.first_occurrence(lines.join(orders, "l_orderkey"), ["src", "dst"],
                              ["l_orderkey", "l_linenumber"])


@query("J16_meta_path", """
    SELECT s.dst AS src, r.dst AS dst, COUNT(*) AS n_paths
    FROM g_edges s JOIN g_edges l ON s.rel = 'SUPPLIES' AND l.rel = 'LOCATED_IN'
                                 AND l.src_type = 'Supplier' AND l.src = s.src
    JOIN g_edges r ON r.rel = 'PART_OF' AND r.src = l.dst
    GROUP BY s.dst, r.dst""")
def meta_path(t):
    return G.meta_path(t.edges, [("Part", "rev_SUPPLIES", "Supplier"), ("Supplier", "LOCATED_IN", "Nation"),
                                 ("Nation", "PART_OF", "Region")])
