"""File sources and sinks, written to and read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions.scalar import layer_norm, vector_text
from edgeloom.operators import evidence as E
from edgeloom.operators import graph as G
from edgeloom.operators import splits as S
from edgeloom.queries.evidence import MASK_SQL
from edgeloom.queries.features import norm_sql, text_sql
from edgeloom.queries.literature import XML_SQL, article_xml
from edgeloom.queries.registry import query
from edgeloom.queries.scoring import RANKED_SQL, ranked_targets
from edgeloom.queries.splits import STRAT_SQL
from edgeloom.session import side_table
from edgeloom.sources import readers as R
from edgeloom.sources import writers as W

MAP_SQL = """
    SELECT node_type, idx, name, row_number() OVER (ORDER BY node_type, idx) - 1 AS gid FROM g_nodes"""
RELATION_SQL = """
    SELECT src_type, rel, dst_type, concat(src_type, '__', rel, '__', dst_type) AS relation,
           row_number() OVER (ORDER BY concat(src_type, '__', rel, '__', dst_type)) - 1 AS rid
    FROM (SELECT DISTINCT src_type, rel, dst_type FROM g_edges)"""
TRIPLE_SQL = f"""
    SELECT a.gid AS head, r.rid AS relation, b.gid AS tail, a.name AS head_name, b.name AS tail_name,
           r.relation AS relation_name
    FROM g_edges e JOIN ({MAP_SQL}) a ON a.node_type = e.src_type AND a.idx = e.src
    JOIN ({MAP_SQL}) b ON b.node_type = e.dst_type AND b.idx = e.dst
    JOIN ({RELATION_SQL}) r ON r.src_type = e.src_type AND r.rel = e.rel AND r.dst_type = e.dst_type"""


def triples(t):
    entities = G.dense_ids(t.nodes.select("node_type", "idx", "name"), "idx")
    return W.triple_table(t.edges, entities, G.relation_ids(t.edges))


@query("S10_triple_export", TRIPLE_SQL)
def triple_export(t):
    path = side_table(t.spark, "triples")
    W.write_triples(triples(t), path)
    return t.spark.read.schema(R.TRIPLE_SCHEMA).option("header", True).csv(path)


@query("S6_triple_scan", f"SELECT head, relation, tail FROM ({TRIPLE_SQL})")
def triple_scan(t):
    path = side_table(t.spark, "triples")
    W.write_triples(triples(t), path)
    return R.read_triples(t.spark, path)


@query("S11_id_maps", f"""
    SELECT 'entity' AS kind, concat(node_type, ':', idx) AS key, gid AS id FROM ({MAP_SQL})
    UNION ALL SELECT 'relation', relation, rid FROM ({RELATION_SQL})""")
def id_maps(t):
    path = side_table(t.spark, "maps")
    W.write_maps(G.dense_ids(t.nodes.select("node_type", "idx"), "idx"), G.relation_ids(t.edges), path)
    entities = t.spark.read.schema("node_type string, idx bigint, global_id bigint").json(f"{path}/entity_map")
    relations = t.spark.read.schema("relation string, relation_id bigint").json(f"{path}/relation_map")
    return entities.select(F.lit("entity").alias("kind"), F.concat_ws(":", "node_type", "idx").alias("key"),
                           F.col("global_id").alias("id")).unionByName(
        relations.select(F.lit("relation").alias("kind"), F.col("relation").alias("key"), F.col("relation_id").alias("id")))


@query("S12_dataset_round_trip", f"""
    SELECT src_type, rel, dst_type, src, dst, fold AS split FROM ({STRAT_SQL}) WHERE fold IN ('val', 'test')""")
def dataset(t):
    path = side_table(t.spark, "dataset")
    W.write_dataset(S.stratified_split(t.edges), S.stratified_report, path)
    # Partition pruning: only the val and test folders are listed and read.
    back = t.spark.read.parquet(f"{path}/edges").where(F.col("split").isin("val", "test"))
    return back.select(*[F.col(c).cast("string") if c in ("src_type", "rel", "dst_type", "split") else F.col(c)
                         for c in (*S.PAIR, "split")])


CANDIDATE_SQL = f"""
    SELECT pos AS rank, canonical AS canonical_name, src_name AS original_name, src_type, dst_name AS disease,
           sc AS score, rel AS relation, canonical = 'ENTITY ONE' AS is_par2 FROM ({RANKED_SQL})"""


def written_candidates(t):
    path = side_table(t.spark, "ranked")
    ranked = ranked_targets(t).select(
        "rank", "canonical_name", "original_name", "src_type", "disease", "score", F.col("rel").alias("relation"),
        (F.col("canonical_name") == "ENTITY ONE").alias("is_par2"))
    W.write_ranked(ranked, path)
    return path


@query("S14_ranked_sink", CANDIDATE_SQL)
def ranked_sink(t):
    return t.spark.read.schema(R.CANDIDATE_SCHEMA).json(written_candidates(t))


@query("S14_subgraph_sink", f"""
    WITH k AS (SELECT * FROM ({MASK_SQL}) WHERE mask >= 0.3)
    SELECT 'edge' AS kind, COUNT(*) AS n FROM k UNION ALL SELECT 'node', COUNT(*) FROM
      (SELECT src_type, src FROM k UNION SELECT dst_type, dst FROM k)""")
def subgraph_sink(t):
    path = side_table(t.spark, "subgraph")
    masked = t.edges.withColumn("mask", ((F.col("src") * 31 + F.col("dst") * 17) % 100) / 100.0)
    kept, nodes = E.extract_subgraph(masked, "mask", 0.3)
    W.write_subgraph(kept, nodes, path)
    edges = t.spark.read.option("header", True).csv(f"{path}/edges")
    back = t.spark.read.option("header", True).csv(f"{path}/nodes")
    return edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "n").unionByName(
        back.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "n"))


@query("S7_nested_json_scan", """
    SELECT n_name AS gene, CAST(n_regionkey AS BIGINT) AS chromosome, 'NATION' AS source FROM nation""")
def nested_json(t):
    # One document per region, each with its array of records.
    path = side_table(t.spark, "targets")
    records = t.read("nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(
        F.col("n_name").alias("gene"), F.col("n_regionkey").cast("bigint").alias("chromosome"),
        F.lit("NATION").alias("source"))).alias("targets"))
    records.select("targets").write.json(path)
    return R.read_target_list(t.spark, path, "targets", "gene:string,chromosome:bigint,source:string", multi_line=False)


@query("S4_article_files", XML_SQL)
def article_files(t):
    # Records as files of the citation index, many to a file; the reader splits files by record.
    path = side_table(t.spark, "articles")
    article_xml(t).write.text(path)
    return R.article_dates(R.read_articles(t.spark, path, whole_files=False))


FEATURE_SQL = f"""
    WITH k AS (SELECT *, CASE (src // 4 + dst) % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM g_known),
    n AS (SELECT DISTINCT split, src_type AS node_type, src AS idx FROM k UNION SELECT DISTINCT split, dst_type, dst FROM k),
    f AS ({norm_sql("SELECT concat(n.split, '|', n.node_type) AS node_type, n.idx, v.vec FROM n JOIN g_vectors v ON v.node_type = n.node_type AND v.idx = n.idx")})
    SELECT split_part(node_type, '|', 1) AS split, split_part(node_type, '|', 2) AS node_type, idx, {text_sql('vec')} AS vec FROM f"""


@query("S12_feature_tables", FEATURE_SQL)
def feature_tables(t):
    path = side_table(t.spark, "dataset")
    part = (F.floor(F.col("src") / 4) + F.col("dst")) % 5
    edges = t.known.withColumn("split", F.when(part == 0, "val").when(part == 1, "test").otherwise("train"))
    vectors = t.vectors.select("node_type", "idx", layer_norm(F.col("vec")).alias("vec"))
    back = None
    for split in ("train", "val", "test"):
        own = edges.where(F.col("split") == split)
        nodes = own.select(F.explode(F.array(F.struct(F.col("src_type").alias("node_type"), F.col("src").alias("idx")),
                                             F.struct(F.col("dst_type").alias("node_type"), F.col("dst").alias("idx")))).alias("n")).select("n.*").distinct()
        W.write_features(vectors.join(nodes, ["node_type", "idx"], "left_semi"), path, split)
        table = R.read_features(t.spark, path, split).select(F.lit(split).alias("split"), "node_type", "idx", vector_text(F.col("vec")).alias("vec"))
        back = table if back is None else back.unionByName(table)
    return back
