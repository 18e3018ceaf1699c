"""Typed-graph views over the star-schema tables, for Spark and as SQL text."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.scalar import tidy
from edgeloom.session import spread

# Codes that make ids of different node types distinct in one id space.
TYPE_CODES = {"Customer": 0, "Supplier": 1, "Part": 2, "Nation": 3, "Region": 4}
TYPE_PRIORITY = ["Region", "Nation", "Hub", "Supplier", "Part", "Customer"]

# Split windows of the dated graph.
TRAIN_END, VAL_START, VAL_END = "1999-12-31", "2000-01-01", "2000-06-30"
TEST_START, TEST_END = "2000-07-01", "2001-06-30"
WINDOWS = dict(train_end=TRAIN_END, val_start=VAL_START, val_end=VAL_END,
               test_start=TEST_START, test_end=TEST_END)

SQL_VIEWS = {
    "g_nodes": """
        SELECT 'Customer' AS node_type, CAST(c_custkey AS BIGINT) AS idx, c_name AS name,
               CAST(NULL AS VARCHAR) AS pub_date FROM customer
        UNION ALL SELECT 'Supplier', CAST(s_suppkey AS BIGINT), s_name, NULL FROM supplier
        UNION ALL SELECT 'Part', CAST(p_partkey AS BIGINT), p_name,
               CAST(DATE '1995-01-01' + CAST((p_partkey * 37) % 2500 AS INT) AS VARCHAR) FROM part
        UNION ALL SELECT 'Nation', CAST(n_nationkey AS BIGINT), n_name, NULL FROM nation
        UNION ALL SELECT 'Region', CAST(r_regionkey AS BIGINT), r_name, NULL FROM region""",
    "g_edges": """
        SELECT 'Customer' AS src_type, 'BUYS' AS rel, 'Part' AS dst_type,
               CAST(o_custkey AS BIGINT) AS src, CAST(l_partkey AS BIGINT) AS dst,
               CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) AS pub_date,
               COUNT(*) AS weight
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
        UNION ALL
        SELECT 'Supplier', 'SUPPLIES', 'Part', CAST(l_suppkey AS BIGINT), CAST(l_partkey AS BIGINT),
               CAST(CAST(MIN(l_shipdate) AS DATE) AS VARCHAR), COUNT(*)
        FROM lineitem GROUP BY l_suppkey, l_partkey
        UNION ALL
        SELECT 'Customer', 'LOCATED_IN', 'Nation', CAST(c_custkey AS BIGINT),
               CAST(c_nationkey AS BIGINT), NULL, 1 FROM customer
        UNION ALL
        SELECT 'Supplier', 'LOCATED_IN', 'Nation', CAST(s_suppkey AS BIGINT),
               CAST(s_nationkey AS BIGINT), NULL, 1 FROM supplier
        UNION ALL
        SELECT 'Nation', 'PART_OF', 'Region', CAST(n_nationkey AS BIGINT),
               CAST(n_regionkey AS BIGINT), NULL, 1 FROM nation
        UNION ALL
        SELECT 'Region', 'HAS_HUB', 'Nation', CAST(n_regionkey AS BIGINT),
               CAST(MIN(n_nationkey) AS BIGINT), NULL, 1 FROM nation GROUP BY n_regionkey""",
    "g_split": f"""
        SELECT *, CASE
            WHEN COALESCE(TRY_CAST(pub_date AS DATE), DATE '1900-01-01') <= DATE '{TRAIN_END}' THEN 'train'
            WHEN TRY_CAST(pub_date AS DATE) BETWEEN DATE '{VAL_START}' AND DATE '{VAL_END}' THEN 'val'
            WHEN TRY_CAST(pub_date AS DATE) BETWEEN DATE '{TEST_START}' AND DATE '{TEST_END}' THEN 'test'
            ELSE 'dropped' END AS split
        FROM g_edges""",
    "g_ends": """
        SELECT src_type AS node_type, src AS idx, rel FROM g_edges
        UNION ALL SELECT dst_type, dst, rel FROM g_edges""",
    "g_degree": """
        SELECT node_type, idx, COUNT(*) AS degree FROM g_ends GROUP BY node_type, idx""",
    "g_labels": """
        SELECT idx * 8 + CASE node_type WHEN 'Customer' THEN 0 WHEN 'Supplier' THEN 1
               WHEN 'Part' THEN 2 WHEN 'Nation' THEN 3 ELSE 4 END AS node_id,
               'Entity' AS label, CASE WHEN idx % 11 = 0 THEN NULL ELSE name END AS name FROM g_nodes
        UNION ALL
        SELECT idx * 8 + CASE node_type WHEN 'Customer' THEN 0 WHEN 'Supplier' THEN 1
               WHEN 'Part' THEN 2 WHEN 'Nation' THEN 3 ELSE 4 END, node_type,
               CASE WHEN idx % 11 = 0 THEN NULL ELSE name END FROM g_nodes
        UNION ALL
        SELECT idx * 8 + CASE node_type WHEN 'Customer' THEN 0 WHEN 'Supplier' THEN 1
               WHEN 'Part' THEN 2 WHEN 'Nation' THEN 3 ELSE 4 END, 'Hub',
               CASE WHEN idx % 11 = 0 THEN NULL ELSE name END FROM g_nodes
        WHERE idx % 3 = 0 AND node_type = 'Part'""",
    "g_vectors": """
        SELECT CASE vec_id % 4 WHEN 0 THEN 'Gene' WHEN 2 THEN 'Protein' ELSE 'Disease' END AS node_type,
               vec_id AS idx,
               concat('entity-', CAST(label AS VARCHAR), ' form ', CAST(vec_id % 7 AS VARCHAR)) AS name,
               CAST(embedding AS DOUBLE[]) AS vec
        FROM embeddings""",
    "g_known": """
        SELECT DISTINCT s.node_type AS src_type,
               CASE j % 2 WHEN 0 THEN 'ASSOCIATED_WITH' ELSE 'PROMOTES' END AS rel,
               'Disease' AS dst_type, s.idx AS src, d.idx AS dst
        FROM g_vectors s, range(1, 5) t(j), g_vectors d
        WHERE s.node_type <> 'Disease' AND d.node_type = 'Disease'
          AND d.idx = 2 * ((s.idx * 37 + j * 101) % (SELECT COUNT(*) // 2 FROM embeddings)) + 1""",
    "g_articles": """
        SELECT CAST(doc_id AS VARCHAR) AS pmid, source AS entity, text AS abstract,
               CASE doc_id % 5
                 WHEN 0 THEN concat(CAST(1995 + doc_id % 8 AS VARCHAR), '-03-15')
                 WHEN 1 THEN concat(CAST(1995 + doc_id % 8 AS VARCHAR), '-07')
                 WHEN 2 THEN CAST(1995 + doc_id % 8 AS VARCHAR)
                 WHEN 3 THEN 'n.d.' ELSE NULL END AS pub_date
        FROM documents""",
    "g_article_dates": """
        SELECT *, CASE
            WHEN pub_date IS NULL THEN DATE '1900-01-01'
            WHEN regexp_matches(pub_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN CAST(pub_date AS DATE)
            WHEN regexp_matches(pub_date, '^\\d{4}-\\d{2}$') THEN CAST(pub_date || '-01' AS DATE)
            WHEN regexp_matches(pub_date, '^\\d{4}$') THEN CAST(pub_date || '-01-01' AS DATE)
            ELSE DATE '1900-01-01' END AS d
        FROM g_articles""",
    "g_scores": """
        SELECT l.doc_id AS item, l.quality AS is_pos, CAST(d.n_chars AS DOUBLE) AS score,
               l.doc_id % 5 AS seed
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "g_expr": """
        SELECT event_id AS cell_id, event_type AS cell_type,
               CASE WHEN user_id % 2 = 0 THEN 'Control' ELSE 'Case' END AS condition,
               concat('gene', CAST(user_id % 17 AS VARCHAR)) AS gene,
               CASE WHEN value < 5 THEN 0.0 ELSE value END AS value
        FROM events""",
    "g_ranked": """
        SELECT concat('P', CAST(l_partkey AS VARCHAR)) AS gene,
               round(AVG(l_discount) - 0.05, 6) + 0.0 AS stat
        FROM lineitem GROUP BY l_partkey""",
    "g_ranked_pos": """
        SELECT gene, stat, row_number() OVER (ORDER BY stat DESC, gene) AS pos,
               COUNT(*) OVER () AS n_total FROM g_ranked""",
    "g_gene_sets": """
        SELECT concat(p_brand, ' ', p_type) AS set_name, concat('P', CAST(p_partkey AS VARCHAR)) AS gene FROM part""",
}


def with_views(body: str, recursive: bool = False) -> str:
    """Prefixes the views that ``body`` uses, directly or through other views."""
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for view in SQL_VIEWS:
            if view not in need and re.search(rf"\b{view}\b", text):
                need.add(view)
                todo.append(SQL_VIEWS[view])
    ctes = [f"{view} AS ({SQL_VIEWS[view]})" for view in SQL_VIEWS if view in need]
    body = body.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        recursive = recursive or bool(own.group(1))
        body = body[own.end():]
        if ctes:
            body = ", ".join(ctes) + ", " + body
        return f"WITH {'RECURSIVE ' if recursive else ''}" + body
    if not ctes:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes) + "\n" + body


def _day(col) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd")


class Tables:
    """Lazily read tables and the graph views built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        no_date = F.lit(None).cast("string").alias("pub_date")

        def typed(table, kind, key, name, date=no_date):
            return self.read(table).select(
                F.lit(kind).alias("node_type"), F.col(key).cast("bigint").alias("idx"),
                F.col(name).alias("name"), date)

        part_date = _day(F.date_add(F.lit("1995-01-01").cast("date"),
                                    ((F.col("p_partkey") * 37) % 2500).cast("int"))).alias("pub_date")
        return (typed("customer", "Customer", "c_custkey", "c_name")
                .unionByName(typed("supplier", "Supplier", "s_suppkey", "s_name"))
                .unionByName(typed("part", "Part", "p_partkey", "p_name", part_date))
                .unionByName(typed("nation", "Nation", "n_nationkey", "n_name"))
                .unionByName(typed("region", "Region", "r_regionkey", "r_name")))

    def _relation(self, df, src_type, rel, dst_type, src, dst, date=None, weight=None) -> DataFrame:
        return df.select(
            F.lit(src_type).alias("src_type"), F.lit(rel).alias("rel"),
            F.lit(dst_type).alias("dst_type"), F.col(src).cast("bigint").alias("src"),
            F.col(dst).cast("bigint").alias("dst"),
            (F.lit(None).cast("string") if date is None else _day(F.col(date))).alias("pub_date"),
            (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("weight"))

    @cached_property
    def buys(self) -> DataFrame:
        lines = self.read("lineitem").select("l_orderkey", "l_partkey")
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        pairs = (spread(bought, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey")
                 .agg(F.min("o_orderdate").alias("d"), F.count(F.lit(1)).alias("w")))
        return self._relation(pairs, "Customer", "BUYS", "Part", "o_custkey", "l_partkey", "d", "w")

    @cached_property
    def supplies(self) -> DataFrame:
        pairs = (spread(self.read("lineitem"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey")
                 .agg(F.min("l_shipdate").alias("d"), F.count(F.lit(1)).alias("w")))
        return self._relation(pairs, "Supplier", "SUPPLIES", "Part", "l_suppkey", "l_partkey", "d", "w")

    @cached_property
    def places(self) -> DataFrame:
        hubs = self.read("nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("hub"))
        return (self._relation(self.read("customer"), "Customer", "LOCATED_IN", "Nation",
                               "c_custkey", "c_nationkey")
                .unionByName(self._relation(self.read("supplier"), "Supplier", "LOCATED_IN", "Nation",
                                            "s_suppkey", "s_nationkey"))
                .unionByName(self._relation(self.read("nation"), "Nation", "PART_OF", "Region",
                                            "n_nationkey", "n_regionkey"))
                .unionByName(self._relation(hubs, "Region", "HAS_HUB", "Nation", "n_regionkey", "hub")))

    @cached_property
    def edges(self) -> DataFrame:
        return self.buys.unionByName(self.supplies).unionByName(self.places)

    @cached_property
    def labels(self) -> DataFrame:
        """Per-label node scans: one row per (node, label)."""
        code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
        labels = F.filter(
            F.array(F.lit("Entity"), F.col("node_type"),
                    F.when((F.col("idx") % 3 == 0) & (F.col("node_type") == "Part"), F.lit("Hub"))),
            lambda x: x.isNotNull())
        return self.nodes.select(
            (F.col("idx") * 8 + code[F.col("node_type")]).alias("node_id"),
            F.explode(labels).alias("label"),
            F.when(F.col("idx") % 11 != 0, F.col("name")).alias("name"))

    @cached_property
    def vectors(self) -> DataFrame:
        kind = F.when(F.col("vec_id") % 4 == 0, "Gene").when(F.col("vec_id") % 4 == 2, "Protein")
        return self.read("embeddings").select(
            kind.otherwise("Disease").alias("node_type"), F.col("vec_id").alias("idx"),
            F.concat(F.lit("entity-"), F.col("label").cast("string"), F.lit(" form "),
                     (F.col("vec_id") % 7).cast("string")).alias("name"),
            F.col("embedding").cast("array<double>").alias("vec"))

    @cached_property
    def known(self) -> DataFrame:
        half = self.read("embeddings").count() // 2
        sources = self.vectors.where("node_type <> 'Disease'").select(
            F.col("node_type").alias("src_type"), F.col("idx").alias("src"),
            F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j"))
        linked = sources.select(
            "src_type", F.when(F.col("j") % 2 == 0, "ASSOCIATED_WITH").otherwise("PROMOTES").alias("rel"),
            F.lit("Disease").alias("dst_type"), "src",
            (2 * ((F.col("src") * 37 + F.col("j") * 101) % half) + 1).alias("dst"))
        targets = self.vectors.where("node_type = 'Disease'").select(F.col("idx").alias("dst"))
        return linked.distinct().join(targets, "dst", "left_semi").select(
            "src_type", "rel", "dst_type", "src", "dst")

    @cached_property
    def articles(self) -> DataFrame:
        year = (F.lit(1995) + F.col("doc_id") % 8).cast("string")
        kind = F.col("doc_id") % 5
        return self.read("documents").select(
            F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("entity"),
            F.col("text").alias("abstract"),
            F.when(kind == 0, F.concat(year, F.lit("-03-15")))
            .when(kind == 1, F.concat(year, F.lit("-07")))
            .when(kind == 2, year).when(kind == 3, F.lit("n.d.")).alias("pub_date"))

    @cached_property
    def scores(self) -> DataFrame:
        docs = self.read("documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
        return self.read("labels").join(docs, "doc_id").select(
            F.col("doc_id").alias("item"), F.col("quality").alias("is_pos"), "score",
            (F.col("doc_id") % 5).alias("seed"))

    @cached_property
    def expr(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("cell_id"), F.col("event_type").alias("cell_type"),
            F.when(F.col("user_id") % 2 == 0, "Control").otherwise("Case").alias("condition"),
            F.concat(F.lit("gene"), (F.col("user_id") % 17).cast("string")).alias("gene"),
            F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("value"))

    @cached_property
    def ranked(self) -> DataFrame:
        return self.read("lineitem").groupBy("l_partkey").agg(
            tidy(F.avg("l_discount") - 0.05).alias("stat")).select(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene"), "stat")

    @cached_property
    def gene_sets(self) -> DataFrame:
        return self.read("part").select(
            F.concat_ws(" ", "p_brand", "p_type").alias("set_name"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"))
