"""Expression profiles and programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.operators import expression as X
from edgeloom.queries.registry import query

PROGRAMS = {"Axis A": ["gene1", "gene2", "gene3"], "Axis B": ["gene2", "gene7"], "Ligand": ["gene11"]}
PROFILE_SQL = """
    SELECT cell_type, condition, gene, COUNT(*) AS n_cells, round(SUM(value::DECIMAL(28, 9))::DOUBLE / COUNT(*), 6) AS mean_expr,
           round(COALESCE(SUM(value::DECIMAL(28, 9)) FILTER (value > 0)::DOUBLE / COUNT(*) FILTER (value > 0), 0), 6) AS mean_expr_pos,
           round(100.0 * COUNT(*) FILTER (value > 0) / COUNT(*), 2) AS pct_positive
    FROM g_expr GROUP BY cell_type, condition, gene"""


@query("A13_expression_profile", PROFILE_SQL)
def profile(t):
    return X.expression_profile(t.expr)


@query("A13_profile_zero_suppressed", """
    SELECT e.cell_type, e.condition, e.gene, g.n_cells, round(SUM(value::DECIMAL(28, 9))::DOUBLE / g.n_cells, 6) AS mean_expr,
           round(SUM(value::DECIMAL(28, 9))::DOUBLE / COUNT(*), 6) AS mean_expr_pos, round(100.0 * COUNT(*) / g.n_cells, 2) AS pct_positive
    FROM (SELECT * FROM g_expr WHERE value > 0) e JOIN (SELECT cell_type, condition, COUNT(DISTINCT cell_id) AS n_cells
          FROM g_expr GROUP BY 1, 2) g ON g.cell_type = e.cell_type AND g.condition = e.condition
    GROUP BY e.cell_type, e.condition, e.gene, g.n_cells""")
def sparse_profile(t):
    return X.expression_profile(t.expr.where("value > 0"), t.expr)


@query("A14_cell_proportions", """
    WITH c AS (SELECT DISTINCT cell_id, cell_type, condition FROM g_expr),
    d AS (SELECT t.cell_type, k.condition, COUNT(c.cell_id) AS n_cells
          FROM (SELECT DISTINCT cell_type FROM c) t CROSS JOIN (VALUES ('Case'), ('Control'), ('Sham')) k(condition)
          LEFT JOIN c ON c.cell_type = t.cell_type AND c.condition = k.condition GROUP BY 1, 2)
    SELECT cell_type, condition, n_cells, COALESCE(round(CASE WHEN SUM(n_cells) OVER (PARTITION BY condition) > 0
           THEN 100.0 * n_cells / SUM(n_cells) OVER (PARTITION BY condition) END, 2), 0) AS pct FROM d""")
def proportions(t):
    return X.cell_proportions(t.expr, ["Case", "Control", "Sham"])


@query("P12_program_labels", f"""
    SELECT *, CASE WHEN gene IN ('gene1', 'gene2', 'gene3') THEN 'Axis A' WHEN gene = 'gene7' THEN 'Axis B'
              ELSE 'Ligand' END AS program
    FROM ({PROFILE_SQL}) WHERE condition = 'Case' AND gene IN ('gene1', 'gene2', 'gene3', 'gene7', 'gene11')""")
def programs(t):
    return X.label_programs(X.expression_profile(t.expr), PROGRAMS, "Case")


@query("P13_cell_quality", """
    SELECT cell_id, n_genes, round(mito, 6) AS mito_share FROM (
      SELECT l_orderkey AS cell_id, COUNT(DISTINCT CASE WHEN l_quantity > 0 THEN l_partkey END) AS n_genes,
             SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / SUM(l_quantity) AS mito
      FROM lineitem GROUP BY l_orderkey) WHERE n_genes > 2 AND n_genes < 7 AND mito < 0.2""")
def quality(t):
    counts = t.read("lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value"),
        (F.col("l_returnflag") == "R").alias("is_mito"))
    return X.quality_cells(counts, 2, 7, 0.2).withColumn("mito_share", F.round("mito_share", 6))


@query("P14_program_from_markers", """
    SELECT upper(gene) AS gene, log2fc FROM (
      SELECT concat('p', l_partkey) AS gene, round(AVG(l_quantity) / 25.0 - 0.4, 6) AS log2fc,
             round(AVG(l_tax), 6) AS p_adj FROM lineitem GROUP BY l_partkey)
    WHERE log2fc > 0.5 AND p_adj < 0.05 AND upper(gene) IN (SELECT gene FROM g_ranked WHERE stat > 0)
      AND upper(gene) <> 'P7'""")
def marker_program(t):
    markers = t.read("lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_quantity") / 25.0 - 0.4, 6).alias("log2fc"), F.round(F.avg("l_tax"), 6).alias("p_adj")).select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("gene"), "log2fc", "p_adj")
    return X.program_from_markers(markers, t.ranked.where("stat > 0"), "P7")
