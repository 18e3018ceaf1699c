"""Cell-type expression: profiles, proportions, quality filter, gene programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom import constants

GROUP = ["cell_type", "condition"]


def expression_profile(expr: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Cells, mean, mean over expressing cells and percent expressing, per group and gene.

    Pass ``cells(cell_id, cell_type, condition)`` when zero values are not
    stored: means then divide by all cells of the group. Sums are of nine decimals, exact, so that they
    do not depend on the order of the rows.
    """
    value = F.col("value").cast("decimal(28,9)")
    positive = F.when(F.col("value") > 0, value)
    stats = expr.groupBy(*GROUP, "gene").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(value).cast("double").alias("total"),
        F.sum(positive).cast("double").alias("pos_total"), F.count(positive).alias("n_pos"))
    stats = stats.withColumn("pos_mean", F.coalesce(F.try_divide("pos_total", "n_pos"), F.lit(0.0)))
    if cells is None:
        sized = stats.withColumn("n_cells", F.col("n_rows"))
    else:
        sizes = cells.select("cell_id", *GROUP).distinct().groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_cells"))
        sized = stats.join(sizes, GROUP)
    return sized.select(
        *GROUP, "gene", "n_cells", F.round(F.col("total") / F.col("n_cells"), 6).alias("mean_expr"),
        F.round("pos_mean", 6).alias("mean_expr_pos"),
        F.round(F.lit(100.0) * F.col("n_pos") / F.col("n_cells"), 2).alias("pct_positive"))


def cell_proportions(expr: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Cells per (cell type, condition), zero groups included, and share of the condition."""
    cells = expr.select("cell_id", *GROUP).distinct()
    per_type = cells.groupBy("cell_type").agg(
        F.array(*[F.struct(F.lit(c).alias("condition"), F.count(F.when(F.col("condition") == c, 1)).alias("n_cells"))
                  for c in conditions]).alias("c"))
    long = per_type.select("cell_type", F.explode("c").alias("c")).select("cell_type", "c.*")
    whole = Window.partitionBy("condition")  # one row per cell type
    return long.withColumn("pct", F.coalesce(F.round(
        F.try_divide(F.lit(100.0) * F.col("n_cells"), F.sum("n_cells").over(whole)), 2), F.lit(0.0)))


def program_of(gene: Column, programs: dict[str, Sequence[str]] = constants.GENE_PROGRAMS) -> Column:
    out = None
    for name, genes in programs.items():
        hit = gene.isin(list(genes))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def label_programs(profile: DataFrame, programs: dict[str, Sequence[str]], condition: str) -> DataFrame:
    """Program genes of one condition, labelled."""
    labelled = profile.where(F.col("condition") == condition).withColumn("program", program_of(F.col("gene"), programs))
    return labelled.where(F.col("program").isNotNull())


def quality_cells(counts: DataFrame, min_genes: int = 200, max_genes: int = 6000, max_mito: float = 0.2) -> DataFrame:
    """Cells with enough but not too many detected genes and little mitochondrial signal."""
    per_cell = counts.groupBy("cell_id").agg(
        F.count_distinct(F.when(F.col("value") > 0, F.col("gene"))).alias("n_genes"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("is_mito"), F.col("value")).otherwise(0.0)), F.sum("value")),
                   F.lit(0.0)).alias("mito_share"))
    return per_cell.where((F.col("n_genes") > min_genes) & (F.col("n_genes") < max_genes)
                          & (F.col("mito_share") < max_mito))


def program_from_markers(markers: DataFrame, universe: DataFrame, drop_gene: str, min_fc: float = 0.5,
                         max_p: float = 0.05) -> DataFrame:
    """Up-regulated marker genes found in the universe, one gene left out."""
    up = markers.where((F.col("log2fc") > min_fc) & (F.col("p_adj") < max_p)).select(
        F.upper("gene").alias("gene"), "log2fc")
    return up.join(universe.select("gene"), "gene", "left_semi").where(F.col("gene") != drop_gene).orderBy(
        F.col("log2fc").desc(), "gene")
