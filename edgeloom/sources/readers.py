"""Readers for node, edge, triple, citation, candidate and statistic files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Citation-index records; months stay text because some are names.
_STAMP = "Year:string,Month:string,Day:string"
ARTICLE_SCHEMA = (
    "MedlineCitation struct<PMID:string,Article:struct<"
    f"Journal:struct<JournalIssue:struct<PubDate:struct<{_STAMP}>>>,"
    f"ArticleDate:array<struct<{_STAMP}>>>>,"
    f"PubmedData struct<History:struct<PubMedPubDate:array<struct<_PubStatus:string,{_STAMP}>>>>"
)
TRIPLE_SCHEMA = ("head bigint, relation bigint, tail bigint, head_name string, tail_name string, "
                 "relation_name string")
CANDIDATE_SCHEMA = ("rank bigint, canonical_name string, original_name string, src_type string, "
                    "disease string, score double, relation string, is_par2 boolean")


def read_articles(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Citation-index XML files, one row per article.

    A file is one document and one task. With ``whole_files=False`` files are split among tasks at
    record tags, and need no root element.
    """
    return spark.read.format("xml").option("rowTag", "PubmedArticle").option("multiLine", whole_files).schema(ARTICLE_SCHEMA).load(path)


def _stamp_text(stamp: Column) -> Column:
    def two(part: str) -> Column:
        text = F.coalesce(stamp[part], F.lit("01"))
        return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))

    return F.when(F.coalesce(stamp["Year"], F.lit("")) != "",
                  F.concat_ws("-", stamp["Year"], two("Month"), two("Day")))


def article_dates(articles: DataFrame) -> DataFrame:
    """Best available date per article; articles without a year are left out."""
    history = F.col("PubmedData.History.PubMedPubDate")
    indexed = F.filter(history, lambda s: s["_PubStatus"] == "pubmed")
    best = F.coalesce(F.try_element_at(indexed, F.lit(1)), F.try_element_at(history, F.lit(1)))
    date = F.coalesce(
        _stamp_text(F.try_element_at(F.col("MedlineCitation.Article.ArticleDate"), F.lit(1))),
        _stamp_text(best),
        _stamp_text(F.col("MedlineCitation.Article.Journal.JournalIssue.PubDate")))
    return articles.select(F.col("MedlineCitation.PMID").alias("pmid"), date.alias("pub_date")).where(
        F.col("pmid").isNotNull() & F.col("pub_date").isNotNull())


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIPLE_SCHEMA).option("header", True).csv(path).select(
        "head", "relation", "tail")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Ranked candidates: a JSON array of records, or one record per line."""
    return spark.read.schema(CANDIDATE_SCHEMA).option("multiLine", True).json(path)


def read_target_list(spark: SparkSession, path: str, field: str, record: str, multi_line: bool = True) -> DataFrame:
    """Rows of the record array ``field`` of nested JSON documents.

    A file of one indented document is one task. Files with a document a line
    (``multi_line=False``) are split among tasks.
    """
    schema = f"{field} array<struct<{record}>>"
    return spark.read.schema(schema).option("multiLine", multi_line).json(path).select(
        F.explode(field).alias("r")).select("r.*")


def read_features(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The feature table of one split, as ``write_features`` leaves it."""
    return spark.read.schema("idx bigint, vec array<double>, node_type string").parquet(f"{path}/features/{split}")


def clean_statistics(table: DataFrame, gene: str, stat: str, file_order: Column) -> DataFrame:
    """Upper-cased genes with a statistic; the first row per gene in file order wins."""
    rows = table.where(F.col(stat).isNotNull()).select(
        F.upper(F.col(gene)).alias("gene"), F.col(stat).cast("double").alias("stat"),
        file_order.alias("_order"))
    return rows.groupBy("gene").agg(F.min_by("stat", "_order").alias("stat"))


def read_gene_program(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema("gene string").option("header", True).csv(path).select(
        F.lit(name).alias("set_name"), "gene")
