"""Publication dates, summaries and evidence counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.operators import literature as L
from edgeloom.queries.registry import query
from edgeloom.sources import readers

ERAS = dict(train_end="1997-12-31", val_start="1998-01-01", val_end="1998-06-30",
            test_start="1998-07-01", test_end="2001-12-31")
ERA_SQL = ("CASE WHEN d <= DATE '1997-12-31' THEN 'train_era' WHEN d <= DATE '1998-06-30' THEN 'val_era' "
           "WHEN d <= DATE '2001-12-31' THEN 'prospective' ELSE 'post_window' END")
EDGE_ID = ["src_type", "rel", "dst_type", "src", "dst"]
SUPPORT_SQL = """
    SELECT src_type, rel, dst_type, src, dst, MIN(a.pub_date) AS pub_date
    FROM (SELECT *, unnest([src % nd, (src * 7 + dst * 3) % nd]) AS doc FROM g_edges,
                 (SELECT COUNT(*) AS nd FROM documents)) e
    LEFT JOIN g_articles a ON a.pmid = CAST(e.doc AS VARCHAR) AND a.pub_date <> 'n.d.'
    GROUP BY src_type, rel, dst_type, src, dst"""


def supported_edges(t):
    n = t.read("documents").count()
    ids = F.array(F.col("src") % n, (F.col("src") * 7 + F.col("dst") * 3) % n)
    return t.edges.withColumn("pmids", ids.cast("array<string>"))


def usable_dates(t):
    return t.articles.where("pub_date <> 'n.d.'").select("pmid", "pub_date")


def article_xml(t):
    """Records in citation-index XML, built from the documents table."""
    year = (1980 + F.col("doc_id") % 40).cast("string")
    month = (1 + F.col("doc_id") % 12).cast("string")

    def stamp(tag, attr, *parts):
        body = [F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>")) for n, v in parts]
        return F.concat(F.lit(f"<{tag}{attr}>"), *body, F.lit(f"</{tag}>"))

    kind = F.col("doc_id") % 5
    article_date = F.when(kind == 0, stamp("ArticleDate", "", ("Year", year), ("Month", month), ("Day", F.lit("7"))))
    issue = F.when(kind == 3, stamp("PubDate", "", ("Year", year), ("Month", F.lit("Jan"))))
    entrez = stamp("PubMedPubDate", ' PubStatus="entrez"', ("Year", F.lit("1900")))
    pubmed = stamp("PubMedPubDate", ' PubStatus="pubmed"', ("Year", year), ("Month", month))
    history = F.when(kind == 1, F.concat(entrez, pubmed)).when(kind == 2, entrez)
    blank = F.lit("")
    return t.read("documents").select(F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"),
        F.lit("</PMID><Article><Journal><JournalIssue>"), F.coalesce(issue, blank),
        F.lit("</JournalIssue></Journal>"), F.coalesce(article_date, blank),
        F.lit("</Article></MedlineCitation><PubmedData><History>"), F.coalesce(history, blank),
        F.lit("</History></PubmedData></PubmedArticle>")).alias("xml"))


XML_SQL = """
    SELECT pmid, pub_date FROM (SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE doc_id % 5
        WHEN 0 THEN concat(1980 + doc_id % 40, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '-07')
        WHEN 1 THEN concat(1980 + doc_id % 40, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '-01')
        WHEN 2 THEN '1900-01-01'
        WHEN 3 THEN concat(1980 + doc_id % 40, '-Jan-01') ELSE NULL END AS pub_date FROM documents)
    WHERE pub_date IS NOT NULL"""


@query("S4_article_dates_from_xml", XML_SQL)
def xml_dates(t):
    parsed = article_xml(t).select(F.from_xml("xml", readers.ARTICLE_SCHEMA).alias("a")).select("a.*")
    return readers.article_dates(parsed)


@query("S5_incremental_dates", """
    SELECT DISTINCT a.pmid, a.pub_date FROM g_articles a
    WHERE a.pub_date IS NOT NULL AND a.pmid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def incremental(t):
    wanted = t.read("labels").select(F.col("doc_id").cast("string").alias("pmid"))
    cache = t.articles.where("pub_date LIKE '%-%'").select("pmid", "pub_date")
    return L.resolve_dates(wanted, cache, t.articles)[1]


@query("J6_edge_dating", SUPPORT_SQL)
def edge_dating(t):
    return L.date_edges(supported_edges(t), usable_dates(t), EDGE_ID)


@query("J7_date_injection", """
    SELECT src_type, rel, dst_type, src, dst,
           CASE WHEN rel IN ('SUPPLIES', 'LOCATED_IN') THEN MIN(a.pub_date) ELSE MIN(e.pub_date) END AS pub_date
    FROM (SELECT *, unnest([src % nd, (src * 7 + dst * 3) % nd]) AS doc FROM g_edges,
                 (SELECT COUNT(*) AS nd FROM documents)) e
    LEFT JOIN g_articles a ON a.pmid = CAST(e.doc AS VARCHAR) AND a.pub_date <> 'n.d.'
    GROUP BY src_type, rel, dst_type, src, dst""")
def date_injection(t):
    dates = L.date_edges(supported_edges(t), usable_dates(t), EDGE_ID)
    return L.inject_dates(t.edges, dates, EDGE_ID, ["SUPPLIES", "LOCATED_IN"]).select(*EDGE_ID, "pub_date")


@query("P15_literature_era", f"SELECT pmid, {ERA_SQL} AS era FROM g_article_dates")
def era(t):
    return t.articles.select("pmid", L.era(F.col("pub_date"), ERAS).alias("era"))


@query("P16_prospective_filter", f"""
    SELECT pmid, pub_date FROM g_article_dates WHERE {ERA_SQL} = 'prospective'""")
def prospective(t):
    return L.prospective(t.articles.select("pmid", "pub_date"), ERAS)


SOURCES_SQL = """
    SELECT * FROM (SELECT entity, pmid, pub_date, abstract,
        row_number() OVER (PARTITION BY entity ORDER BY pub_date DESC, pmid) AS nth
        FROM g_articles WHERE pub_date <= '2001-12-31') WHERE nth <= 50"""


@query("J14_literature_sources", f"""
    SELECT entity, pmid, pub_date, CAST(substr(pub_date, 1, 4) AS BIGINT) AS year
    FROM ({SOURCES_SQL})""")
def sources(t):
    return L.newest_sources(t.articles, "2001-12-31").select(
        "entity", "pmid", "pub_date", F.substring("pub_date", 1, 4).cast("bigint").alias("year"))


@query("W6_top_sources_per_entity", f"""
    SELECT entity, pmid, nth FROM ({SOURCES_SQL}) WHERE nth <= 10""")
def top_sources(t):
    return L.newest_sources(t.articles, "2001-12-31", 10).select(
        "entity", "pmid", F.col("nth").cast("bigint").alias("nth"))


@query("F1_entity_summary", """
    WITH m AS (SELECT lang AS entity, CAST(doc_id AS VARCHAR) AS pmid, text AS abstract, pub_date
               FROM documents JOIN g_articles ON pmid = CAST(doc_id AS VARCHAR)),
    s AS (SELECT entity, abstract, row_number() OVER (PARTITION BY entity ORDER BY pub_date DESC, pmid) AS nth
          FROM m WHERE pub_date <= '2001-12-31'),
    p AS (SELECT entity, nth, list_transform(list_filter(string_split(abstract, '.'),
                    lambda x: contains(lower(x), entity)),
                    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))[1:3] AS parts FROM s WHERE nth <= 10),
    j AS (SELECT entity, array_to_string(flatten(list(parts ORDER BY nth))[1:15], '. ') AS summary
          FROM p GROUP BY entity)
    SELECT e.entity, COALESCE(NULLIF(j.summary, ''), e.entity) AS summary
    FROM (SELECT DISTINCT lang AS entity FROM documents) e LEFT JOIN j ON j.entity = e.entity""")
def summary(t):
    langs = t.read("documents").select(F.col("doc_id").cast("string").alias("pmid"), F.col("lang").alias("entity"))
    mentions = t.articles.drop("entity").join(langs, "pmid")
    return L.entity_summaries(langs.select("entity").distinct(), L.newest_sources(mentions, "2001-12-31"))


@query("A20_prospective_evidence", """
    WITH h AS (SELECT DISTINCT entity AS target, pmid FROM g_article_dates
               WHERE d BETWEEN DATE '1998-07-01' AND DATE '2001-12-31')
    SELECT target, COUNT(*) AS n_hits, array_to_string(list_sort(list(pmid))[1:5], ',') AS pmids
    FROM h GROUP BY target""")
def evidence(t):
    mentions = t.articles.withColumnRenamed("entity", "target")
    return L.evidence_counts(mentions, "1998-07-01", "2001-12-31").withColumn(
        "pmids", F.concat_ws(",", "pmids"))


@query("A20_prediction_status", f"""
    SELECT p.target, COUNT(*) FILTER (era = 'prospective') AS n_prospective,
           COUNT(*) FILTER (era IN ('train_era', 'val_era')) AS n_earlier,
           CASE WHEN COUNT(*) FILTER (era = 'prospective') > 0 THEN 'prospective'
                WHEN COUNT(*) FILTER (era IN ('train_era', 'val_era')) > 0 THEN 'reproduction'
                ELSE 'unvalidated' END AS status
    FROM (SELECT concat('src', n_nationkey) AS target FROM nation) p
    LEFT JOIN (SELECT entity, {ERA_SQL} AS era FROM g_article_dates) a ON a.entity = p.target
    GROUP BY p.target""")
def status(t):
    predictions = t.read("nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("target"))
    return L.prediction_status(predictions, t.articles.withColumnRenamed("entity", "target"), ERAS)


@query("A21_neglect_ratio", """
    SELECT target, n_total, n_topic, n_reference, round(100.0 * n_topic / n_total, 1) AS topic_pct,
           CASE WHEN n_topic > 0 THEN round(n_reference / n_topic, 1) END AS neglect_ratio
    FROM (SELECT entity AS target, COUNT(*) AS n_total,
                 COUNT(*) FILTER (contains(lower(abstract), 'license')) AS n_topic,
                 COUNT(*) FILTER (contains(lower(abstract), 'the')) AS n_reference
          FROM g_articles GROUP BY entity)""")
def neglect(t):
    return L.neglect_ratio(t.articles.withColumnRenamed("entity", "target"), "license", "the")
