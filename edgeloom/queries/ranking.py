"""Name annotation and ranking reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions.scalar import tidy
from edgeloom.operators import ranking as R
from edgeloom.operators import scoring as S
from edgeloom.plans.global_ranking import attach_names
from edgeloom.queries.metrics import SEEDS_SQL, seed_metrics
from edgeloom.queries.registry import query
from edgeloom.queries.scoring import FORMS, RANKED_SQL, TOP_SQL, ranked_targets, ranked_types

PATTERNS = [("Odd", "entity-[13579]"), ("Low", "entity-[0-4]"), ("Seven", "FORM [0-6]$|form three"),
            ("One", "entity one")]
ANCHOR_FORMS = [("red", "RED"), ("widget", "WIDGET"), ("hot", "HOT")]


def any_sql(col, terms):
    return "(" + " OR ".join(f"contains(lower({col}), '{t}')" for t in terms) + ")"


@query("P6_keyword_flags", f"""
    SELECT doc_id, {any_sql('text', C.TEXTBOOK_TERMS)} AS is_textbook,
           {any_sql('text', C.MECHANISM_TERMS)} AS is_mechanism FROM documents""")
def keyword_flags(t):
    return t.read("documents").select("doc_id", R.is_textbook(F.col("text")).alias("is_textbook"),
                                      R.is_mechanism(F.col("text")).alias("is_mechanism"))


@query("P7_pathway_tags", f"""
    SELECT doc_id, concat_ws('|', {', '.join(f"CASE WHEN {any_sql('text', words)} THEN '{tag}' END"
                                            for tag, words in C.PATHWAY_TERMS.items())}) AS pathways
    FROM documents""")
def pathway_tags(t):
    return t.read("documents").select("doc_id", F.concat_ws("|", R.pathway_tags(F.col("text"))).alias("pathways"))


@query("P8_entity_canonicalisation", """
    SELECT node_type, idx, CASE WHEN contains(lower(trim(name)), 'entity-1') THEN 'ENTITY ONE'
           WHEN contains(lower(trim(name)), 'form 3') THEN 'FORM THREE'
           WHEN contains(lower(trim(name)), 'entity-2') THEN 'ENTITY TWO' ELSE name END AS canonical_name
    FROM g_vectors""")
def canonical(t):
    return t.vectors.select("node_type", "idx", R.canonical_name(F.col("name"), FORMS).alias("canonical_name"))


@query("P9_anchor_naming", """
    SELECT node_type, idx, CASE WHEN contains(lower(name), 'red') THEN 'RED' WHEN contains(lower(name), 'widget')
           THEN 'WIDGET' WHEN contains(lower(name), 'hot') THEN 'HOT' ELSE substr(name, 1, 30) END AS anchor
    FROM (SELECT node_type, idx, concat(name, ' of type ', node_type, ' in the catalogue') AS name FROM g_nodes)""")
def anchor_naming(t):
    name = F.concat(F.col("name"), F.lit(" of type "), F.col("node_type"), F.lit(" in the catalogue"))
    return t.nodes.select("node_type", "idx", R.anchor_name(name, ANCHOR_FORMS).alias("anchor"))


@query("P10_regex_normalisation", """
    SELECT p_partkey, COALESCE(NULLIF(regexp_replace(c, 'nf-.*b', 'nf-kb', 'gi'), ''), p_name) AS target
    FROM (SELECT p_partkey, p_name, CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN NULL
                 ELSE concat('NF-', p_name, 'B ', p_brand) END AS c FROM part)""")
def normalisation(t):
    raw = F.when(F.col("p_partkey") % 10 == 0, "").when(
        F.col("p_partkey") % 10 != 1, F.concat(F.lit("NF-"), F.col("p_name"), F.lit("B "), F.col("p_brand")))
    return t.read("part").select("p_partkey", R.display_target(raw, F.col("p_name")).alias("target"))


@query("P11_regex_category", f"""
    SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p}', 'i') THEN '{c}'"
                                 for c, p in reversed(C.CATEGORY_PATTERNS))} ELSE 'Other' END AS category,
           CASE WHEN regexp_matches(text, '{C.FIBROSIS_AXIS_PATTERN}', 'i') THEN '{C.PATHWAY_AXES[1]}'
                ELSE '{C.PATHWAY_AXES[0]}' END AS axis FROM documents""")
def category(t):
    return t.read("documents").select("doc_id", R.category(F.col("text")).alias("category"),
                                      R.pathway_axis(F.col("text")).alias("axis"))


@query("W4_best_row_per_entity", f"""
    SELECT canonical AS canonical_name, src_type, rel, src, dst, sc AS score FROM ({RANKED_SQL})""")
def best_row(t):
    return ranked_targets(t).select("canonical_name", "src_type", "rel", "src", "dst", "score")


@query("W5_final_rank", f"SELECT pos AS rank, canonical AS canonical_name FROM ({RANKED_SQL})")
def final_rank(t):
    return ranked_targets(t).select("rank", "canonical_name")


RAW_TERMS = ["entity-1", "form 3"]


@query("W5_raw_rank", f"""
    SELECT * FROM (SELECT src_type, rel, src, dst, src_name AS original_name, sc AS score,
                          row_number() OVER (ORDER BY sc DESC, src_type, rel, src, dst) AS raw_rank
                   FROM (SELECT * FROM ({TOP_SQL}) ORDER BY sc DESC, src_type, rel, src, dst LIMIT 2000))
    WHERE contains(lower(original_name), 'entity-1') OR contains(lower(original_name), 'form 3')""")
def raw_rank(t):
    top = S.merge_top(S.top_pairs(t.vectors, ranked_types(), t.known, 2000).drop("rank"), 2000)
    return R.raw_ranks(attach_names(top, t.vectors), RAW_TERMS).select("src_type", "rel", "src", "dst", "original_name", "score", "raw_rank")


@query("T4_head_table", f"""
    SELECT pos AS rank, substr(canonical, 1, 35) AS target, src_type AS type, round(sc, 2) AS score,
           substr(dst_name, 1, 20) AS disease FROM ({RANKED_SQL}) WHERE pos <= 10""")
def head_table(t):
    return R.head_table(ranked_targets(t))


CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(canonical, '{p}', 'i') THEN '{c}'" for c, p in reversed(PATTERNS)) + " ELSE 'Other' END"


@query("A15_category_share", f"""
    SELECT category, COUNT(*) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER () * 100, 1) AS pct
    FROM (SELECT {CATEGORY_SQL} AS category FROM ({RANKED_SQL}) WHERE pos <= 100) GROUP BY category""")
def share(t):
    return R.category_share(ranked_targets(t), 100, patterns=PATTERNS)


@query("A16_box_statistics", f"""
    SELECT metric, round(AVG(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(MAX(v), 6) AS max,
           round(MIN(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS median
    FROM (SELECT 'auroc' AS metric, auroc AS v FROM ({SEEDS_SQL})
          UNION ALL SELECT 'mrr', mrr FROM ({SEEDS_SQL})) GROUP BY metric""")
def box(t):
    out = R.box_stats(seed_metrics(t), ["seed"], ["auroc", "mrr"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "max", "min", "median")])


@query("A17_model_comparison", f"""
    WITH m AS (SELECT concat('model-', seed) AS model, CASE WHEN seed % 2 = 0 THEN mrr END AS filtered,
                      mrr * 0.9::DOUBLE AS pooled FROM ({SEEDS_SQL})),
    n AS (SELECT model, COALESCE(filtered, pooled) AS metric FROM m)
    SELECT model, round(metric, 6) AS metric, CASE WHEN model = 'model-0' THEN round(metric /
           (SELECT MAX(metric) FROM n WHERE model <> 'model-0'), 6) END AS fold FROM n""")
def comparison(t):
    models = seed_metrics(t).select(
        F.concat(F.lit("model-"), F.col("seed").cast("string")).alias("model"),
        F.when(F.col("seed") % 2 == 0, F.col("mrr")).alias("filtered"), (F.col("mrr") * 0.9).alias("pooled"))
    out = R.compare_models(models, ["filtered", "pooled"], "model-0")
    return out.select("model", F.round("metric", 6).alias("metric"), F.round("fold", 6).alias("fold"))


@query("A18_best_epoch", """
    SELECT model, arg_max(epoch, v) AS best_epoch, round(MAX(v), 6) AS best_value
    FROM (SELECT seed AS model, item % 7 AS epoch, AVG(score) AS v FROM g_scores GROUP BY 1, 2) GROUP BY model""")
def best_epoch(t):
    history = t.scores.groupBy(F.col("seed").alias("model"), (F.col("item") % 7).alias("epoch")).agg(
        F.avg("score").alias("v"))
    return R.best_epoch(history, "v").withColumn("best_value", F.round("best_value", 6))


@query("A18_suppression", """
    WITH s AS (SELECT seed AS model, AVG(score) AS mean_score, MAX(score) AS max_score FROM g_scores
               WHERE is_pos = 0 GROUP BY seed)
    SELECT model, round(mean_score, 6) AS mean_score, max_score, round(1 - mean_score /
           (SELECT mean_score FROM s WHERE model = 0), 6) + 0.0 AS suppression,
           row_number() OVER (ORDER BY mean_score, model) = 1 AS is_best FROM s""")
def suppression(t):
    scores = t.scores.where("is_pos = 0").select(F.col("seed").alias("model"), "score")
    return R.suppression(scores, "0").select("model", F.round("mean_score", 6).alias("mean_score"), "max_score",
                                             tidy(F.col("suppression")).alias("suppression"), "is_best")


OVERLAP_SQL = """
    SELECT gene, bool_or(a) AS in_predicted, bool_or(b) AS in_reference FROM (
      SELECT DISTINCT concat('P', l_partkey) AS gene, true AS a, false AS b FROM lineitem WHERE l_discount >= 0.09
      UNION ALL SELECT DISTINCT concat('P', p_partkey), false, true FROM part WHERE p_size > 25) GROUP BY gene"""


def overlap_members(t):
    predicted = t.read("lineitem").where("l_discount >= 0.09").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene"))
    reference = t.read("part").where("p_size > 25").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"))
    return R.overlap(predicted, reference)


@query("U4_target_overlap", OVERLAP_SQL)
def overlap(t):
    return overlap_members(t)


@query("U4_overlap_counts", f"""
    SELECT COUNT(*) FILTER (in_predicted AND NOT in_reference) AS predicted_only,
           COUNT(*) FILTER (in_reference AND NOT in_predicted) AS reference_only,
           COUNT(*) FILTER (in_predicted AND in_reference) AS intersection,
           round(COUNT(*) FILTER (in_predicted AND in_reference) / COUNT(*), 6) AS jaccard FROM ({OVERLAP_SQL})""")
def overlap_counts(t):
    return R.overlap_counts(overlap_members(t)).withColumn("jaccard", F.round("jaccard", 6))


RULES = [(40000.0, "tier1"), (20000.0, "tier2")]
TIER_SQL = """
    SELECT gene, score, CASE WHEN score >= 40000 THEN 'tier1' WHEN score >= 20000 THEN 'tier2' ELSE 'other' END
           AS tier, gene IN (SELECT concat('P', p_partkey) FROM part WHERE p_size > 40) AS is_mr_target
    FROM (SELECT concat('P', l_partkey) AS gene, MAX(l_extendedprice) AS score FROM lineitem GROUP BY l_partkey)"""


def tiered(t):
    predictions = t.read("lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("score")).select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene"), "score")
    targets = t.read("part").where("p_size > 40").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"))
    return R.tier_predictions(predictions, RULES, targets, "other")


@query("G11_prediction_tiers", TIER_SQL)
def tiers(t):
    return tiered(t)


@query("G11_tier_counts", f"""
    SELECT tier, COUNT(*) AS n, COUNT(*) FILTER (is_mr_target) AS n_mr FROM ({TIER_SQL}) GROUP BY tier""")
def tier_counts(t):
    return R.tier_counts(tiered(t))
