"""Pair scoring, top-k, embedding scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions.scalar import tidy, vector_text
from edgeloom.operators import graph as G
from edgeloom.operators import kge as K
from edgeloom.operators import metrics as M
from edgeloom.operators import scoring as S
from edgeloom.plans.global_ranking import rank_targets
from edgeloom.queries.registry import query

EDGE_TYPES = [("Gene", "ASSOCIATED_WITH", "Disease"), ("Gene", "PROMOTES", "Disease"),
              ("Protein", "ASSOCIATED_WITH", "Disease"), ("Protein", "PROMOTES", "Disease"),
              ("Disease", "TREATED_BY", "Gene")]
FORMS = [("entity-1", "ENTITY ONE"), ("form 3", "FORM THREE"), ("entity-2", "ENTITY TWO")]
PAIRS_SQL = """
    SELECT a.node_type AS src_type, a.idx AS src, b.idx AS dst, a.name AS src_name, b.name AS dst_name,
           round(list_dot_product(a.vec, b.vec), 8) AS sc
    FROM g_vectors a JOIN g_vectors b ON a.node_type <> 'Disease' AND b.node_type = 'Disease'"""
OPEN_SQL = f"""
    SELECT p.*, r.rel FROM ({PAIRS_SQL}) p, (VALUES ('ASSOCIATED_WITH'), ('PROMOTES')) r(rel)
    WHERE NOT EXISTS (SELECT 1 FROM g_known k WHERE k.src = p.src AND k.dst = p.dst AND k.rel = r.rel)"""


def ranked_types():
    return S.target_edge_types(EDGE_TYPES, "Disease", ["Gene", "Protein"])


@query("J12_all_pairs_summary", f"""
    SELECT concat(src_type, '__Disease') AS grp, src, COUNT(*) AS n_pairs,
           round(SUM(sc), 4) + 0.0 AS score_sum, MAX(sc) + 0.0 AS score_max
    FROM ({PAIRS_SQL}) GROUP BY src_type, src""")
def all_pairs(t):
    return S.all_pairs_summary(t.vectors, ranked_types()).select(
        "grp", "src", "n_pairs", tidy(F.col("score_sum"), 4).alias("score_sum"),
        (F.col("score_max") + 0.0).alias("score_max"))


@query("J13_edge_scores", """
    SELECT k.src_type, k.rel, k.src, k.dst, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS score,
           round(1 / (1 + exp(-list_dot_product(a.vec, b.vec))), 6) + 0.0 AS prob
    FROM g_known k JOIN g_vectors a ON a.idx = k.src JOIN g_vectors b ON b.idx = k.dst""")
def edge_scores(t):
    return S.score_edges(t.known, t.vectors).select(
        "src_type", "rel", "src", "dst", tidy(F.col("score")).alias("score"), tidy(F.col("prob")).alias("prob"))


@query("J4_mask_known_pairs", """
    SELECT s.node_type AS src_type, CASE j % 2 WHEN 0 THEN 'ASSOCIATED_WITH' ELSE 'PROMOTES' END AS rel,
           'Disease' AS dst_type, s.idx AS src, d.idx AS dst
    FROM g_vectors s, range(1, 9) t(j), g_vectors d
    WHERE s.node_type <> 'Disease' AND d.node_type = 'Disease'
      AND d.idx = 2 * ((s.idx * 37 + j * 101) % (SELECT COUNT(*) // 2 FROM embeddings)) + 1
    EXCEPT SELECT src_type, rel, dst_type, src, dst FROM g_known""")
def mask_known(t):
    half = t.read("embeddings").count() // 2
    proposed = t.vectors.where("node_type <> 'Disease'").select(
        F.col("node_type").alias("src_type"), F.col("idx").alias("src"),
        F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j")).select(
        "src_type", F.when(F.col("j") % 2 == 0, "ASSOCIATED_WITH").otherwise("PROMOTES").alias("rel"),
        F.lit("Disease").alias("dst_type"), "src",
        (2 * ((F.col("src") * 37 + F.col("j") * 101) % half) + 1).alias("dst"))
    existing = t.vectors.where("node_type = 'Disease'").select(F.col("idx").alias("dst"))
    proposed = proposed.join(existing, "dst", "left_semi").distinct()
    return S.mask_known(proposed, t.known).select("src_type", "rel", "dst_type", "src", "dst")


TOP_SQL = f"""
    SELECT * FROM (SELECT src_type, rel, 'Disease' AS dst_type, src, dst, src_name, dst_name, sc,
        row_number() OVER (PARTITION BY src_type, rel ORDER BY sc DESC, src, dst) AS rank
        FROM ({OPEN_SQL})) WHERE rank <= 2000"""


@query("T1_top_pairs_per_edge_type", f"""
    SELECT src_type, rel, dst_type, src, dst, sc AS score, rank FROM ({TOP_SQL})""")
def top_pairs(t):
    return S.top_pairs(t.vectors, ranked_types(), t.known, 2000)


@query("T2_global_top_pairs", f"""
    SELECT src_type, rel, dst_type, src, dst, sc AS score FROM ({TOP_SQL})
    ORDER BY sc DESC, src_type, rel, src, dst LIMIT 2000""")
def global_top(t):
    return S.merge_top(S.top_pairs(t.vectors, ranked_types(), t.known, 2000).drop("rank"), 2000)


@query("T3_target_type_filter", """
    SELECT src_type, 'Disease' AS dst_type, rel,
           (SELECT COUNT(*) FROM g_vectors v WHERE v.node_type = src_type)
           * (SELECT COUNT(*) FROM g_vectors v WHERE v.node_type = 'Disease') AS n_pairs
    FROM (VALUES ('Gene'), ('Protein')) s(src_type), (VALUES ('ASSOCIATED_WITH'), ('PROMOTES')) r(rel)""")
def target_types(t):
    return S.pairs_scored(t.vectors, ranked_types())


RANKED_SQL = f"""
    SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY sc DESC, src_type, rel, src, dst) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY sc DESC, src_type, rel, src, dst) AS rn
      FROM (SELECT *, CASE WHEN contains(lower(trim(src_name)), 'entity-1') THEN 'ENTITY ONE'
                 WHEN contains(lower(trim(src_name)), 'form 3') THEN 'FORM THREE'
                 WHEN contains(lower(trim(src_name)), 'entity-2') THEN 'ENTITY TWO'
                 ELSE src_name END AS canonical
            FROM (SELECT * FROM ({TOP_SQL}) ORDER BY sc DESC, src_type, rel, src, dst LIMIT 2000))) WHERE rn = 1"""


def ranked_targets(t):
    return rank_targets(t.vectors, t.known, EDGE_TYPES, top_k=2000, forms=FORMS)


@query("G10_global_ranking", f"""
    SELECT pos AS rank, canonical AS canonical_name, src_name AS original_name, src_type, dst_name AS disease,
           sc AS score, rel AS relation FROM ({RANKED_SQL})""")
def global_ranking(t):
    return ranked_targets(t).select("rank", "canonical_name", "original_name", "src_type", "disease", "score",
                                    F.col("rel").alias("relation"))


# ------------------------------------------------------------ embedding scorers
def kge_inputs(t, model):
    rows = t.read("embeddings").select(F.col("vec_id").alias("id"),
                                       F.col("embedding").cast("array<double>").alias("vec"))
    relations = rows.where("id < 2")
    if model == "rotate":
        relations = relations.withColumn("vec", F.slice("vec", 1, 32))
    triples = t.known.select(F.col("src").alias("h"),
                             F.when(F.col("rel") == "PROMOTES", 1).otherwise(0).cast("bigint").alias("r"),
                             F.col("dst").alias("t"))
    return triples, rows, relations


def zipped(a, b, op):
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] {op} p[2])"


def mapped(a, expr):
    return f"list_transform({a}, lambda x: {expr})"


def complex_sql(a, b, conj):
    ar, ai, br, bi = f"{a}[1:32]", f"{a}[33:64]", f"{b}[1:32]", f"{b}[33:64]"
    plus, minus = ("+", "-") if not conj else ("-", "+")
    re = zipped(zipped(ar, br, "*"), zipped(ai, bi, "*"), minus)
    im = (zipped(zipped(ai, br, "*"), zipped(ar, bi, "*"), plus))
    return f"list_concat({re}, {im})"


UNIT_SQL = f"list_concat({mapped('rv', 'cos(x)')}, {mapped('rv', 'sin(x)')})"
TAIL_SQL = {"transe": zipped("hv", "rv", "+"), "distmult": zipped("hv", "rv", "*"),
            "complex": complex_sql("hv", "rv", False), "rotate": complex_sql("hv", UNIT_SQL, False)}
HEAD_SQL = {"transe": zipped("tv", "rv", "-"), "distmult": zipped("tv", "rv", "*"),
            "complex": complex_sql("tv", "rv", True), "rotate": complex_sql("tv", UNIT_SQL, True)}


def pair_sql(model, q, v):
    return f"list_dot_product({q}, {v})" if model in ("distmult", "complex") else f"-list_distance({q}, {v})"


def triples_sql(model):
    rv = "r.vec[1:32]" if model == "rotate" else "r.vec"
    return f"""SELECT h, r, t, hv, tv, rv FROM (SELECT k.src AS h, rid AS r, k.dst AS t, a.vec AS hv, b.vec AS tv,
        {rv} AS rv FROM (SELECT *, CASE rel WHEN 'PROMOTES' THEN 1 ELSE 0 END AS rid FROM g_known) k
        JOIN g_vectors a ON a.idx = k.src JOIN g_vectors b ON b.idx = k.dst JOIN g_vectors r ON r.idx = k.rid)"""


def register_scores(key, model):
    sql = f"""SELECT h, CAST(r AS BIGINT) AS r, t,
        round({pair_sql(model, 'q', 'tv')}, 6) + 0.0 AS score
        FROM (SELECT *, {TAIL_SQL[model]} AS q FROM ({triples_sql(model)}))"""

    @query(key, sql)
    def scores(t):
        triples, entities, relations = kge_inputs(t, model)
        return K.score_triples(triples, entities, relations, model).withColumn("score", tidy(F.col("score")))


for key, model in (("K1_transe_scores", "transe"), ("K2_distmult_scores", "distmult"),
                   ("K3_complex_scores", "complex"), ("K4_rotate_scores", "rotate")):
    register_scores(key, model)


def register_candidates(key, model, side):
    known, make = ("h", TAIL_SQL) if side == "tail" else ("t", HEAD_SQL)
    sql = f"""
        WITH q AS (SELECT DISTINCT {known} AS known, CAST(r AS BIGINT) AS r, {make[model]} AS qv
                   FROM ({triples_sql(model)})),
        s AS (SELECT known, r, e.idx AS candidate, round({pair_sql(model, 'qv', 'e.vec')}, 8) + 0.0 AS score
              FROM q, g_vectors e)
        SELECT known, r, candidate, score, rank FROM (SELECT *, row_number() OVER (
            PARTITION BY known, r ORDER BY score DESC, candidate) AS rank FROM s) WHERE rank <= 5"""

    @query(key, sql)
    def candidates(t):
        triples, entities, relations = kge_inputs(t, model)
        questions = triples.select(F.col(known).alias("known"), "r")
        return K.score_candidates(questions, entities, relations, model, side, 5)


register_candidates("K5_all_tails_transe", "transe", "tail")
register_candidates("K5_all_heads_complex", "complex", "head")
register_candidates("K5_all_heads_rotate", "rotate", "head")


def kge_ranks_sql(model):
    def side(known, other, make):
        return f"""SELECT s.h, s.r, s.t, COUNT(e.idx) + 1 AS rank FROM s
            LEFT JOIN g_vectors e ON round({pair_sql(model, make, 'e.vec')}, 8) > s.sc
             AND NOT EXISTS (SELECT 1 FROM s k WHERE k.{known} = s.{known} AND k.r = s.r AND k.{other} = e.idx)
            GROUP BY s.h, s.r, s.t"""
    return f"""s AS (SELECT *, round({pair_sql(model, 'tq', 'tv')}, 8) AS sc FROM (
            SELECT *, {TAIL_SQL[model]} AS tq, {HEAD_SQL[model]} AS hq FROM ({triples_sql(model)}))),
        tails AS ({side('h', 't', 's.tq')}), heads AS ({side('t', 'h', 's.hq')}),
        ranks AS (SELECT CAST(a.r AS VARCHAR) AS relation, a.rank AS tail_rank, b.rank AS head_rank
                  FROM tails a JOIN heads b ON a.h = b.h AND a.r = b.r AND a.t = b.t)"""


REPORT_SQL = """
    SELECT CASE WHEN GROUPING(relation) = 1 THEN 'ALL' ELSE relation END AS relation, COUNT(*) AS n_triples,
           round(AVG(1 / tail_rank), 4) AS tail_mrr, round(AVG(1 / head_rank), 4) AS head_mrr,
           round((AVG(1 / tail_rank) + AVG(1 / head_rank)) / 2, 4) AS mrr,
           round((AVG((tail_rank <= 1)::INT) + AVG((head_rank <= 1)::INT)) / 2, 4) AS hits_1,
           round((AVG((tail_rank <= 3)::INT) + AVG((head_rank <= 3)::INT)) / 2, 4) AS hits_3,
           round((AVG((tail_rank <= 10)::INT) + AVG((head_rank <= 10)::INT)) / 2, 4) AS hits_10
    FROM ranks GROUP BY ROLLUP (relation)"""


def register_evaluation(key, model):
    @query(key, f"WITH {kge_ranks_sql(model)} {REPORT_SQL}")
    def evaluation(t):
        triples, entities, relations = kge_inputs(t, model)
        ranks = K.filtered_ranks(triples, triples, entities, relations, model)
        return M.filtered_report(ranks.withColumn("relation", F.col("r").cast("string")))


register_evaluation("K6_kge_filtered_evaluation", "distmult")
register_evaluation("K6_kge_filtered_rotate", "rotate")


@query("K7_edges_to_triples", """
    WITH e AS (SELECT node_type, idx, row_number() OVER (ORDER BY node_type, idx) - 1 AS gid
               FROM g_nodes WHERE node_type <> 'Region'),
    r AS (SELECT src_type, rel, dst_type, row_number() OVER (
             ORDER BY concat(src_type, '__', rel, '__', dst_type)) - 1 AS rid
          FROM (SELECT DISTINCT src_type, rel, dst_type FROM g_edges))
    SELECT a.gid AS h, r.rid AS r, b.gid AS t FROM g_edges g
    JOIN e a ON a.node_type = g.src_type AND a.idx = g.src
    JOIN e b ON b.node_type = g.dst_type AND b.idx = g.dst
    JOIN r ON r.src_type = g.src_type AND r.rel = g.rel AND r.dst_type = g.dst_type""")
def edges_to_triples(t):
    ids = G.dense_ids(t.nodes.where("node_type <> 'Region'").select("node_type", "idx"), "idx")
    return K.to_triples(t.edges, ids, G.relation_ids(t.edges))


def train_inputs(t):
    triples, rows, _ = kge_inputs(t, "distmult")
    relations = triples.select(F.col("r").alias("id")).distinct()
    return triples, rows.select("id"), relations


@query("K8_training_epochs")
def training(t):
    # The reference's size: 128 dimensions, 100 epochs.
    triples, entity_ids, relation_ids = train_inputs(t)
    _, _, history = K.fit(triples, entity_ids, relation_ids, "distmult")
    return t.spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(history)], "epoch int, loss double")


@query("N3_tail_corruption", """
    SELECT k.src AS h, CASE rel WHEN 'PROMOTES' THEN 1 ELSE 0 END::BIGINT AS r, k.dst AS t, c AS copy,
           CAST(floor(('0x' || substr(md5(concat_ws('|', '42', k.src, CASE rel WHEN 'PROMOTES' THEN 1 ELSE 0 END,
                 k.dst, c)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                 * (SELECT COUNT(*) FROM embeddings)) AS BIGINT) AS neg_t
    FROM g_known k, range(1, 4) c(c)""")
def tail_corruption(t):
    triples, _, _ = kge_inputs(t, "distmult")
    return K.corrupt_tails(triples, t.read("embeddings").count(), 3).withColumn("copy", F.col("copy").cast("bigint"))


def start_sql(seed, key, bound, dim=16):
    """Seeded start vectors, as in the first training epoch."""
    u = (f"('0x' || substr(md5(concat_ws('|', '{seed}', {key}, i)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE")
    return f"list_transform(range(1, {dim + 1}), lambda i: ({u} * 2 - 1) * {bound})"


def each(expr, n=16):
    return f"[{expr} FOR j IN range(1, {n + 1})]"


def gradient_sql(model, rows, tail):
    """Score ``s`` and gradients ``gh``, ``gr``, ``gt`` of rows with vectors ``h``, ``r`` and the tail."""
    t = tail
    if model == "distmult":
        return f"""SELECT *, list_sum({each(f'h[j] * r[j] * {t}[j]')}) AS s, {each(f'r[j] * {t}[j]')} AS gh, {each(f'h[j] * {t}[j]')} AS gr,
            {each('h[j] * r[j]')} AS gt FROM ({rows})"""
    if model == "complex":
        parts = f"""list_sum({each(f'h[j] * r[j] * {t}[j] + h[j] * r[j + 8] * {t}[j + 8] + h[j + 8] * r[j] * {t}[j + 8] - h[j + 8] * r[j + 8] * {t}[j]', 8)}) AS s,
            {each(f'r[j] * {t}[j] + r[j + 8] * {t}[j + 8]', 8)} || {each(f'r[j] * {t}[j + 8] - r[j + 8] * {t}[j]', 8)} AS gh,
            {each(f'h[j] * {t}[j] + h[j + 8] * {t}[j + 8]', 8)} || {each(f'h[j] * {t}[j + 8] - h[j + 8] * {t}[j]', 8)} AS gr,
            {each('h[j] * r[j] - h[j + 8] * r[j + 8]', 8)} || {each('h[j] * r[j + 8] + h[j + 8] * r[j]', 8)} AS gt"""
        return f"SELECT *, {parts} FROM ({rows})"
    if model == "transe":
        gap = f"SELECT *, {each(f'h[j] + r[j] - {t}[j]')} AS gap FROM ({rows})"
        unit = f"SELECT *, {each('gap[j] / dist')} AS u FROM (SELECT *, sqrt(list_sum({each('gap[j] * gap[j]')})) + 1e-12 AS dist FROM ({gap}))"
        return f"SELECT * EXCLUDE (gap, dist, u), -dist AS s, {each('-u[j]')} AS gh, {each('-u[j]')} AS gr, u AS gt FROM ({unit})"
    turned = f"""SELECT *, {each('h[j] * cos(r[j]) - h[j + 8] * sin(r[j])', 8)} AS re, {each('h[j] * sin(r[j]) + h[j + 8] * cos(r[j])', 8)} AS im FROM ({rows})"""
    gap = f"SELECT *, {each(f're[j] - {t}[j]', 8)} || {each(f'im[j] - {t}[j + 8]', 8)} AS gap FROM ({turned})"
    unit = f"SELECT *, {each('gap[j] / dist')} AS u FROM (SELECT *, sqrt(list_sum({each('gap[j] * gap[j]')})) + 1e-12 AS dist FROM ({gap}))"
    return f"""SELECT * EXCLUDE (gap, dist, u, re, im), -dist AS s,
        {each('-(u[j] * cos(r[j]) + u[j + 8] * sin(r[j]))', 8)} || {each('-(-u[j] * sin(r[j]) + u[j + 8] * cos(r[j]))', 8)} AS gh,
        {each('-(-u[j] * im[j] + u[j + 8] * re[j])', 8)} AS gr, u AS gt FROM ({unit})"""


def first_epoch_sql(model):
    """All vectors after one epoch: start, gradients of every triple summed by id, one Adam step."""
    rel_dim, rel_bound = (8, "3.14159::DOUBLE") if model == "rotate" else (16, "sqrt(6.0::DOUBLE / 18)")
    start = f"SELECT vec_id AS id, {start_sql(42, 'vec_id', 'sqrt(6.0::DOUBLE / (ne + 16))')} AS v FROM embeddings, n"
    if model == "transe":
        start = f"SELECT id, list_transform(v, lambda x: x * (1.0::DOUBLE / greatest(w, 1e-12))) AS v FROM (SELECT *, sqrt(list_sum({each('v[j] * v[j]')})) AS w FROM ({start}))"
    margin = {"transe": 1.0, "rotate": 6.0}.get(model)
    if margin:
        weights = f"CASE WHEN sn - sp + {margin}::DOUBLE > 0 THEN -1.0::DOUBLE / nt ELSE 0 END AS wp, CASE WHEN sn - sp + {margin}::DOUBLE > 0 THEN 1.0::DOUBLE / nt ELSE 0 END AS wn"
    else:
        weights = "-1.0::DOUBLE / (1.0 + exp(sp)) / (2 * nt) AS wp, 1.0::DOUBLE / (1.0 + exp(-sn)) / (2 * nt) AS wn"
    seen = f"SELECT * RENAME (s AS sp, gh AS ph, gr AS pr, gt AS pt) FROM ({gradient_sql(model, 'SELECT * FROM p', 't')})"
    both = f"SELECT *, s AS sn FROM ({gradient_sql(model, seen, 'x')})"
    return f"""
    WITH n AS (SELECT COUNT(*) AS ne FROM embeddings),
    e AS MATERIALIZED ({start}),
    r AS MATERIALIZED (SELECT id, {start_sql(43, 'id', rel_bound, rel_dim)} AS v FROM (VALUES (0), (1)) x(id)),
    k AS (SELECT src AS h, CASE rel WHEN 'PROMOTES' THEN 1 ELSE 0 END AS r, dst AS t FROM g_known),
    c AS (SELECT *, CAST(floor(('0x' || substr(md5(concat_ws('|', '43', h, r, t, 1)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * ne) AS BIGINT) AS x FROM k, n),
    p AS MATERIALIZED (SELECT c.h AS hid, c.r AS rid, c.t AS tid, c.x AS xid, a.v AS h, r.v AS r, b.v AS t, d.v AS x, (SELECT COUNT(*) FROM k) AS nt
          FROM c JOIN e a ON a.id = c.h JOIN r ON r.id = c.r JOIN e b ON b.id = c.t JOIN e d ON d.id = c.x),
    w AS MATERIALIZED (SELECT *, {weights} FROM ({both})),
    g AS (SELECT 'e' AS kind, hid AS id, {each('wp * ph[j] + wn * gh[j]')} AS g FROM w
          UNION ALL SELECT 'r', rid, {each('wp * pr[j] + wn * gr[j]', rel_dim)} FROM w
          UNION ALL SELECT 'e', tid, {each('wp * pt[j]')} FROM w UNION ALL SELECT 'e', xid, {each('wn * gt[j]')} FROM w),
    s AS (SELECT kind, id, i, SUM(x) AS x FROM (SELECT kind, id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM g) GROUP BY ALL),
    v AS (SELECT 'e' AS kind, id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e UNION ALL SELECT 'r', id, unnest(v), generate_subscripts(v, 1) FROM r)
    SELECT kind, id, string_agg(CAST(CAST(round((v.x - 0.01::DOUBLE * COALESCE(s.x, 0) / (abs(COALESCE(s.x, 0)) + 1e-8)) * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS vec
    FROM v LEFT JOIN s USING (kind, id, i) GROUP BY kind, id"""


def register_first_epoch(model):
    @query(f"K8_first_epoch_{model}", first_epoch_sql(model))
    def first_vectors(t):
        triples, entity_ids, relation_ids = train_inputs(t)
        entities, relations, _ = K.fit(triples, entity_ids, relation_ids, model, dim=16, epochs=1, lr=0.01)
        both = entities.select(F.lit("e").alias("kind"), "id", "vec").unionByName(relations.select(F.lit("r").alias("kind"), "id", "vec"))
        return both.withColumn("vec", vector_text(F.col("vec")))


for model in K.SCORERS:
    register_first_epoch(model)


@query("K8_first_epoch_loss", f"""
    WITH n AS (SELECT COUNT(*) AS ne FROM embeddings),
    e AS (SELECT vec_id, {start_sql(42, 'vec_id', 'sqrt(6.0::DOUBLE / (ne + 16))')} AS v FROM embeddings, n),
    r AS (SELECT rid, {start_sql(43, 'rid', 'sqrt(6.0::DOUBLE / 18)')} AS v FROM (VALUES (0), (1)) x(rid)),
    k AS (SELECT src AS h, CASE rel WHEN 'PROMOTES' THEN 1 ELSE 0 END AS r, dst AS t FROM g_known),
    p AS (SELECT k.*, CAST(floor(('0x' || substr(md5(concat_ws('|', '43', h, r, t, 1)), 1, 13))::BIGINT
              / 4503599627370496.0::DOUBLE * ne) AS BIGINT) AS x FROM k, n),
    s AS (SELECT list_dot_product({zipped('a.v', 'r.v', '*')}, b.v) AS sp,
                 list_dot_product({zipped('a.v', 'r.v', '*')}, c.v) AS sn
          FROM p JOIN e a ON a.vec_id = p.h JOIN r ON r.rid = p.r JOIN e b ON b.vec_id = p.t JOIN e c ON c.vec_id = p.x)
    SELECT round(AVG((ln(1 + exp(-sp)) + ln(1 + exp(sn))) / 2), 8) AS loss FROM s""")
def first_epoch(t):
    triples, entity_ids, relation_ids = train_inputs(t)
    _, _, history = K.fit(triples, entity_ids, relation_ids, "distmult", dim=16, epochs=1, lr=0.01)
    return t.spark.createDataFrame([(round(history[0], 8),)], "loss double")
