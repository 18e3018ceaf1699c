"""Gene-set enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions.scalar import tidy
from edgeloom.operators import enrichment as E
from edgeloom.queries.registry import query
from edgeloom.sources.readers import clean_statistics

N_SETS = 2000
HITS_SQL = """
    SELECT s.set_name, s.gene, r.pos, abs(r.stat) AS w, r.n_total, COUNT(*) OVER (PARTITION BY s.set_name) AS size
    FROM g_gene_sets s JOIN g_ranked_pos r ON r.gene = s.gene"""


def run_sql(rows, key="set_name"):
    """Running sum at every member of the sets in ``rows``."""
    return f"""SELECT *, (cum - w) / total - (pos - hit) / (n_total - size) AS bef,
        cum / total - (pos - hit) / (n_total - size) AS aft FROM (
          SELECT *, SUM(w) OVER (PARTITION BY {key} ORDER BY pos) AS cum, SUM(w) OVER (PARTITION BY {key}) AS total,
                 row_number() OVER (PARTITION BY {key} ORDER BY pos) AS hit FROM ({rows}))"""


def es_sql(rows, key="set_name"):
    return f"""SELECT {key}, MAX(size) AS size, CASE WHEN abs(MAX(aft)) >= abs(MIN(bef)) THEN MAX(aft)
        ELSE MIN(bef) END AS es FROM ({run_sql(rows, key)}) GROUP BY {key}"""


BOUNDED_SQL = f"SELECT * FROM ({HITS_SQL}) WHERE size BETWEEN 5 AND 500"
ES_SQL = es_sql(BOUNDED_SQL)


def null_sql(sizes):
    """Scores of size-matched random sets: the first places of one random order a replicate."""
    draws = f"""SELECT r, j, CAST(floor(('0x' || substr(md5(concat_ws('|', '123', r, j)), 1, 13))::BIGINT
        / 4503599627370496.0::DOUBLE * (SELECT COUNT(*) FROM g_ranked)) AS BIGINT) + 1 AS pos
        FROM (SELECT r, unnest(range(1, (SELECT MAX(size) FROM ({sizes})) * 2 + 65)) AS j
              FROM (SELECT unnest(range(1, {N_SETS + 1})) AS r))"""
    picked = f"""SELECT r, place, pos FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY j) AS place FROM
        (SELECT r, pos, MIN(j) AS j FROM ({draws}) GROUP BY r, pos)) WHERE place <= (SELECT MAX(size) FROM ({sizes}))"""
    rows = f"""SELECT concat(s.size, '|', p.r) AS key, s.size, p.r, p.pos, abs(g.stat) AS w, g.n_total
        FROM ({picked}) p JOIN ({sizes}) s ON p.place <= s.size JOIN g_ranked_pos g ON g.pos = p.pos"""
    return f"SELECT size, key, round(es, 8) + 0.0 AS es FROM ({es_sql(rows, 'key')})", picked


SIZES_SQL = f"SELECT DISTINCT size FROM ({BOUNDED_SQL})"
NULL_SQL, PICKED_SQL = null_sql(SIZES_SQL)
TIED_SQL = f"SELECT set_name, size, round(es, 8) + 0.0 AS es FROM ({ES_SQL})"


def nes_sql(scores, null):
    return f"""SELECT o.*, o.es / CASE WHEN o.es >= 0 THEN m.up ELSE m.down END AS nes FROM ({scores}) o
        JOIN (SELECT size, AVG(CASE WHEN es >= 0 THEN es END) AS up, AVG(CASE WHEN es < 0 THEN -es END) AS down
              FROM ({null}) GROUP BY size) m ON m.size = o.size"""


def inputs(t):
    positions = E.rank_genes(t.ranked)
    return positions, positions.count(), E.hits(t.gene_sets, positions)


@query("S9_clean_statistics", """
    SELECT gene, stat FROM (SELECT upper(concat('p', l_partkey)) AS gene, l_discount AS stat,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn
        FROM lineitem WHERE l_tax > 0) WHERE rn = 1""")
def statistics(t):
    raw = t.read("lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("g"),
        F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("v"), "l_orderkey", "l_linenumber")
    return clean_statistics(raw, "g", "v", F.struct("l_orderkey", "l_linenumber"))


@query("W7_running_sum", f"""
    SELECT set_name, gene, pos, hit, size, round(bef, 6) + 0.0 AS before, round(aft, 6) + 0.0 AS after
    FROM ({run_sql(BOUNDED_SQL)})""")
def running(t):
    _, n, members = inputs(t)
    return E.running_sum(members, n).withColumn("before", tidy(F.col("before"))).withColumn(
        "after", tidy(F.col("after")))


@query("E1_enrichment_score", f"SELECT set_name, size, round(es, 6) + 0.0 AS es FROM ({ES_SQL})")
def score(t):
    _, n, members = inputs(t)
    return E.enrichment_score(members, n).withColumn("es", tidy(F.col("es")))


@query("N4_random_sets", f"""
    SELECT p.r, p.place, g.gene FROM ({PICKED_SQL}) p JOIN g_ranked_pos g ON g.pos = p.pos""")
def random_sets(t):
    positions, n, members = inputs(t)
    largest = members.agg(F.max("size")).first()[0] or 0
    return E.random_orders(N_SETS, largest, n, t.spark).join(positions, "pos").select("r", "place", "gene")


def scored(t):
    positions, n, members = inputs(t)
    observed = E.enrichment_score(members, n).withColumn("es", E.tied("es"))
    return observed, E.null_scores(members.select("size").distinct(), positions, n, N_SETS)


@query("E2_nes", f"""
    WITH nul AS ({NULL_SQL}), obs AS ({nes_sql(TIED_SQL, 'SELECT * FROM nul')})
    SELECT o.set_name, o.size, round(o.es, 6) + 0.0 AS es, round(o.nes, 6) + 0.0 AS nes,
           round((COUNT(*) FILTER ((n.es >= 0) = (o.es >= 0) AND abs(n.es) >= abs(o.es)) + 1)
                 / (COUNT(*) FILTER ((n.es >= 0) = (o.es >= 0)) + 1), 6) AS pval
    FROM obs o JOIN nul n ON n.size = o.size GROUP BY o.set_name, o.size, o.es, o.nes""")
def nes(t):
    observed, null = scored(t)
    return E.nominal_p(observed, null).select("set_name", "size", tidy(F.col("es")).alias("es"),
                                              tidy(F.col("nes")).alias("nes"), F.round("pval", 6).alias("pval"))


@query("E2_multilevel_p")
def multilevel(t):
    observed, null = scored(t)
    positions = E.rank_genes(t.ranked)
    return E.multilevel_p(observed, null, positions, positions.count())


NULL_NES_SQL = nes_sql("SELECT * FROM nul", "SELECT * FROM nul")


@query("E4_empirical_p", f"""
    WITH nul AS ({NULL_SQL}), obs AS ({nes_sql(TIED_SQL, 'SELECT * FROM nul')}), nn AS ({NULL_NES_SQL})
    SELECT o.set_name, round(o.nes, 6) + 0.0 AS nes, COUNT(*) AS n_random,
           round((COUNT(*) FILTER (abs(n.nes) >= abs(o.nes)) + 1) / (COUNT(*) + 1), 6) AS p_empirical
    FROM obs o JOIN nn n ON n.size = o.size GROUP BY o.set_name, o.nes""")
def empirical(t):
    observed, null = scored(t)
    out = E.empirical_p(E.normalise(observed, null), E.normalise(null, null))
    return out.select("set_name", tidy(F.col("nes")).alias("nes"), "n_random", F.round("p_empirical", 6).alias("p_empirical"))


@query("E5_null_histogram", f"""
    WITH nul AS ({NULL_SQL}), nn AS (SELECT round(nes, 6) AS nes FROM ({NULL_NES_SQL}))
    SELECT CAST(least(40, floor((nes - lo) / (hi - lo) * 40) + 1) AS BIGINT) AS bin, COUNT(*) AS n
    FROM nn, (SELECT MIN(nes) AS lo, MAX(nes) AS hi FROM nn) GROUP BY bin""")
def null_histogram(t):
    _, null = scored(t)
    return E.histogram(E.normalise(null, null).select(F.round("nes", 6).alias("nes")), "nes")


LOO_ROWS_SQL = f"""
    SELECT concat(a.set_name, '|', b.gene) AS key, a.set_name, b.gene AS removed, a.pos, a.w, a.n_total, a.size - 1 AS size
    FROM ({BOUNDED_SQL}) a JOIN ({BOUNDED_SQL}) b ON a.set_name = b.set_name AND a.gene <> b.gene"""
LOO_NULL_SQL, _ = null_sql(f"SELECT DISTINCT size - 1 AS size FROM ({BOUNDED_SQL})")


@query("E3_leave_one_out", f"""
    WITH nul AS ({LOO_NULL_SQL}),
    loo AS ({nes_sql(es_sql(LOO_ROWS_SQL, 'key'), 'SELECT * FROM nul')})
    SELECT split_part(key, '|', 1) AS set_name, COUNT(*) AS n_removed, round(MIN(nes), 6) + 0.0 AS nes_min,
           round(AVG(nes), 6) + 0.0 AS nes_mean, round(MAX(nes), 6) + 0.0 AS nes_max FROM loo GROUP BY 1""")
def leave_one_out(t):
    positions, n, members = inputs(t)
    loo = E.leave_one_out(members, n)
    null = E.null_scores(members.select((F.col("size") - 1).alias("size")).distinct(), positions, n, N_SETS)
    return E.normalise(loo, null).groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n_removed"), tidy(F.min("nes")).alias("nes_min"),
        tidy(F.avg("nes")).alias("nes_mean"), tidy(F.max("nes")).alias("nes_max"))


@query("U5_program_in_universe", """
    SELECT DISTINCT s.set_name, s.gene FROM g_gene_sets s WHERE s.gene IN (SELECT gene FROM g_ranked WHERE stat > 0)""")
def universe(t):
    return E.in_universe(t.gene_sets, t.ranked.where("stat > 0"))


@query("U5_leave_one_out_sets", """
    WITH s AS (SELECT set_name, list_sort(list(gene)) AS genes FROM g_gene_sets GROUP BY set_name),
    r AS (SELECT set_name, unnest(genes) AS removed, genes FROM s)
    SELECT set_name, removed, len(genes) - 1 AS n_left,
           md5(array_to_string(list_filter(genes, lambda g: g <> removed), ',')) AS digest FROM r""")
def loo_sets(t):
    return E.remaining_digests(t.gene_sets)
