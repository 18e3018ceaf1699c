"""Ranking, evidence, expression, enrichment and features."""

import itertools
import math
import timeit
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import attention as A
from edgeloom.operators import enrichment as E
from edgeloom.operators import evidence as V
from edgeloom.operators import expression as X
from edgeloom.operators import features as FE
from edgeloom.operators import lowrank as LR
from edgeloom.operators import ranking as R
from edgeloom.operators import skipgram as SG
from edgeloom.plans.global_ranking import rank_targets
from edgeloom.session import cut_lineage


def test_overlap(spark):
    a = spark.createDataFrame([(g,) for g in ("F11", "KNG1", "NEW", "F2")], "gene string")
    b = spark.createDataFrame([(g,) for g in ("F11", "KNG1", "LRP4")], "gene string")
    row = R.overlap_counts(R.overlap(a, b)).first()
    assert (row.reference_only, row.predicted_only, row.intersection, row.jaccard) == (1, 2, 2, 0.4)


def test_name_rules(spark):
    row = spark.createDataFrame([("  PAR-2 receptor", "TGF-beta and IL-6 in NF-kappaB", "x" * 40)], "a string, b string, c string").select(
        R.canonical_name(F.col("a")).alias("a"), R.pathway_tags(F.col("b")).alias("tags"), R.category(F.col("b")).alias("cat"),
        R.pathway_axis(F.col("b")).alias("axis"), R.anchor_name(F.col("c")).alias("anchor"),
        R.display_target(F.lit("the NF-kappaB axis"), F.lit("o")).alias("shown"), R.is_textbook(F.col("a")).alias("tb")).first()
    assert row.a == "F2RL1 (PAR-2)" and row.tags == ["Inflammation", "Fibrosis"] and row.cat == "Fibrosis/TGFB"
    assert row.axis == "TLR4/Inflammation" and row.anchor == "x" * 30 and row.shown == "the nf-kb axis" and not row.tb


def test_contradiction_and_subgraph(spark):
    paths = spark.createDataFrame([(1, "FUT8", "Padi4"), (1, "Padi4", "Hmgb1"), (1, "Hmgb1", "Lgals3"), (2, "FUT8", "F2")],
                                  "path_id long, src_name string, dst_name string")
    got = {r.path_id: (r.contradiction_score, r.contaminated) for r in V.contradiction_gate(paths, ["Padi4", "Hmgb1"]).collect()}
    assert got == {1: (2, True), 2: (0, False)}
    edges = spark.createDataFrame([("G", "R", "G", i, i + 1, m) for i, m in enumerate([0.8, 0.2, 0.9, 0.05])],
                                  "src_type string, rel string, dst_type string, src long, dst long, mask double")
    kept, nodes = V.extract_subgraph(edges, "mask", 0.3)
    assert kept.count() == 2 and nodes.count() == 4


def test_alignment(spark):
    rows = [("a", n) for n in ("FUT8", "Lgals3", "CD44")] + [("b", n) for n in ("XYZ1", "ABC2")]
    out = {r.target: r.alignment for r in V.anchor_alignment(
        spark.createDataFrame(rows, "target string, name string"), ["FUT8", "Lgals3", "CD44", "ITGB1"], ["TNF", "TLR4", "NFKB1"]).collect()}
    assert out["a"] > 0.4 and out["b"] == 0.0


def test_discovery_score_and_novelty(spark):
    rows = spark.createDataFrame([(134.73, 40, 0), (59.57, 9, 0), (136.98, 86, 6), (106.63, 43, 4)], "s double, d int, c int")
    category, confidence = V.novelty(F.col("d"), F.col("c"))
    got = rows.select(V.discovery_score(F.col("s"), F.col("d")).alias("x"), category.alias("k"), confidence.alias("f")).collect()
    assert abs(got[0].x - 36.281) < 2e-3 and abs(got[1].x - 25.869) < 4e-3
    assert [(r.k, r.f) for r in got] == [("novel_mechanism", 0.7), ("novel_mechanism", 0.7), ("underexplored", 0.6), ("underexplored", 0.65)]


def test_paths_count_all_shortest_ones(spark):
    edges = spark.createDataFrame([("N", "R", "N", 0, 1, 0.5), ("N", "R", "N", 0, 2, 0.9), ("N", "R", "N", 1, 3, 1.0), ("N", "R", "N", 2, 3, 1.0)],
                                  "src_type string, rel string, dst_type string, src long, dst long, w double")
    anchors = spark.createDataFrame([("top", "N", 3)], "anchor string, node_type string, idx long")
    row = V.path_cascade(edges, anchors, "w", 4).where("idx = 0").first()
    assert (row.hops, row.n_paths, row.path) == (2, 2, "N:0-R->N:2-R->N:3") and abs(row.strength - 0.9) < 1e-12
    assert {r.idx: r.hops for r in V.anchor_hops(edges, anchors, 4).collect()} == {3: 0, 1: 1, 2: 1, 0: 2}


def test_tied_paths_take_the_later_text_and_counts_carry_none(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kinds, rels = ["A", "AB", "B"], ["R", "RS", "Q"]
    rows = {(kinds[rng.integers(3)], rels[rng.integers(3)], kinds[rng.integers(3)], int(rng.integers(12)), int(rng.integers(12)), float(rng.integers(1, 3)) / 2) for _ in range(60)}
    edges = spark.createDataFrame(sorted(rows), "src_type string, rel string, dst_type string, src long, dst long, w double")
    starts = [("x", "A", 1), ("x", "A", 10), ("x", "AB", 1), ("y", "B", 2)]
    anchors = spark.createDataFrame(starts, "anchor string, node_type string, idx long")
    steps = [x for a, r, b, i, j, w in rows for x in (((a, i), (b, j), r, w), ((b, j), (a, i), "INVERSE_" + r, w))]
    level = {(a, k, i): (0, 1, 1.0, f"{k}:{i}") for a, k, i in starts}
    known = dict(level)
    for hop in range(1, 5):
        met = {}
        for node, nbr, label, w in steps:
            for anchor in ("x", "y"):
                if (anchor, *nbr) in level and (anchor, *node) not in known:
                    _, n, strength, path = level[anchor, *nbr]
                    met.setdefault((anchor, *node), []).append((n, strength * w, f"{node[0]}:{node[1]}-{label}->{path}"))
        level = {k: (hop, sum(n for n, _, _ in found), *max((s, p) for _, s, p in found)) for k, found in met.items()}
        known |= level
    got = {(r.anchor, r.node_type, r.idx): (r.hops, r.n_paths, r.strength, r.path) for r in V.path_cascade(edges, anchors, "w", 4).collect()}
    assert got == known and max(v[0] for v in known.values()) >= 3
    joined = []
    real = V.spread_join
    monkeypatch.setattr(V, "spread_join", lambda big, lookup, *more: joined.append(lookup.columns) or real(big, lookup, *more))
    short = V.path_cascade(edges, anchors, "w", 4, texts=False)
    assert {(r.anchor, r.node_type, r.idx): (r.hops, r.n_paths) for r in short.collect()} == {k: v[:2] for k, v in known.items()}
    assert joined and not any("path" in columns for columns in joined)


def test_expression(spark):
    expr = spark.createDataFrame([(1, "T", "Case", "g", 0.0), (2, "T", "Case", "g", 4.0), (3, "B", "Control", "g", 0.0)],
                                 "cell_id long, cell_type string, condition string, gene string, value double")
    dense = {r.cell_type: r for r in X.expression_profile(expr).collect()}
    assert (dense["T"].mean_expr, dense["T"].mean_expr_pos, dense["T"].pct_positive) == (2.0, 4.0, 50.0)
    assert dense["B"].mean_expr_pos == 0.0
    sparse = X.expression_profile(expr.where("value > 0"), expr).first()
    assert (sparse.n_cells, sparse.mean_expr, sparse.pct_positive) == (2, 2.0, 50.0)
    props = {(r.cell_type, r.condition): r.n_cells for r in X.cell_proportions(expr, ["Case", "Control"]).collect()}
    assert props[("B", "Case")] == 0 and props[("T", "Case")] == 2


def brute_es(stats, members):
    order = sorted(range(len(stats)), key=lambda i: -stats[i])
    total = sum(abs(stats[i]) for i in members)
    run, best = 0.0, 0.0
    for i in order:
        run += abs(stats[i]) / total if i in members else -1 / (len(stats) - len(members))
        if abs(run) > abs(best) + 1e-12:
            best = run
    return best


def test_enrichment_against_full_running_sum(spark):
    rng = np.random.default_rng(5)
    stats = rng.normal(size=120).round(6).tolist()
    ranked = spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(stats)], "gene string, stat double")
    sets = {f"s{k}": set(rng.choice(120, size=10 + k, replace=False).tolist()) for k in range(4)}
    rows = spark.createDataFrame([(k, f"g{i}") for k, m in sets.items() for i in m], "set_name string, gene string")
    positions = E.rank_genes(ranked)
    members = E.hits(rows, positions)
    got = {r.set_name: r.es for r in E.enrichment_score(members, 120).collect()}
    for k, m in sets.items():
        assert abs(got[k] - brute_es(stats, m)) < 1e-9
    loo = {(r.set_name, r.removed): r.es for r in E.leave_one_out(members, 120).collect()}
    for i in sorted(sets["s0"]):
        assert abs(loo[("s0", f"g{i}")] - brute_es(stats, sets["s0"] - {i})) < 1e-9
    orders = E.random_orders(3, 60, 100, spark).collect()
    assert all(len({o.pos for o in orders if o.r == r}) == 60 and sorted(o.place for o in orders if o.r == r) == list(range(1, 61)) for r in (1, 2, 3))
    assert all(1 <= o.pos <= 100 for o in orders)
    null = E.null_scores(spark.createDataFrame([(60,), (5,)], "size long"), E.rank_genes(spark.createDataFrame(
        [(f"g{i}", s) for i, s in enumerate(stats[:100])], "gene string, stat double")), 100, 3).collect()
    assert len(null) == 6
    down = sorted(range(100), key=lambda i: (-stats[i], f"g{i}"))
    for row in null:
        members = {down[o.pos - 1] for o in orders if o.r == row.r and o.place <= row["size"]}
        assert abs(row.es - brute_es(stats[:100], members)) < 1e-7
    none = E.null_scores(spark.createDataFrame([], "size long"), positions, 120, 3)
    assert none.count() == 0 and none.columns == ["size", "r", "es"]


@pytest.mark.parametrize("genes, size", [(14, 4), (40, 3)])
def test_multilevel_p_against_all_sets(spark, genes, size):
    """Exact shares of all sets of a small universe, far below one in the number of random sets."""
    rng = np.random.default_rng(11)
    stats = np.sort(rng.normal(size=genes))[::-1].round(6).tolist()
    every = {c: brute_es(stats, set(c)) for c in itertools.combinations(range(genes), size)}
    order = sorted(every, key=every.get)
    chosen = [order[-1], order[-len(order) // 200], order[0], order[len(order) // 300], order[len(order) // 2]]
    rows = [(f"s{k}", f"g{i:03d}") for k, c in enumerate(chosen) for i in c]
    positions = E.rank_genes(spark.createDataFrame([(f"g{i:03d}", s) for i, s in enumerate(stats)], "gene string, stat double"))
    members = E.hits(spark.createDataFrame(rows, "set_name string, gene string"), positions, min_size=1)
    observed = E.enrichment_score(members, genes).withColumn("es", E.tied("es"))
    null = E.null_scores(members.select("size").distinct(), positions, genes, 200)
    got = {r.set_name: r for r in E.multilevel_p(observed, null, positions, genes, fewest=8, population=401).collect()}
    for k, c in enumerate(chosen):
        es = every[c]
        same = [x for x in every.values() if (x >= 0) == (es >= 0)]
        exact = sum(abs(x) >= abs(es) - 1e-9 for x in same) / len(same)
        if exact < 8 / 200:
            assert got[f"s{k}"].levels > 0
        assert abs(np.log2(got[f"s{k}"].pval / exact)) < 1.2, (k, got[f"s{k}"], exact)
    again = {r.set_name: r for r in E.multilevel_p(observed, null, positions, genes, fewest=8, population=401).collect()}
    assert again == got


def test_hops_from_many_anchors(spark):
    """More anchors than a bit word holds, against a plain search."""
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 300, (380, 2)).tolist() if p[0] != p[1]}
    edges = spark.createDataFrame([("N", "R", "N", a, b) for a, b in pairs], "src_type string, rel string, dst_type string, src long, dst long")
    starts = [(f"a{i % 150}", "N", int(x)) for i, x in enumerate(rng.integers(0, 300, 200))]
    got = {(r.anchor, r.idx): r.hops for r in V.anchor_hops(edges, spark.createDataFrame(starts, "anchor string, node_type string, idx long"), 4).collect()}
    near = {i: set() for i in range(300)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for anchor in {s[0] for s in starts}:
        level = {x for a, _, x in starts if a == anchor}
        seen = set(level)
        for hops in range(5):
            want |= {(anchor, x): hops for x in level}
            level = {y for x in level for y in near[x]} - seen
            seen |= level
    assert got == want


def attention_toy(spark):
    vec = lambda seed: np.random.default_rng(seed).normal(size=8).tolist()
    nodes = spark.createDataFrame([("Gene", i, vec(i)) for i in range(4)] + [("Disease", i, vec(10 + i)) for i in range(3)],
                                  "node_type string, idx long, vec array<double>")
    edges = spark.createDataFrame([("Gene", "A", "Disease", 0, 0, 1.0), ("Gene", "A", "Disease", 1, 0, 0.0), ("Gene", "A", "Disease", 2, 1, 2.0)],
                                  "src_type string, rel string, dst_type string, src long, dst long, bias double")
    return nodes, edges


def taus(spark, value):
    return spark.createDataFrame([("Gene", "A", "Disease", value)], "src_type string, rel string, dst_type string, tau double")


def test_attention(spark):
    nodes, edges = attention_toy(spark)

    def alpha(tau, **kw):
        w = A.attention_weights(edges, nodes, nodes, taus(spark, tau), heads=2, dim=8, **kw)
        return {(r.src, r.dst): r.alpha for r in w.collect()}

    assert alpha(0.001) == alpha(0.01)  # clamped
    assert alpha(1.0, bias="bias", decay=0.0) == alpha(1.0)
    assert alpha(1.0, bias="bias", decay=1.0) != alpha(1.0)
    assert abs(sum(a[0] for a in alpha(1.0).values()) - 1.0) < 1e-9
    by_dst = alpha(1.0, scope="dst")
    assert abs(by_dst[(0, 0)][0] + by_dst[(1, 0)][0] - 1.0) < 1e-9 and abs(by_dst[(2, 1)][1] - 1.0) < 1e-9
    w = A.attention_weights(edges, nodes, nodes, taus(spark, 1.0), heads=2, dim=8)
    for side in ("dst", "src"):
        out = A.attention_layer(nodes, w, nodes, heads=2, dim=8, value_side=side).collect()
        assert len(out) == 7 and all(np.isfinite(r.vec).all() for r in out)


def test_relational_mean(spark):
    nodes, edges = attention_toy(spark)
    vecs = {(r.node_type, r.idx): np.array(r.vec) for r in nodes.collect()}
    out = {(r.node_type, r.idx): np.array(r.vec) for r in A.relational_mean(nodes, edges, 8).collect()}
    want = np.maximum((vecs[("Gene", 0)] + vecs[("Gene", 1)]) / 2, 0)
    assert np.allclose(out[("Disease", 0)], want) and np.allclose(out[("Disease", 2)], np.maximum(vecs[("Disease", 2)], 0))


def test_walk_vectors_isolated_and_empty(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    nodes = spark.range(4)
    out = {r.id: r.vec for r in FE.walk_vectors(nodes, edges, dim=8, walk_length=5, walks_per_node=3, window=2).collect()}
    assert len(out) == 4 and out[3] == [0.0] * 8 and any(out[0])
    noise = FE.walk_vectors(nodes, edges.limit(0), dim=8).first().vec
    assert any(noise) and max(map(abs, noise)) <= 0.01
    again = {r.id: r.vec for r in FE.walk_vectors(nodes, edges.repartition(3), dim=8, walk_length=5, walks_per_node=3, window=2).collect()}
    assert again == out


def test_row_sums_are_those_of_slices_in_less_time():
    rng = np.random.default_rng(6)
    for top, n in ((40, 1000), (900, 1024), (3, 5), (5, 0)):
        at, rows = rng.integers(0, top, n), rng.normal(size=(n, 128)).astype(np.float32)
        ids, sums = LR.sum_rows(at, rows)
        assert ids.tolist() == sorted(set(at.tolist()))
        assert all(np.allclose(sums[k], rows[at == i].sum(axis=0), atol=1e-4) for k, i in enumerate(ids))
    at, rows = rng.integers(0, 3000, 4096), rng.normal(size=(4096, 128)).astype(np.float32)

    def slices():
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        return np.add.reduceat(rows[order], first, axis=0)

    def least(run):
        return min(timeit.repeat(run, number=5, repeat=7))

    assert np.allclose(LR.sum_rows(at, rows)[1], slices(), atol=1e-4) and least(lambda: LR.sum_rows(at, rows)) < 0.8 * least(slices)


def test_walk_vectors_predict_links(spark):
    """Held-out links of a graph with groups: better than vectors from factored counts of the same walks."""
    rng = np.random.default_rng(12)
    group = rng.integers(0, 6, 150)
    pairs = [(i, j) for i in range(150) for j in range(i) if rng.random() < (0.25 if group[i] == group[j] else 0.01)]
    rng.shuffle(pairs)
    held, kept = pairs[:len(pairs) // 5], pairs[len(pairs) // 5:]
    walks = FE.random_walks(spark.createDataFrame([tuple(map(int, p)) for p in kept], "a long, b long"), 12, 12)
    counts = cut_lineage(SG.window_pairs(walks, 4))
    learned = {r.id: np.array(r.vec) for r in SG.skipgram_vectors(counts, 16, epochs=4).collect()}
    log_counts = counts.select("a", "b", F.log1p("n").alias("v"))
    factored = {r.id: np.array(r.vec) for r in LR.symmetric_vectors(log_counts, 16).collect()}
    known = {frozenset(p) for p in pairs}
    others = [(i, j) for i in range(150) for j in range(i) if frozenset((i, j)) not in known]

    def auroc(vectors):
        near = lambda p: vectors[p[0]] @ vectors[p[1]] / np.linalg.norm(vectors[p[0]]) / np.linalg.norm(vectors[p[1]])
        scores = [[near(p) for p in part if p[0] in vectors and p[1] in vectors] for part in (held, others)]
        return np.mean([(x > np.array(scores[1])).mean() for x in scores[0]])

    assert auroc(learned) > 0.8 and auroc(learned) > auroc(factored)


def test_text_vectors_empty_text_is_zero(spark):
    texts = spark.createDataFrame([(1, "alpha beta alpha beta"), (2, ""), (3, None), (1, "alpha beta alpha beta"), (4, "--- ---")], "id long, text string")
    rows = FE.text_vectors(texts, dim=4).collect()
    assert len(rows) == 5 and all(r.vec == [0.0] * 4 for r in rows if r.id in (2, 3, 4))
    assert len({tuple(r.vec) for r in rows if r.id == 1}) == 1 and any(rows[0].vec) | any(rows[1].vec)
    assert FE.text_vectors(texts.limit(0), dim=4).count() == 0


def test_tokens_of_like_use_have_like_vectors(spark):
    """Two words that stand in the same places, and one that stands in others."""
    rng = np.random.default_rng(2)
    places, others = ["red", "blue", "green", "grey"], ["seven", "nine", "three", "five"]
    lines = []
    for i in range(900):
        noun, words = [("car", places), ("auto", places), ("sum", others)][i % 3]
        lines.append((i, " ".join([rng.choice(words), noun, rng.choice(words), rng.choice(words)])))
    learned = {r.token: np.array(r.vec) for r in FE.token_vectors(spark.createDataFrame(lines, "id long, text string"), dim=6, window=2).collect()}

    def cosine(a, b):
        return learned[a] @ learned[b] / np.linalg.norm(learned[a]) / np.linalg.norm(learned[b])

    assert cosine("car", "auto") > 0.9 > 0.5 > cosine("car", "sum")


def test_walks_are_the_same_in_short_legs(spark, monkeypatch):
    edges = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(0, 3), (2, 5)], "a bigint, b bigint")
    linked = {(r.a, r.b) for r in edges.collect()} | {(r.b, r.a) for r in edges.collect()}

    def walked():
        return {(r.start, r.walk_no): r.walk for r in FE.random_walks(edges, 8, 2).collect()}

    monkeypatch.setattr(FE, "LEG", 3)
    short = walked()
    assert len(short) == 14 and all(len(w) == 8 and w[0] == k[0] and set(zip(w, w[1:])) <= linked for k, w in short.items())
    monkeypatch.setattr(FE, "LEG", 100)
    assert walked() == short


def test_training_in_chunks_equals_broadcast(spark, monkeypatch):
    from edgeloom.operators import kge
    from edgeloom.session import shared_dir

    triples = spark.createDataFrame([(i % 9, i % 2, (i * 5 + 3) % 20) for i in range(40)], "h bigint, r bigint, t bigint").distinct()
    ids, kinds = spark.range(20), spark.range(2)
    kept = len([p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith("epoch-")])
    want = kge.fit(triples, ids, kinds, "rotate", dim=8, epochs=6, lr=0.05)
    for name, value in (("BROADCAST_NUMBERS", 0), ("CHUNK_ROWS", 7), ("BATCH_ROWS", 3)):
        monkeypatch.setattr(kge, name, value)
    got = kge.fit(triples, ids, kinds, "rotate", dim=8, epochs=6, lr=0.05)
    assert np.allclose(got[2], want[2]) and len(got[2]) == 6 and min(got[2]) > 0
    for a, b in zip(got[:2], want[:2]):
        mine, theirs = ({r.id: r.vec for r in x.collect()} for x in (a, b))
        assert mine.keys() == theirs.keys() and all(np.allclose(mine[i], theirs[i]) for i in mine)
    # Only the last state of each model is left.
    assert len([p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith("epoch-")]) == kept + 2


def test_sparse_times_in_small_blocks(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 4), ("TASK_CELLS", 10), ("PART_ROWS", 3), ("CHUNK", 7)):
        monkeypatch.setattr(LR, name, value)
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(12, 11)) * (rng.random((12, 11)) < 0.6)
    vectors = rng.normal(size=(11, 5))
    cells = spark.createDataFrame([(a, b, float(dense[a, b])) for a, b in zip(*(x.tolist() for x in np.nonzero(dense)))], "a bigint, b bigint, v double")
    dealt = LR.deal_cells(cells)
    assert len(dealt[1]) == 3 and max(dealt[1].values()) > 1
    got = {r.no: r.vec for r in LR.sparse_times(dealt, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "no bigint, vec array<double>")).collect()}
    assert np.allclose([got[a] for a in range(12)], dense @ vectors)


def test_text_vectors_keep_one_table(spark):
    from edgeloom.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    texts = spark.createDataFrame([(i, f"w{i % 5} x{i % 3} y{i % 2}") for i in range(60)] + [(60, None), (61, "once")], "id long, text string")
    vectors = FE.text_vectors(texts, dim=4)
    assert len(set(folder.iterdir()) - before) == 1
    got = {r.id: r.vec for r in vectors.collect()}
    assert len(got) == 62 and got[60] == [0.0] * 4 and got[0] == got[30] != [0.0] * 4


def test_walks_leave_one_table_and_deal_neighbours_once(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from edgeloom.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    held = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a, f=DataFrame.persist, **k: held.append(self) or f(self, *a, **k))
    edges = spark.createDataFrame([(i, (i + step) % 12) for i in range(12) for step in (1, 5)], "a long, b long")
    walks = FE.random_walks(edges, 8, 2)
    assert len(set(folder.iterdir()) - before) == 1 and len(held) == 1 and not held[0].is_cached
    assert walks.count() == 24 and all(len(r.walk) == 8 and all((b - a) % 12 in (1, 5, 7, 11) for a, b in zip(r.walk, r.walk[1:])) for r in walks.collect())


def test_sparse_times_beyond_the_narrow_blocks(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 2), ("NARROW", 2), ("WIDER", 3), ("TASK_CELLS", 5)):
        monkeypatch.setattr(LR, name, value)
    dense = np.random.default_rng(4).normal(size=(6, 15))
    cells = spark.createDataFrame([(a, b, float(dense[a, b])) for a in range(6) for b in range(15)], "a bigint, b bigint, v double")
    dealt = LR.deal_cells(cells)
    assert sorted(dealt[1]) == [0, 1, 2, 3]
    got = {r.no: r.vec for r in LR.sparse_times(dealt, spark.createDataFrame([(i, [float(i), 1.0]) for i in range(15)], "no bigint, vec array<double>")).collect()}
    assert np.allclose([got[a] for a in range(6)], dense @ np.column_stack([np.arange(15), np.ones(15)]))


def test_token_pairs_leave_their_texts(spark):
    pairs = FE.token_pairs(spark.createDataFrame([("x y x",), ("x y x",), (None,)], "text string"), window=2)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "Generate explode(concat" in x)
    assert "[0]" in line  # the text is not copied to each of its pairs
    vocabulary, salt = FE.token_keys(spark.createDataFrame([("x y x",)], "text string"))
    key = {r.token: r.key for r in vocabulary.collect()}
    assert salt == 0 and {(r.a, r.b): r.n for r in pairs.collect()} == {
        (key["x"], key["y"]): 4, (key["y"], key["x"]): 4, (key["x"], key["x"]): 4}


def test_symmetric_vectors_match_eigenvectors(spark):
    rng = np.random.default_rng(8)
    half = rng.normal(size=(60, 4)) * [4, 3, 2, 1]
    full = half @ half.T
    cells = spark.createDataFrame([(int(i), int(j), float(full[i, j])) for i in range(60) for j in range(60)], "a long, b long, v double").repartition(20)
    got = {r.id: r.vec for r in LR.symmetric_vectors(cells, 4).collect()}
    found = np.array([got[i] for i in range(60)])
    assert np.allclose(found @ found.T, full, atol=1e-6)


@pytest.mark.parametrize("n, width, k", [(400, 60, 12), (30, 768, 128), (50, 8, 8)])
def test_principal_components_match_numpy(spark, n, width, k):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(n, width)) * (0.8 ** np.arange(width)) @ np.linalg.qr(rng.normal(size=(width, width)))[0] + 3.0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + [(n, None)], "id long, vec array<double>").repartition(21)
    mean, components, variances, total = LR.principal_components(rows.where("vec is not null"), k)
    _, s, vt = np.linalg.svd(data - data.mean(axis=0), full_matrices=False)
    real = min(k, n - 1, width)
    assert np.allclose(mean, data.mean(axis=0)) and abs(total - data.var(axis=0, ddof=1).sum()) < 1e-9
    assert np.allclose(variances[:real], (s ** 2 / (n - 1))[:real], rtol=1e-6, atol=1e-12) and (np.diff(variances) <= 1e-12).all()
    kept = int((variances > variances[0] * 1e-8).sum())
    assert np.allclose(components[:kept] @ components[:kept].T, np.eye(kept), atol=1e-8)
    centred = data - mean
    lost = np.linalg.norm(centred - centred @ components.T @ components) ** 2
    assert lost <= (s[real:] ** 2).sum() * 1.01 + 1e-6
    reduced, shares = FE.reduce_dimension(rows, k)
    got = {r.id: r.vec for r in reduced.collect()}
    assert got[n] is None and len(got) == n + 1 and np.allclose(got[3], (data[3] - mean) @ components.T, atol=1e-9)
    assert shares.sum() <= 1 + 1e-9


def test_ranking_plan_has_no_cross_join(spark):
    rng = np.random.default_rng(6)
    rows = [("Gene", i, f"gene {i}", rng.normal(size=4).tolist()) for i in range(30)]
    rows += [("Disease", i, f"disease {i}", rng.normal(size=4).tolist()) for i in range(20)]
    vectors = spark.createDataFrame(rows, "node_type string, idx long, name string, vec array<double>")
    known = spark.createDataFrame([("Gene", "ASSOCIATED_WITH", "Disease", i, i) for i in range(10)],
                                  "src_type string, rel string, dst_type string, src long, dst long")
    ranked = rank_targets(vectors, known, [("Gene", "ASSOCIATED_WITH", "Disease")], top_k=40, block=7)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = ranked.orderBy("rank").collect()
    genes, diseases = np.array([r[3] for r in rows[:30]]), np.array([r[3] for r in rows[30:]])
    scores = genes @ diseases.T
    scores[range(10), range(10)] = -np.inf
    best = np.argsort(-scores.ravel())[:40]
    seen = list(dict.fromkeys(f"gene {b // 20}" for b in best))
    assert [r.canonical_name for r in got] == seen and math.isclose(got[0].score, scores.max(), abs_tol=1e-7)


def test_two_layer_inference_matches_numpy(spark):
    from edgeloom.operators.attention import Linear, Norm
    from edgeloom.plans.inference import Layer, forward

    rng = np.random.default_rng(11)
    heads, dim, sizes = 2, 4, {"A": 5, "B": 3}
    x = {t: rng.normal(size=(n, 3)) for t, n in sizes.items()}
    m = lambda *shape: rng.normal(size=shape)
    typed = lambda i, o: Linear({t: m(i, o) for t in sizes}, {t: m(o) for t in sizes})
    encoder, norms = typed(3, dim), {t: Norm(m(dim), m(dim)) for t in sizes}
    layers = [Layer(typed(dim, dim), typed(dim, dim), typed(dim, dim), Linear(m(dim, dim), m(dim)), Linear(m(dim, dim), m(dim)), Norm(m(dim), m(dim)))
              for _ in range(2)]
    output = Linear(m(dim, 2), m(2))
    links = {("A", "r", "B"): [(0, 0), (1, 0), (2, 1), (4, 1)], ("B", "q", "A"): [(0, 3), (1, 3), (2, 0)]}
    tau = {("A", "r", "B"): 0.5, ("B", "q", "A"): 2.0}

    h = {t: norms[t].at(encoder.at(t, v)) for t, v in x.items()}
    for layer in layers:
        total = {t: np.zeros((n, dim)) for t, n in sizes.items()}
        for (s, r, d), pairs in links.items():
            src, dst = map(list, zip(*pairs))
            q, k, v = (w.at(t, h[t])[i].reshape(-1, heads, dim // heads) for w, t, i in ((layer.query, s, src), (layer.key, d, dst), (layer.value, d, dst)))
            score = (q * k).sum(-1) / (tau[s, r, d] * np.sqrt(dim // heads))
            alpha = np.exp(score - score.max(0))
            alpha /= alpha.sum(0)
            np.add.at(total[d], dst, (alpha[:, :, None] * v).reshape(-1, dim))
        h = {t: layer.norm.at(layer.skip.at(t, h[t]) + layer.out.at(t, total[t])) for t in sizes}
    want = {(t, i): output.at(t, h[t])[i] for t, n in sizes.items() for i in range(n)}

    features = spark.createDataFrame([(t, i, v.tolist()) for t in sizes for i, v in enumerate(x[t])], "node_type string, idx long, vec array<double>")
    edges = spark.createDataFrame([(*k, a, b) for k, pairs in links.items() for a, b in pairs], "src_type string, rel string, dst_type string, src long, dst long")
    temperatures = spark.createDataFrame([(*k, v) for k, v in tau.items()], "src_type string, rel string, dst_type string, tau double")
    got = forward(features, edges, temperatures, encoder, layers, output, heads=heads, dim=dim, norms=norms).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(r.vec, want[r.node_type, r.idx])


def test_remaining_digests_are_those_of_the_lists(spark):
    sets = spark.createDataFrame([("one", "x"), ("two", "b"), ("two", "a"), ("two", "ab"), ("two", "b"), ("odd", ""), ("odd", "é"), ("odd", None),
                                  *[(f"s{i % 40}", f"P{i}") for i in range(600)]], "set_name string, gene string")
    made = E.remaining_digests(sets)
    want = E.remaining_genes(sets).select("set_name", "removed", F.size("genes").cast("bigint").alias("n_left"), F.md5(F.array_join("genes", ",")).alias("digest"))
    assert made.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    # A small table of sets makes many bytes to digest: it must not end up in one task.
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
