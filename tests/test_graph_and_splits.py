"""Graph loading, splits, negatives, literature and the dataset plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import graph as G
from edgeloom.operators import literature as L
from edgeloom.operators import negatives as N
from edgeloom.operators import splits as S
from edgeloom.plans.dataset import build_dataset
from edgeloom.sources import readers, writers

EDGE = "src_type string, rel string, dst_type string, src long, dst long, pub_date string"
NODE = "node_type string, idx long, name string, pub_date string"


@pytest.fixture(scope="module")
def dated(spark):
    edges = spark.createDataFrame([
        ("Gene", "ASSOC", "Disease", 0, 0, "2019-08-01"), ("Gene", "ASSOC", "Disease", 1, 1, "2020-01-01"),
        ("Gene", "ASSOC", "Disease", 2, 0, "2025-08-01"), ("Gene", "ASSOC", "Disease", 3, 2, "2021-05-01"),
        ("Gene", "REGULATES", "Gene", 2, 0, "2025-08-01"), ("Gene", "REGULATES", "Gene", 3, 1, "2025-08-01"),
        ("Gene", "REGULATES", "Gene", 0, 1, None), ("Gene", "REGULATES", "Gene", 1, 0, "2030-01-01")], EDGE)
    nodes = spark.createDataFrame([
        ("Gene", 0, "a", "2010-01-01"), ("Gene", 1, "b", None), ("Gene", 2, "c", "2025-03-01"), ("Gene", 3, "d", "2020"),
        ("Disease", 0, "x", None), ("Disease", 1, "y", None), ("Disease", 2, "z", None)], NODE)
    return edges, nodes


def test_temporal_split(dated):
    rows = S.temporal_split(dated[0]).collect()
    got = {(r.rel, r.src, r.dst): r.split for r in rows}
    assert got[("ASSOC", 0, 0)] == got[("ASSOC", 1, 1)] == got[("ASSOC", 3, 2)] == "train"
    assert got[("ASSOC", 2, 0)] == "test" and got[("REGULATES", 0, 1)] == "train"
    assert got[("REGULATES", 1, 0)] == "dropped"


def test_inductive_routing(dated):
    edges, nodes = dated
    routed = S.route_inductive(S.temporal_split(edges), nodes)
    got = {(r.rel, r.src, r.dst): r.split for r in routed.collect()}
    assert got[("REGULATES", 2, 0)] == "inductive" and got[("REGULATES", 3, 1)] == "test"
    report = S.temporal_report(routed).first()
    assert report.test_edges == 1 and report.inductive_edges == 2 and report.has_temporal_info


def test_stratified_split_is_complete_and_disjoint(spark):
    edges = spark.range(100).select(F.lit("A").alias("src_type"), F.lit("R").alias("rel"), F.lit("B").alias("dst_type"),
                                    F.col("id").alias("src"), (F.col("id") % 9).alias("dst"))
    few = edges.where("src < 6").withColumn("rel", F.lit("FEW"))
    both = edges.unionByName(few).unionByName(edges.where("src < 5"))
    split = S.stratified_split(both)
    assert split.count() == 106 and split.select(*S.PAIR).distinct().count() == 106
    counts = {(r.rel, r.split): r["count"] for r in split.groupBy("rel", "split").count().collect()}
    assert counts == {("R", "train"): 80, ("R", "val"): 10, ("R", "test"): 10, ("FEW", "train"): 6}
    again = S.stratified_split(both.repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))
    audit = S.leakage_audit(split, [("train", "val"), ("train", "test"), ("val", "test")])
    assert {r.overlap for r in audit.collect()} == {0}
    with pytest.raises(ValueError):
        S.stratified_split(both, 0.5, 0.1, 0.1)


def test_types_and_reindex(spark):
    scans = spark.createDataFrame([(1, "Entity", "F2"), (1, "Gene", None), (2, "Entity", None), (3, "Odd", "o")],
                                  "node_id long, label string, name string")
    merged = G.merge_labels(scans).withColumn("node_type", G.assign_type(F.col("labels")))
    assert {r.node_id: (r.name, r.node_type) for r in merged.collect()} == {
        1: ("F2", "Gene"), 2: ("2", "Entity"), 3: ("o", "Odd")}
    ids = spark.createDataFrame([("A", 10, 0), ("A", 20, 1), ("B", 5, 0)], "node_type string, node_id long, local_idx long")
    edges = spark.createDataFrame([("A", "R", "B", 10, 5), ("A", "R", "B", 20, 99), ("A", "Q", "A", 10, 20)],
                                  "src_type string, rel string, dst_type string, src long, dst long")
    assert [(r.rel, r.src_idx, r.dst_idx) for r in G.reindex_edges(edges, ids).collect()] == [("Q", 0, 1)]
    assert G.reindex_edges(edges, ids, on_dangling="drop_edge").count() == 2


def toy(spark):
    edges = spark.createDataFrame([("Gene", "ASSOC", "Disease", 0, d) for d in (1, 2, 3)] + [("Gene", "ASSOC", "Disease", 4, 1)],
                                  "src_type string, rel string, dst_type string, src long, dst long")
    nodes = spark.createDataFrame([("Gene", i) for i in range(5)] + [("Disease", i) for i in range(5)], "node_type string, idx long")
    return edges, nodes


def test_negatives_avoid_positives_and_repeat(spark):
    edges, nodes = toy(spark)
    first = N.degree_preserving(edges, nodes, 3)
    rows = sorted((r.src, r.dst) for r in first.collect())
    assert len(rows) == 12 == len(set(rows))
    assert not set(rows) & {(0, 1), (0, 2), (0, 3), (4, 1)}
    assert rows == sorted((r.src, r.dst) for r in N.degree_preserving(edges.repartition(3), nodes, 3).collect())


def test_negatives_fall_short_only_when_space_is_exhausted(spark):
    edges, nodes = toy(spark)
    # 25 pairs, 4 positive: at most 21 negatives exist.
    assert N.degree_preserving(edges, nodes, 10).count() == 21


def test_hard_negatives_and_injection(spark):
    nodes = spark.createDataFrame([("Gene", 0, "Padi4"), ("Gene", 1, "Hmgb1"), ("Gene", 2, "F2"), ("Disease", 0, "VTE"),
                                   ("Disease", 1, "DVT"), ("Protein", 0, "p0"), ("Protein", 1, "p1")],
                                  "node_type string, idx long, name string")
    false = N.falsified_negatives(nodes, ["Padi4", "Hmgb1", "Gone"], "Gene", "ASSOC", "Disease", 5)
    assert false.count() == 20
    cross = N.cross_group_negatives(nodes, [("g", "VTE"), ("h", "none")], "Protein", "ASSOC", "Disease", 10)
    assert sorted((r.src, r.dst) for r in cross.collect()) == [(0, 0), (1, 0)]
    pairs = spark.createDataFrame([("Gene", "ASSOC", "Disease", "F2", "vt"), ("Gene", "ASSOC", "Disease", "Nope", "VTE")],
                                  "src_type string, rel string, dst_type string, src_name string, dst_name string")
    resolved = N.resolve_pairs(pairs, nodes)
    assert [(r.src, r.dst) for r in resolved.where("resolved").collect()] == [(2, 0)]
    schema = "src_type string, rel string, dst_type string, src long, dst long"
    train = spark.createDataFrame([("Gene", "ASSOC", "Disease", 1, 1)], schema)
    negatives = spark.createDataFrame([("Gene", "ASSOC", "Disease", 2, 0), ("Gene", "ASSOC", "Disease", 0, 1)], schema)
    more, less = N.inject(train, negatives, resolved)
    assert more.count() == 2 and less.count() == 1


def test_date_cache_and_edge_dates(spark):
    wanted = spark.createDataFrame([("1",), ("2",), ("9",)], "pmid string")
    cache = spark.createDataFrame([("1", "2001-01-01"), ("5", "2005-01-01")], "pmid string, pub_date string")
    source = spark.createDataFrame([("1", "1999-01-01"), ("2", "2002-01-01")], "pmid string, pub_date string")
    grown, found = L.resolve_dates(wanted, cache, source)
    assert sorted(map(tuple, found.collect())) == [("1", "2001-01-01"), ("2", "2002-01-01")] and grown.count() == 3
    edges = spark.createDataFrame([(1, ["1", "2"]), (2, ["9"]), (3, None)], "e long, pmids array<string>")
    assert {r.e: r.pub_date for r in L.date_edges(edges, grown, ["e"]).collect()} == {1: "2001-01-01", 2: None, 3: None}


def test_eras(spark):
    cases = {"2018-03-15": "train_era", "2025-01-15": "val_era", "2025-08-01": "prospective", "2026-01-20": "prospective"}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", L.era(F.col("d")).alias("e")).collect()
    assert {r.d: r.e for r in rows} == cases
    dates = spark.createDataFrame([("12345", "2025-08-15"), ("67890", "2023-06-01"), ("11111", "2026-01-10")], "pmid string, pub_date string")
    assert {r.pmid for r in L.prospective(dates).collect()} == {"12345", "11111"}


def test_article_xml_files(spark, tmp_path):
    def article(pmid, inner, history=""):
        return (f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article>{inner}</Article></MedlineCitation>"
                f"<PubmedData><History>{history}</History></PubmedData></PubmedArticle>")

    body = "".join([
        article(1, "<ArticleDate><Year>2020</Year><Month>3</Month><Day>5</Day></ArticleDate>"),
        article(2, "", '<PubMedPubDate PubStatus="entrez"><Year>1999</Year></PubMedPubDate>'
                       '<PubMedPubDate PubStatus="pubmed"><Year>2001</Year><Month>12</Month></PubMedPubDate>'),
        article(3, "<Journal><JournalIssue><PubDate><Year>2010</Year><Month>Jan</Month></PubDate></JournalIssue></Journal>"),
        article(4, "<ArticleDate><Month>3</Month></ArticleDate>")])
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{body}</PubmedArticleSet>")
    got = {r.pmid: r.pub_date for r in readers.article_dates(readers.read_articles(spark, str(tmp_path))).collect()}
    assert got == {"1": "2020-03-05", "2": "2001-12-01", "3": "2010-Jan-01"}


def test_candidate_and_target_files(spark, tmp_path):
    (tmp_path / "ranked.json").write_text('[{"rank": 1, "canonical_name": "A", "score": 2.5, "is_par2": true}]')
    assert readers.read_candidates(spark, str(tmp_path / "ranked.json")).first().score == 2.5
    (tmp_path / "t.json").write_text('{"targets": [{"gene": "F11"}, {"gene": "KNG1"}]}')
    rows = readers.read_target_list(spark, str(tmp_path / "t.json"), "targets", "gene:string").collect()
    assert [r.gene for r in rows] == ["F11", "KNG1"]
    (tmp_path / "p.csv").write_text("gene\nA\nB\n")
    assert readers.read_gene_program(spark, str(tmp_path / "p.csv"), "prog").count() == 2
    edges = spark.createDataFrame([("a", "b", 0.9)], "s string, t string, w double")
    writers.write_subgraph(edges, edges.select("s"), str(tmp_path / "sub"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sub/edges")).count() == 1


def test_dataset_plan(spark):
    scans = spark.range(40).select(F.col("id").alias("node_id"), F.when(F.col("id") < 25, "Gene").otherwise("Disease").alias("label"),
                                   F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    raw = spark.range(60).select((F.col("id") % 25).alias("src"), F.lit("ASSOC").alias("rel"),
                                 (25 + (F.col("id") * 7) % 15).alias("dst"), F.array(F.col("id").cast("string")).alias("pmids"))
    dates = spark.range(60).select(F.col("id").cast("string").alias("pmid"),
                                   F.when(F.col("id") % 6 == 0, "2025-08-01").otherwise("2020-01-01").alias("pub_date"))
    built = build_dataset(scans, raw, dates)
    report = built.report.first()
    assert report.train_edges + report.test_edges == built.edges.count() and report.test_edges > 0
    assert built.negatives.count() == report.train_edges
    assert N.audit(built.negatives, built.edges.where("split = 'train'")).first().n_positive == 0


def test_sources_keep_their_share_when_most_destinations_are_taken(spark):
    # Source 0 has 38 of 40 destinations, sources 1..19 one each: source 0 owns 39 of 77 slots.
    rows = [("A", "r", "B", 0, d) for d in range(38)] + [("A", "r", "B", s, s) for s in range(1, 20)]
    edges = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, src long, dst long")
    nodes = spark.createDataFrame([("A", i) for i in range(20)] + [("B", i) for i in range(40)], "node_type string, idx long")
    first = [N.degree_preserving(edges.where(f"src = 0 or src = {s}"), nodes.where(f"node_type = 'B' or idx in (0, {s})"), 1, seed=s).collect()
             for s in (3, 7)]
    for drawn in first:
        taken = {(r.src, r.dst) for r in drawn}
        assert len(taken) == 39 and not taken & {(r[3], r[4]) for r in rows if r[3] == 0}
        assert sum(s == 0 for s, _ in taken) == 2  # both of its free pairs


def test_every_free_pair_is_returned_when_all_are_wanted(spark):
    rows = [("A", "r", "B", i, i) for i in range(6)]
    edges = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, src long, dst long")
    nodes = spark.createDataFrame([(k, i) for k in "AB" for i in range(6)], "node_type string, idx long")
    for n, want in ((2, 12), (5, 30), (9, 30)):
        got = {(r.src, r.dst) for r in N.degree_preserving(edges, nodes, n).collect()}
        assert len(got) == want and all(a != b for a, b in got)


def test_names_found_by_grams(spark):
    """Against plain containment: short, empty, repeated and missing terms, letters of any case."""
    rng = np.random.default_rng(6)
    names = [("G", i, "".join(rng.choice(list("abAB c-é"), rng.integers(0, 9)))) for i in range(300)] + [("G", 300, None), ("D", 1, "Abcab"), ("D", 0, "xxabcab")]
    nodes = spark.createDataFrame([(k, n, i) for k, i, n in names], "node_type string, name string, idx long")
    terms = {("".join(rng.choice(list("abAB cé"), rng.integers(0, 6)))) for _ in range(60)} | {"", "zzz", "ABCAB", "É"}
    asked = spark.createDataFrame([(k, t) for t in terms for k in ("G", "D")] * 2 + [("none", "a"), ("G", None)], "node_type string, term string")
    got = {(r.node_type, r.term): r.idx for r in N.containing_names(nodes, asked).collect()}
    want = {}
    for kind in ("G", "D"):
        for term in terms:
            held = [i for k, i, n in names if k == kind and n is not None and term.lower() in n.lower()]
            if held:
                want[kind, term] = min(held)
    assert got == want
    plan = N.containing_names(nodes, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert N.containing_names(nodes, asked.limit(0)).count() == 0


def test_gap_index_reaches_every_free_pair_alike(spark):
    """Raw draws of a small graph: no positive pair, and frequencies as the weights say."""
    edges = spark.createDataFrame([("A", "R", "B", s, d) for s, d in [(0, 0), (0, 1), (0, 2), (0, 4), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]],
                                  "src_type string, rel string, dst_type string, src long, dst long")
    nodes = spark.createDataFrame([("A", i) for i in range(4)] + [("B", i) for i in range(5)], "node_type string, idx long")
    keyed, kinds = N._keyed(edges)
    index = N.gap_index(keyed, nodes, N._within(keyed.select(N.KEY, "src", "dst"), nodes, kinds))
    draws = 20_000
    seen = {(r.src, r.dst): r["count"] for r in N.weighted_draws(index, {0: draws}).groupBy("src", "dst").count().collect()}
    positive = {(r.src, r.dst) for r in edges.collect()}
    out = {s: 1 + sum(a == s for a, _ in positive) for s in range(4)}
    into = {d: 1 + sum(b == d for _, b in positive) for d in range(5)}
    free = {s: [d for d in range(5) if (s, d) not in positive] for s in range(4)}
    total = sum(out[s] for s in free if free[s])
    want = {(s, d): draws * out[s] / total * into[d] / sum(into[x] for x in free[s]) for s in free for d in free[s]}
    assert set(seen) == set(want) and sum(seen.values()) == draws
    assert all(abs(seen[p] - want[p]) < 5 * np.sqrt(want[p]) for p in want)


def test_first_draws_cut_exactly(spark):
    rows = spark.createDataFrame([(k, i, i, i * 7 % 1000 + (k == 1) * 10 ** 9) for k in (0, 1, 2) for i in range(1000)], "_rel int, src long, dst long, draw long")
    kept = N.first_draws(rows, {0: 17, 1: 999, 2: 5000}, fan=8)
    got = {k: sorted(r.draw for r in kept.where(f"_rel = {k}").collect()) for k in (0, 1, 2)}
    assert got[0] == list(range(17)) and got[1] == [10 ** 9 + i for i in range(999)] and len(got[2]) == 1000


def test_dates_of_other_relations_are_not_joined(spark):
    edges = spark.createDataFrame([("A", "R", "B", 1, 1, "2001"), ("A", "Q", "B", 1, 1, "2002"), ("A", "R", "B", 2, 1, "2003"), ("A", None, "B", 3, 1, "2004")], EDGE)
    key = ["src_type", "rel", "dst_type", "src", "dst"]
    dates = spark.createDataFrame([("A", "R", "B", 1, 1, "1990"), ("A", "Q", "B", 1, 1, "1991"), ("A", "Q", "B", 1, 1, "1992")], EDGE)
    out = L.inject_dates(edges, dates, key, ["R"])
    assert out.columns == edges.columns
    got = sorted((r.rel or "", r.src, r.pub_date) for r in out.collect())
    assert got == [("", 3, "2004"), ("Q", 1, "2002"), ("R", 1, "1990"), ("R", 2, None)]


def test_tasks_follow_the_size_of_their_input(spark, tmp_path, monkeypatch):
    from edgeloom import session
    from edgeloom.operators.ordering import running_totals

    path = str(tmp_path / "rows")
    spark.range(20_000).select(F.xxhash64("id").alias("k"), F.pmod("id", F.lit(3)).alias("g"), F.lit(1).cast("bigint").alias("v")).write.parquet(path)
    rows = spark.read.parquet(path)
    assert session.spread(rows, "k").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(session, "PIECE_BYTES", 8_192)
    assert session.spread(rows, "k").rdd.getNumPartitions() == -(-session.input_bytes(rows) // 8_192) > 8
    totals = running_totals(rows, ["g"], [F.col("k")], {"upto": F.col("v")})
    assert totals.groupBy("g").agg(F.max("upto").alias("n")).agg(F.sum("n")).first()[0] == 20_000
    assert totals.select("g", "upto").distinct().count() == 20_000
    # The window's tasks follow the size too: the session's four would each hold more the larger the input is.
    assert totals.rdd.getNumPartitions() > 8


def test_uniform_fill_in_parts_and_turns(spark, monkeypatch):
    """The same pairs whether draws look for their ends at once or in turns; no table but the result is left."""
    from pathlib import Path

    from edgeloom.session import shared_dir

    edges = spark.createDataFrame([("A", "r", "B", i % 20, (i * 7) % 23) for i in range(60)], "src_type string, rel string, dst_type string, src long, dst long")
    nodes = spark.createDataFrame([("A", i) for i in range(20)] + [("B", i) for i in range(23)], "node_type string, idx long")
    drawn = []
    monkeypatch.setattr(N, "_draws", lambda edges, wanted, start, f=N._draws: drawn.append(sum(wanted.values())) or f(edges, wanted, start))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    whole = N.degree_preserving(edges, nodes, 1, rounds=0)
    assert len(set(folder.iterdir()) - before) == 1
    n = edges.distinct().count()
    assert drawn[0] == n + n // 16 + 16  # half as many again are drawn only where these fall short
    found = {(r.src, r.dst) for r in whole.collect()}
    assert len(found) == n and not found & {(r.src, r.dst) for r in edges.collect()}
    monkeypatch.setattr(N, "TURN_DRAWS", 20)
    assert {(r.src, r.dst) for r in N.degree_preserving(edges, nodes, 1, rounds=0).collect()} == found
