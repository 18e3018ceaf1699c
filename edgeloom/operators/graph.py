"""Nodes, edges, types, degrees and graph-wide statistics.

Shapes: ``nodes(node_type, idx, name, ...)`` and
``edges(src_type, rel, dst_type, src, dst, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom import constants
from edgeloom.operators.ordering import dense_number
from edgeloom.operators.skew import small_side, spread_join
from edgeloom.session import cut_lineage

EDGE_TYPE = ["src_type", "rel", "dst_type"]


def edge_key() -> Column:
    return F.concat_ws("__", *EDGE_TYPE)


def merge_labels(scans: DataFrame) -> DataFrame:
    """One row per node from per-label scans; a missing name falls back to the id."""
    return scans.groupBy("node_id").agg(
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.coalesce(F.min("name"), F.col("node_id").cast("string")).alias("name"))


def edge_scan(raw: DataFrame, support: str = "pmid_count") -> DataFrame:
    """Edges with weight = number of supporting papers, 1 when unknown."""
    return raw.withColumn("weight", F.coalesce(F.col(support), F.lit(1)).cast("bigint")).drop(support)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_nodes"))


def assign_type(labels: Column, priority: Sequence[str] = constants.TYPE_PRIORITY) -> Column:
    """First label of the priority list a node carries, else its first label."""
    order = F.array(*[F.lit(p) for p in priority])
    found = F.filter(order, lambda p: F.array_contains(labels, p))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.try_element_at(labels, F.lit(1)),
                      F.lit("Entity"))


def nonempty_types(nodes: DataFrame, domain: Sequence[str]) -> DataFrame:
    return nodes.where(F.col("node_type").isin(list(domain))).groupBy("node_type").agg(
        F.count(F.lit(1)).alias("n_nodes"))


def allowed_edges(edges: DataFrame, nodes: DataFrame,
                  allowed: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Edges of an allow-listed type whose endpoint types have nodes."""
    kept = edges.where(edge_key().isin(["__".join(t) for t in allowed]))
    types = nodes.select("node_type").distinct()
    kept = kept.join(types.withColumnRenamed("node_type", "src_type"), "src_type", "left_semi")
    return kept.join(types.withColumnRenamed("node_type", "dst_type"), "dst_type", "left_semi")


def display_name(name: Column, node_type: Column, idx: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat_ws("_", node_type, idx.cast("string")))


def dense_ids(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """Adds ``local_idx`` per type and ``global_id`` across types in type order."""
    local = dense_number(nodes, ["node_type"], [F.col(order)], "local_idx")
    sizes = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("node_type").rowsBetween(Window.unboundedPreceding, -1)
    # One row per node type: a short, closed list.
    offsets = sizes.select("node_type", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offsets), "node_type").withColumn(
        "global_id", F.col("local_idx") + F.col("_off")).drop("_off")


def relation_ids(edges: DataFrame) -> DataFrame:
    """Edge types with their position in sorted order (one row per edge type)."""
    types = edges.select(*EDGE_TYPE).distinct().withColumn("relation", edge_key())
    order = Window.orderBy("relation")
    return types.withColumn("relation_id", (F.row_number().over(order) - 1).cast("bigint"))


def reindex_edges(edges: DataFrame, ids: DataFrame, id_col: str = "local_idx",
                  on_dangling: str = "drop_relation") -> DataFrame:
    """Replaces endpoint node ids by ``ids(node_type, node_id, <id_col>)``.

    ``drop_relation`` discards a whole edge type if any endpoint is unknown,
    ``drop_edge`` only the edges concerned.
    """
    def side(end: str) -> DataFrame:
        return ids.select(F.col("node_type").alias(f"{end}_type"), F.col("node_id").alias(end),
                          F.col(id_col).alias(f"{end}_idx"))

    if on_dangling == "drop_relation":
        # Ends are few beside edges: those without a node are found once a type and end.
        known = ids.select("node_type", F.col("node_id").alias("end"))
        ends = edges.select(*EDGE_TYPE, F.explode(F.array(
            F.struct(F.col("src_type").alias("node_type"), F.col("src").alias("end")),
            F.struct(F.col("dst_type").alias("node_type"), F.col("dst").alias("end")))).alias("e")).select(*EDGE_TYPE, "e.*").distinct()
        broken = ends.join(known, ["node_type", "end"], "left_anti").select(*EDGE_TYPE).distinct()
        # One row per edge type at most.
        edges = edges.join(F.broadcast(broken), EDGE_TYPE, "left_anti")
    mapped = spread_join(edges, side("src"), ["src_type", "src"])
    return spread_join(mapped, side("dst"), ["dst_type", "dst"]).select(*edges.columns, "src_idx", "dst_idx")


def discover_edge_types(raw: DataFrame, typed_nodes: DataFrame) -> DataFrame:
    """Edge types present among untyped ``raw(src, rel, dst)`` edges, with counts."""
    def side(end: str) -> DataFrame:
        return typed_nodes.select(F.col("node_id").alias(end), F.col("node_type").alias(f"{end}_type"))

    typed = spread_join(raw.select("src", "rel", "dst"), side("src"), ["src"])
    typed = spread_join(typed, side("dst"), ["dst"])
    return typed.groupBy(*EDGE_TYPE).agg(F.count(F.lit(1)).alias("n_edges"))


def type_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes"))


def category_stats(edges: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Edge types and edges per relation category (a short configured map)."""
    per_type = edges.groupBy(*EDGE_TYPE).agg(F.count(F.lit(1)).alias("n"))
    lookup = F.create_map(*[F.lit(x) for kv in sorted(categories.items()) for x in kv])
    return per_type.withColumn("category", F.coalesce(lookup[F.col("rel")], F.lit("Other"))).groupBy(
        "category").agg(F.count_distinct(edge_key()).alias("n_relations"), F.sum("n").alias("n_edges"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge as two rows, one per end, in a single pass over the edges."""
    ends = F.array(
        F.struct(F.col("src_type").alias("node_type"), F.col("src").alias("idx"), F.lit("out").alias("side")),
        F.struct(F.col("dst_type").alias("node_type"), F.col("dst").alias("idx"), F.lit("in").alias("side")))
    return edges.select(F.explode(ends).alias("e"), "rel").select("e.*", "rel")


def degrees(edges: DataFrame) -> DataFrame:
    """Out, in and total degree of every node that has an edge."""
    return endpoints(edges).groupBy("node_type", "idx").agg(
        F.count(F.when(F.col("side") == "out", 1)).alias("out_degree"),
        F.count(F.when(F.col("side") == "in", 1)).alias("in_degree"),
        F.count(F.lit(1)).alias("degree"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees with zeros for isolated nodes."""
    return nodes.select("node_type", "idx").join(degrees(edges), ["node_type", "idx"], "left").fillna(0)


def name_lookup(nodes: DataFrame, terms: Sequence[str], term_col: str = "anchor") -> DataFrame:
    """First node (by type, then idx) whose name contains each term, ignoring case."""
    hits = nodes.select(
        "node_type", "idx", F.lower("name").alias("_low"),
        F.explode(F.array(*[F.lit(t) for t in terms])).alias(term_col)).where(
        F.contains(F.col("_low"), F.lower(F.col(term_col))))
    return hits.groupBy(term_col).agg(F.min(F.struct("node_type", "idx")).alias("_n")).select(
        term_col, "_n.node_type", "_n.idx")


def anchor_check(nodes: DataFrame, edges: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """Degree and status of each named anchor."""
    wanted = nodes.sparkSession.createDataFrame([(a,) for a in anchors], "anchor string")
    found = name_lookup(nodes, anchors)
    deg = degrees(edges).select("node_type", "idx", "degree")
    return wanted.join(found, "anchor", "left").join(deg, ["node_type", "idx"], "left").select(
        "anchor", "node_type", "idx", F.coalesce("degree", F.lit(0)).alias("degree"),
        F.when(F.col("idx").isNull(), "NOT FOUND")
        .when(F.coalesce("degree", F.lit(0)) > 0, "CONNECTED").otherwise("ISOLATED").alias("status"))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges plus their reversals, named ``rev_<rel>``, in one pass."""
    forward = F.struct("src_type", "rel", "dst_type", "src", "dst")
    back = F.struct(F.col("dst_type").alias("src_type"), F.concat(F.lit("rev_"), F.col("rel")).alias("rel"),
                    F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.explode(F.array(forward, back)).alias("e")).select("e.*")


def first_occurrence(edges: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest row per key; a partial minimum instead of a window."""
    rest = [c for c in edges.columns if c not in keys and c not in order]
    return edges.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])


def temperatures(edges: DataFrame, table: Sequence[tuple[str, float]] = constants.TEMPERATURES) -> DataFrame:
    """Temperature per edge type; the last matching row of the table wins."""
    last = dict(table)
    lookup = F.create_map(*[F.lit(x) for kv in sorted(last.items()) for x in kv])
    return edges.select(*EDGE_TYPE).distinct().withColumn(
        "tau", F.coalesce(F.try_element_at(lookup, F.col("rel")), F.lit(1.0)))


def hub_flags(nodes: DataFrame, edges: DataFrame, threshold: int = constants.HUB_DEGREE,
              names: Sequence[str] = constants.HUB_NAMES) -> DataFrame:
    deg = degrees(edges).select("node_type", "idx", "degree")
    return nodes.join(deg, ["node_type", "idx"], "left").select(
        "node_type", "idx", "name", F.coalesce("degree", F.lit(0)).alias("degree"),
        ((F.coalesce("degree", F.lit(0)) >= threshold) | F.col("name").isin(list(names))).alias("is_hub"))


#: Pairs that one middle node may make in a task, and rows of a block of a heavier one's ends.
HEAVY_PAIRS, HEAVY_SIDE = 1 << 24, 1 << 12


def sparse_product(left: DataFrame, right: DataFrame, heavy: int = HEAVY_PAIRS, side: int = HEAVY_SIDE) -> DataFrame:
    """``(a, c, n)``: the product of ``left(a, b, n)`` and ``right(b, c, m)`` over ``b``.

    A middle node that would make more than ``heavy`` pairs has both its sides cut into blocks
    of about ``side`` rows; a block of one side meets each block of the other in a cell of its own. So
    a hub's outer product is many bounded tasks; other nodes are joined as they are.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    sizes = left.groupBy("b").agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy("b").agg(F.count(F.lit(1)).alias("_r")), "b")
    hubs = small_side(sizes.where(F.col("_l").cast("double") * F.col("_r") > heavy).select(
        "b", F.ceil(F.col("_l") / side).cast("int").alias("_rows"), F.ceil(F.col("_r") / side).cast("int").alias("_cols")))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = rows.join(hubs, "b", "left")
        place = F.coalesce(F.pmod(F.xxhash64(key), F.col(f"_{own}s")).cast("int"), F.lit(0))
        return met.withColumn(f"_{own}", place).withColumn(
            f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_{other}s"), F.lit(1)) - 1))).drop("_rows", "_cols")

    cells = dealt(left, "a", "row", "col").join(dealt(right, "c", "col", "row"), ["b", "_row", "_col"])
    return cells.groupBy("a", "c").agg(F.sum(F.col("n") * F.col("m")).alias("n"))


def meta_path(edges: DataFrame, hops: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Number of paths along a sequence of edge types, per end pair.

    Counts are merged after every hop, so parallel paths never multiply rows.
    """
    def hop(triple):
        src_type, rel, dst_type = triple
        back = rel.startswith("rev_")
        a, b = ("dst", "src") if back else ("src", "dst")
        base = edges.where((F.col(f"{a}_type") == src_type) & (F.col("rel") == rel.removeprefix("rev_"))
                           & (F.col(f"{b}_type") == dst_type))
        return base.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))

    paths = hop(hops[0])
    for triple in hops[1:]:
        step = hop(triple).select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"))
        paths = sparse_product(paths, step).withColumnRenamed("c", "b")
    return paths.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("n_paths"))
