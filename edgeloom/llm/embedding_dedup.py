"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Method. A unit vector u is stored as int8 steps q of size s, with the length of
what rounding lost, e = |u - s q|. For two vectors

    |u.v - s s' q.q'| <= e + e' + e e',

so the product of two int8 tiles settles every pair whose estimate lies further
than that from the threshold, and only the others are computed in double
precision from the full vectors. Integer products are exact in float32 while
``dim * 127^2 < 2^24``; longer vectors are multiplied in double.

Vectors of one label are dealt by a digest of their id to blocks of bounded size,
and pairs of blocks are tiles of one task each. A tile returns link counts and a
spanning forest of its links, never its pairs. Equal vectors collapse first.

Defined results. A vector that is null, empty, zero, has a null or non-finite
component, or a null label links with nothing: no links, its own component. So
do vectors of different lengths with each other. Ids that are null are ignored;
an id that repeats with an equal vector is one vector. Ties of the smallest id
cannot occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.columns import bounded_broadcast
from edgeloom.llm.components import components
from edgeloom.session import cut_lineage

BLOCK, STRIP = 8192, 512
#: Rounding of the bound itself and of double products.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 steps, step sizes, and lengths of the rounding errors of unit vectors."""
    step = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / step[:, None]).astype(np.int8)
    return q, step, np.sqrt(((unit - q * step[:, None]) ** 2).sum(axis=1))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of links between row numbers."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while head.setdefault(root, root) != root:
            root = head[root]
        while head[x] != root:
            head[x], x = root, head[x]
        return root

    out_a, out_b = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = find(x), find(y)
        if i != j:
            head[max(i, j)] = min(i, j)
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool):
    """Yields ``(rows, columns)`` of linked pairs, strip by strip; with ``same`` only rows below columns.

    ``left`` and ``right`` hold unit vectors in double precision.
    """
    q, s, e = quantised(left)
    r, t, f = quantised(right)
    kind = np.float32 if left.shape[1] * 127 ** 2 < 1 << 24 else np.float64
    r = r.astype(kind).T
    for at in range(0, len(left), STRIP):
        rows = slice(at, at + STRIP)
        product = q[rows].astype(kind) @ r
        # A float32 scale keeps one array of the strip; its rounding is below the slack added here.
        estimate = product * (s[rows, None] * t[None, :])
        bound = e[rows, None] + f[None, :] + e[rows, None] * f[None, :] + SLACK
        near, other = np.nonzero(estimate + bound >= threshold)
        if same:
            keep = near + at < other
            near, other = near[keep], other[keep]
        sure = estimate[near, other] - bound[near, other] >= threshold
        for part in range(0, len(near), 1 << 16):
            i, j, known = near[part:part + (1 << 16)], other[part:part + (1 << 16)], sure[part:part + (1 << 16)]
            exact = np.einsum("ij,ij->i", left[i + at], right[j])
            linked = known | (exact >= threshold)
            yield i[linked] + at, j[linked]


def _tile(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    row, col = key[2].as_py(), key[3].as_py()
    ids, block, copies = (table[c].to_numpy() for c in ("rep", "block", "copies"))
    flat = table["vector"].combine_chunks().flatten().to_numpy().astype(np.float64)
    vectors = flat.reshape(len(ids), -1)
    # Dividing by the largest component first keeps squares in range.
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    left = np.flatnonzero(block == row)
    right = left if row == col else np.flatnonzero(block == col)
    links = np.zeros(len(ids), np.int64)
    out_a, out_b = [], []
    if len(left) and len(right):
        for i, j in tile_links(vectors[left], vectors[right], threshold, row == col):
            a, b = left[i], right[j]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            x, y = _forest(a, b)
            out_a += x
            out_b += y
    out_a, out_b = _forest(np.array(out_a, np.int64), np.array(out_b, np.int64))
    met = np.flatnonzero(links)
    a, b = ids[out_a] if out_a else ids[:0], ids[out_b] if out_b else ids[:0]
    return pa.table({
        "rep": pa.array(np.concatenate([ids[met], a]), pa.int64()),
        "links": pa.array(np.concatenate([links[met], np.zeros(len(a), np.int64)]), pa.int64()),
        "other": pa.array(np.concatenate([ids[met], b]), pa.int64())})


def vector_links(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row for every vector.

    Vectors of one label are linked at cosine ``threshold`` or more.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector"), F.col(label).alias("label")).where("vec_id is not null")
    # exists() is null if a comparison is, so every test is made to give a plain truth value.
    sound = F.coalesce(
        (F.size("vector") > 0) & F.col("label").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: F.coalesce(x, F.lit(0.0)) != 0), F.lit(False))
    sound_rows = rows.where(sound)
    # Adding zero makes -0.0 and 0.0 one value.
    plain = sound_rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("tinyint")))
    ided = plain.select("vec_id", "label", "vector", F.size("vector").alias("dim"))
    reps = cut_lineage(ided.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")))
    copies = cut_lineage(ided.join(reps.where("copies > 1").select("label", "dim", "vector", "rep"), ["label", "dim", "vector"]).where(
        "vec_id != rep").select("vec_id", "rep").distinct())

    sizes = bounded_broadcast(cut_lineage(reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))))
    placed = reps.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = placed.select("label", "dim", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "rep", "copies", "vector")
    found = cut_lineage(tiled.groupBy("label", "dim", "row", "col").applyInArrow(
        lambda key, table: _tile(key, table, threshold), "rep bigint, links bigint, other bigint"))

    counts = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("links = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")).unionByName(
        copies.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    groups = components(edges)
    member = ided.select("vec_id").distinct().join(copies, "vec_id", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"))
    extra = reps.select("rep", (F.col("copies") - 1).alias("extra"))
    linked = member.join(counts, "rep", "left").join(extra, "rep", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n_links"))
    return rows.select("vec_id").distinct().join(linked, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))
