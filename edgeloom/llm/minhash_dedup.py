"""Near-duplicate documents by SuperMinHash, banding, verification and components.

Method. Every element of a set draws, rank by rank, a slot of a random
permutation and a fraction; slot values are the smallest ``rank + fraction``.
Ranks of one element are correlated, which lowers the variance, and a text
stops as soon as no slot can change any more. Bands of the signature bring
candidates together and full sets confirm them.

Groups of copies. Texts with equal sets collapse to one representative first.
Within a band's bucket every member is confirmed against the bucket's smallest
member, which costs one comparison a member; a bucket of near copies is thus
joined without comparing all its pairs. Only buckets that still hold members of
different components have their remaining pairs compared, in square tiles of
bounded size, by signatures first and by full sets where those agree enough; a
tile returns the links that join its components, never all its pairs.

Defined results. Null, empty and blank texts have empty sets and link with
nothing. Rows with a null id are ignored; repeated rows of one id count once if
their texts are equal, and otherwise the id belongs with all of its texts. Columns besides id and text are not
read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytestrings import MASK, mix, text_bytes
from edgeloom.llm.columns import bounded_broadcast, chunks
from edgeloom.llm.components import components
from edgeloom.llm.shingles import shingle_sets
from edgeloom.session import cut_lineage, parallelism

SLOTS, BAND_ROWS = 150, 5
#: A pair at similarity 0.8 agrees in 120 of 150 slots, standard deviation under 5.
AGREE = 96
#: Most members of a tile's side, and most shingles of their sets together.
TILE, TILE_SHINGLES = 1024, 1_500_000
#: Bytes of text handled at a time; an element still open takes ``SLOTS`` bytes.
CHUNK = 1 << 20
GOLDEN = 0x9E3779B97F4A7C15
SIGNATURE = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                       ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNATURE_DDL = "doc bigint, n bigint, set_a bigint, set_b bigint, sig binary, bands array<bigint>"


def super_min_hash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signature of every set: ``(rank << 32) + fraction`` per slot, all ones for an empty set."""
    n = len(offsets) - 1
    out = np.full(n * slots, MASK, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    order, values = None, elements
    for rank in range(slots):
        if not len(values):
            break
        drawn = mix(values + np.uint64((GOLDEN * (rank + 1)) & MASK))
        slot = rank + ((drawn >> np.uint64(32)) % np.uint64(slots - rank)).astype(np.int64)
        if order is not None:
            rows = np.arange(len(values))
            taken = order[rows, slot]
            order[rows, slot] = order[:, rank]
            order[:, rank] = taken
            place = taken.astype(np.int64)
        else:
            place = slot
        np.minimum.at(out, owner * slots + place, (drawn & np.uint64(0xFFFFFFFF)) + np.uint64(rank << 32))
        # A later rank is at least rank + 1, so a text whose slots are all below it is final.
        open_texts = out.reshape(n, slots).max(axis=1) >= np.uint64((rank + 1) << 32)
        keep = open_texts[owner]
        if rank == 0:
            values, owner, slot = values[keep], owner[keep], slot[keep]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
            order[np.arange(len(values)), slot] = 0
            order[:, 0] = slot
        elif not keep.all():
            values, owner, order = values[keep], owner[keep], order[keep]
    return out.reshape(n, slots)


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    coefficients = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
    for part in chunks(batches, "text", CHUNK):
        data, offsets = text_bytes(part["text"])
        sets, at = shingle_sets(data, offsets, k)
        sizes = np.diff(at)
        totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)))]) for salt in (1, 2)]
        digests = [(t[at[1:]] - t[at[:-1]]).view(np.int64) for t in totals]
        signature = super_min_hash(sets, at)
        bands = mix((signature * coefficients).reshape(len(sizes), -1, BAND_ROWS).sum(axis=2, dtype=np.uint64))
        short = mix(signature).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([
            part["doc"].combine_chunks().cast(pa.int64()), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]),
            pa.array([row.tobytes() for row in short], pa.binary()),
            pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))], schema=SIGNATURE)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``docs(doc, text)`` to set size, set digest, short signature and band keys."""
    return docs.mapInArrow(lambda batches: _signed(batches, k), SIGNATURE_DDL)


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity.

    Members ``a`` travel to a task of their ``b``, whose set is built once there. A
    ``b`` with many members is cut into lots of 256.
    """
    lots = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("lots"))
    member = pairs.join(lots, "b").select(F.col("a").alias("need"), F.col("b").alias("head"), F.pmod(F.xxhash64("a"), F.col("lots")).cast("int").alias("lot"), F.lit(1).alias("kind"))
    head = lots.select(F.col("b").alias("need"), F.col("b").alias("head"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("kind"))
    wanted = bounded_broadcast(cut_lineage(member.unionByName(head)))
    wanted = docs.select(F.col("doc").alias("need"), "text").join(wanted, "need")
    dealt = wanted.repartition(parallelism(docs.sparkSession), "head", "lot").sortWithinPartitions("head", "lot", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, None
        for part in chunks(batches, "text", CHUNK):
            data, offsets = text_bytes(part["text"])
            sets, at = shingle_sets(data, offsets, k)
            heads, lots_, kinds, ids = (part[c].to_numpy() for c in ("head", "lot", "kind", "need"))
            a, b = [], []
            for i in range(len(ids)):
                mine = sets[at[i]:at[i + 1]]
                if kinds[i] == 0:
                    current, own = (heads[i], lots_[i]), mine
                    continue
                if current != (heads[i], lots_[i]) or 100 * min(len(mine), len(own)) < percent * max(len(mine), len(own)):
                    continue
                both = np.concatenate([mine, own])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    a.append(ids[i])
                    b.append(heads[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(check, "a bigint, b bigint")


class _Tile:
    """A square of a bucket: its members, and which pairs are worth a comparison."""

    def __init__(self, key: tuple, table: pa.Table, percent: int):
        self.band, self.percent = key[0].as_py(), percent
        row, col = key[2].as_py(), key[3].as_py()
        self.ids, self.comp, self.size, block = (table[c].to_numpy() for c in ("doc", "comp", "n", "block"))
        self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(self.ids), SLOTS)
        self.bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        rows, cols = np.flatnonzero(block == row), np.flatnonzero(block == col)
        if row == col:
            cols = rows
        names, counts = np.unique(self.comp, return_counts=True)
        main = names[counts.argmax()] if len(names) else 0  # its members need no comparison with each other
        self.sides = ((rows[self.comp[rows] != main], cols), (cols[self.comp[cols] != main], rows[self.comp[rows] == main]))

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """A member and those of other components, closest first, that may reach the similarity.

        A pair is left to the first band in which it shares a bucket.
        """
        for left, right in self.sides:
            for i in left:
                low, high = np.minimum(self.size[right], self.size[i]), np.maximum(self.size[right], self.size[i])
                near = right[(self.comp[right] != self.comp[i]) & (100 * low >= self.percent * high)]
                agree = (self.sig[near] == self.sig[i]).sum(axis=1)
                near, agree = near[agree >= AGREE], agree[agree >= AGREE]
                first = ~(self.bands[near, :self.band] == self.bands[i, :self.band]).any(axis=1)
                near, agree = near[first], agree[first]
                if len(near):
                    yield int(i), near[np.argsort(-agree, kind="stable")]


def _with_candidates(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Members of the tile that have a candidate in it."""
    tile = _Tile(key, table, percent)
    hit = np.zeros(len(tile.ids), bool)
    for i, near in tile.candidates():
        hit[i] = True
        hit[near] = True
    return table.filter(pa.array(hit))


def _joined(key: tuple, table: pa.Table, percent: int, k: int) -> pa.Table:
    """Confirmed links that join components within the tile, at most one less than its members."""
    tile = _Tile(key, table, percent)
    sets: list[np.ndarray] = []
    for part in chunks(table.select(["text"]).to_batches(), "text", CHUNK, tidy=False):
        values, at = shingle_sets(*text_bytes(part["text"]), k)
        sets += [values[at[i]:at[i + 1]] for i in range(len(at) - 1)]
    head = {c: c for c in tile.comp.tolist()}

    def find(c: int) -> int:
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    a, b = [], []
    for i, near in tile.candidates():
        for j in near.tolist():
            x, y = find(int(tile.comp[i])), find(int(tile.comp[j]))
            if x == y:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                head[max(x, y)] = min(x, y)
                a.append(tile.ids[i])
                b.append(tile.ids[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def remaining_links(buckets: DataFrame, signed: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join components within ``buckets(band, key, doc, comp)``.

    Tiles first find their members with a candidate by signature; only those get
    their texts, and pairs are confirmed on full sets unless joined already.
    """
    buckets = buckets.join(signed.select("doc", "n"), "doc")
    sizes = buckets.groupBy("band", "key").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").drop("lo", "hi")
    placed = cut_lineage(buckets.drop("n").join(sizes, ["band", "key"])).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "key", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "doc", "comp")
    facts = signed.select("doc", "n", "sig", "bands")
    full = tiled.join(facts, "doc").select("band", "key", "row", "col", "block", "doc", "comp", "n", "sig", "bands")
    square = ["band", "key", "row", "col"]
    worth = full.groupBy(*square).applyInArrow(lambda key, table: _with_candidates(key, table, percent), full.schema)
    worth = bounded_broadcast(cut_lineage(worth.drop("sig", "bands")))
    with_text = docs.select("doc", "text").join(worth, "doc").join(facts.drop("n"), "doc").select(*full.columns, "text")
    return with_text.groupBy(*square).applyInArrow(lambda key, table: _joined(key, table, percent, k), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row for every document.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` over their sets of
    ``k``-word shingles; the component is the smallest id reachable by links.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    signed = cut_lineage(signatures(docs, k))
    groups = cut_lineage(signed.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")))
    members = signed.where("n > 0").select("doc", "set_a", "set_b").join(groups.where("rep != last"), ["set_a", "set_b"]).where(
        "doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))

    # Buckets with two representatives or more, each with its smallest member.
    banded = signed.where("n > 0").select("doc", "bands").join(groups.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").select(
        "doc", F.posexplode("bands").alias("band", "key"))
    heads = banded.groupBy("band", "key").agg(F.min("doc").alias("b"), F.max("doc").alias("last")).where("b != last").drop("last")
    shared = cut_lineage(banded.join(heads, ["band", "key"]))
    stars = cut_lineage(shared.where("doc != b").select(F.col("doc").alias("a"), "b").distinct())
    linked = cut_lineage(confirmed(stars, docs, k, percent).unionByName(members))
    first = components(linked)

    # Buckets whose members are still apart after the stars.
    left = shared.select("band", "key", "doc").join(first.withColumnRenamed("node", "doc"), "doc", "left").select(
        "band", "key", "doc", F.coalesce("component", "doc").alias("comp"))
    late = cut_lineage(remaining_links(cut_lineage(left), signed, docs, k, percent))
    final = components(linked.unionByName(late))
    result = signed.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return result.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; null ids stay."""
    groups = near_duplicates(docs, k, percent, doc_id, text)
    gone = groups.where("not kept").select(F.col("doc_id").alias(doc_id))
    return docs.join(bounded_broadcast(cut_lineage(gone)), doc_id, "left_anti").select(*docs.columns)
