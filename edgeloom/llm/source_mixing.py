"""A corpus mixed from its sources to target weights, as shards of equal blocks of words.

Method, on column functions alone. The words of a source, its documents in order of
id, are packed into blocks of a fixed length; the last one is shorter. A source's
target tells how many blocks it gives. Every slot of every output shard draws a
source with probability in proportion to those numbers, so a shard's counts by source
are multinomial. A source's draws are numbered through all shards. Draws beyond its
number give their slots back, and sources drawn too seldom take these in a pseudorandom
order, so the totals are exact; about the square root of all slots change hands. A
source's slots go through its blocks in a pseudorandom permutation, a new one for every
pass, and blocks are joined to slots by source and index. The last slot of a source takes
as many words as are missing to its target.

Targets. Sources in code point order, null last, have the weights 3, 1, 2 in turn and share
one and a half times all words. No target goes beyond twice its source's size; what is over
goes to the others by weight until none is above.

Bounds. Running numbers are made over range slices, so a source of any share spreads over
tasks. Source tables are broadcast after a count only. The driver sees sums of the source
table. The permutation is a swap-or-not shuffle: a bijection of any 0 .. n - 1, keyed by hashes.

Defined results. A null text has no words; texts without words are taken 0 times. Sources
without words have target 0. Repeated rows are documents of their own; equal rows may swap
results. An empty table gives an empty result. Other columns are not read. Reruns agree.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.columns import bounded_broadcast
from edgeloom.operators.ordering import dense_number, running_totals
from edgeloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK_WORDS, SHARD_SLOTS = 512, 256
ROUNDS = 24
CELLS = 4096


def permuted(x: Column, n: Column, *keys: Column) -> Column:
    """The image of ``x`` under a pseudorandom permutation of ``0 .. n - 1``, by swap-or-not rounds."""
    n = F.greatest(n, F.lit(1)).cast("bigint")

    def swap(v: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - v, n)
        return F.when(F.xxhash64(*keys, -r, F.greatest(v, partner)) % 2 == 0, v).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("bigint"), swap)


def source_targets(rows: DataFrame, share: Fraction = Fraction(3, 2), limit: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_no, source_size, target, quota)`` from ``rows(source, size)``; ``quota`` is the target in whole words."""
    sizes = dense_number(cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), [], [F.col("source").asc_nulls_last()], "source_no")
    sizes = cut_lineage(sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int"))))
    kinds = sorted(set(weights))

    def by_weight(values: list) -> Column:
        out = F.lit(values[0])
        for w, v in zip(kinds[1:], values[1:]):
            out = F.when(F.col("weight") == w, F.lit(v)).otherwise(out)
        return out

    # A source is at its limit if it is smaller than a bound that depends on its weight; bounds only rise.
    bounds, level = [0] * len(kinds), Fraction(0)
    while True:
        full = F.col("source_size") < by_weight(bounds)
        whole, used, free = sizes.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        level = (share * (whole or 0) - limit * (used or 0)) / free if free else Fraction(0)
        above = [-(-(w * level / limit).numerator // (w * level / limit).denominator) for w in kinds]
        if above == bounds or not free:
            break
        bounds = [max(a, b) for a, b in zip(above, bounds)]
    target = F.when(full, (F.col("source_size") * limit).cast("double")).otherwise(by_weight([float(w * level) for w in kinds]))
    quota = F.when(full, F.col("source_size") * limit).otherwise(by_weight([int(w * level + Fraction(1, 2)) for w in kinds]))
    return sizes.select("source", "source_no", "source_size", target.alias("target"), quota.cast("bigint").alias("quota"))


def slot_plan(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds each source's blocks a pass, its slots and their range among all slots."""
    size, quota = F.col("source_size"), F.col("quota")
    rest = F.when(size > 0, F.expr("quota % source_size")).otherwise(0)
    passes = F.when(size > 0, F.expr("quota div source_size")).otherwise(0)
    plan = targets.withColumn("blocks", F.ceil(size / block_words)).withColumn("whole_blocks", F.floor(size / block_words))
    plan = plan.withColumn("slots", (passes * F.col("blocks") + F.ceil(rest / block_words)).cast("bigint")).withColumn("last_words", (rest % block_words).cast("int"))
    plan = running_totals(plan, [], [F.col("source_no")], {"slots_upto": F.col("slots")})
    return cut_lineage(plan.withColumn("slots_from", F.col("slots_upto") - F.col("slots")))


def shard_draws(plan: DataFrame, slots: int, sources: int, shard_slots: int = SHARD_SLOTS, seed: int = 42) -> DataFrame:
    """``(shard, source_no, drawn)``: multinomial counts of every shard.

    A uniform whole number below ``slots`` falls into one source's range. Ranges are
    listed by cells of equal width, so a draw meets the few of its cell.
    """
    cells = max(CELLS, 4 * sources)
    width = -(-slots // cells)
    guide = plan.where("slots > 0").select("source_no", "slots_from", "slots_upto", F.explode(F.sequence(
        F.floor(F.col("slots_from") / width), F.floor((F.col("slots_upto") - 1) / width))).alias("cell"))
    draws = plan.sparkSession.range(slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(slots)).alias("u"))
    met = draws.withColumn("cell", F.floor(F.col("u") / width)).join(bounded_broadcast(cut_lineage(guide)), "cell").where("u >= slots_from and u < slots_upto")
    return met.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("drawn"))


def mix_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42) -> DataFrame:
    """``(shard, place, source_no, slot, block, words)``: the mix; ``place`` orders a shard, ``words`` counts from the block's start."""
    plan = slot_plan(targets, block_words)
    slots, sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    small = bounded_broadcast(plan.select("source_no", "slots", "blocks", "whole_blocks", "source_size", "last_words"))
    counts = cut_lineage(shard_draws(plan, max(slots, 1), sources, shard_slots, seed))
    runs = running_totals(counts, ["source_no"], [F.col("shard")], {"upto": F.col("drawn")}).withColumn("before", F.col("upto") - F.col("drawn"))
    runs = runs.join(small.select("source_no", "slots"), "source_no")
    runs = cut_lineage(runs.withColumn("held", F.least("drawn", F.greatest(F.col("slots") - F.col("before"), F.lit(0)))))
    held = runs.where("held > 0").select("shard", "source_no", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("held") - 1)).alias("slot"))

    freed = running_totals(runs.select("shard", "source_no", (F.col("drawn") - F.col("held")).alias("n")).where("n > 0"), [], [F.col("shard"), F.col("source_no")], {"upto": F.col("n")})
    freed = freed.select("shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("at"))
    short = plan.select("source_no", "slots").join(runs.groupBy("source_no").agg(F.sum("drawn").alias("drawn")), "source_no", "left").select(
        "source_no", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("slots") - F.coalesce("drawn", F.lit(0))).alias("n")).where("n > 0")
    short = cut_lineage(running_totals(short, [], [F.col("source_no")], {"upto": F.col("n")}))
    missing = short.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fill = short.select("source_no", "drawn", (F.col("upto") - F.col("n")).alias("first"), F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("q")).select(
        "source_no", (F.col("drawn") + F.col("q") - F.col("first")).alias("slot"), permuted(F.col("q"), F.lit(missing), F.lit(seed), F.lit("fill")).alias("at"))
    mixed = held.unionByName(fill.join(freed, "at").select("shard", "source_no", "slot"))

    rows = mixed.join(small, "source_no").withColumn("turn", F.expr("slot div blocks")).withColumn("step", F.expr("slot % blocks"))
    block = F.when(F.col("step") < F.col("whole_blocks"), permuted(F.col("step"), F.col("whole_blocks"), F.lit(seed), F.col("source_no"), F.col("turn"))).otherwise(F.col("whole_blocks"))
    rows = rows.withColumn("block", block)
    words = F.when((F.col("slot") == F.col("slots") - 1) & (F.col("last_words") > 0), F.col("last_words")).when(
        F.col("block") == F.col("whole_blocks"), F.col("source_size") % block_words).otherwise(block_words)
    return rows.select("shard", F.xxhash64(F.lit(seed), F.lit("place"), "source_no", "slot").alias("place"), "source_no", "slot", "block", words.cast("int").alias("words"))


def _sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))


def _numbered(rows: DataFrame, targets: DataFrame) -> DataFrame:
    small = bounded_broadcast(targets)
    return rows.join(small, rows["source"].eqNullSafe(small["source"])).drop(small["source"])


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """Documents cut at block borders; ``from`` and ``upto`` count within the block."""
    first, end = F.col("end") - F.col("size"), F.col("end")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(first / block_words), F.floor((end - 1) / block_words))))
    origin = F.col("block") * block_words
    return cut.withColumn("from", F.greatest(first, origin) - origin).withColumn("upto", F.least(end, origin + block_words) - origin)


def _prepared(docs: DataFrame, doc_id: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    sized = _sized(docs, doc_id, source, text)
    narrow = cut_lineage(sized.drop("text"))
    return narrow, cut_lineage(source_targets(narrow.select("source", "size")))


def _order() -> list[Column]:
    return [F.col("doc_id"), F.col("tie"), F.col("size")]


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row for every row of ``docs``: how many of its words the mix takes."""
    narrow, targets = _prepared(docs, doc_id, source, text)
    mix = mix_slots(targets, block_words, shard_slots, seed).select("source_no", "block", "words")
    rows = _numbered(narrow, targets).select("doc_id", "source_no", "tie", "size", "source_size", "target")
    placed = running_totals(rows.where("size > 0").drop("source_size", "target"), ["source_no"], _order(), {"end": F.col("size")})
    cut = _pieces(placed, block_words).select("source_no", "block", "end", "doc_id", "size", "from", "upto")
    taken = F.greatest(F.least("upto", F.coalesce("words", F.lit(0))) - F.col("from"), F.lit(0))
    found = cut.join(mix, ["source_no", "block"], "left").groupBy("source_no", "end", "doc_id", "size").agg(F.sum(taken).alias("taken"))
    found = found.join(bounded_broadcast(targets.select("source_no", "source_size", "target")), "source_no")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return found.select(*columns).unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")).select(*columns))


def mixed_texts(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(shard, place, source, n_words, text)``: the blocks of the mix as texts, words joined by blanks."""
    narrow, targets = _prepared(docs, doc_id, source, text)
    mix = mix_slots(targets, block_words, shard_slots, seed)
    rows = _numbered(_sized(docs, doc_id, source, text).where("size > 0"), targets).select("doc_id", "source_no", "tie", "size", "text")
    cut = _pieces(running_totals(rows, ["source_no"], _order(), {"end": F.col("size")}), block_words)
    listed = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = F.greatest(F.col("block") * block_words - F.col("end") + F.col("size"), F.lit(0))
    cut = cut.select("source_no", "block", "from", F.slice(listed, (first + 1).cast("int"), (F.col("upto") - F.col("from")).cast("int")).alias("words"))
    packed = cut.groupBy("source_no", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "words"))), lambda p: p["words"])).alias("listed"))
    named = bounded_broadcast(targets.select("source_no", "source"))
    return mix.join(packed, ["source_no", "block"]).join(named, "source_no").select(
        "shard", "place", "source", F.col("words").alias("n_words"), F.array_join(F.slice("listed", F.lit(1), F.col("words")), " ").alias("text"))
