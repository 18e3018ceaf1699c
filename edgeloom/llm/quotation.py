"""Conversations in reply order without quotes, by linking quoted passages to their originals.

Method, on column functions alone. Leading ``>`` marks give the quote level of a
line. Neighbouring quoted lines of one level form a passage, and neighbouring lines of a
message's own text a paragraph. Both are taken apart alike: the whole of it, each of its
sentences and each of its lines are units. Units are normalised and hashed, and each quoted one is
joined to the latest earlier message of its conversation with an own unit of that hash. So a
passage is found again when it was wrapped anew, and so is a sentence of a longer paragraph. The
message that holds most of the words of linked units at the smallest quote level that the message
has, the latest of equals, is the one replied to. A thread is the message that a chain of
replies begins with, found by doubling jumps. Messages in order of thread and turn are in
reply order: an answer follows what it answers.

Units are compared lower-cased, with every run of other characters than letters
and digits as one blank. A message's body is its lines without quoted ones and
without the lines that introduce a quote. The latest original is found by one pass in turn order over the units of
one hash in one conversation, so a phrase that many messages quote costs rows,
not pairs; only hashes that are quoted take part.

Defined results. Null text counts as empty. A message without a linked quote
replies to nothing and begins a thread. Rows of one (conversation, turn) count as
one message in linking, and each row has its own result. Rows with a null conversation or turn
are not linked. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.ordering import dense_number
from edgeloom.session import cut_lineage

QUOTED = r"^[\x20\t]*>"
MARKS = r"^(?:[\x20\t]*>)+"
#: Lines that introduce a quote, fixed forms.
INTRODUCTION = r"^(On .+ wrote:|Am .+ schrieb.*:|Le .+ a écrit ?:|El .+ escribió:)[\x20\t]*$"


#: Blank lines between paragraphs, and what ends a sentence.
BLANK, SENTENCE = r"\n(?:[\x20\t\r]*\n)+", r"[.!?。！？]+(?:[\x20\t\r]+|$)"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _units(block: Column) -> Column:
    """Normalised paragraphs, sentences and lines of a block, each once."""
    def apart(part: Column) -> Column:
        flat = F.replace(part, F.lit("\n"), F.lit(" "))
        return F.concat(F.array(flat), F.split(flat, SENTENCE), F.split(part, "\n"))

    parts = F.flatten(F.transform(F.split(block, BLANK), apart))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))), lambda x: x != ""))


def _at_level(lines: Column, level: Column) -> Column:
    """The lines of one quote level without their marks; other lines are blank, so they part passages."""
    return F.array_join(F.transform(lines, lambda line: F.when(_level(line) == level, F.regexp_replace(line, MARKS, "")).otherwise("")), "\n")


def link_quotes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, thread, reply_to, n_quoted, n_linked, quote_levels, body)``, one row a message row."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed = rows.where("conv_id is not null and turn is not null")
    marked = placed.where(F.coalesce(F.col("text").rlike(r"(^|\n)[\x20\t]*>"), F.lit(False)))
    marked = marked.select("conv_id", "turn", _lines(F.col("text")).alias("lines"))
    levels = cut_lineage(marked.select("conv_id", "turn", F.size(F.filter("lines", lambda x: x.rlike(QUOTED))).alias("n"), F.transform("lines", _level).alias("levels"), "lines"))
    spoken = levels.select("conv_id", "turn", "lines", F.explode(F.filter(F.array_distinct("levels"), lambda x: x > 0)).alias("level"))
    units = spoken.select("conv_id", "turn", "level", F.explode(_units(_at_level(F.col("lines"), F.col("level")))).alias("unit"))
    quoted = cut_lineage(units.groupBy("conv_id", "turn", "level", F.xxhash64("unit").alias("hash")).agg(F.max(F.size(F.split("unit", " "))).cast("bigint").alias("n")))
    asked = quoted.select("conv_id", "hash").distinct()
    # Only conversations that quote are searched, and of them only units of a quoted hash stay.
    own = placed.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select(
        "conv_id", "turn", F.explode(_units(_at_level(_lines(F.col("text")), F.lit(0)))).alias("unit")).select(
        "conv_id", "turn", F.xxhash64("unit").alias("hash")).distinct().join(asked, ["conv_id", "hash"], "left_semi")
    both = own.select("conv_id", "turn", "hash", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("bigint").alias("n")).unionByName(
        quoted.select("conv_id", "turn", "hash", F.lit(None).cast("bigint").alias("source"), "level", "n"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = cut_lineage(both.withColumn("origin", F.max("source").over(earlier)).where("level is not null and origin is not null"))

    counts = levels.groupBy("conv_id", "turn").agg(
        F.sum("n").alias("n_quoted"), F.max(F.array_max("levels")).alias("quote_levels"), F.min(F.array_min(F.filter("levels", lambda x: x > 0))).alias("level"))
    votes = found.join(counts.select("conv_id", "turn", "level"), ["conv_id", "turn", "level"], "left_semi").groupBy("conv_id", "turn", "origin").agg(F.sum("n").alias("words"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("words", "origin")).alias("best")).select("conv_id", "turn", F.col("best.origin").alias("reply_to"))
    parents = cut_lineage(parents)
    threads = _threads(parents)
    linked = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    kept = F.filter(_lines(F.col("text")), lambda line: ~line.rlike(QUOTED) & ~line.rlike(INTRODUCTION))
    body = F.when(F.coalesce(F.col("n_quoted"), F.lit(0)) > 0, F.array_join(kept, "\n")).otherwise(F.coalesce("text", F.lit("")))
    key = ["conv_id", "turn"]
    return rows.join(counts.drop("level"), key, "left").join(linked, key, "left").join(parents, key, "left").join(threads, key, "left").select(
        "conv_id", "turn", "role", F.coalesce("thread", "turn").alias("thread"), "reply_to",
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("quote_levels", F.lit(0)).alias("quote_levels"), body.alias("body"))


def _threads(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread)`` of every message with a parent; jumps double until none moves."""
    jumps = parents.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        onward = jumps.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"))
        moved = cut_lineage(jumps.join(onward, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")))
        jumps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return jumps


def reply_ordered(linked: DataFrame) -> DataFrame:
    """The messages with their place in their conversation's reply order, from 1: threads by first message, messages by turn.

    Numbers are made over range slices, so a conversation of any length spreads over tasks. Rows
    of one turn come in order of role and body.
    """
    placed = linked.where("conv_id is not null and turn is not null")
    order = [F.col("thread"), F.col("turn"), F.col("role"), F.col("body")]
    return dense_number(placed, ["conv_id"], order, "place", 1)


def formatted(linked: DataFrame) -> DataFrame:
    """Adds the message in chat form; ordering by conversation, thread and turn reads as a chat."""
    return linked.withColumn("message", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.trim("body"), F.lit("\n<|end|>")))
