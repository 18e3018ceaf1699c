"""Personal data by fixed patterns and bootstrapped contextual extraction, on column functions alone.

Method. Emails, network addresses, card and phone numbers are found by fixed
patterns with checks. They, and values of the shape of a secret, are the seeds.
Instances are the seeds and every other run of identifier characters with a digit.
The two and the three words before an instance, and those after it, are lexical
patterns, as is the key with its delimiter of every ``key = value`` or
``key: value``; each occurrence is an edge between a pattern and an instance. In
each round a pattern scores the mean confidence of its different instances and an
instance the best score of its patterns; a pattern with enough trusted instances
and a score over ``CONFIDENT`` makes its identifier-like instances trusted. When a
round adds no pattern and leaves the mean score as it was to four decimals, the
identifier-like instances of confident patterns are spans of kind ``id``.

Words are runs of letters, digits and ``_``, lower-cased. A context ends at the ends
of the text and at the next match of the same kind, and that end, written ``^`` or
``$``, counts as a word; a context needs one other. Identifier runs are taken
without the dots and hyphens around them, and not where they overlap a fixed match.

Offsets count code points, ends exclusive. The fixed patterns are written with
possessive repeats and ``\\G``, which match the same spans as the plain forms but
never backtrack over a long run, so a very long text cannot overflow or stall.

Defined results. A null text counts as empty and has no spans. Every row gets its
own result, repeated rows the same one, since spans depend on the text alone. An
``id`` span never overlaps a fixed one nor lies in another. An empty table gives an empty result.
Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.columns import bounded_broadcast
from edgeloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A key, a delimiter and a value, fixed shapes of the bootstrapping: the whole identifier and the whole run of value characters.
PAIR = r"(?<![\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]*+)(\x20{0,2}[=:#]\x20{0,2}[\"']?)([^\s\"'<>]{6,}+)"
SECRET = r"^(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+$"
#: May end in the padding of base 64.
IDENTIFIER = r"^(?=[^0-9]*+[0-9])[A-Za-z0-9@._+/-]{6,}+={0,2}$"
#: Runs of identifier characters with a digit; each run is tried once.
TOKEN = r"(?<![A-Za-z0-9@._+/-])(?=[A-Za-z@._+/-]*+[0-9])[A-Za-z0-9@._+/-]{6,}+"
CONFIDENT, SUPPORT = 0.5, 3
#: Steps of a value's trust between 0 and 1.
TRUST_STEPS = 1000
SPAN = "array<struct<start:int,end:int,value:string,patterns:array<string>>>"
OCCURRENCE = "array<struct<pattern:string,start:int,end:int,value:string>>"


def _contexts(before: Column, after: Column) -> Column:
    """Patterns of the two and three words next to a match, from the texts before and after it."""
    words = lambda text: F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))
    both = F.array(F.struct(F.trim(F.concat(F.lit("^ "), F.trim(words(before)))).alias("before"), F.trim(F.concat(F.trim(words(after)), F.lit(" $"))).alias("after")))
    made = F.get(F.transform(both, lambda x: F.array(
        *[F.concat(F.lit("< "), F.substring_index(x["before"], " ", -n)) for n in (2, 3)],
        *[F.concat(F.substring_index(x["after"], " ", n), F.lit(" >")) for n in (2, 3)])), 0)
    return F.array_distinct(F.filter(made, lambda x: x.rlike(r"[\p{L}\p{N}_]")))


def _matches(text: Column, pattern: str, contexts: bool = True) -> Column:
    """Matches with their offsets, from the lengths of the matches and of what lies between them, and their contexts."""
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(
        (F.length(gap) + F.length(value)).alias("step"), F.length(value).alias("size"), value.alias("value"), gap.alias("gap")))
    none = F.array().cast("array<string>")
    # The last gap has no match; it is not looked at.
    parts = F.filter(F.zip_with(parts, F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(0))), lambda x, after: F.when(x["value"].isNotNull(), F.struct(
        x["step"].alias("step"), x["size"].alias("size"), x["value"].alias("value"),
        (_contexts(x["gap"], after) if contexts else none).alias("patterns")))), lambda x: x.isNotNull())
    ends = F.aggregate(F.transform(parts, lambda x: x["step"]), F.array().cast("array<int>"), lambda acc, step: F.concat(
        acc, F.array(step + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))
    return F.zip_with(parts, ends, lambda x, end: F.struct(
        (end - x["size"]).alias("start"), end.alias("end"), x["value"].alias("value"), x["patterns"].alias("patterns")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).when(
        i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


_CHECKS = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: F.forall(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False))),
    "card": lambda value: F.length(_digits(value)).between(12, 19) & _luhn(_digits(value)),
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
}
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def base_spans(text: Column, kind: str) -> Column:
    """Checked matches of one kind; texts that cannot hold one are not searched."""
    hint = F.contains(text, F.lit(_HINTS[kind])) if _HINTS[kind] else F.lit(True)
    if kind != "email":
        hint = hint & text.rlike("[0-9]")
    found = F.filter(_matches(text, PATTERNS[kind]), lambda x: _CHECKS[kind](x["value"]))
    return F.when(hint, found).otherwise(F.array().cast(SPAN))


def pair_spans(text: Column) -> Column:
    """``key = value`` occurrences: the pattern, and the value with its offsets."""
    has = text.rlike(r"[=:#]\x20{0,2}[\"']?[^\s\"'<>]{6}")
    pairs = F.transform(_matches(text, PAIR, contexts=False), lambda x: F.struct(
        F.concat(F.lower(F.regexp_extract(x["value"], PAIR, 1)), F.trim(F.regexp_replace(F.regexp_extract(x["value"], PAIR, 2), "[\"']", ""))).alias("pattern"),
        (x["end"] - F.length(F.regexp_extract(x["value"], PAIR, 3))).alias("start"), x["end"].alias("end"),
        F.regexp_extract(x["value"], PAIR, 3).alias("value")))
    return F.when(has, pairs).otherwise(F.array().cast(OCCURRENCE))


def token_spans(text: Column) -> Column:
    """Identifier-like runs, without the dots and hyphens around them."""
    first = lambda value: F.regexp_replace(value, r"^[.-]++", "")
    core = lambda value: F.regexp_replace(first(value), r"(?<![.-])[.-]++$", "")
    cut = F.transform(_matches(text, TOKEN), lambda x: F.struct(
        (x["end"] - F.length(first(x["value"]))).alias("start"),
        (x["end"] - F.length(first(x["value"])) + F.length(core(x["value"]))).alias("end"), core(x["value"]).alias("value"), x["patterns"].alias("patterns")))
    return F.when(text.rlike(TOKEN), F.filter(cut, lambda x: x["value"].rlike(IDENTIFIER))).otherwise(F.array().cast(SPAN))


def _occurrences(spans: Column) -> Column:
    """One entry for each pattern of each span."""
    return F.flatten(F.transform(spans, lambda x: F.transform(x["patterns"], lambda pattern: F.struct(
        pattern.alias("pattern"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))))


def confident_patterns(found: DataFrame) -> DataFrame:
    """``(pattern, score)`` from ``found(base, seen, pairs)`` by rounds over the pattern-instance graph until it is settled."""
    edges = cut_lineage(found.select(F.explode(F.concat("seen", "pairs")).alias("p")).select("p.pattern", "p.value").distinct())
    seeds = found.select(F.explode("base").alias("b")).select("b.value").distinct().withColumn("seed", F.lit(1.0))
    looks = F.col("value").rlike(IDENTIFIER)
    nodes = edges.select("value").distinct().join(seeds, "value", "left").select(
        "value", F.coalesce("seed", F.when(F.col("value").rlike(SECRET), 1.0), F.lit(0.0)).alias("trust"))
    while True:
        nodes = cut_lineage(nodes)
        scores = edges.join(nodes, "value").groupBy("pattern").agg(
            F.avg("trust").alias("score"), F.sum((F.col("trust") > 0).cast("int")).alias("support"))
        scores = cut_lineage(scores.where((F.col("support") >= SUPPORT) & (F.col("score") >= CONFIDENT)).select("pattern", "score"))
        # Trust rises in whole steps up to 1, so the rounds end, and they end when no value's trust has changed.
        best = edges.join(bounded_broadcast(scores), "pattern").where(looks).groupBy("value").agg(F.max("score").alias("best"))
        better = F.greatest("trust", F.floor(F.coalesce("best", F.lit(0.0)) * TRUST_STEPS) / TRUST_STEPS)
        moved = cut_lineage(nodes.join(best, "value", "left").select("value", better.alias("trust"), (better > F.col("trust")).alias("moved")))
        if moved.where("moved").isEmpty():
            return scores
        nodes = moved.drop("moved")


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "id")]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _with_kind(number: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, n_email, n_ip, n_card, n_phone, base, spans)``, one row for every row of ``docs``.

    ``base`` and ``spans`` are arrays of (start, kind, end) in order, kinds by
    number as listed, 4 for ``id``.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.sha2(whole, 256).alias("digest"),
        *[base_spans(whole, kind).alias(kind) for kind in KINDS], pair_spans(whole).alias("pairs"), token_spans(whole).alias("tokens"))
    tagged = F.concat(*[F.transform(kind, _with_kind(i)) for i, kind in enumerate(KINDS)])
    found = found.select(
        "doc_id", "digest", *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS], tagged.alias("base"),
        F.concat(*[_occurrences(F.col(kind)) for kind in KINDS]).alias("seen"), "pairs", "tokens")
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"])))
    found = cut_lineage(found.withColumn("pairs", F.concat("pairs", _occurrences(free))).drop("tokens"))
    patterns = bounded_broadcast(confident_patterns(found))
    lone = found.where(F.size("pairs") > 0).dropDuplicates(["digest"]).select("digest", "base", F.explode("pairs").alias("p"))
    apart = ~F.exists("base", lambda x: (x["start"] < F.col("p.end")) & (F.col("p.start") < x["end"]))
    ids = lone.select("digest", "base", "p", F.col("p.pattern").alias("pattern")).join(patterns, "pattern", "left_semi").where(
        F.col("p.value").rlike(IDENTIFIER) & apart).select("digest", "p.start", "p.end").distinct()
    # A run of a pair's value may hold an identifier run that is shorter by its ends.
    wider = Window.partitionBy("digest").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    more = ids.withColumn("reach", F.max("end").over(wider)).where("reach is null or reach < end").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start"), F.lit(len(KINDS)).alias("kind"), F.col("end")))).alias("more"))
    bare = F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return found.withColumn("base", bare).drop("pairs", "seen").join(bounded_broadcast(cut_lineage(more)), "digest", "left").withColumn("spans", spans).drop("more")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each fixed kind, the digest of the fixed spans and all spans as text."""
    return find(docs, doc_id, text).select(
        "doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; what a span before covers is skipped."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "id")])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    pieces = F.aggregate(spans, start, lambda acc, x: F.when(x["start"] < acc["at"], F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            x["end"].alias("at"), F.concat(acc["out"], F.array(
                text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))).alias("out"))),
        lambda acc: F.concat_ws("", acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, pieces).otherwise(text)


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text; rows without any stay as they are."""
    hits = find(docs, doc_id, text).where(F.size("spans") > 0).dropDuplicates(["digest"]).select(
        F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(bounded_broadcast(cut_lineage(hits)), "_digest", "left")
    clean = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("_spans")))
    return joined.withColumn(text, clean).select(*docs.columns)
