"""Licence notices and texts in texts, by canonical digests of entire lines, runs of lines and entire texts.

Method, on column functions alone. A text is put in canonical form: lower case,
every run of punctuation and blanks as one blank, equivalent spellings as one,
copyright lines dropped. The digest of the whole text, and of each of its lines,
and of each run of lines that begins with the first word of a known text and has as
many words, is hash-joined to the digests of known licence texts in the same form,
so a notice is found however it is wrapped. Nothing is matched in part: a line that
only mentions a licence has another digest. Known are the notices below and the
whole texts in ``licenses``, with and without their title; Creative Commons texts
are not among them. A wrapped line that begins with "copyright" is taken for a
copyright line, so a text wrapped before that word is not found.

Defined results. Null and empty texts hold no units and no licence. Each row gets
its own result, repeated rows the same one. Known texts whose canonical form is
empty are ignored; equal known texts all count. Known texts are broadcast only if
counted to be few. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.columns import bounded_broadcast
from edgeloom.session import cut_lineage

#: Known notices, fixed values: identifier and text.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
#: Spellings that count as one, fixed values, in canonical form.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
             ("favour", "favor"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"))
#: First lines of whole texts that copies often lack.
TITLES = ("MIT License", "BSD 2-Clause License", "BSD 3-Clause License")
COPYRIGHT = r"(?m)^\x20?(copyright|c [0-9]{4}|all rights reserved)( .*)?$"


def canonical(text: Column) -> Column:
    """Canonical form with line ends kept."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    for spelling, one in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{spelling}\b", one)
    return F.regexp_replace(out, COPYRIGHT, "")


def units(text: Column) -> Column:
    """Canonical lines that are not blank."""
    return F.filter(F.transform(F.split(canonical(text), "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def known_digests(known: DataFrame, license_id: str = "license_id", text: str = "text") -> DataFrame:
    """``(digest, license_id, head, words)`` of known licence texts."""
    whole = F.array_join(units(F.col(text)), " ")
    return known.select(F.col(license_id).alias("license_id"), whole.alias("whole")).where("whole != '' and license_id is not null").select(
        F.sha2("whole", 256).alias("digest"), "license_id", F.substring_index("whole", " ", 1).alias("head"), F.size(F.split("whole", " ")).alias("words")).distinct()


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*NOTICES, *whole_texts()], "license_id string, text string")


def whole_texts() -> list[tuple[str, str]]:
    """Identifier and text of the licence texts and headers that come with the package."""
    found = []
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        name, text = file.name.removesuffix(".txt").removesuffix(".header"), file.read_text()
        title, _, rest = text.partition("\n")
        found += [(name, text)] + [(name, rest)] * (title in TITLES)
    return found


def _runs(lines: Column, known: Column) -> Column:
    """``(digest, at, n)`` of runs of several lines that hold the first word and the number of words of a known text."""
    word = lambda line: F.substring_index(line, " ", 1)
    words = lambda line: F.size(F.split(line, " "))
    heads = F.array_distinct(F.transform(known, lambda k: k["head"]))
    starts = F.filter(F.transform(lines, lambda line, i: F.when(F.array_contains(heads, word(line)), i)), lambda i: i.isNotNull())

    def run(i: Column, k: Column) -> Column:
        # Every line has a word, so k.words lines are enough. The count of lines is null unless the words end with a line.
        nearest = F.aggregate(F.slice(lines, i + 1, k["words"]), F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), lambda acc, line: F.when(
            acc["words"] < k["words"], F.struct((acc["words"] + words(line)).alias("words"), (acc["n"] + 1).alias("n"))).otherwise(acc))
        return F.get(F.transform(F.array(nearest), lambda end: F.when((end["words"] == k["words"]) & (end["n"] > 1), F.struct(
            F.sha2(F.array_join(F.slice(lines, i + 1, end["n"]), " "), 256).alias("digest"), i.alias("at"), end["n"].alias("n")))), 0)

    return F.filter(F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(known, lambda k: k["head"] == word(F.get(lines, i))), lambda k: run(i, k)))), lambda x: x.isNotNull())


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_license_lines, licenses, whole_license)``, one row for every row of ``docs``.

    ``licenses`` are the identifiers in order, joined by commas; ``whole_license``
    is set if the entire text is a known one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("row"), units(F.col(text)).alias("lines"))
    table = cut_lineage(known_digests(known))
    shapes = table.agg(F.collect_set(F.struct("head", "words")).alias("shapes"))
    table = bounded_broadcast(table.drop("head", "words"))
    # The array binds the lines, so that they are made once.
    found = F.get(F.transform(F.array("lines"), lambda lines: F.concat(
        F.transform(lines, lambda line, i: F.struct(F.sha2(line, 256).alias("digest"), i.alias("at"), F.lit(1).alias("n"))), _runs(lines, F.col("shapes")))), 0)
    digested = cut_lineage(rows.crossJoin(F.broadcast(shapes)).select(
        "doc_id", "row", F.size("lines").cast("bigint").alias("n_lines"), F.sha2(F.array_join("lines", " "), 256).alias("whole"), found.alias("digests")))
    # Unmatched lines fall out in the join, before anything is shuffled. A line of several hits counts once.
    lines = digested.select("row", F.explode("digests").alias("d")).select("row", "d.*").join(table, "digest")
    hits = cut_lineage(lines.select("row", "license_id", "at", "n").distinct())
    found = hits.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"))
    covered = hits.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    counts = covered.groupBy("row").agg(F.count(F.lit(1)).alias("n_license_lines"))
    ids = digested.select("row", F.col("whole").alias("digest")).distinct().join(table, "digest").groupBy("row").agg(F.min("license_id").alias("whole_license"))
    found = found.join(counts, "row", "left").join(ids, "row", "full")
    return digested.select("doc_id", "row", "n_lines").join(found, "row", "left").select(
        "doc_id", "n_lines", F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), F.coalesce("licenses", F.lit("")).alias("licenses"), "whole_license")
