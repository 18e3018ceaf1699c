"""How the filters of a corpus interact: what each removes in every order, and its fair share.

Method. Each document has a mask of the filters it fails. Documents are counted by
part and mask; from that table the number that any coalition of filters removes is
tabulated for all coalitions. A filter's Shapley value is found by constrained least
squares: an additive model is fitted to the coalition values under the Shapley
kernel's weights, with the empty coalition exact and the filters' shares adding up to
what all remove together. The normal equations depend on the number of filters
alone, so they are solved once, in rationals, for a right-hand side left open; Spark
applies the solution to the counts of every part in whole numbers. What a filter
removes at a step of an order is the difference of two coalitions.

Identical texts are told by their SHA-256 digests. Rows are counted by digest, part and
labels before they meet, so a text that a third of all documents hold is a few rows.
Nothing but the fixed tables of filters, coalitions and orders is on the driver or broadcast.

Defined results. A null text is empty, a null part is the empty string. A null id is
smaller than no other and no other is smaller than it. Repeated rows are documents of
their own; rows of one id are not smaller than each other. Of several label rows of one
document, any with the value 1 counts; documents without labels are neither good nor
toxic. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: The filters by letter; E, the copy of an earlier document, is not a matter of one text.
FILTERS = "ABCDE"


def failures(text: Column) -> list[Column]:
    """Whether a text, not null, fails each of the first four filters."""
    listed = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(listed)
    return [n < 100, 100 * F.size(F.array_distinct(listed)) < 80 * n,
            100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents by part, failed filters and labels."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(whole))), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), own.cast("int").alias("own"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marked, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Labels depend on the id alone, so rows of one id and digest are one row with a count.
    once = rows.groupBy("doc_id", "digest", "part", "own", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    group = ["digest", "part", "own", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    each = once.groupBy(*group).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), first.alias("first"))
    # A digest has as many rows as parts and labels meet in it.
    both = each.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    # Rows with the smallest id of their text pass E, and so do those without an id.
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    spread = both.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), passing.alias("n")), F.struct(F.col("own").bitwiseOR(16).alias("mask"), (F.col("n") - passing).alias("n")))).alias("m"))
    return spread.groupBy("part", "m.mask", "good", "toxic").agg(F.sum("m.n").alias("n"))


def shapley_weights(m: int) -> tuple[list[list[int]], int]:
    """Whole-number weights of every coalition's value in each filter's Shapley value, and their common divisor.

    Minimises the kernel-weighted squared error of ``sum of shares of S`` against ``v(S)`` over the proper coalitions,
    subject to the shares adding up to ``v(all)``; ``v`` stays symbolic, one column a coalition.
    """
    full = (1 << m) - 1
    rows = [[Fraction(0)] * (m + 1 + full + 1) for _ in range(m + 1)]
    for s in range(1, full):
        inside = [i for i in range(m) if s >> i & 1]
        weight = Fraction(m - 1, comb(m, len(inside)) * len(inside) * (m - len(inside)))
        for i in inside:
            for j in inside:
                rows[i][j] += weight
            rows[i][m + 1 + s] += weight
    for i in range(m):  # the multiplier of the efficiency constraint, and the constraint itself
        rows[i][m] = rows[m][i] = Fraction(1)
    rows[m][m + 1 + full] = Fraction(1)
    for c in range(m + 1):
        pivot = next(r for r in range(c, m + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(m + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    solved = [row[m + 1:] for row in rows[:m]]
    divisor = lcm(*[x.denominator for row in solved for x in row])
    return [[int(x * divisor) for x in row] for row in solved], divisor


def coalition_values(counted: DataFrame, m: int) -> DataFrame:
    """``(part, n, removed, good, toxic)``: documents of a part and, by coalition number, how many it removes."""
    spread = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))).alias("coalition"))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    tabled = spread.groupBy("part", "coalition").agg(F.sum("n").alias("n"), *[
        F.coalesce(F.sum(F.when(hit & cond, F.col("n"))), F.lit(0)).alias(name)
        for name, cond in (("removed", F.lit(True)), ("good", F.col("good") == 1), ("toxic", F.col("toxic") == 1))])
    row = F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic")))
    return tabled.groupBy("part").agg(F.max("n").alias("n"), row.alias("v")).select(
        "part", "n", *[F.col(f"v.{c}").alias(c) for c in ("removed", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every part, order of the filters and step, with the step's counts.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, share)``;
    ``shapley`` sums over all orders, ``share`` is its mean over them.
    """
    m, spark = len(FILTERS), docs.sparkSession
    full = (1 << m) - 1
    weights, divisor = shapley_weights(m)
    steps = []
    for order in permutations(range(m)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            steps.append((len(steps), "".join(FILTERS[j] for j in order), step, i, 1 << i, full ^ 1 << i, before, after))
            before = after
    steps = spark.createDataFrame(steps, "place int, filter_order string, step int, filter int, alone int, others int, before int, after int")
    values = coalition_values(masks(docs, labels, part, doc_id, text), m)
    shares = F.array(*[sum((F.col("removed")[s] * (w * factorial(m) // divisor) for s, w in enumerate(row) if w), F.lit(0)) for row in weights])
    rows = values.withColumn("shares", shares).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(m * factorial(m) - 1))))
    rows = rows.join(F.broadcast(steps), "place")  # a fixed table: m * m! rows
    gone = F.get("removed", "after") - F.get("removed", "before")
    shapley = F.get("shares", F.col("filter"))
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - F.get("removed", "after")).alias("kept"), gone.alias("removed"), (F.get("removed", "alone") - gone).alias("redundant"),
        (F.get("removed", F.lit(full)) - F.get("removed", "others")).alias("unique_fails"),
        *[(F.get(c, "after") - F.get(c, "before")).alias(f"{c}_lost") for c in ("good", "toxic")],
        shapley.cast("bigint").alias("shapley"), (shapley / F.lit(factorial(m))).alias("share"))
