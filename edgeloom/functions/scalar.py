"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_TEXT = "1900-01-01"


def bind(value: Column, body) -> Column:
    """``body`` applied to ``value``, computed once even if used inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tidy(value: Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)


def seeded_key(seed: int, *parts: Column) -> Column:
    """Hex digest of the seed and the parts: a repeatable shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_uniform(seed: int, *parts: Column) -> Column:
    """Repeatable number in [0, 1) from the first 52 bits of the digest."""
    bits = F.conv(F.substring(seeded_key(seed, *parts), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(2 ** 52))


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """Repeatable number in [0, 1) from 53 bits of a 64-bit hash; cheaper than a digest, known to Spark alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(2 ** 53))


def parse_date(text: Column) -> Column:
    """Lenient date: full date, month or year; anything else gives 1900-01-01."""
    head = F.substring(text, 1, 10)
    year = F.substring(head, 1, 4)
    # The cast reads yyyy, yyyy-[m]m and yyyy-[m]m-[d]d; the pattern keeps out
    # the looser forms it would also take.
    whole = F.when(head.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2})?)?$"), head).try_cast("date")
    yearly = F.when(head.rlike(r"^\d{4}"), F.concat(year, F.lit("-01-01"))).try_cast("date")
    return F.coalesce(F.when(year != "0000", F.coalesce(whole, yearly)), F.lit(EPOCH_TEXT).cast("date"))


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """True when any of the terms occurs in the lower-cased text."""
    return bind(F.lower(text), lambda low: holds_any(low, terms))


def holds_any(low: Column, terms: Sequence[str]) -> Column:
    """Like ``has_any`` for text that is lower-cased already."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def first_match(text: Column, patterns: Sequence[tuple[str, str]], default: Column) -> Column:
    """Value of the first pattern (in order) contained in the text."""
    out = None
    for fragment, value in patterns:
        hit = F.contains(text, F.lit(fragment))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return default if out is None else out.otherwise(default)


# ------------------------------------------------------------------ vectors
def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, k: Column) -> Column:
    return bind(k, lambda f: F.transform(a, lambda x: x * f))


def norm(vec: Column) -> Column:
    return F.sqrt(total(F.transform(vec, lambda x: x * x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def layer_norm(vec: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit population variance per vector (unit gain, no shift)."""
    def centred(v: Column) -> Column:
        return bind(total(v) / F.size(v), lambda mu: F.transform(v, lambda x: x - mu))

    def scaled(c: Column) -> Column:
        deviation = F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + F.lit(eps))
        return bind(deviation, lambda d: F.transform(c, lambda x: x / d))

    return bind(bind(vec, centred), scaled)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def vector_sum(vec: str, dim: int) -> Column:
    """Element-wise sum aggregate; combines map-side, so hot groups stay cheap."""
    return F.array(*[F.sum(F.col(vec)[i]) for i in range(dim)])


def vector_mean(vec: str, dim: int) -> Column:
    return F.array(*[F.avg(F.col(vec)[i]) for i in range(dim)])


def vector_text(vec: Column, digits: int = 4) -> Column:
    """Readable fixed-precision text of a vector, for reports and comparisons."""
    scaled = F.transform(vec, lambda x: F.round(x * (10 ** digits)).cast("bigint").cast("string"))
    return F.concat_ws(",", scaled)


def cosine_decay(step: int, total_steps: int) -> float:
    """Prior decay factor: half a cosine wave from 1 at the first step down to 0 at the last."""
    done = min(max(step, 0) / max(total_steps, 1), 1.0)
    return (1.0 + math.cos(math.pi * done)) / 2.0
