"""Runs of words that repeat with a short period, from a dictionary of basic factors.

Method. A basic factor is a stretch of 1, 2, 4, ... words. Factors of one length
have equal names in a text exactly if they are equal; names of a length come from
the pairs of names of half that length. For every factor that has an equal
successor so near that both lie in a stretch of twice its length, the distance is a
proposed period. Neighbouring places with one distance start arithmetic progressions
of occurrences and together span the stretch that repeats with that period. It is
extended by comparing words, and kept once, with its smallest period.

A run with period q and at least four periods is proposed whole at the smallest
basic length that is not under q: a factor of q words or more can't recur nearer
than q in it, since q is its smallest period. Places whose factor occurs once in
the text are left out of all longer ones, so ordinary prose costs a few sorts.

Words are maximal runs of bytes other than the six ASCII spaces, compared exactly.
Texts are independent: a task takes its texts in chunks of about 1 MB, or one text.
Memory is a few numbers for each word of the chunk, at every length.

Defined results. A null text is empty and has no runs. Each row has its own result,
repeated rows too. Ties for the greatest exponent go to the smallest start, then
the smallest period. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytestrings import binary_slices, counted, ragged, text_bytes
from edgeloom.llm.columns import chunks
from edgeloom.llm.shingles import words

MIN_LENGTH, MIN_PERIODS = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """A number for every word, equal exactly for equal words of one text."""
    encoded = binary_slices(data, starts, ends).dictionary_encode()
    counts = np.diff(word_at)
    return encoded.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(counts)) * len(encoded.dictionary), counts)


def _proposed(codes: np.ndarray, stop: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and period of stretches, one batch for every basic length."""
    n, size = len(codes), 1
    at, key = np.arange(n), codes
    while len(at):
        order = np.argsort(key, kind="stable")  # equal factors stay in order of place
        new = np.ones(len(at), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        gap = np.zeros(n, np.int64)
        gap[at[order[:-1]]] = np.where(new[1:], 0, at[order[1:]] - at[order[:-1]])
        gap[gap > size] = 0
        near = np.flatnonzero(gap)
        if len(near):
            turn = np.ones(len(near), bool)
            turn[1:] = (near[1:] != near[:-1] + 1) | (gap[near[1:]] != gap[near[:-1]])
            first = np.flatnonzero(turn)
            last = near[np.append(first[1:], len(near)) - 1]
            yield near[first], last + size + gap[last], gap[last]
        if size >= longest:
            return
        alone = new & np.append(new[1:], True)
        name = np.full(n + 1, -1, np.int64)
        name[at[order]] = np.where(alone, -1, np.cumsum(new))
        at = at[(name[at] >= 0) & (at + 2 * size <= stop[at])]
        at = at[name[at + size] >= 0]
        key = name[at] * (n + 1) + name[at + size]
        size *= 2


def text_runs(codes: np.ndarray, word_at: np.ndarray, min_length: int, min_periods: int) -> tuple[np.ndarray, ...]:
    """Text, start in the chunk, end and period of every run, in order of text, start and period."""
    counts = np.diff(word_at)
    longest = int(counts.max(initial=0)) // min_periods
    stop = np.repeat(word_at[1:], counts)
    found = [np.zeros((3, 0), np.int64)]
    for start, end, period in _proposed(codes, stop, longest):
        keep = end - start >= np.maximum(min_length, min_periods * period)
        start, end, period = start[keep], end[keep], period[keep]
        floor, ceiling = word_at[np.searchsorted(word_at, start, side="right") - 1], stop[start]
        while True:
            left = (start > floor) & (codes[start - 1] == codes[start - 1 + period])
            right = (end < ceiling) & (codes[np.minimum(end, len(codes) - 1)] == codes[end - period])
            if not (left.any() or right.any()):
                break
            start, end = start - left, end + right
        found.append(np.stack([start, end, period]))
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return np.searchsorted(word_at, start, side="right") - 1, start, end, period


def _strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> dict:
    """The run with the greatest exact length / period, the first of equals."""
    ratio = length / period
    best = None
    for i in np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12)):
        run = {"start": int(start[i]), "length": int(length[i]), "period": int(period[i])}
        if best is None or run["length"] * best["period"] > best["length"] * run["period"]:
            best = run
    return best


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """Words of every text joined by blanks; ``text`` is sorted."""
    sizes = ends - starts
    blank = np.zeros(len(starts), np.int64)
    blank[1:] = text[1:] == text[:-1]
    to = np.cumsum(sizes + blank)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    out[ragged(to - sizes, sizes)] = data[ragged(starts, sizes)]
    at = np.concatenate([[0], to])[counted(text, n)]
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at), pa.py_buffer(out)]).cast(pa.string())


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, runs, strongest, collapsed)``, one row for every row of ``docs``.

    ``runs`` holds ``(start, length, period)`` in words, by start, then period. ``collapsed`` is
    the text's words joined by blanks, without those after the first period of a run.
    """
    kind = dict(docs.dtypes)[doc_id]
    ddl = f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, offsets = text_bytes(part["text"])
            starts, ends, word_at = words(data, offsets)
            n = len(offsets) - 1
            owner, begin, end, period = text_runs(word_codes(data, starts, ends, word_at), word_at, min_length, min_periods)
            at, length, own = counted(owner, n), end - begin, begin - word_at[owner]
            dropped = np.zeros(len(starts) + 1, np.int64)
            np.add.at(dropped, begin + period, 1)
            np.add.at(dropped, end, -1)
            kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
            text_of = np.repeat(np.arange(n), np.diff(word_at))
            runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(own), pa.array(length), pa.array(period)], fields=list(RUN)))
            best = [_strongest(own[i:j], length[i:j], period[i:j]) if j > i else None for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([
                part["doc_id"].combine_chunks(), runs, pa.array(best, RUN), _joined(data, starts[kept], ends[kept], text_of[kept], n)], ["doc_id", "runs", "strongest", "collapsed"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, ddl)


def with_periodic_tail(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` where a tenth of the texts, drawn by the id's checksum, end in a repeated stretch.

    Of ``n`` words those from ``a`` on repeat with period ``p``; both come from the checksum. A null id draws nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drawn = rows.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10).cast("bigint")))
    split = drawn.withColumn("words", F.when(F.col("g").isNotNull(), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    sized = split.withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("bigint")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("bigint"))
    place = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    tail = F.array_join(F.transform(place, lambda i: F.get("words", i.cast("int"))), " ")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))
