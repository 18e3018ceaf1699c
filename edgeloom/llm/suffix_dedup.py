"""Removal of long byte strings that occur more than once, on Burrows-Wheeler transforms.

Method. Every window of ``length`` bytes is represented by its smallest gram, so
equal windows share that gram and where it lies in them. Neighbouring windows of
one smallest gram form a segment; only segments whose gram occurs again can hold
a repeated window, and equal segments are one class. The classes of a gram go to
one task. There a suffix order of the classes and its Burrows-Wheeler transform
are built, and common-prefix lengths are derived by increasing value: boundaries
of value l are extended backward by one character to boundaries of value l + 1,
breadth first, and the expansion stops at ``length``. Suffixes that no boundary
separates by then share a whole window.

The order is settled to a depth of at least ``length`` only; suffixes equal to
that depth are one class of ranks, which is what the expansion needs.

Bounds. A task takes the grams of its partition in lots of about ``LOT`` bytes. A
gram whose classes exceed ``WIDEST`` bytes is not gathered: its windows are
counted one by one by two independent 64-bit hashes, which decides the same thing.
Segments are equal by gram and a cryptographic digest.

Defined results. A null text is empty. Texts shorter than ``length`` lose
nothing. Repeated rows, with the same or another id, are occurrences of their
text, and each has its own result. An empty table gives an empty result. Only id
and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytestrings import binary_slices, digests, ragged, run_hashes, text_bytes, window_hashes
from edgeloom.llm.columns import bounded_broadcast, chunks
from edgeloom.llm.shingles import words as split_words
from edgeloom.session import cut_lineage, parallelism

LENGTH, GRAM = 400, 64
#: Words of a passage whose sharing is reported.
PASSAGE = 50
LOT, WIDEST = 1 << 20, 3 << 20
SYMBOLS = 7  # of nine bits, in one word


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, begin, end, gram and digest of every segment; begin and end in the chunk."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    n = len(data)
    if not (sizes >= length).any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    grams = window_hashes(data, gram)
    # The position in the low bits makes the first of equal grams the smallest.
    bits = np.uint64(int(n).bit_length())
    low = (grams >> bits << bits) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    last = np.repeat(offsets[1:] - length, sizes)[:len(low)]
    starts = np.flatnonzero(at[:len(low)] <= last)
    anchor = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    turn = np.ones(len(starts), bool)
    turn[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(turn)
    begin = starts[first]
    end = starts[np.append(first[1:], len(starts)) - 1] + length
    text = np.searchsorted(offsets, begin, side="right") - 1
    whole = memoryview(np.ascontiguousarray(data))
    return text, begin, end, grams[anchor[first]], digests(whole[a:b] for a, b in zip(begin.tolist(), end.tolist()))


def suffix_ranks(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order to ``depth`` at least, and each suffix's class: the place of its first equal."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(SYMBOLS, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(SYMBOLS):
        key = key << np.uint64(9) | padded[i:i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    done = SYMBOLS
    while done < depth:
        follows = np.append(~new[1:], False)
        slots = np.flatnonzero(~new | follows)  # places in classes of two or more
        if not len(slots):
            break
        suffix = order[slots]
        beyond = suffix + done
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = head[slots] << 32 | second
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[slots] = suffix
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        head[slots] = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[suffix] = head[slots]
        done *= 2
    return order, rank


def repeated_positions(symbols: np.ndarray, length: int) -> np.ndarray:
    """Marks positions whose next ``length`` symbols also start elsewhere.

    ``symbols`` are bytes plus one, with a zero after each string.
    """
    n = len(symbols)
    order, rank = suffix_ranks(symbols, length)
    before = order - 1  # the last symbol is a zero, so wrapping round starts no string
    transform = symbols[before]
    target = rank[before]
    by_symbol = np.argsort(transform, kind="stable")
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    j, k = by_symbol[:-1][same], by_symbol[1:][same]
    adjoining = np.zeros(n, bool)
    adjoining[k[j == k - 1]] = True
    apart = j != k - 1
    j, k = j[apart], k[apart]
    value = np.full(n, -1, np.int32)
    first = symbols[order]
    front = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    value[front] = 0
    for l in range(length - 1):
        reached = [target[front[adjoining[front]]]]
        if len(j):
            if len(j) * 16 > n:
                mark = np.zeros(n, np.int32)
                mark[front] = 1
                upto = np.cumsum(mark, dtype=np.int32)
                hit = upto[k] > upto[j]
            else:
                hit = np.searchsorted(front, k, side="right") > np.searchsorted(front, j, side="right")
            reached.append(target[k[hit]])
            j, k = j[~hit], k[~hit]
        front = np.concatenate(reached)
        front = np.unique(front[value[front] < 0])
        if not len(front):
            break
        value[front] = l + 1
    shared = value < 0  # no boundary before this place: a common prefix of at least ``length``
    shared[0] = False
    out = np.zeros(n, bool)
    out[order[shared]] = True
    out[order[np.flatnonzero(shared) - 1]] = True
    return out


def _covered(flags: np.ndarray, begin: int, count: int, length: int) -> list[dict]:
    """Spans that the marked windows of one segment cover, from its begin."""
    inside = flags[begin:begin + count]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return [{"from": int(a), "to": int(b) - 1 + length} for a, b in zip(edge[::2], edge[1::2])]


def _decided(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans of every class, from batches sorted by gram."""
    held: dict[tuple[int, int], tuple[int, bytes]] = {}
    size, last = 0, None

    def settle() -> pa.RecordBatch:
        keys = list(held)
        texts = [held[key][1] for key in keys]
        joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        symbols = joined.astype(np.uint16) + 1
        symbols[at[1:] - 1] = 0
        flags = repeated_positions(symbols, length)
        spans = [[{"from": 0, "to": len(t)}] if held[key][0] > 1 else _covered(flags, at[i], len(t) - length + 1, length)
                 for i, (key, t) in enumerate(zip(keys, texts))]
        return pa.RecordBatch.from_arrays([
            pa.array([key[0] for key in keys], pa.int64()), pa.array([key[1] for key in keys], pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))], ["gram", "digest", "parts"])

    for batch in batches:
        for gram, digest, copies, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "digest", "copies", "piece"))):
            if gram != last and size >= LOT:
                yield settle()
                held, size = {}, 0
            last = gram
            if (gram, digest) not in held:
                held[gram, digest] = (copies, piece)
                size += len(piece)
    if held:
        yield settle()


PARTS = "gram bigint, digest bigint, parts array<struct<from:int,to:int>>"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, spans)`` of texts with repeated strings, from ``docs(key, text)``; spans may overlap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            data, offsets = text_bytes(part["text"])
            text, begin, end, grams, digests = segments(data, offsets, length, gram)
            at = np.searchsorted(text, np.arange(len(offsets)))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (
                (begin - offsets[text]).astype(np.int32), (end - offsets[text]).astype(np.int32), grams.view(np.int64), digests.view(np.int64))]
            rows = pa.table([part["key"].combine_chunks(), *lists], ["key", "begin", "end", "gram", "digest"])
            yield from rows.filter(pa.array(np.diff(at) > 0)).to_batches()

    lists = cut_lineage(docs.mapInArrow(cut, "key binary, begin array<int>, end array<int>, gram array<bigint>, digest array<bigint>"))
    single = lists.select("key", F.explode(F.arrays_zip("begin", "end", "gram", "digest")).alias("s")).select("key", "s.begin", "s.end", "s.gram", "s.digest")
    again = single.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    again = cut_lineage(again.where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")))
    met = cut_lineage(single.join(bounded_broadcast(again), "gram"))

    classes = met.where("mixed").groupBy("gram", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "begin", "end")).alias("at"))
    classes = cut_lineage(classes.select("gram", "digest", "copies", "at.key", "at.begin", "at.end"))
    wide = classes.groupBy("gram").agg(F.sum(F.col("end") - F.col("begin")).alias("bytes")).where(F.col("bytes") > WIDEST).select("gram")
    wide = bounded_broadcast(cut_lineage(wide))
    wanted = cut_lineage(classes.groupBy("key").agg(F.collect_list(F.struct("gram", "digest", "copies", "begin", "end")).alias("wanted")))
    wanted = F.broadcast(wanted) if classes.count() <= 1_000_000 else wanted

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            data, offsets = text_bytes(part["text"])
            listed = part["wanted"].combine_chunks()
            counts = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            base = np.repeat(offsets[:-1], counts)
            begin, end = base + flat.field("begin").to_numpy(), base + flat.field("end").to_numpy()
            pieces = data[ragged(begin, end - begin)]
            at = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(pieces))])
            yield pa.RecordBatch.from_arrays([flat.field("gram"), flat.field("digest"), flat.field("copies"), binary], ["gram", "digest", "copies", "piece"])

    pieces = docs.join(wanted, "key").mapInArrow(fetch, "gram bigint, digest bigint, copies bigint, piece binary")
    narrow = pieces.join(wide, "gram", "left_anti").repartition(parallelism(docs.sparkSession), "gram").sortWithinPartitions("gram", "digest")
    decided = narrow.mapInArrow(lambda batches: _decided(batches, length), PARTS).unionByName(
        _counted(pieces.join(wide, "gram", "left_semi"), length))
    decided = cut_lineage(decided)

    sure = met.where("not mixed").select("key", F.col("begin").alias("from"), F.col("end").alias("to"))
    part = met.where("mixed").join(decided.where(F.size("parts") > 0), ["gram", "digest"]).select("key", "begin", F.explode("parts").alias("p")).select(
        "key", (F.col("begin") + F.col("p.from")).alias("from"), (F.col("begin") + F.col("p.to")).alias("to"))
    return sure.unionByName(part).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated spans of the classes of very frequent grams, by counts of window digests."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, digest, copies, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "digest", "copies", "piece"))):
                data = np.frombuffer(piece, np.uint8)
                at = np.arange(len(data) - length + 1)
                one, two = window_hashes(data, length, 1), window_hashes(data, length, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), gram), pa.int64()), pa.array(np.full(len(at), digest), pa.int64()), pa.array(np.full(len(at), copies), pa.int64()),
                    pa.array(at, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["gram", "digest", "copies", "at", "a", "b"])

    each = pieces.mapInArrow(windows, "gram bigint, digest bigint, copies bigint, at int, a bigint, b bigint").distinct()
    often = each.groupBy("a", "b").agg(F.sum("copies").alias("n")).where("n > 1")
    return each.join(often, ["a", "b"]).groupBy("gram", "digest").agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("from"), (F.col("at") + length).cast("int").alias("to")))).alias("parts"))


def shared_passages(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """``(key, n_shared)`` of texts that share a passage with the text of another row, from ``docs(key, text)``.

    A stretch of about half as many words, the one of smallest hash, stands for every ``words``
    neighbouring words, so texts that share a passage of ``words`` words share a stretch. ``n_shared``
    counts a text's stretches that other rows hold. Equal texts have one key.
    """
    half = words // 2 + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            data, offsets = text_bytes(part["text"])
            starts, ends, word_at = split_words(data, offsets)
            at, found = np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
            if (np.diff(word_at) >= words).any():
                named = binary_slices(data, starts, ends).dictionary_encode()
                low = run_hashes(digests(named.dictionary.to_pylist())[named.indices.to_numpy()], half)
                width, span = words - half + 1, 1
                while span * 2 <= width:
                    low = np.minimum(low[:-span], low[span:])
                    span *= 2
                if span < width:
                    low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(word_at))[:len(low)]
                inside = np.arange(len(low)) + words <= word_at[owner + 1]
                owner, found = owner[inside], low[inside]
                order = np.lexsort((found, owner))
                owner, found = owner[order], found[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                owner, found = owner[new], found[new]
                at = np.searchsorted(owner, np.arange(len(offsets)))
            rows = pa.table([part["key"].combine_chunks(), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))], ["key", "runs"])
            yield from rows.filter(pa.array(np.diff(at) > 0)).to_batches()

    lists = docs.mapInArrow(cut, "key binary, runs array<bigint>").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.any_value("runs").alias("runs"))
    single = cut_lineage(lists).select("key", "copies", F.explode("runs").alias("run"))
    again = cut_lineage(single.groupBy("run").agg(F.sum("copies").alias("n")).where("n > 1").select("run"))
    return single.join(bounded_broadcast(again), "run").groupBy("key").agg(F.count(F.lit(1)).alias("n_shared"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared[, kept])``, one row for every row of ``docs``.

    ``n_shared`` tells of passages of ``PASSAGE`` words that another row's text holds too, whatever they
    have in bytes; nothing is removed for them alone.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(whole.cast("binary"))).alias("key"), whole.alias("text"))
    spans = repeated_spans(rows.select("key", "text"), length, gram).join(shared_passages(rows.select("key", "text")), "key", "full")
    spans = cut_lineage(spans)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_shared", pa.int64())]
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint"
    if keep_text:
        fields.append(("kept", pa.binary()))
        ddl += ", kept binary"
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, offsets = text_bytes(part["text"])
            removed, runs, sums, kept = [], [], [], []
            for i, found in enumerate(part["spans"].to_pylist()):
                own, gone, at, n = data[offsets[i]:offsets[i + 1]], 0, 0, 0
                pieces = []
                for span in found or ():
                    if span["from"] > at or n == 0:
                        pieces.append(own[at:span["from"]])
                        n += 1
                        gone += span["to"] - span["from"]
                        at = span["to"]
                    elif span["to"] > at:
                        gone += span["to"] - at
                        at = span["to"]
                pieces.append(own[at:])
                rest = b"".join(p.tobytes() for p in pieces)
                removed.append(gone)
                runs.append(n)
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [part["doc_id"].combine_chunks().cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums, pa.string()),
                       part["n_shared"].combine_chunks().cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, schema=schema)

    return rows.join(spans, "key", "left").select("doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared")).mapInArrow(cut, ddl)
