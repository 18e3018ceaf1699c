"""Benchmark passages in documents, found with edits by the pigeonhole principle.

Method. An item of n characters may differ from a passage in ``k = rate * n``
edits. It is cut into k + 1 pieces, of which at least one must occur unchanged;
all pieces of all items are searched in one pass. Neighbouring pieces form
groups of at most 64 characters, and a passage within k edits matches some group
of g pieces within g - 1 edits, so a piece hit is verified on its group first,
all hits of a chunk side by side, one machine word each, and the few that remain
on the whole item, by Myers' bit-parallel distance both times.

Texts and items are compared lower-cased, with every run of characters other
than letters and digits as one blank. Items travel to the tasks in lots of
``LOT`` items, so what a task holds is bounded for any number of items.

Items of fewer than ``SHORTEST`` characters leave no room for edits: they are found
unchanged, between blanks or ends of the normalised text.

Defined results. Null and empty texts and items match nothing; equal items all match. One row for each
document row and item; clean documents have no row. Rows with a null id are
ignored. Empty tables give an empty result. Only id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.byte_bpe import NUMBER, character_kinds
from edgeloom.llm.bytestrings import text_bytes
from edgeloom.llm.columns import bounded_broadcast, chunks, resident
from edgeloom.session import cut_lineage

RATE = 0.08
SHORTEST = 20
LOT = 20_000
WORD = 64
DDL = "doc_id bigint, item_id bigint, edits int, item_chars int, end_at bigint"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_chars", pa.int32()), ("end_at", pa.int64())])


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, a zero after each, and where each begins."""
    lowered = [t.lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])]).astype(np.int64)
    points = np.frombuffer(("\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.zeros(len(points), bool)
    stop[at[1:] - 1] = True
    out = np.where(character_kinds()[points] <= NUMBER, points, 32)
    blank = out == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep |= stop
    out[stop] = 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], before[at]


class Searcher:
    """Pieces, groups and items of one lot."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items: list[tuple[int, str, int]] = []
        self.pieces: list[tuple[int, int, int, int, int]] = []  # item, offset, group, offset in group, group size
        self.trie, self.whole = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.short: dict[str, list[int]] = {}  # by normalised text between blanks
        patterns, budgets, owners = [], [], {}
        for item_id, text in items:
            points, at = normalised([text])
            plain = points[:-1].astype(np.uint32).tobytes().decode("utf-32-le").strip()
            if len(plain) < SHORTEST:
                if plain:
                    self.short.setdefault(f" {plain} ", []).append(item_id)
                continue
            k = int(rate * len(plain))
            number = len(self.items)
            self.items.append((item_id, plain, k))
            cuts = [len(plain) * i // (k + 1) for i in range(k + 2)]
            first = 0
            while first <= k:
                last = first
                while last < k and cuts[last + 2] - cuts[first] <= WORD:
                    last += 1
                group = len(patterns)
                start, end = cuts[first], min(cuts[last + 1], cuts[first] + WORD)
                patterns.append(plain[start:end])
                budgets.append(last - first)
                for i in range(first, last + 1):
                    owners.setdefault(plain[cuts[i]:cuts[i + 1]], []).append(len(self.pieces))
                    self.pieces.append((number, cuts[i], group, cuts[i] - start, end - start))
                first = last + 1
        for piece, numbers in owners.items():
            self.trie.add_word(piece, (len(piece), tuple(numbers)))
        if owners:
            self.trie.make_automaton()
        for plain, ids in self.short.items():
            self.whole.add_word(plain, (len(plain) - 2, tuple(ids)))
        if self.short:
            self.whole.make_automaton()
        letters = sorted({c for p in patterns for c in p})
        self.codes = np.zeros(0x110000, np.int32)
        for i, c in enumerate(letters):
            self.codes[ord(c)] = i + 1
        self.masks = np.zeros((len(patterns), len(letters) + 1), np.uint64)
        for g, pattern in enumerate(patterns):
            for i, c in enumerate(pattern):
                self.masks[g, self.codes[ord(c)]] |= np.uint64(1 << i)
        self.group_size = np.array([len(p) for p in patterns], np.int64)
        self.group_budget = np.array(budgets, np.int64)
        self.table = np.array(self.pieces, np.int64).reshape(-1, 5)

    def groups_match(self, codes: np.ndarray, group: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whether each group occurs within its budget in its window; one machine word a window."""
        size = self.group_size[group].astype(np.uint64)
        high = np.uint64(1) << (size - np.uint64(1))
        up = np.full(len(group), np.iinfo(np.uint64).max, np.uint64)
        down = np.zeros(len(group), np.uint64)
        score = self.group_size[group].copy()
        best = score.copy()
        one = np.uint64(1)
        for t in range(int(width.max())):
            code = codes[np.minimum(start + t, len(codes) - 1)]
            code = np.where(t < width, code, 0)
            equal = self.masks[group, code]
            vertical = equal | down
            horizontal = (((equal & up) + up) ^ up) | equal
            plus, minus = down | ~(horizontal | up), up & horizontal
            score += (plus & high) != 0
            score -= (minus & high) != 0
            plus, minus = plus << one, minus << one
            up, down = minus | ~(vertical | plus), plus & vertical
            np.minimum(best, score, out=best, where=t < width)
        return best <= self.group_budget[group]

    def search(self, points: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(text, item id, edits, item length, end)`` of every item within its budget in every text."""
        return sorted(self.search_short(points, at) + self.search_long(points, at))

    def search_short(self, points: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Short items between blanks or ends of a text, unchanged; the first place of each."""
        if not self.short:
            return []
        # Every blank stands for itself and every end of a text for one.
        plain = " " + np.where(points == 0, 32, points).astype(np.uint32).tobytes().decode("utf-32-le")
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for last, (size, ids) in self.whole.iter(plain):
            end = last - 1  # of the item, in ``points``
            text = int(np.searchsorted(at, end - size, side="right")) - 1
            if end > at[text + 1] - 1:  # it would run into the next text
                continue
            for item in ids:
                found.setdefault((text, item), (size, end - int(at[text])))
        return [(t, item, 0, size, end) for (t, item), (size, end) in found.items()]

    def search_long(self, points: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        if not self.items:
            return []
        plain = points.astype(np.uint32).tobytes().decode("utf-32-le")
        ends, numbers = [], []
        for end, (size, found) in self.trie.iter(plain):
            ends.extend([end + 1 - size] * len(found))
            numbers.extend(found)
        if not ends:
            return []
        where = np.array(ends, np.int64)
        item, offset, group, inner, size = self.table[np.array(numbers)].T
        text = np.searchsorted(at, where, side="right") - 1
        budget = self.group_budget[group]
        low = np.maximum(where - inner - budget, at[text])
        high = np.minimum(where - inner + size + budget, at[text + 1] - 1)
        codes = self.codes[points]
        keep = np.zeros(len(where), bool)
        for i in range(0, len(where), 1 << 17):
            part = slice(i, i + (1 << 17))
            keep[part] = self.groups_match(codes, group[part], low[part], np.maximum(high[part] - low[part], 0))
        diagonal = (where - offset)[keep]
        text, item = text[keep], item[keep]
        order = np.lexsort((diagonal, item, text))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        last = None
        for t, i, d in zip(text[order].tolist(), item[order].tolist(), diagonal[order].tolist()):
            _, pattern, k = self.items[i]
            # A window reaches twice the budget to either side, so it covers a second hit this near.
            if last is not None and last[:2] == (t, i) and d - last[2] <= k:
                continue
            last = (t, i, d)
            begin, stop = max(d - 2 * k, int(at[t])), min(d + len(pattern) + 2 * k, int(at[t + 1]) - 1)
            edits, end = myers(pattern, plain[begin:stop])
            if edits <= k and edits < best.get((t, i), (k + 1, 0))[0]:
                best[t, i] = (edits, begin + end - int(at[t]))
        return [(t, self.items[i][0], edits, len(self.items[i][1]), end) for (t, i), (edits, end) in sorted(best.items())]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Fewest edits between ``pattern`` and any part of ``text``, and where the first such part ends."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    high = 1 << len(pattern) - 1
    up, down, score = full, 0, len(pattern)
    best, end = score, 0
    for i, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = plus << 1 & full
        up = (minus << 1 | ~(vertical | plus)) & full
        down = plus & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def _searcher(key: str, items: list[tuple[int, str]], rate: float) -> Searcher:
    return resident(f"searcher {key}", lambda: Searcher(items, rate))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, edits, item_chars, end_at)``: items that occur in documents within the budget.

    ``edits`` is the fewest over all passages and ``end_at`` where one ends, in the
    normalised text.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    lots = max(1, -(-items.count() // LOT))
    out = docs.sparkSession.createDataFrame([], DDL)
    for lot in range(lots):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot).collect()
        held = sorted((r.item_id, r.text) for r in rows)
        key = hashlib.sha256(repr((held, rate)).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            own = _searcher(key, held, rate)
            for part in chunks(batches, "text", 1 << 20):
                data, offsets = text_bytes(part["text"])
                raw = data.tobytes()
                texts = [raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace") for i in range(len(offsets) - 1)]
                points, at = normalised(texts)
                found = own.search(points, at)
                ids = part["doc_id"].to_pylist()
                columns = list(zip(*[(ids[t], *rest) for t, *rest in found])) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

        found = docs.mapInArrow(run, DDL)
        out = found if lots == 1 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id has no benchmark passage; null ids stay."""
    bad = contaminated(docs, benchmark, rate, doc_id, text=text).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(bounded_broadcast(cut_lineage(bad)), doc_id, "left_anti").select(*docs.columns)
