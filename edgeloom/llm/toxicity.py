"""Toxicity scores from a learned lexicon, matched through typing errors and read in context.

Method. Terms that mark toxic rows are learned from labelled rows and kept in a
trie. The trie is intersected with Levenshtein automata: a state holds all
(trie node, edits) pairs a word prefix can reach, and the reachable states are
compiled into one table, through which all words of a chunk run side by side. A
hit then looks at a window of words around it: inside quotation marks, on a
quoted line, or beside a word of reporting, it counts as quotation, otherwise as
abuse. A logistic model over both kinds of evidence gives the score.

Bounds. Lexicon and model are fitted on about ``sample_rows`` labelled rows with
different texts, drawn by a digest of their id; the lexicon keeps the ``TERMS``
strongest terms. Terms of ``FUZZY_FROM`` characters or more match with one edit.

Defined results. Null and empty texts get the score of a text without hits. With
no toxic or no clean labelled row every score is the toxic share (0 without any
row). Every row gets its own result, repeated ones too; an empty table gives an
empty result. Labels of several rows for one document count as toxic if any
does; null labels are ignored. Only id, text and label columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.byte_bpe import NUMBER, character_kinds
from edgeloom.llm.bytestrings import text_bytes
from edgeloom.llm.columns import chunks, resident
from edgeloom.session import cut_lineage

TERMS = 300
FUZZY_FROM = 5
WINDOW = 6
#: Words of reporting, a fixed list.
REPORTING = ("said", "says", "quote", "quoted", "quoting", "called", "wrote", "writes", "term", "word",
             "sagte", "schrieb", "zitat", "wort", "dit", "citation", "mot", "dijo", "cita", "palabra")
OPENING, CLOSING, EITHER = "“«„‹", "”»“›", "\""
MARKS, LEADING = re.compile(f"[{OPENING}{CLOSING}{EITHER}]"), re.compile(r"\s*>")
FEATURES = ("abuse", "quoted", "terms", "density")
SCHEMA = pa.schema([("doc_id", pa.int64()), *[(name, pa.float64()) for name in FEATURES]])
DDL = "doc_id bigint, " + ", ".join(f"{name} double" for name in FEATURES)


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    near_weights: tuple[float, ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    intercept: float
    coefficients: tuple[float, ...]


class Automaton:
    """Trie of the terms intersected with Levenshtein automata, as one transition table."""

    def __init__(self, lexicon: Lexicon):
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        room = [0]  # most edits that any term below a node allows
        for number, term in enumerate(lexicon.terms):
            edits = int(len(term) >= FUZZY_FROM)
            node = 0
            room[0] = max(room[0], edits)
            for letter in term:
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    room.append(0)
                node = children[node][letter]
                room[node] = max(room[node], edits)
            ends[node] = number
        letters = sorted({c for term in lexicon.terms for c in term})
        self.width = len(letters) + 1
        self.codes = np.zeros(0x110000, np.uint8 if self.width < 256 else np.uint16)
        for i, letter in enumerate(letters):
            self.codes[ord(letter)] = i + 1
        self.longest = max(map(len, lexicon.terms), default=0) + 1

        def closed(pairs: dict[int, int]) -> frozenset:
            """Adds what skipping letters of a term reaches; keeps the fewest edits of a node."""
            stack = list(pairs)
            while stack:
                node = stack.pop()
                for child in children[node].values():
                    if pairs[node] + 1 <= room[child] and pairs.get(child, 9) > pairs[node] + 1:
                        pairs[child] = pairs[node] + 1
                        stack.append(child)
            return frozenset(pairs.items())

        def step(state: frozenset, letter: str | None) -> frozenset:
            out: dict[int, int] = {}
            for node, edits in state:
                for name, child in children[node].items():
                    cost = edits + (name != letter)
                    if cost <= room[child]:
                        out[child] = min(out.get(child, 9), cost)
                if edits + 1 <= room[node]:
                    out[node] = min(out.get(node, 9), edits + 1)
            return closed(out)

        start = closed({0: 0})
        states = {frozenset(): 0, start: 1}
        todo, rows = [start], {0: [0] * self.width}
        while todo:
            state = todo.pop()
            row = []
            for letter in [None, *letters]:
                target = step(state, letter)
                if target not in states:
                    states[target] = len(states)
                    todo.append(target)
                row.append(states[target])
            rows[states[state]] = row
        self.table = np.array([rows[i] for i in range(len(states))], np.int32).ravel() * self.width
        self.accepts = np.full(len(states), -1, np.int32)
        self.edits = np.zeros(len(states), np.int8)
        for state, number in states.items():
            hits = [(edits, -lexicon.weights[ends[node]], ends[node]) for node, edits in state
                    if node in ends and edits <= int(len(lexicon.terms[ends[node]]) >= FUZZY_FROM)]
            if hits:
                self.edits[number], _, self.accepts[number] = min(hits)

    def match(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that match: their numbers, terms and edits."""
        code = self.codes[points]
        size = end - start
        word = np.flatnonzero(size <= self.longest)
        state = np.full(len(word), self.width, np.int32)
        found_word, found_state = [], []
        for t in range(self.longest):
            if not len(word):
                break
            state = self.table[state + code[start[word] + t]]
            done = size[word] == t + 1
            hit = done & (self.accepts[state // self.width] >= 0)
            found_word.append(word[hit])
            found_state.append(state[hit] // self.width)
            keep = ~done & (state > 0)
            word, state = word[keep], state[keep]
        if not found_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)
        word, state = np.concatenate(found_word), np.concatenate(found_state)
        order = np.argsort(word)
        return word[order], self.accepts[state[order]], self.edits[state[order]]


class Line:
    """Quotation marks of one line, found once for all of its hits."""

    def __init__(self, text: str, inside: int):
        self.start = text.rfind("\n", 0, inside) + 1
        end = text.find("\n", inside)
        self.end = len(text) if end < 0 else end
        first = LEADING.match(text, self.start, self.end)
        self.quoted_after = first.end() if first else self.end + 1
        self.marks: dict[str, list[int]] = {}
        for found in MARKS.finditer(text, self.start, self.end):
            self.marks.setdefault(found.group(), []).append(found.start())

    def before(self, mark: str, at: int) -> int:
        return bisect_left(self.marks.get(mark, ()), at)

    def last(self, mark: str, at: int) -> int:
        count = self.before(mark, at)
        return self.marks[mark][count - 1] if count else -1

    def after(self, mark: str, at: int) -> bool:
        return self.before(mark, at) < len(self.marks.get(mark, ()))


def _near(text: str, low: int, high: int, backward: bool) -> list[str]:
    """The last or first ``WINDOW`` words of a stretch, read from its end no further than they need."""
    size = 64
    while True:
        part = text[max(low, high - size):high] if backward else text[low:min(high, low + size)]
        words = part.split()
        if len(words) > WINDOW or size >= high - low:  # the word at the cut may be a part
            return words[-WINDOW:] if backward else words[:WINDOW]
        size *= 4


def _is_quoted(text: str, start: int, end: int, line: Line) -> bool:
    """Whether a hit is quotation, by its whole line's marks and the words around it."""
    if line.quoted_after <= start:
        return True
    if any(line.before(mark, start) % 2 and line.after(mark, end) for mark in EITHER):
        return True
    if any(line.last(o, start) > line.last(c, start) and line.after(c, end) for o in OPENING for c in CLOSING):
        return True
    near = _near(text, line.start, start, True) + _near(text, end, line.end, False)
    return any(w.strip(".,;:!?()'") in REPORTING for w in near)


def _automaton(lexicon: Lexicon, key: str) -> Automaton:
    return resident(f"automaton {key}", lambda: Automaton(lexicon))


class Hits:
    """Words of a chunk of texts that match a term, and the lowered texts."""

    def __init__(self, part: pa.Table, own: Automaton):
        data, offsets = text_bytes(part["text"])
        self.n = len(offsets) - 1
        raw = data.tobytes()
        self.lowered = [raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace").lower() for i in range(self.n)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in self.lowered])]).astype(np.int64)
        points = np.frombuffer("".join(self.lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.append(character_kinds()[points] <= NUMBER, False)
        turn = np.zeros(len(points) + 1, bool)
        turn[1:] = inside[1:] != inside[:-1]
        turn[at] = True
        edges = np.flatnonzero(turn)
        keep = inside[edges]
        start, end = edges[keep], edges[1:][keep[:-1]]
        word, self.term, self.edits = own.match(points, start, end)
        self.doc = np.searchsorted(at, start[word], side="right") - 1
        self.start, self.end = start[word] - at[self.doc], end[word] - at[self.doc]
        self.words = np.bincount(np.searchsorted(at, start, side="right") - 1, minlength=self.n)


def _measured(part: pa.Table, own: Automaton, lexicon: Lexicon) -> pa.RecordBatch:
    hits = Hits(part, own)
    features = np.zeros((hits.n, len(FEATURES)))
    seen: set[tuple[int, int]] = set()
    line, owner = None, -1
    for d, t, e, start, end in zip(*(x.tolist() for x in (hits.doc, hits.term, hits.edits, hits.start, hits.end))):
        weight = lexicon.near_weights[t] if e else lexicon.weights[t]
        if weight <= 0:
            continue
        if line is None or owner != d or start >= line.end:  # hits come in order
            line, owner = Line(hits.lowered[d], start), d
        quoted = _is_quoted(hits.lowered[d], start, end, line)
        features[d, int(quoted)] += weight
        if not quoted and (d, t) not in seen:
            seen.add((d, t))
            features[d, 2] += 1
    features[:, 3] = features[:, 0] / np.sqrt(np.maximum(hits.words, 1))
    features = np.log1p(features)
    return pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().cast(pa.int64()), *[pa.array(f) for f in features.T.copy()]], schema=SCHEMA)


def near_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, term)``: terms that a document holds with one edit."""
    key = lexicon.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(lexicon, key)
        for part in chunks(batches, "text", 1 << 20):
            hits = Hits(part, own)
            ids = part["doc_id"].to_numpy()
            pairs = sorted({(int(ids[d]), t) for d, t, e in zip(hits.doc.tolist(), hits.term.tolist(), hits.edits.tolist()) if e})
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.int32())], ["doc_id", "term"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, term int")


def evidence(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Summed weights of hits in abuse and in quotation, different terms and density, logged, for every document."""
    key = lexicon.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(lexicon, key)
        for part in chunks(batches, "text", 1 << 20):
            yield _measured(part, own, lexicon)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DDL)


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from about ``sample_rows`` of the labelled rows that ``train`` selects."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where("y is not null and doc_id is not null").where(
        train).groupBy("doc_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    total = marked.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    drawn = marked.where(draw < F.lit(int((1 << 30) * min(1.0, sample_rows / max(total, 1)))))
    # At most about sample_rows narrow rows.
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id").where("text is not null")
    sample = sample.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    sample = cut_lineage(sample.select("doc_id", "y", "text"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    words = sample.select("y", half, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("word"))
    rows = sample.groupBy("y").count().collect()
    size = {r["y"]: r["count"] for r in rows}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        share = bad / max(bad + good, 1)
        return Model(Lexicon((), (), ()), float(np.log(share / (1 - share))) if 0 < share < 1 else (50.0 if share else -50.0), (0.0,) * len(FEATURES))
    # A term must stand out in both halves of the sample, so a chance word of one half falls out.
    odds = lambda x, y: F.log((F.col(x) + 0.5) / F.lit(bad / 2 + 1.0)) - F.log((F.col(y) + 0.5) / F.lit(good / 2 + 1.0))
    of = lambda half, y: F.sum(F.when((F.col("half") == half) & (F.col("y") == y), 1).otherwise(0))
    counts = words.where(F.length("word") >= 3).groupBy("word").agg(
        of(0, 1).alias("bad0"), of(1, 1).alias("bad1"), of(0, 0).alias("good0"), of(1, 0).alias("good1"))
    least = max(2, bad // 200)
    strong = counts.where((F.least("bad0", "bad1") >= least) & (F.least(odds("bad0", "good0"), odds("bad1", "good1")) > 1.5)).select(
        "word", ((odds("bad0", "good0") + odds("bad1", "good1")) / 2).alias("odds"))
    terms = strong.orderBy(F.desc("odds"), "word").limit(TERMS).collect()
    lexicon = Lexicon(tuple(r["word"] for r in terms), tuple(round(r["odds"], 6) for r in terms), (0.0,) * len(terms))
    # A near hit counts for as much as its term's near hits tell toxic from clean rows, at most as an exact one.
    met = near_hits(sample, lexicon).join(sample.select("doc_id", "y"), "doc_id").groupBy("term").agg(
        F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).collect()
    near = {r["term"]: (r["bad"], r["good"]) for r in met}
    worth = [math.log((near.get(i, (0, 0))[0] + 0.5) / (bad + 1)) - math.log((near.get(i, (0, 0))[1] + 0.5) / (good + 1)) for i in range(len(terms))]
    lexicon = Lexicon(lexicon.terms, lexicon.weights, tuple(round(max(0.0, min(w, x)), 6) for w, x in zip(worth, lexicon.weights)))
    table = evidence(sample, lexicon).join(sample.select("doc_id", "y"), "doc_id").toPandas().sort_values("doc_id")
    x, y = table[list(FEATURES)].to_numpy(), table["y"].to_numpy().astype(float)
    intercept, *coefficients = _logistic(x, y)
    return Model(lexicon, intercept, tuple(coefficients))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - shrink * beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(hessian, gradient)
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return [float(b) for b in beta]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` and the evidence, one row for every document."""
    logit = F.lit(model.intercept)
    for name, weight in zip(FEATURES, model.coefficients):
        logit = logit + F.lit(weight) * F.col(name)
    rows = evidence(docs, model.lexicon, doc_id, text).withColumn("score", 1 / (1 + F.exp(-logit)))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)
