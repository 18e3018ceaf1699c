"""Language identification by cross-parsing entropy.

Method. A suffix automaton is built per language from a sample of labelled text.
A text is parsed greedily into the longest phrases that occur in the sample; the
number of phrases times the bits that name a position in the sample, per
character, is the cross entropy. The language with the least wins.

Texts are lower-cased, everything but letters becomes one blank, and they are
parsed in blocks of ``BLOCK`` characters, all blocks of a chunk side by side in
all automata, so a very long text costs no more steps than a short one.

Bounds. The model is fitted on at most ``sample_chars`` characters of each
language, from excerpts of at most ``EXCERPT`` characters of rows drawn by a
digest of their id, equal excerpts once. The alphabet is the sample's
``MAX_LETTERS`` most frequent letters; any other letter is a phrase of its own.

Defined results. A null text or one without letters is ``und`` with score 0. The
score is ``1 - best / second`` of the entropies (1 for a sole language); ties go
to the first language by name. Without labelled rows everything is ``und``. Only
the id, text and language columns are read, the language in fitting only; every
row, repeated or not, gets its own result, and an empty table an empty one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.byte_bpe import LETTER, character_kinds
from edgeloom.llm.bytestrings import text_bytes
from edgeloom.llm.columns import chunks, release, resident

BLOCK = 256
EXCERPT = 4000
MAX_LETTERS = 250
UNKNOWN = "und"
#: Mean phrase length under which a text is in none of the languages.
LEAST_PHRASE = 1.5
DDL = "doc_id bigint, lang_pred string, score double, phrase_chars double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("phrase_chars", pa.float64())])


@dataclass(frozen=True)
class Model:
    """Languages, their sample texts as letter codes, and the alphabet."""

    languages: tuple[str, ...]
    samples: tuple[bytes, ...]
    alphabet: str

    @property
    def key(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


def _codes(points: np.ndarray, table: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes with runs of blanks as one, and how many codes precede each point."""
    code = table[points]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    keep |= first
    return code[keep], np.concatenate([[0], np.cumsum(keep)])


def _code_table(alphabet: str) -> np.ndarray:
    """0 for blanks, 1 .. n for the alphabet, n + 1 for other letters."""
    table = np.where(character_kinds() == LETTER, len(alphabet) + 1, 0).astype(np.uint8)
    for i, letter in enumerate(alphabet):
        table[ord(letter)] = i + 1
    return table


def fit(docs: DataFrame, train: Column, sample_chars: int = 50_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows that ``train`` selects, at most ``sample_chars`` a language."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("doc"), F.substring(F.col(text), 1, EXCERPT).alias("excerpt"))
    totals = rows.groupBy("lang").agg(F.sum(F.length("excerpt")).alias("chars"))
    # Languages are a closed list of names, so these rows and the sample are bounded.
    share = F.lit(4.0 * sample_chars) / F.greatest(F.col("chars"), F.lit(1))
    drawn = rows.join(F.broadcast(totals), "lang").withColumn("draw", F.xxhash64(F.col("doc").cast("string"), F.lit("sample"))).where(
        F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "draw", "excerpt").collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(drawn, key=lambda r: (r.lang, r.draw)):
        texts.setdefault(row.lang, []).append(row.excerpt.lower())
    joined = {}
    for name, parts in sorted(texts.items()):
        sample = " ".join(dict.fromkeys(parts))[:sample_chars]
        if any(c.isalpha() for c in sample):
            joined[name] = sample
    kinds = character_kinds()
    letters = Counter(c for sample in joined.values() for c in sample if kinds[ord(c)] == LETTER)
    alphabet = "".join(sorted(c for c, _ in sorted(letters.items(), key=lambda item: (-item[1], item[0]))[:MAX_LETTERS]))
    table = _code_table(alphabet)
    samples = []
    for sample in joined.values():
        points = np.frombuffer(sample.encode("utf-32-le"), np.uint32)
        samples.append(_codes(points, table, np.zeros(len(points), bool))[0].tobytes())
    return Model(tuple(joined), tuple(samples), alphabet)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is its start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def _links(sample: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that a sample's automaton takes in the table, and its transitions as arrays."""
    moves = suffix_automaton(sample)
    source = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
    symbol = np.fromiter((c for m in moves for c in m), np.int64, len(source))
    return len(moves) + 1, source, symbol, np.fromiter((t for m in moves for t in m.values()), np.int64, len(source))


class Parser:
    """All automata in one table: the next row, and whether the character begins a phrase."""

    def __init__(self, model: Model):
        self.model = model
        self.codes = _code_table(model.alphabet)
        width = self.width = len(model.alphabet) + 3  # blank, letters, other letters, padding
        self.pad = width - 1
        links = [_links(sample) for sample in model.samples]
        rows = sum(n for n, _, _, _ in links)
        kind = np.int32 if rows * width * 2 < 2 ** 31 else np.int64
        self.table = np.empty((rows, width), kind)
        self.roots, base = [], 0
        for n, source, symbol, target in links:  # of a language's n rows the first has no open phrase
            table = self.table[base:base + n]
            begin = np.zeros(width, np.int64)
            begin[symbol[source == 0]] = target[source == 0] + 1
            table[:] = (base + begin) * width * 2 + 1
            table[source + 1, symbol] = (base + 1 + target) * width * 2
            table[:, self.pad] = (base + np.arange(n)) * width * 2
            self.roots.append(base * width)
            base += n
        self.table = self.table.ravel()
        self.bits = np.log2([max(len(s), 2) for s in model.samples])

    def phrases(self, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[owner] + within * BLOCK
        end = np.minimum(start + BLOCK, offsets[owner + 1])
        at = start[None, :] + np.arange(BLOCK)[:, None]
        grid = np.where(at < end[None, :], np.append(code, 0)[np.minimum(at, len(code))], self.pad).astype(self.table.dtype)
        out = np.zeros((len(sizes), len(self.roots)), np.int64)
        for l, root in enumerate(self.roots):
            state = np.full(len(owner), root, self.table.dtype)
            count = np.zeros(len(owner), self.table.dtype)
            for step in grid:
                state += step
                state = self.table[state]
                count += state & 1
                state >>= 1
            out[:, l] = np.bincount(owner, weights=count, minlength=len(sizes)).astype(np.int64)
        return out


def parser(model: Model, key: str) -> Parser:
    return resident(f"parser {key}", lambda: Parser(model))


def _identified(part: pa.Table, own: Parser | None, model: Model) -> list[pa.Array]:
    data, offsets = text_bytes(part["text"])
    n = len(offsets) - 1
    best, score, chars = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    open_ = np.zeros(n, bool)
    if own is not None and len(data):
        # Lower-casing can change lengths, so it is done text by text.
        raw = data.tobytes()
        lowered = [raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace").lower() for i in range(n)]
        point_at = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(points) + 1, bool)
        first[point_at] = True
        code, before = _codes(points, own.codes, first[:-1])
        code_at = before[point_at]
        letters = np.concatenate([[0], np.cumsum(code != 0)])
        open_ = np.diff(letters[code_at]) > 0
        phrases = own.phrases(code, code_at)
        sizes = np.maximum(np.diff(code_at), 1)
        entropy = phrases * own.bits[None, :] / sizes[:, None]
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(n), best]
        chars = np.where(open_, sizes / np.maximum(phrases[np.arange(n), best], 1), 0.0)
        if entropy.shape[1] > 1:
            second = np.partition(entropy, 1, axis=1)[:, 1]
            score = np.where(open_, 1.0 - low / np.maximum(second, 1e-12), 0.0)
        else:
            score = open_.astype(float)
    names = [model.languages[b] if o else UNKNOWN for b, o in zip(best, open_)]
    return [part["doc_id"].combine_chunks().cast(pa.int64()), pa.array(names, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(chars)]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, phrase_chars)``: language, confidence, and mean phrase length."""
    key = model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(model, key) if model.languages else None
        for part in chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(_identified(part, own, model), schema=SCHEMA)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DDL)


def keep_identified(docs: DataFrame, model: Model, least_phrase: float = LEAST_PHRASE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language, with all their columns.

    Rejected are texts that are ``und`` and texts whose phrases average under
    ``least_phrase`` characters: no language's sample shares more than chance with them.
    """
    key = model.key
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(model, key) if model.languages else None
        for batch in batches:
            for part in chunks([batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])], f"c{at}", 1 << 20, tidy=False):
                view = pa.table({"doc_id": pa.nulls(part.num_rows, pa.int64()), "text": part[f"c{at}"]})
                _, lang, _, chars = _identified(view, own, model)
                keep = pa.compute.and_(pa.compute.not_equal(lang, UNKNOWN), pa.compute.greater_equal(chars, least_phrase))
                yield from part.filter(keep).rename_columns(batch.schema.names).to_batches()
        release()

    return docs.mapInArrow(run, docs.schema)
