"""Byte-level BPE by merge replay over the distinct words of many texts.

Method. Texts are cut into words as the pre-tokenising pattern cuts them. The
distinct words of a whole batch are encoded together: an inverted index leads
from a mergeable pair to the positions that hold it, merges are replayed in rank
order, and only the neighbours of a merged position get new index entries. A
worker keeps the words it has encoded, up to a bound, so later batches replay
new words only. Decoding joins the bytes of the ids.

A pair is merged wherever it occurs as long as no token that begins or ends with
the merged one has a lower rank; for the few pairs where one does, occurrences
are replayed one per word and the index is consulted again in between, which is
the order of an encoder that always takes the lowest, leftmost pair.

Defined results. A null text is empty: no ids, and the digests of empty strings.
Repeated rows are encoded each. Any text length is handled; texts are cut into
chunks only between rows. An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytestrings import digests as string_digests
from edgeloom.llm.bytestrings import ragged, text_bytes
from edgeloom.llm.columns import chunks, resident

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Words a worker keeps encoded, and bytes of text handled at a time.
KEPT_WORDS = 600_000
PIECE = 1 << 20
#: Bytes of text whose distinct words are replayed together.
LOT = 3 << 20


@lru_cache(1)
def character_kinds() -> np.ndarray:
    """Kind of every code point, by the Unicode tables of the tokenizer library."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    plain = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        matches = tiktoken.Encoding(f"kind{kind}", pat_str=pattern, mergeable_ranks=plain, special_tokens={})
        found = bytes(matches.encode_ordinary(text)).decode()
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return kinds


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks where the pattern's matches begin; ``first`` marks where texts begin."""
    kind = character_kinds()[points]
    n = len(points)
    turn = np.empty(n, bool)
    turn[0] = True
    turn[1:] = kind[1:] != kind[:-1]
    turn |= first
    starts = turn.copy()
    # The last space before a word starts a match: as the word's prefix if it is a blank, alone otherwise.
    after = np.flatnonzero(turn & (kind != SPACE) & ~first)
    after = after[kind[after - 1] == SPACE]
    starts[after - 1] = True
    blank = after[points[after - 1] == 0x20]
    starts[blank] = False
    # Contractions, where an apostrophe starts a match.
    quote = np.flatnonzero((points == 0x27) & starts)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        ends = np.concatenate([first, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        open1 = ~ends[quote + 1]
        open2 = open1 & ~ends[quote + 2]
        pair = lambda a, b: (one == ord(a)) & (two == ord(b)) & open2
        long = pair("r", "e") | pair("v", "e") | pair("l", "l")
        short = np.isin(one, [ord(c) for c in "stmd"]) & open1
        for where, size in ((quote[short], 2), (quote[long & ~short], 3)):
            starts[where + 1] = False
            rest = where + size
            rest = rest[rest < n]
            inner = rest[(kind[rest] == LETTER)]
            starts[inner] = True
    return starts


class Vocabulary:
    """Ranks of a byte-level vocabulary and what replaying needs of them."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values, unsafe = [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
                # A part with a higher rank than the whole: once merged, the whole comes first.
                unsafe.update(part for part in (left, right) if part is not None and part > rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.unsafe = unsafe
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at, self.token_size = np.cumsum(lengths) - lengths, lengths
        decimals = [b"%d," % i for i in range(size)]
        self.decimal_size = np.array([len(d) for d in decimals], np.int64)
        self.decimal_at = np.cumsum(self.decimal_size) - self.decimal_size
        self.decimal_bytes = np.frombuffer(b"".join(decimals), np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def replay(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie end to end in ``data``, and how many each word has."""
        n = len(data)
        symbol = self.single[data]
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        last = np.cumsum(sizes) - 1
        after[last] = n
        before[last + 1 - sizes] = -1
        alive = np.ones(n + 1, bool)
        rank = np.full(n, -1, np.int32)
        has = np.flatnonzero(after < n)
        rank[has] = self.pair_rank(symbol[has], symbol[after[has]])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] >= 0]
            if not len(at):
                return
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            names = rank[at]
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for name, group in zip(names[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if name in index:
                    index[name].append(group)
                else:
                    index[name] = [group]
                    heapq.heappush(queue, name)

        enter(has)
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[(rank[at] == r) & alive[at]]
            if not len(at):
                continue
            if r in self.unsafe:
                once = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                rest = at[~once]
                at = at[once]
                if len(rest):
                    index[r] = [rest]
                    heapq.heappush(queue, r)
            elif len(at) > 1:
                at = _apart(at, after)
            right = after[at]
            following = after[right]
            symbol[at] = r
            alive[right] = False
            rank[right] = -1
            after[at] = following
            inner = following < n
            before[following[inner]] = at[inner]
            rank[at] = -1
            left = before[at]
            left = left[left >= 0]
            touched = np.unique(np.concatenate([at[inner], left]))
            rank[touched] = self.pair_rank(symbol[touched], symbol[after[touched]])
            enter(touched)
        keep = alive[:n]
        return symbol[keep].astype(np.int32), np.bincount(word[keep], minlength=len(sizes))


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Sorted positions without those that the pair at the position before takes up."""
    tied = np.zeros(len(at), bool)
    tied[1:] = after[at[:-1]] == at[1:]
    if not tied.any():
        return at
    place = np.arange(len(at))
    head = np.maximum.accumulate(np.where(tied, 0, place))
    return at[(place - head) % 2 == 0]


@dataclass
class Piece:
    """A chunk of texts as codes of its distinct words, with a digest of each."""

    names: np.ndarray
    word_bytes: np.ndarray
    word_sizes: np.ndarray
    code: np.ndarray
    text_at: np.ndarray


def cut_words(data: np.ndarray, offsets: np.ndarray) -> Piece:
    if not len(data):
        return Piece(np.zeros(0, np.uint64), data, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(offsets), np.int64))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.flatnonzero((data & 0xC0) != 0x80)
    is_first = np.zeros(len(data) + 1, bool)
    is_first[offsets] = True
    begins = np.append(byte_at[word_starts(points, is_first[:-1][byte_at])], len(data))
    named = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    words = named.dictionary.to_pylist()
    return Piece(string_digests(words), np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)),
                 named.indices.to_numpy(), np.searchsorted(begins[:-1], offsets))


class Encoder:
    """Encodes batches of texts, keeping the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _place(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.names, names)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == names[known]
        return at, known

    def learn(self, pieces: list[Piece]) -> None:
        """Replays the merges over all words of the pieces that are not kept yet."""
        names, first = np.unique(np.concatenate([p.names for p in pieces]), return_index=True)
        sizes = np.concatenate([p.word_sizes for p in pieces])
        at = (np.cumsum(sizes) - sizes)[first]
        sizes = sizes[first]
        new = ~self._place(names)[1]
        if len(self.names) + int(new.sum()) > KEPT_WORDS:
            self.forget()
            new[:] = True
        if not new.any():
            return
        data = np.concatenate([p.word_bytes for p in pieces])
        ids, counts = self.vocabulary.replay(data[ragged(at[new], sizes[new])], sizes[new])
        names = np.concatenate([self.names, names[new]])
        at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts) - counts])
        size = np.concatenate([self.size, counts])
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(names, kind="stable")
        self.names, self.at, self.size = names[order], at[order], size[order]

    def ids_of(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a learnt piece's texts end to end, and each text's offsets in them."""
        at, _ = self._place(piece.names)
        counts = self.size[at][piece.code]
        ids = self.ids[ragged(self.at[at][piece.code], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[piece.text_at]

    def alone(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts whose words are replayed in place, none told by its digest."""
        self.forget()
        found = []
        for i in range(len(offsets) - 1):
            piece = cut_words(data[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            if not len(piece.word_sizes):
                found.append(np.zeros(0, np.int32))
                continue
            ids, counts = self.vocabulary.replay(piece.word_bytes, piece.word_sizes)
            found.append(ids[ragged((np.cumsum(counts) - counts)[piece.code], counts[piece.code])])
        return np.concatenate(found), np.cumsum([0] + [len(x) for x in found])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids end to end, and how many bytes each id has."""
        sizes = self.vocabulary.token_size[ids]
        return self.vocabulary.token_bytes[ragged(self.vocabulary.token_at[ids], sizes)], sizes

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal, each followed by a comma, and how many bytes each takes."""
        sizes = self.vocabulary.decimal_size[ids]
        return self.vocabulary.decimal_bytes[ragged(self.vocabulary.decimal_at[ids], sizes)], sizes


def encoder(path: str) -> Encoder:
    return resident(f"encoder {path}", lambda: Encoder(Vocabulary(path)))


def digests(coder: Encoder, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[str], list[bool]]:
    """Digests of ids and of decoded bytes, and whether decoding gave each text back."""
    texts, widths = coder.decode(ids)
    commas, digits = coder.decimals(ids)
    text_at = np.concatenate([[0], np.cumsum(widths)])[at]
    comma_at = np.concatenate([[0], np.cumsum(digits)])[at]
    texts, commas, original = memoryview(texts), memoryview(commas), memoryview(np.ascontiguousarray(data))
    id_sums, text_sums, same = [], [], []
    for i in range(len(offsets) - 1):
        id_sums.append(hashlib.sha256(commas[comma_at[i]:max(comma_at[i], comma_at[i + 1] - 1)]).hexdigest())
        part = texts[text_at[i]:text_at[i + 1]]
        text_sums.append(hashlib.sha256(part).hexdigest())
        same.append(part == original[offsets[i]:offsets[i + 1]])
    return id_sums, text_sums, same


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, lossless[, ids])``, one row for every document.

    ``path`` is the vocabulary file; it must be there on every executor, as the
    library that brings it is.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())]
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for lot in chunks(batches, "text", LOT):
            parts = list(chunks(lot.to_batches(), "text", PIECE, tidy=False))
            pieces = [cut_words(*text_bytes(part["text"])) for part in parts]
            coder.learn(pieces)
            for part, piece in zip(parts, pieces):
                data, offsets = text_bytes(part["text"])
                ids, at = coder.ids_of(piece)
                id_sums, text_sums, same = digests(coder, ids, at, data, offsets)
                if not all(same):  # words of equal digest met: no word of other texts is used
                    ids, at = coder.alone(data, offsets)
                    id_sums, text_sums, same = digests(coder, ids, at, data, offsets)
                columns = [part["doc_id"].combine_chunks().cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(id_sums, pa.string()),
                           pa.array(text_sums, pa.string()), pa.array(same, pa.bool_())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)
