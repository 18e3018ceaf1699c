"""Language, toxicity, tokens, benchmark passages and repeated strings against brute force."""

import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import docs, prose, thue_morse
from pyspark.sql import functions as F

from edgeloom.llm import byte_bpe, bytestrings, decontamination, language_id, suffix_dedup, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language(name, seed, words):
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["zar", "eno", "vik", "ulm"], "cc": ["éa", "où", "çi", "nê"]}[name]
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def parsed(text, sample):
    """Phrases of the longest-match parse, block by block, by substring search."""
    count = 0
    for at in range(0, len(text), language_id.BLOCK):
        block, i = text[at:at + language_id.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i:j + 1] in sample:
                j += 1
            count, i = count + 1, j
    return count


def test_language_matches_naive_parse(spark):
    texts = [language(n, i, 80 if i % 5 else 900) for i in range(12) for n in ("aa", "bb", "cc")]
    langs = ["aa", "bb", "cc"] * 12
    table = docs(spark, texts, langs=langs)
    model = language_id.fit(table, F.col("doc_id") % 4 != 0, sample_chars=2000)
    odd = [None, "", "123 .. !", "Ω", "KALO zar", "x" * 30_000]
    every = table.unionByName(docs(spark, odd, 1000)).unionByName(docs(spark, texts[:2]))
    got = {r.doc_id: r for r in language_id.identify(every, model).collect()}
    assert [got[i].lang_pred for i in range(36)] == langs
    assert [got[1000 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    codes = language_id._code_table(model.alphabet)
    for i, text in list(enumerate(texts))[:9] + [(1003, odd[3]), (1004, odd[4])]:
        points = np.array([ord(c) for c in text.lower()], np.uint32)
        code = language_id._codes(points, codes, np.zeros(len(points), bool))[0].tobytes()
        entropy = [parsed(code, s) * math.log2(len(s)) / len(code) for s in model.samples]
        low, second = sorted(entropy)[:2]
        assert got[i].score == pytest.approx(1 - low / second, abs=1e-9)
    kept = language_id.keep_identified(every, model)
    assert kept.columns == every.columns
    assert {r.doc_id for r in kept.collect()} == set(range(36)) | {1004}
    assert language_id.identify(every.limit(0), model).count() == 0
    unlearnt = language_id.fit(docs(spark, ["kalo"]), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(every, unlearnt).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(2)
    terms = ("stupid", "idiot", "scum", "moron", "idiots", "abcab")
    own = toxicity.Automaton(toxicity.Lexicon(terms, tuple(range(6, 0, -1)), (1.0,) * 6))
    words = [*terms, *["".join(rng.choice("abcdiotsumr") for _ in range(rng.randint(1, 8))) for _ in range(3000)]]
    for t in terms:
        for i in range(len(t) + 1):
            words += [t[:i] + t[i + 1:], t[:i] + "x" + t[i:], t[:i] + "o" + t[i + 1:]]
    words = [w for w in words if w]
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    end = np.cumsum([len(w) for w in words])
    found = {w: int(e) for w, e in zip(*(x.tolist() for x in own.match(points, end - [len(w) for w in words], end)[::2]))}
    for i, w in enumerate(words):
        fits = [distance(w, t) for t in terms if distance(w, t) <= (len(t) >= toxicity.FUZZY_FROM)]
        assert found.get(i) == (min(fits) if fits else None), w


def test_toxicity_tells_abuse_from_quotation(spark):
    texts = [prose(i, 40) + (" you idiot you moron" if i % 4 == 0 else "") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(240)] + [(0, None, "x")], "doc_id bigint, toxic int, text string")
    model = toxicity.fit(docs(spark, texts), labels, F.col("doc_id") < 200)
    assert {"idiot", "moron"} <= set(model.lexicon.terms)
    asked = [texts[204], texts[205], "what an idiott", 'they said "idiot" and "moron" there', None, "", "idiot " * 20_000]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, asked), model).collect()}
    assert got[0].predicted == 1 and got[1].predicted == 0 and got[6].predicted == 1
    assert got[2].abuse > 0 and got[3].abuse == 0 and got[3].quoted > 0
    assert got[4].score == got[5].score and 0 <= got[4].score < 0.5
    none = toxicity.fit(docs(spark, texts), labels.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs(spark, asked), none).collect()} == {0}
    assert toxicity.score(docs(spark, asked).limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    from edgeloom.llm.columns import fold_of, read

    sf = "/root/testdata/sf0.1"
    table, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    scored = toxicity.score(table, toxicity.fit(table, labels, fold_of() != 0))
    rows = scored.where(fold_of() == 0).join(labels, "doc_id").select("score", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.93


def reference_encoder():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_quoted(text, start, end):
    """Whether a hit is quotation, by counting marks of the whole line."""
    begin, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    before, after = text[begin:start], text[end:len(text) if stop < 0 else stop]
    near = before.split()[-6:] + after.split()[:6]
    return (before.lstrip().startswith(">") or (before.count('"') % 2 == 1 and '"' in after)
            or any(before.rfind(o) > before.rfind(c) and c in after for o in toxicity.OPENING for c in toxicity.CLOSING)
            or any(w.strip(".,;:!?()'") in toxicity.REPORTING for w in near))


def test_quotation_counts_whole_lines():
    rng = random.Random(4)
    for _ in range(400):
        parts = [rng.choice(["abc", "x" * 70, '"', "“ ", "” ", "»", "«", "\n", "\n> ", " said ", " > ", " word, "]) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(parts))
        head, tail = "".join(parts[:at]), "".join(parts[at:])
        text, start, end = head + "HIT" + tail, len(head), len(head) + 3
        assert toxicity._is_quoted(text, start, end, toxicity.Line(text, start)) == plain_quoted(text, start, end), text


def test_tokens_match_the_library(spark):
    rng = random.Random(1)
    texts = [None, "", "don't we'll I've 'tis 's 'S''s \n's  's a'", "   ", " \n\n  x", "a  b", "a" * 3000, "!" * 999, "abab" * 300, " " * 5000,
             "日本語 ١٢٣ ½", "🙂🙂👨‍👩‍👧", "''ll x'll're've'd", "1'st 2're", "a  b　", prose(3, 5000)]
    texts += ["".join(rng.choice("ab 'stremvld\néß1½ !.日🙂  ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    table = docs(spark, texts)
    coder = reference_encoder()
    rows = {r.doc_id: r for r in byte_bpe.encode_documents(table.unionByName(docs(spark, texts[:3])), PATH, keep_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = coder.encode_ordinary(text or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids), repr(text)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and rows[i].lossless
    assert byte_bpe.encode_documents(table.limit(0), PATH).count() == 0


def test_tokens_of_words_that_weak_hashes_confuse(spark):
    texts = list(thue_morse())
    coder = reference_encoder()
    rows = {r.doc_id: r for r in byte_bpe.encode_documents(docs(spark, texts), PATH, keep_ids=True).collect()}
    assert all(rows[i].ids == coder.encode_ordinary(t) and rows[i].lossless for i, t in enumerate(texts))


def test_equal_digests_do_not_change_tokens(spark, monkeypatch):
    texts = ["one two", "", "six ten", None, "two two one"]
    coder = reference_encoder()
    monkeypatch.setattr(byte_bpe, "string_digests", lambda words: np.array([len(w) for w in words], np.uint64))
    encoder = byte_bpe.Encoder(byte_bpe.Vocabulary(PATH))
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t or "") for t in texts])
    piece = byte_bpe.cut_words(data, offsets)
    encoder.learn([piece])
    assert not all(byte_bpe.digests(encoder, *encoder.ids_of(piece), data, offsets)[2])
    ids, at = encoder.alone(data, offsets)
    assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == [coder.encode_ordinary(t or "") for t in texts]


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(4)
    for length in (1, 2, 7, 64, 400):
        data = np.concatenate([rng.integers(97, 99, 900).astype(np.uint8), np.frombuffer("".join(thue_morse()).encode(), np.uint8)])
        hashed = bytestrings.window_hashes(data, length)
        strings = [data[i:i + length].tobytes() for i in range(len(data) - length + 1)]
        assert len(hashed) == len(strings) and len(set(hashed.tolist())) == len(set(strings))
        assert dict(zip(strings, hashed.tolist())) == {s: h for s, h in zip(strings, hashed.tolist())}


def test_short_benchmark_items_are_found_unchanged(spark):
    items = [(1, "Ab-c d"), (2, "yes"), (3, "是的"), (4, " !! "), (5, "ab c d"), (6, None), (7, "x" * 30)]
    texts = ["so: AB  c, D!", "abc d", "yes", "Yes. no", "yesterday", "是的。", "不是的", None, "", "end ab c", "d yes yes", "ab c", "d"]
    table = docs(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.item_chars, r.end_at) for r in decontamination.contaminated(table, benchmark).collect())
    assert got == [(0, 1, 0, 6, 9), (0, 5, 0, 6, 9), (2, 2, 0, 3, 3), (3, 2, 0, 3, 3), (5, 3, 0, 2, 2), (10, 2, 0, 3, 5)]


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for j, p in enumerate(pattern, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != p))
        best = min(best, row[-1])
    return best


def plain(text):
    points, _ = decontamination.normalised([text])
    return "".join(map(chr, points[:-1])).strip()


def test_benchmark_passages_match_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(300 + i, 12 + 3 * i)) for i in range(8)] + [(20, None), (21, ""), (22, "!?"), (23, prose(300, 12))]
    texts = [None, "", prose(1, 9000)]
    for number, text in items[:8]:
        for edits in (0, 3, 6, 9, 14):
            letters = list(text.upper() if edits == 3 else text)
            for _ in range(edits):
                at = rng.randrange(len(letters))
                letters[at:at + 1] = rng.choice(["", "x", "y" + letters[at]])
            texts.append(prose(rng.random(), 15) + ", " + "".join(letters) + " " + prose(rng.random(), 15))
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, edits string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(docs(spark, texts), table).collect()}
    want = {}
    for d, text in enumerate(texts):
        for number, item in items:
            if item and len(plain(item)) >= decontamination.SHORTEST and text and len(text) < 9000:
                edits = sellers(plain(item), plain(text))
                if edits <= int(decontamination.RATE * len(plain(item))):
                    want[d, number] = edits
    assert got == want and len(want) > 15
    kept = decontamination.drop_contaminated(docs(spark, texts), table)
    assert kept.columns == docs(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contaminated(docs(spark, texts), table.limit(0)).count() == 0
    assert decontamination.contaminated(docs(spark, texts).limit(0), table).count() == 0


def removed(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("widest", [3 << 20, 1500])
def test_repeated_strings_match_brute_force(spark, monkeypatch, widest):
    monkeypatch.setattr(suffix_dedup, "WIDEST", widest)
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 150))) for _ in range(20)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(60)] + [None, "", "a" * 300, "xy" * 200, "z" * 39, prose(8, 3000)]
    texts += texts[:3]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated(docs(spark, texts), 40, 8).collect()}
    assert got == dict(enumerate(removed([(t or "").encode() for t in texts], 40)))
    assert suffix_dedup.remove_repeated(docs(spark, texts).limit(0), 40, 8).count() == 0


def test_shared_passages(spark):
    """Two texts with 50 words in common share a stretch; texts without 26 in common share none; short ones never do."""
    passage = prose(77, 50)
    texts = [prose(1, 300) + " " + passage + " " + prose(2, 40), passage + " end", prose(3, 400), prose(4, 49), prose(4, 49), None, "", "\n".join([prose(5, 100)] * 2),
             prose(6, 60), prose(6, 60), prose(7, 30) + " " + prose(77, 25) + " " + prose(8, 30)]
    got = {r.doc_id: r.n_shared for r in suffix_dedup.remove_repeated(docs(spark, texts)).collect()}
    assert [i for i, n in sorted(got.items()) if n] == [0, 1, 8, 9] and len(got) == len(texts)


def test_expansion_finds_repeats_of_every_length():
    rng = random.Random(5)
    for length in (5, 8, 20, 60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 120))) for _ in range(8)] + [b"a" * 70, b"ab" * 40]
        symbols = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, 0) for t in texts]).astype(np.uint16)
        flags, at = suffix_dedup.repeated_positions(symbols, length), 0
        windows = [t[i:i + length] for t in texts for i in range(len(t) - length + 1)]
        for t in texts:
            for i in range(len(t) - length + 1):
                assert flags[at + i] == (windows.count(t[i:i + length]) > 1)
            at += len(t) + 1
