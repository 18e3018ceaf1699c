"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

CLASHING = "key string, digest string, row string, doc bigint, component string, n bigint"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING


def docs(spark, texts, first=0, langs=None):
    rows = [(first + i, t, langs[i] if langs else None, None, None if t is None else len(t), "k", None, "r", 7, "c", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(random.Random(f"w{i}").choice("abcdefghij") for _ in range(3 + i % 6)) for i in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))


def thue_morse(bits=10):
    """A word of a and b and its complement: equal under any polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
