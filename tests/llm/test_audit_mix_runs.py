"""Filter audit, source mixing and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from fixtures import docs, prose
from pyspark.sql import functions as F

from edgeloom.llm import filter_audit, periodic_runs, source_mixing
from edgeloom.llm.registry import op13_basic_factors

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


# Periodic runs.

def naive_runs(words, min_length=6, min_periods=4):
    codes, found = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int), {}
    n = len(words)
    for q in range(1, n // min_periods + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (codes[q:] == codes[:n - q]).view(np.int8), [0]])))
        for a, b in zip(same[::2], same[1::2]):
            if b - a + q >= max(min_length, min_periods * q):
                found.setdefault((int(a), int(b) + q), q)  # periods rise, so the first is the smallest
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words, runs):
    gone = set()
    for start, length, period in runs:
        gone.update(range(start + period, start + length))
    return [w for i, w in enumerate(words) if i not in gone]


def texts_with_runs():
    rng = random.Random(5)
    out = ["", None, "  ", "a", "a " * 6, "a " * 5, "a b " * 4, "A a " * 9, "x" + " y z" * 3 + " y", "é ü " * 7, prose(1, 900) + " " + prose(2, 50) * 1]
    for _ in range(150):
        letters = "abc"[:rng.randint(1, 3)]
        out.append(" ".join(rng.choice(letters) for _ in range(rng.randint(1, 70))))
    for _ in range(40):
        period = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        body = (period * rng.randint(3, 9))[:rng.randint(1, 400)]
        out.append(" ".join([rng.choice("abcd") for _ in range(rng.randint(0, 9))] + body + [rng.choice("abcd") for _ in range(rng.randint(0, 9))] + body))
    out.append("a b a a b " * 20_000)
    return out


def test_runs_equal_brute_force(spark):
    texts = texts_with_runs()
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        want = naive_runs(words) if len(words) < 10_000 else [(0, 100_000, 5)]
        assert [tuple(r) for r in got[i].runs] == want, text
        assert got[i].collapsed == " ".join(collapse(words, want))
        best = min(want, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert (got[i].strongest and tuple(got[i].strongest)) == best


def test_runs_of_empty_table_and_repeated_rows(spark):
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0
    twice = docs(spark, ["a " * 8]).unionByName(docs(spark, ["a " * 8]))
    assert [len(r.runs) for r in periodic_runs.find_runs(twice).collect()] == [1, 1]


def test_runs_query_on_whole_table(spark):
    got = {r.doc_id: r for r in op13_basic_factors(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    tails = 0
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            tails += 1
        runs = naive_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapse(words, runs)).encode()).hexdigest()
    assert tails


# Filter audit.

def test_shapley_weights_equal_marginal_means():
    rng = random.Random(3)
    for m in (2, 3, 5):
        value = [0] + [rng.randint(0, 10 ** 6) for _ in range((1 << m) - 1)]
        orders = list(permutations(range(m)))
        want = [Fraction(0)] * m
        for order in orders:
            before = 0
            for i in order:
                want[i] += Fraction(value[before | 1 << i] - value[before], len(orders))
                before |= 1 << i
        weights, divisor = filter_audit.shapley_weights(m)
        assert [Fraction(sum(w * v for w, v in zip(row, value)), divisor) for row in weights] == want


def failing(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        yield lang or "", i, {k for k, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)), ("E", i is not None and i > least[text])) if bad}


def test_audit_equals_replay(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    texts = [clean, clean, clean + " #", "", None, "A" * 9, "AB é", clean + " " + "a " * 200, clean.upper(), clean, "\t\n", "x|y"]
    langs = ["en", "de", "en", None, "", "en", "en", "de", "de", None, "en", "en"]
    table = docs(spark, texts, langs=langs).unionByName(docs(spark, texts[:4], langs=langs[:4]))
    table = table.unionByName(docs(spark, [clean, ""], langs=["en", "en"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, 1), (7, 1, 1), (7, 1, 1), (99, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    good, toxic = {0, 1, 7}, {1, 2, 7}
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    fails = list(failing(rows))
    got = {(r["part"], r.filter_order, r.step): r for r in filter_audit.audit(table, labels).collect()}
    parts = {p for p, _, _ in fails}
    assert len(got) == 600 * len(parts)
    total = defaultdict(int)
    for part in parts:
        own = [(i, f) for p, i, f in fails if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                out = [(i, f) for i, f in left if k in f]
                left = [(i, f) for i, f in left if k not in f]
                r = got[part, "".join(order), step]
                assert (r.kept, r.removed) == (len(left), len(out))
                assert r.redundant == sum(k in f for _, f in own) - len(out)
                assert r.unique_fails == sum(f == {k} for _, f in own)
                assert (r.good_lost, r.toxic_lost) == (sum(i in good for i, _ in out), sum(i in toxic for i, _ in out))
                total[part, k] += len(out)
    for (part, order, step), r in got.items():
        assert r.shapley == total[part, order[step - 1]] and r.share == pytest.approx(r.shapley / 120)


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int, text string")
    assert filter_audit.audit(docs(spark, []), labels).count() == 0
    assert filter_audit.audit(docs(spark, ["a"]), labels).count() == 600


# Source mixing.

def reshared(sizes):
    """Targets by repeated resharing, sources in order."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = Fraction(3, 2) * sum(sizes) - sum(fixed.values())
        target = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if target[i] > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, target.get(i)) for i in range(len(sizes))]
        fixed |= {i: Fraction(2 * sizes[i]) for i in over}


def mixed_docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        source = rng.choice(["web", "web", "web", "wiki", "Books", "code", "é", None, "", "tiny"])
        n = rng.choice([0, 1, 2, 30, 300]) if source != "tiny" else 1
        rows.append((i, prose(i, n) if rng.random() > 0.05 else None, source, "clash", 1))
    rows += [(7, "same words", "web", "clash", 1)] * 3 + [(1000, "big " * 40_000, "web", "clash", 1), (None, "no id", "wiki", "clash", 1), (1001, " \t", "blank", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, block bigint")


@pytest.mark.parametrize("block, shard", [(512, 256), (16, 8)])
def test_mix_meets_targets(spark, block, shard):
    table = mixed_docs(spark)
    rows = table.collect()
    got = source_mixing.taken_words(table, block, shard).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, reshared([sizes[s] for s in order])))
    assert {s: want[s] for s in ("blank", "tiny")} == {"blank": 0, "tiny": 2 * sizes["tiny"]}
    known = {(float(want[s]), sizes[s]) for s in order}
    assert {(r.target, r.source_size) for r in got} <= known
    taken = defaultdict(int)
    for r in got:
        taken[r.target, r.source_size] += r.taken
    assert all(abs(n - target) <= 0.5 for (target, _), n in taken.items())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mixing.taken_words(table.repartition(5), block, shard).collect()), key=repr)


def test_mixed_texts_hold_the_taken_words(spark):
    table = mixed_docs(spark).where("doc_id is not null").withColumn("text", F.concat_ws(" ", F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit("d"), "doc_id", F.lit("_"), w))))
    texts = source_mixing.mixed_texts(table, 16, 8).collect()
    assert all(len(r.text.split(" ")) == r.n_words <= 16 for r in texts)
    assert set(Counter(r.shard for r in texts).values()) <= set(range(1, 9))
    found = Counter(int(w[1:w.index("_")]) for r in texts for w in r.text.split(" "))
    want = Counter()
    for r in source_mixing.taken_words(table, 16, 8).collect():
        want[r.doc_id] += r.taken
    assert found == +want


def test_shards_draw_multinomial_counts(spark):
    targets = spark.createDataFrame([(None, 0, 1, 1.0, 9000), ("b", 1, 1, 1.0, 3000), ("c", 2, 1, 1.0, 0)], "source string, source_no bigint, source_size bigint, target double, quota bigint")
    plan = source_mixing.slot_plan(targets.withColumn("source_size", F.lit(5000)).withColumn("quota", F.col("quota")), 1)
    drawn = source_mixing.shard_draws(plan, 12000, 3, 100).collect()
    by = defaultdict(dict)
    for r in drawn:
        by[r.shard][r.source_no] = r.drawn
    assert len(by) == 120 and all(sum(d.values()) == 100 and 2 not in d for d in by.values())
    first = np.array([d.get(0, 0) for d in by.values()])
    assert 72 < first.mean() < 78 and 10 < first.var() < 30  # mean 75, variance 18.75


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 17, 256, 1000):
        image = spark.range(n).select(source_mixing.permuted(F.col("id"), F.lit(n), F.lit(n), F.lit("k")).alias("x")).collect()
        assert sorted(r.x for r in image) == list(range(n))
    assert [r.x for r in image] != list(range(n))


def test_mix_of_empty_tables(spark):
    assert source_mixing.taken_words(mixed_docs(spark).limit(0)).count() == 0
    blank = mixed_docs(spark).withColumn("text", F.lit(" "))
    assert all(r.taken == 0 and r.target == 0 for r in source_mixing.taken_words(blank).collect())
