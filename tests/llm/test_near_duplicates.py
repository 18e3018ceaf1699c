"""Groups of near duplicates against brute force."""

import random
import re

import numpy as np
from fixtures import docs, prose, thue_morse

from edgeloom.llm.components import components
from edgeloom.llm.embedding_dedup import quantised, vector_links
from edgeloom.llm.minhash_dedup import SLOTS, drop_near_duplicates, near_duplicates, super_min_hash


def union(n, links):
    head = list(range(n))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    want = union(131, links)
    rows = spark.createDataFrame(links + [(5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(rows).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def shingles(text, k):
    data = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_minhash_groups_match_brute_force(spark):
    base = [prose(i, 120) for i in range(6)]
    texts = [None, "", " \t\n", "one", "One", "two words", "ABBA BAAB", prose(99, 20_000)]
    rng = random.Random(1)
    for b in base:
        for edits in (0, 0, 1, 2, 4, 8, 20):
            words = b.split(" ")
            for _ in range(edits):
                words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
    # A chain whose ends are far apart, and a passage that many texts share.
    texts += [prose(50, 60) + " " + prose(200 + i, 60) for i in range(30)]
    for k in (4, 5):
        sets = [shingles(t, k) for t in texts]
        links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        want = union(len(texts), links)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark, texts).unionByName(docs(spark, texts[:9])), k, 80).collect()}
        assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}
    kept = drop_near_duplicates(docs(spark, texts), 5, 80)
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in range(len(texts)) if want[i] == i]


def test_minhash_of_words_that_weak_hashes_confuse(spark):
    rows = near_duplicates(docs(spark, [w + " x y z" for w in thue_morse()]), k=4, percent=80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(0, 0, True), (1, 1, True)]


def test_minhash_of_an_empty_table(spark):
    assert near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(0)
    both, left, right = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (400, 50, 50))
    a, b = np.unique(np.concatenate([both, left])), np.unique(np.concatenate([both, right]))
    signature = super_min_hash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((signature[0] == signature[1]).mean() - 0.8) < 0.12
    # Every slot is filled even by one element, each by its own rank.
    one = super_min_hash(a[:1], np.array([0, 1]))
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(SLOTS))


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    vectors = [(centres[i % 6] + rng.normal(size=16) * 0.22).astype(np.float32).tolist() for i in range(150)]
    vectors[7] = vectors[1]
    labels = [i % 6 % 3 for i in range(150)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8, vectors[0]]
    rows = list(zip(range(150), vectors, labels)) + [(200 + i, v, None if i == 7 else 0) for i, v in enumerate(odd)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(3, vectors[3], labels[3], "x", 1)], "vec_id bigint, embedding array<float>, label int, rep string, links int")
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, l in rows if i < 150 or i == 206}
    label = {i: l for i, _, l in rows}
    links = [(i, j) for i in good for j in good if i > j and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.93]
    assert 100 < len(links) < 4000
    want = union(300, links)
    for block in (8192, 20):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links(table, 0.93, block=block).collect()}
        assert got == {i: (sum(i in l for l in links), want[i], want[i] == i) for i, _, _ in rows}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(80, 24))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q, step, error = quantised(unit)
    estimate = (q.astype(float) @ q.T.astype(float)) * step[:, None] * step[None, :]
    bound = error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-12
    assert (np.abs(estimate - unit @ unit.T) <= bound).all()
