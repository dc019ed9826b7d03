"""SuperMinHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from quillspark.llm import minhash
from quillspark.llm.shingles import shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, n long, node long, cluster long"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute(rows):
    """doc_id to (set size, component)."""
    sets = [shingle_set(t) for _, t in rows]
    above = list(range(len(rows)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    n = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                above[find(i)] = find(j)
                n += sets[i] != sets[j]
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}, n


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 9, 20, 80, 300]))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed, 500)))
    want, n = brute(rows)
    assert n > 20
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_chunks_of_large_buckets_and_clusters_lose_nothing(spark):
    rows = list(enumerate(corpus(7, 300)))
    want, _ = brute(rows)
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], SCHEMA)
    got = minhash.near_duplicates(df, bucket=5, cluster=700).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST", 0)
    rows = list(enumerate(corpus(9, 200)))
    got = minhash.near_duplicates(spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)[0]


def test_signature_is_the_one_drawn_element_by_element():
    """The plain algorithm: a shuffle for each element, without stopping early."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 60, 500, 3000)]
    got = minhash.signatures(sets)
    m = minhash._SIZE
    for s, row in zip(sets, got, strict=True):
        want = [1 << 64] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                r, k = minhash._draw(np.array([e]), j)
                k = int(k[0])
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], (j << 32) | int(r[0]))
        assert row.tolist() == want


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(6)
    errors = []
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        one, two = minhash.signatures([base[:50], base[10:]])
        errors.append((one == two).mean() - 40 / 60)
    independent = (40 / 60) * (20 / 60) / minhash._SIZE
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.9 * independent


def test_links_within_a_group_are_exact():
    rng = random.Random(8)
    for _ in range(60):
        sets = [shingle_hashes(word_hashes(t), 3) for t in corpus(rng.random(), 40)]
        a, b = minhash.linked(list(range(40)), sets)
        whole = [set(s.tolist()) for s in sets]
        above = list(range(40))

        def find(x, above=above):
            while above[x] != x:
                x = above[x]
            return x

        pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(whole[i] & whole[j]) >= 85 * len(whole[i] | whole[j])]
        for i, j in pairs:
            above[find(i)] = find(j)
        want = [min(k for k in range(40) if find(k) == find(i)) for i in range(40)]
        above[:] = range(40)
        for i, j in zip(a, b, strict=True):
            above[find(i)] = find(j)
        assert [min(k for k in range(40) if find(k) == find(i)) for i in range(40)] == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd_docs).collect()}
    assert [(got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) for k in (3, 4, 5)] == [(0, 3, True), (0, 4, True), (0, 5, True)]
    assert got[2]["component_id"] == 1 and got[6]["n_shingles"] == 1 and got[None]["component_id"] is None
    assert minhash.near_duplicates(no_docs).collect() == []


def test_a_set_known_by_null_ids_only_is_verified(spark):
    base = ["w%d" % k for k in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join(base[:-1])), (5, " ".join(base[1:])), (None, "other words of another text")]
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], SCHEMA)
    got = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 5, 57), (None, 5, 57), (None, 5, 58), (None, None, 3)}
