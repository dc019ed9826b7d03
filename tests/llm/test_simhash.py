import re

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, distance):
    label = {f: f for f in fps}
    find = lambda f: f if label[f] == f else find(label[f])
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints(sample, spark):
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    for r in sample.limit(20).collect():
        assert simhash.fingerprint(r["text"]) == plain(r["text"])


@pytest.mark.parametrize("bucket", [4096, 7])
def test_links_lose_nothing(spark, bucket):
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 8).tolist():
        for _ in range(40):
            f = centre
            for b in rng.integers(0, 63, rng.integers(0, 6)).tolist():
                f ^= 1 << b
            fps.add(f)
    fps |= set(rng.integers(0, 1 << 63, 50).tolist())
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    got = simhash.components(simhash.links(df, 4, bucket))
    found = {r["node"]: r["component"] for r in got.collect()}
    want = closure(sorted(fps), 4)
    assert {f: found.get(f, f) for f in fps} == want


@pytest.mark.parametrize("blocks", [6, 7, 9])
def test_any_number_of_blocks_finds_the_same(spark, blocks):
    df = spark.createDataFrame([(f, f) for f in (0, 0b1111, 0b11111 << 30, 1 << 60 | 0b1111 << 40)], "node long, fp long")
    edges = {(r["a"], r["b"]) for r in simhash.links(df, 4, blocks=blocks).collect()}
    assert edges == {(0, 0b1111)}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == by[5]["component_id"] == 3
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_copies_are_found_and_others_left_alone(spark):
    """Copies with 2 to 6 % of their words changed go; texts which share less than a third of their shingles stay."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    often = 1 / np.arange(2, 3002)
    often /= often.sum()  # words are as frequent as in prose
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, alike = [], {}
    for k in range(300):
        text = rng.choice(vocabulary, 300, p=often).tolist()
        copy = list(text)
        for i in rng.choice(300, rng.integers(6, 19) if k % 2 else rng.integers(75, 150), replace=False):
            copy[i] = vocabulary[rng.integers(0, 3000)]
        a, b = shingles(text), shingles(copy)
        alike[2 * k + 1] = len(a & b) / len(a | b)
        rows += [(2 * k, 2 * k, " ".join(text)), (2 * k + 1, 2 * k + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "row long, doc_id long, text string")
    kept = {r["row"] for r in simhash.near_copies(df).collect()}
    assert {2 * k for k in range(300)} <= kept  # originals are never dropped for a copy
    close, far = [d for d in alike if d // 2 % 2], [d for d in alike if d // 2 % 2 == 0]
    assert min(alike[d] for d in close) > 0.5 and max(alike[d] for d in far) < 0.33
    assert len(close) == 150 and sum(d not in kept for d in close) >= 0.9 * len(close)
    assert len(far) == 150 and all(d in kept for d in far)


def test_near_copies_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(0, 5, None), (1, 4, ""), (2, None, " "), (3, None, "one"), (4, None, "one"), (5, 7, "one two"), (6, 7, "three"), (7, 9, "three")]
    got = simhash.near_copies(spark.createDataFrame(rows, "row long, doc_id long, text string"))
    assert sorted(r["row"] for r in got.collect()) == [1, 3, 5, 6]
    assert simhash.near_copies(spark.createDataFrame([], "row long, doc_id long, text string")).count() == 0


def test_a_hub_and_a_chain(spark):
    """One node with most of the links, beside a long chain."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5060)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5061)}


def test_unrelated_texts_of_one_language_do_not_meet(spark):
    """Long texts of common words have nearly the same bits by words; only texts with shingles in common are compared."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    often = 1 / np.arange(2, 3002)
    often /= often.sum()
    texts = [" ".join(rng.choice(vocabulary, 800, p=often)) for _ in range(300)]
    texts += [texts[0].replace("w7 ", "x "), " ".join([*texts[1].split()[:-9], *["x"] * 9])]
    fps, wide, least, n_least = simhash.copy_marks(texts)
    alike = np.bitwise_count(fps[:300, None] ^ fps[None, :300]) <= simhash.WORD_DISTANCE
    assert alike.mean() > 0.1
    ends = np.cumsum(n_least)
    rows = [(k, fps[k : k + 1].view(np.int64).item(), wide[k].view(np.int64).tolist(), least[e - n : e].view(np.int64).tolist()) for k, (e, n) in enumerate(zip(ends, n_least, strict=True))]
    points = spark.createDataFrame(rows, "node long, fp long, wide array<long>, least array<long>")
    assert {r["node"] for r in simhash.near_meetings(points).collect()} == {0, 1, 300, 301}
    assert {(r["a"], r["b"]) for r in simhash.near_links(points).collect()} >= {(1, 301)}


def test_marks_of_many_texts_are_those_of_each(sample):
    texts = [r["text"] for r in sample.limit(40).collect()] + [None, "", " \n", "one", "one two", "a b c d e", "a b c d e a b c d e", "x " * 700]
    fps, wide, least, n_least = simhash.copy_marks(texts)
    assert [(int(f), w.tolist()) for f, w in zip(fps, wide, strict=True)] == [simhash.copy_fingerprint(t) for t in texts]
    words = texts[0].encode().lower().split()
    h = [simhash._hashes[w] for w in words]
    assert int(fps[0]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert n_least[-8:].tolist() == [0, 0, 0, 1, 1, 1, 5, 1] and n_least.max() == simhash.LEAST and len(least) == n_least.sum()
