"""Periodic runs against a brute-force search, and the planted tails."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from quillspark.llm import periodic


def brute(words):
    """All maximal stretches of each period, the smallest period only."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and (i, j + q) not in seen:
                out.append((i, j + q - i, q))
                seen.add((i, j + q))
            i = j + 1
    return sorted(out)


def made(rng):
    words = []
    while len(words) < rng.randrange(1, 160):
        unit = [rng.choice("abcde") for _ in range(rng.randrange(1, 14))]
        words += (unit * rng.randrange(1, 6))[: rng.randrange(1, 60)]
    return [w.encode() for w in words]


def test_runs_are_those_of_brute_force():
    rng, n = random.Random(5), 0
    for _ in range(1500):
        words = made(rng)
        want = brute(words)
        n += len(want)
        assert periodic.runs_of(words) == want, words
    assert n > 1500


@pytest.mark.parametrize("words, want", [([], []), ([b"x"] * 11, []), ([b"x"] * 12, [(0, 12, 1)]), ([b"a", b"b"] * 6, [(0, 12, 2)]), (list(b"abcdefghijklmnopqrst"), [])])
def test_small_cases(words, want):
    assert periodic.runs_of(words) == want


def test_long_texts_take_bounded_time():
    rng = random.Random(1)
    words = [str(rng.randrange(5000)).encode() for _ in range(200_000)] + [b"ha"] * 3000 + [b"x%d" % (k % 700) for k in range(4000)]
    runs = periodic.runs_of(words)
    assert (200_000, 3000, 1) in runs and (203_000, 4000, 700) in runs


def test_what_stays():
    words = [b"p"] + [b"a", b"b", b"c"] * 5 + [b"q"]
    runs = periodic.runs_of(words)
    assert runs == [(1, 15, 3)]
    assert periodic.collapsed(words, runs) == [b"p", b"a", b"b", b"c", b"q"]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = periodic.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for k in (3, 4, 5):
        assert by_id[k]["n_words"] == 0 and by_id[k]["runs"] == [] and by_id[k]["collapsed"] == ""
    assert [(r["start"], r["length"], r["period"]) for r in by_id[7]["runs"]] == [(0, 60_000, 20)]
    assert by_id[7]["collapsed"] == by_id[1]["collapsed"]
    assert periodic.periodic_runs(no_docs).collect() == []


def test_query_over_the_smallest_table(spark, sample):
    got = {r["doc_id"]: r for r in periodic.op13_bit_planes(spark, "/root/testdata/sf0.001").collect()}
    docs = sample.collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = (d["text"] or "").encode().split()
        h, n = crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        want = brute(words[:3000]) if n <= 3000 else None
        if want is None:
            continue
        r = got[d["doc_id"]]
        assert r["n_runs"] == len(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert r["collapsed_sha256"] == sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert planted > 5
