import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import ngram
from quillspark.llm.common import held_out


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(train, text, mu):
    ones, twos = Counter(), Counter()
    for t in train:
        w = words(t)
        ones.update(w)
        twos.update(zip([None, *w], w, strict=False))
    n, v = sum(ones.values()), len(ones)
    steps = ngram.thresholds(max([1, *twos.values()]))
    floor = lambda c: int(steps[steps <= c].max()) if c else 0
    w, base, score = words(text), 0.0, 0.0
    for a, b in zip([None, *w], w, strict=False):
        p1 = (ones[b] + 0.5) / (n + 0.5 * (v + 1))
        base += math.log10(p1)
        score += math.log10((floor(twos[a, b]) + mu * p1) / (ones[a] + mu))
    return len(w), sum(ones[x] > 0 for x in w), n, base, score


@pytest.mark.parametrize("limit", [ngram.MAX_BROADCAST, 0])
def test_scores_equal_brute_force(spark, sample, limit):
    train = sample.filter(~held_out("doc_id", 5, 1))
    got = {r["doc_id"]: r for r in ngram.language_model_scores(train, sample, mu=50.0, max_broadcast=limit).collect()}
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    known = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    for d in list(texts)[:15]:
        n, k, total, base, score = brute(known, texts[d], 50.0)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, k, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        # a false positive of the filter can only raise a count, with one block or with one for each segment
        assert r["score"] == pytest.approx(score, rel=0.01) and r["score"] >= score - 1e-6


def test_filter_has_no_false_negatives():
    h = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 5000) % 50 + 1
    levels = ngram.thresholds(50)
    q = np.searchsorted(levels, counts, "right")
    bits = int(q.sum() * ngram.BITS_PER_ENTRY) // 8 * 8
    on = np.zeros(bits, bool)
    for j in range(1, q.max() + 1):
        for k in range(ngram.HASHES):
            on[ngram.place(ngram.member(h[q >= j], j), k, bits)] = True
    m = ngram.NgramModel(2, 1, bits, np.packbits(on, bitorder="little"), levels, h[:0], counts[:0], 0, 1.0)
    assert (m.ngram_counts(h) >= levels[q - 1]).all()
    other = np.arange(10**6, 10**6 + 5000, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    assert (m.ngram_counts(other) > 0).mean() < 0.03


def test_odd_rows(odd_docs, no_docs):
    out = ngram.language_model_scores(odd_docs, odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (3, 4, 5))
    assert ngram.language_model_scores(odd_docs, no_docs).count() == 0
    untrained = ngram.language_model_scores(no_docs, odd_docs).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in untrained)


def test_longer_ngrams_help_repeated_text(sample):
    two, three = (ngram.language_model_scores(sample, sample, order=n).agg({"score": "sum"}).first()[0] for n in (2, 3))
    assert three > two


@pytest.mark.parametrize(("order", "limit"), [(2, 1), (3, 60_000)])
def test_passes_over_blocks_give_the_same_scores(sample, odd_docs, order, limit):
    docs = sample.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    key = lambda r: tuple(x is not None and x for x in r)
    one, many = (sorted(ngram.language_model_scores(docs, docs, order=order, max_broadcast=b).collect(), key=key) for b in (ngram.MAX_BROADCAST, limit))
    assert one == many


@pytest.mark.parametrize("bound", [1, 25, 70, 1000])
def test_blocks_hold_every_segment_once_and_words_first(bound):
    sizes = [10, 0, 30, 20]
    blocks = ngram.blocks_of(sizes, 15, bound)
    for side in (0, 1):
        assert [s for b in blocks for s in range(*b[side])] == list(range(4))
    assert all(b[0][1] == 4 for b in blocks if b[1][0] < b[1][1])
    assert all(sum(sizes[slice(*w)]) + 15 * (f[1] - f[0]) <= max(bound, 30) for w, f in blocks)
