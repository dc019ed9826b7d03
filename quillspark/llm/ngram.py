"""n-gram language model in a log-frequency Bloom filter (Talbot and Osborne 2007).

Counts are quantised to logarithmic levels. An n-gram of level q is stored as q
members (n-gram, 1) to (n-gram, q); a look-up probes 1, 2, ... until one is
missing. The filter is built in segments by the n-grams' hash, one task each,
and broadcast to the workers, which score texts by repeated probes:

    P(w | v) = (c(vw) + mu * P(w)) / (c(v) + mu)

and so on for longer n-grams, over P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). A
level counts as its least count and never as more than its words' counts, so
false positives aside the probabilities of a history sum to one at most.

Words are known by their 64-bit hash. Filter and vocabulary grow with the
corpus, so they are broadcast in blocks of segments of ``max_broadcast`` bytes
at most. Each block takes a pass over the texts, which looks up the tokens that
fall into it; what is found goes along with the text to the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, held_out, lean, materialize, read_table, release

ORDER = 2
MU = 200.0
BASE = 1.5
HASHES = 7
BITS_PER_ENTRY = 10.1  # HASHES / ln 2
MAX_BROADCAST = 384 << 20
#: Corpus bytes whose n-grams make a segment, and n-grams which a task merges before it sends them on.
SEGMENT_BYTES, FLUSH = 8 << 20, 1_000_000
#: The end of a text, which is also what stands before its first word.
END = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, cut at blanks) and of the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def extend(history: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of a history followed by a word."""
    return _mix(history * np.uint64(0xFF51AFD7ED558CCD) + words)


def histories(flat: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 2 to ``order``, the hash of the n - 1 tokens before each token; texts begin at ``first``."""
    place = np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))
    before = []
    for back in range(1, order):
        h = np.full(len(flat), END)
        ok = place >= back
        h[ok] = flat[np.flatnonzero(ok) - back]
        before.append(h)
    out = []
    for n in range(2, order + 1):
        h = before[n - 2]
        for back in range(n - 3, -1, -1):
            h = extend(h, before[back])
        out.append(h)
    return out


def thresholds(largest: int, base: float = BASE) -> np.ndarray:
    """The least count of each level: 1, 2, 3, 4, 6, 8, 12, ... up to ``largest``."""
    out, x = [1], 1.0
    while x <= largest:
        x *= base
        if (t := int(np.ceil(x))) > out[-1] and t <= largest:
            out.append(t)
    return np.array(out, np.int64)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of hashes, so sorted hashes are in order of their segments."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def member(h: np.ndarray, level: int) -> np.ndarray:
    """The hash of the member (n-gram, level)."""
    return _mix(h + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def place(m: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The bit of hash function ``k`` within the segment, from both halves of a member's hash."""
    x = (m & np.uint64(0xFFFFFFFF)) + np.uint64(k) * (m >> np.uint64(32) | np.uint64(1))
    return ((x & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def _merged(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = h.argsort()
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c[order], first) if len(h) else c


_PARTS = "n int, segment int, hashes binary, counts binary"


def count_ngrams(texts: DataFrame, order: int, segments: int) -> DataFrame:
    """(n, segment, hashes, counts): every n-gram's count, an array for each n and segment.

    Each task merges its own n-grams before it sends them, so a frequent one
    is one entry for each task and not for each occurrence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            flat = np.concatenate(held)
            first = np.cumsum([0] + [len(x) for x in held[:-1]])
            for n in range(1, order + 1):
                h = flat if n == 1 else extend(histories(flat, first, n)[-1], flat)
                h = np.sort(h)
                at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                h, c = h[at], np.diff(np.append(at, len(h)))
                ends = np.searchsorted(segment_of(h, segments), np.arange(segments + 1))
                rows = [(s, slice(a, b)) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n] * len(rows), pa.int32()),
                        pa.array([s for s, _ in rows], pa.int32()),
                        pa.array([h[i].tobytes() for _, i in rows], pa.binary()),
                        pa.array([c[i].astype(np.uint32).tobytes() for _, i in rows], pa.binary()),
                    ],
                    ["n", "segment", "hashes", "counts"],
                )

        for b in batches:
            for x in b.column(0):
                held.append(tokens(x.as_py()))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in part["hashes"]])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in part["counts"]]).astype(np.int64)
        h, c = _merged(h, c)
        largest = int(c.max(initial=0))
        levels = np.searchsorted(thresholds(largest), c, "right")
        release()
        return pd.DataFrame(
            {"n": [key[0]], "segment": [key[1]], "hashes": [h.tobytes()], "counts": [c.tobytes()],
             "distinct": [len(h)], "total": [int(c.sum())], "entries": [int(levels.sum())], "largest": [largest]}
        )

    merged = _PARTS + ", distinct long, total long, entries long, largest long"
    return materialize(texts.mapInArrow(lean(run), _PARTS).groupBy("n", "segment").applyInPandas(merge, merged), "ngrams")


@dataclass
class NgramModel:
    """bits: the held segments' filters, one after the other; words, counts: the held vocabulary in order of its hashes.

    By default all is held. A block holds the words of the segments in
    ``word_range`` and the filters of those in ``filter_range``.
    """

    order: int
    segments: int
    segment_bits: int
    bits: np.ndarray
    levels: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    total: int
    mu: float
    vocabulary: int | None = None
    word_range: tuple[int, int] | None = None
    filter_range: tuple[int, int] | None = None

    def _held(self, h: np.ndarray, part: tuple[int, int] | None) -> np.ndarray:
        if part is None or part == (0, self.segments):
            return np.ones(len(h), bool)
        s = segment_of(h, self.segments)
        return (s >= part[0]) & (s < part[1])

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        u, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
        return np.where(self.words[at] == u, self.counts[at], 0).astype(np.int64)[back]

    def ngram_levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram of the held segments, by probes until one fails; 0 if it is not held.

        Frequent n-grams have many members, so each distinct one is probed once.
        """
        h, back = np.unique(h, return_inverse=True)
        level = np.zeros(len(h), np.uint8)
        base = (segment_of(h, self.segments) - (self.filter_range or (0,))[0]) * self.segment_bits
        alive = np.arange(len(h)) if len(self.bits) else np.zeros(0, np.int64)
        for j in range(1, len(self.levels) + 1):
            m = member(h[alive], j)
            for k in range(HASHES):
                at = base[alive] + place(m, k, self.segment_bits)
                found = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                alive, m = alive[found], m[found]
            if not len(alive):
                break
            level[alive] = j
        return level[back]

    def _least(self, level: np.ndarray) -> np.ndarray:
        return np.where(level > 0, self.levels[np.maximum(level, 1) - 1], 0) if len(self.levels) else np.zeros(len(level), np.int64)

    def ngram_counts(self, h: np.ndarray) -> np.ndarray:
        """The least count of each n-gram's level; 0 if it is not held."""
        return self._least(self.ngram_levels(h))

    def look_up(self, flat: np.ndarray, first: np.ndarray, c: np.ndarray, levels: list[np.ndarray]) -> None:
        """Fill in what this block holds: the tokens' counts, and the levels of their n-grams and, for n > 2, of the histories."""
        ok = np.flatnonzero(self._held(flat, self.word_range))
        c[ok] = np.maximum(c[ok], self.word_counts(flat[ok]))
        if not len(self.bits):
            return
        # words come in the first blocks, so all are known here
        for n, history in enumerate(histories(flat, first, self.order), 2):
            for to, h in zip(levels[max(0, 2 * n - 5) : 2 * n - 3], (history, extend(history, flat))[-1 if n == 2 else 0 :], strict=True):
                ok = np.flatnonzero((c > 0) & self._held(h, self.filter_range))
                to[ok] = self.ngram_levels(h[ok])

    def score(self, flat: np.ndarray, first: np.ndarray, c: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base and model log10 probability of each text, from what all blocks filled in."""
        p = (c + 0.5) / (self.total + 0.5 * ((len(self.words) if self.vocabulary is None else self.vocabulary) + 1))
        base, most = np.log10(p), c
        for n in range(2, self.order + 1):
            if n == 2:
                seen = np.empty_like(c)
                seen[1:] = c[:-1]
                seen[first] = c[-1]  # the last token is an end, which also stands before a text
            else:
                seen = np.where(most > 0, self._least(levels[2 * n - 5]), 0)
            together = np.zeros(len(flat), np.int64)
            ok = np.flatnonzero((most > 0) & (seen > 0))
            together[ok] = np.minimum(self._least(levels[2 * n - 4][ok]), np.minimum(most[ok], seen[ok]))
            p = (together + self.mu * p) / (seen + self.mu)
            most = together
        add = lambda x: np.add.reduceat(x, first)
        return np.diff(np.append(first, len(flat))), add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def blocks_of(word_bytes: list[int], filter_bytes: int, bound: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(segments of words, segments of filters) of each block, words first: as many as fit ``bound`` bytes, one at least."""
    n = len(word_bytes)
    out, begin, held = [], 0, 0
    for i, size in enumerate([*word_bytes, *[filter_bytes] * n]):
        if i > begin and held + size > bound:
            out.append((begin, i))
            begin, held = i, 0
        held += size
    out.append((begin, 2 * n))
    return [((min(a, n), min(b, n)), (max(a - n, 0), max(b - n, 0))) for a, b in out]


def _bit_filters(grams: DataFrame, segment_bits: int, levels: np.ndarray) -> DataFrame:
    """(segment, bits): the filter of each segment, from all orders' n-grams in it."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(segment_bits, bool)
        for hs, cs in zip(part["hashes"], part["counts"], strict=True):
            h, c = np.frombuffer(hs, np.uint64), np.frombuffer(cs, np.int64)
            q = np.searchsorted(levels, c, "right")
            for j in range(1, int(q.max(initial=0)) + 1):
                m = member(h[q >= j], j)
                for k in range(HASHES):
                    on[place(m, k, segment_bits)] = True
        packed = np.packbits(on, bitorder="little").tobytes()
        del on
        release()
        return pd.DataFrame({"segment": [key[0]], "bits": [packed]})

    return materialize(grams.groupBy("segment").applyInPandas(build, "segment int, bits binary"), "filters")


_SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def language_model_scores(
    train: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    mu: float = MU,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Null and empty texts are the end token alone. Repeated rows are scored (and
    counted in training) each. With an empty training table every token is
    unknown. All n-grams of ``train`` are counted, none is dropped. Other
    columns are ignored. The method is the same at every size: what exceeds
    ``max_broadcast`` takes more passes, of one segment each at least.
    """
    texts = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(8, -(-size // SEGMENT_BYTES))
    grams = count_ngrams(texts, order, segments)
    facts = {r["n"]: r for r in grams.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("distinct", "total", "entries")], F.max("largest").alias("largest")).collect()}
    words = facts[1]["distinct"] if 1 in facts else 0
    total = facts[1]["total"] if 1 in facts else 0
    higher = [f for n, f in facts.items() if n > 1]
    entries, largest = sum(f["entries"] for f in higher), max([0, *(f["largest"] for f in higher)])
    # room for the fullest segment, as hashes deal entries evenly but not equally
    fullest = grams.filter("n > 1").groupBy("segment").agg(F.sum("entries").alias("e")).agg(F.max("e")).first()[0] or 0
    segment_bits = max(64, -(-int(fullest * BITS_PER_ENTRY) // 8) * 8)
    levels = thresholds(largest)
    filters = _bit_filters(grams.filter("n > 1"), segment_bits, levels) if entries else None
    ones = grams.filter("n = 1").select("segment", "hashes", "counts", "distinct")
    distinct = {r["segment"]: r["distinct"] for r in ones.select("segment", "distinct").collect()}
    blocks = blocks_of([16 * distinct.get(s, 0) for s in range(segments)], segment_bits // 8, max_broadcast)

    def block(held: tuple[int, int], filtered: tuple[int, int]) -> NgramModel:
        within = lambda df, part: df.filter(F.col("segment").between(part[0], part[1] - 1)).toLocalIterator()
        bits = np.zeros((filtered[1] - filtered[0]) * (segment_bits // 8) if entries else 0, np.uint8)
        if len(bits):
            for r in within(filters, filtered):
                bits[(r["segment"] - filtered[0]) * (segment_bits // 8) :][: segment_bits // 8] = np.frombuffer(r["bits"], np.uint8)
        size = sum(distinct.get(s, 0) for s in range(*held))
        known, counts, at = np.zeros(size, np.uint64), np.zeros(size, np.int64), 0
        for r in within(ones, held) if size else ():
            h = np.frombuffer(r["hashes"], np.uint64)
            known[at : at + len(h)], counts[at : at + len(h)] = h, np.frombuffer(r["counts"], np.int64)
            at += len(h)
        by = known.argsort()
        return NgramModel(order, segments, segment_bits, bits, levels, known[by], counts[by], total, mu, words, held, filtered)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for i, parts in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block(*parts))
        if i == len(blocks) - 1:
            return rows.mapInArrow(lean(_pass(shared, True)), _SCORES)
        before, rows = rows, materialize(rows.mapInArrow(lean(_pass(shared, False)), _PASSED), "passed")
        shared.destroy()
        if i:
            discard(before)


_PASSED = "doc_id long, text string, found binary"


def _pass(shared, last: bool):
    """A pass over the texts with one block: adds what it holds to ``found``; the last one gives the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kinds = 2 * m.order - 3
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                part, size, start = [], 0, at
                while at < whole.num_rows and size < 1 << 18:  # texts looked up at once
                    part.append(tokens(whole.column(1)[at].as_py()))
                    size += len(part[-1])
                    at += 1
                flat = np.concatenate(part)
                first = np.cumsum([0] + [len(x) for x in part[:-1]])
                c, levels = np.zeros(size, np.int64), [np.zeros(size, np.uint8) for _ in range(kinds)]
                if whole.num_columns == 3:
                    for a, x, held in zip(first.tolist(), part, whole.column(2).slice(start, at - start), strict=True):
                        held, n = np.frombuffer(held.as_py(), np.uint8), len(x)
                        c[a : a + n] = held[: 8 * n].view(np.int64)
                        for k in range(kinds):
                            levels[k][a : a + n] = held[(8 + k) * n : (9 + k) * n]
                m.look_up(flat, first, c, levels)
                doc_id = whole.column(0).slice(start, at - start)
                if last:
                    n, k, base, score = m.score(flat, first, c, levels)
                    cols = [doc_id, pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(np.full(len(n), m.total), pa.int64()), pa.array(base), pa.array(score)]
                else:
                    ends = (first + [len(x) for x in part]).tolist()
                    found = [c[a:b].tobytes() + b"".join(x[a:b].tobytes() for x in levels) for a, b in zip(first.tolist(), ends, strict=True)]
                    cols = [doc_id, whole.column(1).slice(start, at - start), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in (_SCORES if last else _PASSED).split(", ")])

    return run


def op1_bloom_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the bigram model of those which are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    out = language_model_scores(docs.filter(~held_out("doc_id", 5, 1)), docs)
    return out.select(
        "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
