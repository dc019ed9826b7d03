"""Periodic runs of words, found lag by lag on big-integer bit planes.

The ids of a text's words are held as bit planes, one big integer a bit. XOR
of a plane with itself shifted by a lag has a one where the bit differs; the
OR over the planes has a one where the word differs from the word a lag later.
A run of period q is a long stretch of zeros at lag q, and AND with shifts
that double isolates stretches which are long enough.

Every word of a run lies in a six-word sequence that occurs again within the
run, so only stretches of words covered by such sequences are looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read_table

#: Least length of a run; a run has two periods at least as well.
LEAST = 12
_GRAM = LEAST // 2
_MULT = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, stop) of the stretches of true of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= least
    return list(zip(start[long].tolist(), stop[long].tolist(), strict=True))


def _repetitive(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of stretches outside of which no run has a word.

    A run of period q repeats at a lag of q for at least max(q, 12 - q) words,
    so its words all lie in six-word sequences which occur twice in it. What
    is not covered by sequences that repeat within a stretch splits it.
    """
    n = len(ids)
    if n < LEAST:
        return []
    gram = np.zeros(n - _GRAM + 1, np.uint64)
    for k in range(_GRAM):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(_MULT) + ids[k : n - _GRAM + 1 + k].astype(np.uint64)
    out, open_ = [], [(0, n)]
    while open_:
        a, b = open_.pop()
        part = gram[a : b - _GRAM + 1]
        ordered = np.sort(part)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            continue
        depth = np.zeros(b - a + 1, np.int32)
        at = np.flatnonzero(np.isin(part, again))
        np.add.at(depth, at, 1)
        np.add.at(depth, at + _GRAM, -1)
        parts = _stretches(np.cumsum(depth[:-1]) > 0, LEAST)
        if parts == [(0, b - a)]:
            out.append((a, b))
        else:
            open_ += [(a + x, a + y) for x, y in parts]
    return sorted(out)


def _isolated(equal: int, length: int) -> int:
    """The bits at which ``length`` ones in a row begin, by AND with shifts that double; ends as soon as none is left."""
    have = 1
    while equal and have < length:
        step = min(have, length - have)
        equal &= equal >> step
        have += step
    return equal


def _runs_within(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs of a stretch of words."""
    n = len(ids)
    dense = np.unique(ids, return_inverse=True)[1]
    planes = [
        int.from_bytes(np.packbits((dense >> k) & 1, bitorder="little").tobytes(), "little") for k in range(max(1, int(dense.max()).bit_length()))
    ]
    out: list[Run] = []
    found: dict[int, tuple[list[int], list[int]]] = {}  # starts and stops of the runs of a period
    for q in range(1, n // 2 + 1):
        need, all_ = max(q, LEAST - q), (1 << (n - q)) - 1
        if n - q < need:
            continue
        equal = all_
        for plane in planes:
            # what cannot hold a long stretch any more is left at once
            equal = _isolated_or(equal, plane, q, need)
            if not equal:
                break
        else:
            starts = _isolated(equal, need)
            bits = np.unpackbits(np.frombuffer(starts.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")
            for s, e in _stretches(bits.astype(bool), 1):
                length = e - s + need - 1 + q
                if not any(q % p == 0 and _within(found[p], s, s + length) for p in found):
                    out.append((s, length, q))
                    starts_, stops = found.setdefault(q, ([], []))
                    starts_.append(s)
                    stops.append(s + length)
    return out


def _isolated_or(equal: int, plane: int, q: int, need: int) -> int:
    """``equal`` without the places where this plane differs at lag ``q``; 0 if no stretch of ``need`` is left."""
    equal &= ~(plane ^ (plane >> q))
    return equal if _isolated(equal, need) else 0


def _within(runs: tuple[list[int], list[int]], start: int, stop: int) -> bool:
    """Whether one of these runs, in order of their starts, holds all of a stretch. Runs of one period overlap by less than it."""
    at = bisect_right(runs[0], start)
    return any(runs[1][k] >= stop for k in range(max(0, at - 2), at))


def runs_of(words: list[bytes]) -> list[Run]:
    """(start, length, period) of all runs, by start, then period.

    A run is a stretch of consecutive words with smallest period q (words q
    apart are equal), of at least 12 words and two periods, which no
    neighbouring word extends.
    """
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return sorted((a + s, length, q) for a, b in _repetitive(ids) for s, length, q in _runs_within(ids[a:b]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those which any run has after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        depth[s + q] += 1
        depth[s + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if d == 0]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``; ``runs`` are structs of start, length and period.

    Words are what is left between blanks (U+0020, U+0009 to U+000D);
    ``collapsed`` are the words that stay, joined by one space. ``rewrite``
    changes the words of a document before. Rows are judged each on its own and
    nothing is shuffled: null, empty and blank texts have no words and no runs,
    repeated rows give repeated results, other columns are ignored, an empty
    table gives an empty result. The cost of a text is about in proportion to
    its words, and to the square of its repetitive stretches over 64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                counts, found, texts = [], [], []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    if rewrite and words:
                        words = rewrite(doc_id, words)
                    runs = runs_of(words)
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For about one id in ten, the words from some place on repeat with a period; ids, not chance, decide. A null id changes nothing."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[: n - a]


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, of which some are made repetitive: their number, the longest, and digests of runs and of what stays."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=repeated_tail)
    # the greatest length first, then the least start, then the least period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
