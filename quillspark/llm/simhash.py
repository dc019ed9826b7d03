"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints which differ in at most ``k`` bits
agree on at least ``n - k`` of ``n`` blocks, so they share the key made of some
``n - k`` blocks. Distinct fingerprints are joined on these keys, and each
bucket is verified by Hamming distance. ``n`` follows the number of
fingerprints, so that a bucket of unrelated ones stays small; any ``n`` finds
the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import join_by_key, lean, materialize, read_table
from quillspark.llm.graph import components

BITS = 64
SHINGLE = 4
DISTANCE = 4
#: Members of a bucket compared in one task; a larger bucket is cut into chunks and its chunk pairs are dealt out.
BUCKET = 4096
#: Shingles whose bits are counted at once.
_STEP = 1 << 15
#: Near copies: bits by words, and 256 bits by distinct word shingles; of each at most so many differ.
WORD_DISTANCE = 6
WIDE_WORDS, WIDE_SHINGLE, WIDE_DISTANCE = 4, 5, 72
#: Least shingle hashes of a text, of which near copies share one, and texts whose hashes are counted at once.
LEAST, TEXTS = 24, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; no words: 0.

    A-Z is lower-cased, words are runs without blanks (U+0020, U+0009 to
    U+000D). Fewer words than a shingle make one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[:-1]))
    if len(words) > shingle:
        start, stop = first[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    else:
        start, stop = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(start), _STEP):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(start[i : i + _STEP], stop[i : i + _STEP])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, fp long")


def n_blocks(n: int, distance: int, bucket: int = 2) -> int:
    """The least number of blocks at which ``n`` random fingerprints put about ``bucket`` at most into one key."""
    for blocks in range(distance + 2, distance + 9):
        if n / 2 ** (BITS * (blocks - distance) // blocks) <= bucket:
            return blocks
    return distance + 8


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """One key for each choice of ``blocks - distance`` blocks: its number and the chosen bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(k).cast("short").alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _forest(nodes: np.ndarray, fps: np.ndarray, wide: np.ndarray | None, distance: int, wide_distance: int | None) -> list[tuple[int, np.ndarray]]:
    """(root, linked nodes) for each component of the members which are near."""
    _, at = np.unique(nodes, return_index=True)
    nodes, fps = nodes[at], fps[at]
    wide = None if wide is None else wide[at]
    rest, out = np.arange(len(nodes)), []
    while len(rest):
        root, rest = rest[0], rest[1:]
        stack, linked = [root], []
        while stack and len(rest):
            one = stack.pop()
            near = np.bitwise_count(fps[rest] ^ fps[one]) <= distance
            if wide is not None and near.any():
                k = np.flatnonzero(near)
                near[k] = np.bitwise_count(wide[rest[k]] ^ wide[one]).sum(1) <= wide_distance
            if near.any():
                found = rest[near]
                linked.append(found)
                stack.extend(found)
                rest = rest[~near]
        if linked:
            out.append((int(nodes[root]), nodes[np.concatenate(linked)]))
    return out


def links(points: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, blocks: int | None = None) -> DataFrame:
    """Links (a, b) of nodes whose transitive closure is that of all near pairs of ``points`` (node, fp).

    Near are fingerprints within ``distance``. What is known of a bucket
    reaches its members by :func:`join_by_key`, so a frequent block is no hot key.
    """
    n = points.count()
    blocks = blocks or n_blocks(n, distance)
    keys = block_keys(F.col("fp"), blocks, distance)
    keyed = points.select("node", "fp", F.explode(keys).alias("key")).select("key.choice", "key.bits", "node", "fp")
    held = _shared(keyed, ["choice", "bits"], bucket, n * len(list(combinations(range(blocks), distance))))
    return _compared(held, ["choice", "bits"], distance)


def near_meetings(points: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, cut, node) of those of ``points`` (node, least) which have one of their least shingle hashes in common with another."""
    keyed = points.select("node", F.explode("least").alias("key"))
    return _shared(keyed, ["key"], bucket, LEAST * points.count())


def near_links(points: DataFrame, distance: int = WORD_DISTANCE, wide_distance: int = WIDE_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """As :func:`links`, of ``points`` (node, fp, wide, least) within both distances which share one of their ``least``."""
    held = near_meetings(points, bucket).join(points.select("node", "fp", "wide"), "node")
    return _compared(held, ["key"], distance, wide_distance)


def _shared(keyed: DataFrame, keys: list[str], bucket: int, total: int) -> DataFrame:
    """Rows of ``keyed`` whose key another row has too, with ``cut``, the chunks into which their bucket is cut."""
    shared = keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("cut", F.ceil(F.col("n") / bucket))
    return join_by_key(keyed, shared, keys, total)


def _compared(held: DataFrame, keys: list[str], distance: int, wide_distance: int | None = None) -> DataFrame:
    """(a, b) of near members of the buckets of ``held`` (keys, cut, node, fp, and wide where there is a bound for it).

    A bucket gives a spanning forest, never its pairs. Larger buckets are cut
    into chunks by hash; every pair of chunks is one group, so all pairs are
    still compared and no group outgrows a task.
    """
    columns = ["node", "fp"] + ([] if wide_distance is None else ["wide"])
    members = (
        held.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("cut")))
        # each chunk meets every chunk, itself included, once
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
        .groupBy(*keys, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        .agg(F.collect_list(F.struct(*columns)).alias("members"))
        .select("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
            values, ends = lists.values.slice(first, last - first), np.asarray(lists.offsets) - first
            node = np.asarray(values.field("node"))
            fp = np.asarray(values.field("fp")).view(np.uint64)
            wide = np.asarray(values.field("wide").flatten()).view(np.uint64).reshape(len(node), -1) if wide_distance is not None and len(node) else None
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            size = np.diff(ends)
            two = ends[:-1][size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
            if wide is not None:
                near &= np.bitwise_count(wide[two] ^ wide[two + 1]).sum(1) <= wide_distance
            a.append(np.minimum(node[two], node[two + 1])[near])
            b.append(np.maximum(node[two], node[two + 1])[near])
            for s, e in zip(ends[:-1][size > 2], ends[1:][size > 2], strict=True):
                for root, linked in _forest(node[s:e], fp[s:e], None if wide is None else wide[s:e], distance, wide_distance):
                    a.append(np.full(len(linked), root, np.int64))
                    b.append(linked)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], ["a", "b"])

    return members.mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    shingle: int = SHINGLE,
    bucket: int = BUCKET,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the least doc_id reachable over links of at most
    ``distance`` differing bits. Null, empty and blank texts have fingerprint
    zero and are linked like any other; a null doc_id names no component (its
    component has the least of the other ids, or null). Repeated rows and equal
    texts share a fingerprint and are one member. Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct-fingerprints")
    found = components(links(fps.select(F.col("fp").alias("node"), "fp"), distance, bucket))
    named = (
        fps.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = materialize(named.join(least, "component").select("fp", "component_id", "n"), "classes")
    return join_by_key(rows, classes, ["fp"], rows.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


class _Hashes(dict):
    """64-bit hashes of words, of as many as are in use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bits which most of a text's hashes have, for each text; ``first`` are the places of the texts' first hashes."""
    size = np.diff(np.append(first, len(h)))
    steps = -(-size // 255)  # so many ones at most fit a byte
    begin = np.concatenate(([0], np.cumsum(steps)[:-1]))
    at = np.repeat(first, steps) + 255 * (np.arange(steps.sum()) - np.repeat(begin, steps))
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)  # a byte for each bit
    sums = np.add.reduceat(bits, at, axis=0).view(np.uint8).reshape(-1, BITS)
    ones = np.add.reduceat(sums, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > size[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def copy_marks(texts: list[str | None], shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the majority bits of its words, repeats included, and four times 64 of its distinct word shingles; no words: all 0.

    Then the least ``LEAST`` hashes of its shingles (all, where there are
    fewer), one text's after another's, and their numbers.
    """
    words = [text.encode("utf-8", "surrogatepass").lower().split() if text else [] for text in texts]
    size = np.array([len(w) for w in words], np.int64)
    fps, wide, n_least = np.zeros(len(texts), np.uint64), np.zeros((len(texts), WIDE_WORDS), np.uint64), np.zeros(len(texts), np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return fps, wide, np.zeros(0, np.uint64), n_least
    size, n = size[some], int(size.sum())
    first = _starts(size)
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, n)
    fps[some] = _majority(h, first)
    # fewer words than a shingle make one shingle
    within, text = np.minimum(size, shingle), np.repeat(np.arange(len(some)), size - np.minimum(size, shingle) + 1)
    begin = first[text] + np.arange(len(text)) - _starts(size - within + 1)[text]
    joined = np.zeros(len(text), np.uint64)
    for k in range(shingle):
        more = np.flatnonzero(within[text] > k)
        joined[more] = _mixed(joined[more] * np.uint64(0xFF51AFD7ED558CCD) + h[begin[more] + k])
    order = np.lexsort((joined, text))
    joined, text = joined[order], text[order]
    new = np.append(True, (joined[1:] != joined[:-1]) | (text[1:] != text[:-1]))
    joined, text = joined[new], text[new]
    distinct = np.bincount(text)
    first = _starts(distinct)
    for k in range(WIDE_WORDS):
        wide[some, k] = _majority(_mixed(joined + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), first)
    n_least[some] = np.minimum(distinct, LEAST)
    return fps, wide, joined[np.arange(len(text)) - first[text] < LEAST], n_least


def copy_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE) -> tuple[int, list[int]]:
    """The bits by words and the bits by shingles of :func:`copy_marks`.

    Edits move few of the bits by words; the bits by shingles tell how much of
    the texts agrees.
    """
    fps, wide, _, _ = copy_marks([text], shingle)
    return int(fps[0]), wide[0].tolist()


def near_copies(rows: DataFrame, distance: int = WORD_DISTANCE, wide_distance: int = WIDE_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(row) of those of ``rows`` (row, doc_id, text) which stay: one of each group of near copies.

    Near are texts whose bits by words differ in at most ``distance`` and whose
    256 bits by five-word shingles in at most ``wide_distance``: 72 stands for
    a similarity of about 0.6, which a copy keeps whose words are changed by 2
    to 6 %. Unrelated texts differ in about 128. Texts are compared where they
    share one of their 24 least shingle hashes: bits by words of long texts of
    one language are alike, so blocks of them would hold a fixed part of all
    texts. Texts with a similarity of s share none in about (1 - s)**24 of
    cases, 6e-8 at 0.5; those of 24 shingles or fewer share all that there is.
    The row with the least doc_id stays, then the least row; rows without
    a doc_id are judged too and stay if their group has no other. Null, empty
    and blank texts are one group. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                fps, wide, least, n_least = copy_marks(b.column(2).to_pylist())
                wides = pa.ListArray.from_arrays(ends(np.full(len(fps), WIDE_WORDS)), pa.array(wide.view(np.int64).reshape(-1)))
                leasts = pa.ListArray.from_arrays(ends(n_least), pa.array(least.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), wides, leasts], ["row", "doc_id", "fp", "wide", "least"])

    made = "row long, doc_id long, fp long, wide array<long>, least array<long>"
    marked = materialize(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), made), "copy-fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    same = marked.groupBy("fp", "wide").agg(best, F.min("least").alias("least"))
    groups = materialize(same.withColumn("node", F.monotonically_increasing_id()), "groups")
    found = components(near_links(groups, distance, wide_distance, bucket))
    named = groups.join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "best")
    return named.groupBy("component").agg(F.min("best").alias("best")).select("best.row")


def op4_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
