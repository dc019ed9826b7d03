"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

Each shingle draws a random permutation of the signature's places. Its j-th
place gets the value j plus a random fraction, and a place keeps the least
value. Ranks of one shingle are thus correlated, which lowers the variance
against independent hashes, and once every place holds a value below j the
ranks from j on cannot matter, so drawing stops early.

Distinct shingle sets meet in buckets of equal bands. Within a bucket the
signatures' low bytes tell what may be near; these candidates form clusters,
and in a cluster the whole sets are compared. Exact links are gathered by
union-find in tasks and merged across them by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, join_by_key, materialize, read_table
from quillspark.llm.graph import components
from quillspark.llm.shingles import shingle_hashes, word_hashes

SHINGLE = 3
#: Linked are sets with 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bands and their places. At a similarity of 0.85 a pair shares no band once in 1.3 million times.
BANDS, ROWS = 24, 5
#: Bands whose buckets are looked at first; later ones only join what these left apart.
FIRST = 4
#: Equal places from which on two signatures are candidates: six standard deviations below what 0.85 gives.
ALIKE = 78
#: Members of a bucket compared in one task, and shingles of a cluster; more are cut into chunks whose pairs are dealt out.
BUCKET, CLUSTER = 16384, 2_000_000
#: Sets in clusters up to which their ids are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST = 200_000
_SIZE = BANDS * ROWS


def _draw(state: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element: a 32-bit random rank at level ``j``, and a random slot from ``j`` on."""
    x = state + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    low = x & np.uint64(0xFFFFFFFF)
    return x >> np.uint64(32), (low * np.uint64(_SIZE - j) >> np.uint64(32)).astype(np.int64) + j


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS * ROWS`` values for each of the sets, none of them empty: level and random rank of the least.

    All sets go through the levels together; a set leaves as soon as each of
    its places is taken at the level reached or below.
    """
    n = len(sets)
    out = np.full(n * _SIZE, np.iinfo(np.uint64).max)
    if not n:
        return out.reshape(0, _SIZE)
    size = np.array([len(s) for s in sets])
    state, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    # the first level needs no permutation: its slot is its place
    rank, slot = _draw(state, 0)
    np.minimum.at(out, owner * _SIZE + slot, rank)
    open_ = out.reshape(n, -1).max(1) >= np.uint64(1 << 32)
    here = open_[owner]
    state, owner, slot = state[here], owner[here], slot[here]
    at = np.arange(len(state))
    places = np.tile(np.arange(_SIZE, dtype=np.uint8), (len(state), 1))
    places[at, slot] = 0  # what swapping slot 0 leaves behind
    for j in range(1, _SIZE):
        if not len(state):
            break
        rank, slot = _draw(state, j)
        place = places[at, slot]
        places[at, slot] = places[at, j]
        np.minimum.at(out, owner * _SIZE + place, rank | np.uint64(j << 32))
        open_ = out.reshape(n, -1).max(1) >= np.uint64((j + 1) << 32)
        here = open_[owner]
        if not here.all():
            state, owner, places = state[here], owner[here], places[here]
            at = np.arange(len(state))
    return out.reshape(n, _SIZE)


def _digest(s: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


_MARKED = "doc_id long, text_hash long, n long, d1 long, d2 long, bands array<long>, low binary"


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n, d1, d2, bands, low): set size and digest, band keys and low signature bytes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingle_hashes(word_hashes(t.as_py()), SHINGLE) for t in b.column(2)]
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in some])
                keys: list[list[int] | None] = [None] * len(sets)
                low: list[bytes | None] = [None] * len(sets)
                d1: list[int | None] = [None] * len(sets)
                d2: list[int | None] = [None] * len(sets)
                for i, row in zip(some, sig, strict=True):
                    d1[i], d2[i] = _digest(sets[i])
                    raw = row.tobytes()
                    step = 8 * ROWS
                    keys[i] = [xxhash.xxh3_64_intdigest(raw[k * step : k * step + step], k) - (1 << 63) for k in range(BANDS)]
                    low[i] = row.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n", "d1", "d2", "bands", "low"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _MARKED)


def _forest(label: np.ndarray, low: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of labels which join all members that are alike over labels; members of one label are joined already."""
    rest, a, b = np.arange(len(label)), [], []
    while len(rest):
        own = label[rest] == label[rest[0]]
        stack, rest = rest[own].tolist(), rest[~own]
        while stack and len(rest):
            one = stack.pop()
            near = (low[rest] == low[one]).sum(1) >= ALIKE
            if near.any():
                found = np.unique(label[rest[near]])
                a += [int(label[one])] * len(found)
                b += found.tolist()
                joined = np.isin(label[rest], found)
                stack += rest[joined].tolist()
                rest = rest[~joined]
    return a, b


def _chunked(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of a group with ``cut`` chunks, dealt so that each chunk meets each other and itself: columns i and j tell the pair."""
    return (
        members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("cut")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
        .select(*keys, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), *[c for c in members.columns if c not in (*keys, "cut")])
    )


def candidates(points: DataFrame, first: int, last: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of labels whose closure joins all alike ``points`` (node, label, bands, low) which share one of these bands.

    A bucket gives a spanning forest over its labels. Buckets of one label give
    nothing; larger ones than ``bucket`` are cut into chunks.
    """
    keys = F.slice("bands", first + 1, last - first)
    keyed = points.select("node", "label", "low", F.posexplode(keys).alias("band", "key"))
    facts = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    shared = facts.filter("lo < hi").select("band", "key", "n", F.ceil(F.col("n") / bucket).alias("cut"))
    held = join_by_key(keyed, shared, ["band", "key"], points.count() * (last - first))
    grouped = _chunked(held, ["band", "key"]).groupBy("band", "key", "i", "j").agg(F.collect_list(F.struct("label", "low")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for cell in batch.column(0):
                label = cell.values.field("label").to_numpy()
                low = np.frombuffer(b"".join(cell.values.field("low").to_pylist()), np.uint8).reshape(len(label), -1)
                x, y = _forest(label, low)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return grouped.select("members").mapInArrow(run, "a long, b long").distinct()


def linked(nodes: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Pairs of nodes which join all sets with a similarity of ``percent`` or more, by union-find over exact comparisons.

    Only sets which share one of their rarest shingles (so many that similar
    ones must) and agree in size are compared, each with its whole set.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(count[code] * np.int64(len(values)) + code, kind="stable")  # rarest first, the same for all
    owner = np.repeat(np.arange(n), size)
    place = np.empty(len(code), np.int64)
    by_owner = order[np.argsort(owner[order], kind="stable")]
    first = np.concatenate(([0], np.cumsum(size)))
    place[by_owner] = np.arange(len(code)) - np.repeat(first[:-1], size)
    # with o in common, one set may miss o - its own size of its rarest ones
    prefix = place <= size[owner] - np.ceil(size[owner] * percent / 100)
    prefix_code, prefix_owner = code[prefix], owner[prefix]
    sorted_ = np.argsort(prefix_code, kind="stable")
    prefix_code, posting = prefix_code[sorted_], prefix_owner[sorted_]
    starts = np.searchsorted(prefix_code, np.arange(len(values) + 1))
    own = np.argsort(prefix_owner, kind="stable")
    own_code, own_start = code[prefix][own], np.concatenate(([0], np.cumsum(np.bincount(prefix_owner, minlength=n))))
    held = np.zeros(len(values), bool)
    alive = np.ones(n, bool)
    a: list[int] = []
    b: list[int] = []
    for root in range(n):
        if not alive[root]:
            continue
        alive[root] = False
        stack = [root]
        while stack:
            one = stack.pop()
            codes = own_code[own_start[one] : own_start[one + 1]]
            near = np.unique(np.concatenate([posting[starts[c] : starts[c + 1]] for c in codes]))
            near = near[alive[near]]
            near = near[(100 * size[near] >= percent * size[one]) & (percent * size[near] <= 100 * size[one])]
            if not len(near):
                continue
            mine = code[first[one] : first[one + 1]]
            held[mine] = True
            common = np.array([np.count_nonzero(held[code[first[k] : first[k + 1]]]) for k in near])
            held[mine] = False
            found = near[100 * common >= percent * (size[one] + size[near] - common)]
            alive[found] = False
            a += [nodes[root]] * len(found)
            b += [nodes[k] for k in found]
            stack += found.tolist()
    return a, b


def verified(docs: DataFrame, clustered: DataFrame, cluster: int = CLUSTER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact links (a, b) within the clusters of ``clustered`` (node, cluster, n, doc_id, text_hash, d1, d2).

    A set's text is found again by the id and hash of one of its documents, and
    the digest tells whether it is the set's. Every set is sent to its cluster
    once; clusters of more than ``cluster`` shingles are cut into chunks by
    hash, and every pair of chunks is one group.
    """
    sizes = clustered.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("n_sets"))
    cut = sizes.filter("n_sets > 1").select("cluster", F.greatest(F.ceil(F.col("total") / cluster), F.ceil(F.col("n_sets") / BUCKET)).alias("cut"), F.col("n_sets").alias("n"))
    total = clustered.count()
    held = join_by_key(clustered.withColumnRenamed("n", "size"), cut, ["cluster"], total)
    wanted = held.select("node", "cluster", "cut", "d1", "d2", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_hash"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), F.col(id_col).isNull().alias("_none"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(wanted) if total <= BROADCAST else wanted, ["_id", "_none", "_hash"])
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _chunked(found.select("node", "cluster", "cut", "d1", "d2", "text"), ["cluster"]).repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                a, b = linked(list(sets), list(sets.values()))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k) for k in range(6)]
            for k in range(batch.num_rows):
                cluster, i, j, node, d1, d2 = (c[k].as_py() for c in cols)
                if (cluster, i, j) != group:
                    yield from links()
                    group, sets = (cluster, i, j), {}
                if node not in sets:
                    s = shingle_hashes(word_hashes(batch.column(6)[k].as_py()), SHINGLE)
                    if len(s) and _digest(s) == (d1, d2):
                        sets[node] = s
        yield from links()

    return dealt.select("cluster", "i", "j", "node", "d1", "d2", "text").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, cluster: int = CLUSTER) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents are linked if 85 % of the union of their sets of three-word
    shingles is common to both. component_id is the least doc_id reachable;
    documents without words are linked with nothing, so they are their own, and
    a null doc_id names no component (its component has the least of the other
    ids, or null). ``kept`` says whether the row's id is its component's.
    Repeated rows and equal sets are one member of the search. Other columns are
    ignored; an empty table gives an empty result. A link is lost only if its
    pair shares none of 24 bands (once in 1.3 million times at 0.85, less above).
    """
    rows = materialize(marked(docs, id_col, text_col), "marked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    grouped = rows.filter("n > 0").groupBy("d1", "d2").agg(least, F.count("*").alias("n"), F.first("n").alias("size"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    sets = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "sets")
    points = sets.select("node", F.col("node").alias("label"), "bands", "low")
    early = materialize(components(candidates(points, 0, FIRST, bucket)), "early")
    relabelled = sets.join(early, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "bands", "low")
    late = components(candidates(relabelled, FIRST, BANDS, bucket)).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    # of labels: those joined late, then the early ones; nodes without any are alone
    labels = early.join(late, "component", "left").select("node", F.coalesce("cluster", "component").alias("cluster"))
    alone = late.join(early.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), "cluster")
    clustered = materialize(
        sets.join(labels.unionByName(alone), "node").select("node", "cluster", F.col("size").alias("n"), "least.doc_id", "least.text_hash", "d1", "d2"), "clusters"
    )
    exact = components(verified(docs, clustered, cluster, id_col, text_col))
    named = sets.select("node", "d1", "d2", "n", F.col("least.doc_id").alias("least")).join(exact, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(named.join(ids, "component").select("d1", "d2", "n", "component_id"), "classes")
    discard(clustered)
    discard(early)
    base = rows.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    worded = join_by_key(base.filter("n_shingles > 0"), classes, ["d1", "d2"], rows.count()).select("doc_id", "n_shingles", "component_id")
    empty = base.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by their sets of three-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
