"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt by hash into blocks of bounded size. Best-fit decreasing packs
each block; a block that does not reach its lower bound evolves on several
islands. A chromosome is a list of sequences. Crossover injects whole
well-filled sequences of one parent into the other, removes the sequences with
duplicates, and best-fits the displaced documents. After each epoch an island's
elite migrates to the next island. The pieces of ill-filled sequences of all
blocks are then dealt anew into fewer blocks, until one block is left.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import lean, materialize, read_table
from quillspark.llm.tokens import slices, tokenizer

CAPACITY = 2048
#: Pieces of a block, islands of a block, epochs between migrations, generations of an epoch, chromosomes of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 3, 2, 12, 6
#: Sequences filled to less than this share are dealt anew at the next level.
WELL_FILLED = 0.995


class _Bins:
    """Sequences by free room: the tightest one which takes a piece is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def _file(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.by_room.setdefault(r, []).append(b)
            self.mask |= 1 << r

    def add(self, items: list[int], used: int) -> None:
        self.items.append(items)
        self.room.append(self.capacity - used)
        self._file(len(self.items) - 1)

    def put(self, item: int, size: int) -> None:
        found = self.mask >> size
        if not found:
            self.add([item], size)
            return
        r = size + (found & -found).bit_length() - 1
        held = self.by_room[r]
        b = held.pop()
        if not held:
            self.mask ^= 1 << r
        self.items[b].append(item)
        self.room[b] = r - size
        self._file(b)


def best_fit(sizes: list[int], order: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    """Put the items of ``order`` one by one into the fullest sequence with room, beside those of ``start``."""
    bins = _Bins(capacity)
    for b in start:
        bins.add(list(b), sum(sizes[i] for i in b))
    for i in order:
        bins.put(i, sizes[i])
    return bins.items


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer: total size, or the pieces of which no two fit together (with what must join them)."""
    best = -(-sum(sizes) // capacity)
    big = sum(s > capacity // 2 for s in sizes)
    for k in sorted({capacity - s for s in sizes if s > capacity // 2} | {0}):
        alone = sum(s > capacity - k for s in sizes) if k else 0
        large = [s for s in sizes if capacity // 2 < s <= capacity - k]
        rest = sum(s for s in sizes if k <= s <= capacity // 2)
        free = len(large) * capacity - sum(large)
        best = max(best, alone + len(large) + max(0, -(-(rest - free) // capacity)))
        if k > capacity // 4:
            break
    return max(best, big)


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones (mean square of the fill)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes, one, two, capacity: int, rng: random.Random):
    """Whole well-filled sequences of ``two`` enter ``one``; what they displace is best-fitted."""
    full = sorted(two, key=lambda b: -sum(sizes[i] for i in b))[: max(1, len(two) // 2)]
    injected = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, capacity, [*injected, *kept])


def mutate(sizes, bins, capacity: int, rng: random.Random):
    """Dissolve some of the worst-filled sequences and one random one."""
    worst = sorted(range(len(bins)), key=lambda b: sum(sizes[i] for i in bins[b]))[:3]
    gone = {*worst, rng.randrange(len(bins))}
    loose = [i for b in gone for i in bins[b]]
    loose.sort(key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1))
    return best_fit(sizes, loose, capacity, [b for k, b in enumerate(bins) if k not in gone])


def evolve(sizes, start, capacity: int, bound: int, seed: int, generations: int, population: int):
    """The fittest chromosome after some generations; ends early at the lower bound. ``start`` has elites."""
    rng = random.Random(seed)
    ranked = lambda c: (fitness(sizes, c, capacity), c)
    pool = [ranked(c) for c in start]
    while len(pool) < population and max(pool)[0][0] < -bound:
        noise = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.7, 1.3))
        pool.append(ranked(best_fit(sizes, noise, capacity)))
    pool.sort(key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(pool[0][1]) <= bound:
            break
        (_, one), (_, two) = rng.sample(pool[: max(2, population // 2)], 2)
        child = mutate(sizes, crossover(sizes, one, two, capacity, rng), capacity, rng)
        pool = sorted([*pool[: population - 1], ranked(child)], key=lambda x: x[0], reverse=True)
    return pool[0][1]


def _genome(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(genome: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(genome):
        out.setdefault(k, []).append(i)
    return list(out.values())


_BLOCKS = "block long, keys array<long>, sizes array<int>, genome array<int>, bins int, bound int"
_KINDS = {
    "block": pa.int64(), "island": pa.int32(), "keys": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()),
    "genome": pa.list_(pa.int32()), "bins": pa.int32(), "bound": pa.int32(),
}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[n]) for n in names], names)


def _pack_level(pieces: DataFrame, n: int, capacity: int, block: int, level: int) -> DataFrame:
    """(key, size, block, bin) of each piece of one level; ``key`` names a piece."""
    n_blocks = max(1, -(-n // block))
    grouped = (
        pieces.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(n_blocks)))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "key"))).alias("p"))
        .select("block", F.col("p.key").alias("keys"), F.transform("p.s", lambda s: -s).alias("sizes"))
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bins = best_fit(r["sizes"], list(range(len(r["sizes"]))), capacity)
                r |= {"genome": _genome(bins, len(r["sizes"])), "bins": len(bins), "bound": lower_bound(r["sizes"], capacity)}
                yield _batch([r], ["block", "keys", "sizes", "genome", "bins", "bound"])

    best = materialize(grouped.mapInArrow(lean(first), _BLOCKS), "packed")
    hard = best.filter("bins > bound")
    if not hard.isEmpty():
        islands = hard.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        for epoch in range(EPOCHS):

            def run(batches: Iterator[pa.RecordBatch], epoch=epoch) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for r in b.to_pylist():
                        start = [_bins(g) for g in (r["genome"], r.get("migrant")) if g]
                        seed = (r["block"] * 31 + r["island"]) * 31 + epoch
                        bins = evolve(r["sizes"], start, capacity, r["bound"], seed, GENERATIONS, POPULATION)
                        r |= {"genome": _genome(bins, len(r["sizes"])), "bins": len(bins)}
                        yield _batch([r], ["block", "island", "keys", "sizes", "genome", "bins", "bound"])

            # by number, so that small rows with much work are not put together again
            dealt = islands.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "island")
            islands = materialize(dealt.mapInArrow(lean(run), "block long, island int, " + _BLOCKS.split(", ", 1)[1]), "islands")
            if epoch + 1 < EPOCHS:
                elite = islands.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("genome").alias("migrant"))
                islands = islands.filter("bins > bound").join(elite, ["block", "island"], "left").unionByName(
                    islands.filter("bins <= bound"), allowMissingColumns=True
                )
        fittest = islands.groupBy("block").agg(F.min_by("genome", F.struct("bins", "island")).alias("evolved"), F.min("bins").alias("n"))
        best = best.join(fittest, "block", "left").withColumn("genome", F.when(F.col("n") < F.col("bins"), F.col("evolved")).otherwise(F.col("genome")))
    each = F.explode(F.arrays_zip("keys", "sizes", "genome")).alias("x")
    return best.select("block", each).select(
        F.col("x.keys").alias("key"), F.col("x.sizes").alias("size"), "block", F.col("x.genome").alias("bin")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, levels: int = 4) -> DataFrame:
    """(key, sequence_id, offset) for ``pieces`` (key, size), at most ``capacity`` in a sequence.

    Keys are distinct longs, sizes from 1 to ``capacity``. A block has about
    ``block`` pieces at any input size. An empty table gives an empty result.
    Equal sizes are taken in order of the key, so results repeat.
    """
    rest, done = materialize(pieces.select("key", F.col("size").cast("int").alias("size")), "pieces"), None
    for level in range(levels):
        n = rest.count()
        placed = materialize(_pack_level(rest, n, capacity, block, level).withColumn("level", F.lit(level)), "placed")
        last = n <= block or level == levels - 1
        if not last:
            fill = placed.groupBy("block", "bin").agg((F.sum("size") < WELL_FILLED * capacity).alias("ill"))
            placed = materialize(placed.join(fill, ["block", "bin"]), "judged")
            rest = placed.filter("ill").select("key", "size")
            placed = placed.filter("not ill").drop("ill")
        done = placed if done is None else done.unionByName(placed)
        if last:
            break
    from pyspark.sql import Window

    # a sequence holds at most ``capacity`` pieces
    before = Window.partitionBy("level", "block", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("level").cast("long") * (1 << 56) + F.col("block") * (1 << 24) + F.col("bin")
    return done.select(
        "key", number.alias("sequence_id"), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset")
    )


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids and an end id, cut at ``capacity``.

    Null and empty texts are the end id alone. Texts and ids stay in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary, False)
        for b in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            each = (ids for texts in slices(b.column(1)) for ids in t.ids_of(texts))
            for doc, got in zip(b.column(0).to_pylist(), each, strict=True):
                ids = np.append(got, np.uint16(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for c, v in zip(cols, (doc, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run, "tokens"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, **columns) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Null and empty texts are the end id alone. A repeated row is packed once
    for each row, and a null doc_id stays null. An empty table gives an empty
    result.
    """
    # numbered after writing, so that the numbers are those of files and do not change
    pieces = materialize(pieces_of(docs, vocabulary, capacity, **columns), "pieces").withColumn("key", F.monotonically_increasing_id())
    pieces = materialize(pieces, "keyed-pieces")
    packed = pack(pieces.select("key", F.col("length").alias("size")), capacity)
    return pieces.join(packed, "key").drop("key")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"), word_vocabulary())
