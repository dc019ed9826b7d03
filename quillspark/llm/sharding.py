"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by id into a fixed number of virtual slots (thousands). The
bytes and rows of each slot are aggregated once, and a small map says which
shard holds a slot. The map is stored as a versioned table; a rebalance edits
the newest version, moves as few slots as needed, and writes the next one.
Records never change their slot, so a move is always of whole slots.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quillspark.llm.common import materialize, read_table, shared_dir

N_SLOTS = 8192
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """``shards[s]`` is the shard which holds virtual slot ``s``."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        """Version 1: slots dealt round robin."""
        if n_shards < 1 or n_slots < n_shards:
            raise ValueError("needs 1 <= n_shards <= n_slots")
        return cls(1, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.shards)), "virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table; versions are never rewritten."""
        (
            self.frame(spark)
            .withColumn("n_shards", F.lit(self.n_shards))
            .coalesce(1)
            .write.parquet(f"{path}/version={self.version}")
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the newest. A map has one row per slot, thousands, never per record."""
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(int(version), rows[0]["n_shards"], tuple(r["shard"] for r in rows))

    @classmethod
    def newest(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The newest stored version; None if there is no table yet."""
        try:
            return cls.load(spark, path)
        except AnalysisException:
            return None

    def rebalance(self, weights: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version, with shard weights near equal.

        ``weights`` has the bytes of each slot (none: zero). Slots which fit
        into a shard's excess over the mean move, largest first, to the
        emptiest shard; a last pass exchanges slots between the fullest and
        the emptiest shard while their gap shrinks. Works on the slot table only.
        """
        n = n_shards or self.n_shards
        shards = [s if s < n else s % n for s in self.shards]
        load = [0] * n
        held: list[list[int]] = [[] for _ in range(n)]
        for slot, shard in enumerate(shards):
            load[shard] += weights.get(slot, 0)
            held[shard].append(slot)
        mean = sum(load) / n
        loose = []
        for shard in range(n):
            for slot in sorted(held[shard], key=lambda s: (-weights.get(s, 0), s)):
                w = weights.get(slot, 0)
                if 0 < w <= load[shard] - mean:
                    load[shard] -= w
                    loose.append((w, slot))
        heap = [(load[s], s) for s in range(n)]
        heapq.heapify(heap)
        for w, slot in sorted(loose, key=lambda x: (-x[0], x[1])):
            at, shard = heapq.heappop(heap)
            shards[slot] = shard
            heapq.heappush(heap, (at + w, shard))
        return SlotMap(self.version + 1, n, tuple(_smoothed(shards, weights, n)))


def _smoothed(shards: list[int], weights: dict[int, int], n: int) -> list[int]:
    """Exchange slots between the fullest and the emptiest shard while their gap shrinks."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for slot, shard in enumerate(shards):
        held[shard].append((weights.get(slot, 0), slot))
    load = [sum(w for w, _ in h) for h in held]
    for _ in range(20 * n):
        a, b = max(range(n), key=load.__getitem__), min(range(n), key=load.__getitem__)
        gap = load[a] - load[b]
        if gap <= 1:
            break
        small = sorted(held[b]) or [(0, -1)]
        best = (0, None, None)
        for x in held[a]:
            # the partner whose difference comes nearest to half the gap
            want = x[0] - gap / 2
            lo, hi = 0, len(small)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if small[mid][0] < want else (lo, mid)
            for y in [*small[max(0, lo - 1) : lo + 1], None]:
                d = x[0] - (y[0] if y else 0)
                if 0 < d < gap and (gain := min(d, gap - d)) > best[0]:
                    best = (gain, x, y)
        if not best[0]:
            break
        _, x, y = best
        held[a].remove(x)
        held[b].append(x)
        if y:
            held[b].remove(y)
            held[a].append(y)
        d = x[0] - (y[0] if y else 0)
        load[a], load[b] = load[a] - d, load[b] + d
    out = list(shards)
    for shard in range(n):
        for _, slot in held[shard]:
            out[slot] = shard
    return out


def slotted(df: DataFrame, id_col: str, text_col: str, n_slots: int = N_SLOTS) -> DataFrame:
    """id, size (UTF-8 bytes and 16), text_crc32 and virtual slot of each record.

    A record is hashed by its id and the crc32 of its text, so rows without an
    id, and texts which share one, spread over the slots. Null texts have size
    16 and the crc32 of an empty text, 0. Rows equal in both share a slot.
    """
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def shard(
    df: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """Assign each record to a shard so that the shards' bytes are near equal.

    The newest map stored at ``map_path`` is edited, slots moving only as far
    as balance needs, and saved as the next version if it changed; without a
    stored map, version 1 deals the slots round robin.

    Returns doc_id, size, text_crc32, virtual_slot, shard, map_version and
    slot, the record's place within its shard, gapless from 0. Texts are read
    once and never shuffled. Only slot totals (``n_slots`` rows, whatever the
    input) reach the driver. The place is the number of rows in the shard's
    earlier virtual slots plus the row's rank in its own slot, so no task sorts
    a whole shard. An empty table gives an empty result. Ties between equal
    ids are broken by crc32 and size; rows equal in all of them get places in
    any order.
    """
    spark = df.sparkSession
    rows = materialize(slotted(df, id_col, text_col, n_slots), "slotted")
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    stored = SlotMap.newest(spark, path)
    if stored is None:
        stored = SlotMap.initial(n_slots, n_shards)
        stored.save(spark, path)
    if len(stored.shards) != n_slots:
        raise ValueError(f"the stored map has {len(stored.shards)} slots")
    slot_map = stored.rebalance({r["virtual_slot"]: r["bytes"] for r in totals}, n_shards)
    if (slot_map.shards, slot_map.n_shards) == (stored.shards, stored.n_shards):
        slot_map = stored
    else:
        slot_map.save(spark, path)
    counts = {r["virtual_slot"]: r["n"] for r in totals}
    at = [0] * n_shards
    placed = []
    for s, k in enumerate(slot_map.shards):
        placed.append((s, k, at[k]))
        at[k] += counts.get(s, 0)
    where = spark.createDataFrame(
        placed,
        T.StructType(
            [
                T.StructField("virtual_slot", T.IntegerType()),
                T.StructField("shard", T.IntegerType()),
                T.StructField("before", T.LongType()),
            ]
        ),
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(where), "virtual_slot")  # n_slots rows at most
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "virtual_slot",
            "shard",
            (F.col("before") + F.col("rank") - 1).alias("slot"),
            F.lit(slot_map.version).alias("map_version"),
        )
    )


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 under the law ``bytes``."""
    out = shard(read_table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
