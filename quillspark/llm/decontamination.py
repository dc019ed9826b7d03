"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words. A document holds a window
only if it holds all of the window's words, so at containment 1 the prefix
which every match must share is the window's rarest word, by the words' counts
over all documents. Document words are joined with these prefix words; a
candidate survives if the window fits between the document's first and last
word (length and position), and is then verified word by word. Verified
windows mark their words as hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import lean, materialize, read_table

WINDOW = 10
#: Item bytes broadcast at once; a larger benchmark is joined in blocks of about so many.
BLOCK_BYTES = 16 << 20

#: Separators become blanks, A-Z lower case; every byte from 0x80 on belongs to a word.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """Runs of ``size`` words; fewer words, but not none, are one window."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """One text at a time, so that a batch of long texts is not held twice."""
    for x in batch.column(batch.schema.get_field_index("text")):
        yield x.as_py()


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each of the vocabulary's words occurs in all documents.

    Each task counts its own rows and sends one row for each word it met; the
    result has at most as many rows as the vocabulary, which the caller bounds.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in _texts(batch):
                for w in words_of(text):
                    if w in known.value:
                        seen[w] += 1
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())}
        )

    total = docs.select("text").mapInArrow(lean(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in total.collect()}


class WindowIndex:
    """Windows by their rarest word: ``prefix[word]`` has (place of the word in the window, window)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], counts: dict[bytes, int], size: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            for w in windows_of(words, size):
                owners[w].add(item)
        self.owners = {w: tuple(sorted(o)) for w, o in owners.items()}
        self.prefix: dict[bytes, list[tuple[int, tuple[bytes, ...]]]] = defaultdict(list)
        for w in self.owners:
            rank = [(counts.get(x, 0), x) for x in w]
            at = min(range(len(w)), key=rank.__getitem__)
            self.prefix[w[at]].append((at, w))
        # equal prefix, place and length: one look-up of the document's run instead of a walk over all windows
        self.shapes = {x: sorted({(at, len(w)) for at, w in found}) for x, found in self.prefix.items()}

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside any occurring window, and the items with one."""
        hit = np.zeros(len(words) + 1, np.int32)
        items: set[str] = set()
        shapes, owners, n = self.shapes, self.owners, len(words)
        for i in [i for i, w in enumerate(words) if w in shapes]:
            for at, length in shapes[words[i]]:
                start = i - at
                if start < 0 or start + length > n:
                    continue
                run = tuple(words[start : start + length])
                if (found := owners.get(run)) is not None:
                    hit[start] += 1
                    hit[start + length] -= 1
                    items.update(found)
        return np.cumsum(hit[:-1]) > 0, items


_RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "hit_spans array<struct<first:int,last:int>>, item_ids array<string>"
)


def _gathered(items: DataFrame) -> list[tuple[str, list[bytes]]]:
    """A block of items as words on the driver; blocks are cut so that this is bounded."""
    return [(r["item"], words_of(r["text"])) for r in items.toLocalIterator()]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Words of each document which lie in windows of items.

    Returns one row per row of ``docs`` (a repeated row: a row each): doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (first and
    last hit word of each run) and item_ids. Null and empty texts have no
    words, no hits, and the digest of an empty list. Null item ids and null,
    empty or wordless items have no windows. With no items nothing is hit.
    Repeated items count once for each distinct id. Other columns are ignored.

    The benchmark is the query side: its words and windows are what is
    broadcast, in blocks of about ``block_bytes`` bytes of items, dealt by the hash of the id, all documents
    against each block. Documents are never shuffled for a single block; for
    more, only hit spans are, grouped by document row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter(
        "item is not null and text is not null"
    )
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    if n_blocks <= 1:
        return _one_block(rows, _gathered(wanted), window)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # the same numbers for each block
    parts = None
    for k in range(n_blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k)
        out = _one_block(rows, _gathered(block), window, keep_row=True)
        parts = out if parts is None else parts.unionByName(out)
    return _merged(parts)


def _one_block(rows: DataFrame, items: list[tuple[str, list[bytes]]], window: int, keep_row: bool = False) -> DataFrame:
    spark = rows.sparkSession
    vocabulary = frozenset(w for _, words in items for w in words)
    counts = word_counts(rows, vocabulary) if vocabulary else {}
    index = spark.sparkContext.broadcast(WindowIndex(items, counts, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_row(words_of(t), index.value) for t in _texts(batch)]
            cols = {"doc_id": batch.column(batch.schema.get_field_index("doc_id"))}
            if keep_row:
                cols["row"] = batch.column(batch.schema.get_field_index("row"))
            names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "item_ids")
            kinds = (
                pa.int64(),
                pa.int64(),
                pa.int64(),
                pa.string(),
                pa.bool_(),
                pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
                pa.list_(pa.string()),
            )
            for name, kind, values in zip(names, kinds, zip(*out) if out else [[]] * 7, strict=True):
                cols[name] = pa.array(values, kind)
            yield pa.RecordBatch.from_pydict(cols)

    schema = _RESULT.replace("doc_id long,", "doc_id long, row long,") if keep_row else _RESULT
    return rows.mapInArrow(lean(scan), schema)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _row(words: list[bytes], index: WindowIndex) -> tuple:
    hit, items = index.matches(words)
    names = sorted(items)
    return len(words), int(hit.sum()), len(names), _digest(names), bool(names), _spans(hit), names


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each document row from the spans of all blocks: covered words are the union of the spans."""
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] + 1 >= x["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["first"].alias("first"),
                        F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return (
        whole.withColumn("hit_spans", joined)
        .withColumn("n_hit", n_hit)
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("item_ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            "hit_spans",
            "item_ids",
        )
    )


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's windows of 10 words in all documents."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop(
        "hit_spans", "item_ids"
    )
