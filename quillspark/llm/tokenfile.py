"""Token-ID files: documents' ids in independently coded segments of checksummed blocks.

A segment holds consecutive ids: a header (magic, the documents which they
belong to and how many ids of each), the segment's alphabet, and blocks of
``BLOCK`` ids by :mod:`quillspark.llm.idcoder`. Each block starts from a fresh
model and has the CRC-32 of its ids, so one block can be read, or be found
damaged, without the others. A document which does not fit into what is left
of a segment goes on in the next one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import idcoder
from quillspark.llm.common import materialize, read_table, shared_dir
from quillspark.llm.tokens import slices, tokenizer

MAGIC = b"QTOK3\n"
BLOCK = idcoder.BLOCK
#: Blocks of a segment at most, which bounds the memory of a task.
LANES = 4096
#: Bytes of text which make a file of the table.
FILE_BYTES = 36 << 20
#: Files whose totals are added up in one task.
_GROUP = 1024


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, first: int = 0, begun: bool = False, goes_on: bool = False) -> bytes:
    """One segment, of documents number ``first`` and on of a file. A null document id is written as a flag and zero.

    ``begun``: the first document has ids in the segment before; ``goes_on``: the last one has more in the next.
    """
    alphabet, parts = idcoder.encode(ids, BLOCK)
    head = [MAGIC, struct.pack("<IIQQ??", len(doc_ids), len(parts), len(ids), first, begun, goes_on)]
    head.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    head.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    head.append(np.array(lengths, "<u4").tobytes())
    head.append(alphabet)
    for k, p in enumerate(parts):
        head.append(struct.pack("<II", len(p), zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u2").tobytes())))
    return b"".join(head + parts)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int, bool, bool]:
    """Document ids, lengths, all ids, the first document's number, whether it had begun and whether the last one goes on.

    Raises if the magic or a block's checksum does not hold.
    """
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token segment")
    at = len(MAGIC)
    docs, blocks, n, first, begun, goes_on = struct.unpack_from("<IIQQ??", data, at)
    at += 26
    null = np.frombuffer(data, np.uint8, docs, at)
    numbers = np.frombuffer(data, "<i8", docs, at + docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    alphabet, at = idcoder.Alphabet.from_bytes(data, at + 13 * docs)
    table = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(-1, 2)
    at += 8 * blocks
    ends = at + np.cumsum(table[:, 0].astype(np.int64))
    parts = [data[e - int(s) : e] for e, s in zip(ends.tolist(), table[:, 0], strict=True)]
    ids = idcoder.decode(alphabet, parts, n, BLOCK)
    for k in range(blocks):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u2").tobytes()) != table[k, 1]:
            raise ValueError(f"block {k} is damaged")
    return [None if z else int(d) for z, d in zip(null, numbers, strict=True)], lengths.astype(np.int64), ids, first, begun, goes_on


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all rows in ascending order of their id (nulls first) as a table of segments.

    Null and empty texts are the end id alone; repeated rows are written each;
    an empty table makes a table of no segments. A file holds a range of ids.
    Its segments are cut when ``LANES`` blocks are full, within a document too,
    so a task holds one segment and one text at a time, whatever their number
    and length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(1, -(-size // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary, True)
        most = LANES * BLOCK
        numbers: list[int | None] = []
        held: list[np.ndarray] = []
        n, segment, number, begun = 0, 0, -1, False

        def cut(goes_on: bool):
            data = write_segment(numbers, [len(x) for x in held], np.concatenate(held), number - len(numbers) + 1, begun, goes_on)
            return pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([len(numbers)], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())],
                ["segment", "docs", "ids", "data"],
            )

        for b in batches:
            each = (ids for texts in slices(b.column(1)) for ids in t.ids_of(texts))
            for doc, got in zip(b.column(0).to_pylist(), each, strict=True):
                rest = np.append(got, np.uint16(end_id))
                number += 1
                while len(rest):
                    part, rest = rest[: most - n], rest[most - n :]
                    numbers.append(doc)
                    held.append(part)
                    n += len(part)
                    if n == most:
                        yield cut(len(rest) > 0)
                        begun = len(rest) > 0
                        numbers, held, n = [], [], 0
                        segment += 1
        if held:
            yield cut(False)

    (
        ranged.mapInArrow(run, "segment int, docs long, ids long, data binary")
        .withColumn("file", F.spark_partition_id())
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, lowest power in the highest bit."""
    out = 0
    while a:
        if a & 1 << 31:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row from their own ones and the second's length."""
    power, square, n = 1 << 31, 1 << 23, length  # x to the 0, x to the 8
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(first, power) ^ second


def _starts(totals: DataFrame) -> DataFrame:
    """(file, segment, start): how many ids stand before each segment.

    Files are added up by groups of ``_GROUP``; the driver sees one row for each
    group (some gigabytes of text), and no window holds all segments.
    """
    spark = totals.sparkSession
    files = totals.groupBy("file").agg(F.sum("ids").alias("n")).withColumn("group", F.floor(F.col("file") / _GROUP))
    groups = {r["group"]: r["n"] for r in files.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    at, before = 0, []
    for g in sorted(groups):
        before.append((g, at))
        at += groups[g]
    of_group = spark.createDataFrame(before, "group long, group_start long")
    earlier = lambda *by: Window.partitionBy(by[0]).orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)
    of_file = files.withColumn("in_group", F.coalesce(F.sum("n").over(earlier("group", "file")), F.lit(0))).join(F.broadcast(of_group), "group")
    of_file = of_file.select("file", (F.col("group_start") + F.col("in_group")).alias("file_start"))
    inner = totals.withColumn("inner", F.coalesce(F.sum("ids").over(earlier("file", "segment")), F.lit(0)))
    return inner.join(of_file, "file").select("file", "segment", (F.col("file_start") + F.col("inner")).alias("start"))


_PARTS = "file int, segment int, number long, doc_id long, offset long, n long, crc long, whole boolean"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the stored segments.

    ``start`` counts the ids of all documents before it in the files. The parts
    of a document that goes over segments are put together by their numbers.
    """
    table = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, segment, data in zip(*(b.column(i) for i in range(3)), strict=True):
                docs, lengths, ids, first, begun, goes_on = read_segment(data.as_py())
                ends = np.cumsum(lengths)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(docs)
                whole = np.ones(k, bool)
                whole[0] &= not begun
                whole[-1] &= not goes_on
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * k, pa.int32()), pa.array([segment.as_py()] * k, pa.int32()), pa.array(np.arange(first, first + k)),
                     pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(whole)],
                    [f.split()[0] for f in _PARTS.split(", ")],
                )

    decoded = materialize(table.select("file", "segment", "data").mapInArrow(run, _PARTS), "decoded")
    placed = decoded.join(_starts(table.select("file", "segment", "ids")), ["file", "segment"]).withColumn("start", F.col("start") + F.col("offset"))

    def join_parts(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("segment")
        crc = 0
        for c, n in zip(part["crc"].tolist(), part["n"].tolist(), strict=True):
            crc = crc32_joined(crc, c, 4 * n)
        first = part.iloc[:1]
        return first[["doc_id", "start"]].assign(n_tokens=part["n"].sum(), ids_crc32=crc)

    cut = placed.filter("not whole").groupBy("file", "number").applyInPandas(join_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")
    whole = placed.filter("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    return whole.unionByName(cut)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as token files and read back."""
    import uuid

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(read_table(spark, sf_dir, "documents"), path, byte_vocabulary())
    return read_tokens(spark, path)
