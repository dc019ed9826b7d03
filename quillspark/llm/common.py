"""Small helpers which the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.joins import join_by_key
from quillspark.storage import discard, materialize, shared_dir

__all__ = ["discard", "held_out", "join_by_key", "lean", "materialize", "release", "read_table", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


#: By name, what drops a store which a worker keeps from task to task.
stores: dict[str, Callable[[], None]] = {}


def release(uses: str = "") -> None:
    """Hand memory which is held but not used back to the machine: a worker keeps it for its next task, beside that task's own.

    So it keeps stores of other operators than ``uses``, which are dropped.
    """
    for name, drop in stores.items():
        if name != uses:
            drop()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # the GNU library's
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its worker holds no more than it uses.

    ``uses``: the store which it leaves for the next task of its kind.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(uses)
        yield from run(batches)
        release(uses)

    return whole
