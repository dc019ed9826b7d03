"""Similarity of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the queries which are sent to the tasks at once.
QUERY_BYTES = 64 << 20
#: Queries and rows which meet in one product; the greatest id stands where there is no row yet.
QUERIES, ROWS = 512, 2048
_NONE = np.iinfo(np.int64).max


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _units(vectors: list[list[float]] | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(queries: DataFrame, rows: DataFrame, k: int, above: float, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, vec_id, similarity): the best ``k`` of ``rows`` above a similarity for a stated query set.

    Any number of queries: they are dealt by hash into blocks of about
    ``query_bytes``, each block meets all rows in one matrix product a batch,
    and a task keeps the best ``k`` a query. Ties go to the lesser vec_id. Null
    vectors and those of length zero are similar to none. A query does not
    find its own id.
    """
    spark = rows.sparkSession
    usable = lambda df: df.filter("embedding is not null and exists(embedding, x -> x <> 0)").select("vec_id", "embedding")
    q = usable(queries)
    size = q.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    # a task holds the vector of each query, and the similarity and id of its best k
    blocks = max(1, -(-(size["n"] or 0) * ((size["d"] or 1) * 8 + 16 * k) // query_bytes))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    partial = None
    for b in range(blocks):
        held = q.filter(F.col("block") == b).orderBy("vec_id").collect()  # one block, of bounded bytes
        if not held:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in held]), _units([r["embedding"] for r in held])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            # the best so far: a row a query, k wide, whatever the number of rows
            top, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), _NONE)
            for batch in batches:
                vec = batch.column(0).to_numpy(zero_copy_only=False)
                lists = batch.column(1)
                if not len(vec):
                    continue
                mine = _units(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(lists[0])))
                for r in range(0, len(vec), ROWS):
                    own, some = vec[r : r + ROWS], mine[r : r + ROWS].T
                    for q in range(0, len(ids), QUERIES):
                        s = unit[q : q + QUERIES] @ some
                        # only what may be among the best k is looked at; an equal one with a lesser id is
                        at, row = np.nonzero((s > above) & (s >= top[q : q + QUERIES, -1:]))
                        other = ids[q + at] != own[row]
                        at, row = at[other], row[other]
                        if not len(at):
                            continue
                        asked = np.unique(at)
                        at = np.concatenate((at, np.repeat(asked, k)))
                        sim = np.concatenate((s[at[: len(row)], row], top[q + asked].ravel()))
                        name = np.concatenate((own[row], who[q + asked].ravel()))
                        order = np.lexsort((name, -sim, at))
                        at, sim, name = at[order], sim[order], name[order]
                        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                        ok = place < k
                        top[q + at[ok], place[ok]], who[q + at[ok], place[ok]] = sim[ok], name[ok]
            for q in range(0, len(ids), QUERIES):
                at, place = np.nonzero(top[q : q + QUERIES] > -np.inf)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q + at]), pa.array(who[q + at, place]), pa.array(top[q + at, place])], ["query_id", "vec_id", "similarity"])

        part = usable(rows).mapInArrow(run, "query_id long, vec_id long, similarity double")
        partial = part if partial is None else partial.unionByName(part)
    if partial is None:
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))
