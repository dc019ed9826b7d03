"""Keyword hits followed by semantic hits, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import display
from quillspark.operators import batch, nearpages
from quillspark.operators.index import SearchIndex
from quillspark.storage import materialize


def appended(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, slug, origin, place) of keyword hits, then of those semantic hits whose slug a query does not have yet.

    Both sides are (query_id, slug, rank). A slug found twice by one side counts
    at its best rank; places run from 1 on within a query.
    """
    best = lambda df, o, k: df.groupBy("query_id", "slug").agg(F.min("rank").alias("rank")).select("query_id", "slug", "rank", F.lit(o).alias("origin"), F.lit(k).alias("_side"))
    one = best(keyword, "keyword", 0)
    two = best(semantic, "semantic", 1).join(one.select("query_id", "slug"), ["query_id", "slug"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("_side", "rank", "slug")
    return one.unionByName(two.select(one.columns)).withColumn("place", F.row_number().over(w)).select("query_id", "slug", "origin", "place")


def hybrid_search(index: SearchIndex, queries: DataFrame, vectors: DataFrame, k: int = 12, above: float = 0.3, probes: int | None = None, digits: int | None = None) -> DataFrame:
    """The hits of each of ``queries`` (query_id, query, embedding) as :func:`appended`; ``vectors`` are (vec_id, path, embedding) of pages.

    Keyword hits come from the stored index, semantic ones are the ``k`` nearest
    vectors above a cosine similarity. Pages that are hidden or reserved are no
    hits. A query without a usable vector, or without a keyword hit, has the
    hits of the other side. Scores equal to so many ``digits`` are ties.
    """
    asked = materialize(queries.select("query_id", "query", "embedding"), "hybrid")
    found = batch.search_batch(index, asked.select("query_id", "query"), k, digits=digits).hits
    score = F.col("score") if digits is None else F.round("score", digits)
    order = Window.partitionBy("query_id").orderBy(F.col("title_match").desc(), score, "path", "space_id")
    slug = display.concept_id(F.col("path")).alias("slug")
    words = found.filter(display.is_searchable(F.col("path"))).select("query_id", slug, F.row_number().over(order).alias("rank"))
    # a query is no page: ids of queries are kept apart from those of vectors
    shown = vectors.filter(display.is_searchable(F.col("path")))
    near = nearpages.nearest_pages(asked.select((-F.col("query_id") - 1).alias("vec_id"), "embedding"), shown.select("vec_id", "embedding"), k, above, probes)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")))
    meaning = ranked.join(shown.select("vec_id", slug), "vec_id").select((-F.col("query_id") - 1).alias("query_id"), "slug", "rank")
    return appended(words, meaning)
