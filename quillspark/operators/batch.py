"""The best pages of many queries at once, from stored postings.

Postings of every part of any query are put together once, in blocks of
neighbouring page numbers with the greatest frequency and least length of a
block. From these a block's score for a query is bounded before a posting of it
is looked at. The most promising blocks of each query are scored first; their
k-th best page is a threshold, and only blocks whose bound reaches it are
scored after that. Equal queries are asked once. A block's postings meet its
queries in one group, which gives the best pages of each query only, so the
pages that match a query are never written.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import paths
from quillspark.operators import search
from quillspark.operators.index import SearchIndex
from quillspark.operators.search import B, BODY_WEIGHT, K1, TITLE_WEIGHT
from quillspark.storage import materialize

#: Page numbers of a block are equal but for so many bits. Blocks are scored for a query's threshold until they may hold so many times k pages.
BLOCK_BITS, SEEDS = 12, 2
#: Terms up to which ranges of postings are picked one by one, and parts up to which they are broadcast.
FEW_TERMS, FEW_PARTS = 1000, 100_000
_PARTS = "array<struct<raw:string,terms:array<string>>>"


class Batch(NamedTuple):
    hits: DataFrame
    #: One row: candidate_blocks, blocks with all parts of a query, and scored_blocks, those whose postings were joined.
    report: DataFrame


def _parsed(queries: DataFrame) -> DataFrame:
    """(query_id, needle, space, parts) of the queries which can have hits: all their parts have tokens."""

    @F.pandas_udf(f"needle string, parts {_PARTS}")
    def parse(query: pd.Series) -> pd.DataFrame:
        needles = [(q or "").strip().lower() for q in query]
        parts = [[{"raw": raw, "terms": terms} for raw, terms in zip(n.split(), search.query_phrases(q or ""), strict=True)] for n, q in zip(needles, query, strict=True)]
        return pd.DataFrame({"needle": [n.replace("\1", "") for n in needles], "parts": parts})

    space = F.col("space_id").cast("string") if "space_id" in queries.columns else F.lit(None).cast("string")
    rows = queries.select("query_id", space.alias("space"), parse(F.col("query")).alias("p")).select("query_id", "space", "p.needle", "p.parts")
    return rows.filter(F.size("parts") > 0).filter(F.forall("parts", lambda p: F.size(p["terms"]) > 0))


def _part_postings(index: SearchIndex, few: list[str] | None, m: dict, terms: DataFrame) -> DataFrame:
    """(raw, doc, n_tokens, tf): the weighted occurrences of each part, a phrase where it has several terms. Only phrases need positions."""
    page = ["doc", "n_tokens"]
    weight = F.when(F.col("field") == "title", TITLE_WEIGHT).otherwise(BODY_WEIGHT)
    alone = index.postings(few, m).join(terms.filter("n_terms = 1").select("raw", "term"), "term").select("raw", *page, (F.col("tf") * weight).alias("tf"))
    single = alone.repartition("doc").groupBy("raw", *page).agg(F.sum("tf").alias("tf"))  # for the groups and for the titles which they meet
    several = terms.filter("n_terms > 1")
    if several.isEmpty():
        return single
    joined = index.postings(few, m).join(several, "term").repartition("doc")
    place = F.struct("at", F.expr("transform(positions, p -> p - at)").alias("begins"))
    held = joined.groupBy("raw", "n_terms", "field", *page).agg(F.collect_list(place).alias("x")).filter(F.size("x") == F.col("n_terms"))
    begins = F.aggregate(F.slice("x", 2, F.size("x")), F.element_at("x", 1)["begins"], lambda s, x: F.array_intersect(s, x["begins"]))
    phrases = held.withColumn("hits", F.size(begins)).filter("hits > 0").groupBy("raw", *page).agg(F.sum(F.col("hits") * weight).alias("tf"))
    return single.unionByName(phrases)


def _saturated(tf: Column, n_tokens: Column, avg: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / F.lit(avg or 1.0)))


def _best(scored: DataFrame, k: int, digits: int | None) -> DataFrame:
    score = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy("ask").orderBy(F.col("title_match").desc(), score, "path", "space_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _rounded(score: float, digits: int) -> Decimal:
    """As Spark rounds."""
    return Decimal(repr(score)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


_BEST = pa.schema([("ask", pa.int64()), ("doc", pa.int64()), ("space_id", pa.string()), ("path", pa.string()), ("title_match", pa.bool_()), ("score", pa.float64())])


def _best_of_block(k: int, digits: int | None, avg: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``k`` pages of a block for each query that is asked of it, none that is worse than the query's threshold.

    The block is a row for each part, with the pages that have it, and rows of
    its pages' names; their order is that of :func:`_best`.
    """
    slack = 0.0 if digits is None else 10.0**-digits * 1.001

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        parts, names = block.filter(pc.is_valid(block["raw"])), block.filter(pc.is_null(block["raw"]))
        if not (asked.num_rows and parts.num_rows and names.num_rows):
            return _BEST.empty_table()
        lists = parts["members"].combine_chunks()
        ends, held = lists.offsets.to_numpy(), lists.values
        doc, tf, n_tokens = (held.field(c).to_numpy(zero_copy_only=False) for c in ("doc", "tf", "n_tokens"))
        titled = held.field("titled").to_numpy(zero_copy_only=False)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / (avg or 1.0)))
        span = {raw: slice(s, e) for raw, s, e in zip(parts["raw"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
        pages = names["pages"].combine_chunks().flatten()
        number = pages.field("doc").to_numpy(zero_copy_only=False)
        order = np.argsort(number)
        number = number[order]
        space, path, lower = (pages.field(c).take(pa.array(order)).to_numpy(zero_copy_only=False) for c in ("space_id", "path", "lower"))
        out: list[tuple] = []

        def first(page: np.ndarray, score: np.ndarray, few: int) -> list[int]:
            """Places of the best ``few`` of pages with the same title_match."""
            at = np.arange(len(page))
            if len(page) > few > 0:
                at = np.flatnonzero(score <= np.partition(score, few - 1)[few - 1] + slack)
            key = lambda i: (score[i] if digits is None else _rounded(float(score[i]), digits), path[page[i]], space[page[i]])
            return sorted(at.tolist(), key=key)[:few]

        for ask, needle, within, terms, last_match, last_score in zip(*[asked[c].to_pylist() for c in ("ask", "needle", "space", "terms", "last_match", "last_score")], strict=True):
            if not all(t["raw"] in span for t in terms):
                continue
            spans = sorted(((span[t["raw"]], t["weight"]) for t in terms), key=lambda x: x[0].stop - x[0].start)
            one, weight = spans[0]
            d, score, match = doc[one], -weight * part[one], titled[one]
            for other, weight in spans[1:]:
                mine = doc[other]
                at = np.minimum(np.searchsorted(mine, d), len(mine) - 1)
                both = mine[at] == d
                d, at = d[both], at[both]
                score, match = score[both] - weight * part[other][at], match[both] & titled[other][at]
            page = np.searchsorted(number, d)
            if within is not None:
                mine = space[page] == within
                page, score, match = page[mine], score[mine], match[mine]
            if len(terms) > 1 or terms[0]["raw"] != needle:
                # a title can hold the query only if it holds all parts
                match = match.copy()
                for i in np.flatnonzero(match):
                    match[i] = needle in lower[page[i]]
            if last_score is not None:
                reach = score <= last_score + slack
                reach = match & reach if last_match else match | reach
                page, score, match = page[reach], score[reach], match[reach]
            left = k
            for kind in (True, False):
                mine = np.flatnonzero(match == kind)
                if left and len(mine):
                    chosen = mine[first(page[mine], score[mine], left)]
                    left -= len(chosen)
                    out += [(ask, int(number[page[i]]), space[page[i]], path[page[i]], kind, float(score[i])) for i in chosen]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_BEST)], schema=_BEST)

    return run


def search_batch(index: SearchIndex, queries: DataFrame, k: int = 12, block_bits: int = BLOCK_BITS, digits: int | None = None) -> Batch:
    """The hits of each of ``queries`` (query_id, query, space_id where wanted), as :meth:`SearchIndex.search` finds them one by one.

    hits: (query_id, space_id, path, title, title_match, score). A query_id is
    one query; null or empty queries, and those with a part without tokens, have
    no hits. ``k`` is 100 at most; reserved documents are dropped after it.
    With ``digits`` scores which are equal when rounded so are ties, which the
    path decides; a score is given unrounded.
    Nothing of the queries or of the hits is collected: postings meet parts,
    blocks and queries in joins.
    """
    k = max(0, min(k, search.MOST))
    m = index.manifest()
    n_docs, avg = m["n_docs"], m["n_tokens"] / max(1, m["n_docs"])
    q = materialize(_parsed(queries), "queries")
    said = ["needle", "space", "parts"]
    # what is asked again is answered once
    asks = materialize(q.select(*said).distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    wanted = asks.select("ask", "needle", "space", F.explode("parts").alias("part")).select("ask", "needle", "space", "part.raw", "part.terms")
    distinct = materialize(wanted.select("raw", "terms").distinct(), "parts")
    terms = distinct.select("raw", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("at", "term"))
    few = [r["term"] for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    parts = distinct.count()
    postings = _part_postings(index, few if len(few) <= FEW_TERMS else None, m, F.broadcast(terms) if parts <= FEW_PARTS else terms)
    lower = index.titles(m).select("doc", "space_id", "path", F.lower("title").alias("lower"))
    titled = F.coalesce(F.contains("lower", "raw"), F.lit(False)).alias("titled")
    named = postings.join(lower.select("doc", "lower"), "doc").select("raw", "doc", "n_tokens", "tf", titled)
    block = F.shiftright("doc", block_bits).alias("block")
    blocks = materialize(
        named.groupBy("raw", block).agg(
            F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("n_tokens").alias("least"), F.max("titled").alias("titled"),
            F.array_sort(F.collect_list(F.struct("doc", "n_tokens", "tf", "titled"))).alias("members"),
        ), "blocks",
    )
    df = blocks.groupBy("raw").agg(F.sum("n").alias("df"))
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = wanted.groupBy("ask", "needle", "space", "raw").agg(F.count("*").alias("times")).join(df.select("raw", idf.alias("idf")), "raw")
    n_parts = wanted.groupBy("ask").agg(F.countDistinct("raw").alias("n_parts"))
    weighed = materialize(weighed.join(n_parts, "ask").withColumn("weight", F.col("times") * F.col("idf")), "asked")
    asked = weighed.groupBy("ask", "needle", "space", "n_parts").agg(F.collect_list(F.struct("raw", "weight")).alias("terms")).filter(F.size("terms") == F.col("n_parts")).drop("n_parts")
    bound = F.sum(F.col("weight") * _saturated(F.col("max_tf"), F.col("least"), avg)).alias("bound")
    met = weighed.join(blocks.drop("members"), "raw").groupBy("ask", "block", "n_parts").agg(bound, F.min("titled").alias("titled"), F.min("n").alias("pages"), F.count("*").alias("met"))
    bounds = materialize(met.filter("met = n_parts").drop("met", "n_parts"), "bounds")
    first = Window.partitionBy("ask").orderBy(F.col("bound").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("pages").over(first), F.lit(0))
    seeds = materialize(bounds.withColumn("before", before).filter(F.col("before") < SEEDS * k).select("ask", "block"), "seeds")
    pages = lower.groupBy(block).agg(F.collect_list(F.struct("doc", "space_id", "path", "lower")).alias("pages"))
    whole = blocks.select("block", "raw", "members").unionByName(pages, allowMissingColumns=True)

    def scored(pairs: DataFrame) -> DataFrame:
        """The best pages of each of ``pairs`` (ask, block, last_match, last_score)."""
        to = pairs.join(asked, "ask").select("block", "ask", "needle", "space", "terms", "last_match", "last_score")
        return whole.groupBy("block").cogroup(to.groupBy("block")).applyInArrow(_best_of_block(k, digits, avg), "ask long, doc long, space_id string, path string, title_match boolean, score double")

    columns = ["ask", "doc", "space_id", "path", "title_match", "score"]
    unknown = seeds.withColumn("last_match", F.lit(None).cast("boolean")).withColumn("last_score", F.lit(None).cast("double"))
    early = materialize(_best(scored(unknown), k, digits).select(*columns, "rank"), "early")
    last = early.filter(F.col("rank") == k).select("ask", F.col("title_match").alias("last_match"), F.col("score").alias("last_score"))
    reach = F.col("bound") * (1 + 1e-9) + (0 if digits is None else 10.0**-digits) >= -F.col("last_score")
    open_ = F.col("last_score").isNull() | F.when(F.col("last_match"), F.col("titled") & reach).otherwise(F.col("titled") | reach)
    rest = materialize(bounds.join(seeds, ["ask", "block"], "left_anti").join(last, "ask", "left").filter(open_).select("ask", "block", "last_match", "last_score"), "rest")
    both = early.select(columns).unionByName(scored(rest).select(columns))
    best = materialize(_best(both, k, digits).filter(~paths.is_reserved(F.col("path"))).select(columns), "best")
    found = best.join(index.titles(m).select("doc", "title"), "doc")
    who = q.select("query_id", *said).distinct().join(asks.withColumnRenamed("space", "_space"), ["needle", "parts"]).filter(F.col("space").eqNullSafe(F.col("_space")))
    hits = who.select("query_id", "ask").join(found, "ask").select("query_id", "space_id", "path", "title", "title_match", "score")
    seen = lambda d, n: d.select(*[F.lit(int(c == n)).alias(c) for c in ("candidate_blocks", "scored_blocks")])
    report = seen(bounds, "candidate_blocks").unionByName(seen(seeds, "scored_blocks")).unionByName(seen(rest, "scored_blocks")).agg(F.sum("candidate_blocks").alias("candidate_blocks"), F.sum("scored_blocks").alias("scored_blocks"))
    return Batch(hits, report)
