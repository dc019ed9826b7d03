"""Ranked full-text search over positional postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import paths, text

TITLE_WEIGHT, BODY_WEIGHT, K1, B = 8.0, 1.0, 1.2, 0.75
MOST = 100


def postings(pages: DataFrame, keep: tuple[str, ...] = ("space_id", "path")) -> DataFrame:
    """(term, *keep, field, positions, tf) of every page, made within its row: nothing is shuffled.

    A term of a field is one row, which carries the columns ``keep`` of its
    page. Null titles and bodies have none.
    """
    kept = pages.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                terms, rows, positions, fields, counts = [], [], [], [], []
                for field, column in (("title", b.column(len(keep))), ("body", b.column(len(keep) + 1))):
                    for i, value in enumerate(column):
                        found: dict[str, list[int]] = {}
                        for k, t in enumerate(text.tokens_of(value.as_py())):
                            found.setdefault(t, []).append(k)
                        terms += found
                        rows += [i] * len(found)
                        positions += found.values()
                        counts += map(len, found.values())
                    fields += [field] * (len(terms) - len(fields))
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), *[b.column(k).take(take) for k in range(len(keep))], pa.array(fields, pa.string()), pa.array(positions, pa.list_(pa.int32())), pa.array(counts, pa.int64())],
                    ["term", *keep, "field", "positions", "tf"],
                )

    schema = f"term string, {', '.join(f'`{c}` {t}' for c, t in kept.dtypes)}, field string, positions array<int>, tf long"
    return pages.select(*keep, F.col("title").alias("_title"), F.col("body").alias("_body")).mapInArrow(run, schema)


def term_counts(pages: DataFrame) -> DataFrame:
    """(term, df, tf) of all bodies. A task counts each batch itself, so what is shuffled is distinct terms, not tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df: Counter[str] = Counter()
            tf: Counter[str] = Counter()
            for value in b.column(0):
                found = text.tokens_of(value.as_py())
                tf.update(found)
                df.update(set(found))
            yield pa.RecordBatch.from_arrays([pa.array(list(tf), pa.string()), pa.array([df[t] for t in tf], pa.int64()), pa.array(list(tf.values()), pa.int64())], ["term", "df", "tf"])

    return pages.select("body").mapInArrow(run, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def query_phrases(query: str) -> list[list[str]]:
    """White space parts the query; a part's tokens are a phrase. A part without tokens matches nothing."""
    return [text.tokens_of(word.strip('"')) for word in query.split()]


def search(pages: DataFrame, query: str, limit: int = 12, space_id: str | None = None) -> DataFrame:
    """(space_id, path, title, title_match, score): all parts must occur; title matches first, then BM25, then the path.

    Statistics are those of all spaces, as the space is filtered afterwards.
    Reserved documents are dropped after the limit. An empty query, or a part
    without tokens, gives no rows. Reads all pages; for many queries keep a
    :class:`quillspark.operators.index.SearchIndex`.
    """
    terms = sorted({t for p in query_phrases(query) for t in p})
    n = F.size(text.tokens(F.coalesce("title", F.lit("")))) + F.size(text.tokens(F.coalesce("body", F.lit(""))))
    size = pages.select("space_id", "path", n.cast("long").alias("n_tokens"))
    stats = size.agg(F.count("*"), F.sum("n_tokens")).first()
    found = postings(pages).filter(F.col("term").isin(*terms)).join(size, ["space_id", "path"])
    return ranked(found, pages.select("space_id", "path", "title"), ["space_id", "path"], query, stats[0], (stats[1] or 0) / max(1, stats[0]), limit, space_id)


def _moved(positions: Column, by: int) -> Column:
    """Where a phrase would begin whose word number ``by`` stands at these positions."""
    return F.transform(positions, lambda p: p - by)


def ranked(found: DataFrame, titles: DataFrame, key: list[str], query: str, n_docs: int, avg_tokens: float, limit: int, space_id: str | None) -> DataFrame:
    """Score and order pages from the postings of the query's terms, which carry ``key`` and n_tokens of their page; ``titles`` names hits by the key."""
    parts = query_phrases(query)
    empty = not parts or any(not p for p in parts) or limit <= 0
    hits = []
    # phrases are put together within a page: one shuffle for all terms
    held = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
    per_field = found.repartition(*key).groupBy(*key, "n_tokens", "field").agg(held.alias("at"))
    for phrase in parts or [["-"]]:
        places = [_moved(F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<int>")), i) for i, t in enumerate(phrase or ["-"])]
        hits.append(F.size(reduce(F.array_intersect, places[1:], places[0])))
    weight = F.when(F.col("field") == "title", TITLE_WEIGHT).otherwise(BODY_WEIGHT)
    tf = F.array(*[h * weight for h in hits]).alias("tf")
    per_page = per_field.select(*key, "n_tokens", tf).groupBy(*key, "n_tokens")
    tfs = per_page.agg(*[F.sum(F.get("tf", F.lit(k))).alias(f"t{k}") for k in range(len(hits))])
    df = tfs.agg(*[F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(hits))])
    norm = K1 * (1 - B + B * F.col("n_tokens") / F.lit(avg_tokens or 1.0))
    score = F.lit(0.0)
    for k in range(len(hits)):
        d, t = F.col(f"d{k}"), F.col(f"t{k}")
        score = score - F.greatest(F.log((n_docs - d + 0.5) / (d + 0.5)), F.lit(1e-6)) * t * (K1 + 1) / (t + norm)
    scored = tfs.filter(reduce(lambda x, y: x & y, [F.col(f"t{k}") > 0 for k in range(len(hits))])).join(F.broadcast(df)).withColumn("score", score)  # one row
    scored = scored.join(titles, key)
    if space_id is not None:
        scored = scored.filter(F.col("space_id") == space_id)
    # wildcards of the query count as such; the escape character is one that does not occur
    pattern = "%" + query.strip().lower().replace("\1", "") + "%"
    match = F.coalesce(F.like(F.lower("title"), F.lit(pattern), F.lit("\1")), F.lit(False))
    top = scored.withColumn("title_match", match).orderBy(F.col("title_match").desc(), "score", "path", "space_id").limit(0 if empty else min(limit, MOST))
    return top.filter(~paths.is_reserved(F.col("path"))).select("space_id", "path", "title", "title_match", "score")


def top_per_query(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of every query_id of a batch."""
    w = Window.partitionBy("query_id").orderBy(F.col("title_match").desc(), "score", "path")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def snippet(body: Column, terms: list[str], n: int = 24) -> Column:
    """``n`` tokens around the first occurrences of folded ``terms``, with an ellipsis where text is left out.

    The text's beginning if the occurrences fit into it, or there is none; else
    they are in the middle, as far as the text's end allows. All occurrences
    within ``n`` tokens of the first count. Line breaks become blanks. That a
    window begins with a sentence, where one is near, is left out.
    """
    units = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0))
    token = lambda unit: text.folded(F.regexp_extract(unit, r"^[\p{L}\p{N}]+", 0))
    # a value which lambdas or several places use is bound to a name of its own, or it would be worked out anew for each
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), F.lit(1))
    marked = lambda us: F.filter(F.transform(us, lambda u, i: F.when(token(u).isin(*terms), i)), lambda i: i.isNotNull())

    def span(hits: Column, size: Column) -> Column:
        first = F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(0))
        last = lambda f: F.coalesce(F.array_max(F.filter(hits, lambda i: i < f + n)), F.lit(0))
        middle = lambda f, z: F.floor((f + z) / 2).cast("int") - (n // 2 - 1)
        start = lambda f, z: F.when(z < n, 0).otherwise(F.greatest(F.lit(0), F.least(size - n, middle(f, z))))
        return let(first, lambda f: let(last(f), lambda z: start(f, z)))

    def cut_at(us: Column, start: Column) -> Column:
        shown = F.array_join(F.slice(us, start + 1, F.lit(n)), "")
        ended = F.when(start + n < F.size(us), F.concat(F.regexp_replace(shown, r"[^\p{L}\p{N}]+$", ""), F.lit(" … "))).otherwise(shown)
        return F.concat(F.when(start > 0, " … ").otherwise(F.regexp_extract(body, r"^[^\p{L}\p{N}]+", 0)), ended)

    begun = let(units, lambda us: let(let(marked(us), lambda hits: span(hits, F.size(us))), lambda start: cut_at(us, start)))
    return F.translate(begun, "\n", " ")
