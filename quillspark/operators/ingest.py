"""Source ingest as a set: deduplication by content, and names which do not collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import paths, text
from quillspark.operators.joins import join_by_key
from quillspark.sources import formats
from quillspark.storage import materialize

EXTRACTOR = "html-snapshot"
#: How much of the content hash is tried as a suffix, in turn.
SUFFIXES = (8, 16, 32, 64)


def _document(title: Column, body: Column, extra: Column) -> Column:
    return F.concat(F.lit("---\ntitle: "), text.quoted(title), F.lit("\ntype: Source\n"), extra, F.lit("---\n\n"), F.trim(body), F.lit("\n"))


def routed(entries: DataFrame) -> DataFrame:
    """Requests (arrival, space_id, source_type, content, filename, url) as documents to store.

    Adds name, title, body, content_hash and source_url. A ``url`` request has
    the page's HTML as content: it becomes a Markdown snapshot with its hash and
    address. Any other type is trimmed text without either, titled by the
    requested name, or ``source``. Null contents are empty.
    """
    pages = entries.filter("source_type = 'url'").select("*", F.col("arrival").alias("page_id"), F.col("content").alias("html"))
    shot = formats.snapshots(pages.select("page_id", "url", "html")).select(F.col("page_id").alias("arrival"), F.col("title").alias("page_title"), "markdown")
    web = pages.drop("page_id", "html").join(shot, "arrival").select(
        "arrival", "space_id", F.coalesce("filename", "page_title").alias("name"), F.col("page_title").alias("title"), F.col("markdown").alias("body"),
        F.sha2("markdown", 256).alias("content_hash"), F.col("url").alias("source_url"),
    )
    none = F.lit(None).cast("string")
    plain = entries.filter("source_type <> 'url' or source_type is null").select(
        "arrival", "space_id", F.coalesce("filename", F.lit("source")).alias("name"), F.trim(F.coalesce("filename", F.lit("source"))).alias("title"),
        F.trim(F.coalesce("content", F.lit(""))).alias("body"), none.alias("content_hash"), none.alias("source_url"),
    )
    return web.unionByName(plain)


def named(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """(arrival, space_id, path, reused): where each of ``routed`` documents is stored.

    ``existing`` (space_id, path, content_hash, source_url) are the stored
    sources. A document whose hash and address (null equals null) are those of
    the file at one of its names is that file again. Otherwise the first one by
    arrival takes the plain name if it is free; one with a hash then tries 8,
    16, 32 and all of its digits, text without a hash always gets eight digits
    of a digest of its arrival. Grouped by name and suffix, never in one window;
    the winners of frequent names are broadcast to their rows.
    """
    slug = text.slug_collapsed(F.regexp_replace("name", r"(?i)\.md$", ""))
    stem = F.when(slug == "", "source").otherwise(slug)
    left = materialize(documents.select("arrival", "space_id", stem.alias("stem"), "content_hash", "source_url"), "unnamed")
    old = existing.select("space_id", "path", F.col("content_hash").alias("old_hash"), F.col("source_url").alias("old_url"), F.lit(True).alias("taken"))
    used, done = old, None
    for size in (0, *SUFFIXES):
        digits = F.substring("content_hash", 1, size) if size else None
        name = F.concat(F.lit(paths.SOURCES), "stem", *([F.lit("-"), digits] if size else []), F.lit(".md"))
        tried = left.filter("content_hash is not null") if size else left
        tried = tried.withColumn("path", name)
        met = tried.join(used, ["space_id", "path"], "left")
        again = F.col("taken") & F.col("content_hash").isNotNull() & F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.col("source_url").eqNullSafe(F.col("old_url"))
        reused = met.filter(again)
        free = materialize(met.filter(F.col("taken").isNull()), "free")
        # the first by arrival takes the name; others with the same content are that file again
        winner = free.groupBy("space_id", "path").agg(F.min_by(F.struct("content_hash", "source_url"), "arrival").alias("w"), F.min("arrival").alias("first"), F.count("*").alias("n"))
        won = join_by_key(free, winner, ["space_id", "path"], free.count())
        mine = won.filter((F.col("arrival") == F.col("first")) | (F.col("content_hash").isNotNull() & F.col("content_hash").eqNullSafe(F.col("w.content_hash")) & F.col("source_url").eqNullSafe(F.col("w.source_url"))))
        placed = reused.select("arrival", "space_id", "path", F.lit(True).alias("reused")).unionByName(mine.select("arrival", "space_id", "path", (F.col("arrival") != F.col("first")).alias("reused")))
        placed = materialize(placed, "placed")
        done = placed if done is None else done.unionByName(placed)
        rest = left.join(placed.select("arrival"), "arrival", "left_anti")
        if not size:  # text without a hash is named at once
            seed = F.substring(F.sha2(F.concat_ws(":", "space_id", "stem", F.col("arrival").cast("string")), 256), 1, 8)
            texts = rest.filter("content_hash is null")
            done = done.unionByName(texts.select("arrival", "space_id", F.concat(F.lit(paths.SOURCES), "stem", F.lit("-"), seed, F.lit(".md")).alias("path"), F.lit(False).alias("reused")))
            rest = rest.filter("content_hash is not null")
        left = materialize(rest, "unnamed")
        taken = winner.select("space_id", "path", F.col("w.content_hash").alias("old_hash"), F.col("w.source_url").alias("old_url"), F.lit(True).alias("taken"))
        used = materialize(used.unionByName(taken), "used")
        if left.isEmpty():
            break
    # the same digits from another address: a digest of the arrival follows all of them
    tail = F.substring(F.sha2(F.concat_ws(":", "space_id", "stem", F.col("arrival").cast("string")), 256), 1, 8)
    last = F.concat(F.lit(paths.SOURCES), "stem", F.lit("-"), "content_hash", F.lit("-"), tail, F.lit(".md"))
    return done.unionByName(left.select("arrival", "space_id", last.alias("path"), F.lit(False).alias("reused")))


def stored(documents: DataFrame, names: DataFrame, captured_at: str) -> DataFrame:
    """(space_id, path, body): the files to write, one for each name that is not reused; null addresses have no capture."""
    q = text.quoted
    hash_ = lambda key: F.when(F.col("content_hash").isNotNull(), F.concat(F.lit(f"{key}: "), q(F.col("content_hash")), F.lit("\n"))).otherwise("")
    web = F.concat(F.lit("source_url: "), q(F.col("source_url")), F.lit("\ncaptured_at: "), q(F.lit(captured_at)), F.lit("\nextractor: "), q(F.lit(EXTRACTOR)), F.lit("\n"), hash_("content_hash"))
    extra = F.when(F.col("source_url").isNotNull(), web).otherwise(hash_("source_hash"))
    fresh = documents.join(names.filter("not reused").select("arrival", "path"), "arrival")
    return fresh.select("space_id", "path", _document(F.col("title"), F.col("body"), extra).alias("body"))


def outcome(total: int, failed: list[tuple[str, str]]) -> str:
    """The message of a batch: how many failed, each with its name and reason."""
    if not failed:
        return f"{total} of {total} added"
    return f"{len(failed)} of {total} failed: " + ", ".join(f"{n} ({e})" for n, e in failed)
