"""The link graph: edges, backlinks and broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import commonmark, links, paths, text


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (space_id, source_path, target) of all wikilinks and Markdown links outside of code.

    Pages without a bracket never reach Python.
    """
    found = pages.filter(F.col("body").contains("[")).select("space_id", "path", commonmark.link_targets(F.col("body")).alias("x"))
    wiki = F.transform("x.wiki", links.resolve_wikilink)
    plain = F.transform("x.plain", lambda t: links.resolve_markdown(F.col("path"), t))
    targets = F.array_distinct(F.filter(F.concat(wiki, plain), lambda t: t.isNotNull() & (t != "")))
    return found.select("space_id", F.col("path").alias("source_path"), F.explode(targets).alias("target")).dropDuplicates()


def named_links(links_: DataFrame) -> DataFrame:
    """(space_id, target, source_path, source_title) of links which carry their source's title; reserved sources are left out."""
    return links_.filter(~paths.is_reserved(F.col("source_path"))).select("space_id", "target", "source_path", "source_title")


def backlinks(pages: DataFrame, links_: DataFrame) -> DataFrame:
    """(space_id, target, source_path, source_title) for all targets at once; reserved sources are left out."""
    named = pages.select("space_id", F.col("path").alias("source_path"), text.index_title(F.col("body")).alias("source_title"))
    return named_links(links_.select("space_id", "source_path", "target").join(named, ["space_id", "source_path"]))


def diagnostic(source: Column, target: Column) -> Column:
    """Whether a broken link is reported: the source is visible and not reserved, the target visible or below the raw sources."""
    parts = F.split(target, "/")
    hidden = lambda p: F.exists(p, lambda c: c.startswith("."))
    below = target.startswith(paths.SOURCES) & ~hidden(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))))
    return ~hidden(F.split(source, "/")) & ~paths.is_reserved(source) & F.when(parts[0] == paths.HIDDEN_ROOT, below).otherwise(~hidden(parts))


def live_targets(pages: DataFrame) -> DataFrame:
    """Every file and every directory above one, by space."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return pages.select("space_id", F.explode(prefixes).alias("target")).distinct()


def without_target(links_: DataFrame, targets: DataFrame) -> DataFrame:
    """(space_id, source_path, source_title, target) of named links whose target is none of ``targets`` (space_id, path) nor a directory."""
    found = named_links(links_).filter(diagnostic(F.col("source_path"), F.col("target")))
    return found.join(live_targets(targets), ["space_id", "target"], "left_anti").select("space_id", "source_path", "source_title", "target")


def broken_links(pages: DataFrame, links_: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(space_id, source_path, source_title, target) whose target is neither a file nor a directory.

    ``targets`` (space_id, path): all files, where there are others than pages.
    """
    return without_target(backlinks(pages, links_), pages if targets is None else targets)


def grouped_by_source(broken: DataFrame) -> DataFrame:
    """Each source with its broken targets in order."""
    return broken.groupBy("space_id", "source_path").agg(
        F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"), F.count("*").alias("n")
    )
