"""The read-only tools of a knowledge base: context, search, page, backlinks and broken links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import links, paths, text
from quillspark.operators import graph, search
from quillspark.operators.index import SearchIndex


class Corpus:
    """Tools over a stored index, or over a table of pages (space_id, path, title, body) where there is none.

    Every answer is a DataFrame; nothing runs before it is read. With an index
    a search reads the postings of its terms, links come as they were stored,
    and bodies are read by :meth:`page` only.
    """

    def __init__(self, pages: DataFrame | None = None, index: SearchIndex | None = None):
        if pages is None and index is None:
            raise ValueError("pages or an index are needed")
        self.index = index
        self.pages = index.pages() if pages is None else pages
        self._edges: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = self.index.links().drop("source_title") if self.index else graph.edges(self.pages)
        return self._edges

    def _of(self, df: DataFrame, space_id: str | None) -> DataFrame:
        return df if space_id is None else df.filter(F.col("space_id") == space_id)

    def context(self, space_id: str | None = None) -> DataFrame:
        """Pages and reserved documents of each space."""
        reserved = F.count_if(paths.is_reserved(F.col("path"))).alias("n_reserved")
        held = self.index.live() if self.index else self.pages
        return self._of(held, space_id).groupBy("space_id").agg(F.count("*").alias("n_pages"), reserved)

    def search_pages(self, query: str, limit: int = 12, space_id: str | None = None) -> DataFrame:
        if not 1 <= limit <= search.MOST:
            raise ValueError(f"limit must be from 1 to {search.MOST}")
        if self.index:
            return self.index.search(query, limit, space_id)
        return search.search(self.pages, query, limit, space_id)

    def page(self, path: str, space_id: str | None = None) -> DataFrame:
        """One page with its kind and slug, without its front matter."""
        found = self._of(self.pages.filter(F.col("path") == path), space_id)
        return found.select("space_id", "path", "title", paths.kind(F.col("path")).alias("kind"), paths.slug(F.col("path")).alias("slug"), text.content(F.col("body")).alias("content"))

    def backlinks(self, target: str, space_id: str | None = None) -> DataFrame:
        """Pages which link to a target; the argument is resolved like a wikilink, so it always names a page."""
        wanted = F.col("target") == links.resolve_wikilink(F.lit(target))
        if self.index:
            found = self._of(self.index.backlinks(), space_id).filter(wanted)
        else:
            found = graph.backlinks(self._of(self.pages, space_id), self._of(self.edges, space_id).filter(wanted))
        return found.orderBy(F.lower("source_title"), "source_path")

    def broken_links(self, space_id: str | None = None) -> DataFrame:
        if self.index:
            return self._of(self.index.broken_links(), space_id).orderBy("source_path", "target")
        return graph.broken_links(self._of(self.pages, space_id), self._of(self.edges, space_id)).orderBy("source_path", "target")
