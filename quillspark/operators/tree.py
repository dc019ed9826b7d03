"""The page tree as a flat table, point reads, and overlays of two trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import metadata, paths, text
from quillspark.operators import ranks


def _is_html(path: Column) -> Column:
    return path.rlike(r"(?i)\.html?$")


def _visible(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda c: c.startswith("."))


def folders(files: DataFrame) -> DataFrame:
    """(space_id, path) of every directory above a visible file; rows with ``is_dir`` are directories themselves."""
    parts = F.split("path", "/")
    last = F.size(parts) - (F.when(F.col("is_dir"), 0).otherwise(1) if "is_dir" in files.columns else 1)
    above = F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.filter(_visible(F.col("path"))).filter(last > 0).select("space_id", F.explode(above).alias("path")).distinct()


def page_tree(files: DataFrame) -> DataFrame:
    """(space_id, path, parent, kind, slug, title, summary, depth) of all folders and pages of visible files (space_id, path, body).

    Folders have the title and summary of their index, HTML pages their file
    name; other pages their own metadata, else the file's stem. Symbolic links
    (``is_symlink``) and other files are left out; an index and a log are no
    pages. :func:`in_order` puts them in the order of the tree.
    """
    kept = files.filter(~F.col("is_symlink")) if "is_symlink" in files.columns else files
    kept = kept.filter(_visible(F.col("path")))
    docs = kept.filter(~F.col("is_dir")) if "is_dir" in kept.columns else kept
    p = F.col("path")
    described = docs.filter(paths.is_markdown(p) | (paths.base_name(p) == "index.md")).select("space_id", "path", metadata.display_metadata(F.col("body")).alias("m"))
    index = described.filter(paths.base_name(p) == "index.md").select("space_id", paths.parent(p).alias("path"), "m")
    dirs = folders(kept).join(index, ["space_id", "path"], "left")
    folder_rows = dirs.select(
        "space_id", "path", F.lit("folder").alias("kind"), F.col("path").alias("slug"),
        F.coalesce("m.title", paths.base_name(p)).alias("title"), F.coalesce("m.description", F.lit("")).alias("summary"),
    )
    stem = paths.slug(paths.base_name(p))
    concepts = described.filter(paths.kind(p) == "concept").select(
        "space_id", "path", F.lit("page").alias("kind"), paths.slug(p).alias("slug"), F.coalesce("m.title", stem).alias("title"), F.coalesce("m.description", F.lit("")).alias("summary")
    )
    html = docs.filter(_is_html(p)).select("space_id", "path", F.lit("page").alias("kind"), p.alias("slug"), paths.base_name(p).alias("title"), F.lit("").alias("summary"))
    every = folder_rows.unionByName(concepts).unionByName(html)
    return every.select("space_id", "path", paths.parent(p).alias("parent"), "kind", "slug", "title", "summary", F.size(F.split(p, "/")).alias("depth"))


def in_order(tree: DataFrame) -> DataFrame:
    """Adds the place in the order of siblings: by kind, then lower-case title; no task holds a whole folder."""
    return ranks.placed(tree, [F.col("space_id"), F.col("parent"), F.col("kind"), F.lower("title"), F.col("path")])


def deepest_first(dirs: DataFrame) -> DataFrame:
    """Adds the place of directories (space_id, path) when children come before their parents; the root has the empty path."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return ranks.placed(dirs.withColumn("depth", depth), [F.col("depth").desc(), F.col("space_id"), F.col("path")])


def first_page(tree: DataFrame) -> DataFrame:
    """(space_id, path): what opens first, the first page of the order that is no raw source."""
    order = F.struct("depth", "kind", F.lower("title").alias("t"), "path")
    return tree.filter("kind = 'page'").groupBy("space_id").agg(F.min(order).alias("m")).select("space_id", F.col("m.path").alias("path"))


def with_parents(entries: DataFrame) -> DataFrame:
    """Adds ``parent`` to (space_id, path, kind): the directory above if it is listed as a folder, else the root (empty)."""
    above = entries.filter("kind = 'folder'").select("space_id", F.col("path").alias("parent"))
    wanted = entries.withColumn("parent", paths.parent(F.col("path")))
    found = wanted.join(above.withColumn("listed", F.lit(True)), ["space_id", "parent"], "left")
    return found.withColumn("parent", F.when(F.col("listed"), F.col("parent")).otherwise("")).select(*entries.columns, "parent")


def overlay(main: DataFrame, draft: DataFrame) -> DataFrame:
    """(path, kind, origin): pages of both trees by path. Main wins, folders merge, and what lies below main's page goes.

    A draft's entry is left out if main has its path, or has a page where the
    draft has one of the directories above it.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    fresh = draft.select("path", "kind").join(main.select("path"), "path", "left_anti")
    inside = fresh.filter(F.size(parts) > 1).select("path", F.explode(above).alias("dir"))
    blocked = inside.join(main.filter("kind <> 'folder'").select(F.col("path").alias("dir")), "dir", "left_semi").select("path").distinct()
    kept = fresh.join(blocked, "path", "left_anti")
    return main.select("path", "kind", F.lit("main").alias("origin")).unionByName(kept.select("path", "kind", F.lit("draft").alias("origin")))


def source_listing(files: DataFrame) -> DataFrame:
    """(space_id, filename, title) of raw Markdown sources of any case; the title is read from the first 64 KiB."""
    p = F.col("path")
    raw = files.filter(p.startswith(paths.SOURCES) & paths.is_markdown(p))
    name = F.substr(p, F.lit(len(paths.SOURCES) + 1))
    # half a character at the end of the 64 KiB does no harm to a title
    head = F.make_valid_utf8(F.substr(F.encode("body", "UTF-8"), F.lit(1), F.lit(1 << 16)).cast("string"))
    return raw.select("space_id", name.alias("filename"), F.coalesce(metadata.display_metadata(head)["title"], name).alias("title"))


def _safe(path: str) -> str:
    if not path or path.startswith("/") or "\\" in path or any(c in ("", ".", "..") for c in path.split("/")):
        raise ValueError(f"not a path within the Space: {path!r}")
    return path


def _full(found: DataFrame) -> DataFrame:
    p = F.col("path")
    kind = F.when(paths.base_name(p) == "index.md", "index").when(paths.base_name(p) == "log.md", "log").when(p.startswith(paths.SOURCES) & p.endswith(".md"), "source").otherwise("page")
    title = F.when(_is_html(p), paths.base_name(p)).otherwise(F.coalesce(text.index_title(F.col("body")), paths.slug(paths.base_name(p))))
    return found.select("space_id", "path", paths.slug(p).alias("slug"), kind.alias("kind"), title.alias("title"), "body")


def page_by_slug(files: DataFrame, space_id: str, slug: str) -> DataFrame:
    """One page by its slug; an HTML page's slug is its path. An index or a log is no page."""
    path = slug if slug.lower().endswith((".html", ".htm")) else _safe(slug).removesuffix(".md") + ".md"
    if path.rsplit("/", 1)[-1] in ("index.md", "log.md"):
        raise ValueError("reserved documents are read by path")
    return _full(files.filter((F.col("space_id") == space_id) & (F.col("path") == _safe(path)))).withColumn("kind", F.lit("page"))


def page_by_path(files: DataFrame, space_id: str, path: str) -> DataFrame:
    """One document by its path, with its kind: index, log, source or page."""
    return _full(files.filter((F.col("space_id") == space_id) & (F.col("path") == _safe(path))))


def source_by_name(files: DataFrame, space_id: str, filename: str) -> DataFrame:
    """(filename, title, content) of one raw source."""
    found = files.filter((F.col("space_id") == space_id) & (F.col("path") == paths.SOURCES + _safe(filename)))
    title = F.coalesce(metadata.display_metadata(F.col("body"))["title"], F.lit(filename))
    return found.select(F.lit(filename).alias("filename"), title.alias("title"), F.col("body").alias("content"))
