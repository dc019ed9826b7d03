"""A directory of files as a table, hidden names handled by rule and not by the file index."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import paths, text
from quillspark.storage import materialize

_LISTED = "path string, is_dir boolean, is_symlink boolean, modified_ns long"
_SCHEMA = "space_id string, path string, content binary, is_dir boolean, is_symlink boolean, modified_ns long"


def listing(spark: SparkSession, root: str, prune: str | None = None) -> DataFrame:
    """(path, is_dir, is_symlink, modified_ns) of every file and directory below ``root``, without the root.

    Breadth first: the directories of one depth are dealt to tasks, which list
    them, and what they hold is written to the shared folder; the driver sees a
    count for each depth. Symbolic links are listed and not followed. A
    directory whose path matches ``prune`` is listed and not entered; one that
    goes away meanwhile, or may not be read, has no entries. ``root`` is on
    storage which all machines share.
    """
    cores = spark.sparkContext.defaultParallelism

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top in batch["path"]:
                rows = []
                try:
                    with os.scandir(os.path.join(root, top) if top else root) as found:
                        for e in found:
                            with contextlib.suppress(FileNotFoundError):
                                rows.append((f"{top}/{e.name}" if top else e.name, e.is_dir(follow_symlinks=False), e.is_symlink(), e.stat(follow_symlinks=False).st_mtime_ns))
                except (FileNotFoundError, NotADirectoryError, PermissionError):
                    continue
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=["path", "is_dir", "is_symlink", "modified_ns"])

    open_ = spark.createDataFrame([("",)], "path string")
    out = None
    while True:
        level = materialize(open_.mapInPandas(entries, _LISTED), "listing")
        out = level if out is None else out.unionByName(level)
        below = level.filter("is_dir")
        below = below if prune is None else below.filter(~F.col("path").rlike(prune))
        n = below.count()
        if not n:
            return out
        open_ = below.select("path").repartition(min(n, 4 * cores))


def walk(spark: SparkSession, root: str, space_id: str) -> DataFrame:
    """Every file and directory below ``root`` with its content; symbolic links are listed and not followed.

    File readers of Spark skip names which begin with ``_`` or ``.``, so tasks
    list directories (:func:`listing`) and read files themselves.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 64):
                p = whole.iloc[at : at + 64]
                content = []
                for path, is_dir, link in zip(p["path"], p["is_dir"], p["is_symlink"], strict=True):
                    if is_dir or link:
                        content.append(None)
                    else:
                        with open(os.path.join(root, path), "rb") as f:
                            content.append(f.read())
                yield p.assign(content=content, space_id=space_id)[["space_id", "path", "content", "is_dir", "is_symlink", "modified_ns"]]

    return listing(spark, root).repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, _SCHEMA)


def space_name(folder: Column) -> Column:
    """The name of a Space from its folder's: fixed for personal and general ones, else dashes and underscores are blanks."""
    return F.when(folder.startswith("personal-"), "My Space").when(folder.startswith("general-"), "General").otherwise(F.translate(folder, "-_", "  "))


def spaces(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """(slug, name, local_path) of the folders of ``root`` which hold ``repo/.git``, those of ``known`` (local_path) left out.

    Only the folders themselves and their ``repo`` are listed.
    """
    found = listing(spark, root, "^[^/]+/(?!repo$)").filter(F.col("path").rlike(r"^[^/]+/repo/\.git$"))
    slug = F.split("path", "/")[0]
    out = found.select(slug.alias("slug"), space_name(slug).alias("name"), F.concat(F.lit(root.rstrip("/") + "/"), slug, F.lit("/repo")).alias("local_path"))
    return out if known is None else out.join(known.select("local_path"), "local_path", "left_anti").select("slug", "name", "local_path")


def pages(files: DataFrame) -> DataFrame:
    """Visible Markdown files with valid UTF-8: (space_id, path, title, body, modified_ns)."""
    p = F.col("path")
    kept = files.filter(~F.col("is_dir") & ~F.col("is_symlink") & ~paths.is_hidden(p) & paths.is_markdown(p))
    body = kept.withColumn("body", F.try_validate_utf8(F.col("content").cast("string"))).filter("body is not null")
    return body.select("space_id", "path", F.coalesce(text.index_title(F.col("body")), paths.slug(p)).alias("title"), "body", "modified_ns")
