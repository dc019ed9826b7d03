"""Changes to tables as new tables: upserts, guarded writes, renames and deletes. The caller swaps the result in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import metadata, paths
from quillspark.operators import bundle
from quillspark.storage import materialize


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those rows whose key it does not have; of several new rows of a key the least one."""
    rest = [c for c in table.columns if c not in keys]
    one = rows.select(*table.columns).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else rows.select(*keys).distinct()
    return table.unionByName(one.join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with rows replaced by key, or added; columns ``keep`` of a replaced row stay. One new row a key."""
    old = table.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_old"))
    fresh = rows.join(old, keys, "left")
    for c in keep:
        fresh = fresh.withColumn(c, F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)))
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def cascade_delete(comments: DataFrame, gone: DataFrame) -> DataFrame:
    """``comments`` (id, parent_id) without ``gone`` (id) and all that replies to them, at any depth."""
    layer = materialize(gone.select("id").distinct(), "gone")
    every = layer
    while True:
        below = comments.join(layer.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").join(every, "id", "left_anti")
        layer = materialize(below.distinct(), "gone")
        if layer.isEmpty():
            return comments.join(every, "id", "left_anti")
        every = materialize(every.unionByName(layer), "gone")


def set_resolved(comments: DataFrame, ids: DataFrame, resolved: bool) -> DataFrame:
    """Roots with these ids get the flag; an id which is no root is an error, and nothing changes."""
    missing = ids.select("id").join(comments.filter("parent_id is null").select("id"), "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("comment not found")
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return comments.join(hit, "id", "left").withColumn("resolved", F.when(F.col("_hit"), F.lit(resolved)).otherwise(F.col("resolved"))).select(*comments.columns)


def write_errors(files: DataFrame, writes: DataFrame) -> DataFrame:
    """Adds ``error`` to writes (path, content, expected, create_only): null, gone, changed or exists.

    A write with an expected content needs the file to have it; a null
    expectation overwrites. ``create_only`` needs the file not to be there.
    """
    now = files.select("path", F.sha2("body", 256).alias("_now"), F.lit(True).alias("_there"))
    joined = writes.join(now, "path", "left")
    error = (
        F.when(F.col("expected").isNotNull() & F.col("_there").isNull(), "gone")
        .when(F.col("expected").isNotNull() & (F.sha2("expected", 256) != F.col("_now")), "changed")
        .when(F.col("create_only") & F.col("_there"), "exists")
    )
    return joined.withColumn("error", error).select(*writes.columns, "error")


def write_pages(files: DataFrame, writes: DataFrame) -> DataFrame:
    """``files`` (path, body) after the writes that may be made, with their front matter completed. One write a path."""
    ok = write_errors(files, writes).filter("error is null")
    body = metadata.normalised_concept(F.coalesce("content", F.lit("")), paths.slug(paths.base_name(F.col("path"))), F.lit("Note"))
    return upsert(files.select("path", "body"), ok.select("path", body.alias("body")), ["path"])


def _below(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder + "/")


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """``files`` (path, ...) with a file or a folder under its new path.

    An error if nothing is there, if the new path is taken, or if a single file
    is or becomes an index, a log or no document.
    """
    p = F.col("path")
    if files.filter(_below(p, old)).isEmpty():
        raise ValueError("the item to rename no longer exists")
    if not files.filter(_below(p, new)).isEmpty():
        raise ValueError("an item with that name already exists")
    is_file = not files.filter(p == old).isEmpty()
    concept = lambda x: x.endswith(".md") and x.rsplit("/", 1)[-1] not in ("index.md", "log.md")
    if is_file and not (concept(old) and concept(new)):
        raise ValueError("index.md and log.md are reserved")
    return files.withColumn("path", F.when(_below(p, old), F.concat(F.lit(new), F.substr(p, F.lit(len(old) + 1)))).otherwise(p))


def delete(files: DataFrame, path: str) -> DataFrame:
    """``files`` without a file, or a folder and all below it; an error at the root or if nothing is there."""
    if not path.strip("/"):
        raise ValueError("the root stays")
    if files.filter(_below(F.col("path"), path)).isEmpty():
        raise ValueError("the item to delete no longer exists")
    return files.filter(~_below(F.col("path"), path))


def create_folder(files: DataFrame, name: str, parent: str = "") -> DataFrame:
    """``files`` (path, body) with the index of a new folder."""
    if not name or name.startswith(".") or "/" in name or "\\" in name:
        raise ValueError("not a folder name")
    folder = f"{parent}/{name}" if parent else name
    if not files.filter(_below(F.col("path"), folder)).isEmpty():
        raise ValueError("cannot create folder: it exists")
    row = files.sparkSession.createDataFrame([(f"{folder}/index.md",)], "path string").select("path", bundle.folder_index(F.lit(name)).alias("body"))
    return files.select("path", "body").unionByName(row)


def add_spaces(spaces: DataFrame, new: DataFrame) -> DataFrame:
    """The registry (id, name, slug, path) with new ones (name, slug, path); a path that is registered stays as it is.

    The id has the form of a UUID and is a digest of the path, so a repeated
    call gives the same. Of several new rows of a path the least slug counts.
    """
    h = F.sha2("path", 256)
    part = lambda a, n: F.substring(h, a, n)
    ident = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    return insert_or_ignore(spaces.select("path", "id", "name", "slug"), new.select("path", ident.alias("id"), "name", "slug"), ["path"]).select("id", "name", "slug", "path")
