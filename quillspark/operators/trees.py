"""Directory hashes of a tree of files, and differences which descend only into directories that differ."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.versions import digest
from quillspark.storage import materialize

#: Entries of a directory which are hashed as one list, about.
LISTED = 1024
_ENTRY = "depth int, parent string, path string, kind string, hash string"


def _hashed(entries: DataFrame) -> DataFrame:
    """(path, hash) of the directories above entries of one depth.

    A directory's hash is that of its entries' sorted lines, in as many lists
    as its size asks for: by a hash of the path, so that no list grows with the
    directory. Equal directories have equal hashes, others do not, but for
    collisions of SHA-256.
    """
    lists = entries.groupBy("parent").agg(F.ceil(F.count("*") / LISTED).alias("lists"))
    line = F.concat_ws(" ", "kind", F.sha2("path", 256), "hash")
    part = F.pmod(F.xxhash64("path"), F.col("lists")).alias("part")
    parts = entries.join(lists, "parent").groupBy("parent", "lists", part).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("part").cast("string"), 20, "0"), "h"))), "\n")
    return parts.groupBy("parent").agg(F.sha2(F.concat_ws("\n", F.first("lists").cast("string"), whole), 256).alias("hash")).withColumnRenamed("parent", "path")


def merkle(files: DataFrame) -> DataFrame:
    """(depth, parent, path, kind, hash) of every file and directory above ``files`` (path, body), the root '' included.

    Made bottom up, a round for each depth. A null body is a value of its own;
    of repeated paths one body counts (the greatest); an empty tree has a root
    with a fixed hash. Directories exist where files are.
    """
    spark = files.sparkSession
    parent = lambda: F.regexp_replace("path", "/?[^/]*$", "")
    leaf = files.groupBy("path").agg(F.max("body").alias("body")).select(
        F.size(F.split("path", "/")).alias("depth"), parent().alias("parent"), "path", F.lit("file").alias("kind"), F.coalesce(digest(F.col("body")), F.lit("-")).alias("hash")
    )
    leaves = materialize(leaf, "tree")
    out, below = leaves, None
    for depth in range(leaves.agg(F.max("depth")).first()[0] or 0, 0, -1):
        entries = leaves.filter(F.col("depth") == depth)
        entries = entries if below is None else entries.unionByName(below)
        directories = _hashed(entries).select(F.lit(depth - 1).alias("depth"), parent().alias("parent"), "path", F.lit("directory").alias("kind"), "hash")
        below = materialize(directories, "tree")
        out = out.unionByName(below)
    return out if below is not None else spark.createDataFrame([(0, "", "", "directory", "-")], _ENTRY)


class TreeDiff(NamedTuple):
    changes: DataFrame
    #: Entries which were looked at, and all there are in both trees.
    compared: int
    entries: int


def tree_diff(old: DataFrame, new: DataFrame) -> TreeDiff:
    """(path, status) of added, deleted and modified files between two trees of :func:`merkle`.

    From the root down, only the entries of directories whose hashes differ are
    joined; the driver sees counts. A file in one tree that is a directory in
    the other is deleted, and what is below the directory added.
    """
    spark = old.sparkSession
    frontier = spark.createDataFrame([("",)], "path string")
    found = spark.createDataFrame([], "path string, status string")
    roots = [d.filter("depth = 0").select("hash").first() for d in (old, new)]
    compared = 0
    if roots[0] == roots[1]:
        frontier = frontier.limit(0)
    entries = old.count() + new.count()
    depth = 1
    while not frontier.isEmpty():
        at = frontier.withColumnRenamed("path", "parent")
        one, two = (d.filter(F.col("depth") == depth).join(at, "parent", "left_semi").select("path", "kind", F.col("hash").alias(n)) for d, n in ((old, "old"), (new, "new")))
        met = materialize(one.join(two, ["path", "kind"], "full"), "met")
        compared += met.count()
        odd = met.filter(~F.col("old").eqNullSafe(F.col("new")))
        status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
        found = found.unionByName(odd.filter("kind = 'file'").select("path", status.alias("status")))
        frontier = odd.filter("kind = 'directory'").select("path")
        depth += 1
    return TreeDiff(found, compared, entries)
