"""Snapshots of files: differences, three-way merge, reconciliation, and line diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import linediff
from quillspark.storage import materialize


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def tree_hash(files: DataFrame, by: str) -> DataFrame:
    """(by, tree): a hash of all files (path, body) of a tree, the same in any order.

    The parts of each file's digest are added up, so tasks add up their own
    rows first and no tree is one list. Two trees with the same files, repeated
    rows included, have the same hash. A null body counts as a value of its own.
    """
    entry = F.sha2(F.concat("path", F.lit(":"), F.coalesce(digest(F.col("body")), F.lit("-"))), 256)
    hashed = files.select(by, entry.alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return hashed.groupBy(by).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[part(k) for k in range(4)]), 256).alias("tree"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of added, deleted and modified files; only digests are shuffled."""
    a = old.select("path", digest(F.col("body")).alias("old_sha"))
    b = new.select("path", digest(F.col("body")).alias("new_sha"))
    status = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "modified")
    return a.join(b, "path", "full").withColumn("status", status).filter("status is not null").select("path", "status", "old_sha", "new_sha")


def merge_states(base: DataFrame, draft: DataFrame, agent: DataFrame) -> DataFrame:
    """(path, state): unchanged, same, take_agent, keep_draft or conflict; a missing file counts as a version."""
    one, two, three = (d.select("path", digest(F.col("body")).alias(n)) for d, n in ((base, "b"), (draft, "d"), (agent, "a")))
    b, d, a = F.col("b"), F.col("d"), F.col("a")
    state = (
        F.when(d.eqNullSafe(b) & a.eqNullSafe(b), "unchanged")
        .when(d.eqNullSafe(a), "same")
        .when(d.eqNullSafe(b), "take_agent")
        .when(a.eqNullSafe(b), "keep_draft")
        .otherwise("conflict")
    )
    return one.join(two, "path", "full").join(three, "path", "full").select("path", state.alias("state"))


def reconcile(index: DataFrame, seen: DataFrame) -> DataFrame:
    """(space_id, path, action): upsert where the time differs or is new, delete where the file has gone."""
    a = index.select("space_id", "path", F.col("modified_ns").alias("indexed_ns"))
    b = seen.select("space_id", "path", F.col("modified_ns").alias("seen_ns"))
    action = F.when(F.col("seen_ns").isNull(), "delete").when(~F.col("seen_ns").eqNullSafe(F.col("indexed_ns")), "upsert")
    return a.join(b, ["space_id", "path"], "full").withColumn("action", action).filter("action is not null").select("space_id", "path", "action")


def file_diffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, lines, additions, deletions) of changed files: kept, deleted and added lines with their numbers on either side."""
    changed = changes(old, new).select("path", "status")
    both = changed.join(old.select("path", F.col("body").alias("old")), "path", "left").join(new.select("path", F.col("body").alias("new")), "path", "left")
    pairs = materialize(both.select(F.col("path").alias("key"), "status", linediff.lines(F.col("old")).alias("x"), linediff.lines(F.col("new")).alias("y")), "pairs")
    row = F.struct("place", F.struct("kind", "old_line", "new_line", "text").alias("line"))
    listed = linediff.diff_lines(pairs.select("key", "x", "y")).groupBy("key").agg(
        F.array_sort(F.collect_list(row))["line"].alias("lines"), F.count_if(F.col("kind") == "add").alias("additions"), F.count_if(F.col("kind") == "del").alias("deletions")
    )
    none = F.array().cast("array<struct<kind:string,old_line:int,new_line:int,text:string>>")
    out = pairs.select("key", "status").join(listed, "key", "left")
    return out.select(F.col("key").alias("path"), "status", F.coalesce("lines", none).alias("lines"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


def remap_anchors(comments: DataFrame, snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page_slug, state, start_line, end_line): where the commented lines are in the current page.

    ``comments`` (id, page_slug, content_hash, start_line, end_line),
    ``snapshots`` (page_slug, content_hash, source), ``pages`` (page_slug,
    body). Every distinct snapshot is compared once, for all its comments, and
    only if it differs from the page. A comment is ``outdated``, without lines,
    if one of its lines, its snapshot or its page is gone, and if its lines are
    null or not within the snapshot.
    """
    distinct = snapshots.select("page_slug", "content_hash", "source").dropDuplicates(["page_slug", "content_hash"])
    both = materialize(distinct.join(pages.select("page_slug", "body"), "page_slug").filter("source is not null and body is not null"), "snapshots")
    same = both.filter("source = body").select("page_slug", "content_hash", F.sequence(F.lit(1), F.size(F.split("source", "\n"))).alias("lines"))
    pairs = both.filter("source <> body").select(F.struct("page_slug", "content_hash").alias("key"), F.split("source", "\n").alias("x"), F.split("body", "\n").alias("y"))
    kept = linediff.matches(pairs).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("a") + 1, F.col("b") + 1))).alias("to"))
    found = pairs.join(kept, "key", "left").select("key.*", F.transform(F.sequence(F.lit(1), F.size("x")), lambda n: F.coalesce(F.try_element_at("to", n), F.lit(0))).alias("lines"))
    joined = comments.select("id", "page_slug", "content_hash", "start_line", "end_line").join(same.unionByName(found), ["page_slug", "content_hash"], "left")
    first, last = F.col("start_line"), F.col("end_line")
    within = (first >= 1) & (first <= last) & (last <= F.size("lines"))
    kept_all = F.when(within, F.forall(F.slice("lines", first, last - first + 1), lambda n: n > 0)).otherwise(False)
    at = lambda line: F.when(kept_all, F.try_element_at(F.col("lines"), line.cast("int")))
    return joined.select("id", "page_slug", F.when(kept_all, "anchored").otherwise("outdated").alias("state"), at(first).alias("start_line"), at(last).alias("end_line"))
