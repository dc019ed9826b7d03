"""Page comments: insertion with its checks, listings, threads and members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import display

MOST = 10_000
SNAPSHOT_BYTES = 512 << 10


def checked(new: DataFrame, comments: DataFrame) -> DataFrame:
    """Adds ``error`` to new comments: null, or what the first failing check says.

    ``new`` and ``comments`` are (id, space_id, page_slug, user_id, user_name,
    body, source, start_line, end_line, parent_id, created_at); ``source`` is
    the page as the commenter saw it. A reply has a parent on the same page,
    among the stored comments, and no anchor; a root has a source and lines
    within it. Null ids of parents mean roots.
    """
    parents = comments.select(F.col("id").alias("parent_id"), "space_id", "page_slug", F.lit(True).alias("_found")).distinct()
    joined = new.join(parents, ["parent_id", "space_id", "page_slug"], "left")
    slug_ok = display.page_slug_ok(F.col("page_slug"))
    length = F.length(F.trim("body"))
    reply, anchored = F.col("parent_id").isNotNull(), F.col("source").isNotNull() | F.col("start_line").isNotNull() | F.col("end_line").isNotNull()
    lines = F.size(F.split("source", "\n")) - F.col("source").endswith("\n").cast("int")
    within = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.greatest(lines, F.lit(1)))
    error = (
        F.when(~F.coalesce(slug_ok, F.lit(False)), "page slug is not valid")
        .when(~F.coalesce((length >= 1) & (length <= MOST), F.lit(False)), f"body must have 1 to {MOST} characters")
        .when(reply & anchored, "replies have no anchor")
        .when(reply & F.col("_found").isNull(), "the parent is not on this page")
        .when(~reply & F.col("source").isNull(), "a source is required")
        .when(~reply & (F.octet_length("source") > SNAPSHOT_BYTES), "the source is too large")
        .when(~reply & ~F.coalesce(within, F.lit(False)), "lines are not within the source")
    )
    return joined.withColumn("error", error).drop("_found").select(*new.columns, "error")


def inserted(new: DataFrame, comments: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The comments and snapshots with the new rows that pass :func:`checked`.

    A snapshot (space_id, page_slug, content_hash, source) is stored once; a
    blank user name becomes ``You``. Rows which fail are left out.
    """
    good = checked(new, comments).filter("error is null").drop("error").withColumn("content_hash", F.when(F.col("parent_id").isNull(), F.sha2("source", 256)))
    name = F.when(F.trim(F.coalesce("user_name", F.lit(""))) == "", "You").otherwise(F.trim("user_name"))
    rows = good.withColumn("user_name", name).withColumn("body", F.trim("body")).withColumn("resolved", F.lit(False))
    key = ["space_id", "page_slug", "content_hash"]
    seen = good.filter("content_hash is not null").groupBy(*key).agg(F.min("source").alias("source"))
    return comments.unionByName(rows.select(*comments.columns)), snapshots.select(*key, "source").unionByName(seen.join(snapshots, key, "left_anti").select(*key, "source"))


def listing(comments: DataFrame, spaces: DataFrame, page_slug: str, space_id: str | None = None) -> DataFrame:
    """The comments of a page with their Space's slug, oldest first."""
    found = comments.filter(F.col("page_slug") == page_slug)
    found = found if space_id is None else found.filter(F.col("space_id") == space_id)
    return found.join(F.broadcast(spaces.select(F.col("id").alias("space_id"), F.col("slug").alias("workspace_slug"))), "space_id").orderBy("created_at", "id")


def page_snapshots(snapshots: DataFrame, page_slug: str) -> DataFrame:
    return snapshots.filter(F.col("page_slug") == page_slug)


def threads(comments: DataFrame, anchors: DataFrame) -> DataFrame:
    """(root_id, page_slug, part, n_replies, last_reply): part is resolved, or the anchor's state.

    ``anchors`` (id, state) comes from :func:`quillspark.operators.versions.remap_anchors`.
    A root without an anchor is outdated. Replies are counted before the join.
    """
    replies = comments.filter("parent_id is not null").groupBy(F.col("parent_id").alias("root_id")).agg(F.count("*").alias("n_replies"), F.max("created_at").alias("last_reply"))
    roots = comments.filter("parent_id is null").select(F.col("id").alias("root_id"), "page_slug", "resolved")
    joined = roots.join(anchors.select(F.col("id").alias("root_id"), "state"), "root_id", "left").join(replies, "root_id", "left")
    part = F.when(F.col("resolved"), "resolved").otherwise(F.coalesce("state", F.lit("outdated")))
    return joined.select("root_id", "page_slug", part.alias("part"), F.coalesce("n_replies", F.lit(0)).alias("n_replies"), "last_reply")


def open_counts(threads_: DataFrame) -> DataFrame:
    """(page_slug, anchored, outdated, resolved, open_count) of each page."""
    n = lambda p: F.count_if(F.col("part") == p)
    return threads_.groupBy("page_slug").agg(n("anchored").alias("anchored"), n("outdated").alias("outdated"), n("resolved").alias("resolved"), F.count_if(F.col("part") != "resolved").alias("open_count"))


def members(comments: DataFrame) -> DataFrame:
    """(user_id, user_name): the greatest name of each commenter, by lower-case name, then id."""
    return comments.groupBy("user_id").agg(F.max("user_name").alias("user_name")).orderBy(F.lower("user_name"), "user_id")
