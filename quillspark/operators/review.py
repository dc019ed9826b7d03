"""Reviews: unified patches as rows, comments on their lines, and the state of a cloud link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def clean_path(path: Column) -> Column:
    """Without the prefix of either side; empty for null and ``/dev/null``."""
    return F.when(path.isNull() | (path == "/dev/null"), "").otherwise(F.regexp_replace(path, "^[ab]/", ""))


def patch_lines(patches: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, hunk, header, place, kind, old_line, new_line, text): the lines of a file's unified patch.

    Lines before the first hunk, after a hunk's counts are used up, and
    ``\\ No newline`` marks are none. A count that is left out is one. Null and
    empty patches have no lines. Windows are within one patch.
    """
    lines = patches.select(key, F.posexplode(F.split("patch", "\n")).alias("pos", "raw"))
    whole = Window.partitionBy(key).orderBy("pos")
    is_header = F.col("raw").rlike(_HEADER)
    part = lambda n: F.regexp_extract("raw", _HEADER, n)
    count = lambda n: F.when(part(n) == "", 1).otherwise(part(n).cast("long"))
    marked = lines.withColumn("hunk", F.sum(is_header.cast("long")).over(whole)).filter("hunk > 0")
    heads = marked.filter(is_header).select(
        key, "hunk", part(1).cast("long").alias("a"), count(2).alias("an"), part(3).cast("long").alias("b"), count(4).alias("bn")
    )
    body = marked.filter(~is_header & ~F.col("raw").startswith("\\"))
    within = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sign = F.left("raw", F.lit(1))
    before = lambda other: F.coalesce(F.sum((sign != other).cast("long")).over(within), F.lit(0))
    counted = body.withColumn("o", before("+")).withColumn("n", before("-")).join(heads, [key, "hunk"])
    kind = F.when(sign == "+", "add").when(sign == "-", "del").otherwise("ctx")
    inside = F.when(kind == "add", F.col("n") < F.col("bn")).when(kind == "del", F.col("o") < F.col("an")).otherwise((F.col("o") < F.col("an")) & (F.col("n") < F.col("bn")))
    span = lambda start, size: F.when(size == 1, start.cast("string")).otherwise(F.concat(start, F.lit(","), size))
    header = F.concat(F.lit("@@ -"), span(F.col("a"), F.col("an")), F.lit(" +"), span(F.col("b"), F.col("bn")), F.lit(" @@"))
    return counted.filter(inside).select(
        key, "hunk", header.alias("header"), F.col("pos").alias("place"), kind.alias("kind"),
        F.when(kind != "add", F.col("a") + F.col("o")).alias("old_line"), F.when(kind != "del", F.col("b") + F.col("n")).alias("new_line"), F.substr("raw", F.lit(2)).alias("text"),
    )


def diff_files(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Files (file_path, status, additions, deletions) with the number of hunks of the patch of their cleaned path, 0 without one."""
    hunks = patch_lines(patches.withColumn("file_path", clean_path(F.col("file_path")))).groupBy("file_path").agg(F.countDistinct("hunk").alias("hunks"))
    return files.join(hunks, "file_path", "left").fillna(0, ["hunks"])


def inline_comments(lines: DataFrame, comments: DataFrame) -> DataFrame:
    """Diff lines joined with the comments (id, file_path, line_number) on them: the old line of a deletion, else the new one."""
    number = F.when(F.col("kind") == "del", F.col("old_line")).otherwise(F.col("new_line"))
    return lines.withColumn("line_number", number).join(comments.select("id", "file_path", "line_number"), ["file_path", "line_number"])


def sync_state(facts: DataFrame) -> DataFrame:
    """Adds ``state`` to facts (linked, rebasing, dirty, action, local_oid, remote_oid, previous_oid, conflicts, failure).

    ``action`` is status, sync or push. The eight states: unlinked, conflicted,
    dirty, needsSync, upToDate, synced, submitted and leaseRejected; null if a
    push failed otherwise. A remote that was never fetched is null.
    """
    c = F.col
    rejected = F.lower("failure").rlike("stale info|fetch first|force-with-lease|rejected")
    synced = F.when(c("conflicts") > 0, "conflicted").when(c("previous_oid").eqNullSafe(c("local_oid")), "upToDate").otherwise("synced")
    pushed = F.when(c("failure").isNull(), "submitted").when(rejected, "leaseRejected")
    state = (
        F.when(~c("linked"), "unlinked")
        .when(c("rebasing"), "conflicted")
        .when(c("dirty"), "dirty")
        .when(c("action") == "push", pushed)
        .when(c("action") == "sync", synced)
        .when(c("remote_oid").isNull() | (c("local_oid") != c("remote_oid")), "needsSync")
        .otherwise("upToDate")
    )
    return facts.withColumn("state", state)


def line_threads(threads: DataFrame) -> DataFrame:
    """(page_slug, line, root_id): the thread of each line, the first by (created_at, root_id) of those that cover it.

    ``threads`` (root_id, page_slug, created_at, start_line, end_line) are the
    anchored ones. Grouped by page and line, so no page is one task.
    """
    each = threads.select("page_slug", "root_id", "created_at", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    return each.groupBy("page_slug", "line").agg(F.min_by("root_id", F.struct("created_at", "root_id")).alias("root_id"))


def settled(events: DataFrame, delay_ms: int) -> DataFrame:
    """Of typed queries (session, at, query) those which are sent: no other one follows in the session within the delay."""
    w = Window.partitionBy("session").orderBy("at", "query")
    after = (F.unix_micros(F.lead("at").over(w)) - F.unix_micros("at")) / 1000
    return events.withColumn("_gap", after).filter(F.col("_gap").isNull() | (F.col("_gap") >= delay_ms)).drop("_gap")


def ready(checks: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """(agent, ready): the newest check of each agent if it is not older than ``seconds``; others are not listed."""
    newest = checks.groupBy("agent").agg(F.max("checked_at").alias("at"), F.max_by("ready", "checked_at").alias("ready"))
    return newest.filter(F.unix_micros(now) - F.unix_micros("at") <= seconds * 1_000_000).select("agent", "ready")


def sources_of(main: DataFrame, own: DataFrame, private: bool) -> DataFrame:
    """(filename, origin): sources of both branches by name; one's own win in a private Space, main's in a shared one."""
    a, b = (own, main) if private else (main, own)
    names = ("user", "main") if private else ("main", "user")
    first = a.select("filename").distinct()
    return first.withColumn("origin", F.lit(names[0])).unionByName(b.select("filename").distinct().join(first, "filename", "left_anti").withColumn("origin", F.lit(names[1])))


def contributions(changes: DataFrame, commit: DataFrame) -> DataFrame:
    """(id) of agent changes (id, path) with any path in common with a commit (path)."""
    return changes.join(commit.select("path").distinct(), "path", "left_semi").select("id").distinct()
