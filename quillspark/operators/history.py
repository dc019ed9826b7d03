"""Commit graphs with merges: reachable commits, an order of time that respects parents, and the last change of every path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import materialize


def dated(commits: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``commits`` (id, parents, committed_at) with ``at``, a time after those of all parents.

    It is the commit's own time unless a parent's is as late. Only commits with
    such a parent take part in a further round, so a graph without skewed clocks
    takes one.
    """
    edges = materialize(commits.select("id", F.explode("parents").alias("parent")).distinct(), "edges")
    now = materialize(commits.select("id", F.col("committed_at").cast("long").alias("at")), "dated")
    for _ in range(rounds):
        least = edges.join(now.select(F.col("id").alias("parent"), "at"), "parent").groupBy("id").agg((F.max("at") + 1).alias("least"))
        late = materialize(now.join(least, "id").filter(F.col("least") > F.col("at")).select("id", "least"), "late")
        if late.isEmpty():
            return commits.join(now, "id")
        now = materialize(now.join(late, "id", "left").select("id", F.greatest("at", F.coalesce("least", "at")).alias("at")), "dated")
    raise ValueError("commits have a cycle")


def ancestors(commits: DataFrame, tip: str) -> DataFrame:
    """(id) of ``tip`` and all commits reachable from it.

    First parents make a forest, so pointers which double give a whole line of
    first parents in log2(n) joins. Other parents start lines of their own; the
    rounds are as many as merges are nested, not as the history is long.
    """
    jumps = []
    step = materialize(commits.select("id", F.get("parents", F.lit(0)).alias("to")).filter("`to` is not null"), "jump")
    while not step.isEmpty():
        jumps.append(step)
        then = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = materialize(step.join(then, "to").select("id", F.col("next").alias("to")), "jump")
    known = commits.filter(F.col("id") == tip).select("id")
    fresh = known
    others = materialize(commits.filter(F.size("parents") > 1).select("id", F.explode(F.slice("parents", 2, 1 << 30)).alias("to")), "merged")
    reached = known.limit(0)
    while not fresh.isEmpty():
        line = fresh
        for jump in jumps:
            line = materialize(line.unionByName(jump.join(line, "id", "left_semi").select(F.col("to").alias("id"))).distinct(), "line")
        added = materialize(line.join(reached, "id", "left_anti"), "reached")
        reached = materialize(reached.unionByName(added), "reached")
        fresh = materialize(others.join(added, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(reached, "id", "left_anti"), "fresh")
    return reached.join(commits.select("id"), "id", "left_semi")


def last_changes(commits: DataFrame, blobs: DataFrame, tip: str) -> DataFrame:
    """(path, id): the latest reachable commit that changed each path.

    ``commits`` (id, parents, committed_at), ``blobs`` (id, path, blob): a row
    for each file of a commit's tree. A commit changed a path if its blob is
    not the one in its first parent's tree; a tree without the path changes
    nothing. Latest is by :func:`dated`, children before parents, then the
    greater id.
    """
    held = materialize(dated(commits).join(ancestors(commits, tip), "id", "left_semi").select("id", F.get("parents", F.lit(0)).alias("parent"), "at"), "walked")
    mine = blobs.filter("blob is not null").join(held, "id")
    before = blobs.select(F.col("id").alias("parent"), "path", F.col("blob").alias("before"))
    changed = mine.join(before, ["parent", "path"], "left").filter(~F.col("blob").eqNullSafe(F.col("before")))
    return changed.groupBy("path").agg(F.max_by("id", F.struct("at", "id")).alias("id"))
