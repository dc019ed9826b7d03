"""Agent changes: trailers, records, status, merge into a draft, guarded transitions, and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import linediff, ranks, versions
from quillspark.storage import materialize

TITLE_PREFIX = "Agent Change: "
TRAILERS = ("Agent: ", "Agent-Change: ", "Agent-Task: ")


def trailer_value(value: Column) -> Column:
    """The first line, trimmed, of 160 characters at most."""
    return F.left(F.trim(F.regexp_extract(value, r"^([^\r\n]*)", 1)), F.lit(160))


def with_trailers(message: Column, name: Column, change_id: Column, task: Column) -> Column:
    lines = [F.concat(F.lit(k), trailer_value(v), F.lit("\n")) for k, v in zip(TRAILERS, (name, change_id, task), strict=True)]
    return F.concat(F.rtrim(message), F.lit("\n\n"), *lines)


def trailers(message: Column) -> Column:
    """Structs of name, change_id and task: three lines in a row, in this order; other lines are none."""
    a, b, c = TRAILERS
    lines = F.split(message, r"\r?\n")
    at = F.when(F.size(lines) > 2, F.sequence(F.lit(0), F.size(lines) - 3))
    line = lambda i, k: F.get(lines, i + k)
    whole = F.filter(at, lambda i: line(i, 0).startswith(a) & line(i, 1).startswith(b) & line(i, 2).startswith(c))
    rest = lambda i, k, p: F.substr(line(i, k), F.lit(len(p) + 1))
    found = F.transform(whole, lambda i: F.struct(rest(i, 0, a).alias("name"), rest(i, 1, b).alias("change_id"), rest(i, 2, c).alias("task")))
    return F.coalesce(found, F.array().cast("array<struct<name:string,change_id:string,task:string>>"))


def status(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds ``status`` to changes (id): discarded before merged before needsResolution before open, from refs (id, kind)."""
    has = lambda k: F.max((F.col("kind") == k).cast("int")) == 1
    facts = refs.groupBy("id").agg(has("discarded").alias("d"), has("merged").alias("m"), has("conflict").alias("c"))
    found = F.when(F.col("d"), "discarded").when(F.col("m"), "merged").when(F.col("c"), "needsResolution").otherwise("open")
    return changes.join(facts, "id", "left").withColumn("status", found).drop("d", "m", "c")


def transition(refs: DataFrame, changes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The refs after ``wanted`` (id, kind: discarded, merged or conflict), and the requests which are refused.

    Only open changes and those that need resolution move. A discarded or
    merged change loses its conflict. Of two requests for one change the
    stronger status counts.
    """
    now = status(refs, changes.select("id"))
    active = wanted.join(now.filter(F.col("status").isin("open", "needsResolution")).select("id"), "id", "left_semi")
    rank = F.when(F.col("kind") == "discarded", 0).when(F.col("kind") == "merged", 1).otherwise(2)
    chosen = active.groupBy("id").agg(F.min_by("kind", rank).alias("kind"))
    closed = chosen.filter("kind <> 'conflict'").select("id", F.lit("conflict").alias("kind"))
    after = refs.select("id", "kind").join(closed, ["id", "kind"], "left_anti").unionByName(chosen).distinct()
    return after, wanted.join(now.filter(F.col("status").isin("open", "needsResolution")).select("id"), "id", "left_anti")


def records(changes: DataFrame, refs: DataFrame, diffs: DataFrame) -> DataFrame:
    """(id, title, status, created_at, files) of changes (id, summary, created_at); ``diffs`` (id, path) are base to result."""
    title = F.when(F.col("summary").startswith(TITLE_PREFIX), F.substr("summary", F.lit(len(TITLE_PREFIX) + 1))).otherwise("Agent Change")
    n = diffs.groupBy("id").agg(F.count("*").alias("files"))
    return status(refs, changes).join(n, "id", "left").select("id", title.alias("title"), "status", "created_at", F.coalesce("files", F.lit(0)).alias("files"))


def newest_first(records_: DataFrame, first: Column | None = None) -> DataFrame:
    """Adds the place of the listing: newest first, then the greater id; ``first`` is pinned before all others."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return ranks.placed(records_, order if first is None else [first.cast("int").desc(), *order])


def merged(base: DataFrame, draft: DataFrame, agent: DataFrame) -> DataFrame:
    """(path, state, body) of the three-way merge, line by line where both sides changed a file.

    State: unchanged, same, take_agent, keep_draft, merged or conflict. A
    missing file is a null body; a file which one side deleted and the other
    changed is a conflict, as is one that both added differently. The body of a
    conflict is the draft's. Only files which both changed are compared line by line,
    by the rules of :func:`quillspark.operators.linediff.merged`.
    """
    states = versions.merge_states(base, draft, agent)
    named = lambda df, n: df.select("path", F.col("body").alias(n))
    joined = states.join(named(draft, "draft"), "path", "left").join(named(agent, "agent"), "path", "left")
    simple = joined.filter("state <> 'conflict'").select("path", "state", F.when(F.col("state") == "take_agent", F.col("agent")).otherwise(F.col("draft")).alias("body"))

    both = joined.filter("state = 'conflict'").join(named(base, "base"), "path", "left")
    whole = both.filter("base is not null and draft is not null and agent is not null").select(F.col("path").alias("key"), "base", "draft", "agent")
    both = both.join(linediff.merged(whole).select(F.col("key").alias("path"), F.col("body").alias("made")), "path", "left")
    hard = both.select("path", F.when(F.col("made").isNotNull(), "merged").otherwise("conflict").alias("state"), F.coalesce("made", "draft").alias("body"))
    return simple.unionByName(hard)


def merge_change(base: DataFrame, draft: DataFrame, agent: DataFrame) -> tuple[str, DataFrame]:
    """``merged`` and the new draft (path, body); with any conflict ``needsResolution`` and the draft as it was."""
    files = materialize(merged(base, draft, agent), "merged")
    if not files.filter("state = 'conflict'").isEmpty():
        return "needsResolution", draft.select("path", "body")
    return "merged", files.filter("body is not null").select("path", "body")


def stale(actual: DataFrame, expected: DataFrame, paths: DataFrame) -> DataFrame:
    """Those of ``paths`` whose bytes are not those expected; a missing file is a value of its own."""
    sha = lambda df, n: df.select("path", F.sha2("body", 256).alias(n))
    joined = paths.select("path").distinct().join(sha(actual, "a"), "path", "left").join(sha(expected, "e"), "path", "left")
    return joined.filter(~F.col("a").eqNullSafe(F.col("e"))).select("path")


def apply_transition(actual: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``actual`` (path, body) moved from the tree ``before`` to ``after``: all of it, or an error and none.

    Only paths that differ between the trees are touched, and each must still
    be as it was ``before``. The result is a new table; the caller swaps it in,
    so there is nothing to roll back.
    """
    touched = materialize(versions.changes(before, after).select("path"), "touched")
    if not stale(actual, before, touched).isEmpty():
        raise ValueError("the draft changed in the meantime; merge again")
    kept = actual.select("path", "body").join(touched, "path", "left_anti")
    return kept.unionByName(after.select("path", "body").join(touched, "path", "left_semi"))


def same_diff(current: DataFrame, expected: DataFrame) -> bool:
    """Whether two diffs (path, status, old_sha, new_sha) are equal row by row; what a review keeps must be what it showed."""
    cols = ["path", "status", "old_sha", "new_sha"]
    a, b = current.select(*cols), expected.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def stale_paths(current: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, stale) of both diffs (path, status, old_sha, new_sha): whether a path's row is not the one expected."""
    row = lambda df, n: df.select("path", F.struct("status", "old_sha", "new_sha").alias(n))
    met = row(current, "c").join(row(expected, "e"), "path", "full")
    return met.select("path", (~F.col("c").eqNullSafe(F.col("e"))).alias("stale"))


def keep_diff(head: DataFrame, work: DataFrame, expected: DataFrame) -> DataFrame:
    """The new head after the reviewed diff is kept; refused if files have changed since."""
    if not same_diff(versions.changes(head, work), expected):
        raise ValueError("files changed after the review opened")
    return apply_transition(head, head, work)


def last_change(history: DataFrame) -> DataFrame:
    """(path, seq) of the last commit whose blob differs from the commit before, of (path, seq, blob) with a row for each commit.

    A null blob is a missing file and names no commit. Linear history.
    """
    w = Window.partitionBy("path").orderBy("seq")
    changed = history.withColumn("before", F.lag("blob").over(w)).filter("blob is not null").filter(~F.col("blob").eqNullSafe(F.col("before")))
    return changed.groupBy("path").agg(F.max("seq").alias("seq"))


def checkpoint_chain(commits: DataFrame, tip: str) -> DataFrame:
    """(id, place) from the tip through first parents, until a commit has no checkpoint ref; ``commits`` (id, parent, has_ref).

    Pointers are doubled, so a chain of n commits takes about log2(n) rounds of joins.
    """
    marked = commits.filter("has_ref").select("id", "parent")
    alive = marked.select(F.col("id").alias("parent"))
    jump = materialize(marked.join(alive, "parent", "left_semi").select(F.col("id").alias("a"), F.col("parent").alias("b")), "jump")
    found = marked.filter(F.col("id") == tip).select("id", F.lit(0).cast("long").alias("place"))
    step = 1
    while not jump.isEmpty():
        found = materialize(found.unionByName(found.join(jump, found["id"] == jump["a"]).select(F.col("b").alias("id"), (F.col("place") + step).alias("place"))), "chain")
        then = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump = materialize(jump.join(then, "b").select("a", F.col("c").alias("b")), "jump")
        step *= 2
    return found
