"""Bundles of documents: whether they need migration, and the migration as a plan over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import conformance, metadata, paths, text
from quillspark.operators import tree, versions
from quillspark.storage import materialize

VERSION = "0.1"
VERSION_KEY = "format_version"
LEGACY = f"{paths.HIDDEN_ROOT}/legacy/"
OLD_SOURCES = "sources/"


def root_index() -> str:
    return f'---\n{VERSION_KEY}: "{VERSION}"\n---\n\n# Knowledge\n'


def folder_index(title: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n"))


def replacement_log(path: Column, date: str) -> Column:
    return F.concat(F.lit(f"# Directory Update Log\n\n## {date}\n* **Migration**: Preserved the legacy log from `"), path, F.lit(f"` under `{LEGACY}`.\n"))


def conforms(path: Column, body: Column) -> Column:
    """Whether a document is valid for its kind; other files are."""
    kind = paths.kind(path)
    index = F.when(path == "index.md", conformance.index(body, (VERSION_KEY,))).otherwise(conformance.index(body))
    return F.when(kind == "concept", conformance.concept(body)).when(kind == "index", index).when(kind == "log", conformance.log(body)).otherwise(True)


def judged(path: Column) -> Column:
    """Visible documents and raw sources."""
    visible = ~F.exists(F.split(path, "/"), lambda c: c.startswith("."))
    return visible | path.startswith(paths.SOURCES)


def needs_migration(files: DataFrame) -> DataFrame:
    """(space_id, needs_migration, newer) of files (space_id, path, body).

    A Space with a declared other version is ``newer`` and needs none. Else it
    does if the root index is missing or declares no version, a document is not
    valid for its kind or has no valid text (a null body), or a visible
    directory has no index.
    """
    p, b = F.col("path"), F.col("body")
    root = files.filter("path = 'index.md'").select("space_id", F.nullif(text.field(b, VERSION_KEY), F.lit("")).alias("declared"), F.lit(True).alias("has_root"))
    bad = files.filter(judged(p)).groupBy("space_id").agg(F.max(F.coalesce(~conforms(p, b), F.lit(True))).alias("bad"))
    dirs = tree.folders(files.filter(~p.startswith(paths.HIDDEN_ROOT)))
    indexes = files.filter(paths.base_name(p) == "index.md").select("space_id", paths.parent(p).alias("path"))
    bare = dirs.join(indexes, ["space_id", "path"], "left_anti").groupBy("space_id").agg(F.lit(True).alias("bare"))
    every = files.select("space_id").distinct().join(root, "space_id", "left").join(bad, "space_id", "left").join(bare, "space_id", "left")
    newer = F.col("declared").isNotNull() & (F.col("declared") != VERSION)
    needs = F.col("has_root").isNull() | F.col("declared").isNull() | F.coalesce("bad", F.lit(False)) | F.coalesce("bare", F.lit(False))
    return every.select("space_id", (needs & ~newer).alias("needs_migration"), newer.alias("newer"))


def source_moves(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(space_id, path, action, target) for files below the old source folder.

    A blank ``.gitkeep`` is removed. A plain Markdown name moves below the raw
    sources; a reserved or other name becomes its digest. If the target exists,
    the bytes are archived instead.
    """
    p = F.col("path")
    relative = F.substr(p, F.lit(len(OLD_SOURCES) + 1))
    name = paths.base_name(p)
    plain = name.endswith(".md") & ~name.isin("index.md", "log.md")
    target = F.when(plain, F.concat(F.lit(paths.SOURCES), relative)).otherwise(F.concat(F.lit(f"{paths.SOURCES}_encoded/"), F.sha2(relative, 256), F.lit(".md")))
    old = files.filter(p.startswith(OLD_SOURCES)).withColumn("target", target)
    taken = existing.select("space_id", F.col("path").alias("target"), F.lit(True).alias("taken")).distinct()
    gone = (name == ".gitkeep") & (F.trim(F.translate(F.coalesce("body", F.lit("x")), "\t\r\n\f", "    ")) == "")
    archive = F.concat(F.lit(f"{LEGACY}source-collisions/"), F.regexp_replace(relative, r"\.[^./]*$", ""), F.lit(".md.legacy"))
    action = F.when(gone, "remove").when(F.col("taken"), "archive").otherwise("move")
    where = F.when(gone, F.lit(None)).when(F.col("taken"), archive).otherwise(F.col("target"))
    return old.join(taken, ["space_id", "target"], "left").select("space_id", "path", action.alias("action"), where.alias("target"))


def archived(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """Archive targets with a number where the path is taken, by stored files or by earlier ones of the same plan."""
    rows = moves.filter("action = 'archive'")
    numbered = existing.select("space_id", F.regexp_replace("path", r"(\.legacy)\.\d+$", "$1").alias("target")).groupBy("space_id", "target").agg(F.count("*").alias("stored"))
    # as many files as share one archive name: those of one path, which differ in their extension only
    rank = F.row_number().over(Window.partitionBy("space_id", "target").orderBy("path")) - 1
    placed = rows.join(numbered, ["space_id", "target"], "left").withColumn("k", rank + F.coalesce("stored", F.lit(0)))
    name = F.when(F.col("k") == 0, F.col("target")).otherwise(F.concat("target", F.lit("."), F.col("k").cast("string")))
    return placed.select("space_id", "path", "action", name.alias("target"))


def prepared(files: DataFrame, date: str, dirty: DataFrame | None = None) -> DataFrame:
    """The files (space_id, path, body) of Spaces after migration: sources moved, documents normalised, indexes in place.

    ``dirty`` (space_id, path) are changes that are not committed: a Space with
    any is refused. Documents that already conform keep their bytes; an invalid
    log is archived and replaced; other documents get type and title. Every
    directory gets an index. The input is left as it is, so it is the backup.
    """
    if dirty is not None and not dirty.isEmpty():
        raise ValueError("commit or discard changes first")
    moves = source_moves(files, files)
    plan = materialize(moves.filter("action <> 'archive'").unionByName(archived(moves, files)), "moves")
    stay = files.join(plan.select("space_id", "path"), ["space_id", "path"], "left_anti").select("space_id", "path", "body")
    moved = files.select("space_id", "path", "body").join(plan.filter("action <> 'remove'"), ["space_id", "path"]).select("space_id", F.col("target").alias("path"), "body")
    every = materialize(stay.unionByName(moved), "moved")
    p, b = F.col("path"), F.col("body")
    kind, fine = paths.kind(p), conforms(p, b)
    default = F.when(p.startswith(paths.SOURCES), "Source").otherwise("Note")
    concept = metadata.normalised_concept(b, paths.slug(paths.base_name(p)), default)
    heading = F.concat(F.lit("# "), F.when(paths.parent(p) == "", "Knowledge").otherwise(paths.base_name(paths.parent(p))), F.lit("\n\n"), F.regexp_replace(text.content(b), r"^[\r\n]+", ""))
    body = text.content(b)
    index = F.when(body.rlike(r"(?m)^# "), F.regexp_replace(body, r"^[\r\n]+", "")).otherwise(heading)
    index = F.when(p == "index.md", F.concat(F.lit(f'---\n{VERSION_KEY}: "{VERSION}"\n---\n\n'), index)).otherwise(index)
    invalid = judged(p) & ~fine & b.isNotNull()
    made = F.when(invalid & (kind == "concept"), concept).when(invalid & (kind == "index"), index).when(invalid & (kind == "log"), replacement_log(p, date)).otherwise(b)
    logs = every.filter(invalid & (kind == "log")).select("space_id", F.concat(F.lit(LEGACY), F.regexp_replace(p, r"\.md$", ""), F.lit(".md.legacy")).alias("path"), "body")
    normal = materialize(every.select("space_id", "path", made.alias("body")).unionByName(logs), "normal")
    dirs = tree.folders(normal.filter(~p.startswith(paths.HIDDEN_ROOT))).unionByName(normal.select("space_id", F.lit("").alias("path")).distinct())
    wanted = dirs.select("space_id", F.when(p == "", "index.md").otherwise(F.concat(p, F.lit("/index.md"))).alias("path"))
    fresh = wanted.join(normal.select("space_id", "path"), ["space_id", "path"], "left_anti")
    new_body = F.when(p == "index.md", root_index()).otherwise(folder_index(paths.base_name(paths.parent(p))))
    return normal.unionByName(fresh.select("space_id", "path", new_body.alias("body")))


def staged(changed: DataFrame, artifacts_only: bool = False) -> DataFrame:
    """Of changed paths those which are committed: documents in safe paths and the legacy archive; or indexes and the archive only."""
    p = F.col("path")
    safe = ~p.startswith("/") & ~F.exists(F.split(p, "/"), lambda c: c.isin("", ".", "..", ".git"))
    kept = (paths.kind(p) == "index") if artifacts_only else (paths.kind(p) != "other") & safe
    return changed.filter(kept | p.startswith(LEGACY))


def migration_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a migration changed, as :func:`quillspark.operators.versions.changes` of paths with their Space before them."""
    named = lambda df: df.select(F.concat("space_id", F.lit("/"), "path").alias("path"), "body")
    return versions.changes(named(before), named(after))
