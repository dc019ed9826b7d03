"""Path and visibility rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN_ROOT = ".kb"
SOURCES = f"{HIDDEN_ROOT}/sources/"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The directory of a path; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_hidden(path: Column) -> Column:
    """Any component starts with a dot; below the raw-source directory only deeper ones count."""
    rest = F.when(path.startswith(SOURCES), F.substr(path, F.lit(len(SOURCES) + 1))).otherwise(path)
    return F.exists(F.split(rest, "/"), lambda c: c.startswith("."))


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def kind(path: Column) -> Column:
    """concept, index, log or other, by file name only."""
    name = base_name(path)
    return F.when(name == "index.md", "index").when(name == "log.md", "log").when(name.endswith(".md"), "concept").otherwise("other")


def is_reserved(path: Column) -> Column:
    return base_name(path).isin("index.md", "log.md")


def slug(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def humanised(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, r"\.md$", ""), "[-_]", " ")


def extension(path: Column) -> Column:
    """Lower case, empty without a dot in the name."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def stored_source_name(name: Column) -> Column:
    """A plain Markdown name is kept; a reserved or other one becomes its digest."""
    kept = name.endswith(".md") & ~name.isin("index.md", "log.md")
    return F.when(kept, name).otherwise(F.concat(F.lit("_encoded/"), F.sha2(name, 256), F.lit(".md")))


def fold(path: Column) -> Column:
    """Resolve ``.`` and ``..``; null if the path escapes the root."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    step = lambda acc, c: (
        F.when(c.isin("", "."), acc)
        .when(
            c == "..",
            F.struct(F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["ok"] & (F.size(acc["p"]) > 0)).alias("ok")),
        )
        .otherwise(F.struct(F.concat(acc["p"], F.array(c)).alias("p"), acc["ok"].alias("ok")))
    )
    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["p"], "/")))
