"""Conformance of concept, index and log documents as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text


def concept(body: Column) -> Column:
    """Front matter with a non-blank ``type``, and not the legacy ``kind: concept``."""
    return (text.field(body, "type") != "") & (text.field(body, "kind") != "concept")


def index(body: Column, root_keys: tuple[str, ...] = ()) -> Column:
    """A heading line and no front matter; the root's index may have front matter of ``root_keys`` only."""
    heading = body.rlike(r"(?m)^# ")
    block = text.front_matter(body)
    keys = F.filter(F.regexp_extract_all(block, F.lit(r"(?m)^([^\s:#]+):"), F.lit(1)), lambda k: ~k.isin(*root_keys))
    return heading & ((F.size(keys) == 0) if root_keys else ~body.rlike(r"^---\r?\n"))


def log(body: Column) -> Column:
    """A first heading, then date groups, newest first, each with a list item; other lines are items or indented."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    shaped = F.forall(rest, lambda x: x.rlike(r"^(?:## \d{4}-\d{2}-\d{2}\s*$|[-*] |[ \t])"))
    joined = F.concat(F.array_join(rest, "\n"), F.lit("\n"))
    dates = F.regexp_extract_all(joined, F.lit(r"(?m)^## (\d{4}-\d{2}-\d{2})"), F.lit(1))
    real = F.forall(dates, lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull())
    # ISO dates order as text; distinct and descending is strictly newest first
    ordered = (F.array_join(F.reverse(F.array_sort(dates)), ",") == F.array_join(dates, ",")) & (F.size(F.array_distinct(dates)) == F.size(dates))
    filled = ~joined.rlike(r"(?m)^## [^\n]*\n(?:## |\z)") & ~F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("## ")).rlike(r"^(?:[-*] |[ \t])")
    return F.try_element_at(lines, F.lit(1)).startswith("# ") & shaped & real & ordered & filled & (F.size(dates) > 0)
