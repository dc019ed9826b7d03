"""Target resolution of links as columns; :mod:`quillspark.functions.commonmark` finds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import paths


def local_target(target: Column) -> Column:
    """The path part of a local link; null for anchors, queries, absolute URLs and schemes."""
    t = F.trim(target)
    outside = (t == "") | t.rlike("^[#?]") | t.startswith("//") | t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(~outside, F.regexp_replace(t, "[#?].*$", ""))


def resolve_wikilink(target: Column) -> Column:
    """Root-anchored; ``.md`` is appended; null if it escapes or is empty."""
    p = paths.fold(local_target(target))
    return F.when(p != "", F.when(paths.is_markdown(p), p).otherwise(F.concat(p, F.lit(".md"))))


def resolve_markdown(source: Column, target: Column) -> Column:
    """Percent-decoded and relative to the source's directory, or to the root with a leading slash."""
    t = F.coalesce(F.try_url_decode(F.replace(local_target(target), F.lit("+"), F.lit("%2B"))), local_target(target))
    return paths.fold(F.when(t.startswith("/"), t).otherwise(F.concat(paths.parent(source), F.lit("/"), t)))
