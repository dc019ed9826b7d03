"""Display metadata, source lists, source addresses and normalised front matter of documents as columns.

Display metadata is read as YAML. Elsewhere front matter is read line by line
as flat ``key: value`` fields; nested YAML under other keys is kept as it
stands.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import conformance, paths, text


def yaml_fields(block: str | None, keys: tuple[str, ...]) -> list[str | None]:
    """Trimmed text values of a YAML mapping by key; null where it is absent, blank or no text, or the block is no mapping."""
    if not block:
        return [None] * len(keys)
    try:
        import yaml
    except ImportError:  # flat fields only
        found = dict(re.findall(r"""(?m)^(\w+):[ \t]*["']?(.*?)["']?[ \t\r]*$""", block))
        return [found.get(k, "").strip() or None for k in keys]
    try:
        found = yaml.safe_load(block)
    except (yaml.YAMLError, ValueError):
        found = None
    values = [found.get(k) if isinstance(found, dict) else None for k in keys]
    return [v.strip() or None if isinstance(v, str) else None for v in values]


def display_metadata(document: Column) -> Column:
    """A struct of title and description.

    The title is the YAML title, else the first line of the body which begins
    with ``# `` unindented; the description is the YAML description, else the
    summary. Only documents with front matter reach Python.
    """

    @F.pandas_udf("title string, description string")
    def parsed(blocks: pd.Series) -> pd.DataFrame:
        rows = [yaml_fields(b, ("title", "description", "summary")) for b in blocks]
        return pd.DataFrame([(t, d or s) for t, d, s in rows], columns=["title", "description"])

    block = F.when(document.startswith("---"), text.front_matter(document))
    fields = parsed(block)
    heading = F.regexp_extract(text.content(document), r"(?m)^# (.*)$", 1)
    trimmed = F.trim(F.regexp_replace(heading, "\r", ""))
    return F.struct(F.coalesce(fields["title"], F.when(trimmed != "", trimmed)).alias("title"), fields["description"].alias("description"))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"""^['"]|['"]$""", "")


def source_reference(value: Column) -> Column:
    """The path below the raw-source directory; null if it is no Markdown file or has an empty or dotted part."""
    v = _unquoted(value)
    relative = F.when(v.startswith(paths.SOURCES), F.substr(v, F.lit(len(paths.SOURCES) + 1))).otherwise(F.regexp_replace(v, "^sources/", ""))
    unsafe = F.exists(F.split(relative, "/"), lambda part: (part == "") | part.startswith("."))
    return F.when(paths.is_markdown(relative) & ~unsafe, F.concat(F.lit(paths.SOURCES), relative))


def sources(document: Column) -> Column:
    """Distinct safe references of ``sources:``, in order: an inline list, one value, or the items below it.

    Empty for a null document, and without the field; a repeated field counts once, the first.
    """
    block = F.regexp_replace(text.front_matter(document), "\r\n", "\n")
    line = F.trim(F.regexp_extract(block, r"(?m)^sources[ \t]*:(.*)$", 1))
    below = F.regexp_extract(block, r"(?m)^sources[ \t]*:[ \t]*\n((?:[ \t]+-[ \t]+\S.*(?:\n|\z))*)", 1)
    items = F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]+-[ \t]+(\S.*)$"), F.lit(1))
    inline = F.when(line.rlike(r"^\[.*\]$"), F.split(F.regexp_replace(line, r"^\[|\]$", ""), ",")).otherwise(F.array(line))
    found = F.transform(F.when(line == "", items).otherwise(inline), source_reference)
    return F.coalesce(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def source_address(document: Column) -> Column:
    """The HTTP(S) address of ``source_url``; null if it has another scheme, no host, or a user name or password."""
    address = F.trim(text.field(document, "source_url"))
    parsed = lambda part: F.try_parse_url(address, F.lit(part))
    safe = F.lower(parsed("PROTOCOL")).isin("http", "https") & (parsed("HOST") != "") & parsed("USERINFO").isNull()
    return F.when(safe, address)


def normalised_concept(document: Column, fallback_title: Column, default_type: Column) -> Column:
    """The document with ``type`` and ``title`` filled where missing or blank, and ``summary`` mirrored as ``description``.

    A conforming document is returned as it is. The legacy ``kind: concept`` is
    removed; other lines of the front matter keep their order and bytes. A
    document whose front matter does not end is all body. Null stays null.
    """
    block = F.regexp_replace(text.front_matter(document), "\r\n", "\n")
    body = text.content(document)
    lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
    blank = lambda key: text.field(document, key) == ""
    kept = F.filter(lines, lambda x: ~x.rlike(r"""^kind:[ \t]*["']?concept["']?[ \t]*$"""))
    for key in ("type", "title"):
        kept = F.filter(kept, lambda x, key=key: ~(x.rlike(rf"^{key}:") & blank(key)))
    absent = lambda key: ~F.exists(lines, lambda x: x.rlike(rf"^{key}:"))
    none = F.array().cast("array<string>")
    filled = F.concat(
        kept,
        F.when(blank("type"), F.array(F.concat(F.lit("type: "), default_type))).otherwise(none),
        F.when(blank("title"), F.array(F.concat(F.lit("title: "), text.quoted(fallback_title)))).otherwise(none),
        F.when(absent("description") & ~blank("summary"), F.array(F.regexp_extract(block, r"(?m)^summary(:.*)$", 1))).otherwise(none),
    )
    named = F.transform(filled, lambda x: F.when(x.startswith(":"), F.concat(F.lit("description"), x)).otherwise(x))
    made = F.concat(F.lit("---\n"), F.array_join(named, "\n"), F.lit("\n---\n\n"), F.regexp_replace(body, r"^[\r\n]+", ""))
    return F.when(conformance.concept(document), document).otherwise(made)
