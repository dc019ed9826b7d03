"""Small columns of the views: times, hashes, initials, routes, titles and states."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import paths, text

_DAY = 86_400


def _elapsed(at: Column, now: Column) -> Column:
    return F.floor(F.unix_micros(now) / 1_000_000 - F.unix_micros(at) / 1_000_000).cast("long")


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("long").cast("string"), F.lit(unit))


def time_ago(at: Column, now: Column) -> Column:
    """``5s ago``, ``3m ago``, ``2h ago``, ``4d ago``; empty for null, and never negative."""
    s = F.greatest(_elapsed(at, now), F.lit(0))
    value = F.when(s < 60, _counted(s, "s")).when(s < 3600, _counted(F.floor(s / 60), "m")).when(s < _DAY, _counted(F.floor(s / 3600), "h")).otherwise(_counted(F.floor(s / _DAY), "d"))
    return F.when(at.isNull(), "").otherwise(F.concat(value, F.lit(" ago")))


def comment_time(at: Column, now: Column) -> Column:
    """``now`` within a minute, then ``3m``, ``2h``, ``4d``; ``recently`` for null."""
    s = F.greatest(_elapsed(at, now), F.lit(0))
    value = F.when(s < 60, "now").when(s < 3600, _counted(F.floor(s / 60), "m")).when(s < _DAY, _counted(F.floor(s / 3600), "h")).otherwise(_counted(F.floor(s / _DAY), "d"))
    return F.when(at.isNull(), "recently").otherwise(value)


def ordinal_timestamp(parts: Column) -> Column:
    """ISO text (UTC, milliseconds) of [year, day of year, hour, minute, second, nanosecond, offset hour, minute, second].

    The offset may be left out, in whole or from its end on. Fewer than six
    numbers, a null array or a null number give an empty text.
    """
    n = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(0)).cast("long")
    oh, om, os = n(6), n(7), n(8)
    sign = F.signum(F.when(oh != 0, oh).when(om != 0, om).otherwise(os)).cast("long")
    offset = oh * 3600 + sign * (F.abs(om) * 60 + F.abs(os))
    start = F.unix_date(F.make_date(n(0).cast("int"), F.lit(1), F.lit(1))).cast("long")
    ms = ((start + n(1) - 1) * _DAY + n(2) * 3600 + n(3) * 60 + n(4) - offset) * 1000 + F.floor(n(5) / 1_000_000)
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day, rest = F.floor(ms / (_DAY * 1000)), F.pmod(ms, F.lit(_DAY * 1000))
    clock = F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(rest / 3_600_000), F.lit(":"), two(rest % 3_600_000 / 60_000), F.lit(":"),
        two(rest % 60_000 / 1000), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"),
    )
    return F.when((F.size(parts) >= 6) & F.forall(F.slice(parts, 1, 6), lambda x: x.isNotNull()), clock).otherwise("")


def highlighted(column: Column, needle: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with all occurrences of a needle marked, in any case; as it is for a blank needle."""
    wanted = needle.strip()
    if not wanted:
        return column
    return F.regexp_replace(column, "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", wanted), f"{before}$0{after}")


def _units(value: Column) -> Column:
    """The UTF-16 units of a text."""

    def of(c):
        point = F.ascii(c).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(point - 0x10000, 10), F.lit(0xDC00) + (point - 0x10000).bitwiseAND(F.lit(0x3FF).cast("long"))
        return F.when(point < 0x10000, F.array(point)).otherwise(F.array(high, low))

    return F.flatten(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), of))


def char_code_hash(value: Column) -> Column:
    """The sum of the first UTF-16 unit of each character."""

    def first(c):
        point = F.ascii(c).cast("long")
        return F.when(point < 0x10000, point).otherwise(F.lit(0xD800) + F.shiftright(point - 0x10000, 10))

    return F.aggregate(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), first), F.lit(0).cast("long"), lambda s, c: s + c)


def djb2_hash(value: Column) -> Column:
    """Hash times 31 plus each unit, in 32 bits; its absolute value, 0 for the least number."""
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    h = F.aggregate(_units(value), F.lit(0).cast("long"), lambda s, c: wrap(s * 31 + c))
    return F.when(h == -(1 << 31), F.lit(0).cast("long")).otherwise(F.abs(h))


def avatar_initials(name: Column, kind: str = "default") -> Column:
    """Two letters of the first two words; one for a member; a comment's single word gives its first two letters; ``?`` for none."""
    t = F.trim(name)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    first = lambda w: F.left(w, F.lit(1))
    both = F.array_join(F.transform(F.slice(words, 1, 2), first), "")
    if kind == "member":
        both = first(t)
    elif kind == "comment":
        both = F.when(F.size(words) == 1, F.left(F.get(words, F.lit(0)), F.lit(2))).otherwise(both)
    return F.when(F.coalesce(t, F.lit("")) == "", "?").otherwise(F.upper(both))


def repo_path(value: Column) -> Column:
    """Forward slashes, without a leading ``./`` and without slashes at either end."""
    return F.regexp_replace(F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"^\./", ""), r"^/+|/+$", "")


def concept_id(path: Column) -> Column:
    return F.regexp_replace(repo_path(path), r"(?i)\.md$", "")


def concept_path(concept: Column) -> Column:
    """The page's file: HTML as it is, else with ``.md``."""
    return F.when(concept.rlike(r"(?i)\.html?$"), repo_path(concept)).otherwise(F.concat(concept_id(concept), F.lit(".md")))


def is_searchable(path: Column) -> Column:
    """A visible Markdown file which is no log; an index counts, other than for the engine."""
    p = repo_path(path)
    return p.rlike(r"(?i)\.md$") & ~F.exists(F.split(p, "/"), lambda c: c.startswith(".")) & (paths.base_name(p) != "log.md")


def is_concept_page(path: Column, kind: Column) -> Column:
    p = repo_path(path)
    visible = ~F.exists(F.split(p, "/"), lambda c: c.startswith("."))
    return (kind == "page") & (is_searchable(p) | (p.rlike(r"(?i)\.html?$") & visible))


def ui_slug(path: Column) -> Column:
    """The slug of a search hit in the view; null for an index, a log and raw sources, which it leaves out."""
    s = paths.slug(path)
    gone = paths.base_name(s).isin("index", "log") | s.startswith(paths.SOURCES)
    return F.when(~gone, s)


def uri_component(value: Column) -> Column:
    """Percent-encoded but for letters, digits and ``-_.!~*'()``."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def page_route(workspace: Column, concept: Column) -> Column:
    parts = F.transform(F.split(repo_path(concept), "/"), uri_component)
    return F.concat(F.lit("/"), uri_component(workspace), F.lit("/"), F.array_join(parts, "/"))


def mention_query(value: Column, caret: Column) -> Column:
    """What is typed after an ``@`` that ends at the caret; null if there is none."""
    head = F.left(value, caret)
    return F.when(head.rlike(r"@[A-Za-z0-9_-]*$"), F.regexp_extract(head, r"@([A-Za-z0-9_-]*)$", 1))


def system_front_matter(document: Column) -> Column:
    """The front matter with its marks and all line ends after it, as bytes stand; empty without one."""
    return F.regexp_extract(document, r"^(---\r?\n[\s\S]*?\r?\n---(?:\r?\n)*)", 1)


def editable_body(document: Column) -> Column:
    """What follows :func:`system_front_matter`; both in a row are the document again."""
    return F.substr(document, F.length(system_front_matter(document)) + 1)


def scalar(document: Column, key: str) -> Column:
    """A field as the view reads it: a JSON string if it begins with a double quote, else without single quotes."""
    line = F.regexp_extract(system_front_matter(document), rf"(?m)^{key}:(.*)$", 1)
    raw = F.trim(F.regexp_replace(line, "\r$", ""))
    return F.when(raw.startswith('"'), F.coalesce(F.try_element_at(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(1)), F.lit(""))).otherwise(F.regexp_replace(raw, "^'|'$", ""))


def source_title(title: Column, document: Column, path: Column) -> Column:
    """The loaded title, the field, the first heading or the file name in words: the first that is not empty."""
    filled = lambda c: F.when(c != "", c)
    heading = F.regexp_extract(editable_body(document), r"(?m)^#\s+(.+)$", 1)
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, f"^{re.escape(paths.SOURCES)}", ""), r"(?i)\.md$", ""), "[_-]+", " ")
    return F.coalesce(filled(title), filled(scalar(document, "title")), filled(heading), named)


def space_name(local_path: Column) -> Column:
    """The last part of a path on either kind of system."""
    name = F.trim(F.regexp_extract(F.regexp_replace(local_path, r"[\\/]+$", ""), r"([^\\/]*)$", 1))
    return F.when(name == "", "Local Space").otherwise(name)


def space_slug(local_path: Column) -> Column:
    """a-z, digits and hyphens; a letter's mark counts as a break, as in its decomposed form."""
    broken = F.regexp_replace(F.lower(space_name(local_path)), f"([{text._ACCENTED}])", "$1-")
    made = F.regexp_replace(F.regexp_replace(text.folded(broken), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "local-space").otherwise(made)


def legacy_space_name(slug: Column) -> Column:
    return F.when(slug.startswith("personal-"), "My Space").when(slug.startswith("general-"), "General").otherwise(F.translate(slug, "-_", "  "))


_UUID = r"^(?:urn:uuid:)?\{?[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}\}?$"


def portable_link_error(server: Column, space_id: Column, git_url: Column, user_ref: Column) -> Column:
    """What is wrong with a portable cloud link, the first of its checks that fails; null if nothing is."""
    part = lambda u, n: F.try_parse_url(u, F.lit(n))
    web = lambda u: F.lower(part(u, "PROTOCOL")).isin("http", "https") & (part(u, "HOST") != "") & part(u, "USERINFO").isNull()
    root = F.coalesce(part(server, "PATH"), F.lit("")).isin("", "/") & part(server, "QUERY").isNull() & part(server, "REF").isNull()
    ok = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~ok(web(server) & root), "server")
        .when(~ok(space_id.rlike(_UUID)), "space_id")
        .when(~ok(web(git_url)), "git_url")
        .when(~ok(user_ref.startswith("user/") & F.substr(user_ref, F.lit(6)).rlike(_UUID)), "user_ref")
    )


def sync_label(desktop: Column, status_known: Column, state: Column, local_changes: Column) -> Column:
    """A struct of kind, label and attention of a Space's link, by the first rule that holds."""
    s = lambda kind, label, attention: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(attention).alias("attention"))
    return (
        F.when(~desktop, s("cloud", "Cloud", False))
        .when(~status_known, s("local", "Local · Checking link", False))
        .when(state == "unavailable", s("local", "Local · Link unavailable", True))
        .when(state.isNull() | state.isin("", "unlinked"), s("local", "Local only", False))
        .when(local_changes | (state == "dirty"), s("linked", "Local + Cloud · Not uploaded", True))
        .when(state == "submitted", s("linked", "Local + Cloud · In review", False))
        .when(state == "needsSync", s("linked", "Local + Cloud · Cloud update", True))
        .when(state.isin("conflicted", "leaseRejected"), s("linked", "Local + Cloud · Attention", True))
        .otherwise(s("linked", "Local + Cloud · Synced", False))
    )


def is_binary(content: Column) -> Column:
    """Whether bytes hold a NUL or are no UTF-8; false for null."""
    text_ = content.cast("string")
    return F.coalesce((F.instr(F.hex(content), "00") > 0) & F.exists(F.regexp_extract_all(F.hex(content), F.lit("(..)"), F.lit(1)), lambda x: x == "00") | ~F.is_valid_utf8(text_), F.lit(False))


def checkpoint_name(now: Column) -> Column:
    return F.concat(F.lit("Checkpoint "), F.date_format(now, "yyyy-MM-dd HH:mm"))


def draft_label(changed: Column, has_checkpoint: Column) -> Column:
    n = changed.cast("string")
    since = F.when(changed == 0, "No changes since the latest checkpoint").when(changed == 1, "1 saved file changed since the latest checkpoint").otherwise(F.concat(n, F.lit(" saved files changed since the latest checkpoint")))
    draft = F.when(changed == 0, "No saved changes in the current draft").when(changed == 1, "1 saved file in the current draft").otherwise(F.concat(n, F.lit(" saved files in the current draft")))
    return F.when(has_checkpoint, since).otherwise(draft)


def broken_link_summary(count: Column) -> Column:
    return F.when(count == 0, "No broken links").when(count == 1, "1 broken link").otherwise(F.concat(count.cast("string"), F.lit(" broken links")))


def can_push(role: Column) -> Column:
    return role.isin("owner", "manager", "editor")


def can_merge(role: Column) -> Column:
    """Also who manages members."""
    return role.isin("owner", "manager")


def can_manage(actor: Column, target: Column) -> Column:
    return F.when(actor == "owner", target != "owner").when(actor == "manager", target.isin("editor", "viewer")).otherwise(False)


def page_slug_ok(slug: Column) -> Column:
    """A visible Markdown path of 1024 bytes at most."""
    parts = F.split(slug, "/")
    ok = (F.octet_length(slug) <= 1024) & slug.endswith(".md") & ~slug.contains("\\") & ~F.exists(parts, lambda c: (c == "") | c.startswith("."))
    return F.coalesce(ok, F.lit(False))
