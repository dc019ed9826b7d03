"""Titles, front matter, tokens and other text functions as columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks which are dropped wherever they stand.
_MARKS = "".join(map(chr, range(0x300, 0x332)))


# A letter which keeps its marks, and the long s, with and without its dot, which is an s.
_WHOLE, _LONG_S = "ǡ", "ſẛ"
_LATIN = frozenset("abcdefghijklmnopqrstuvwxyz")


def _letters() -> tuple[str, str]:
    """Letters which decompose into a Latin one and combining marks, and those Latin ones; from the Unicode tables."""
    whole, base = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if plain != c and plain in _LATIN and c == c.lower() and c not in _WHOLE:
            whole.append(c)
            base.append(plain)
    return "".join(whole) + _LONG_S, "".join(base) + "ss"


_ACCENTED, _PLAIN = _letters()
_FOLD = str.maketrans(_ACCENTED, _PLAIN, _MARKS)


def folded(text: Column) -> Column:
    """Lower case without diacritics: whole letters lose theirs, combining marks are dropped."""
    return F.translate(F.lower(text), _ACCENTED + _MARKS, _PLAIN)


def fold(text: str) -> str:
    """The same for a query."""
    return text.lower().translate(_FOLD)


_SPLIT = {**_FOLD, ord("_"): " "}
_WORD = re.compile("[\\w\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd]+").findall


def tokens_of(text: str | None) -> list[str]:
    """The tokens of one text in Python, for where a task counts them itself: the same as :func:`tokens`."""
    return _WORD(text.lower().translate(_SPLIT)) if text else []


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def front_matter(text: Column) -> Column:
    """The block between the opening and the closing line of three hyphens; empty without one."""
    return F.regexp_extract(text, r"(?s)^---\r?\n(.*?)(?:^|(?<=\n))---(?:\r?\n|$)", 1)


def content(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\r?\n.*?(?<=\n)---(?:\r?\n|$)", "")


def field(text: Column, key: str) -> Column:
    """A flat field of the front matter without its quotes; empty if it is absent."""
    raw = F.regexp_extract(front_matter(text), rf"(?m)^{key}:[ \t]*(.*)$", 1)
    return F.regexp_replace(F.trim(raw), r"""^["']|["']$""", "")


def index_title(text: Column) -> Column:
    """The first ``title:`` of the front matter, else the first line which, trimmed, starts with ``# ``."""
    headings = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("# "))
    heading = F.trim(F.substr(F.try_element_at(headings, F.lit(1)), F.lit(3)))
    named = field(text, "title")
    return F.when(named != "", named).otherwise(heading)


def first_content_line(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & (x != "---") & ~x.startswith("title:"))
    return F.trim(F.regexp_replace(F.try_element_at(kept, F.lit(1)), "^#+", ""))


def slug_strict(text: Column) -> Column:
    """Keep a-z, digits, blanks and hyphens; blanks become hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 -]", ""), " +", "-")


def slug_collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def quoted(text: Column) -> Column:
    """A YAML double-quoted string."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def excerpt(text: Column, n: int = 140) -> Column:
    """Lines without list, heading and quote marks, joined; an ellipsis beyond ``n`` characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*+>]|#+|\d+\.)\s+", "")))
    joined = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return F.when(F.length(joined) > n, F.concat(F.left(joined, F.lit(n)), F.lit("…"))).otherwise(joined)


def initials(name: Column) -> Column:
    words = F.filter(F.split(name, r"[\s#_-]+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.left(w, F.lit(1))), ""))


def without_control(text: Column) -> Column:
    """Terminal control sequences removed."""
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")
