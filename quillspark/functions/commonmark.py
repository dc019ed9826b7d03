"""Links of Markdown documents outside of code: a small scanner for each row, behind an Arrow UDF.

Blocks first, line by line: block quotes, lists, fenced and indented code, HTML
blocks and reference definitions. What is left are stretches of inline text,
each read once: code spans, HTML tags and autolinks go before brackets, and
open brackets wait on a stack. It covers what link extraction needs of
CommonMark, in time in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ITEM = re.compile(r"( {0,3}(?:[-*+]|\d{1,9}[.)])) +")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]: *(<[^<>\n]*>|[^\s<]\S*)")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_SPACE = re.compile(r"\s+")
_QUOTE = re.compile(r" {0,3}> ?")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
#: HTML blocks: how one begins, and what ends it; those without an end go to the next blank line.
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
]
# fixed values: the names of block tags in CommonMark
_BLOCK_TAG = re.compile(
    r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]"
    r"|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
    re.I,
)
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_TAG = re.compile(rf"<(?:[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>")
_LONE_TAG = re.compile(rf" {{0,3}}{_TAG.pattern}\s*$")
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_SPECIAL = re.compile(r"[\\`<\[\]]")
_TARGET = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]")
_OPEN = re.compile(r"(?<!\\)[\[\]]")

Span = tuple[int, int]


def _indent(line: str) -> int:
    n = 0
    for ch in line:
        if ch == " ":
            n += 1
        elif ch == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _html_end(line: str, paragraph: bool) -> re.Pattern | str | None:
    """What ends the HTML block which begins on this line: a pattern, '' for a blank line, or None if none begins."""
    if not line.lstrip(" ").startswith("<"):
        return None
    for start, end in _HTML:
        if start.match(line):
            return end
    if _BLOCK_TAG.match(line) or (not paragraph and _LONE_TAG.match(line)):
        return ""
    return None


def _blocks(body: str) -> tuple[list[Span], dict[str, str], list[Span]]:
    """Spans of code blocks, reference definitions by label, and the stretches of inline text."""
    code: list[Span] = []
    definitions: dict[str, str] = {}
    inline: list[Span] = []
    fence, html, at, list_at, blank, paragraph, depth = "", None, 0, 0, True, False, 0

    def text_line(start: int, end: int, goes_on: bool) -> None:
        if goes_on and inline and inline[-1][1] == start:
            inline[-1] = (inline[-1][0], end)
        else:
            inline.append((start, end))

    for line in body.splitlines(keepends=True):
        start, end = at, at + len(line)
        at = end
        text = line.rstrip("\r\n")
        quoted = 0
        if ">" in text[:4] or depth:
            while m := _QUOTE.match(text):
                text, quoted = text[m.end() :], quoted + 1
        if quoted != depth and (quoted > depth or not paragraph or not text.strip()):
            # what a quote holds ends with it; only a paragraph may go on without its marks
            fence, html, list_at, blank, paragraph, depth = "", None, 0, True, False, quoted
        indent = _indent(text) if text[:1] in " \t" else 0
        empty = not text.strip()
        if fence:
            code.append((start, end))
            closing = text.strip()
            if indent < 4 + list_at and closing and set(closing) == {fence[0]} and len(closing) >= len(fence):
                fence, paragraph = "", False
            continue
        if html is not None:
            if (html == "" and empty) or (html != "" and html.search(text)):
                html, paragraph = None, False
                blank = empty
            continue
        if empty:
            blank, paragraph = True, False
            continue
        item = _ITEM.match(text[list_at:] if indent >= list_at else text)
        if not item and blank and indent < list_at:
            list_at = 0
        inner = text[list_at:] if list_at and indent >= list_at else text
        if indent - list_at >= 4 and not paragraph and not (item and list_at):
            code.append((start, end))
        else:
            if item:
                list_at = (list_at if indent >= list_at else 0) + len(item[0])
                inner = inner[len(item[0]) :]
                paragraph = False
            if opened := _FENCE.match(inner):
                fence = opened[1]
                code.append((start, end))
            elif (stop := _html_end(inner, paragraph)) is not None:
                first = inner.lstrip(" ")
                # an end on the line itself counts behind the block's start
                if stop == "" or not stop.search(first, 4 if first.startswith("<!--") else 1):
                    html = stop
                paragraph = False
            elif not paragraph and inner.lstrip(" ").startswith("[") and (d := _DEFINITION.match(inner)):
                definitions.setdefault(_label(d[1]), d[2][1:-1] if d[2].startswith("<") else d[2])
            elif _HEADING.match(inner):
                text_line(start, end, False)
                paragraph = False
            else:
                text_line(start, end, paragraph)
                paragraph = True
        blank = False
    return code, definitions, inline


def _label(text: str) -> str:
    return _SPACE.sub(" ", text.strip()).casefold()


def _inline(body: str, start: int, end: int, definitions: dict[str, str], spans: list[Span], links: list[tuple[int, str]]) -> None:
    """Add the code spans and links (place of the bracket, target) of one stretch of text."""
    s = body[start:end]
    runs: dict[int, list[int]] = {}
    if "`" in s:
        for m in re.finditer("`+", s):
            runs.setdefault(len(m[0]), []).append(m.start())
    stack: list[tuple[int, bool]] = []
    dead, at, no_comment = 0, 0, False
    while m := _SPECIAL.search(s, at):
        i, ch = m.start(), m[0]
        at = i + 1
        if ch == "\\":
            at = i + 2
        elif ch == "`":
            n = 1
            while s[i + n : i + n + 1] == "`":
                n += 1
            later = runs[n] if n in runs else []
            k = bisect_right(later, i)
            at = i + n
            if k < len(later):
                at = later[k] + n
                spans.append((start + i, start + at))
        elif ch == "<":
            if s.startswith("<!--", i):
                close = -1 if no_comment else s.find("-->", i + 4)
                no_comment = close < 0
                at = close + 3 if close >= 0 else i + 1
            elif t := (_AUTOLINK.match(s, i) or _TAG.match(s, i)):
                at = t.end()
        elif ch == "[":
            stack.append((i, i > 0 and s[i - 1] == "!" and not (i > 1 and s[i - 2] == "\\")))
        elif stack:
            opened, image = stack.pop()
            usable = image or len(stack) >= dead
            dead = min(dead, len(stack))
            if not usable:
                continue
            target, stop = None, i + 1
            if s[i + 1 : i + 2] == "(" and (t := _TARGET.match(s, i + 1)):
                target, stop = _ESCAPED.sub(r"\1", t[1] if t[1] is not None else t[2]), t.end()
            elif definitions:
                named = _LABEL.match(s, i + 1)
                whole = named[1] if named and named[1].strip() else s[opened + 1 : i] if i - opened < 1000 else ""
                if whole.strip() and not _OPEN.search(whole) or named and named[1].strip():
                    target = definitions.get(_label(whole))
                if target is None and named and named[1].strip():
                    named = None
                stop = named.end() if named and target is not None else i + 1
            if target is not None:
                at = stop
                if not image:
                    links.append((start + opened, target))
                    dead = len(stack)


def scan(body: str | None) -> tuple[list[str], list[str]]:
    """Raw targets of ``[[target|label]]`` and of Markdown links (images excluded), each in order.

    Wikilinks stand on one line and touch no code. A Markdown link which
    begins in a wikilink is none. Null and empty documents have none.
    """
    if not body or "[" not in body:
        return [], []
    code, definitions, inline = _blocks(body)
    found: list[tuple[int, str]] = []
    for a, b in inline:
        _inline(body, a, b, definitions, code, found)
    code.sort()
    stops = [y for _, y in code]
    wiki, taken, at = [], [], 0
    while (a := body.find("[[", at)) >= 0 and (b := body.find("]]", a + 2)) >= 0:
        at = b + 2
        k = bisect_right(stops, a)
        if "\n" not in body[a:b] and not (k < len(code) and code[k][0] < at):
            wiki.append(body[a + 2 : b].split("|")[0].strip())
            taken.append((a, at))
    starts = [x for x, _ in taken]
    links = []
    for place, target in sorted(found):
        k = bisect_right(starts, place) - 1
        if k < 0 or taken[k][1] <= place:
            links.append(target)
    return wiki, links


def link_targets(body: Column) -> Column:
    """A struct of the raw wikilink and Markdown link targets of a document."""

    @F.pandas_udf("wiki array<string>, plain array<string>")
    def scanned(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(b) for b in bodies], columns=["wiki", "plain"])

    return scanned(body)
