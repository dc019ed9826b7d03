"""Text of office and web files by pandas UDF, one row in, text or an error out."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions by reader, and size limits in bytes.
TEXT = ("md", "markdown", "txt", "csv", "json", "yaml", "yml", "toml", "xml", "html", "htm")
ARCHIVE = ("docx", "xlsx", "pptx", "ods", "odt", "odp")
FILE_LIMIT, ENTRY_LIMIT, TOTAL_LIMIT, ENTRIES, TEXT_LIMIT = 128 << 20, 64 << 20, 256 << 20, 20_000, 32 << 20


def reader(extension: Column) -> Column:
    """text, archive or null (unsupported: no library reads it here)."""
    e = F.lower(extension)
    return F.when(e.isin(*TEXT), "text").when(e.isin(*ARCHIVE), "archive")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _entries(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    sizes = [i.file_size for i in z.infolist()]
    if len(sizes) > ENTRIES or max(sizes, default=0) > ENTRY_LIMIT or sum(sizes) > TOTAL_LIMIT:
        raise ValueError("archive is too large")
    return z


def _paragraphs(xml: bytes, ends: tuple[str, ...]) -> list[str]:
    out, held = [], []
    for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
        if event == "start" and e.text:
            held.append(e.text)
        elif event == "end":
            if _local(e.tag) in ends:
                out.append("".join(held).strip())
                held = []
            if e.tail:
                held.append(e.tail)
    return [p for p in [*out, "".join(held).strip()] if p]


def _docx(z: zipfile.ZipFile) -> str:
    root, blocks = ElementTree.fromstring(z.read("word/document.xml")), []
    body = next((e for e in root.iter() if _local(e.tag) == "body"), root)
    text = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t").strip()
    for e in body:
        if _local(e.tag) == "tbl":
            rows = [[text(c) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            blocks += [" | ".join(r) for r in rows]
        elif _local(e.tag) == "p" and (t := text(e)):
            style = next((v for s in e.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"Heading(\d+)", style)
            numbered = any(_local(s.tag) == "numPr" for s in e.iter())
            blocks.append("#" * min(6, max(1, int(level[1]))) + f" {t}" if level else f"- {t}" if numbered else t)
    return "\n\n".join(blocks)


def _pptx(z: zipfile.ZipFile) -> str:
    slides = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return "\n\n".join(f"## Slide {k}\n\n" + "\n".join(_paragraphs(z.read(n), ("p",))) for k, n in slides)


def _cell(value: str) -> str:
    return value.replace("\n", "<br>").replace("|", "\\|")


def _markdown_table(name: str, rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    lines = ["| " + " | ".join(_cell(c) for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([f"## {name}", "", lines[0], "|" + " --- |" * width, *lines[1:]])


def _xlsx(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    text = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    shared = [text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [s.attrib["name"] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    out = []
    for k, title in enumerate(titles, 1):
        rows = []
        for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter():
            if _local(r.tag) == "row":
                cells = []
                for c in (c for c in r if _local(c.tag) == "c"):
                    v = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" else text(c) if c.attrib.get("t") == "inlineStr" else v)
                rows.append(cells)
        if any(any(r) for r in rows):
            out.append(_markdown_table(title, rows))
    return "\n\n".join(out)


def _ods(z: zipfile.ZipFile) -> str:
    out = []
    for t in ElementTree.fromstring(z.read("content.xml")).iter():
        if _local(t.tag) == "table":
            name = next((v for k, v in t.attrib.items() if _local(k) == "name"), "Sheet")
            rows = [["\n".join("".join(p.itertext()) for p in c) for c in r if _local(c.tag) == "table-cell"] for r in t.iter() if _local(r.tag) == "table-row"]
            if any(any(r) for r in rows):
                out.append(_markdown_table(name, rows))
    return "\n\n".join(out)


def text_of(extension: str, data: bytes | None) -> str:
    """The text of one file; raises what the outcome row reports."""
    if data is None or len(data) > FILE_LIMIT:
        raise ValueError("file is missing or too large")
    e = (extension or "").lower()
    if e in TEXT:
        out = data.decode("utf-8")
    elif e in ARCHIVE:
        z = _entries(data)
        if e in ("odt", "odp"):
            out = "\n\n".join(_paragraphs(z.read("content.xml"), ("p", "h")))
        else:
            out = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "ods": _ods}[e](z)
    else:
        raise ValueError(f"unsupported format: {e}")
    if not out.strip() or len(out.encode()) > TEXT_LIMIT:
        raise ValueError("text is empty or too large")
    return out


def extracted(files: DataFrame) -> DataFrame:
    """Adds text and error to (extension, content); a failed row never fails the batch."""

    @F.pandas_udf("text string, error string")
    def run(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for e, c in zip(extension, content, strict=True):
            try:
                out.append((text_of(e, c), None))
            except Exception as problem:  # noqa: BLE001  the row reports it
                out.append((None, str(problem)))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("x", run("extension", "content")).select("*", "x.text", "x.error").drop("x")


# Limits of a page in bytes, of its Markdown, and of its nodes.
PAGE_LIMIT, MARKDOWN_LIMIT, NODE_LIMIT = 5 << 20, 2 << 20, 200_000
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}


class _Snapshot(HTMLParser):
    """Markdown of a page's main parts, or of all of it if it has none."""

    SKIP = ("script", "style", "nav", "header", "footer", "aside", "noscript", "template", "svg", "iframe")

    def __init__(self, main: bool, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.nodes = base, 0
        self.main = main
        self.open: list[tuple[str, bool]] = []  # open elements, and whether each is a main part
        self.depth = self.skip = self.pre = 0
        self.out: list[str] = []
        self.title: list[str] = []
        self.heading: list[str] | None = None
        self.in_title = False
        self.hrefs: list[tuple[str, int]] = []
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.quote = 0

    def _count(self):
        self.nodes += 1
        if self.nodes > NODE_LIMIT:
            raise ValueError("page has too many nodes")

    def _url(self, address: str | None) -> str:
        try:
            return urljoin(self.base, (address or "").strip())
        except ValueError:
            return (address or "").strip()

    def handle_starttag(self, tag, attrs):
        self._count()
        a = dict(attrs)
        if tag == "base" and a.get("href"):
            self.base = self._url(a["href"])
        if tag not in _VOID:
            is_main = tag in ("article", "main") or a.get("role") == "main"
            self.open.append((tag, is_main))
            self.depth += is_main
        if tag == "title" and not self.title:
            self.in_title = True
        elif tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "main", "figure", "dl"):
            self._put("\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._put("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self._put("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "blockquote":
            self.quote += 1
            self._put("\n\n> ")
        elif tag == "br":
            self._put("\n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag == "pre":
            self.pre += 1
            self._put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag in _MARKS and not self.pre:
            self._put(_MARKS[tag])
        elif tag == "a":
            self.hrefs.append((self._url(a.get("href")) if a.get("href") else "", len(self.out)))
            self._put("[" if a.get("href") else "")
        elif tag == "img" and a.get("src"):
            self._put(f"![{a.get('alt') or ''}]({self._url(a['src'])})")
        elif tag == "table":
            self._put("\n\n")
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _VOID or not any(t == tag for t, _ in self.open):
            return
        while self.open:
            last, is_main = self.open.pop()
            self._close(last)
            self.depth -= is_main
            if last == tag:
                break

    def _close(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.hrefs:
            address, _ = self.hrefs.pop()
            self._put(f"]({address})" if address else "")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self._put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag in _MARKS and not self.pre:
            self._put(_MARKS[tag])
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("" if self.lists else "\n\n")
        elif tag == "blockquote":
            self.quote = max(0, self.quote - 1)
            self._put("\n\n")
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(_cell(re.sub(r"\s+", " ", c).strip()) for c in r + [""] * (width - len(r))) + " |" for r in rows]
                self._put("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")

    def handle_data(self, data):
        self._count()
        if self.in_title:
            self.title.append(data)
        else:
            self._put(data if self.pre else re.sub(r"\s+", " ", data))

    def _put(self, s):
        if not s or self.skip or (self.main and not self.depth):
            return
        if self.rows and self.rows[-1]:
            self.rows[-1][-1] += s
        elif self.rows is None:
            self.out.append(s)


def html_snapshot(html: str | None, url: str | None = None) -> tuple[str, str]:
    """Title and Markdown of a page: its main parts with absolute addresses, without navigation, scripts and the like.

    Null is an empty page. Raises ValueError beyond the limits of bytes and nodes.
    """
    html = html or ""
    if len(html.encode("utf-8", "surrogatepass")) > PAGE_LIMIT:
        raise ValueError("page is too large")
    p = _Snapshot(bool(re.search(r"<(article|main)\b|role=[\"']?main\b", html, re.I)), url or "")
    p.feed(html)
    p.close()
    for tag, _ in reversed(p.open):
        p._close(tag)
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.out))).strip()
    if len(body.encode("utf-8", "surrogatepass")) > MARKDOWN_LIMIT:
        raise ValueError("snapshot is too large")
    return re.sub(r"\s+", " ", "".join(p.title)).strip(), body


def snapshots(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, markdown, error) of HTML pages; without a title the host is taken, beyond the limits there is an error only.

    A page longer than the limit never reaches Python.
    """

    @F.pandas_udf("title string, markdown string, error string")
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        out = []
        for h, u in zip(html, url, strict=True):
            try:
                out.append((*html_snapshot(h, u), None))
            except ValueError as problem:
                out.append((None, None, str(problem)))
        return pd.DataFrame(out, columns=["title", "markdown", "error"])

    large = F.coalesce(F.octet_length("html") > PAGE_LIMIT, F.lit(False))
    x = pages.withColumn("x", run(F.when(~large, F.col("html")), "url"))
    title = F.when(F.col("x.title") != "", F.col("x.title")).otherwise(F.try_parse_url("url", F.lit("HOST")))
    error = F.when(large, "page is too large").otherwise(F.col("x.error"))
    return x.select("page_id", "url", F.when(error.isNull(), title).alias("title"), F.when(error.isNull(), F.col("x.markdown")).alias("markdown"), error.alias("error"))
