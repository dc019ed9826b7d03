"""Small fixtures for the corpus operators: files, links, search, versions, formats and streams."""

import io
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import commonmark, metadata, paths, text
from quillspark.operators import graph, linediff, search, versions
from quillspark.sources import files, formats
from quillspark.streaming import reconcile


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("space")
    bodies = {
        "wiki/overview.md": "---\ntitle: Network overview\n---\nThe network is optional here, local-first.\n",
        "wiki/body.md": "# Other\nThe orchid grows. [one](../wiki/overview.md#x) and [[wiki/title|label]]\n",
        "wiki/title.md": "# Orchid\nSome text. `[[wiki/decoy]]`\n```\n[[wiki/fenced]]\n```\n![i](image.md)\n",
        "wiki/links.md": "[up](../root.md) [enc](a%20b.md) [gone](gone.md) [web](https://x.org/a.md) [m](mailto:a@b) [a](#top) [dir](../wiki)\n",
        "_under.md": "[[Note: x]] [out](../../etc.md)\n",
        "root.md": "# Root\n[case](wiki/Title.md)\n",
        "wiki/a b.md": "# Blank\n",
        ".private/secret.md": "network optional\n",
        "index.md": "# Index\n",
    }
    for name, body in bodies.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(body)
    (root / "bad.md").write_bytes(b"\xff\xfe\xfd")
    os.symlink(root / "root.md", root / "link.md")
    return files.walk(spark, str(root), "s").cache()


def test_walk_and_visibility(space):
    listed = {r["path"] for r in space.collect()}
    assert {"_under.md", ".private/secret.md", "link.md", "wiki"} <= listed
    seen = {r["path"]: r["title"] for r in files.pages(space).collect()}
    assert ".private/secret.md" not in seen and "bad.md" not in seen and "link.md" not in seen
    assert seen["wiki/overview.md"] == "Network overview" and seen["wiki/title.md"] == "Orchid"


def test_listing_and_spaces(spark, tmp_path):
    for d in ("a-b/repo/.git", "personal-x/repo/.git", "general-1/repo/.git/deep/er", "no/other/.git", "deep/x/repo/.git", "e_f/repo"):
        os.makedirs(tmp_path / d)
    (tmp_path / "e_f/repo/.git").write_text("gitdir: elsewhere")
    os.symlink(tmp_path / "a-b", tmp_path / "link")
    got = {r["path"]: (r["is_dir"], r["is_symlink"]) for r in files.listing(spark, str(tmp_path)).collect()}
    assert got["link"] == (False, True) and not any(p.startswith("link/") for p in got) and got["general-1/repo/.git/deep/er"] == (True, False)
    assert set(got) == {os.path.relpath(os.path.join(t, n), tmp_path) for t, d, f in os.walk(tmp_path) for n in d + f}
    found = files.spaces(spark, str(tmp_path))
    assert {(r["slug"], r["name"]) for r in found.collect()} == {("a-b", "a b"), ("personal-x", "My Space"), ("general-1", "General"), ("e_f", "e f")}
    assert files.spaces(spark, str(tmp_path), found.filter("slug <> 'a-b'")).first()["slug"] == "a-b"
    assert files.listing(spark, str(tmp_path / "no/other/.git")).count() == 0


def test_search(space):
    pages = files.pages(space)
    hit = search.search(pages, "network optional").collect()
    assert [r["path"] for r in hit] == ["wiki/overview.md"] and not hit[0]["title_match"]
    assert [r["path"] for r in search.search(pages, "orchid").collect()] == ["wiki/title.md", "wiki/body.md"]
    assert search.search(pages, '"local-first"').count() == 1 and search.search(pages, "first-local").count() == 0
    for nothing in ("", "---", "orchid ---", "orch"):
        assert search.search(pages, nothing).count() == 0
    assert search.search(pages, "orchid", limit=0).count() == 0


def test_scores_equal_fts5(space):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(path unindexed, title, body, tokenize = 'unicode61 remove_diacritics 2')")
    pages = files.pages(space)
    db.executemany("insert into f values (?, ?, ?)", [(r["path"], r["title"], r["body"]) for r in pages.collect()])
    for q, match in (("orchid", '"orchid"'), ("the", '"the"'), ("local-first", '"local-first"')):
        want = dict(db.execute("select path, bm25(f, 0.0, 8.0, 1.0) from f where f match ?", (match,)))
        got = {r["path"]: r["score"] for r in search.search(pages, q, 100).collect()}
        want = {p: s for p, s in want.items() if p not in ("index.md", "log.md")}
        assert got.keys() == want.keys()
        assert all(got[p] == pytest.approx(want[p], rel=1e-6) for p in got)


def test_link_graph(space):
    pages = files.pages(space)
    edges = graph.edges(pages)
    found = {(r["source_path"], r["target"]) for r in edges.collect()}
    assert ("wiki/body.md", "wiki/overview.md") in found and ("wiki/body.md", "wiki/title.md") in found
    assert ("wiki/links.md", "wiki/a b.md") in found and ("wiki/links.md", "root.md") in found
    assert not any(t in ("wiki/decoy.md", "wiki/fenced.md", "wiki/image.md") for _, t in found)
    assert not any(s == "_under.md" for s, _ in found)
    broken = {(r["source_path"], r["target"]) for r in graph.broken_links(pages, edges).collect()}
    assert broken == {("wiki/links.md", "wiki/gone.md"), ("root.md", "wiki/Title.md")}


def test_path_and_text_columns(spark):
    df = spark.createDataFrame([("a/../b/./c.md",), ("../x",), (".kb/sources/n.md",), (".kb/sources/.x/n.md",)], "p string")
    p = F.col("p")
    got = df.select(paths.fold(p).alias("f"), paths.is_hidden(p).alias("h"), paths.stored_source_name(F.lit("index.md")).alias("s")).collect()
    assert [r["f"] for r in got][:2] == ["b/c.md", None]
    assert [r["h"] for r in got] == [True, True, False, True]  # '..' begins with a dot
    assert got[0]["s"].startswith("_encoded/") and len(got[0]["s"]) == len("_encoded/.md") + 64
    one = spark.createDataFrame([("---\ntitle: \"A\"\nk: v\n---\n# B 10\n",), ("no\n  # Late 0\n",), ("---\ntitle: x\n",)], "t string")
    t = F.col("t")
    rows = one.select(text.index_title(t).alias("i"), text.content(t).alias("c"), text.field(t, "k").alias("k")).collect()
    assert [r["i"] for r in rows] == ["A", "Late 0", None] and rows[0]["c"] == "# B 10\n" and rows[0]["k"] == "v"
    w = spark.createDataFrame([("[[a|b]] [[c]] [[x\ny]]",)], "t string").select(commonmark.link_targets(F.col("t")).alias("w")).first()["w"]
    assert w["wiki"] == ["a", "c"]


def test_versions(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, body string")
    base = f([("a", "1\n2\n3\n"), ("b", "x"), ("c", "y"), ("d", "z")])
    draft = f([("a", "1\n2\n3\n4\n"), ("b", "x"), ("c", "y1"), ("e", "n")])
    agent = f([("a", "0\n1\n2\n3\n"), ("b", "x"), ("c", "y1"), ("d", "z")])
    state = {r["path"]: r["state"] for r in versions.merge_states(base, draft, agent).collect()}
    assert state == {"a": "conflict", "b": "unchanged", "c": "same", "d": "keep_draft", "e": "keep_draft"}
    diffs = {r["path"]: r for r in versions.file_diffs(base, draft).collect()}
    assert (diffs["a"]["additions"], diffs["a"]["deletions"], diffs["d"]["status"]) == (1, 0, "deleted")
    texts = [(1, "1\n2\n3\n", "1\n2\n3\n4\n", "0\n1\n2\n3\n"), (2, "1\n", "2\n", "3\n"), (3, "1\n2\n", "1\n2\nx\n", "1\n2\n")]
    made = linediff.merged(spark.createDataFrame(texts, "key int, base string, draft string, agent string"))
    assert {r["key"]: r["body"] for r in made.collect()} == {1: "0\n1\n2\n3\n4\n", 2: None, 3: "1\n2\nx\n"}


@pytest.mark.parametrize(("old", "new"), [("", "a\nb"), ("a\nb\nc", "b\nc\nd"), ("x\n" * 5, "x\n" * 3), ("a", "")])
def test_line_diff_gives_both_sides(spark, old, new):
    one = lambda body: spark.createDataFrame([("p", body)], "path string, body string")
    lines = versions.file_diffs(one(old), one(new)).first()["lines"]
    assert [x["text"] for x in lines if x["kind"] != "add"] == old.splitlines()
    assert [x["text"] for x in lines if x["kind"] != "del"] == new.splitlines()


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def test_formats(spark):
    slide = "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:t>Slide %d</a:t></a:p></p:sld>"
    sheet = "<worksheet><sheetData><row><c t='inlineStr'><is><t>A|b</t></is></c><c><v>1</v></c></row><row><c t='inlineStr'><is><t>x\ny</t></is></c><c><v>2</v></c></row></sheetData></worksheet>"
    docx = "<w:document xmlns:w='w'><w:body><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>"
    rows = [
        ("a.txt", "txt", b"hello"), ("b.doc", "doc", b"x"), ("c.txt", "txt", b"\xff"), ("d.txt", "txt", b" "), ("e.md", "md", None),
        ("p.pptx", "pptx", _zip({"ppt/slides/slide10.xml": slide % 10, "ppt/slides/slide2.xml": slide % 2})),
        ("s.xlsx", "xlsx", _zip({"xl/workbook.xml": "<workbook><sheets><sheet name='S'/></sheets></workbook>", "xl/worksheets/sheet1.xml": sheet})),
        ("w.docx", "docx", _zip({"word/document.xml": docx})), ("o.odt", "odt", _zip({"content.xml": "<c xmlns:t='t'><t:p>one</t:p><t:p> two </t:p></c>"})),
    ]
    out = {r["name"]: r for r in formats.extracted(spark.createDataFrame(rows, "name string, extension string, content binary")).collect()}
    assert out["a.txt"]["text"] == "hello" and all(out[n]["error"] for n in ("b.doc", "c.txt", "d.txt", "e.md"))
    assert out["p.pptx"]["text"].index("Slide 2") < out["p.pptx"]["text"].index("Slide 10")
    assert "| A\\|b | 1 |" in out["s.xlsx"]["text"] and "x<br>y" in out["s.xlsx"]["text"]
    assert out["w.docx"]["text"] == "## Top\n\ntext" and out["o.odt"]["text"] == "one\n\ntwo"
    title, body = formats.html_snapshot("<title>T</title><nav>no</nav><main><h1>H</h1><p>a <a href='b.html'>l</a></p><script>x</script></main><p>out</p>")
    assert title == "T" and body.startswith("# H") and "[l](b.html)" in body and "no" not in body.split() and "x" not in body.split()


def test_stream_keeps_newest(spark, tmp_path):
    schema = "space_id string, path string, body string, modified_ns long"
    for k, rows in enumerate(([("s", "a", "1", 1), ("s", "b", "1", 1)], [("s", "a", "2", 5)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = reconcile.keep_index(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "ck"))
        q.awaitTermination()
    now = reconcile.newest(spark.read.parquet(str(tmp_path / "index")))
    assert {(r["path"], r["body"]) for r in now.collect()} == {("a", "2"), ("b", "1")}


def test_tools(space):
    from quillspark.api import Corpus

    c = Corpus(files.pages(space))
    assert c.context().first()["n_pages"] == c.pages.count()
    assert c.page("wiki/overview.md").first()["content"].startswith("The network")
    assert [r["source_path"] for r in c.backlinks("wiki/overview").collect()] == ["wiki/body.md"]
    assert [r["target"] for r in c.broken_links("s").collect()] == ["wiki/Title.md", "wiki/gone.md"]
    with pytest.raises(ValueError, match="limit"):
        c.search_pages("x", 101)


def test_tools_on_a_stored_index(spark, space, tmp_path):
    from quillspark.api import Corpus
    from quillspark.operators.index import SearchIndex

    pages = files.pages(space)
    stored = SearchIndex(spark, str(tmp_path / "index"))
    stored.rebuild(pages)
    one, two = Corpus(pages), Corpus(index=stored)
    for tool in (lambda c: c.context(), lambda c: c.search_pages("network"), lambda c: c.page("wiki/overview.md"), lambda c: c.backlinks("wiki/overview"), lambda c: c.broken_links("s")):
        a, b = tool(one), tool(two)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError, match="needed"):
        Corpus()


def test_conformance(spark):
    from quillspark.functions import conformance

    logs = [
        "# Log\n\n## 2026-02-03\n- a\n  more\n\n## 2026-01-31\n* b\n", "# Log\n## 2026-01-01\n- a\n## 2026-01-02\n- b\n", "# Log\n## 2026-02-30\n- a\n",
        "# Log\n## 2026-02-03\n## 2026-02-01\n- a\n", "# Log\n- a\n## 2026-02-03\n- b\n", "no\n## 2026-02-03\n- b\n", "# Log\n## 2026-02-03\n- a\ntext\n", "# Log\n## 2026-02-03\n",
    ]
    df = spark.createDataFrame(list(enumerate(logs)), "k int, b string")
    assert [r["ok"] for r in df.select("k", conformance.log(F.col("b")).alias("ok")).orderBy("k").collect()] == [True] + [False] * 7
    pages = spark.createDataFrame([("---\ntype: Note\n---\nx",), ("---\ntype: Note\nkind: concept\n---\n",), ("x",), ("---\ntype: ''\n---\n",)], "b string")
    assert [r["ok"] for r in pages.select(conformance.concept(F.col("b")).alias("ok")).collect()] == [True, False, False, False]
    idx = spark.createDataFrame([("# I\n",), ("---\nformat: 1\n---\n# I\n",), ("---\na: 1\n---\n# I\n",), ("x",)], "b string")
    got = idx.select(conformance.index(F.col("b")).alias("n"), conformance.index(F.col("b"), ("format",)).alias("r")).collect()
    assert [r["n"] for r in got] == [True, False, False, False] and [r["r"] for r in got] == [True, True, False, False]


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("front", "want"),
    [
        ("sources: [a.md, 'b/c.md', a.md]", ["a.md", "b/c.md"]),
        ("sources: sources/a.md", ["a.md"]),
        ("sources:\n  - .kb/sources/a.md\n  - x.txt\n  - b.md\ntype: Note\n  - no.md", ["a.md", "b.md"]),
        ("sources: [../a.md, .hidden.md, b//c.md, A.MD]", ["A.MD"]),
        ("type: Note", []),
    ],
)
def test_sources(spark, front, want):
    assert _one(spark, f"---\n{front}\n---\nText", metadata.sources) == [f".kb/sources/{x}" for x in want]


def test_sources_without_front_matter(spark):
    for document in (None, "", "sources: [a.md]", "---\nsources: [a.md]\n"):
        assert _one(spark, document, metadata.sources) == []


def test_source_address(spark):
    for url, ok in (("https://x.org/a?b=c", True), ("http://x.org", True), ("ftp://x.org/a", False), ("https://me:pw@x.org/", False), ("no url", False)):
        assert _one(spark, f'---\nsource_url: "{url}"\n---\n', metadata.source_address) == (url if ok else None)
    assert _one(spark, None, metadata.source_address) is None


def test_normalised_concept(spark):
    made = lambda x: _one(spark, x, lambda c: metadata.normalised_concept(c, F.lit('A "b"'), F.lit("Note")))
    fine = "---\ntype: Source\nother: 1\n---\nText"
    assert made(fine) == fine and made(None) is None
    assert made("Text\n") == '---\ntype: Note\ntitle: "A \\"b\\""\n---\n\nText\n'
    assert made("") == '---\ntype: Note\ntitle: "A \\"b\\""\n---\n\n'
    old = "---\nkind: concept\ntitle: T\nsummary: short\ntags:\n  - a\n---\n\n\nText"
    assert made(old) == "---\ntitle: T\nsummary: short\ntags:\n  - a\ntype: Note\ndescription: short\n---\n\nText"
    assert made(made(old)) == made(old)


def test_anchor_remap(spark):
    snapshots = spark.createDataFrame([("p", "h1", "a\nb\nc"), ("p", "h1", "a\nb\nc"), ("p", "h2", "x\na\nc"), ("q", "h1", "a")], "page_slug string, content_hash string, source string")
    pages = spark.createDataFrame([("p", "x\na\nc")], "page_slug string, body string")
    rows = [(1, "p", "h1", 1, 1), (2, "p", "h1", 2, 2), (3, "p", "h1", 3, 3), (4, "p", "h1", 1, 3), (5, "p", "h2", 2, 3), (6, "q", "h1", 1, 1), (7, "p", "gone", 1, 1), (8, "p", "h2", 3, 9), (9, "p", "h1", None, None)]
    comments = spark.createDataFrame(rows, "id int, page_slug string, content_hash string, start_line int, end_line int")
    got = {r["id"]: (r["state"], r["start_line"], r["end_line"]) for r in versions.remap_anchors(comments, snapshots, pages).collect()}
    gone = ("outdated", None, None)
    assert got == {1: ("anchored", 2, 2), 2: gone, 3: ("anchored", 3, 3), 4: gone, 5: ("anchored", 2, 3), 6: gone, 7: gone, 8: gone, 9: gone}
    assert versions.remap_anchors(comments.limit(0), snapshots.limit(0), pages.limit(0)).count() == 0


def test_snippets_equal_fts5(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body)")
    words = [f"w{i}" for i in range(60)]
    for n, hits in ((10, [3]), (60, [5]), (60, [30]), (60, [58]), (60, [30, 40])):
        body = " ".join("Hit" if i in hits else w for i, w in enumerate(words[:n]))
        db.execute("delete from f")
        db.execute("insert into f values (?)", (body,))
        (want,) = db.execute("select snippet(f, 0, '', '', ' … ', 24) from f where f match 'hit'").fetchone()
        assert _one(spark, body, lambda c: search.snippet(c, ["hit"])) == want
    assert _one(spark, "", lambda c: search.snippet(c, ["hit"])) == ""
    assert _one(spark, None, lambda c: search.snippet(c, ["hit"])) is None


def test_a_snippet_takes_time_in_proportion_to_the_text(spark):
    import time

    rows = spark.createDataFrame([("hit word " * 20000,)], "body string")
    begin = time.monotonic()
    got = rows.select(search.snippet(F.col("body"), ["hit"])).first()[0]
    assert got.startswith("hit word hit") and got.endswith(" … ")
    assert time.monotonic() - begin < 60  # not with the text cut anew for each of 20,000 hits
