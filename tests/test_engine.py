"""Small cases of the index, tree, comments, reviews, changes, bundles, ingest, assets and writes."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.functions import commonmark, display, metadata, text
from quillspark.operators import assets, bundle, changes, comments, graph, index, ingest, ranks, review, search, tree, vector, writes
from quillspark.sources import formats

PAGES = "space_id string, path string, title string, body string, modified_ns long"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_folding_and_odd_queries_equal_fts5(spark):
    rows = [("a.md", "Žena", "čaj a Łódź, naïve café"), ("b.md", "zena", "cafe\u0301s straße"), ("c.md", "C:\\dir", "path C:\\dir 100% a_b"), ("d.md", "ὈΔΟΣ", "ξένος İstanbul ǅ Ǆ")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(path unindexed, title, body, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("insert into f values (?, ?, ?)", rows)
    pages = spark.createDataFrame([("s", p, t, b, 1) for p, t, b in rows], PAGES)
    for q in ("žena", "ZENA", "cafés", "café", "čaj", "lodz", "łódź", "C:\\dir", "100%", "a_b", "istanbul", "ξενος", "ξένος", '"naive café"'):
        match = " AND ".join('"' + w.strip('"').replace('"', '""') + '"' for w in q.split())
        want = {p for (p,) in db.execute("select path from f where f match ?", (match,))}
        assert {r["path"] for r in search.search(pages, q, 50).collect()} == want, q
    marked = {r["path"]: r["title_match"] for r in search.search(pages, "C:\\dir").collect()}
    assert marked == {"c.md": True}
    db.execute("create virtual table v using fts5vocab(f, row)")
    every = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c).isalpha()]
    folded = spark.createDataFrame([(c,) for c in every], "c string").select("c", text.folded(F.col("c")).alias("f"))
    for c, by_column in folded.collect():
        db.execute("delete from f")
        db.execute("insert into f values ('x', '', ?)", (c,))
        (term,) = db.execute("select term from v").fetchone()
        assert text.fold(c) == by_column == term, c


def test_stored_index_follows_changes(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, PAGES)
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    assert kept.search("alpha").count() == 0
    first = [("s", "a.md", "Alpha", "alpha beta [[b]]", 1), ("s", "b.md", "B", "beta gamma", 1), ("t", "a.md", "A", "alpha", 1)]
    assert kept.refresh(made(first)) == 1 and kept.refresh(made(first)) == 1
    assert [(r["space_id"], r["path"]) for r in kept.search("alpha").collect()] == [("s", "a.md"), ("t", "a.md")]
    assert [r["target"] for r in kept.links().collect()] == ["b.md"]
    second = [("s", "a.md", "Alpha", "delta [[c]]", 2), ("s", "b.md", "B", "not read, as the time is the same", 1), ("s", "n.md", "N", "alpha", 1)]
    assert kept.refresh(made(second)) == 2
    for q in ("alpha", "beta", "delta", "gamma", "read"):
        got = [(r["path"], round(r["score"], 9)) for r in kept.search(q).collect()]
        now = [second[0], ("s", "b.md", "B", "beta gamma", 1), second[2]]
        assert got == [(r["path"], round(r["score"], 9)) for r in search.search(made(now), q).collect()], q
    assert [r["target"] for r in kept.links().collect()] == ["c.md"]
    kept.upsert(made([("s", "b.md", "B", "alpha alpha", 9)]))
    kept.delete(made([("s", "n.md", "", "", 0)]))
    assert {r["path"] for r in kept.search("alpha").collect()} == {"a.md", "b.md"}  # a.md by its title
    kept.rebuild(made([("t", "z.md", "Z", "alpha", 1)]), "t")
    assert {(r["space_id"], r["path"]) for r in kept.pages().collect()} == {("s", "a.md"), ("s", "b.md"), ("t", "z.md")}
    assert kept.facts()["n_docs"] == 3


def test_markdown_scan():
    scan = commonmark.scan
    assert scan("~~~\n[[no]]\n~~~\n[[yes]]")[0] == ["yes"]
    assert scan("```md\n`[[no]]`\n[x](no.md)\n```\n[y](yes.md)") == ([], ["yes.md"])
    assert scan("text\n\n    [[code]]\n\nmore [[w]]")[0] == ["w"]
    assert scan("para\n    [lazy](yes.md)")[1] == ["yes.md"]
    assert set(scan("[a][r] [r] [r][]\n\n[r]: <t a.md> 'T'\n")[1]) == {"t a.md"}
    assert scan("![i](x.md) [![i](x.md)](out.md) \\[n](no.md) <https://x.org>")[1] == ["out.md"]
    assert scan("`` ` [[no]] `` [[a|b]] [[c\nd]] [e](f.md 'T') [g](<h i.md>) [j](k(l).md)") == (["a"], ["f.md", "h i.md", "k(l).md"])
    assert scan(None) == scan("") == ([], [])


def test_broken_links_of_a_space(spark):
    body = (
        "# Source\n\n[exact](../../Target.md), [encoded](../../My%20Doc.md), [wrong case](../../target.md), [missing](../../missing.md#details), "
        "[attachment](../../attachment.pdf), [directory](../../assets/), [raw](../../.kb/sources/paper.pdf), [ext](https://e.com/m.md) [rel](//e.com/m.md) "
        "[m](mailto:d@e.com) [anchor](#local) [hidden](../../.kb/cache/s.md) [run](../../.kb/sources/.runtime/m.json).\n\n[[Target]], [[Target.md]], and [[Missing Wiki|missing]].\n\n"
        "`[[inline-code]]`\n\n```md\n[[fenced-wiki]]\n[fenced](../../fenced.md)\n```\n"
    )
    files = [("notes/deep/source.md", body), ("Target.md", "# E\n"), ("My Doc.md", "#"), ("attachment.pdf", ""), ("assets/x.png", ""), (".kb/sources/paper.pdf", ""), ("index.md", "[[reserved-missing]]"), (".kb/sources/raw.md", "[[hidden-missing]]")]
    pages = spark.createDataFrame([("s", p, None, b, 1) for p, b in files], PAGES)
    docs = pages.filter("path like '%.md'")
    got = {r["target"] for r in graph.broken_links(docs, graph.edges(docs), pages).collect()}
    assert got == {"target.md", "missing.md", "Missing Wiki.md"}


def test_page_tree(spark):
    rows = [("s", "b.md", "# Zed\n"), ("s", "dir/index.md", "---\ntitle: >-\n  Two\n  words\nsummary: S\n---\n"), ("s", "dir/c.md", "---\ntitle: [no, text]\n---\n# Head\n"), ("s", "dir/log.md", ""), ("s", "dir/p.HTML", "<p>"), ("s", ".x/d.md", "#"), ("s", "e.png", "")]
    got = {r["path"]: r for r in tree.in_order(tree.page_tree(spark.createDataFrame(rows, "space_id string, path string, body string"))).collect()}
    assert {p: (r["kind"], r["title"], r["parent"]) for p, r in got.items()} == {"b.md": ("page", "Zed", ""), "dir": ("folder", "Two words", ""), "dir/c.md": ("page", "Head", "dir"), "dir/p.HTML": ("page", "p.HTML", "dir")}
    assert got["dir"]["summary"] == "S" and got["dir"]["place"] < got["b.md"]["place"]
    files = spark.createDataFrame(rows, "space_id string, path string, body string")
    assert tree.page_by_path(files, "s", "dir/log.md").first()["kind"] == "log" and tree.page_by_slug(files, "s", "b").first()["title"] == "Zed"
    for bad in ("../b", "/b", "a//b", ""):
        with pytest.raises(ValueError):
            tree.page_by_path(files, "s", bad)
    assert tree.page_tree(files.limit(0)).count() == 0


def test_places_and_sums_over_a_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("n"))
    assert all(r["place"] == r["k"] + 1 for r in ranks.placed(df, [F.col("k")]).collect())
    assert all(r["running"] == 2 * (r["k"] + 1) for r in ranks.running(df, [F.col("k")], F.col("n")).collect())
    assert ranks.placed(df.limit(0), [F.col("k")]).count() == 0


def test_comments(spark):
    schema = "id string, space_id string, page_slug string, user_id string, user_name string, body string, source string, start_line int, end_line int, parent_id string, content_hash string, resolved boolean, created_at long"
    made = lambda rows: spark.createDataFrame(rows, schema)
    row = lambda i, page="p.md", body="x", source="a\nb\n", a=1, b=2, parent=None: (i, "s", page, "u", " ", body, source, a, b, parent, None, False, 1)
    stored = made([row("r")])
    new = made([row("1"), row("2", source=None, a=None, b=None, parent="r"), row("3", b=3), row("4", page="../p.md"), row("5", body=" "), row("6", source=None, a=None, b=None, parent="gone"), row("7", parent="r"), row("8", page="p.txt"), row("9", source=None)])
    bad = {r["id"]: r["error"] for r in comments.checked(new, stored).collect()}
    assert {i for i, e in bad.items() if e is None} == {"1", "2"}
    rows, shots = comments.inserted(new, stored, spark.createDataFrame([], "space_id string, page_slug string, content_hash string, source string"))
    assert {r["id"] for r in rows.collect()} == {"r", "1", "2"} and shots.count() == 1
    assert {r["user_name"] for r in rows.filter("id <> 'r'").collect()} == {"You"}


def test_patches(spark):
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@ f\n a\n-b\n+c\n+@@ -9 +9 @@\n\\ No newline at end of file\n@@ -8 +9,0 @@\n-z"
    lines = review.patch_lines(spark.createDataFrame([("x", patch), ("y", ""), ("z", None)], "file_path string, patch string")).orderBy("place").collect()
    assert [(r["hunk"], r["kind"], r["old_line"], r["new_line"], r["text"]) for r in lines] == [(1, "ctx", 1, 1, "a"), (1, "del", 2, None, "b"), (1, "add", None, 2, "c"), (1, "add", None, 3, "@@ -9 +9 @@"), (2, "del", 8, None, "z")]
    assert lines[-1]["header"] == "@@ -8 +9,0 @@"


def test_changes(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, body string")
    base, draft = f([("a", "1\n2\n3\n"), ("b", "x\n"), ("d", "z")]), f([("a", "1\n2\n3\n4\n"), ("b", "x\n")])
    agent = f([("a", "0\n1\n2\n3\n"), ("b", "y\n"), ("d", "z"), ("n", "new")])
    state, merged = changes.merge_change(base, draft, agent)
    assert state == "merged" and {r["path"]: r["body"] for r in merged.collect()} == {"a": "0\n1\n2\n3\n4\n", "b": "y\n", "n": "new"}
    state, same = changes.merge_change(base, draft, f([("a", "other\n"), ("b", "x\n"), ("d", "q")]))
    assert state == "needsResolution" and same.count() == 2
    with pytest.raises(ValueError, match="changed"):
        changes.apply_transition(f([("a", "moved on")]), base, draft)
    assert {r["path"] for r in changes.apply_transition(base, base, draft).collect()} == {"a", "b"}
    message = "S\n\nAgent: A\nAgent-Change: 1\nAgent-Task: t\nAgent: B\nnote\nAgent-Change: 2\n"
    assert one(spark, message, changes.trailers) == [("A", "1", "t")]
    assert one(spark, "S \n", lambda c: changes.trailers(changes.with_trailers(c, F.lit("N\nx"), F.lit("7"), F.lit(" t ")))) == [("N", "7", "t")]
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None, i != 3) for i in range(20)], "id string, parent string, has_ref boolean")
    assert sorted((r["place"], r["id"]) for r in changes.checkpoint_chain(chain, "12").collect()) == [(k, str(12 - k)) for k in range(9)]


def test_bundles(spark):
    f = lambda rows: spark.createDataFrame([("s", *r) for r in rows], "space_id string, path string, body string")
    old = f([("a.md", "text"), ("d/b.md", "---\ntype: Note\n---\nx"), ("d/log.md", "no log"), ("sources/.gitkeep", "\n"), ("sources/x.md", "s"), ("sources/y.txt", "t"), ("sources/index.md", "i")])
    assert bundle.needs_migration(old).first()["needs_migration"]
    new = bundle.prepared(old, "2026-01-31")
    got = {r["path"]: r["body"] for r in new.collect()}
    assert {"index.md", "d/index.md", ".kb/sources/x.md", ".kb/legacy/d/log.md.legacy"} <= got.keys() and not any(p.startswith("sources/") for p in got)
    assert got["d/b.md"] == "---\ntype: Note\n---\nx" and got["a.md"].startswith("---\ntype: Note\ntitle:")
    assert sum(p.startswith(".kb/sources/_encoded/") for p in got) == 2
    assert not bundle.needs_migration(new).first()["needs_migration"]
    with pytest.raises(ValueError, match="commit"):
        bundle.prepared(old, "2026-01-31", old)


def test_ingest_names(spark):
    rows = [(1, "s", "A b", "h1" * 32, "u"), (2, "s", "A b", "h1" * 32, "u"), (3, "s", "A b", "h2" * 32, "u"), (4, "s", "A b", None, None), (5, "s", "A b", "h1" * 32, None), (6, "s", "Old", "old" * 20, None), (7, "s", "Old", "new" * 20, None), (8, "t", "A b", None, None)]
    docs = spark.createDataFrame(rows, "arrival long, space_id string, name string, content_hash string, source_url string")
    stored = spark.createDataFrame([("s", ".kb/sources/old.md", "old" * 20, None)], "space_id string, path string, content_hash string, source_url string")
    got = {r["arrival"]: (r["path"].removeprefix(".kb/sources/"), r["reused"]) for r in ingest.named(docs, stored).collect()}
    assert got[1] == ("a-b.md", False) and got[2] == ("a-b.md", True) and got[3] == ("a-b-h2h2h2h2.md", False)
    assert got[5] == ("a-b-h1h1h1h1.md", False) and got[6] == ("old.md", True) and got[7] == ("old-newnewne.md", False) and got[8] == ("a-b.md", False)
    assert got[4][0].startswith("a-b-") and len(got[4][0]) == len("a-b-12345678.md")
    assert ingest.named(docs.limit(0), stored).count() == 0
    assert ingest.outcome(3, [("x.doc", "bad")]) == "1 of 3 failed: x.doc (bad)"


def test_assets(spark):
    html = "<link rel='stylesheet' href='s.css'><img src=\"a.png\"><img src=\"../no.png\"><div style='background:url(a.png)'></div><a href='b.html'>l</a>"
    docs = spark.createDataFrame([("d/p.html", html)], "path string, body string")
    files = spark.createDataFrame([("d/a.png", 3, b"abc"), ("d/s.css", 2, b"p{")], "path string, size long, content binary")
    states = {r["reference"]: r["state"] for r in assets.audit(docs, files).collect()}
    assert states == {"s.css": "ok", "a.png": "ok", "../no.png": "outside"}
    out = assets.bundled(docs, files).first()
    assert out["body"].count("data:image/png;base64,YWJj") == 2 and "data:text/css;base64," in out["body"] and "href='b.html'" in out["body"]
    assert out["warnings"] == ["unavailable: ../no.png"]


def test_writes(spark):
    f = spark.createDataFrame([("d/a.md", "x"), ("d/b.md", "y"), ("e.md", "z")], "path string, body string")
    assert {r["path"] for r in writes.rename(f, "d", "k/d").collect()} == {"k/d/a.md", "k/d/b.md", "e.md"}
    for call in (lambda: writes.rename(f, "no", "x"), lambda: writes.rename(f, "d", "e.md"), lambda: writes.rename(f, "e.md", "index.md"), lambda: writes.delete(f, ""), lambda: writes.delete(f, "no"), lambda: writes.create_folder(f, "d")):
        with pytest.raises(ValueError):
            call()
    c = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", None)], "id string, parent_id string")
    assert [r["id"] for r in writes.cascade_delete(c, c.filter("id = '1'")).collect()] == ["4"]
    with pytest.raises(ValueError, match="not found"):
        writes.set_resolved(c.withColumn("resolved", F.lit(False)), c.filter("id = '2'"), True)
    w = spark.createDataFrame([("e.md", "n", "z", False), ("d/a.md", "n", "old", False), ("q.md", "n", None, True)], "path string, content string, expected string, create_only boolean")
    got = {r["path"]: r["body"] for r in writes.write_pages(f, w).collect()}
    assert got["d/a.md"] == "x" and got["e.md"].endswith("n") and got["q.md"].startswith("---\ntype: Note")


def test_display_columns(spark):
    assert one(spark, "né Ω😀", display.char_code_hash) == sum(map(ord, "né Ω")) + 0xD83D
    h = 0
    for u in (ord("a"), 0xD83D, 0xDE00):
        h = (h * 31 + u + 2**31) % 2**32 - 2**31
    assert one(spark, "a😀", display.djb2_hash) == abs(h)
    assert [one(spark, n, lambda c, k=k: display.avatar_initials(c, k)) for n, k in (("ann lee x", "default"), ("ann", "comment"), ("ann lee", "member"), (" ", "default"), (None, "comment"))] == ["AL", "AN", "A", "?", "?"]
    assert one(spark, "a/b c.md", lambda c: display.page_route(F.lit("w's"), c)) == "/w's/a/b%20c.md"
    assert one(spark, "say @bob", lambda c: display.mention_query(c, F.lit(8))) == "bob" and one(spark, "say bob", lambda c: display.mention_query(c, F.lit(7))) is None
    assert one(spark, [2024, 366, 23, 59, 59, 999_000_000, -2, 30, 0], display.ordinal_timestamp, "array<long>") == "2025-01-01T02:29:59.999Z"
    assert one(spark, [2024, 1, 1], display.ordinal_timestamp, "array<long>") == ""
    assert one(spark, "C:\\x\\Caf\u00e9 Notes/", display.space_slug) == "cafe-notes" or one(spark, "C:\\x\\Caf\u00e9 Notes/", display.space_slug) == "cafe--notes"
    assert one(spark, "aXbx", lambda c: display.highlighted(c, " x ")) == "a<mark>X</mark>b<mark>x</mark>"
    doc = "---\r\ntitle: 'T'\r\n---\r\n\r\nBody"
    assert one(spark, doc, display.system_front_matter) + one(spark, doc, display.editable_body) == doc
    assert one(spark, doc, lambda c: display.source_title(F.lit(""), c, F.lit("x.md"))) == "T"
    assert one(spark, "---\na: 1\n---\n# H\n", metadata.display_metadata)["title"] == "H"


def test_snapshots_end_with_the_main_part():
    snap = formats.html_snapshot
    title, body = snap("<title> A  b</title><article>in <a href='../x'>l</a><table><tr><th>H</th></tr><tr><td>a|b</td></tr></table><pre>c\n  d</pre></article><div>SIDE after</div>", "https://e.org/p/q")
    assert title == "A b" and "SIDE" not in body and "[l](https://e.org/x)" in body and "| a\\|b |" in body and "```\nc\n  d\n```" in body
    assert snap("<p>one<p>two", None) == ("", "one\n\ntwo") and snap(None) == ("", "")
    with pytest.raises(ValueError, match="large"):
        snap("x" * (formats.PAGE_LIMIT + 1))
    with pytest.raises(ValueError, match="nodes"):
        snap("<i></i>" * (formats.NODE_LIMIT + 1))


def test_nearest_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)] + [(500, None), (501, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 10 = 0 or vec_id >= 500")
    whole = sorted(map(tuple, vector.nearest(q, df, 3, 0.5).collect()))
    assert whole == sorted(map(tuple, vector.nearest(q, df, 3, 0.5, query_bytes=50).collect())) and len(whole) == 60
    assert vector.nearest(q.limit(0), df, 3, 0.5).count() == 0


def test_a_task_of_a_vector_search_holds_the_best_of_each_query_only(spark, monkeypatch):
    import numpy as np
    from quillspark.operators import vector

    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (150, 3))  # many equal and parallel vectors, so ties are frequent
    x[~x.any(1)] = 1
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = set()
    for q in range(0, 150, 5):
        s = np.round(unit @ unit[q], 6)
        want |= {(q, int(v)) for v in sorted((v for v in range(150) if v != q and s[v] > 0.1), key=lambda v: (-s[v], v))[:4]}
    monkeypatch.setattr(vector, "QUERIES", 7)
    monkeypatch.setattr(vector, "ROWS", 11)
    got = vector.nearest(df.filter("vec_id % 5 = 0"), df, 4, 0.1)
    assert {(r["query_id"]) for r in got.collect()} == {q for q, _ in want}
    exact = {(r["query_id"], r["similarity"]) for r in got.collect()}
    assert exact == {(q, float(np.round(unit[v] @ unit[q], 6))) for q, v in want} and got.count() == len(want)
