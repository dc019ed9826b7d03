"""Directory indexes: escaping, titles, the marked block, and chunks of bounded size."""

import pytest

from quillspark.operators import dirindex

FILES = "space_id string, path string, body string"


def test_written_indexes(spark, tmp_path):
    rows = [
        ("s", "d/b.md", "# Zed <1> & [x]\\\n"), ("s", "d/a.md", "---\ntitle: alpha\ndescription: ' A > b '\n---\n"), ("s", "d/50%.md", None), ("s", "d/sub/index.md", "---\ntitle: Below\n---\n"), ("s", "d/sub/p.md", "x"),
        ("s", "d/log.md", "# L"), ("s", "d/.h/x.md", "x"), ("s", "d/f.png", ""), ("s", "d/index.md", f"# Mine\n\n{dirindex.START}\nold\n{dirindex.END}\nkept\n"), ("t", "e/q.md", "x"),
    ]
    got = dirindex.write(spark.createDataFrame(rows, FILES), str(tmp_path), 2).collect()
    text = (tmp_path / "s/d/index.md").read_text()
    assert text == (
        f"# Mine\n\n{dirindex.START}\n* [50%](<50%25.md>)\n* [alpha](<a.md>) - A &gt; b\n* [Below](<sub/>)\n* [Zed &lt;1&gt; &amp; \\[x\\]\\\\](<b.md>)\n{dirindex.END}\nkept\n"
    )
    assert (tmp_path / "s/index.md").read_text() == f"# Knowledge\n\n{dirindex.START}\n* [Mine](<d/>)\n{dirindex.END}\n"
    assert (tmp_path / "s/d/sub/index.md").read_text().startswith("---\ntitle: Below\n---\n\n" + dirindex.START)
    assert {(r["space_id"], r["dir"]): r["n_bytes"] for r in got} == {(s, str(p.parent.relative_to(tmp_path / s)).replace(".", "")): p.stat().st_size for s in "st" for p in (tmp_path / s).rglob("index.md")}
    assert not list(tmp_path.rglob("index.md.*"))


def test_chunks_of_a_large_directory(spark):
    rows = [("s", f"d/p{k:05d}.md", "x") for k in range(2500)]
    got = sorted(dirindex.chunks(spark.createDataFrame(rows, FILES).repartition(6), 300).filter("dir = 'd'").collect(), key=lambda r: r["chunk"])
    assert [r["text"].count("\n") for r in got] == [300] * 8 + [100]
    assert [r["offset"] for r in got] == [sum(len(x["text"]) for x in got[:k]) for k in range(9)]
    assert "".join(r["text"] for r in got) == "".join(f"\n* [p{k:05d}](<p{k:05d}.md>)" for k in range(2500))


def test_an_open_block_is_an_error_and_no_files_are_no_rows(spark):
    rows = [("s", "d/a.md", "x"), ("s", "d/index.md", f"# I\n{dirindex.START}\n")]
    with pytest.raises(Exception, match="closing marker"):
        dirindex.around(spark.createDataFrame(rows, FILES)).collect()
    assert dirindex.chunks(spark.createDataFrame([], FILES)).count() == 0
