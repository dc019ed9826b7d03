"""Line diffs and merges against `git merge-file`, exact reconstruction, and pages of many lines."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quillspark.operators import changes, linediff, versions


def edited(rng, lines, fresh, most):
    out = list(lines)
    for _ in range(rng.randrange(0, most)):
        at = rng.randrange(len(out) + 1)
        what = rng.random()
        if what < 0.4 and out:
            out[at % len(out)] = fresh()
        elif what < 0.7:
            out.insert(at, fresh())
        elif out:
            del out[at % len(out)]
    return out


def cases(n, seed, repeated):
    """Base, draft and agent texts; of ``repeated`` of the lines there are few different ones."""
    rng = random.Random(seed)
    for k in range(n):
        count = iter(range(10**6))
        fresh = lambda k=k, count=count: rng.choice(["\n", "}\n", "x\n"]) if rng.random() < repeated else f"line {next(count)} of {k}\n"
        base = [fresh() for _ in range(rng.randrange(0, 14))]
        draft, agent = (edited(rng, base, fresh, 5) for _ in range(2))
        if rng.random() < 0.2:
            agent = edited(rng, draft, fresh, 2)
        texts = ["".join(t) for t in (base, draft, agent)]
        yield [t[:-1] if rng.random() < 0.1 else t for t in texts]


def git_merged(folder, base, draft, agent):
    for name, t in (("b", base), ("d", draft), ("a", agent)):
        (folder / name).write_text(t)
    done = subprocess.run(["git", "merge-file", "-p", folder / "d", folder / "b", folder / "a"], capture_output=True, text=True)
    return done.stdout if done.returncode == 0 else None


@pytest.mark.parametrize("repeated, seed", [(0.0, 1), (0.25, 2)])
def test_merges_equal_those_of_git(spark, tmp_path, repeated, seed):
    given = list(cases(1000, seed, repeated))
    want = [git_merged(tmp_path, *c) for c in given]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(given)], "key int, base string, draft string, agent string")
    got = {r["key"]: r["body"] for r in linediff.merged(df).collect()}
    assert 250 < sum(w is None for w in want) < 800
    odd = [k for k in range(len(given)) if got[k] != want[k]]
    assert len(odd) <= (0 if not repeated else 20), [(given[k], got[k], want[k]) for k in odd[:3]]


def test_adjacent_edits_conflict_and_equal_ones_do_not(spark):
    rows = [("near", "a\nb\nc\n", "A\nb\nc\n", "a\nB\nc\n"), ("apart", "a\nb\nc\n", "A\nb\nc\n", "a\nb\nC\n"), ("same", "a\nb\n", "a\nx\n", "a\nx\n"), ("both add", "a\n", "a\nx\n", "a\ny\n"), ("empty", "", "", ""), ("gone", "a\n", "", "a\n"), ("end", "a\nb", "a\nb", "a\nb\n")]
    got = {r["key"]: r["body"] for r in linediff.merged(spark.createDataFrame(rows, "key string, base string, draft string, agent string")).collect()}
    assert got == {"near": None, "apart": "A\nb\nC\n", "same": "a\nx\n", "both add": None, "empty": "", "gone": "", "end": "a\nb\n"}


def test_diffs_rebuild_both_sides_with_few_edits(spark):
    given = [(str(k), b, d) for k, (b, d, _) in enumerate(cases(400, 9, 0.5))]
    old, new = spark.createDataFrame([g[:2] for g in given], "path string, body string"), spark.createDataFrame([(g[0], g[2]) for g in given], "path string, body string")
    got = {r["path"]: r for r in versions.file_diffs(old, new).collect()}
    assert set(got) == {p for p, a, b in given if a != b}
    for p, a, b in given:
        if a == b:
            continue
        rows, ends = got[p]["lines"], lambda t: [x.rstrip("\r\n") for x in t.splitlines(keepends=True)]
        assert [r["text"] for r in rows if r["kind"] != "add"] == ends(a) and [r["text"] for r in rows if r["kind"] != "del"] == ends(b)
        assert [r["old_line"] for r in rows if r["kind"] != "add"] == list(range(1, len(ends(a)) + 1))
        assert [r["new_line"] for r in rows if r["kind"] != "del"] == list(range(1, len(ends(b)) + 1))
        assert got[p]["additions"] == sum(r["kind"] == "add" for r in rows)


def _longest(x, y):
    row = [0] * (len(y) + 1)
    for v in x:
        last = 0
        for j, w in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if v == w else max(row[j + 1], row[j])
    return row[-1]


def test_gaps_keep_as_many_lines_as_can_be():
    rng = random.Random(4)
    for _ in range(800):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        found = linediff.gap_matches(x, y)
        assert len(found) == _longest(x, y) and all(x[i] == y[j] for i, j in found)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))


def test_a_page_of_many_lines(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(50_000)}\n" for _ in range(200_000)]
    new = base[:50_000] + ["new\n"] * 1000 + base[60_000:] + rng.sample(base, 5000)
    shuffled = rng.sample(base, len(base))
    df = spark.createDataFrame([("a", "".join(base), "".join(new)), ("b", "".join(base), "".join(shuffled))], "key string, x string, y string")
    found = linediff.matches(df.select("key", linediff.lines(F.col("x")).alias("x"), linediff.lines(F.col("y")).alias("y"))).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"))
    got = {r["key"]: r for r in found.collect()}
    assert all(r["n"] == r["a"] == r["b"] for r in got.values()) and got["a"]["n"] >= 190_000 and got["b"]["n"] > 0


def test_a_merge_of_trees(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, body string")
    base, draft, agent = f([("p", "a\nb\nc\n"), ("q", "a\nb\nc\n")]), f([("p", "A\nb\nc\n"), ("q", "A\nb\nc\n")]), f([("p", "a\nb\nC\n"), ("q", "a\nB\nc\n")])
    assert {r["path"]: (r["state"], r["body"]) for r in changes.merged(base, draft, agent).collect()} == {"p": ("merged", "A\nb\nC\n"), "q": ("conflict", "A\nb\nc\n")}


def test_a_merge_moves_lines_once(spark):
    rows = [(k, f"a\nb\nc\n{k}\n", f"A\nb\nc\n{k}\n", f"a\nb\nC\n{k}\n") for k in range(20)]
    files = spark.createDataFrame(rows, "key long, base string, draft string, agent string")
    made = linediff.merged(files)
    assert {(r["key"], r["body"]) for r in made.collect()} == {(k, f"A\nb\nC\n{k}\n") for k in range(20)}
    # texts met kept lines in three joins, three windows and a grouping
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
