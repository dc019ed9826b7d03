"""Tree hashes and differences against flat ones, and history over merges against a plain walk."""

import random

import pytest

from quillspark.operators import history, trees

FILES = "path string, body string"


def changed_tree(rng, files):
    out = dict(files)
    for _ in range(rng.randrange(0, 6)):
        path = rng.choice(sorted(out)) if out else "x"
        if rng.random() < 0.5:
            out[path] = str(rng.random())
        elif rng.random() < 0.5:
            out.pop(path, None)
        else:
            out["/".join(rng.choice("abc") + rng.choice("12") for _ in range(rng.randrange(1, 5)))] = "n"
    return out


@pytest.mark.parametrize("seed, listed", [(1, 1024), (2, 1024), (3, 2)])
def test_tree_diff_equals_the_flat_one(spark, seed, listed, monkeypatch):
    monkeypatch.setattr(trees, "LISTED", listed)
    rng = random.Random(seed)
    one = {"/".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) + ".md": rng.choice(["x", "y", None]) for _ in range(250)}
    two = changed_tree(rng, one)
    made = lambda d: spark.createDataFrame(sorted(d.items(), key=str), FILES)
    got = trees.tree_diff(trees.merkle(made(one)), trees.merkle(made(two).repartition(3)))
    flat = {(p, "added" if p not in one else "deleted" if p not in two else "modified") for p in one.keys() | two.keys() if one.get(p, 0) != two.get(p, 0)}
    assert {(r["path"], r["status"]) for r in got.changes.collect()} == flat
    assert got.compared < 0.6 * got.entries


def test_trees_which_are_equal_empty_or_swapped(spark):
    made = lambda rows: trees.merkle(spark.createDataFrame(rows, FILES))
    one, empty = made([("a/b", "x"), ("a/c", None), ("d", "")]), made([])
    same = trees.tree_diff(one, made([("d", ""), ("a/c", None), ("a/b", "x")]))
    assert same.compared == 0 and same.changes.count() == 0
    assert {r["path"]: r["status"] for r in trees.tree_diff(empty, one).changes.collect()} == {"a/b": "added", "a/c": "added", "d": "added"}
    assert {r["path"]: r["status"] for r in trees.tree_diff(one, made([("a", "x"), ("a/c", None), ("d/e", "")])).changes.collect()} == {"a/b": "deleted", "d": "deleted", "a": "added", "d/e": "added"}
    assert trees.tree_diff(empty, made([])).changes.count() == 0


def graph(seed):
    """Commits with merges, skewed clocks and commits that are not reachable."""
    rng = random.Random(seed)
    commits, trees_ = {}, {}
    for k in range(40):
        parents = [] if k == 0 or rng.random() < 0.04 else rng.sample(sorted(commits), min(len(commits), rng.choice([1, 1, 1, 2, 3])))
        tree = dict(trees_[parents[0]]) if parents else {}
        for p in parents[1:]:
            if rng.random() < 0.7:
                tree |= trees_[p]
        for _ in range(rng.randrange(0, 3)):
            tree[f"p{rng.randrange(6)}"] = rng.choice("xyz")
        if tree and rng.random() < 0.2:
            tree.pop(rng.choice(sorted(tree)))
        name = f"c{k:02d}"
        commits[name], trees_[name] = (parents, k * 10 if rng.random() < 0.8 else rng.randrange(400)), tree
    return commits, trees_


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_last_changes_equal_a_plain_walk(spark, seed):
    commits, tree = graph(seed)
    tip = "c39"
    at = {}
    for c in sorted(commits):  # parents come before children by name
        at[c] = max([commits[c][1], *[at[p] + 1 for p in commits[c][0]]])
    seen, todo = set(), [tip]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += commits[c][0]
    want = {}
    for c in sorted(seen, key=lambda c: (at[c], c), reverse=True):
        before = tree[commits[c][0][0]] if commits[c][0] else {}
        for p, b in tree[c].items():
            if b != before.get(p):
                want.setdefault(p, c)
    cs = spark.createDataFrame([(c, p, t) for c, (p, t) in commits.items()], "id string, parents array<string>, committed_at long")
    bs = spark.createDataFrame([(c, p, b) for c, t in tree.items() for p, b in t.items()], "id string, path string, blob string")
    assert {r["id"] for r in history.ancestors(cs, tip).collect()} == seen
    assert {r["path"]: r["id"] for r in history.last_changes(cs, bs, tip).collect()} == want


def test_a_long_line_takes_few_rounds_and_a_cycle_is_an_error(spark):
    line = spark.createDataFrame([(f"{k:04d}", [f"{k - 1:04d}"] if k else [], k) for k in range(600)], "id string, parents array<string>, committed_at long")
    assert history.ancestors(line, "0599").count() == 600 and history.ancestors(line, "none").count() == 0
    ring = spark.createDataFrame([("a", ["b"], 1), ("b", ["a"], 1)], "id string, parents array<string>, committed_at long")
    with pytest.raises(ValueError, match="cycle"):
        history.dated(ring, rounds=5)
