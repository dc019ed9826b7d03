"""Line differences of pages by anchors, and the three-way merge built on them.

Lines are rows. A line that occurs once on either side is an anchor: both sides
are grouped by it, which no page size hinders. Of the anchors of a page those
in the same order on both sides count, and what lies between two of them is a
gap. Only gaps with lines on both sides are compared line by line.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import materialize

#: Edits up to which a gap is compared for the fewest edits; beyond it, lines are paired by their occurrences.
MOST_EDITS = 400
_PAIRS = "array<struct<a:int,b:int>>"


def lines(body: Column) -> Column:
    """The lines of a text with their ends; the last may have none. A null text has no lines."""
    return F.filter(F.split(F.coalesce(body, F.lit("")), "(?<=\n)"), lambda x: x != "")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [v]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _fewest_edits(x: list, y: list) -> list[tuple[int, int]] | None:
    """Equal places of two lists along a path of fewest edits; None if there are more than MOST_EDITS."""
    n, m = len(x), len(y)
    reach, trace = {1: 0}, []
    for d in range(min(n + m, MOST_EDITS) + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i += 1
                j += 1
            reach[k] = i
            if i >= n and j >= m:
                break
        else:
            continue
        break
    else:
        return None
    out, i, j = [], n, m
    for d in range(len(trace) - 1, -1, -1):
        held, k = trace[d], i - j
        up = k == -d or (k != d and held[k - 1] < held[k + 1])
        i0 = held[k + 1] if up else held[k - 1] + 1
        while i > max(i0, 0) and j > 0 and i > i0:
            i -= 1
            j -= 1
            out.append((i, j))
        i, j = (i, j - 1) if up else (i - 1, j)
    return out[::-1]


def _paired(x: list, y: list) -> list[tuple[int, int]]:
    """Equal places in the same order: the k-th occurrence of a line with the k-th of the other side, in n log n steps."""
    seen: dict = defaultdict(list)
    for j, v in enumerate(y):
        seen[v].append(j)
    count: dict = defaultdict(int)
    pairs = []
    for i, v in enumerate(x):
        k = count[v]
        if k < len(seen.get(v, ())):
            pairs.append((i, seen[v][k]))
            count[v] += 1
    return [pairs[k] for k in increasing([j for _, j in pairs])]


def _slid(pairs: list[tuple[int, int]], x: list, y: list) -> list[tuple[int, int]]:
    """The same number of pairs with every stretch of unmatched lines as late as it can be, on either side."""
    for side in (0, 1):
        own, to = (x, dict(pairs)) if side == 0 else (y, {j: i for i, j in pairs})
        at = len(own) - 1
        while at >= 0:
            if at in to:
                at -= 1
                continue
            stop = at + 1
            start = at
            while start > 0 and start - 1 not in to:
                start -= 1
            # the line after the stretch equals its first: match that one instead
            while stop < len(own) and stop in to and own[start] == own[stop]:
                to[start] = to.pop(stop)
                start += 1
                stop += 1
                while stop < len(own) and stop not in to:
                    stop += 1
            at = min(at, start) - 1
        pairs = sorted(to.items()) if side == 0 else sorted((i, j) for j, i in to.items())
    return pairs


def gap_matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of equal lines of two short texts, in order on both sides; changes stand as late as they can."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    inner_x, inner_y = x[head : len(x) - tail], y[head : len(y) - tail]
    in_x, in_y = set(inner_x), set(inner_y)
    # lines of one side only match nothing
    kept_x = [i for i, v in enumerate(inner_x) if v in in_y]
    kept_y = [j for j, v in enumerate(inner_y) if v in in_x]
    short_x, short_y = [inner_x[i] for i in kept_x], [inner_y[j] for j in kept_y]
    found = _fewest_edits(short_x, short_y)
    if found is None:
        found = _paired(short_x, short_y)
    middle = [(head + kept_x[i], head + kept_y[j]) for i, j in found]
    ends = [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
    return _slid([(k, k) for k in range(head)] + middle + ends, x, y)


def matches(pairs: DataFrame) -> DataFrame:
    """(key, a, b): the lines, from 0 on, which stay between two versions of each of ``pairs`` (key, x, y: arrays of lines)."""
    side = lambda k, c: pairs.select("key", F.lit(k).alias("side"), F.posexplode(c).alias("n", "line"))
    once = lambda k: F.count_if(F.col("side") == k) == 1
    at = lambda k: F.min(F.when(F.col("side") == k, F.col("n")))
    unique = side(0, "x").unionByName(side(1, "y")).groupBy("key", F.unhex(F.sha2("line", 256)).alias("line")).agg(at(0).alias("a"), at(1).alias("b"), (once(0) & once(1)).alias("ok")).filter("ok")

    @F.pandas_udf("array<int>")
    def ordered(b: pd.Series) -> pd.Series:
        return pd.Series([increasing(list(v)) for v in b])

    met = unique.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("met"))
    anchors = met.select("key", F.transform(ordered(F.col("met.b")), lambda k: F.element_at("met", k + 1)).alias("anchors"))
    none = F.array().cast(_PAIRS)
    edge = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    bounds = F.concat(edge(F.lit(-1), F.lit(-1)), F.coalesce("anchors", none), edge(F.size("x"), F.size("y")))
    held = pairs.join(anchors, "key", "left").withColumn("bounds", bounds)
    gap = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.struct((F.get("bounds", k - 1)["a"] + 1).alias("a"), (F.get("bounds", k - 1)["b"] + 1).alias("b"), F.get("bounds", k)["a"].alias("a1"), F.get("bounds", k)["b"].alias("b1")))
    full = F.filter(gap, lambda g: (g["a1"] > g["a"]) & (g["b1"] > g["b"]))
    gaps = held.select("key", "x", "y", F.explode(full).alias("g")).select(
        "key", "g.a", "g.b", F.slice("x", F.col("g.a") + 1, F.col("g.a1") - F.col("g.a")).alias("xs"), F.slice("y", F.col("g.b") + 1, F.col("g.b1") - F.col("g.b")).alias("ys")
    )

    @F.pandas_udf(_PAIRS)
    def inside(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([[{"a": i, "b": j} for i, j in gap_matches(list(x), list(y))] for x, y in zip(xs, ys, strict=True)])

    between = gaps.select("key", "a", "b", F.explode(inside("xs", "ys")).alias("m")).select("key", (F.col("a") + F.col("m.a")).alias("a"), (F.col("b") + F.col("m.b")).alias("b"))
    return anchors.select("key", F.explode("anchors").alias("m")).select("key", "m.a", "m.b").unionByName(between)


def _numbered(pairs: DataFrame, column: str, number: str) -> DataFrame:
    return pairs.select("key", F.posexplode(column).alias(number, "line"))


def _before(flag: Column, number: str, including: bool) -> Column:
    """How many flagged lines of the page stand before a line, itself included or not."""
    w = Window.partitionBy("key").orderBy(number).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    return F.coalesce(F.sum(flag.cast("int")).over(w), F.lit(0))


def diff_lines(pairs: DataFrame) -> DataFrame:
    """(key, place, kind, old_line, new_line, text): kept, deleted and added lines in order; deletions stand before additions."""
    found = materialize(matches(pairs), "matches")
    old = _numbered(pairs, "x", "a").join(found, ["key", "a"], "left").withColumn("r", _before(F.col("b").isNotNull(), "a", False))
    new = _numbered(pairs, "y", "b").join(found, ["key", "b"], "left").withColumn("r", _before(F.col("a").isNotNull(), "b", False)).filter("a is null")
    kind = F.when(F.col("b").isNull(), "del").otherwise("ctx")
    rows = old.select("key", F.struct("r", F.when(F.col("b").isNull(), 0).otherwise(2).alias("k"), F.col("a").alias("n")).alias("place"), kind.alias("kind"), (F.col("a") + 1).alias("old_line"), (F.col("b") + 1).alias("new_line"), "line")
    added = new.select("key", F.struct("r", F.lit(1).alias("k"), F.col("b").alias("n")).alias("place"), F.lit("add").alias("kind"), F.lit(None).cast("int").alias("old_line"), (F.col("b") + 1).alias("new_line"), "line")
    return rows.unionByName(added).withColumn("text", F.regexp_replace("line", "[\r\n]+$", "")).drop("line")


def merged(files: DataFrame) -> DataFrame:
    """(key, body) of the line-wise merge of ``files`` (key, base, draft, agent); a null body is a conflict.

    Base lines which both sides keep part a file into regions. A region which
    one side left as it was is the other's; so changes of both sides conflict
    unless a kept line stands between them, or they are equal.
    """
    sides = materialize(files.select("key", lines(F.col("base")).alias("base"), lines(F.col("draft")).alias("draft"), lines(F.col("agent")).alias("agent")), "sides")
    pair = lambda s: matches(sides.select("key", F.col("base").alias("x"), F.col(s).alias("y")))
    kept = materialize(pair("draft").withColumnRenamed("b", "d").join(pair("agent").withColumnRenamed("b", "g"), ["key", "a"]), "kept")
    met = sides.join(kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "d", "g"))).alias("k")), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                bodies = [_chosen(*row[:3], list(zip(*row[3:], strict=True)) if row[3] else []) for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.string())], ["key", "body"])

    return met.select("key", "base", "draft", "agent", "k.a", "k.d", "k.g").mapInArrow(run, f"key {files.schema['key'].dataType.simpleString()}, body string")


def _chosen(base: list[str], draft: list[str], agent: list[str], kept: list[tuple[int, int, int]]) -> str | None:
    """The merge of one file by its kept lines, which stand at these places of each side; None if a region conflicts."""
    out, i, j, k = [], 0, 0, 0
    for a, d, g in [*kept, (len(base), len(draft), len(agent))]:
        b, mine, other = base[i:a], draft[j:d], agent[k:g]
        if mine == other or other == b:
            out += mine
        elif mine == b:
            out += other
        else:
            return None
        out += base[a : a + 1]  # a kept line is the same on each side
        i, j, k = a + 1, d + 1, g + 1
    return "".join(out)
