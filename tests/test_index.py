"""The segmented index against an index made anew, its reads, and batches of queries against single searches."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.operators import batch, graph, index, search

PAGES = "space_id string, path string, title string, body string, modified_ns long"
WORDS = ["alpha", "beta", "gamma", "delta", "rare", "Żubr", "café", "x1", "long", "word"]


def pages_of(spark, rows):
    return spark.createDataFrame([(s, p, t, b, m) for (s, p), (t, b, m) in rows.items()], PAGES)


def made(rng, k):
    body = " ".join(rng.choices(WORDS, [8, 6, 4, 2, 0.3, 1, 1, 1, 1, 1], k=rng.randrange(0, 30)))
    return (" ".join(rng.choices(WORDS, k=2)) if rng.random() < 0.8 else None, f"{body} [[{rng.randrange(12)}]]", k)


def test_random_batches_equal_a_rebuild(spark, tmp_path):
    rng, rows = random.Random(11), {}
    kept = index.SearchIndex(spark, str(tmp_path / "i"), range_tokens=150, fan=3)
    for k in range(1, 13):
        new = {(rng.choice("st"), f"p{rng.randrange(25)}.md"): made(rng, k) for _ in range(rng.randrange(1, 7))}
        gone = rng.sample(sorted(rows), min(len(rows), rng.randrange(0, 3)))
        kept.upsert(pages_of(spark, new))
        rows |= new
        if gone and k % 2:
            kept.delete(spark.createDataFrame(gone, "space_id string, path string"))
            rows = {key: v for key, v in rows.items() if key not in gone}
    now = pages_of(spark, rows)
    assert {(r["space_id"], r["path"], r["title"], r["body"], r["modified_ns"]) for r in kept.pages().select("space_id", "path", "title", "body", "modified_ns").collect()} == {(*k, *v) for k, v in rows.items()}
    fresh = index.SearchIndex(spark, str(tmp_path / "j"))
    fresh.rebuild(now)
    assert {k: v for k, v in kept.facts().items() if k != "version"} == {k: v for k, v in fresh.facts().items() if k != "version"}
    m = kept.manifest()
    assert len(m["segments"]) < 12 and max(s["level"] for s in m["segments"]) >= 1
    for q in ("alpha", "rare", '"alpha beta"', "cafe zubr", "nothing"):
        one, two, scan = ([(r["space_id"], r["path"], round(r["score"], 9)) for r in x.collect()] for x in (kept.search(q), fresh.search(q), search.search(now, q)))
        assert one == two == scan, q
    links = lambda df: {tuple(r) for r in df.select("space_id", "source_path", "target").collect()}
    assert links(kept.links()) == links(graph.edges(now))
    broken = lambda df: {tuple(r) for r in df.select("space_id", "source_path", "source_title", "target").collect()}
    assert broken(kept.broken_links()) == broken(graph.broken_links(now, graph.edges(now)))


def test_a_search_reads_only_ranges_of_its_terms(spark, tmp_path):
    rng = random.Random(2)
    rows = {("s", f"p{k}.md"): ("T", " ".join(f"w{rng.randrange(3000):04d}" for _ in range(80)), 1) for k in range(200)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"), range_tokens=1000)
    kept.rebuild(pages_of(spark, rows))
    folder = tmp_path / "i" / "postings" / kept.manifest()["segments"][0]["id"]
    ranges = {p.name for p in folder.glob("range=*")}
    read = {f.rsplit("/", 2)[-2] for f in kept.postings(["w0007"]).inputFiles()}
    assert len(ranges) >= 15 and 1 <= len(read) <= 2
    more = {("s", f"n{k}.md"): ("T", "other words without that term", 1) for k in range(50)}
    kept.upsert(pages_of(spark, more))
    assert {f.rsplit("/", 2)[-2] for f in kept.postings(["w0007"]).inputFiles()} == read  # pages that lack the term add nothing to read
    assert not any("/docs/" in f for f in kept.search("w0007").inputFiles())


def test_an_upsert_writes_its_batch_only(spark, tmp_path):
    rng = random.Random(3)
    rows = {("s", f"p{k}.md"): ("T", " ".join(f"w{rng.randrange(9000)}" for _ in range(200)), 1) for k in range(100)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    kept.rebuild(pages_of(spark, rows))
    before = {p for p in (tmp_path / "i").rglob("*.parquet")}
    kept.upsert(pages_of(spark, {("s", "p1.md"): ("T", "gamma", 2)}))
    written = sum(p.stat().st_size for p in (tmp_path / "i").rglob("*.parquet") if p not in before)
    assert written < 0.05 * sum(p.stat().st_size for p in before) and kept.facts()["n_docs"] == 100
    assert [r["path"] for r in kept.search("gamma").collect()] == ["p1.md"]


def test_repeated_and_concurrent_commits(spark, tmp_path):
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    one = pages_of(spark, {("s", "a.md"): ("A", "alpha", 1)})
    assert kept.upsert(one, "stream", 4) == 1
    assert kept.upsert(pages_of(spark, {("s", "a.md"): ("A", "beta", 2)}), "stream", 4) == 1  # the number is in the index already
    assert kept.search("alpha").count() == 1
    stale = kept.manifest()
    assert kept.upsert(pages_of(spark, {("s", "b.md"): ("B", "beta", 1)}), "stream", 5) == 2
    with pytest.raises(index.ConcurrentCommit):
        kept._commit(stale, one, None)
    (tmp_path / "i" / "manifest" / "000000000003.json").write_text('{"version": 3, "segm')  # a writer which died
    assert kept.facts()["version"] == 2 and kept.search("beta").count() == 1


def test_repeated_keys_nulls_and_an_empty_batch(spark, tmp_path):
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    assert kept.upsert(spark.createDataFrame([], PAGES)) == 1 and kept.search("a").count() == 0
    kept.upsert(spark.createDataFrame([("s", "a.md", None, None, 1), ("s", "a.md", "A", "alpha", 3), ("s", "a.md", "A", "beta", 2)], PAGES))
    assert kept.search("alpha").count() == 1 and kept.search("beta").count() == 0 and kept.facts()["n_docs"] == 1


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_batches_equal_single_searches(spark, tmp_path, bits):
    rng = random.Random(bits)
    rows = {(rng.choice("st"), f"{rng.choice(['d/', ''])}p{k}.md"): made(rng, 1) for k in range(120)} | {("s", "index.md"): ("alpha", "alpha beta", 1)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"), range_tokens=500)
    kept.rebuild(pages_of(spark, rows))
    kept.upsert(pages_of(spark, dict(list(rows.items())[:7])))
    asked = ["alpha", "rare", "alpha beta", '"alpha beta"', "beta beta", "cafe", "CAFÉ long", "nothing", "", "  ", '"" alpha', "alpha gamma delta", "w", "alph"]
    queries = [(k, q, None) for k, q in enumerate(asked)] + [(100, "alpha", "s"), (101, None, None)]
    got = batch.search_batch(kept, spark.createDataFrame(queries, "query_id long, query string, space_id string"), 4, block_bits=bits)
    hits = {}
    for r in got.hits.collect():
        hits.setdefault(r["query_id"], set()).add((r["space_id"], r["path"], r["title"], r["title_match"], round(r["score"], 9)))
    for k, q, space in queries:
        want = {(r["space_id"], r["path"], r["title"], r["title_match"], round(r["score"], 9)) for r in kept.search(q or "", 4, space).collect()}
        assert hits.get(k, set()) == want, q
    counts = got.report.first()
    assert counts["scored_blocks"] <= counts["candidate_blocks"]
    if bits == 0:
        assert counts["scored_blocks"] < 0.8 * counts["candidate_blocks"]


def test_ten_thousand_queries_are_one_batch(spark, tmp_path):
    rng = random.Random(5)
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    kept.rebuild(pages_of(spark, {("s", f"p{k}.md"): made(rng, 1) for k in range(60)}))
    queries = spark.range(10_000).select(F.col("id").alias("query_id"), F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") % 10 + 1).cast("int")).alias("query"))
    got = batch.search_batch(kept, queries, 1).hits.groupBy((F.col("query_id") % 10).alias("w")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))
    assert all(r["n"] == 1000 and r["paths"] == 1 for r in got.collect())


def test_long_titles_are_stored_once_not_with_every_posting(spark, tmp_path):
    rng = random.Random(9)
    # a page of one line is its own title; texts do not repeat each other, so that compression hides nothing
    line = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(1500))
    rows = {("s", f"p{k}.md"): (line(), "", 1) for k in range(40)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    kept.rebuild(pages_of(spark, rows))
    text = sum(len(t) for t, _, _ in rows.values())
    assert "title" not in kept.postings().columns
    assert sum(p.stat().st_size for p in (tmp_path / "i").rglob("*.parquet")) < 5 * text
    word = rows[("s", "p3.md")][0].split()[7]
    assert [(r["path"], r["title_match"]) for r in kept.search(word).collect()] == [("p3.md", True)]


def test_scores_equal_when_rounded_are_ties_of_a_batch(spark, tmp_path):
    filler = {("s", f"x{k}.md"): (None, "word", 1) for k in range(20)}
    # "a" is longer, so its score is worse, but by less than the digits tell
    rows = filler | {("s", "a.md"): (None, "alpha long", 1), ("s", "b.md"): (None, "alpha", 1)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    kept.rebuild(pages_of(spark, rows))
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    best = lambda d: [r["path"] for r in batch.search_batch(kept, asked, 1, block_bits=0, digits=d).hits.collect()]
    assert best(None) == ["b.md"] and best(0) == ["a.md"]


def test_a_link_graph_without_postings(spark, tmp_path):
    rows = {("s", "a.md"): ("A", "[[b]] and [[c]]", 1), ("s", "b.md"): ("B", "alpha", 1)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"), texts=False, fan=2)
    for key, value in rows.items():
        kept.upsert(pages_of(spark, {key: value}))
    assert not (tmp_path / "i" / "postings").exists()
    assert {r["target"] for r in kept.broken_links().collect()} == {r["target"] for r in graph.broken_links(pages_of(spark, rows), graph.edges(pages_of(spark, rows))).collect()}
    with pytest.raises(ValueError):
        kept.search("alpha")


def test_a_batch_does_not_write_the_pages_which_match_its_queries(spark, tmp_path):
    """All of 300 pages match each of 435 queries: what is written follows pages and queries, not their product."""
    from quillspark.storage import shared_dir

    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    rows = {("s", f"p{k}.md"): ("T", " ".join(rng.sample(words, 30) + rng.choices(words, k=20)), 1) for k in range(300)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    kept.rebuild(pages_of(spark, rows))
    folder = Path(shared_dir(spark).removeprefix("file:")) / f"tables-{spark.sparkContext.applicationId}"
    before = set(folder.rglob("*.parquet"))
    pairs = [f"{a} {b}" for i, a in enumerate(words) for b in words[:i]]
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(pairs * 2)], "query_id long, query string")
    hits = batch.search_batch(kept, asked, 3).hits.collect()
    assert len(hits) == 2 * 3 * len(pairs)
    best = {r["path"] for r in kept.search(pairs[7], 3).collect()}
    assert {r["path"] for r in hits if r["query_id"] == 7} == {r["path"] for r in hits if r["query_id"] == 7 + len(pairs)} == best
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in set(folder.rglob("*.parquet")) - before) < 10_000


def test_hybrid_hits_do_not_write_the_pages_which_match_their_words(spark, tmp_path):
    from quillspark.operators import hybrid
    from quillspark.storage import shared_dir

    rng = random.Random(7)
    words = [f"w{k}" for k in range(30)]
    rows = {("s", f"p{k}.md"): ("T", " ".join(rng.sample(words, 30) + rng.choices(words, k=20)), 1) for k in range(300)}
    kept = index.SearchIndex(spark, str(tmp_path / "i"))
    kept.rebuild(pages_of(spark, rows))
    folder = Path(shared_dir(spark).removeprefix("file:")) / f"tables-{spark.sparkContext.applicationId}"
    before = set(folder.rglob("*.parquet"))
    pairs = [f"{a} {b}" for i, a in enumerate(words) for b in words[:i]]
    asked = spark.createDataFrame([(k, q, None) for k, q in enumerate(pairs)], "query_id long, query string, embedding array<double>")
    vectors = spark.createDataFrame([(0, "p0.md", [1.0, 0.0])], "vec_id long, path string, embedding array<double>")
    hits = hybrid.hybrid_search(kept, asked, vectors, 3).collect()
    assert len(hits) == 3 * len(pairs) and {r["origin"] for r in hits} == {"keyword"}
    best = [r["path"] for r in kept.search(pairs[7], 3).collect()]
    assert [f"{r['slug']}.md" for r in sorted(hits, key=lambda r: r["place"]) if r["query_id"] == 7] == best
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in set(folder.rglob("*.parquet")) - before) < 10_000
