"""A stored search index and link graph, kept as segments which changes add to.

Layout of a folder, which all machines share:

* ``docs/<segment>``: pages with their number, length and body, in the order of a hash of their key;
* ``titles/<segment>``: space, path and title by page number, which hits are named from;
* ``postings/<segment>/range=r``: a row for each term of a page's field, which carries the
  page's number and length, in ranges of (term, number). A title may be a whole text, so it is no part of them;
* ``fences/<segment>``: the first and last term of each range;
* ``links/<segment>``: what the pages link to, in the order of the target;
* ``deleted/<commit>``: bitmaps over page numbers;
* ``manifest/<version>.json``: the segments and deletions that are valid, and the corpus statistics.

A commit writes one segment of the pages it adds and a bitmap of those it
replaces or drops, then the manifest, which only one writer can make; until
then nothing of it is seen. Page numbers never change, so segments of one
level are merged by reading them without what has been deleted.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import graph, ranks, search
from quillspark.storage import discard, file_names, materialize, read_text, write_new

#: Tokens of a range of postings, segments of a level before they are merged, keys by which page files are pruned.
RANGE_TOKENS, FAN, FEW_KEYS = 4_000_000, 8, 1000
#: Bytes of bitmaps up to which they are broadcast.
BITMAP_BYTES = 64 << 20
_DOCS = "space_id string, path string, title string, modified_ns long, n_tokens long, doc long, key long, body string"
_TITLES = "doc long, space_id string, path string, title string"
_POSTINGS = "term string, doc long, n_tokens long, field string, positions array<int>, tf long, range int"
_LINKS = "space_id string, source_path string, source_title string, target string, doc long"
_FENCES = "range int, low string, high string"
_EMPTY = {"version": 0, "segments": [], "deleted": [], "n_docs": 0, "n_tokens": 0, "next_doc": 0, "sources": {}}


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this index was read; its own changes are not in the index."""


def _key(space_id: str = "space_id", path: str = "path"):
    return F.xxhash64(space_id, path)


class SearchIndex:
    """The index below ``path``; without ``texts`` its segments have pages and links only. Pages are (space_id, path, title, body, modified_ns); (space_id, path) is their key.

    Of repeated keys in one batch the page with the greatest time counts, then
    the greatest body. Null titles and bodies have no terms.
    """

    def __init__(self, spark: SparkSession, path: str, range_tokens: int = RANGE_TOKENS, fan: int = FAN, texts: bool = True):
        self.spark, self.path, self.range_tokens, self.fan, self.texts = spark, path, range_tokens, fan, texts

    # --- what is valid ----------------------------------------------------------

    def manifest(self) -> dict:
        """The newest version that is whole."""
        for name in sorted(file_names(self.spark, f"{self.path}/manifest"), reverse=True):
            try:
                return json.loads(read_text(self.spark, f"{self.path}/manifest/{name}"))
            except json.JSONDecodeError:  # its writer died
                continue
        return dict(_EMPTY)

    def facts(self) -> dict | None:
        """version, n_docs and n_tokens of the newest version; None before the first."""
        m = self.manifest()
        return {k: m[k] for k in ("version", "n_docs", "n_tokens")} if m["version"] else None

    def _read(self, kind: str, schema: str, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{s['id']}" for s in segments])

    def _valid(self, df: DataFrame, m: dict) -> DataFrame:
        """Rows whose page number ``doc`` is in no deletion bitmap. Only bitmaps are read beside the rows."""
        if not m["deleted"]:
            return df
        held = self.spark.read.schema("bucket long, bitmap binary").parquet(*[f"{self.path}/deleted/{d}" for d in m["deleted"]])
        bitmaps = held.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        if m["next_doc"] // 8 <= BITMAP_BYTES:  # a bit for each page that ever was
            bitmaps = F.broadcast(bitmaps)
        at = F.bitmap_bit_position("doc")
        byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        joined = df.withColumn("bucket", F.bitmap_bucket_number("doc")).join(bitmaps, "bucket", "left")
        return joined.filter(F.col("bitmap").isNull() | (F.getbit(byte, (at % 8).cast("int")) == 0)).drop("bucket", "bitmap")

    def _docs(self, m: dict) -> DataFrame:
        return self._valid(self._read("docs", _DOCS, m["segments"]), m)

    def live(self) -> DataFrame:
        """(space_id, path, title, modified_ns, n_tokens) of all pages."""
        return self._docs(self.manifest()).select("space_id", "path", "title", "modified_ns", "n_tokens")

    def pages(self) -> DataFrame:
        return self._docs(self.manifest()).select("space_id", "path", "body", "title", "modified_ns")

    def links(self) -> DataFrame:
        """(space_id, source_path, source_title, target) of all pages, as they were scanned when they were taken in."""
        m = self.manifest()
        return self._valid(self._read("links", _LINKS, m["segments"]), m).drop("doc")

    def postings(self, terms: list[str] | None = None, m: dict | None = None) -> DataFrame:
        """Postings (term, doc, n_tokens, field, positions, tf) of all pages, of some terms or of all: only the ranges which can hold a term are read."""
        if not self.texts:
            raise ValueError("this index has no postings")
        m = m or self.manifest()
        wanted = f"{self.path}/postings"
        if terms is None:
            folders = [f"{wanted}/{s['id']}" for s in m["segments"]]
            found = lambda: reduce(DataFrame.unionByName, [self.spark.read.schema(_POSTINGS).parquet(f) for f in folders])
        else:
            fences = self._read_fences(m, terms)
            folders = [f"{wanted}/{s}/range={r}" for s, r in fences]
            plain = _POSTINGS.removesuffix(", range int")
            found = lambda: self.spark.read.schema(plain).parquet(*folders).filter(F.col("term").isin(*terms))
        return self._valid(found().drop("range"), m) if folders else self.spark.createDataFrame([], _POSTINGS).drop("range")

    def titles(self, m: dict | None = None) -> DataFrame:
        """(doc, space_id, path, title) of every page number, deleted ones too; what a page number is found by is valid already."""
        return self._read("titles", _TITLES, (m or self.manifest())["segments"])

    def _read_fences(self, m: dict, terms: list[str]) -> list[tuple[str, int]]:
        """(segment, range) of the ranges that can hold one of the terms; a row a range is read, and few are returned."""
        parts = [self._read("fences", _FENCES, [s]).withColumn("segment", F.lit(s["id"])) for s in m["segments"]]
        if not parts or not terms:
            return []
        asked = F.array(*[F.lit(t) for t in terms])
        rows = reduce(DataFrame.unionByName, parts).filter(F.exists(asked, lambda t: (F.col("low") <= t) & (t <= F.col("high"))))
        return sorted((r["segment"], r["range"]) for r in rows.select("segment", "range").collect())

    # --- changes ----------------------------------------------------------------

    def _located(self, m: dict, keys: DataFrame) -> DataFrame:
        """(doc, n_tokens) of the valid pages with these keys. Few keys skip most of each page file; bodies are not read."""
        docs = self._read("docs", _DOCS, m["segments"]).select("space_id", "path", "doc", "n_tokens", "key")
        some = keys.select(_key().alias("key")).limit(FEW_KEYS + 1).collect()
        if len(some) <= FEW_KEYS:
            docs = docs.filter(F.col("key").isin(*{r["key"] for r in some})) if some else docs.limit(0)
        return self._valid(docs.join(keys.select("space_id", "path").distinct(), ["space_id", "path"], "left_semi"), m).select("doc", "n_tokens")

    def _write_segment(self, docs: DataFrame, postings: DataFrame | None, links: DataFrame | None, spent: bool = False) -> dict:
        """Write ``docs`` with their postings and links, made from the bodies where they are not given. ``docs`` of their own table are deleted when ``spent``."""
        name = uuid.uuid4().hex
        size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
        ranges = max(1, -(-size["t"] // self.range_tokens))
        docs.repartitionByRange(ranges, "key").sortWithinPartitions("key").write.parquet(f"{self.path}/docs/{name}")
        if spent:
            discard(docs)
        stored = self._read("docs", _DOCS, [{"id": name}])
        if self.texts:
            titles = stored.select([c.split()[0] for c in _TITLES.split(", ")])
            titles.repartitionByRange(ranges, "doc").sortWithinPartitions("doc").write.parquet(f"{self.path}/titles/{name}")
            if postings is None:
                dealt_out = stored if ranges > 1 else stored.repartition(self.spark.sparkContext.defaultParallelism)
                postings = search.postings(dealt_out, ("doc", "n_tokens"))
            dealt = postings.repartitionByRange(ranges, "term", "doc").sortWithinPartitions("term", "doc").withColumn("range", F.spark_partition_id())
            folder = f"{self.path}/postings/{name}"
            columns = [c.split()[0] for c in _POSTINGS.split(", ")]
            dealt.select(columns).write.option("parquet.block.size", 1 << 20).partitionBy("range").parquet(folder)
            fences = self.spark.read.schema(_POSTINGS).parquet(folder).groupBy("range").agg(F.min("term").alias("low"), F.max("term").alias("high"))
            fences.coalesce(1).write.parquet(f"{self.path}/fences/{name}")
        if links is None:
            found = graph.edges(stored).withColumnRenamed("source_path", "path")
            named = stored.select("space_id", "path", text.index_title(F.col("body")).alias("source_title"), "doc")
            links = found.join(named, ["space_id", "path"]).withColumnRenamed("path", "source_path")
        ordered = links.select([c.split()[0] for c in _LINKS.split(", ")]).repartitionByRange(ranges, "space_id", "target").sortWithinPartitions("space_id", "target")
        ordered.write.parquet(f"{self.path}/links/{name}")
        return {"id": name, "n_docs": size["n"], "n_tokens": size["t"]}

    def _commit(self, m: dict, added: DataFrame | None, removed: DataFrame | None, source: tuple[str, int] | None = None) -> int:
        """Add pages and drop page numbers as one new version."""
        new = json.loads(json.dumps(m))
        new["version"] += 1
        if removed is not None:
            gone = materialize(removed.distinct(), "removed")
            size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
            if size["n"]:
                name = uuid.uuid4().hex
                bits = gone.groupBy(F.bitmap_bucket_number("doc").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc")).alias("bitmap"))
                bits.write.parquet(f"{self.path}/deleted/{name}")
                new["deleted"].append(name)
                new["n_docs"] -= size["n"]
                new["n_tokens"] -= size["t"]
        if added is not None:
            tokens = lambda c: F.size(text.tokens(F.coalesce(F.col(c), F.lit(""))))
            newest = Window.partitionBy("space_id", "path").orderBy(F.col("modified_ns").desc(), F.col("body").desc())
            once = added.select("space_id", "path", "title", "modified_ns", "body")
            # bodies are moved for this only if a key is repeated
            if not once.groupBy("space_id", "path").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
                once = once.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")
            counted = once.withColumn("n_tokens", (tokens("title") + tokens("body")).cast("long")).withColumn("key", _key())
            docs = ranks.numbered(counted, m["next_doc"]).select([c.split()[0] for c in _DOCS.split(", ")])
            segment = self._write_segment(docs, None, None, spent=True) | {"level": 0}
            new["next_doc"] += segment["n_docs"]
            new["n_docs"] += segment["n_docs"]
            new["n_tokens"] += segment["n_tokens"]
            if segment["n_docs"]:
                new["segments"].append(segment)
        if source is not None:
            new["sources"][source[0]] = source[1]
        return self._publish(new)

    def _publish(self, new: dict) -> int:
        if not write_new(self.spark, f"{self.path}/manifest/{new['version']:012d}.json", json.dumps(new)):
            raise ConcurrentCommit(f"version {new['version']} is another writer's")
        return new["version"]

    def merge(self) -> int:
        """Merge the segments of each level that has too many; returns the version that is valid then.

        What has been deleted is left out and nothing is tokenized again. Each
        page is rewritten once a level, so over its life about log(all pages) times.
        """
        m = self.manifest()
        level = 0
        while True:
            full = [s for s in m["segments"] if s["level"] == level]
            if not full and all(s["level"] < level for s in m["segments"]):
                return m["version"]
            if len(full) >= self.fan:
                docs = self._valid(self._read("docs", _DOCS, full), m)
                held = [self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings/{s['id']}") for s in full if self.texts]
                postings = self._valid(reduce(DataFrame.unionByName, held).drop("range"), m) if held else None
                links = self._valid(self._read("links", _LINKS, full), m)
                made = self._write_segment(docs, postings, links) | {"level": level + 1}
                m = json.loads(json.dumps(m))
                m["version"] += 1
                m["segments"] = [s for s in m["segments"] if s not in full] + ([made] if made["n_docs"] else [])
                m["deleted"] = [self._folded(m)] if len(m["deleted"]) > 1 else m["deleted"]
                self._publish(m)
            level += 1

    def _folded(self, m: dict) -> str:
        """One table of all deletion bitmaps."""
        name = uuid.uuid4().hex
        held = self.spark.read.schema("bucket long, bitmap binary").parquet(*[f"{self.path}/deleted/{d}" for d in m["deleted"]])
        held.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).write.parquet(f"{self.path}/deleted/{name}")
        return name

    def rebuild(self, pages: DataFrame, space_id: str | None = None) -> int:
        """Index all pages anew, of one space or of all; other spaces stay as they are. Returns the version."""
        m = self.manifest()
        if space_id is None:
            return self._commit(m | {"segments": [], "deleted": [], "n_docs": 0, "n_tokens": 0}, pages, None)
        return self._commit(m, pages.filter(F.col("space_id") == space_id), self._docs(m).filter(F.col("space_id") == space_id).select("doc", "n_tokens"))

    def refresh(self, seen: DataFrame) -> int:
        """Take in what differs from ``seen``, all pages as they are now: new and changed times, and deleted paths.

        Only bodies of changed pages are read. Nothing is written if nothing
        changed. Returns the version that is valid then.
        """
        m = self.manifest()
        held = self._docs(m).select("space_id", "path", "modified_ns", "doc", "n_tokens")
        keys = ["space_id", "path", "modified_ns"]
        times = materialize(seen.select(*keys), "seen")
        removed = materialize(held.join(times, keys, "left_anti").select("doc", "n_tokens"), "stale")
        changed = seen.join(held.select(*keys), keys, "left_anti")
        if m["version"] and removed.isEmpty() and changed.isEmpty():
            return m["version"]
        version = self._commit(m, changed, removed)
        return max(version, self.merge())

    def upsert(self, pages: DataFrame, source: str | None = None, number: int = 0) -> int:
        """Replace or add these pages; the others stay. What is written follows the batch, not the index.

        A batch of a numbered ``source`` which is in the index already, or an
        earlier one, is left out: the number is part of the version that the
        batch makes, so a batch repeated after a crash counts once.
        """
        m = self.manifest()
        if source is not None and m["sources"].get(source, -1) >= number:
            return m["version"]
        held = materialize(pages.select("space_id", "path", "title", "body", "modified_ns"), "upsert")
        version = self._commit(m, held, self._located(m, held), None if source is None else (source, number))
        return max(version, self.merge())

    def delete(self, paths: DataFrame) -> int:
        """Drop pages by (space_id, path)."""
        m = self.manifest()
        return self._commit(m, None, self._located(m, paths))

    # --- questions --------------------------------------------------------------

    def search(self, query: str, limit: int = 12, space_id: str | None = None) -> DataFrame:
        """As :func:`quillspark.operators.search.search`, from stored postings: only ranges of the query's terms, the bitmaps and titles are read."""
        m = self.manifest()
        terms = sorted({t for p in search.query_phrases(query) for t in p})
        found = self.postings(terms, m)
        return search.ranked(found, self.titles(m), ["doc"], query, m["n_docs"], m["n_tokens"] / max(1, m["n_docs"]), limit, space_id)

    def backlinks(self, target: str | None = None) -> DataFrame:
        """(space_id, target, source_path, source_title) from stored links, of one target or of all; reserved sources are left out."""
        found = self.links()
        return graph.named_links(found if target is None else found.filter(F.col("target") == target))

    def broken_links(self, targets: DataFrame | None = None) -> DataFrame:
        """As :func:`quillspark.operators.graph.broken_links`, from stored links; no body is read."""
        return graph.without_target(self.links(), self.live() if targets is None else targets)
