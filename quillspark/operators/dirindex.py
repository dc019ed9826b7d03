"""Generated directory indexes: a marked block of entries in bounded chunks, existing text around it kept."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import metadata, paths
from quillspark.operators import bundle, ranks
from quillspark.storage import materialize

START, END = "<!-- generated-index:start -->", "<!-- generated-index:end -->"
#: Entries of a chunk.
CHUNK = 1024


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, "\r\n", "  ")


def _label(text: Column) -> Column:
    return F.regexp_replace(_escaped(text), r"([\\\[\]])", r"\\$1")


def _target(name: Column) -> Column:
    for a, b in (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("?", "%3F"), ("#", "%23"), ("\r", "%0D"), ("\n", "%0A")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def entries(files: DataFrame) -> DataFrame:
    """(space_id, dir, title, name, line) of every concept page and sub-directory, by the directory that lists it.

    ``files`` (space_id, path, body). A page is called by its display title or
    else its stem, a directory by the title of its ``index.md`` or else its
    name, with ``/`` behind. Hidden names are left out; repeated paths count
    once.
    """
    seen = files.filter(~paths.is_hidden(F.col("path"))).groupBy("space_id", "path").agg(F.max("body").alias("body"))
    p = F.col("path")
    described = materialize(seen.filter(paths.is_markdown(p)).select("space_id", "path", metadata.display_metadata(F.coalesce("body", F.lit(""))).alias("m"), paths.kind(p).alias("kind")).select("space_id", "path", "kind", "m.*"), "described")
    stem = F.regexp_replace(paths.base_name(p), r"\.[^.]*$", "")
    pages = described.filter("kind = 'concept'").select("space_id", paths.parent(p).alias("dir"), F.coalesce("title", stem).alias("title"), paths.base_name(p).alias("name"), "description")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = seen.filter(F.size(parts) > 1).select("space_id", F.explode(above).alias("path")).distinct()
    own = described.filter(paths.base_name(p) == "index.md").select("space_id", paths.parent(p).alias("path"), "title")
    named = folders.join(own, ["space_id", "path"], "left").select("space_id", paths.parent(p).alias("dir"), F.coalesce("title", paths.base_name(p)).alias("title"), F.concat(paths.base_name(p), F.lit("/")).alias("name"), F.lit(None).cast("string").alias("description"))
    about = F.trim("description")
    line = F.concat(F.lit("\n* ["), _label(F.col("title")), F.lit("](<"), _target(F.col("name")), F.lit(">)"), F.when(about != "", F.concat(F.lit(" - "), _escaped(about))).otherwise(""))
    return pages.unionByName(named).select("space_id", "dir", "title", "name", line.alias("line"))


def chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """(space_id, dir, chunk, offset, text): the entries' lines of each directory in parts of at most ``size`` lines.

    Entries are ordered by title without case, then by name. Places come from
    range partitions over all directories and a chunk is grouped by itself, so
    a directory of any size is no list and no task. ``offset`` says how many
    bytes of the directory's listing stand before a chunk.
    """
    placed = ranks.placed(entries(files), [F.col("space_id"), F.col("dir"), F.lower("title"), F.col("name")])
    placed = materialize(placed, "entries")
    first = placed.groupBy("space_id", "dir").agg(F.min("place").alias("first"))
    at = F.floor((F.col("place") - F.col("first")) / size)
    lines = F.array_join(F.array_sort(F.collect_list(F.struct("place", "line")))["line"], "")
    made = materialize(placed.join(first, ["space_id", "dir"]).groupBy("space_id", "dir", at.alias("chunk")).agg(lines.alias("text")), "chunks")
    running = ranks.running(made, [F.col("space_id"), F.col("dir"), F.col("chunk")], F.octet_length("text"), "upto")
    begins = running.filter("chunk = 0").select("space_id", "dir", (F.col("upto") - F.octet_length("text")).alias("begin"))
    return running.join(begins, ["space_id", "dir"]).select("space_id", "dir", "chunk", (F.col("upto") - F.octet_length("text") - F.col("begin")).alias("offset"), "text")


def around(files: DataFrame) -> DataFrame:
    """(space_id, dir, head, tail): what stands before and after the entries of each directory's index.

    A marked block of an existing index is replaced where it is; without one it
    follows the text. Directories without an index get a heading. A block that
    is not closed is an error.
    """
    p = F.col("path")
    listed = entries(files).select("space_id", "dir").distinct()
    held = files.filter(paths.base_name(p) == "index.md").select("space_id", paths.parent(p).alias("dir"), F.coalesce("body", F.lit("")).alias("body"))
    title = F.when(F.col("dir") == "", "Knowledge").otherwise(paths.base_name(F.col("dir")))
    body = F.coalesce("body", bundle.folder_index(title))
    start = F.locate(START, F.col("b"))
    after = F.expr(f"locate('{END}', b, greatest(1, locate('{START}', b)))")
    marked = start > 0
    head = F.when(marked, F.substr("b", F.lit(1), start - 1)).otherwise(F.concat(F.regexp_replace("b", r"\s+$", ""), F.lit("\n\n")))
    tail = F.when(marked & (after == 0), F.raise_error(F.lit("a generated block has no closing marker"))).when(marked, F.substr("b", after + len(END))).otherwise("\n")
    joined = listed.join(held, ["space_id", "dir"], "left").withColumn("b", body)
    return joined.select("space_id", "dir", F.concat(head, F.lit(START)).alias("head"), F.concat(F.lit("\n" + END), tail).alias("tail"))


def write(files: DataFrame, root: str, size: int = CHUNK) -> DataFrame:
    """Write each directory's ``index.md`` below ``root``/space_id; returns (space_id, dir, n_bytes).

    Head, chunks and tail of a directory come to a task in order and go to a
    new file one by one, which then takes the old one's place. ``root`` is
    storage which all machines share.
    """
    ends = materialize(around(files), "around")
    part = lambda df, k, c: df.select("space_id", "dir", k.alias("chunk"), F.col(c).alias("text"))
    rows = part(ends, F.lit(-1).cast("long"), "head").unionByName(part(chunks(files, size), F.col("chunk"), "text")).unionByName(part(ends, F.lit((1 << 62)), "tail"))
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(n, "space_id", "dir").sortWithinPartitions("space_id", "dir", "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, out, size_ = None, None, 0

        def closed() -> pd.DataFrame:
            out.close()
            os.replace(out.name, out.name.removesuffix(f".{os.getpid()}"))
            return pd.DataFrame({"space_id": [key[0]], "dir": [key[1]], "n_bytes": [size_]})

        for b in batches:
            for space, folder, text in zip(b["space_id"], b["dir"], b["text"], strict=True):
                if (space, folder) != key:
                    if out:
                        yield closed()
                    key, size_ = (space, folder), 0
                    top = os.path.join(root, space, folder) if folder else os.path.join(root, space)
                    os.makedirs(top, exist_ok=True)
                    out = open(os.path.join(top, f"index.md.{os.getpid()}"), "wb")
                size_ += out.write(text.encode())
        if out:
            yield closed()

    return materialize(ordered.mapInPandas(run, "space_id string, dir string, n_bytes long"), "written")
