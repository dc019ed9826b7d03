"""Queries of trees, merges, history over merges, and checks that depend on the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import changes, dirindex, history, trees, versions
from quillspark.plans.registry import query
from quillspark.plans.views import view
from quillspark.sources import files

_FLAT = """
    select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'modified' end as status
    from {kb_base} a full join {kb_draft} b on a.path = b.path where a.path is null or b.path is null or a.body <> b.body"""


def _trees(spark, sf_dir):
    return [trees.merkle(view(spark, sf_dir, n)) for n in ("kb_base", "kb_draft")]


@query("g2_tree_diff", _FLAT)
def tree_diff(spark, sf_dir):
    """Differences of two trees, from their roots down."""
    return trees.tree_diff(*_trees(spark, sf_dir)).changes


@query("k11_unchanged_trees", """
    select string_split(coalesce(a.path, b.path), '/')[1] as source, bool_or(a.body is distinct from b.body) as changed
    from {kb_base} a full join {kb_draft} b on a.path = b.path group by 1 having count(a.path) > 0 and count(b.path) > 0""")
def unchanged_trees(spark, sf_dir):
    """Whether a checkpoint of each source's directory would be a new tree."""
    one, two = (t.filter("depth = 1 and kind = 'directory'").select(F.col("path").alias("source"), F.col("hash").alias(n)) for t, n in zip(_trees(spark, sf_dir), ("old", "new"), strict=True))
    return one.join(two, "source").select("source", (F.col("old") != F.col("new")).alias("changed"))


_EDITED = {
    "base": "concat('a', chr(10), 'b', chr(10), 'c', chr(10), body, chr(10))",
    "draft": "concat(case when doc_id % 2 = 0 then 'A' else 'a' end, chr(10), 'b', chr(10), 'c', chr(10), body, chr(10))",
    "agent": "concat('a', chr(10), case when doc_id % 3 = 0 then 'B' else 'b' end, chr(10), case when doc_id % 3 = 1 then 'C' else 'c' end, chr(10), body, chr(10))",
}
_BOTH = "concat(case when doc_id % 2 = 0 then 'A' else 'a' end, chr(10), case when doc_id % 3 = 0 then 'B' else 'b' end, chr(10), case when doc_id % 3 = 1 then 'C' else 'c' end, chr(10), body, chr(10))"


@query("g3_adjacent_edits", f"""
    select path, case when doc_id % 2 = 0 and doc_id % 3 = 0 then 'conflict' when doc_id % 2 = 0 and doc_id % 3 = 1 then 'merged' when doc_id % 2 = 0 then 'keep_draft' when doc_id % 3 <> 2 then 'take_agent' else 'unchanged' end as state,
        sha256(case when doc_id % 2 = 0 and doc_id % 3 = 0 then {_EDITED['draft']} else {_BOTH} end) as sha from {{kb_page}}""")
def adjacent_edits(spark, sf_dir):
    """Edits of neighbouring lines conflict, edits with a kept line between them do not."""
    sides = [view(spark, sf_dir, "kb_page").select("path", F.expr(_EDITED[n]).alias("body")) for n in ("base", "draft", "agent")]
    return changes.merged(*sides).select("path", "state", F.sha2("body", 256).alias("sha"))


@query("g7_keep_diff", """
    with s as (select coalesce(a.path, b.path) as path, a.body as o, b.body as n from {kb_base} a full join {kb_draft} b on a.path = b.path where a.body is distinct from b.body),
         c as (select coalesce(a.path, b.path) as path, a.body as o, b.body as n from {kb_base} a full join {kb_agent} b on a.path = b.path where a.body is distinct from b.body)
    select coalesce(s.path, c.path) as path, s.path is null or c.path is null or s.n is distinct from c.n as stale from s full join c on s.path = c.path""")
def keep_diff(spark, sf_dir):
    """A review showed one diff and the files now have another: which of its paths are stale."""
    base, draft, agent = (view(spark, sf_dir, n) for n in ("kb_base", "kb_draft", "kb_agent"))
    return changes.stale_paths(versions.changes(base, agent), versions.changes(base, draft))


_COMMITS = [("c0", [], 0), ("c1", ["c0"], 10), ("c2", ["c0"], 20), ("c3", ["c1", "c2"], 30)]
_MERGED = "select coalesce(d.path, a.path) as path, case when right(coalesce(d.path, a.path), 4) in ('1.md', '4.md') then a.body else coalesce(d.body, a.body) end as body from {kb_draft} d full join {kb_agent} a on a.path = d.path"


@query("w2_last_change_over_merges", f"""
    with m as ({_MERGED}),
    h as (select 'c0' as id, path, body from {{kb_base}} union all select 'c1', path, body from {{kb_draft}} union all select 'c2', path, body from {{kb_agent}} union all select 'c3', path, body from m),
    p as (select unnest(['c0', 'c1', 'c2', 'c3']) as id, unnest([null, 'c0', 'c0', 'c1']) as parent)
    select h.path, max(h.id) as id from h join p on p.id = h.id left join h b on b.id = p.parent and b.path = h.path where h.body is not null and h.body is distinct from b.body group by h.path""")
def last_change_over_merges(spark, sf_dir):
    """Two branches from one commit and their merge."""
    draft, agent = view(spark, sf_dir, "kb_draft"), view(spark, sf_dir, "kb_agent")
    met = draft.withColumnRenamed("body", "d").join(agent.withColumnRenamed("body", "a"), "path", "full")
    taken = F.right("path", F.lit(4)).isin("1.md", "4.md")
    merged = met.select("path", F.when(taken, F.col("a")).otherwise(F.coalesce("d", "a")).alias("body"))
    blobs = None
    for name, tree in zip(("c0", "c1", "c2", "c3"), (view(spark, sf_dir, "kb_base"), draft, agent, merged), strict=True):
        rows = tree.filter("body is not null").select(F.lit(name).alias("id"), "path", versions.digest(F.col("body")).alias("blob"))
        blobs = rows if blobs is None else blobs.unionByName(rows)
    commits = spark.createDataFrame(_COMMITS, "id string, parents array<string>, committed_at long")
    return history.last_changes(commits, blobs, "c3")


@query("w3_checkpoint_chain", """
    with d as (select doc_id from {documents} where source = (select min(source) from {documents})),
    t as (select coalesce(max(doc_id) filter (where doc_id % 29 = 0), -1) as lost from d where doc_id < (select max(doc_id) from d where doc_id % 29 <> 0)),
    x as (select doc_id from d, t where doc_id > lost and doc_id <= (select max(doc_id) from d where doc_id % 29 <> 0))
    select cast(doc_id as varchar) as id, row_number() over (order by doc_id desc) - 1 as place from x""")
def checkpoint_chain(spark, sf_dir):
    """The documents of a source are a line of commits; the chain ends where one has lost its ref."""
    from pyspark.sql import Window

    docs = view(spark, sf_dir, "documents")
    line = docs.join(F.broadcast(docs.agg(F.min("source").alias("source"))), "source").select("doc_id")
    commits = line.select(F.col("doc_id").cast("string").alias("id"), F.lag("doc_id").over(Window.orderBy("doc_id")).cast("string").alias("parent"), (F.col("doc_id") % 29 != 0).alias("has_ref"))
    tip = line.filter("doc_id % 29 <> 0").agg(F.max("doc_id").cast("string")).first()[0]
    return changes.checkpoint_chain(commits, tip)


@query("s18_space_names", """
    with f as (select doc_id, concat(case doc_id % 3 when 0 then 'personal-' when 1 then 'general-' else 'team_' end, source, '-', cast(doc_id as varchar)) as slug from {kb_page})
    select slug, case doc_id % 3 when 0 then 'My Space' when 1 then 'General' else replace(replace(slug, '-', ' '), '_', ' ') end as name from f""")
def space_names(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "personal-").when(F.col("doc_id") % 3 == 1, "general-").otherwise("team_")
    slugs = view(spark, sf_dir, "kb_page").select(F.concat(kind, "source", F.lit("-"), F.col("doc_id").cast("string")).alias("slug"))
    return slugs.select("slug", files.space_name(F.col("slug")).alias("name"))


@query("k9_index_chunks", """
    with e as (select space_id, source as dir, concat('Page ', cast(doc_id as varchar)) as title, concat(cast(doc_id as varchar), '.md') as name from {kb_page}
               union all select distinct space_id, '' as dir, source as title, concat(source, '/') as name from {kb_page}),
    p as (select *, concat(chr(10), '* [', title, '](<', name, '>)') as line, (row_number() over (partition by space_id, dir order by lower(title), name) - 1) // 8 as chunk from e),
    c as (select space_id, dir, chunk, string_agg(line, '' order by lower(title), name) as text from p group by space_id, dir, chunk)
    select space_id, dir, cast(chunk as bigint) as chunk, sha256(text) as sha, cast(coalesce(sum(strlen(text)) over (partition by space_id, dir order by chunk rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from c""")
def index_chunks(spark, sf_dir):
    """The listings of all directories in chunks of eight entries."""
    return dirindex.chunks(view(spark, sf_dir, "kb_page_linked"), 8).select("space_id", "dir", "chunk", F.sha2("text", 256).alias("sha"), "offset")
