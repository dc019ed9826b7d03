"""Queries of the tree, comments, reviews, changes, bundles, ingest and small columns over the test tables.

The operators are those of :mod:`quillspark.operators`; the SQL beside each
states its rule anew for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import display, metadata, text
from quillspark.operators import assets, bundle, changes, comments, graph, ingest, ranks, review, tree, writes
from quillspark.plans.registry import query
from quillspark.plans.views import view
from quillspark.sources import formats


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A table made from the test tables and views, which the SQL names in braces."""
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in sorted(set(re.findall(r"\{(\w+)\}", sql)))})


# --- tree ---------------------------------------------------------------------

_SEEN = "select *, string_split(path, '/') as parts from {kb_file} where path not like '.%' and path not like '%/.%'"
_META = "case doc_id % 3 when 0 then concat('Title ', doc_id) when 1 then concat('Head ', doc_id) end as title, case when doc_id % 3 = 0 then concat('Short ', doc_id) end as summary"
_TREE = f"""
    seen as ({_SEEN}),
    dirs as (select distinct space_id, unnest(list_transform(range(1, len(parts)), lambda n: array_to_string(parts[1:n], '/'))) as path from seen),
    idx as (select space_id, regexp_replace(path, '/index.md$', '') as path, {_META} from seen where path like '%/index.md'),
    tree as (
        select d.space_id, d.path, 'folder' as kind, d.path as slug, coalesce(i.title, string_split(d.path, '/')[-1]) as title, coalesce(i.summary, '') as summary
        from dirs d left join idx i on i.space_id = d.space_id and i.path = d.path
        union all select space_id, path, 'page', regexp_replace(path, '\\.md$', ''), coalesce(title, regexp_replace(parts[-1], '\\.md$', '')), coalesce(summary, '')
        from (select *, {_META} from seen) x where path like '%.md' and path not like '%/index.md'
        union all select space_id, path, 'page', path, parts[-1], '' from seen where path like '%.html'),
    full_tree as (select space_id, path, case when path like '%/%' then regexp_replace(path, '/[^/]*$', '') else '' end as parent, kind, slug, title, summary, len(string_split(path, '/')) as depth from tree)"""


@query("s4_page_tree", f"with {_TREE} select * from full_tree")
def page_tree(spark, sf_dir):
    return tree.page_tree(view(spark, sf_dir, "kb_file"))


@query("t3_page_order", f"with {_TREE} select space_id, path, kind, row_number() over (order by space_id, parent, kind, lower(title), path) as place from full_tree")
def page_order(spark, sf_dir):
    return tree.in_order(tree.page_tree(view(spark, sf_dir, "kb_file"))).select("space_id", "path", "kind", "place")


@query("t5_deepest_first", f"with {_TREE} select space_id, path, depth, row_number() over (order by depth desc, space_id, path) as place from full_tree where kind = 'folder'")
def deepest_first(spark, sf_dir):
    dirs = tree.folders(view(spark, sf_dir, "kb_file"))
    return tree.deepest_first(dirs.filter(~F.col("path").startswith(".")))


@query("t7_first_page", f"with {_TREE} select space_id, arg_min(path, row(depth, kind, lower(title), path)) as path from full_tree where kind = 'page' group by space_id")
def first_page(spark, sf_dir):
    return tree.first_page(tree.page_tree(view(spark, sf_dir, "kb_file")))


@query("s5_source_listing", f"select space_id, substr(path, 13) as filename, coalesce(title, substr(path, 13)) as title from (select *, {_META} from {{kb_file}}) x where path like '.kb/sources/%'")
def source_listing(spark, sf_dir):
    return tree.source_listing(view(spark, sf_dir, "kb_file"))


@query("s6_page_by_path", "select 'index' as kind, count(*) as n, sum(length(body)) as chars from {kb_file} where doc_id = 80 union all select 'page', count(*), sum(length(body)) from {kb_file} where doc_id = 87")
def page_by_path(spark, sf_dir):
    files = view(spark, sf_dir, "kb_file")
    wanted = {r["doc_id"]: r for r in files.filter("doc_id in (80, 87)").select("doc_id", "space_id", "path").collect()}
    found = [tree.page_by_path(files, wanted[d]["space_id"], wanted[d]["path"]) for d in (80, 87)]
    found[1] = tree.page_by_slug(files, wanted[87]["space_id"], wanted[87]["path"].removesuffix(".md"))
    return found[0].unionByName(found[1]).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("body").cast("long")).alias("chars"))


_ENTRIES = "select space_id, path, case when doc_id % 2 = 0 then 'page' else 'folder' end as kind from {kb_page} union all select distinct space_id, source as path, case when source like '%1' then 'page' else 'folder' end as kind from {kb_page}"


@query("j13_tree_parents", f"with e as ({_ENTRIES}) select e.space_id, e.path, e.kind, coalesce(f.path, '') as parent from e left join e f on f.space_id = e.space_id and f.kind = 'folder' and f.path = case when e.path like '%/%' then regexp_replace(e.path, '/[^/]*$', '') else '' end")
def tree_parents(spark, sf_dir):
    return tree.with_parents(made(spark, sf_dir, _ENTRIES))


_MAIN = "select path, 'page' as kind from {kb_page} where doc_id % 3 = 0 union all select distinct concat('new', cast(doc_id % 7 as string)) as path, case when doc_id % 7 < 3 then 'page' else 'folder' end as kind from {kb_page}"
_DRAFT = "select path, 'page' as kind from {kb_page} where doc_id % 2 = 0 union all select concat('new', cast(doc_id % 9 as string), '/', cast(doc_id as string), '.md') as path, 'page' as kind from {kb_page} union all select distinct concat('new', cast(doc_id % 9 as string)) as path, 'folder' as kind from {kb_page}"


@query("u1_overlay_merge", f"""
    with m as ({_MAIN}), d as ({_DRAFT}) select path, kind, 'main' as origin from m union all select path, kind, 'draft' from d
    where not exists (select 1 from m where m.path = d.path) and not exists (select 1 from m where m.kind = 'page' and starts_with(d.path, concat(m.path, '/')) and m.path like 'new%')""")
def overlay(spark, sf_dir):
    return tree.overlay(made(spark, sf_dir, _MAIN), made(spark, sf_dir, _DRAFT))


# --- search views ---------------------------------------------------------------

@query("u3_hits_appended", """
    with k as (select path, regexp_replace(path, '\\.md$', '') as slug from {kb_page} where list_contains(string_split_regex(strip_accents(lower(body)), '[^\\p{L}\\p{N}]+'), 'from')),
    s as (select path, regexp_replace(path, '\\.md$', '') as slug from {kb_page} where list_contains(string_split_regex(strip_accents(lower(body)), '[^\\p{L}\\p{N}]+'), 'thon'))
    select slug, 'keyword' as kind from k union all select slug, 'semantic' from s where slug not in (select slug from k)""")
def hits_appended(spark, sf_dir):
    """Pages with one word stand for keyword hits, pages with another for semantic ones."""
    pages = view(spark, sf_dir, "kb_page")
    hits = lambda word: pages.filter(F.array_contains(text.tokens(F.col("body")), word)).select(display.concept_id(F.col("path")).alias("slug"), "path")
    keyword = hits("from").filter(display.is_searchable(F.col("path")))
    semantic = hits("thon").join(keyword.select("slug"), "slug", "left_anti")
    return keyword.select("slug", F.lit("keyword").alias("kind")).unionByName(semantic.select("slug", F.lit("semantic").alias("kind")))


@query("f7_ui_hits", "select path, case when path like '%index.md' or path like '.kb/sources/%' then null else regexp_replace(path, '\\.md$', '') end as slug from {kb_file}")
def ui_hits(spark, sf_dir):
    return view(spark, sf_dir, "kb_file").select("path", display.ui_slug(F.col("path")).alias("slug"))


@query("f16_searchable_paths", """
    select path, path ilike '%.md' and path not like '.%' and path not like '%/.%' as searchable, (path ilike '%.md' or path like '%.html') and path not like '.%' and path not like '%/.%' as page,
        regexp_replace(path, '\\.md$', '', 'i') as concept from {kb_file}""")
def searchable(spark, sf_dir):
    p = F.concat(F.lit("./"), "path")
    return view(spark, sf_dir, "kb_file").select("path", display.is_searchable(p).alias("searchable"), display.is_concept_page(p, F.lit("page")).alias("page"), display.concept_id(p).alias("concept"))


@query("f8_diagnostic_links", "select path, path not like '.%' and path not like '%/.%' and path not like '%/index.md' as source_ok, path like '.kb/sources/%' or (path not like '.%' and path not like '%/.%') as target_ok from {kb_file}")
def diagnostic(spark, sf_dir):
    p = F.col("path")
    return view(spark, sf_dir, "kb_file").select("path", graph.diagnostic(p, F.lit("a.md")).alias("source_ok"), graph.diagnostic(F.lit("a.md"), p).alias("target_ok"))


# --- comments -------------------------------------------------------------------

_COMMENTS = """
    select id, 's' as space_id, page_slug, user_id, concat(user_id, ' ', cast(conv_id % 9 as string)) as user_name, body, case when turn = 0 then concat('a', chr(10), 'b') end as source,
        case when turn = 0 then 1 end as start_line, case when turn = 0 then cast(1 + conv_id % 2 as int) end as end_line, parent_id, resolved, conv_id, conv_id * 100 + turn as created_at from {kb_comment}"""


@query("a2_members_by_last_name", f"select user_id, max(user_name) as user_name from ({_COMMENTS}) c group by user_id")
def members(spark, sf_dir):
    return comments.members(made(spark, sf_dir, _COMMENTS))


_STATES = "select id, case when conv_id % 5 = 0 then 'outdated' else 'anchored' end as state from {kb_comment} where parent_id is null and conv_id % 7 <> 0"


@query("a11_thread_partition", f"""
    with t as (select c.page_slug, case when c.resolved then 'resolved' else coalesce(a.state, 'outdated') end as part from {{kb_comment}} c left join ({_STATES}) a on a.id = c.id where c.parent_id is null)
    select page_slug, count(*) filter (part = 'anchored') as anchored, count(*) filter (part = 'outdated') as outdated, count(*) filter (part = 'resolved') as resolved, count(*) filter (part <> 'resolved') as open_count from t group by page_slug""")
def thread_partition(spark, sf_dir):
    return comments.open_counts(comments.threads(made(spark, sf_dir, _COMMENTS), made(spark, sf_dir, _STATES)))


_NEW = f"""
    select id, space_id, case when conv_id % 11 = 0 then '.hidden/x.md' else page_slug end as page_slug, user_id, user_name, case when conv_id % 13 = 0 then '  ' else body end as body,
        case when conv_id % 17 = 0 then null else source end as source, start_line, case when conv_id % 7 = 0 then end_line + 2 else end_line end as end_line,
        case when conv_id % 19 = 0 and parent_id is not null then 'gone' else parent_id end as parent_id, created_at, conv_id from ({_COMMENTS}) c"""


@query("k15_comment_checks", f"""
    select id, case when conv_id % 11 = 0 then 'page slug is not valid' when trim(body) = '' or length(trim(body)) > 10000 then 'body must have 1 to 10000 characters'
        when parent_id = 'gone' then 'the parent is not on this page' when parent_id is null and source is null then 'a source is required'
        when parent_id is null and end_line > 2 then 'lines are not within the source' end as error from ({_NEW}) n""")
def comment_checks(spark, sf_dir):
    stored = made(spark, sf_dir, _COMMENTS)
    return comments.checked(made(spark, sf_dir, _NEW), stored).select("id", "error")


@query("k15_comment_insert", f"""
    with ok as (select * from ({_NEW}) n where conv_id % 11 <> 0 and trim(body) <> '' and length(trim(body)) <= 10000 and parent_id is distinct from 'gone' and (parent_id is not null or (source is not null and end_line <= 2)))
    select 'comments' as kind, count(*) as n from ok union all select 'snapshots', count(distinct page_slug) from ok where parent_id is null""")
def comment_insert(spark, sf_dir):
    columns = "id, space_id, page_slug, user_id, user_name, body, content_hash, start_line, end_line, parent_id, resolved, created_at".split(", ")
    stored = made(spark, sf_dir, _COMMENTS).withColumn("content_hash", F.lit(None).cast("string")).select(*columns)
    new = made(spark, sf_dir, _NEW).withColumn("id", F.concat(F.lit("new:"), "id"))
    rows, shots = comments.inserted(new, stored, spark.createDataFrame([], "space_id string, page_slug string, content_hash string, source string"))
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(rows.filter(F.col("id").startswith("new:")), "comments").unionByName(n(shots, "snapshots"))


@query("s23_page_comments", f"select id, 'space' as workspace_slug, body from ({_COMMENTS}) c where page_slug = 'p3.md'")
def page_comments(spark, sf_dir):
    spaces = spark.createDataFrame([("s", "space")], "id string, slug string")
    return comments.listing(made(spark, sf_dir, _COMMENTS), spaces, "p3.md").select("id", "workspace_slug", "body")


# --- reviews --------------------------------------------------------------------

_PATCHES = """
    select concat('a/', path) as file_path, doc_id, concat('diff --git', chr(10), '--- a/x', chr(10), '+++ b/x', chr(10), '@@ -', cast(doc_id as string), ',3 +', cast(doc_id + 1 as string), ',4 @@ head', chr(10),
        ' one', chr(10), '-two', chr(10), '+three', chr(10), '+four', chr(10), ' five', chr(10), '\\ No newline at end of file', chr(10), '@@ -900000 +900001 @@', chr(10), '-six', chr(10), '+seven', chr(10), ' over') as patch from {kb_page}"""
_PATCH_SQL = _PATCHES.replace("'\\ No", "'\\\\ No")
_LINE_ROWS = """(values (1, 'ctx', 0, 0, 'one'), (1, 'del', 1, null, 'two'), (1, 'add', null, 1, 'three'), (1, 'add', null, 2, 'four'), (1, 'ctx', 2, 3, 'five'), (2, 'del', 900000, null, 'six'), (2, 'add', null, 900001, 'seven')) v(hunk, kind, o, n, t)"""
_LINES = f"""select path as file_path, hunk, kind, case when hunk = 1 then doc_id + o else o end as old_line, case when hunk = 1 then doc_id + 1 + n else n end as new_line, t as text from {{kb_page}}, {_LINE_ROWS}"""


@query("x16_patch_lines", _LINES)
def patch_lines(spark, sf_dir):
    patches = made(spark, sf_dir, _PATCH_SQL).withColumn("file_path", review.clean_path(F.col("file_path")))
    return review.patch_lines(patches).select("file_path", "hunk", "kind", "old_line", "new_line", "text")


_REVIEW_COMMENTS = "select cast(doc_id as string) as id, path as file_path, doc_id + doc_id % 4 as line_number from {kb_page}"


@query("j8_comment_lines", f"select c.id, l.file_path, l.kind, l.text from ({_LINES}) l join ({_REVIEW_COMMENTS}) c on c.file_path = l.file_path and c.line_number = case when l.kind = 'del' then l.old_line else l.new_line end")
def comment_lines(spark, sf_dir):
    patches = made(spark, sf_dir, _PATCH_SQL).withColumn("file_path", review.clean_path(F.col("file_path")))
    return review.inline_comments(review.patch_lines(patches), made(spark, sf_dir, _REVIEW_COMMENTS)).select("id", "file_path", "kind", "text")


@query("j12_diff_with_patch", "select path as file_path, 'modified' as status, case when doc_id % 2 = 0 then 2 else 0 end as hunks from {kb_page}")
def diff_with_patch(spark, sf_dir):
    files = made(spark, sf_dir, "select path as file_path, 'modified' as status from {kb_page}")
    return review.diff_files(files, made(spark, sf_dir, _PATCH_SQL).filter("doc_id % 2 = 0"))


_FACTS = """
    select id, id % 13 <> 0 as linked, id % 11 = 0 as rebasing, id % 7 = 0 as dirty, case id % 3 when 0 then 'status' when 1 then 'sync' else 'push' end as action,
        cast(id % 5 as string) as local_oid, case when id % 17 = 0 then null else cast(id % 4 as string) end as remote_oid, cast(id % 6 as string) as previous_oid,
        case when id % 19 = 0 then 2 else 0 end as conflicts, case id % 4 when 0 then null when 1 then 'Stale info' when 2 then null else 'network down' end as failure from {kb_submission}"""
_SYNC = """case when not linked then 'unlinked' when rebasing then 'conflicted' when dirty then 'dirty'
    when action = 'push' then case when failure is null then 'submitted' when lower(failure) like '%stale info%' then 'leaseRejected' end
    when action = 'sync' then case when conflicts > 0 then 'conflicted' when previous_oid = local_oid then 'upToDate' else 'synced' end
    when remote_oid is null or local_oid <> remote_oid then 'needsSync' else 'upToDate' end"""


@query("g9_sync_states", f"select id, {_SYNC} as state from ({_FACTS}) f")
def sync_states(spark, sf_dir):
    return review.sync_state(made(spark, sf_dir, _FACTS)).select("id", "state")


@query("x29_sync_labels", f"""
    select id, case when id % 23 = 0 then 'Cloud' when id % 29 = 0 then 'Local · Checking link' when state is null or state = 'unlinked' then 'Local only' when state = 'dirty' then 'Local + Cloud · Not uploaded'
        when state = 'submitted' then 'Local + Cloud · In review' when state = 'needsSync' then 'Local + Cloud · Cloud update' when state in ('conflicted', 'leaseRejected') then 'Local + Cloud · Attention' else 'Local + Cloud · Synced' end as label
    from (select id, {_SYNC} as state from ({_FACTS}) f) s""")
def sync_labels(spark, sf_dir):
    states = review.sync_state(made(spark, sf_dir, _FACTS))
    label = display.sync_label(F.col("id") % 23 != 0, F.col("id") % 29 != 0, F.col("state"), F.lit(False))
    return states.select("id", label["label"].alias("label"))


@query("j10_pending_invitations", "select concat('i', u.id) as invitation_id, u.id as user_id from {kb_member} u where u.id % 3 = 0")
def pending_invitations(spark, sf_dir):
    users = made(spark, sf_dir, "select id as user_id, concat('User', cast(id as string), '@x.org') as email from {kb_member}")
    sent = made(spark, sf_dir, "select concat('i', cast(id as string)) as invitation_id, concat('user', cast(id as string), '@x.org') as email, case when id % 3 = 0 then 'pending' else 'accepted' end as status from {kb_member}")
    return sent.filter("status = 'pending'").withColumn("email", F.lower("email")).join(users.withColumn("email", F.lower("email")), "email").select("invitation_id", "user_id")


# --- changes --------------------------------------------------------------------

_REFS = """
    select id, 'conflict' as kind from {kb_submission} where id % 5 = 0 union all select id, 'merged' as kind from {kb_submission} where status = 'merged'
    union all select id, 'discarded' as kind from {kb_submission} where id % 7 = 0"""
_CHANGES = "select id, case when id % 2 = 0 then concat('Agent Change: T', cast(id as string)) else 'other' end as summary, created_at from {kb_submission}"
_STATUS = "case when id % 7 = 0 then 'discarded' when status = 'merged' then 'merged' when id % 5 = 0 then 'needsResolution' else 'open' end"


@query("g5_status_precedence", f"select id, {_STATUS} as status from {{kb_submission}}")
def status_precedence(spark, sf_dir):
    return changes.status(made(spark, sf_dir, _REFS), made(spark, sf_dir, "select id from {kb_submission}"))


_WANTED = "select id, case when id % 2 = 0 then 'discarded' else 'merged' end as kind from {kb_submission} where id % 3 = 0"


@query("g13_transitions", f"""
    with s as (select id, {_STATUS} as status from {{kb_submission}}), w as ({_WANTED})
    select s.id, case when w.id is not null and s.status in ('open', 'needsResolution') then w.kind else s.status end as status, w.id is not null and s.status not in ('open', 'needsResolution') as refused
    from s left join w on w.id = s.id""")
def transitions(spark, sf_dir):
    ids = made(spark, sf_dir, "select id from {kb_submission}")
    after, refused = changes.transition(made(spark, sf_dir, _REFS), ids, made(spark, sf_dir, _WANTED))
    return changes.status(after, ids).join(refused.select("id", F.lit(True).alias("refused")), "id", "left").fillna(False, ["refused"])


_RECORDS = f"select s.id, case when s.id % 2 = 0 then concat('T', s.id) else 'Agent Change' end as title, {_STATUS.replace('id %', 's.id %')} as status, coalesce(f.n, 0) as files, s.created_at from {{kb_submission}} s left join (select submission_id, count(*) as n from {{kb_submission_file}} group by submission_id) f on f.submission_id = s.id"


def _records(spark, sf_dir):
    diffs = made(spark, sf_dir, "select submission_id as id, path from {kb_submission_file}")
    return changes.records(made(spark, sf_dir, _CHANGES), made(spark, sf_dir, _REFS), diffs)


@query("g14_change_records", f"select id, title, status, files from ({_RECORDS}) r")
def change_records(spark, sf_dir):
    return _records(spark, sf_dir).select("id", "title", "status", "files")


@query("t4_changes_newest_first", f"select id, title, row_number() over (order by case when status = 'open' then 0 else 1 end, created_at desc, id desc) as place from ({_RECORDS}) r")
def newest_first(spark, sf_dir):
    return changes.newest_first(_records(spark, sf_dir), F.col("status") == "open").select("id", "title", "place")


_BODY = "concat('top', chr(10), body, chr(10), 'end', chr(10))"
_VERSIONS = {
    "base": f"select path, {_BODY} as body from {{kb_page}}",
    "draft": f"select path, case when doc_id % 7 = 0 then concat('D', chr(10), {_BODY}) when doc_id % 13 = 0 then concat({_BODY}, 'x', chr(10)) else {_BODY} end as body from {{kb_page}}",
    "agent": f"select path, case when doc_id % 11 = 0 then concat({_BODY}, 'A', chr(10)) when doc_id % 5 = 0 then concat('B', chr(10), {_BODY}) else {_BODY} end as body from {{kb_page}}",
}
_DREW, _AGENT = "(doc_id % 7 = 0 or doc_id % 13 = 0)", "(doc_id % 11 = 0 or doc_id % 5 = 0)"
_CLASH = "((doc_id % 7 = 0 and doc_id % 11 <> 0 and doc_id % 5 = 0) or (doc_id % 7 <> 0 and doc_id % 13 = 0 and doc_id % 11 = 0))"
_D = f"case when doc_id % 7 = 0 then concat('D', chr(10), {_BODY}) when doc_id % 13 = 0 then concat({_BODY}, 'x', chr(10)) else {_BODY} end"
_MERGED_BODY = f"""case when {_CLASH} then {_D} else concat(case when doc_id % 7 = 0 then concat('D', chr(10)) when doc_id % 11 <> 0 and doc_id % 5 = 0 then concat('B', chr(10)) else '' end, {_BODY},
    case when doc_id % 7 <> 0 and doc_id % 13 = 0 then concat('x', chr(10)) when doc_id % 11 = 0 then concat('A', chr(10)) else '' end) end"""


def _three(spark, sf_dir):
    return [made(spark, sf_dir, _VERSIONS[n]) for n in ("base", "draft", "agent")]


@query("g3_line_merge", f"""
    select path, case when {_DREW} and {_AGENT} then case when {_CLASH} then 'conflict' else 'merged' end when {_DREW} then 'keep_draft' when {_AGENT} then 'take_agent' else 'unchanged' end as state,
        sha256({_MERGED_BODY}) as sha from {{kb_page}}""")
def line_merge(spark, sf_dir):
    return changes.merged(*_three(spark, sf_dir)).select("path", "state", F.sha2("body", 256).alias("sha"))


@query("g4_applied_transition", f"select path, sha256({_D}) as sha from {{kb_page}}")
def applied_transition(spark, sf_dir):
    base, draft, _ = _three(spark, sf_dir)
    return changes.apply_transition(base, base, draft).select("path", F.sha2("body", 256).alias("sha"))


_MESSAGE = "concat('Subject ', cast(doc_id as string), chr(10), chr(10), 'Agent: A', chr(10), case when doc_id % 4 = 0 then concat('note', chr(10)) else '' end, 'Agent-Change: C', cast(doc_id as string), chr(10), 'Agent-Task: T', chr(10), 'Agent: B', chr(10), 'Agent-Change: D', chr(10), 'Agent-Task: U v', chr(10))"


@query("a10_agent_trailers", "select doc_id, unnest(case when doc_id % 4 = 0 then ['B:D:U v'] else [concat('A:C', doc_id, ':T'), 'B:D:U v'] end) as trailer from {kb_page}")
def agent_trailers(spark, sf_dir):
    messages = made(spark, sf_dir, f"select doc_id, {_MESSAGE} as message from {{kb_page}}")
    each = messages.select("doc_id", F.explode(changes.trailers(F.col("message"))).alias("t"))
    return each.select("doc_id", F.concat_ws(":", "t.name", "t.change_id", "t.task").alias("trailer"))


_HISTORY = """
    select path, 0 as seq, sha2(body, 256) as blob from {kb_base} union all
    select coalesce(d.path, b.path) as path, 1 as seq, sha2(d.body, 256) as blob from {kb_base} b full join {kb_draft} d on b.path = d.path union all
    select coalesce(a.path, x.path) as path, 2 as seq, sha2(a.body, 256) as blob from (select path from {kb_base} union select path from {kb_draft}) x full join {kb_agent} a on x.path = a.path"""


@query("w2_last_change", f"""
    with h as ({_HISTORY.replace('sha2(body, 256)', 'sha256(body)').replace('sha2(d.body, 256)', 'sha256(d.body)').replace('sha2(a.body, 256)', 'sha256(a.body)')}),
    c as (select path, seq, blob, lag(blob) over (partition by path order by seq) as before from h)
    select path, max(seq) as seq from c where blob is not null and blob is distinct from before group by path""")
def last_change(spark, sf_dir):
    return changes.last_change(made(spark, sf_dir, _HISTORY))


# --- bundles and ingest -----------------------------------------------------------

@query("f13_needs_migration", """
    select space_id, true as needs_migration, false as newer from {kb_file} where space_id <> 'en' group by space_id union all
    select 'en' as space_id, false as needs_migration, true as newer""")
def needs_migration(spark, sf_dir):
    root = spark.createDataFrame([("en", "index.md", '---\nformat_version: "9"\n---\n# K\n')], "space_id string, path string, body string")
    files = view(spark, sf_dir, "kb_file").select("space_id", "path", "body")
    return bundle.needs_migration(files.unionByName(root)).filter(F.col("space_id").isNotNull())


_OLD = "select space_id, concat('sources/', case doc_id % 5 when 0 then '.gitkeep' when 1 then concat(cast(doc_id as string), '.md') when 2 then concat(cast(doc_id as string), '/index.md') else concat(cast(doc_id as string), '.txt') end) as path, case when doc_id % 5 = 0 then ' ' else body end as body, doc_id from {kb_page} where doc_id % 5 <> 0 or doc_id < 5"
_TAKEN = "select space_id, concat('.kb/sources/', cast(doc_id as string), '.md') as path from {kb_page} where doc_id % 2 = 0"


@query("k13_source_moves", f"""
    with o as ({_OLD}) select space_id, path, case when doc_id % 5 = 0 then 'remove' when doc_id % 5 = 1 and doc_id % 2 = 0 then 'archive' else 'move' end as action,
        case when doc_id % 5 = 0 then null when doc_id % 5 = 1 and doc_id % 2 = 0 then concat('.kb/legacy/source-collisions/', doc_id, '.md.legacy')
             when doc_id % 5 = 1 then concat('.kb/sources/', doc_id, '.md') else concat('.kb/sources/_encoded/', sha256(substr(path, 9)), '.md') end as target from o""")
def source_moves(spark, sf_dir):
    return bundle.source_moves(made(spark, sf_dir, _OLD), made(spark, sf_dir, _TAKEN))


@query("k12_archived", "select space_id, concat('sources/', doc_id, '.md') as path, concat('.kb/legacy/source-collisions/', doc_id, '.md.legacy', case when doc_id % 4 = 0 then '.1' else '' end) as target from {kb_page} where doc_id % 10 = 6")
def archived(spark, sf_dir):
    moves = bundle.source_moves(made(spark, sf_dir, _OLD), made(spark, sf_dir, _TAKEN))
    stored = made(spark, sf_dir, "select space_id, concat('.kb/legacy/source-collisions/', cast(doc_id as string), '.md.legacy') as path from {kb_page} where doc_id % 4 = 0")
    return bundle.archived(moves, stored).select("space_id", "path", "target")


@query("k14_prepared_bundles", "select space_id, true as conforms, false as needs_migration from {kb_file} group by space_id")
def prepared(spark, sf_dir):
    files = view(spark, sf_dir, "kb_file").select("space_id", "path", "body")
    after = bundle.prepared(files, "2026-01-31")
    p, b = F.col("path"), F.col("body")
    fine = after.filter(bundle.judged(p)).groupBy("space_id").agg(F.min(bundle.conforms(p, b)).alias("conforms"))
    return fine.join(bundle.needs_migration(after).select("space_id", "needs_migration"), "space_id")


@query("k16_generated_documents", "select distinct source, sha256(concat('# ', source, chr(10))) as folder_sha, sha256(concat('# Directory Update Log', chr(10), chr(10), '## 2026-01-31', chr(10), '* **Migration**: Preserved the legacy log from `', source, '/log.md` under `.kb/legacy/`.', chr(10))) as log_sha from {kb_page}")
def generated(spark, sf_dir):
    s = F.col("source")
    log = bundle.replacement_log(F.concat(s, F.lit("/log.md")), "2026-01-31")
    return view(spark, sf_dir, "kb_page").select("source").distinct().select("source", F.sha2(bundle.folder_index(s), 256).alias("folder_sha"), F.sha2(log, 256).alias("log_sha"))


@query("f23_staged_paths", "select path, path like '%/index.md' as artifact from {kb_file} where path like '%.md'")
def staged(spark, sf_dir):
    files = view(spark, sf_dir, "kb_file").select("path")
    artifacts = bundle.staged(files, True).select("path", F.lit(True).alias("artifact"))
    return bundle.staged(files).join(artifacts, "path", "left").fillna(False, ["artifact"])


_INCOMING = "select doc_id as arrival, lang as space_id, concat('Page ', cast(doc_id % 7 as string), '.md') as name, case when doc_id % 4 = 0 then null else sha2(text, 256) end as content_hash, case when doc_id % 4 = 0 or doc_id % 3 = 0 then null else concat('https://x/', cast(doc_id % 3 as string)) end as source_url from {documents}"
_STORED = "select distinct lang as space_id, '.kb/sources/page-3.md' as path, 'h' as content_hash, cast(null as string) as source_url from {documents}"


def _suffix_level(n: int, before: str) -> str:
    """One more suffix: what is left after ``before`` takes or meets the name with ``n`` digits."""
    return f"""
        t{n} as (select *, concat(stem, '-', substr(content_hash, 1, {n})) as nm from {before}),
        w{n} as (select space_id, nm, min(arrival) as a, arg_min(row(content_hash, coalesce(source_url, '-')), arrival) as w from t{n} group by space_id, nm),
        g{n} as (select t.arrival, t.space_id, t.nm, t.arrival <> w.a as reused from t{n} t join w{n} w on w.space_id = t.space_id and w.nm = t.nm where w.w = row(t.content_hash, coalesce(t.source_url, '-'))),
        r{n} as (select arrival, space_id, stem, content_hash, source_url from t{n} where arrival not in (select arrival from g{n}))"""


@query("w6_collision_suffix", f"""
    with i as (select arrival, space_id, concat('page-', arrival % 7) as stem, content_hash, source_url from ({_INCOMING.replace('sha2(text, 256)', 'sha256(text)')}) x),
    w0 as (select space_id, stem, min(arrival) as a, arg_min(row(coalesce(content_hash, '-'), coalesce(source_url, '-')), arrival) as w from i where stem <> 'page-3' group by space_id, stem),
    g0 as (select i.arrival, i.space_id, i.stem as nm, i.arrival <> w0.a as reused from i join w0 on w0.space_id = i.space_id and w0.stem = i.stem where i.arrival = w0.a or (i.content_hash is not null and w0.w = row(i.content_hash, coalesce(i.source_url, '-')))),
    r0 as (select * from i where content_hash is not null and arrival not in (select arrival from g0)),
    tx as (select arrival, space_id, concat(stem, '-', substr(sha256(concat(space_id, ':', stem, ':', arrival)), 1, 8)) as nm, false as reused from i where content_hash is null and arrival not in (select arrival from g0)),
    {_suffix_level(8, 'r0')}, {_suffix_level(16, 'r8')}, {_suffix_level(32, 'r16')}
    select arrival, space_id, concat('.kb/sources/', nm, '.md') as path, reused from (select * from g0 union all select * from tx union all select * from g8 union all select * from g16 union all select * from g32) u""")
def collision_suffix(spark, sf_dir):
    return ingest.named(made(spark, sf_dir, _INCOMING), made(spark, sf_dir, _STORED))


@query("s21_ingested_text", "select doc_id as arrival, concat('N', doc_id) as title, sha256(concat('---', chr(10), 'title: \"N', doc_id, '\"', chr(10), 'type: Source', chr(10), '---', chr(10), chr(10), trim(text), chr(10))) as sha from {documents}")
def ingested_text(spark, sf_dir):
    entries = made(spark, sf_dir, "select doc_id as arrival, lang as space_id, 'text' as source_type, text as content, concat('N', cast(doc_id as string)) as filename, cast(null as string) as url from {documents}")
    docs = ingest.routed(entries)
    names = ingest.named(docs, made(spark, sf_dir, _STORED))
    files = ingest.stored(docs, names, "2026-01-31T00:00:00Z")
    at = names.join(files, ["space_id", "path"]).join(docs.select("arrival", "title"), "arrival")
    return at.select("arrival", "title", F.sha2("body", 256).alias("sha"))


@query("s21_ingested_pages", "select page_id as arrival, trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) as title, url as source_url, true as hashed from {pages}")
def ingested_pages(spark, sf_dir):
    entries = view(spark, sf_dir, "pages").select(F.col("page_id").alias("arrival"), F.lit("s").alias("space_id"), F.lit("url").alias("source_type"), F.col("html").alias("content"), F.lit(None).cast("string").alias("filename"), "url")
    docs = ingest.routed(entries)
    return docs.select("arrival", "title", "source_url", (F.col("content_hash") == F.sha2("body", 256)).alias("hashed"))


# --- assets ---------------------------------------------------------------------

_HTML = "select concat('site', cast(page_id % 3 as string), '/p', cast(page_id as string), '.html') as path, concat('<link rel=\"stylesheet\" href=\"s.css\"><img src=\"img/a', cast(page_id % 9 as string), '.png\"><img src=''../out.png''><div style=\"background:url(b%20c.jpg)\"><script src=\"https://x.org/y.js\"></script><img src=\"n.exe\">') as body, page_id from {pages}"
_ASSETS = "select concat('site', cast(page_id % 3 as string), '/', case page_id % 4 when 0 then 's.css' when 1 then 'b c.jpg' else concat('img/a', cast(page_id % 9 as string), '.png') end) as path, max(case when page_id % 9 = 5 then 9000000 else 100 end) as size from {pages} group by 1"


@query("s17_asset_audit", f"""
    with h as ({_HTML}), a as ({_ASSETS}), r as (
        select path, unnest(['s.css', concat('img/a', page_id % 9, '.png'), 'b%20c.jpg', '../out.png', 'https://x.org/y.js', 'n.exe']) as reference, concat('site', page_id % 3, '/') as folder from h)
    select r.path, r.reference, case when r.reference in ('../out.png', 'https://x.org/y.js') then 'outside' when r.reference = 'n.exe' then 'unsupported' when a.path is null then 'missing' when a.size > 8388608 then 'too large' else 'ok' end as state
    from r left join a on a.path = concat(r.folder, replace(r.reference, '%20', ' '))""")
def asset_audit(spark, sf_dir):
    return assets.audit(made(spark, sf_dir, _HTML), made(spark, sf_dir, _ASSETS)).select("path", "reference", "state")


_READS = "select page_id, concat('d/', case when page_id % 7 = 0 then 'x.md' else 'x.html' end) as document, case page_id % 5 when 0 then 'd/a.png' when 1 then 'e/a.png' when 2 then 'd/.h/a.png' when 3 then 'd/a.exe' else 'd/../a.png' end as asset, case when page_id % 11 = 0 then cast(null as bigint) when page_id % 13 = 0 then cast(9000000 as bigint) else cast(10 as bigint) end as size, page_id % 17 = 0 as is_symlink from {pages}"


@query("s16_asset_reads", f"""
    select page_id, case when page_id % 7 = 0 then 'not an HTML document' when page_id % 5 = 4 then 'invalid path' when page_id % 5 = 1 then 'outside of the document''s folder' when page_id % 5 = 3 then 'unsupported type'
        when page_id % 5 = 2 then 'hidden' when is_symlink then 'symbolic link' when size is null then 'not a file' when size > 8388608 then 'too large' end as error from ({_READS}) r""")
def asset_reads(spark, sf_dir):
    return made(spark, sf_dir, _READS).select("page_id", assets.read_error(F.col("document"), F.col("asset"), F.col("size"), F.col("is_symlink")).alias("error"))


@query("w5_asset_budget", "select page_id, sum(length(html)) over (order by page_id rows between unbounded preceding and current row) <= 2000000 as kept from {pages}")
def asset_budget(spark, sf_dir):
    return ranks.running(view(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n")), [F.col("page_id")], F.col("n")).select("page_id", (F.col("running") <= 2_000_000).alias("kept"))


# --- small columns ----------------------------------------------------------------

@query("f2_display_metadata", f"select path, title, summary as description from (select *, {_META} from {{kb_file}}) x")
def display_metadata(spark, sf_dir):
    return view(spark, sf_dir, "kb_file").select("path", metadata.display_metadata(F.col("body")).alias("m")).select("path", "m.title", "m.description")


@query("f3b_editable_parts", "select path, case when doc_id % 3 = 0 then length(body) - 4 else 0 end as front, case when doc_id % 3 = 0 then 'Text' else body end as rest from {kb_file}")
def editable_parts(spark, sf_dir):
    b = F.col("body")
    return view(spark, sf_dir, "kb_file").select("path", F.length(display.system_front_matter(b)).cast("long").alias("front"), display.editable_body(b).alias("rest"))


@query("f19_portable_links", """
    select doc_id, case when doc_id % 5 = 0 then 'server' when doc_id % 7 = 0 then 'space_id' when doc_id % 11 = 0 then 'git_url' when doc_id % 13 = 0 then 'user_ref' end as error from {documents}""")
def portable_links(spark, sf_dir):
    d = made(spark, sf_dir, "select doc_id, case when doc_id % 5 = 0 then 'https://x.org/path' else 'https://x.org' end as server, case when doc_id % 7 = 0 then 'nope' else '123e4567-e89b-12d3-a456-426614174000' end as space_id, case when doc_id % 11 = 0 then 'https://me:pw@x.org/r.git' else 'https://x.org/r.git' end as git_url, case when doc_id % 13 = 0 then 'team/123e4567-e89b-12d3-a456-426614174000' else 'user/123e4567-e89b-12d3-a456-426614174000' end as user_ref from {documents}")
    return d.select("doc_id", display.portable_link_error(*[F.col(c) for c in ("server", "space_id", "git_url", "user_ref")]).alias("error"))


_NOW = "cast('2027-01-01 00:00:00' as timestamp)"


@query("x21_relative_times", f"""
    with s as (select id, date_diff('second', created_at, {_NOW}) as s from {{kb_notification}})
    select id, case when s < 60 then concat(greatest(s, 0), 's ago') when s < 3600 then concat(s // 60, 'm ago') when s < 86400 then concat(s // 3600, 'h ago') else concat(s // 86400, 'd ago') end as ago,
        case when s < 60 then 'now' when s < 3600 then concat(s // 60, 'm') when s < 86400 then concat(s // 3600, 'h') else concat(s // 86400, 'd') end as short from s""")
def relative_times(spark, sf_dir):
    now = F.expr(_NOW)
    at = F.date_trunc("second", "created_at")
    return view(spark, sf_dir, "kb_notification").select("id", display.time_ago(at, now).alias("ago"), display.comment_time(at, now).alias("short"))


@query("x22_ordinal_timestamps", """
    select doc_id, strftime(timestamp '2026-01-01 00:00:00' + to_days(cast(doc_id % 365 as integer)) + to_hours(cast(doc_id % 24 - (doc_id % 3 - 1) as bigint)) + to_minutes(cast(doc_id % 60 - 30 * sign(doc_id % 3 - 1) as bigint)) + to_seconds(7), '%Y-%m-%dT%H:%M:%S.123Z') as iso from {documents}""")
def ordinal_timestamps(spark, sf_dir):
    parts = F.array(*[F.lit(2026).cast("long"), F.col("doc_id") % 365 + 1, F.col("doc_id") % 24, F.col("doc_id") % 60, F.lit(7).cast("long"), F.lit(123_456_789).cast("long"), F.col("doc_id") % 3 - 1, F.when(F.col("doc_id") % 3 == 1, 0).otherwise(30).cast("long")])
    return view(spark, sf_dir, "documents").select("doc_id", display.ordinal_timestamp(parts).alias("iso"))


@query("x23_highlights", "select doc_id, sha256(regexp_replace(text, '(a\\.)', '<mark>\\1</mark>', 'gi')) as sha from {documents}")
def highlights(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", F.sha2(display.highlighted(F.col("text"), " A. "), 256).alias("sha"))


@query("x24_avatars", """
    select path, list_sum(list_transform(string_split(path, ''), lambda c: unicode(c))) as codes,
        upper(substr(source, 1, 1)) as member, case when source = '' then '?' else upper(substr(source, 1, 2)) end as comment from {kb_page}""")
def avatars(spark, sf_dir):
    return view(spark, sf_dir, "kb_page").select("path", display.char_code_hash(F.col("path")).alias("codes"), display.avatar_initials(F.col("source"), "member").alias("member"), display.avatar_initials(F.col("source"), "comment").alias("comment"))


@query("x26_slugs", "select path, regexp_replace(path, '\\.md$', '') as slug, concat('/my%20space/', replace(path, ' ', '%20')) as route from {kb_page}")
def slugs(spark, sf_dir):
    from quillspark.functions import paths

    p = F.col("path")
    return view(spark, sf_dir, "kb_page").select("path", paths.slug(p).alias("slug"), display.page_route(F.lit("my space"), p).alias("route"))


@query("x35_mention_queries", "select id, case when length(name) >= 3 then substr(name, 1, 3) else name end as query from {kb_member}")
def mention_queries(spark, sf_dir):
    return view(spark, sf_dir, "kb_member").select("id", display.mention_query(F.concat(F.lit("to @"), "name"), F.lit(7)).alias("query"))


@query("t6_mentions", "select prefix, id, name from (select 'customer#00000000' || p as prefix, id, name, row_number() over (partition by p order by name, id) as k from {kb_member}, (values ('1'), ('2')) v(p) where starts_with(lower(name), 'customer#00000000' || p)) x where k <= 5")
def mentions(spark, sf_dir):
    found = [view(spark, sf_dir, "kb_member").filter(F.lower("name").startswith(p)).orderBy("name", "id").limit(5).select(F.lit(p).alias("prefix"), "id", "name") for p in ("customer#000000001", "customer#000000002")]
    return found[0].unionByName(found[1])


@query("x37_source_titles", """
    select doc_id, case when doc_id % 5 = 0 then 'Loaded' when doc_id % 3 = 0 then concat('Title ', doc_id) when doc_id % 3 = 1 then concat('Head ', doc_id) else concat('file ', doc_id) end as title from {kb_file}""")
def source_titles(spark, sf_dir):
    loaded = F.when(F.col("doc_id") % 5 == 0, "Loaded").otherwise("")
    path = F.concat(F.lit(".kb/sources/file_-"), "doc_id", F.lit(".md"))
    return view(spark, sf_dir, "kb_file").select("doc_id", display.source_title(loaded, F.col("body"), path).alias("title"))


@query("x38_space_names", "select distinct source, concat('My ', source) as name, concat('my-', source) as slug, case when source like '%1' then 'My Space' else replace(replace(source, '-', ' '), '_', ' ') end as legacy from {kb_page}")
def space_names(spark, sf_dir):
    s = view(spark, sf_dir, "kb_page").select("source").distinct()
    local = F.concat(F.lit("C:\\Users\\x/My "), "source", F.lit("//"))
    legacy = display.legacy_space_name(F.when(F.col("source").endswith("1"), F.concat(F.lit("personal-"), "source")).otherwise(F.col("source")))
    return s.select("source", display.space_name(local).alias("name"), display.space_slug(local).alias("slug"), legacy.alias("legacy"))


@query("a12_ingest_outcome", "select count(*) filter (ext in ('doc', 'pdf')) as failed, count(*) as total from (select case doc_id % 5 when 0 then 'md' when 1 then 'csv' when 2 then 'doc' when 3 then 'txt' else 'pdf' end as ext from {kb_page}) x")
def ingest_outcome(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("md", "csv", "doc", "txt", "pdf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = view(spark, sf_dir, "kb_page").select(ext.alias("extension"), F.encode("body", "UTF-8").alias("content"))
    return formats.extracted(files).agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("total"))


# --- writes ---------------------------------------------------------------------

_LINKED = "select id, cast(id * 10 as bigint) as linked_at, cast(id * 10 as bigint) as updated_at, concat('u', cast(id as string)) as url from {kb_space} where id % 2 = 0"
_RELINK = "select id, cast(id * 100 as bigint) as linked_at, cast(id * 100 as bigint) as updated_at, concat('v', cast(id as string)) as url from {kb_space} where id % 3 = 0"


@query("k1_upsert_pages", "select path, sha256(body) as sha from {kb_draft} union all select b.path, sha256(b.body) from {kb_base} b where not exists (select 1 from {kb_draft} d where d.path = b.path)")
def upsert_pages(spark, sf_dir):
    return writes.upsert(view(spark, sf_dir, "kb_base"), view(spark, sf_dir, "kb_draft"), ["path"]).select("path", F.sha2("body", 256).alias("sha"))


@query("k3_insert_or_ignore", "select path, min(origin) as origin from (select path, 1 as origin from {kb_base} union all select path, 2 as origin from {kb_agent}) x group by path")
def insert_or_ignore(spark, sf_dir):
    table = made(spark, sf_dir, "select path, 1 as origin from {kb_base}")
    return writes.insert_or_ignore(table, made(spark, sf_dir, "select path, 2 as origin from {kb_agent} union all select path, 3 as origin from {kb_agent}"), ["path"])


@query("k4_upsert_keeps_linked_at", f"select coalesce(n.id, o.id) as id, coalesce(o.linked_at, n.linked_at) as linked_at, coalesce(n.updated_at, o.updated_at) as updated_at, coalesce(n.url, o.url) as url from ({_LINKED}) o full join ({_RELINK}) n on o.id = n.id")
def upsert_links(spark, sf_dir):
    return writes.upsert(made(spark, sf_dir, _LINKED), made(spark, sf_dir, _RELINK), ["id"], ("linked_at",))


@query("k5_cascade_delete", "select id from {kb_comment} where not resolved")
def cascade_delete(spark, sf_dir):
    stored = view(spark, sf_dir, "kb_comment").select("id", "parent_id")
    return writes.cascade_delete(stored, made(spark, sf_dir, "select id from {kb_comment} where parent_id is null and resolved")).select("id")


@query("k6_resolve", "select id, resolved or (parent_id is null and conv_id % 2 = 0) as resolved from {kb_comment}")
def resolve(spark, sf_dir):
    return writes.set_resolved(view(spark, sf_dir, "kb_comment"), made(spark, sf_dir, "select id from {kb_comment} where parent_id is null and conv_id % 2 = 0"), True).select("id", "resolved")


_WRITES = "select path, body as content, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then body else concat(body, 'x') end as expected, doc_id % 6 = 3 as create_only, doc_id from {kb_page} union all select concat('fresh/', cast(doc_id as string), '.md') as path, body as content, case when doc_id % 2 = 0 then body end as expected, doc_id % 2 = 1 as create_only, doc_id from {kb_page}"


@query("k7_write_conflicts", "select path, case when doc_id % 3 = 2 then 'changed' when doc_id % 6 = 3 then 'exists' end as error from {kb_page} union all select concat('fresh/', doc_id, '.md'), case when doc_id % 2 = 0 then 'gone' end from {kb_page}")
def write_conflicts(spark, sf_dir):
    return writes.write_errors(view(spark, sf_dir, "kb_base"), made(spark, sf_dir, _WRITES)).select("path", "error")


@query("k8_renamed_and_deleted", "select case when path like 'src1/%' then concat('moved/', substr(path, 6)) else path end as path from {kb_page} where path not like 'src2/%' union all select 'moved/new/index.md'")
def renamed(spark, sf_dir):
    files = view(spark, sf_dir, "kb_base")
    return writes.create_folder(writes.delete(writes.rename(files, "src1", "moved"), "src2"), "new", "moved").select("path")


@query("s22_new_spaces", """
    select id, name, slug, path from (select cast(id as varchar) as id, name, 's' || id as slug, '/kb/' || id as path from {kb_space} where id % 2 = 0) o
    union all select concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '4' || substr(h, 14, 3), 'a' || substr(h, 18, 3), substr(h, 21, 12)), name, slug, path
    from (select sha256('/kb/' || id) as h, name, 't' || id as slug, '/kb/' || id as path from {kb_space} where id % 2 <> 0) n""")
def new_spaces(spark, sf_dir):
    old = made(spark, sf_dir, "select cast(id as string) as id, name, concat('s', cast(id as string)) as slug, concat('/kb/', cast(id as string)) as path from {kb_space} where id % 2 = 0")
    return writes.add_spaces(old, made(spark, sf_dir, "select name, concat('t', cast(id as string)) as slug, concat('/kb/', cast(id as string)) as path from {kb_space}"))


# --- joins, unions and sessions ---------------------------------------------------


@query("j4_comments_of_spaces", f"select 'space' as workspace_slug, page_slug, count(*) as n from ({_COMMENTS}) c group by page_slug")
def comments_of_spaces(spark, sf_dir):
    spaces = spark.createDataFrame([("s", "space"), ("t", "other")], "id string, slug string")
    joined = made(spark, sf_dir, _COMMENTS).join(F.broadcast(spaces.select(F.col("id").alias("space_id"), F.col("slug").alias("workspace_slug"))), "space_id")
    return joined.groupBy("workspace_slug", "page_slug").agg(F.count("*").alias("n"))


@query("j9_contributions_by_path", "select distinct submission_id as id from {kb_submission_file} a where a.flag = 'A' and exists (select 1 from {kb_submission_file} b where b.path = a.path and b.flag = 'R')")
def contributions_by_path(spark, sf_dir):
    return review.contributions(made(spark, sf_dir, "select submission_id as id, path from {kb_submission_file} where flag = 'A'"), made(spark, sf_dir, "select path from {kb_submission_file} where flag = 'R'"))


@query("u2_source_union", """
    select path as filename, 'user' as origin, true as private from {kb_draft} union all select path, 'main', true from {kb_base} where path not in (select path from {kb_draft})
    union all select path, 'main', false from {kb_base} union all select path, 'user', false from {kb_draft} where path not in (select path from {kb_base})""")
def source_union(spark, sf_dir):
    main, own = (made(spark, sf_dir, f"select path as filename from {{{n}}}") for n in ("kb_base", "kb_draft"))
    both = [review.sources_of(main, own, p).withColumn("private", F.lit(p)) for p in (True, False)]
    return both[0].unionByName(both[1])


@query("u7_dirty_paths", "select path from {kb_submission_file} where flag <> 'N' union select concat('old/', path) from {kb_submission_file} where flag = 'R'")
def dirty_paths(spark, sf_dir):
    status = made(spark, sf_dir, "select path, case when flag = 'R' then concat('old/', path) end as renamed_from from {kb_submission_file} where flag <> 'N'")
    return status.select(F.explode(F.array("path", "renamed_from")).alias("path")).filter("path is not null").distinct()


_SPANS = "select id as root_id, page_slug, conv_id as created_at, cast(conv_id % 5 + 1 as int) as start_line, cast(conv_id % 5 + 1 + conv_id % 3 as int) as end_line from {kb_comment} where parent_id is null"


@query("w4_first_thread_per_line", f"select page_slug, line, arg_min(root_id, row(created_at, root_id)) as root_id from (select *, unnest(range(start_line, end_line + 1)) as line from ({_SPANS}) s) x group by page_slug, line")
def first_thread(spark, sf_dir):
    return review.line_threads(made(spark, sf_dir, _SPANS)).withColumn("line", F.col("line").cast("long"))


_TYPED = "select user_id as session, cast(ts as timestamp) as at, cast(event_id as string) as query from {events}"


@query("r4_debounced_queries", """
    with t as (select user_id as session, cast(ts as timestamp) as w, cast(event_id as varchar) as query from {events}),
    g as (select *, lead(w) over (partition by session order by w, query) as nxt from t)
    select 'keyword' as kind, query from g where nxt is null or epoch_us(nxt) - epoch_us(w) >= 120000 union all select 'semantic', query from g where nxt is null or epoch_us(nxt) - epoch_us(w) >= 300000""")
def debounced(spark, sf_dir):
    typed = made(spark, sf_dir, _TYPED)
    sent = [review.settled(typed, ms).select(F.lit(k).alias("kind"), "query") for k, ms in (("keyword", 120), ("semantic", 300))]
    return sent[0].unionByName(sent[1])


@query("r5_ready_agents", """
    with m as (select max(cast(ts as timestamp)) as newest from {events}), c as (select user_id % 50 as agent, max(cast(ts as timestamp)) as w from {events} group by 1)
    select agent from c, m where epoch_us(newest) - epoch_us(w) <= 30000000""")
def ready_agents(spark, sf_dir):
    now = view(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    checks = made(spark, sf_dir, "select user_id % 50 as agent, cast(ts as timestamp) as checked_at, value < 5 as ready from {events}")
    return review.ready(checks, F.lit(now)).select("agent")


# --- labels and checks --------------------------------------------------------------


@query("f17_comment_slugs", "select path, path not like '.%' and path not like '%/.%' and path like '%.md' as ok from {kb_file}")
def comment_slugs(spark, sf_dir):
    return view(spark, sf_dir, "kb_file").select("path", display.page_slug_ok(F.col("path")).alias("ok"))


_ROLES = "select id, case id % 4 when 0 then 'owner' when 1 then 'manager' when 2 then 'editor' else 'viewer' end as role, case id % 3 when 0 then 'owner' when 1 then 'manager' else 'viewer' end as target from {kb_member}"


@query("f20_roles", f"select id, role <> 'viewer' as push, role in ('owner', 'manager') as merge, case role when 'owner' then target <> 'owner' when 'manager' then target = 'viewer' else false end as manage from ({_ROLES}) r")
def roles(spark, sf_dir):
    r = F.col("role")
    return made(spark, sf_dir, _ROLES).select("id", display.can_push(r).alias("push"), display.can_merge(r).alias("merge"), display.can_manage(r, F.col("target")).alias("manage"))


@query("x13_binary", "select doc_id, doc_id % 3 <> 0 as is_binary from {documents}")
def binary(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("61006200"))).when(F.col("doc_id") % 3 == 2, F.unhex(F.lit("61FF62"))).otherwise(F.encode("text", "UTF-8"))
    return view(spark, sf_dir, "documents").select("doc_id", display.is_binary(raw).alias("is_binary"))


@query("x32_labels", """
    select doc_id, case when doc_id % 2 = 0 then case doc_id % 4 when 0 then 'No changes since the latest checkpoint' else '2 saved files changed since the latest checkpoint' end
        when doc_id % 4 = 1 then '1 saved file in the current draft' else '3 saved files in the current draft' end as draft,
        case doc_id % 4 when 0 then 'No broken links' when 1 then '1 broken link' else concat(doc_id % 4, ' broken links') end as broken,
        concat('Checkpoint 2026-03-', lpad(cast(1 + doc_id % 28 as varchar), 2, '0'), ' 09:05') as checkpoint from {documents}""")
def labels(spark, sf_dir):
    n = F.col("doc_id") % 4
    at = F.make_timestamp(F.lit(2026), F.lit(3), (1 + F.col("doc_id") % 28).cast("int"), F.lit(9), F.lit(5), F.lit(0))
    return view(spark, sf_dir, "documents").select("doc_id", display.draft_label(n, F.col("doc_id") % 2 == 0).alias("draft"), display.broken_link_summary(n).alias("broken"), display.checkpoint_name(at).alias("checkpoint"))
