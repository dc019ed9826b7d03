"""All queries over the knowledge-base semantics, by name, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import links, metadata, paths, text
from quillspark.operators import batch, graph, hybrid, index, nearpages, search, vector, versions
from quillspark.plans import engine, graphs
from quillspark.plans.registry import ORACLE_SQL, QUERIES, query
from quillspark.plans.shared_sql import SHARED
from quillspark.plans.views import view, with_views
from quillspark.sources import formats
from quillspark.storage import shared_dir

__all__ = ["ORACLE_SQL", "QUERIES", "engine", "graphs"]

def _shared(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    import re

    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return lambda spark, sf_dir: spark.sql(sql, **{n: view(spark, sf_dir, n) for n in used})


for _name, _sql in SHARED.items():
    QUERIES[_name] = _shared(_sql)
    ORACLE_SQL[_name] = with_views(_sql)


def _dealt(pages: DataFrame) -> DataFrame:
    """Rows over all cores where the files have fewer splits than there are cores; a large table stays as it is."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def _titled(spark: SparkSession, sf_dir: str, of: str = "kb_page") -> DataFrame:
    return _dealt(view(spark, sf_dir, of)).withColumn("title", F.split("body", "\n")[0])


_indexes: dict[tuple, index.SearchIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str, of: str = "kb_page", texts: bool = True) -> index.SearchIndex:
    """The search index of a pages view, in the shared folder; without ``texts`` its link graph alone."""
    key = (spark.sparkContext.applicationId, sf_dir, of, texts)
    if key not in _indexes:
        made = index.SearchIndex(spark, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", texts=texts)
        made.rebuild(_titled(spark, sf_dir, of))
        _indexes[key] = made
    return _indexes[key]


SEARCH = "from thon"
_TOKENS = "list_filter(string_split_regex(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"

def _search_sql(words: str, limit: int) -> str:
    """BM25 over all pages for single words, all of which must occur."""
    terms = ", ".join(f"'{w}'" for w in words.split())
    return f"""
    with tok as (select space_id, path, title, {_TOKENS.format('title')} as tt, {_TOKENS.format('body')} as bt
                 from (select space_id, path, body, string_split(body, chr(10))[1] as title from {{kb_page}}) p),
    st as (select count(*) as n_docs, avg(len(tt) + len(bt)) as avg_tokens from tok),
    q as (select unnest([{terms}]) as term),
    hit as (select space_id, path, title, term, len(tt) + len(bt) as d,
                   8.0 * len(list_filter(tt, lambda t: t = term)) + len(list_filter(bt, lambda t: t = term)) as tf from tok, q),
    df as (select term, count(*) as n from hit where tf > 0 group by term),
    sc as (select h.space_id, h.path, h.title, sum(-greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg_tokens))) as score, count(*) as k
           from hit h join df using (term), st where tf > 0 group by h.space_id, h.path, h.title)
    select space_id, path, title, contains(lower(title), '{words}') as title_match, round(score, 6) as score
    from sc where k = {len(words.split())} order by contains(lower(title), '{words}') desc, sc.score, path, space_id limit {limit}"""


_SEARCH_SQL = _search_sql(SEARCH, 12)
_BATCH = ("from thon", "thon", "from")


@query("search_pages", _SEARCH_SQL)
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored index of these tables, which the first call in an application builds and later ones reuse."""
    return stored_index(spark, sf_dir).search(SEARCH).withColumn("score", F.round("score", 6))


@query("w1_top_per_query", " union all ".join(f"select '{q}' as query_id, * from ({_search_sql(q, 5)}) x" for q in _BATCH))
def top_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five pages of each query of a batch, from the stored index."""
    queries = spark.createDataFrame([(q, q) for q in _BATCH], "query_id string, query string")
    hits = batch.search_batch(stored_index(spark, sf_dir), queries, 5).hits
    return hits.withColumn("score", F.round("score", 6))


@query("w1_batch_of_queries", f"""
    with tok as (select doc_id, space_id, path, title, {_TOKENS.format('title')} as tt, {_TOKENS.format('body')} as bt
                 from (select doc_id, space_id, path, body, string_split(body, chr(10))[1] as title from {{kb_page}}) p),
    st as (select count(*) as n_docs, avg(len(tt) + len(bt)) as avg_tokens from tok),
    q as (select doc_id as query_id, concat(bt[3], ' ', bt[5]) as query, [bt[3], bt[5]] as terms from tok where doc_id % 50 = 0 and len(bt) >= 5),
    tf as (select doc_id, term, sum(w) as tf from (select doc_id, unnest(tt) as term, 8.0 as w from tok union all select doc_id, unnest(bt) as term, 1.0 as w from tok) u group by doc_id, term),
    df as (select term, count(*) as n from tf group by term),
    qt as (select query_id, query, unnest(terms) as term from q),
    sc as (select query_id, query, t.doc_id, count(*) as k, sum(-greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(tt) + len(bt)) / avg_tokens))) as score
           from qt join tf using (term) join df using (term) join tok t on t.doc_id = tf.doc_id, st group by query_id, query, t.doc_id),
    r as (select query_id, space_id, path, title, contains(lower(title), query) as title_match, score,
          row_number() over (partition by query_id order by contains(lower(title), query) desc, round(score, 6), path, space_id) as k
          from sc join tok using (doc_id) where sc.k = 2)
    select query_id, space_id, path, title, title_match, round(score, 6) as score from r where k <= 3""")
def batch_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three pages for two words of every fiftieth page, all queries in one batch."""
    t = text.tokens(F.col("body"))
    asked = view(spark, sf_dir, "kb_page").filter("doc_id % 50 = 0").withColumn("t", t).filter(F.size("t") >= 5)
    queries = asked.select(F.col("doc_id").alias("query_id"), F.concat(F.col("t")[2], F.lit(" "), F.col("t")[4]).alias("query"))
    return batch.search_batch(stored_index(spark, sf_dir), queries, 3, digits=6).hits.withColumn("score", F.round("score", 6))


_ASKED = "select doc_id as query_id, concat(bt[3], ' ', bt[5]) as query, [bt[3], bt[5]] as terms from tok where doc_id % 50 = 0 and len(bt) >= 5"


@query("u3_hybrid_hits", f"""
    with tok as (select doc_id, space_id, path, title, {_TOKENS.format('title')} as tt, {_TOKENS.format('body')} as bt
                 from (select doc_id, space_id, path, body, string_split(body, chr(10))[1] as title from {{kb_page}}) p),
    st as (select count(*) as n_docs, avg(len(tt) + len(bt)) as avg_tokens from tok),
    q as ({_ASKED}),
    tf as (select doc_id, term, sum(w) as tf from (select doc_id, unnest(tt) as term, 8.0 as w from tok union all select doc_id, unnest(bt) as term, 1.0 as w from tok) u group by doc_id, term),
    df as (select term, count(*) as n from tf group by term),
    qt as (select query_id, query, unnest(terms) as term from q),
    sc as (select query_id, query, t.doc_id, count(*) as k, sum(-greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(tt) + len(bt)) / avg_tokens))) as score
           from qt join tf using (term) join df using (term) join tok t on t.doc_id = tf.doc_id, st group by query_id, query, t.doc_id),
    kw as (select query_id, doc_id, row_number() over (partition by query_id order by contains(lower(title), query) desc, round(score, 6), path, space_id) as r
           from sc join tok using (doc_id) where sc.k = 2),
    se as (select q.query_id, v.vec_id as doc_id, list_cosine_similarity(cast(o.embedding as double[]), cast(v.embedding as double[])) as s
           from q join {{kb_vec}} o on o.vec_id = q.query_id, {{kb_vec}} v where v.vec_id in (select doc_id from tok)),
    sr as (select query_id, doc_id, row_number() over (partition by query_id order by s desc, doc_id) as r from se where s > 0.3),
    a as (select query_id, doc_id, 0 as side, r from kw where r <= 4 union all select query_id, doc_id, 1, r from sr where r <= 4 and not exists (select 1 from kw where kw.r <= 4 and kw.query_id = sr.query_id and kw.doc_id = sr.doc_id))
    select query_id, regexp_replace(path, '\\.md$', '') as slug, case side when 0 then 'keyword' else 'semantic' end as origin, row_number() over (partition by query_id order by side, r) as place from a join tok using (doc_id)""")
def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words and the vector of every fiftieth page asked of the stored index and of the pages' vectors."""
    pages = view(spark, sf_dir, "kb_page")
    vectors = view(spark, sf_dir, "kb_vec").join(pages.select(F.col("doc_id").alias("vec_id"), "path"), "vec_id").select("vec_id", "path", "embedding")
    asked = pages.filter("doc_id % 50 = 0").withColumn("t", text.tokens(F.col("body"))).filter(F.size("t") >= 5)
    queries = asked.select(F.col("doc_id").alias("query_id"), F.concat(F.col("t")[2], F.lit(" "), F.col("t")[4]).alias("query"))
    own = view(spark, sf_dir, "kb_vec").select(F.col("vec_id").alias("query_id"), "embedding")
    return hybrid.hybrid_search(stored_index(spark, sf_dir), queries.join(own, "query_id", "left"), vectors, 4, 0.3, digits=6)


@query("search_whole_corpus", _SEARCH_SQL)
def search_whole_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index: every page is read."""
    return search.search(_titled(spark, sf_dir), SEARCH).withColumn("score", F.round("score", 6))


@query("r1_refreshed_index", """
    with s as (select space_id, path, case when doc_id % 5 = 0 then concat(body, ' from thon') else body end as body from {kb_page} where doc_id % 7 <> 0),
    t as (select space_id, path, list_filter(string_split_regex(strip_accents(lower(body)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') as w from s)
    select space_id, count(*) as n_pages, cast(sum(len(w)) as bigint) as n_tokens, count(*) filter (list_contains(w, 'thon')) as hits from t group by space_id""")
def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of some pages brought up to date: new, changed and deleted ones, then asked for one word's pages."""
    pages = view(spark, sf_dir, "kb_page").withColumn("title", F.lit(""))
    kept = index.SearchIndex(spark, f"{shared_dir(spark)}/refreshed-{uuid.uuid4().hex}")
    kept.rebuild(pages.filter("doc_id % 3 <> 0"))
    five = F.col("doc_id") % 5 == 0
    seen = pages.filter("doc_id % 7 <> 0").withColumn("modified_ns", F.when(five, F.col("modified_ns") + 1).otherwise(F.col("modified_ns")))
    seen = seen.withColumn("body", F.when(five, F.concat("body", F.lit(" from thon"))).otherwise(F.col("body")))
    # pages which are not divisible by five keep their time, and are not read again
    kept.refresh(seen)
    live = kept.live()
    hits = kept.postings(["thon"]).select("doc").distinct().join(kept.titles(), "doc").groupBy("space_id").agg(F.count("*").alias("hits"))
    return live.groupBy("space_id").agg(F.count("*").alias("n_pages"), F.sum("n_tokens").alias("n_tokens")).join(hits, "space_id", "left").fillna(0, ["hits"])


@query("a9_corpus_statistics", f"select count(*) as n_docs, round(avg(len({_TOKENS.format('body')})), 6) as avg_tokens from {{kb_page}}")
def corpus_statistics(spark, sf_dir):
    n = F.size(text.tokens(F.col("body")))
    return view(spark, sf_dir, "kb_page").agg(F.count("*").alias("n_docs"), F.round(F.avg(n), 6).alias("avg_tokens"))


@query("x2_tokens", f"select path, len({_TOKENS.format('body')}) as n, list_aggregate(list_distinct({_TOKENS.format('body')}), 'max') as last_token from {{kb_page}}")
def token_counts(spark, sf_dir):
    t = text.tokens(F.col("body"))
    return view(spark, sf_dir, "kb_page").select("path", F.size(t).cast("long").alias("n"), F.array_max(t).alias("last_token"))


@query("postings_df", f"select term, count(distinct doc_id) as df, count(*) as tf from (select doc_id, unnest({_TOKENS.format('body')}) as term from {{kb_page}}) x group by term")
def postings_df(spark, sf_dir):
    return search.term_counts(_dealt(view(spark, sf_dir, "kb_page")))


_EDGES = """
    select distinct space_id, path as source_path, unnest([
        concat('src', cast((7 * doc_id) % 20 as varchar), '/', cast((7 * doc_id) % 1200 as varchar), '.md'),
        concat('src', cast(doc_id % 20 as varchar), '/', cast((3 * doc_id) % 1300 as varchar), '.md')]) as target from {kb_page}"""


@query("x9_link_edges", _EDGES)
def link_edges(spark, sf_dir):
    return graph.edges(_dealt(view(spark, sf_dir, "kb_page_linked")))


_NAMED = f"select e.space_id, e.source_path, concat('Page ', cast(p.doc_id as varchar)) as source_title, e.target from ({_EDGES}) e join {{kb_page}} p on p.space_id = e.space_id and p.path = e.source_path"


@query("j2_backlinks", f"select space_id, target, source_path, source_title from ({_NAMED}) n")
def backlinks(spark, sf_dir):
    return stored_index(spark, sf_dir, "kb_page_linked", texts=False).backlinks()


_LIVE = "select space_id, path as target from {kb_page} union select space_id, source as target from {kb_page}"
_BROKEN = f"select * from ({_NAMED}) n where not exists (select 1 from ({_LIVE}) l where l.space_id = n.space_id and l.target = n.target)"


@query("s3_live_targets", _LIVE)
def live_targets(spark, sf_dir):
    return graph.live_targets(view(spark, sf_dir, "kb_page"))


@query("j3_broken_links", _BROKEN)
def broken_links(spark, sf_dir):
    return stored_index(spark, sf_dir, "kb_page_linked", texts=False).broken_links()


@query("a3_broken_by_source", f"select space_id, source_path, string_agg(target, ',' order by target) as targets, count(*) as n from ({_BROKEN}) b group by space_id, source_path")
def broken_by_source(spark, sf_dir):
    return graph.grouped_by_source(stored_index(spark, sf_dir, "kb_page_linked", texts=False).broken_links())


@query("f1_titles", "select path, concat('Page ', cast(doc_id as varchar)) as title, 'Note' as type, concat('[s', cast(doc_id % 5 as varchar), '.md]') as sources, concat('Heading ', cast(doc_id as varchar)) as heading from {kb_page}")
def titles(spark, sf_dir):
    body = F.col("body")
    return view(spark, sf_dir, "kb_page_linked").select(
        "path", text.index_title(body).alias("title"), text.field(body, "type").alias("type"), text.field(body, "sources").alias("sources"),
        text.index_title(text.content(body)).alias("heading"),
    )


@query("f5_first_content_line", "select path, trim(string_split(body, chr(10))[1]) as line from {kb_page}")
def first_line(spark, sf_dir):
    return view(spark, sf_dir, "kb_page").select("path", text.first_content_line(F.col("body")).alias("line"))


@query("f9_document_kinds", """
    with x as (select case doc_id % 6 when 0 then concat(source, '/index.md') when 1 then concat(source, '/log.md') when 2 then concat(source, '/.h/x.md')
        when 3 then concat(source, '/a.html') else path end as path from {kb_page})
    select path, case when path like '%/index.md' then 'index' when path like '%/log.md' then 'log' when path like '%.md' then 'concept' else 'other' end as kind,
        path like '%/.%' as hidden, path like '%/index.md' or path like '%/log.md' as reserved, regexp_replace(path, '\\.md$', '') as slug from x""")  # fmt: skip
def kinds(spark, sf_dir):
    m = F.col("doc_id") % 6
    name = F.when(m == 0, "/index.md").when(m == 1, "/log.md").when(m == 2, "/.h/x.md").when(m == 3, "/a.html")
    p = view(spark, sf_dir, "kb_page").select(F.when(name.isNotNull(), F.concat("source", name)).otherwise(F.col("path")).alias("path"))
    c = F.col("path")
    return p.select("path", paths.kind(c).alias("kind"), paths.is_hidden(c).alias("hidden"), paths.is_reserved(c).alias("reserved"), paths.slug(c).alias("slug"))


@query("x7_resolved_targets", """
    select path, source as root_target, concat(source, '/b c.md') as decoded, cast(null as varchar) as escaped from {kb_page}""")
def resolved(spark, sf_dir):
    p = F.col("path")
    return view(spark, sf_dir, "kb_page").select(
        "path",
        links.resolve_markdown(p, F.concat(F.lit("/x/../"), F.col("source"), F.lit("#top"))).alias("root_target"),
        links.resolve_markdown(p, F.lit("./b%20c.md?x=1")).alias("decoded"),
        links.resolve_markdown(p, F.lit("../../out.md")).alias("escaped"),
    )


@query("x12_content_hash", "select path, sha256(body) as sha256 from {kb_page}")
def hashes(spark, sf_dir):
    return view(spark, sf_dir, "kb_page").select("path", versions.digest(F.col("body")).alias("sha256"))


@query("x28_slugs", "select path, regexp_replace(regexp_replace(lower(t), '[^a-z0-9 -]', '', 'g'), ' +', '-', 'g') as strict, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as collapsed from (select path, string_split(body, chr(10))[1] as t from {kb_page}) x")
def slugs(spark, sf_dir):
    t = F.split("body", "\n")[0]
    return view(spark, sf_dir, "kb_page").select("path", text.slug_strict(t).alias("strict"), text.slug_collapsed(t).alias("collapsed"))


@query("d1_exact_duplicates", "select sha, source, min(doc_id) as kept, count(*) as copies from (select sha256(body) as sha, source, doc_id from {kb_page}) x group by sha, source")
def duplicates(spark, sf_dir):
    p = view(spark, sf_dir, "kb_page").select(versions.digest(F.col("body")).alias("sha"), "source", "doc_id")
    return p.groupBy("sha", "source").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


_NEAREST = """
    select query_id, vec_id, round(s, 6) as similarity from (
        select query_id, vec_id, s, row_number() over (partition by query_id order by s desc, vec_id) as k from (
            select q.vec_id as query_id, v.vec_id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as s
            from {{kb_vec}} q, {{kb_vec}} v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id and v.branch = 'main') a where s > {0}) b where k <= {1}"""


@query("d5_near_vectors", _NEAREST.format(0.3, 3))
def near_vectors(spark, sf_dir):
    """The best three on the main branch for every query vector (each id divisible by 50)."""
    v = view(spark, sf_dir, "kb_vec")
    return vector.nearest(v.filter("vec_id % 50 = 0"), v.filter("branch = 'main'"), 3, 0.3)


@query("d6_semantic_search", _NEAREST.format(0.1, 10))
def semantic_search(spark, sf_dir):
    v = view(spark, sf_dir, "kb_vec")
    return vector.nearest(v.filter("vec_id % 50 = 0"), v.filter("branch = 'main'"), 10, 0.1)


@query("j11_near_pages", """
    with p as (select vec_id, embedding from {kb_vec} union all select vec_id + 1000000 as vec_id, list_transform(embedding, lambda x, i: case when i <= vec_id % 7 then -x else x end) as embedding from {kb_vec}),
    s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as s from p q, p v where q.vec_id <> v.vec_id),
    r as (select query_id, vec_id, s, row_number() over (partition by query_id order by s desc, vec_id) as k from s where s > 0.85)
    select query_id, vec_id, round(s, 6) as similarity from r where k <= 3""")
def near_pages(spark, sf_dir):
    """The three nearest above 0.85 of every vector and of a changed copy of each."""
    v = view(spark, sf_dir, "kb_vec").select("vec_id", "embedding")
    changed = v.select(F.col("vec_id") + 1000000, F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 7, -x).otherwise(x)))
    pages = v.union(changed)
    return nearpages.nearest_pages(pages, pages, 3, 0.85)


_CHANGES = """
    select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'modified' end as status,
        sha256(a.body) as old_sha, sha256(b.body) as new_sha
    from {kb_base} a full join {kb_draft} b on a.path = b.path where a.path is null or b.path is null or a.body <> b.body"""


@query("g1_working_diff", _CHANGES)
def working_diff(spark, sf_dir):
    return versions.changes(view(spark, sf_dir, "kb_base"), view(spark, sf_dir, "kb_draft"))


@query("g3_three_way_merge", """
    select coalesce(b.path, d.path, a.path) as path, case
        when d.body is not distinct from b.body and a.body is not distinct from b.body then 'unchanged' when d.body is not distinct from a.body then 'same'
        when d.body is not distinct from b.body then 'take_agent' when a.body is not distinct from b.body then 'keep_draft' else 'conflict' end as state
    from {kb_base} b full join {kb_draft} d on b.path = d.path full join {kb_agent} a on a.path = coalesce(b.path, d.path)""")
def three_way(spark, sf_dir):
    return versions.merge_states(*(view(spark, sf_dir, n) for n in ("kb_base", "kb_draft", "kb_agent")))


@query("x14_line_diffs", """
    with c as (select coalesce(a.path, b.path) as path, a.body as o, b.body as n from {kb_base} a full join {kb_draft} b on a.path = b.path where a.path is null or b.path is null or a.body <> b.body)
    select path, case when o is null then 'added' when n is null then 'deleted' else 'modified' end as status,
        case when n is null then 0 when o is null then len(string_split(n, chr(10))) else 1 end as additions,
        case when o is null then 0 when n is null then len(string_split(o, chr(10))) else 1 end as deletions from c""")
def line_diffs(spark, sf_dir):
    return versions.file_diffs(view(spark, sf_dir, "kb_base"), view(spark, sf_dir, "kb_draft")).drop("lines")


@query("r1_reconcile", """
    with i as (select space_id, path, modified_ns from {kb_page} where doc_id % 3 <> 0),
         s as (select space_id, path, case when doc_id % 5 = 0 then modified_ns + 1 else modified_ns end as modified_ns from {kb_page} where doc_id % 7 <> 0)
    select coalesce(i.space_id, s.space_id) as space_id, coalesce(i.path, s.path) as path, case when s.path is null then 'delete' else 'upsert' end as action
    from i full join s on i.space_id = s.space_id and i.path = s.path where s.path is null or i.path is null or i.modified_ns <> s.modified_ns""")
def reconcile(spark, sf_dir):
    p = view(spark, sf_dir, "kb_page")
    seen = p.filter("doc_id % 7 <> 0").withColumn("modified_ns", F.when(F.col("doc_id") % 5 == 0, F.col("modified_ns") + 1).otherwise(F.col("modified_ns")))
    return versions.reconcile(p.filter("doc_id % 3 <> 0"), seen)


@query("s7_format_dispatch", """
    select ext, case when ext in ('md','markdown','txt','csv','json','yaml','yml','toml','xml','html','htm') then 'text' when ext in ('docx','xlsx','pptx','ods','odt','odp') then 'archive' end as reader, count(*) as n
    from (select case doc_id % 5 when 0 then 'md' when 1 then 'docx' when 2 then 'doc' when 3 then 'html' else 'pdf' end as ext from {kb_page}) x group by ext""")
def dispatch(spark, sf_dir):
    m = F.col("doc_id") % 5
    ext = F.when(m == 0, "md").when(m == 1, "docx").when(m == 2, "doc").when(m == 3, "html").otherwise("pdf")
    return view(spark, sf_dir, "kb_page").select(ext.alias("ext")).groupBy("ext").agg(F.count("*").alias("n")).select("ext", formats.reader(F.col("ext")).alias("reader"), "n")


@query("s14_html_snapshots")
def html_snapshots(spark, sf_dir):
    return formats.snapshots(_dealt(view(spark, sf_dir, "pages")))


@query("s14_html_titles", "select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as n_links from {pages}")
def html_titles(spark, sf_dir):
    links_ = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return view(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.size(links_).cast("long").alias("n_links"))


@query("s15_url_hosts", "select page_id, regexp_extract(url, '^(https?)://', 1) as protocol, regexp_extract(url, '^https?://([^/?#:]+)', 1) as host, regexp_matches(url, '^https?://[^/@]+(/|$)') as ok from {pages}")
def url_hosts(spark, sf_dir):
    part = lambda n: F.try_parse_url("url", F.lit(n))
    ok = part("PROTOCOL").isin("http", "https") & part("HOST").isNotNull() & part("USERINFO").isNull()
    return view(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("protocol"), part("HOST").alias("host"), F.coalesce(ok, F.lit(False)).alias("ok"))


@query("x30_tool_results", "select path, concat('{\"path\":\"', path, '\",\"title_match\":false}') as result from {kb_page}")
def tool_results(spark, sf_dir):
    return view(spark, sf_dir, "kb_page").select("path", F.to_json(F.struct("path", F.lit(False).alias("title_match"))).alias("result"))


@query("x18_excerpts", """
    with l as (select path, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*(?:[-*+>]|#+|\\d+\\.)\\s+', ''))), lambda x: x <> ''), ' ') as j from {kb_page})
    select path, case when length(j) > 140 then concat(left(j, 140), '…') else j end as excerpt from l""")
def excerpts(spark, sf_dir):
    return view(spark, sf_dir, "kb_page").select("path", text.excerpt(F.col("body")).alias("excerpt"))


@query("k9_directory_index", """
    select source as dir, concat('# ', source, chr(10), string_agg(concat('- [', path, '](', path, ')'), chr(10) order by lower(path), path)) as body from {kb_page} group by source""")
def directory_index(spark, sf_dir):
    entry = F.concat(F.lit("- ["), "path", F.lit("]("), "path", F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct(F.lower("path").alias("k"), F.col("path").alias("p"), entry.alias("e"))))
    grouped = view(spark, sf_dir, "kb_page").groupBy(F.col("source").alias("dir")).agg(listed.alias("x"))
    return grouped.select("dir", F.concat(F.lit("# "), "dir", F.lit("\n"), F.array_join("x.e", "\n")).alias("body"))


@query("k10_source_names", """
    select name, case when name like '%.md' and name not in ('index.md', 'log.md') then name else concat('_encoded/', sha256(name), '.md') end as stored
    from (select case doc_id % 3 when 0 then 'index.md' when 1 then concat(cast(doc_id as varchar), '.md') else concat(cast(doc_id as varchar), '.txt') end as name from {kb_page}) x""")
def source_names(spark, sf_dir):
    m, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    name = F.when(m == 0, "index.md").when(m == 1, F.concat(n, F.lit(".md"))).otherwise(F.concat(n, F.lit(".txt")))
    return view(spark, sf_dir, "kb_page").select(name.alias("name")).select("name", paths.stored_source_name(F.col("name")).alias("stored"))


_PARTS = ", ".join(f"sum(cast(concat('0x', substr(h, {1 + 15 * k}, 15)) as bigint))" for k in range(4))


@query("k11_tree_hash", f"select source, sha256(concat_ws(',', count(*), {_PARTS})) as tree from (select source, sha256(concat(path, ':', sha256(body))) as h from {{kb_page}}) x group by source")
def tree_hash(spark, sf_dir):
    return versions.tree_hash(view(spark, sf_dir, "kb_page"), "source")


@query("x19_lineage", "select path, concat('.kb/sources/s', cast(doc_id % 5 as varchar), '.md') as source from {kb_page}")
def lineage(spark, sf_dir):
    return view(spark, sf_dir, "kb_page_linked").select("path", F.explode(metadata.sources(F.col("body"))).alias("source"))


@query("x20_source_addresses", "select page_id, case when regexp_matches(url, '^https?://[^/@]+(/|$)') then url end as address from {pages}")
def source_addresses(spark, sf_dir):
    document = F.concat(F.lit('---\nsource_url: "'), "url", F.lit('"\n---\nText'))
    return view(spark, sf_dir, "pages").select("page_id", metadata.source_address(document).alias("address"))


@query("f14_normalised_concepts", """
    select path, sha256(concat('---', chr(10), 'type: Note', chr(10), 'title: "', cast(doc_id as varchar), '"', chr(10), '---', chr(10), chr(10), ltrim(body, concat(chr(13), chr(10))))) as sha from {kb_page}""")
def normalised_concepts(spark, sf_dir):
    made = metadata.normalised_concept(F.col("body"), F.col("doc_id").cast("string"), F.lit("Note"))
    return view(spark, sf_dir, "kb_page").select("path", versions.digest(made).alias("sha"))


_ANCHORED = "select path, doc_id, len(string_split(body, chr(10))) as n from {kb_page}"


@query("x17_anchor_remap", f"""
    select path as id, case when doc_id % 13 = 0 or (doc_id % 7 = 0 and doc_id % n = n - 1) then 'outdated' else 'anchored' end as state,
           case when doc_id % 13 = 0 or (doc_id % 7 = 0 and doc_id % n = n - 1) then null else cast(doc_id % n + 1 as integer) end as line
    from ({_ANCHORED}) a""")
def anchor_remap(spark, sf_dir):
    pages = view(spark, sf_dir, "kb_page")
    line = (F.col("doc_id") % F.size(F.split("body", "\n")) + 1).cast("int")
    snapshots = pages.select(F.col("path").alias("page_slug"), versions.digest(F.col("body")).alias("content_hash"), F.col("body").alias("source"))
    comments = pages.select(F.col("path").alias("id"), F.col("path").alias("page_slug"), versions.digest(F.col("body")).alias("content_hash"), line.alias("start_line"), line.alias("end_line"))
    now = view(spark, sf_dir, "kb_draft").withColumnRenamed("path", "page_slug")
    return versions.remap_anchors(comments, snapshots, now).select("id", "state", F.col("start_line").alias("line"))


_UNIT = "[\\p{L}\\p{N}]+[^\\p{L}\\p{N}]*"


@query("x4_snippets", f"""
    with t as (select path, body, regexp_extract_all(body, '{_UNIT}') as u from {{kb_page}}),
    h as (select path, body, u, list_filter(range(0, len(u)), lambda i: list_contains(['from', 'thon'], strip_accents(lower(regexp_extract(u[i + 1], '^[\\p{{L}}\\p{{N}}]+'))))) as p from t),
    f as (select path, body, u, coalesce(p[1], 0) as a, coalesce(list_max(list_filter(p, lambda i: i < p[1] + 24)), 0) as z from h),
    w as (select path, body, u, case when z < 24 then 0 else greatest(0, least(len(u) - 24, (a + z) // 2 - 11)) end as s from f)
    select path, replace(concat(case when s > 0 then ' … ' else regexp_extract(body, '^[^\\p{{L}}\\p{{N}}]+') end,
        case when s + 24 < len(u) then concat(regexp_replace(list_aggregate(u[s + 1 : s + 24], 'string_agg', ''), '[^\\p{{L}}\\p{{N}}]+$', ''), ' … ')
             else coalesce(list_aggregate(u[s + 1 : s + 24], 'string_agg', ''), '') end), chr(10), ' ') as snippet from w""")
def snippets(spark, sf_dir):
    return view(spark, sf_dir, "kb_page").select("path", search.snippet(F.col("body"), ["from", "thon"]).alias("snippet"))
