"""Corpus views over the test tables, as SQL which Spark and DuckDB both read.

The mapping from test tables to a knowledge base is ours; the semantics which
the queries apply to them are those of the operators. ``{name}`` stands for a
table or for an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "kb_page": """
        select lang as space_id, doc_id, concat(source, '/', cast(doc_id as string), '.md') as path,
               text as body, doc_id as modified_ns, source from {documents}""",
    "kb_page_linked": """
        select space_id, doc_id, path, modified_ns, concat(
            '---', chr(10), 'type: Note', chr(10), 'title: Page ', cast(doc_id as string), chr(10),
            'sources: [s', cast(doc_id % 5 as string), '.md]', chr(10), '---', chr(10),
            '# Heading ', cast(doc_id as string), chr(10),
            '[[src', cast((7 * doc_id) % 20 as string), '/', cast((7 * doc_id) % 1200 as string), '|label]] and ',
            '[n](../src', cast(doc_id % 20 as string), '/', cast((3 * doc_id) % 1300 as string), '.md#x)', chr(10),
            '```', chr(10), '[[decoy', cast(doc_id as string), ']]', chr(10), '```', chr(10), body) as body
        from {kb_page}""",
    "kb_file": """
        select lang as space_id, doc_id, case doc_id % 40
                when 0 then concat(source, '/d', cast(doc_id - doc_id % 40 as string), '/index.md')
                when 1 then concat(source, '/d', cast(doc_id - doc_id % 40 as string), '/p', cast(doc_id as string), '.html')
                when 2 then concat(source, '/.h/', cast(doc_id as string), '.md')
                when 3 then concat('.kb/sources/', cast(doc_id as string), '.MD')
                when 4 then concat('sources/', cast(doc_id as string), '.txt')
                else concat(source, '/d', cast(doc_id - doc_id % 40 as string), '/', cast(doc_id as string), '.md') end as path,
            case doc_id % 3
                when 0 then concat('---', chr(10), 'title: "Title ', cast(doc_id as string), '"', chr(10), 'tags: [a, b]', chr(10), 'summary: Short ', cast(doc_id as string), chr(10), '---', chr(10), 'Text')
                when 1 then concat('  # No', chr(10), '# Head ', cast(doc_id as string), chr(10), 'Text')
                else concat('Text ', cast(doc_id as string)) end as body,
            source from {documents}""",
    "kb_comment": """
        select concat(cast(conv_id as string), ':', cast(turn as string)) as id, conv_id, turn,
               case when turn = 0 then null else concat(cast(conv_id as string), ':0') end as parent_id,
               concat('p', cast(conv_id % 50 as string), '.md') as page_slug, role as user_id, text as body,
               conv_id % 3 = 0 as resolved from {conversations}""",
    "kb_notification": """
        select event_id as id, event_type as kind, value < 5 as is_read,
               case when user_id % 20 = 0 then null else concat('w', cast(user_id % 20 as string)) end as space,
               cast(ts as timestamp) as created_at, props from {events}""",
    "kb_member": """
        select c_custkey as id, c_name as name, c_nationkey as space_id,
               case c_custkey % 4 when 0 then 'owner' when 1 then 'admin' when 2 then 'member' else 'viewer' end as role
        from {customer}""",
    "kb_space": "select n_nationkey as id, n_name as name, n_regionkey as region from {nation}",
    "kb_submission": """
        select o_orderkey as id, o_custkey as user_id,
               case o_orderstatus when 'P' then 'pending' when 'O' then 'approved' else 'merged' end as status,
               cast(o_orderdate as timestamp) as created_at from {orders}""",
    "kb_submission_file": """
        select l_orderkey as submission_id, concat('p', cast(l_partkey as string), '.md') as path,
               cast(l_quantity as bigint) as additions, cast(l_linenumber as bigint) as deletions,
               l_returnflag as flag from {lineitem}""",
    "kb_vec": """
        select vec_id, embedding, label, case when label < 5 then 'main' else 'draft' end as branch from {embeddings}""",
    "kb_base": "select path, body from {kb_page}",
    "kb_draft": """
        select path, case when doc_id % 7 = 0 then concat(body, 'D') else body end as body
        from {kb_page} where doc_id % 13 <> 0
        union all select concat('new/', cast(doc_id as string), '.md') as path, body from {kb_page} where doc_id % 19 = 0""",
    "kb_agent": """
        select path, case when doc_id % 11 = 0 then concat(body, 'A') else body end as body
        from {kb_page} where doc_id % 17 <> 0
        union all select concat('new/', cast(doc_id as string), '.md') as path, body from {kb_page} where doc_id % 23 = 0""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; names which are no view are Parquet tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views which it names in braces as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
                need(n)
            order.append(name)

    for n in re.findall(r"\{(\w+)\}", sql):
        need(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = ", ".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
