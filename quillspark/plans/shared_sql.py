"""Queries which both engines read as the same SQL over the corpus views."""

SHARED: dict[str, str] = {
    # aggregations
    "a1_pages_per_space": "select space_id, count(*) as n_pages from {kb_page} group by space_id",
    "a4_diff_totals": """
        select submission_id, sum(additions) as additions, sum(deletions) as deletions, count(*) as files
        from {kb_submission_file} group by submission_id""",
    "a5_unresolved_comments": """
        select page_slug, sum(case when not resolved and parent_id is null then 1 else 0 end) as open_roots,
               count(*) as n from {kb_comment} group by page_slug""",
    "a6_unread_counts": """
        select coalesce(space, '__none__') as space, kind, sum(case when not is_read then 1 else 0 end) as unread,
               count(*) as n from {kb_notification} group by coalesce(space, '__none__'), kind""",
    "a6_review_counts": "select status, count(*) as n from {kb_submission} group by status",
    "a7_distinct_kinds": "select space, count(distinct kind) as kinds, min(kind) as first_kind, max(kind) as last_kind from {kb_notification} group by space",
    "a8_changed_files": """
        select sum(case when a.body is null or b.body is null or a.body <> b.body then 1 else 0 end) as changed, count(*) as files
        from {kb_base} a full join {kb_draft} b on a.path = b.path""",
    # joins
    "j5_replies_with_parent": """
        select c.id from {kb_comment} c where c.parent_id is not null
        and exists (select 1 from {kb_comment} p where p.id = c.parent_id and p.page_slug = c.page_slug)""",
    "j6_threads": """
        select r.id as root_id, r.page_slug, count(c.id) as replies, max(c.turn) as last_turn
        from {kb_comment} r left join {kb_comment} c on c.parent_id = r.id
        where r.parent_id is null group by r.id, r.page_slug""",
    "j7_member_names": """
        select s.id, coalesce(m.name, substr(cast(s.user_id as string), 1, 8)) as user_name
        from {kb_submission} s left join {kb_member} m on m.id = s.user_id + 1""",
    # windows and top-k
    "w7_running_lines": """
        select submission_id, path, sum(additions) over (partition by submission_id order by deletions, path, additions, flag rows between unbounded preceding and current row) as upto
        from {kb_submission_file}""",
    "t1_newest_pages": "select space_id, path, modified_ns from {kb_page} order by modified_ns desc, path limit 12",
    "t2_spaces_in_order": "select id, name, row_number() over (order by region, name) as place from {kb_space}",
    # set operations
    "u5_deleted_paths": "select path from {kb_base} except select path from {kb_draft}",
    "u6_changed_paths": "select path from {kb_draft} union select path from {kb_agent}",
    # filters and predicates
    "f18_markdown_only": "select path from {kb_submission_file} where path like '%.md' and path not like '.%' group by path",
    "f21_review_tabs": """
        select id, status in ('pending', 'approved', 'rejected') as in_open, status = 'merged' as in_merged from {kb_submission}""",
    "f22_notifications": """
        select id from {kb_notification} where not is_read and kind = 'click' and space is null""",
    # sinks as set-based changes
    # versioning
    # streaming analogues in batch form
    "r7_unread_by_hour": """
        select kind, date_trunc('hour', created_at) as hour_start, sum(case when not is_read then 1 else 0 end) as unread
        from {kb_notification} group by kind, date_trunc('hour', created_at)""",
    # scalar functions which are the same in both
    "x15_file_status": """
        select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted'
               when a.body <> b.body then 'modified' else 'same' end as status
        from {kb_base} a full join {kb_agent} b on a.path = b.path""",
    "d7_changed_sources": "select d.path from {kb_draft} d where not exists (select 1 from {kb_base} b where b.path = d.path and b.body = d.body)",
}
