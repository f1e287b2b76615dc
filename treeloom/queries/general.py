"""Queries of the two general problems, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators import hierarchy, snapshots


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.listing_changes(spark.read.parquet(f"{sf_dir}/files.parquet")).select("path", "snapshot_no", "change")


def p2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshots.listing_changes(spark.read.parquet(f"{sf_dir}/files.parquet"))
    return changes.groupBy("repository", "snapshot_no", "change").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.broken_links(spark.read.parquet(f"{sf_dir}/code.parquet"))


def p7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.placed_nodes(spark.read.parquet(f"{sf_dir}/code.parquet"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(spark.read.parquet(f"{sf_dir}/code.parquet"))


QUERIES = {"p2_found": p2_found, "p2_change_counts": p2_change_counts, "p7_found": p7_found, "p7_nodes": p7_nodes, "p7_descendants": p7_descendants}

_HELD = r"""
with t as (
  select regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^\./', '') as path, snapshot_no, delivered_at, lower(hash) as hash, lower(commit_hash) as c
  from files where path is not null and snapshot_no is not null),
h as (
  select path, snapshot_no, split_part(path, '/', 1) as repo, hash, c from t where path <> ''
  qualify row_number() over (partition by path, snapshot_no order by delivered_at desc nulls last, hash desc nulls last, c desc nulls last) = 1),
l as (
  select repo, snapshot_no, lag(snapshot_no) over (partition by repo order by snapshot_no) as before from (select distinct repo, snapshot_no from h)),
now as (select h.*, l.before from h join l using (repo, snapshot_no) where l.before is not null),
was as (select h.*, l.snapshot_no as at from h join l on h.repo = l.repo and h.snapshot_no = l.before),
d as (
  select coalesce(n.repo, w.repo) as repository, coalesce(n.path, w.path) as path, coalesce(n.snapshot_no, w.at) as snapshot_no,
    case when w.path is null then 'added' when n.path is null then 'removed' when n.hash is distinct from w.hash then 'changed'
      when not starts_with(n.c, w.c) and not starts_with(w.c, n.c) then 'recommitted' end as change
  from now n full join was w on n.path = w.path and n.snapshot_no = w.at)
"""

_REACH = """
with recursive n as (
  select id, parent, kind, depth from code where id is not null
  qualify row_number() over (partition by id order by sibling_order nulls last, parent nulls last, depth nulls last, kind nulls last) = 1),
reach(id, anc) as (
  select id, parent from n where parent is not null
  union
  select r.id, n.parent from reach r join n on r.anc = n.id where n.parent is not null),
ring as (select distinct id from reach where id = anc),
below as (select distinct r.id from reach r join ring on r.anc = ring.id where r.id not in (select id from ring)),
steps as (select id, count(*) as steps from reach group by id),
tops as (
  select r.id, r.anc as top from reach r left join n on r.anc = n.id where n.parent is null
  union all select id, id from n where parent is null),
state as (
  select n.id, n.depth, coalesce(s.steps, 0) as steps, t.top, tn.kind as top_kind, tn.id as top_id
  from n left join steps s on n.id = s.id left join tops t on n.id = t.id left join n tn on t.top = tn.id)
"""

SQL = {
    "p2_found": _HELD + "select path, snapshot_no, change from d where change is not null",
    "p2_change_counts": _HELD + "select repository, snapshot_no, change, count(*) as n from d where change is not null group by all",
    "p7_found": _REACH + """
select s.id, case when s.id in (select id from ring) then 'cycle' when s.id in (select id from below) then 'below_cycle'
  when s.top_id is null or s.top_kind is distinct from 'codebase' then 'no_root' else 'wrong_depth' end as issue
from state s
where s.id in (select id from ring) or s.id in (select id from below) or s.top_id is null or s.top_kind is distinct from 'codebase' or s.depth is distinct from s.steps""",
    "p7_descendants": """
with recursive n as (
  select id, parent from code where id is not null
  qualify row_number() over (partition by id order by sibling_order nulls last, parent nulls last, depth nulls last, kind nulls last) = 1),
sound(id) as (
  select id from n where parent is null or parent not in (select id from n)
  union all select n.id from n join sound on n.parent = sound.id),
d(descendant, ancestor, distance) as (
  select n.id, n.parent, 1 from n join sound using (id) where n.parent in (select id from n)
  union all select d.descendant, n.parent, d.distance + 1 from d join n on d.ancestor = n.id where n.parent in (select id from n))
select ancestor, descendant, distance from d""",
    "p7_nodes": _REACH + """,
m as (
  select id, parent, lpad(cast(coalesce(sibling_order, 999999) as varchar), 6, '0') || ' ' || id as place from code where id is not null
  qualify row_number() over (partition by id order by sibling_order nulls last, parent nulls last, depth nulls last, kind nulls last) = 1),
down(id, root, steps, path, order_key) as (
  select id, id, 0, id, place from m where parent is null or parent not in (select id from m)
  union all select m.id, d.root, d.steps + 1, d.path || ' > ' || m.id, d.order_key || chr(1) || m.place from m join down d on m.parent = d.id),
below_ as (select r.anc as id, count(*) as n from reach r join down on r.id = down.id group by r.anc)
select m.id, d.root, d.steps, d.path, d.order_key, case when d.id is not null then coalesce(b.n, 0) end as n_descendants,
  case when m.id in (select id from ring) then 'cycle' when m.id in (select id from below) then 'below_cycle'
    when s.top_id is null or s.top_kind is distinct from 'codebase' then 'no_root' when s.depth is distinct from s.steps then 'wrong_depth' end as issue
from m left join down d on m.id = d.id left join below_ b on m.id = b.id left join state s on m.id = s.id""",
}
