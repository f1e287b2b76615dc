"""Queries of the index build, edits, symbol extraction, evidence and task rules, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import scalars
from treeloom.functions.text import extension, first_segment
from treeloom.operators import edits, evidence, hierarchy, indexing, sessions, summaries, symbols, tables, tasks, trees
from treeloom.queries.reference import EVENTS, FILES, LANG, RANKED, SCOPES, C, code_rows, listed, log_events, spoken, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def texts_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, language, text`` put together from leaves, with the language of the extension."""
    leaves = code_rows(spark, sf_dir, "id", "file", "line_start", "source").where("source is not null and file is not null").select("file", "line_start", "source").distinct()
    whole = leaves.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "source"))), lambda x: x["source"]), "\n").alias("text"))
    known = table(spark, sf_dir, "languages").select(F.lower("extension").alias("ext"), "language").distinct()
    return whole.withColumn("ext", extension(F.col("file"))).join(known, "ext", "left").select("file", "language", "text")


# --- index rows

@query()
def t30_index_rows(spark, sf_dir):
    """No SQL: a level's blocks depend on those above; tested on stated files and against the rules one by one."""
    return indexing.file_rows(texts_of_files(spark, sf_dir))


@query(C + r""", l as (select distinct file, line_start, source from c where source is not null and file is not null), t as (select file, string_agg(source, chr(10) order by line_start, source) as text from l group by file),
n as (select file, text, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) as n_lines from t)
select file, cast(n_lines as int) as n_lines, regexp_matches(text, '[^ \t\n\v\f\r\x{00A0}]') as has_children from n where not ends_with(lower(file), '.md')""")
def t13_file_rows(spark, sf_dir):
    rows = indexing.file_rows(texts_of_files(spark, sf_dir)).where("kind = 'file' and not endswith(lower(file), '.md')")
    return rows.select("file", "n_lines", (F.col("n_children") > 0).alias("has_children"))


@query(C + r""", l as (select distinct file, line_start, source from c where source is not null and file is not null and ends_with(lower(file), '.md')), t as (select file, string_agg(source, chr(10) order by line_start, source) as text from l group by file),
x as (select file, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from t),
f as (select *, coalesce(sum(case when starts_with(trim(line, E' \t\r'), '```') then 1 else 0 end) over (partition by file order by line_no rows between unbounded preceding and 1 preceding), 0) as fences from x)
select file, line_no::int as line_no, replace(regexp_replace(trim(line, E' \t\r'), '^#+\s*', ''), '`', '') as name from f where fences % 2 = 0 and regexp_matches(trim(line, E' \t\r'), '^#{1,6}\s+')""")
def t12_headings(spark, sf_dir):
    """Headings of Markdown files as the functions of the index; a heading's row begins at it, or before it at blank lines that lead the file."""
    rows = indexing.file_rows(texts_of_files(spark, sf_dir).where("endswith(lower(file), '.md')")).where("kind = 'function'")
    first = F.filter(F.transform(F.split("source", "\n", -1), lambda x, k: F.struct(k.alias("k"), F.trim(x).alias("x"))), lambda s: s["x"].rlike("^#"))[0]["k"]
    return rows.select("file", (F.col("line_start") + first).alias("line_no"), "name")


# --- edits

@query(C + r""", l as (select distinct id, string_split(source, chr(10)) as ls from c where source is not null) select id, case when len(ls) >= 3 then array_to_string(ls[:1] || ['one', 'two'] || ls[4:], chr(10)) end as source from l""")
def f3_spliced(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "source").where("source is not null")
    return rows.select("id", edits.spliced(F.col("source"), F.lit(2), F.lit(3), F.lit("one\ntwo\n")).alias("source"))


@query(C + r""", l as (select distinct id, string_split(regexp_replace(source, '\n$', ''), chr(10)) as ls from c where source is not null) select id, case when len(ls) >= 4 then array_to_string(ls[2:4], chr(10)) end as part from l""")
def f2_slices(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "source").where("source is not null")
    return rows.select("id", edits.sliced(F.col("source"), F.lit(2), F.lit(4)).alias("part"))


@query(C + r""", l as (select distinct id, source, string_split(source, chr(10)) as ls from c where source is not null), m as (select *, list_filter(range(1, len(ls) + 1), lambda i: regexp_full_match(ls[i], ' *return src')) as hit from l),
p as (select *, regexp_extract(ls[hit[1]], '^( *)', 1) as pad from m)
select id, len(hit)::int as n_found, case when len(hit) = 0 then 'not_found' when len(hit) > 1 then 'more_left' else 'replaced' end as state,
case when len(hit) = 0 then source else array_to_string(ls[:hit[1] - 1] || [pad || 'return (', pad || '    src', pad || ')'] || ls[hit[1] + 1:], chr(10)) end as source from p""")
def e2_edits(spark, sf_dir):
    return edits.edited(code_rows(spark, sf_dir, "id", "source"), "    return src", "return (\n    src\n)")


@query(C + r""", l as (select distinct id, source from c where source is not null) select id, len(regexp_extract_all(source, '[0-9]+'))::int as n_found, regexp_replace(source, '[0-9]+', '<n>') as source from l""")
def f7_first_number(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "source").where("source is not null")
    return rows.select("id", F.regexp_count("source", F.lit("[0-9]+")).alias("n_found"), edits.replaced_first(F.col("source"), "[0-9]+", "<n>").alias("source"))


@query()
def e5_reindexed(spark, sf_dir):
    """No SQL, as for the index: every file with a return of its own is edited, built anew and put in place of its rows; summaries of ids that stay are kept."""
    files = texts_of_files(spark, sf_dir)
    old = indexing.file_rows(files)
    summaries = old.where("n_children > 0").select("id", F.concat_ws(" ", "kind", "name").alias("summary"))
    text = edits.replaced_lines(F.col("text"), "return src", "return (\n    src\n)", 1)
    changed = files.where(F.size(edits.line_matches(F.col("text"), "return src")) > 0).withColumn("text", text)
    return indexing.reindexed(old, changed, summaries)


# --- symbols from texts

WORDS = ", ".join(f"'{w}'" for w in symbols.RESERVED)
TEXT_SYMBOLS = C + LANG + SCOPES + rf""", lv as (select distinct id, source from x where source is not null and lang <> 'markdown'),
tk as (select id, unnest(regexp_extract_all(source, '([A-Za-z_][A-Za-z0-9_]*)[ ]*(\(?)')) as t from lv),
nm as (select id, symbol, bool_or(called) as called from (select id, regexp_extract(t, '^([A-Za-z0-9_]+)', 1) as symbol, ends_with(t, '(') as called from tk) where symbol not in ({WORDS}) group by id, symbol),
df as (select distinct sc.scope, d.symbol from (
  select id, unnest(regexp_extract_all(source, '([A-Za-z_][A-Za-z0-9_]*)[ ]*=[^=]', 1)) as symbol from lv
  union select id, unnest(regexp_extract_all(source, '(?:def|function|macro|class|struct|module|const|let|var|auto|for)[ ]+([A-Za-z_][A-Za-z0-9_]*)', 1)) from lv) d join sc using (id)),
"""


@query(TEXT_SYMBOLS + """o as (select id as node_id, symbol, 'call' as kind from nm where called
  union all select nm.id, symbol, 'var_ref' from nm join sc using (id) where not called and not exists (select 1 from df where df.scope = sc.scope and df.symbol = nm.symbol)) select * from o""")
def y3_text_symbols(spark, sf_dir):
    return symbols.text_symbols(spoken(spark, sf_dir))


@query(C + LANG + rf""", kn as (select distinct name from x where kind in ('function', 'class', 'type', 'variable', 'import') and lang <> 'markdown' and name is not null),
md as (select distinct id, source from x where source is not null and lang = 'markdown'),
fe as (select id, unnest(range(len(ms))) as pos, unnest(ms) as m from (select id, regexp_extract_all(source, '(?s)```[A-Za-z0-9_+#-]*\n.*?```') as ms from md)),
fx as (select id, pos, lower(regexp_extract(m, '^```([A-Za-z0-9_+#-]*)', 1)) as tag, regexp_extract(m, '(?s)^```[A-Za-z0-9_+#-]*\n(.*?)```$', 1) as text from fe),
tg as (select * from fx where tag in ('julia', 'cpp', 'python', 'javascript')),
tk as (select id, pos, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)[ ]*(\(?)')) as t from tg),
nm as (select id, pos, symbol, bool_or(called) as called from (select id, pos, regexp_extract(t, '^([A-Za-z0-9_]+)', 1) as symbol, ends_with(t, '(') as called from tk) where symbol not in ({WORDS}) group by id, pos, symbol),
df as (select id, pos, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)[ ]*=[^=]', 1)) as symbol from tg
  union select id, pos, unnest(regexp_extract_all(text, '(?:def|function|macro|class|struct|module|const|let|var|auto|for)[ ]+([A-Za-z_][A-Za-z0-9_]*)', 1)) from tg),
ind as (select id, unnest(string_split(source, chr(10))) as text from md),
un as (select id, text from fx where tag = '' union all select id, text from ind where starts_with(text, '    ') or starts_with(text, chr(9))),
ut as (select id, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)[ ]*(\(?)')) as t from un)
select id as node_id, symbol, 'call' as kind from nm where called
union select nm.id, symbol, 'var_ref' from nm where not called and not exists (select 1 from df where df.id = nm.id and df.pos = nm.pos and df.symbol = nm.symbol)
union select id, regexp_extract(t, '^([A-Za-z0-9_]+)', 1) as symbol, case when ends_with(t, '(') then 'call' else 'var_ref' end from ut where regexp_extract(t, '^([A-Za-z0-9_]+)', 1) in (select name from kn)""")
def y9_markdown_symbols(spark, sf_dir):
    rows = spoken(spark, sf_dir)
    return symbols.markdown_symbols(rows, symbols.known_names(rows), ["julia", "cpp", "python", "javascript"])


# --- evidence

FIRST = C + """, fc as (select c.parent, arg_min(c.id, struct_pack(a := c.sibling_order is null, o := c.sibling_order, i := c.id)) as first from c where c.parent in (select id from c) group by c.parent),
w as (select id, id as leaf, 0 as n from c union select w.id, fc.first, n + 1 from w join fc on w.leaf = fc.parent where n < 60),
pl as (select id, leaf from w where leaf not in (select parent from fc)),
kw as (select pl.id, lower(case when length(c.source) > 400 then left(c.source, 400) || '...' else c.source end) as t from pl join (select distinct id, source from c) c on c.id = pl.leaf where c.source is not null),
ks as (select id, max((case when contains(t, 'src') then 1 else 0 end) + (case when contains(t, 'cache') then 1 else 0 end)) as n_distinct, max((length(t) - length(replace(t, 'src', ''))) // 3 + (length(t) - length(replace(t, 'cache', ''))) // 5) as n_total from kw group by id),
cs as (select c.*, ks.n_distinct, ks.n_total from c left join ks using (id))
"""


@query(FIRST.replace("with c as", "with recursive c as", 1) + RANKED.format(words="coalesce(n_distinct, 0) desc, coalesce(n_total, 0) desc,", rows="cs") + "select parent, id, case when n <= 5 then natural_rank else scored_rank end as rank from r where n <= 5 or scored_rank <= 5")
def o4_children_by_keywords(spark, sf_dir):
    """Keywords are counted in the first 400 characters of each child's first leaf, which is its witness: a stated bound of the evidence."""
    rows = code_rows(spark, sf_dir, "id", "parent", "kind", "name", "summary", "n_lines", "sibling_order", "source", "depth")
    nodes = rows.select("id", "parent", "kind", "depth", "sibling_order").distinct()
    inner = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    own = nodes.select("id").join(inner, "id", "left_anti").select("id", F.col("id").alias("leaf"))
    leaves = trees.first_leaves(nodes, sound_only=False).unionByName(own)
    witness = leaves.join(rows.where("source is not null").select(F.col("id").alias("leaf"), scalars.clipped(F.col("source"), 400).alias("text")).distinct(), "leaf").select("id", "text")
    return trees.ranked_children(rows.drop("source", "depth"), 5, evidence.keyword_scores(witness, "id", "text", ["src", "cache"]))[0]


@query("""with recursive n as (select distinct id, parent, sibling_order, kind from code where id is not null),
down(id, top, line) as (select id, id, [struct_pack(missing := sibling_order is null, o := sibling_order, id := id)] from n where parent is null or parent not in (select id from n)
  union all select n.id, down.top, list_append(down.line, struct_pack(missing := n.sibling_order is null, o := n.sibling_order, id := n.id)) from n join down on n.parent = down.id),
leaves as (select * from down where id not in (select parent from n where parent is not null)),
over_ as (select unnest(line).id as id, id as leaf, line from leaves)
select o.id, leaf, row_number() over (partition by o.id order by line) - 1 as position from over_ o where o.id in (select id from n where kind = 'file')""")
def o9_ordered_leaves(spark, sf_dir):
    nodes = trees.nodes_of(table(spark, sf_dir, "code"))
    return trees.ordered_leaves(nodes.where("kind = 'file'"), nodes)


@query(C + r""", r as (select distinct parent as id, id as readme from c where name = 'README.md' and parent is not null), l as (select distinct file, line_start, source from c where source is not null),
t as (select r.id, string_agg(l.source, chr(10) || chr(10) order by l.line_start) as text from r join l on l.file = r.readme group by r.id)
select id, case when length(text) > 3000 then left(text, 3000) || '...' else text end as text from t""")
def v4_readme_texts(spark, sf_dir):
    """The read-me text of a folder: its leaves with a blank line between, at most 3,000 characters, which is the rule's bound."""
    rows = code_rows(spark, sf_dir, "id", "parent", "name", "file", "line_start", "source")
    readmes = rows.where("name = 'README.md' and parent is not null").select(F.col("parent").alias("folder"), F.col("id").alias("file")).distinct()
    leaves = rows.where("source is not null").select("file", "line_start", "source").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "source"))), lambda x: x["source"]), "\n\n")
    return readmes.join(leaves, "file").groupBy(F.col("folder").alias("id")).agg(scalars.clipped(text, 3_000).alias("text"))


@query(C + """, k as (select parent as id, list(kind) as kinds from c where parent is not null group by parent)
select id, case when 0 < len(list_filter(kinds, lambda k: k = 'file')) and len(list_filter(kinds, lambda k: k = 'file')) < len(kinds) then 'mixed'
  when len(kinds) >= 6 and len(list_filter(kinds, lambda k: k = 'chunk')) * 2 >= len(kinds) then 'chunks' end as advisory from k""")
def f25_advisories(spark, sf_dir):
    kinds = code_rows(spark, sf_dir, "*").where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.collect_list("kind").alias("kinds"))
    return kinds.select("id", scalars.advisory(F.col("kinds")).alias("advisory"))


@query(C + "select id, base64(encode(source)) as packed, case when length(source) > 400 then left(source, 400) || '...' else source end as witness from (select distinct id, source from c where source is not null)")
def f19_packed(spark, sf_dir):
    """Base64 there and back, and the witness of a leaf: its first 400 characters with three dots after them."""
    rows = code_rows(spark, sf_dir, "id", "source").where("source is not null")
    packed = F.regexp_replace(F.base64(F.encode("source", "UTF-8")), "[\r\n]", "")
    return rows.select("id", packed.alias("packed"), scalars.clipped(F.decode(F.unbase64(packed), "UTF-8"), 400).alias("witness"))


@query("select event_id, json_valid(props) and list_sort(json_keys(props)) = ['k'] as is_strict from (select distinct * from events)")
def f26_strict_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").distinct().select("event_id", scalars.has_keys(F.col("props"), ["k"]).alias("is_strict"))


# --- sessions

@query(EVENTS + "select doc_id, arg_max(json_extract_string(raw, '$.output'), line_no) as content from e where type = 'llm_response' group by doc_id")
def l7_final_messages(spark, sf_dir):
    return sessions.final_messages(log_events(spark, sf_dir), "doc_id", "line_no")


@query("select coalesce(max(try_cast(split_part(regexp_extract(path, '([^/]+)$', 1), '.', 1) as int)), 0) + 1 as next_id, count(distinct path) as n_paths from files")
def a9_next_number(spark, sf_dir):
    rows = table(spark, sf_dir, "files")
    number = F.substring_index(F.regexp_extract("path", "([^/]+)$", 1), ".", 1).try_cast("int")
    return rows.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id"), F.countDistinct("path").alias("n_paths"))


# --- changed files

CHANGES = """with d as (select distinct * from change_status where path is not null), diff as (select path, max(struct_pack(status := status, old_path := old_path)) as d from d where status not in ('untracked', 'unmerged') group by path),
t as (select path, case when bool_or(status = 'unmerged') then 'unmerged' else 'untracked' end as tree, bool_or(git_has_staged) as s, bool_or(git_has_unstaged) as u from d where status in ('untracked', 'unmerged') group by path),
b as (select distinct path from d where is_binary), i as (select distinct file as path from code where file is not null), st as (select distinct path from d where git_has_staged and status not in ('untracked', 'unmerged')),
un as (select distinct path from d where git_has_unstaged and status not in ('untracked', 'unmerged') union select path from d where status = 'untracked'),
j as (select coalesce(diff.path, t.path) as path, diff.d, t.* exclude (path) from diff full join t on diff.path = t.path)
select path, case when tree is null then d.old_path end as old_path, coalesce(tree, d.status) as status, coalesce(tree, '') <> 'unmerged' and path in (select path from b) as is_binary,
  coalesce(tree, '') <> 'untracked' and path in (select path from i) as is_indexed,
  case when tree = 'unmerged' then s or path in (select path from st) when tree = 'untracked' then false else path in (select path from st) end as git_has_staged,
  case when tree = 'unmerged' then u or path in (select path from un) when tree = 'untracked' then true else path in (select path from un) end as git_has_unstaged from j
"""


@query(CHANGES)
def g1_file_changes(spark, sf_dir):
    """All changed files, put together again from their parts: the entries of the difference, the working tree, and the paths that are binary, indexed, staged and not staged."""
    d = table(spark, sf_dir, "change_status").where("path is not null").distinct()
    entries, tree = d.where("status not in ('untracked', 'unmerged')"), d.where("status in ('untracked', 'unmerged')")
    working = tree.select("path", "status", F.col("git_has_staged").alias("has_staged"), F.col("git_has_unstaged").alias("has_unstaged"))
    indexed = table(spark, sf_dir, "code").where("file is not null").select(F.col("file").alias("path")).distinct()
    return tables.file_changes(entries.select("path", "old_path", "status"), working, d.where("is_binary"), indexed, entries.where("git_has_staged"), entries.where("git_has_unstaged"), "all")


# --- tasks: every node is to be documented, and is done when it has a summary

TASKS = """with recursive n as (select id, parent, sibling_order, depth, kind, summary, file, line_start from code where id is not null
  qualify row_number() over (partition by id order by sibling_order nulls last, parent nulls last, depth nulls last, kind nulls last, summary nulls last, file nulls last, line_start nulls last) = 1),
t as (select split_part(id, '/', 1) as list_id, id, parent, case when summary is null then 'pending' else 'done' end as status, row_number() over (partition by split_part(id, '/', 1) order by file nulls first, line_start nulls first, depth nulls first, id) as row_no from n),
up(id, anc) as (select id, id from t union select up.id, t.parent from up join t on up.anc = t.id where t.parent in (select id from t)),
sound as (select id from t where id not in (select u.id from up u join t on u.anc = t.id join up v on v.id = u.id and v.anc = t.parent where t.parent is not null and exists (select 1 from up w where w.id = t.parent and w.anc = u.anc)))
"""


def task_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``list_id, id, parent, kind, depth, sibling_order, status, row_no``: one row per node, in the order of files and lines."""
    names = ["sibling_order", "parent", "depth", "kind", "summary", "file", "line_start"]
    best = F.min(F.struct(*[x for c in names for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))])).alias("b")
    rows = table(spark, sf_dir, "code").where("id is not null").groupBy("id").agg(best).select("id", *[F.col("b")[c].alias(c) for c in names])
    order = Window.partitionBy("list_id").orderBy(F.col("file").asc_nulls_first(), F.col("line_start").asc_nulls_first(), F.col("depth").asc_nulls_first(), "id")
    return rows.withColumn("list_id", first_segment(F.col("id"))).select(
        "list_id", "id", "parent", "kind", "depth", "sibling_order", F.when(F.col("summary").isNull(), "pending").otherwise("done").alias("status"), F.row_number().over(order).alias("row_no"))


@query(TASKS + "select up.anc as id, max(t.row_no) as end_row from up join t using (id) where up.id in (select id from sound) group by up.anc")
def k4_subtree_ends(spark, sf_dir):
    return tasks.subtree_ends(task_nodes(spark, sf_dir), "row_no")


@query(TASKS + """, inner_ as (select distinct parent as id from t where parent is not null), open_ as (select up.anc as id, count_if(t.id not in (select id from inner_) and t.status <> 'done') as n from up join t using (id) where up.id in (select id from sound) group by up.anc)
select id, case when n = 0 then 'done' else 'pending' end as status from open_ where id in (select id from inner_)""")
def a11_folded_states(spark, sf_dir):
    return tasks.folded_states(task_nodes(spark, sf_dir))


@query(TASKS + """, p as (select list_id, min(row_no) as row_no from t where status = 'pending' and id not in (select parent from t where parent is not null) group by list_id), a as (select t.list_id, t.id from p join t using (list_id, row_no)),
s as (select up.id, anc, a.list_id from up join a using (id) where up.id in (select id from sound)), dp as (select s.anc, count(*) as depth from (select distinct anc from s) s join up on up.id = s.anc group by s.anc)
select s.list_id, dp.depth::int as depth, s.anc as id from s join dp using (anc)
union all select a.list_id, 1, a.id from a where a.id not in (select id from sound)""")
def k7_focus_paths(spark, sf_dir):
    rows = task_nodes(spark, sf_dir)
    active = tasks.next_pending(rows, "row_no")
    return tasks.focus_paths(rows, active)


@query(TASKS + """, p as (select list_id, min(row_no) as row_no from t where status = 'pending' and id not in (select parent from t where parent is not null) group by list_id), a as (select t.list_id, t.id from p join t using (list_id, row_no)),
above as (select distinct up.anc as id from up join a using (id) where up.anc <> up.id and up.id in (select id from sound))
select list_id, case when id in (select id from a) then 'in_progress' when id in (select id from above) then 'pending' else status end as status, count(*) as n from t group by all""")
def k5_started(spark, sf_dir):
    rows = task_nodes(spark, sf_dir)
    return tasks.started(rows, tasks.next_pending(rows, "row_no")).groupBy("list_id", "status").agg(F.count("*").alias("n"))


@query(TASKS + """, hop(id, got, k) as (select id, parent, 1 from t where parent in (select id from t) union all select hop.id, t.parent, k + 1 from hop join t on hop.got = t.id where hop.got <> hop.id and k < 200 and t.parent in (select id from t)),
size as (select id, min(k) as n from hop where got = id group by id), lead_ as (select h.id, min(h.got) as ring from hop h join size s using (id) where h.k <= s.n group by h.id),
away as (select l.id, l.ring, coalesce(min(h.k), 0) as k from lead_ l left join hop h on h.id = l.ring and h.got = l.id and l.id <> l.ring group by all)
select ring, k as position, id from away""")
def k3_cycles(spark, sf_dir):
    return hierarchy.cycles(task_nodes(spark, sf_dir))


# --- small rules over whole tables

@query(FILES + """, p as (select max(snapshot_no) as m from f), a as (select path, commit_hash, hash from f, p where snapshot_no = m - 1), b as (select path, commit_hash, hash from f, p where snapshot_no = m)
select coalesce(b.path, a.path) as path, coalesce(b.hash, a.hash) as hash, coalesce(b.commit_hash, a.commit_hash) as commit_hash from a full join b on a.path = b.path""")
def s24_overlaid(spark, sf_dir):
    """The last listing over the one before: its values count where it has any."""
    rows = listed(spark, sf_dir)
    last = rows.agg(F.max("snapshot_no")).first()[0] or 0
    part = lambda no: rows.where(F.col("snapshot_no") == no).select("path", "hash", "commit_hash")
    return tables.overlaid(part(last), part(last - 1), "path")


@query("""select distinct path from change_status where path is not null and (git_has_staged or git_has_unstaged or status = 'untracked')""")
def u1_touched_paths(spark, sf_dir):
    d = table(spark, sf_dir, "change_status").where("path is not null")
    return d.where("git_has_staged").select("path").unionByName(d.where("git_has_unstaged").select("path")).unionByName(d.where("status = 'untracked'").select("path")).distinct()


@query(C + """, r as (select distinct id, depth, file, line_start from c) select id, row_number() over (partition by coalesce(file, id) order by depth nulls first, line_start nulls first, id) as place from r""")
def o3_path_order(spark, sf_dir):
    """Places of the nodes of each file by depth and line; files follow each other by depth and name, so no window spans more than one."""
    rows = code_rows(spark, sf_dir, "id", "depth", "file", "line_start")
    w = Window.partitionBy(F.coalesce("file", "id")).orderBy(F.col("depth").asc_nulls_first(), F.col("line_start").asc_nulls_first(), "id")
    return rows.select("id", F.row_number().over(w).alias("place"))


@query("""with d as (select doc_id, max(text) as text, max(workspace) as workspace from documents where doc_id is not null group by doc_id)
select workspace, cast(sum(greatest(1, length(coalesce(text, '')) // 4)) as bigint) as tokens, sum(greatest(1, length(coalesce(text, '')) // 4)) > 120000 as is_due from d where workspace is not null group by workspace""")
def l3_due_compactions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("workspace").alias("workspace"))
    total = d.where("workspace is not null").groupBy("workspace").agg(F.sum(sessions.token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))
    return total.select("workspace", "tokens", (F.col("tokens") > 120_000).alias("is_due"))


@query(C + r""", f as (select distinct id, source from c where kind in ('function', 'method') and source is not null),
l as (select id, list_filter(list_transform(string_split(regexp_replace(source, '^\s*\"\"\"([^\"]|\"[^\"]|\"\"[^\"])*\"\"\"', ''), chr(10)), lambda x: trim(regexp_replace(x, '\r$', ''), ' ')), lambda x: x <> '' and not regexp_matches(x, '^(#|//|/\*|\*|@)')) as ls from f)
select id, ls[1] as line from l""".replace('\\"', '"'))
def d5_declaration_lines(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "kind", "source").where("kind in ('function', 'method') and source is not null")
    return rows.select("id", "source").distinct().select("id", summaries.declaration_line(F.col("source")).alias("line"))


@query(C + """, k as (select lower(extension) as ext, language from languages where extension not in ('.h', '.jl') union all select '.h', 'cpp' union all select '.jl', 'julia1'), x as (select distinct file, lower(regexp_extract(file, '(\\.[^./]+)$', 1)) as ext from c where file is not null)
select k.language, count(*) as n_files from x left join k on x.ext = k.ext group by k.language""")
def y14_overridden_languages(spark, sf_dir):
    """Files by the languages of a table of extensions with two rows overridden."""
    base = table(spark, sf_dir, "languages").select("extension", "language").distinct()
    changes = spark.createDataFrame([(".h", "cpp"), (".jl", "julia1")], "extension string, language string")
    known = tables.overridden(base, changes, "extension").select(F.lower("extension").alias("ext"), "language")
    files = code_rows(spark, sf_dir, "id", "file").where("file is not null").select("file", extension(F.col("file")).alias("ext")).distinct()
    return files.join(known, "ext", "left").groupBy("language").agg(F.count("*").alias("n_files"))
