
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import scalars
from treeloom.functions.text import clean_path, extension, first_segment
from treeloom.operators import evidence, lines, sessions, snapshots, summaries, symbols, tables, tasks, trees

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct rows of the code table on the given columns, which hold the id."""
    return table(spark, sf_dir, "code").where("id is not null").select(*columns).distinct()


C = "with c as (select distinct * from code where id is not null)\n"
FILES = r"""with t as (select regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^\./', '') as path, snapshot_no, delivered_at, lower(hash) as hash, lower(commit_hash) as commit_hash from files),
f as (select * from t where path is not null and path <> '' and snapshot_no is not null qualify row_number() over (partition by path, snapshot_no order by delivered_at desc nulls last, hash desc nulls last, commit_hash desc nulls last) = 1)
"""
LINES = r"""with d as (select doc_id, max(text) as text from documents where text is not null group by doc_id),
l as (select doc_id, unnest(range(1, len(string_split(t, chr(10))) + 1)) as line_no, unnest(string_split(t, chr(10))) as line from (select doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', '') as t from d)),
f as (select *, regexp_matches(line, '^[ \t\n\v\f\r]*$') as blank from l)
"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files table with clean paths, one row per path and listing."""
    rows = table(spark, sf_dir, "files").select(clean_path(F.col("path")).alias("path"), "snapshot_no", "delivered_at", F.lower("hash").alias("hash"), F.lower("commit_hash").alias("commit_hash"))
    return snapshots.latest_versions(rows.where("path <> '' and snapshot_no is not null"), ["path", "snapshot_no"], "delivered_at", ["hash", "commit_hash"])


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    return lines.line_features(lines.numbered_lines(texts, "doc_id", "text"))


# --- trees

@query(C + "select c.id, count(k.id) as n_found from c left join c k on k.parent = c.id group by c.id")
def a2_child_counts(spark, sf_dir):
    return trees.child_counts(trees.nodes_of(table(spark, sf_dir, "code")))


@query(C + "select id, row_number() over (partition by parent order by sibling_order nulls last, id) - 1 as position from c where parent is not null")
def w2_sibling_positions(spark, sf_dir):
    return trees.sibling_positions(trees.nodes_of(table(spark, sf_dir, "code")))


@query(C + "select id, name || case when n > 1 then '$' || n else '' end as ordinal_id from (select id, name, row_number() over (partition by parent, name order by line_start nulls last, sibling_order nulls last, id) as n from c where name is not null)")
def t10_ordinal_ids(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "parent", "name", "line_start", "sibling_order").where("name is not null")
    order = [F.col("line_start").asc_nulls_last(), F.col("sibling_order").asc_nulls_last(), F.col("id")]
    return trees.ordinal_ids(rows, "parent", "name", order).select("id", "ordinal_id")


@query("""with recursive n as (select distinct id, parent, coalesce(n_lines, 0) as v from code where id is not null),
up(id, anc) as (select id, id from n union select up.id, n.parent from up join n on up.anc = n.id where n.parent in (select id from n)),
ring as (select distinct r.id from (select a.id, n.parent as p from up a join n on a.anc = n.id) r where r.p = r.id),
sound as (select id from n where id not in (select up.id from up join ring on up.anc = ring.id))
select up.anc as id, count(*) as n_nodes, cast(sum(n.v) as bigint) as total from up join n on up.id = n.id where up.id in (select id from sound) and up.anc in (select id from sound) group by up.anc""")
def a8_subtree_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "code").where("id is not null").select("id", "parent", "kind", "depth", "sibling_order", F.coalesce("n_lines", F.lit(0)).alias("v")).distinct()
    return trees.subtree_totals(rows, "v")


@query("""with recursive n as (select distinct id, parent, sibling_order from code where id is not null),
down(id, top, line) as (select id, id, [struct_pack(missing := sibling_order is null, o := sibling_order, id := id)] from n where parent is null or parent not in (select id from n)
  union all select n.id, down.top, list_append(down.line, struct_pack(missing := n.sibling_order is null, o := n.sibling_order, id := n.id)) from n join down on n.parent = down.id),
leaves as (select * from down where id not in (select parent from n where parent is not null)),
over_ as (select unnest(line[:-2]).id as id, id as leaf, line from leaves)
select id, arg_min(leaf, line) as leaf from over_ group by id""")
def o8_first_leaves(spark, sf_dir):
    return trees.first_leaves(trees.nodes_of(table(spark, sf_dir, "code")))


@query("""with recursive n as (select distinct id, parent, kind from code where id is not null), s as (select id from n where kind in ('module', 'file', 'class')),
up(id, anc) as (select id, parent from n where id in (select id from s) and parent is not null union select up.id, n.parent from up join n on up.anc = n.id where n.parent is not null),
bad as (select id from up where anc = id), lost as (select distinct u.id from up u join up r on u.anc = r.id and r.anc = r.id)
select id from s where id not in (select up.id from up join s on up.anc = s.id where up.id not in (select id from bad) and up.id not in (select id from lost) and up.anc in (select id from n))""")
def o10_outermost(spark, sf_dir):
    nodes = trees.nodes_of(table(spark, sf_dir, "code"))
    return trees.outermost(nodes.where("kind in ('module', 'file', 'class')"), nodes)


RANKED = """, r as (select *, count(*) over (partition by parent) as n, row_number() over (partition by parent order by sibling_order nulls last, id) as natural_rank,
  row_number() over (partition by parent order by case when name = 'README.md' then 0 else 1 end, case when summary is null then 1 else 0 end,
  coalesce(case kind when 'module' then 1 when 'file' then 2 when 'class' then 3 when 'function' then 4 when 'type' then 5 when 'variable' then 6 when 'import' then 7 when 'loop' then 8 when 'conditional' then 9
    when 'try' then 10 when 'with' then 11 when 'comment' then 12 when 'chunk' then 13 end, 99), {words}
  coalesce(n_lines, 0) desc, sibling_order nulls last, id) as scored_rank from {rows} where parent is not null)
"""


@query(C + RANKED.format(words="", rows="c") + "select parent, id, case when n <= 5 then natural_rank else scored_rank end as rank from r where n <= 5 or scored_rank <= 5")
def o4_ranked_children(spark, sf_dir):
    return trees.ranked_children(code_rows(spark, sf_dir, "id", "parent", "kind", "name", "summary", "n_lines", "sibling_order"), 5)[0]


@query(C + RANKED.format(words="", rows="c") + "select parent, kind, count(*) as n_omitted from r where n > 5 and scored_rank > 5 group by parent, kind")
def o5_omitted_children(spark, sf_dir):
    return trees.ranked_children(code_rows(spark, sf_dir, "id", "parent", "kind", "name", "summary", "n_lines", "sibling_order"), 5)[1]


@query(C + """select kind, count(*) as n, count(source) as n_leaves, count_if(parent is null)::bigint as n_roots, cast(sum(n_lines) as bigint) as n_lines from c group by kind""")
def pr9_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "code").where("id is not null").distinct()
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("source").alias("n_leaves"), F.count_if(F.col("parent").isNull()).alias("n_roots"), F.sum("n_lines").alias("n_lines"))


@query(C + r""", k as (select distinct lower(extension) as ext, language as named from languages),
x as (select c.file, coalesce(nullif(lower(trim(c.language, ' ')), ''), k.named) as lang from c left join k on k.ext = lower(regexp_extract(c.file, '(\.[^./]+)$', 1)))
select lang, count(*) as n_rows, count(distinct file) as n_files from x group by lang""")
def s11_languages(spark, sf_dir):
    rows = trees.language_of(table(spark, sf_dir, "code").where("id is not null").distinct(), table(spark, sf_dir, "languages"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_rows"), F.countDistinct("file").alias("n_files"))


@query(C + "select split_part(id, '/', 1) as repository, kind, count(*) as n from c where parent is not null and parent not in (select id from c) group by all")
def j7_orphans(spark, sf_dir):
    nodes = trees.nodes_of(table(spark, sf_dir, "code"))
    lost = nodes.where("parent is not null").join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti")
    return lost.groupBy(first_segment(F.col("id")).alias("repository"), "kind").agg(F.count("*").alias("n"))


# --- spans and lines

@query(C + """select file, count_if(before is not null and line_start <> before + 1)::bigint as n_breaks, count_if(n_lines <> line_end - line_start + 1)::bigint as n_wrong, max(line_end) as last_line
from (select *, lag(line_end) over (partition by file order by line_start, line_end, id) as before from c where source is not null and file is not null) group by file""")
def t3_span_invariants(spark, sf_dir):
    leaves = code_rows(spark, sf_dir, "id", "file", "line_start", "line_end", "n_lines", "source").where("source is not null and file is not null")
    before = F.lag("line_end").over(Window.partitionBy("file").orderBy("line_start", "line_end", "id"))
    return leaves.withColumn("before", before).groupBy("file").agg(
        F.count_if(F.col("before").isNotNull() & (F.col("line_start") != F.col("before") + 1)).alias("n_breaks"),
        F.count_if(F.col("n_lines") != F.col("line_end") - F.col("line_start") + 1).alias("n_wrong"), F.max("line_end").alias("last_line"))


@query(C + """, s as (select distinct file, line_start, line_end from c where kind in ('function', 'method', 'class') and file is not null),
g as (select file, max(line_end) over w + 1 as gap_start, lead(line_start) over w - 1 as gap_end from s window w as (partition by file order by line_start, line_end))
select * from g where gap_start <= gap_end""")
def w3_gaps(spark, sf_dir):
    spans = code_rows(spark, sf_dir, "id", "kind", "file", "line_start", "line_end").where("kind in ('function', 'method', 'class') and file is not null").select("file", "line_start", "line_end").distinct()
    return lines.gaps(spans, "file")


@query(C + """, s as (select distinct file, line_start, line_end from c where kind in ('function', 'method', 'class', 'block') and file is not null and line_start is not null)
select * from s where not exists (select 1 from s o where o.file = s.file and o.line_start <= s.line_start and s.line_end <= o.line_end and (o.line_start < s.line_start or o.line_end > s.line_end))""")
def t19_outer_spans(spark, sf_dir):
    spans = code_rows(spark, sf_dir, "id", "kind", "file", "line_start", "line_end").where("kind in ('function', 'method', 'class', 'block') and file is not null and line_start is not null")
    return lines.outer_spans(spans, "file")


@query(C + """, m as (select distinct file, line_start, line_end from c where kind in ('comment', 'chunk') and source is not null and file is not null),
x as (select *, case when line_start = lag(line_end) over w + 1 then 0 else 1 end as cut from m window w as (partition by file order by line_start, line_end)),
y as (select *, sum(cut) over (partition by file order by line_start, line_end) as run from x)
select file, min(line_start) as line_start, max(line_end) as line_end, count(*) as n from y group by file, run""")
def t8_adjacent_runs(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "kind", "file", "line_start", "line_end", "source").where("kind in ('comment', 'chunk') and source is not null and file is not null")
    return lines.islands(rows.select("file", "line_start", "line_end").distinct(), "file", "line_start", "line_end")


@query(LINES + r""", x as (select *, greatest(1, sum(case when not blank and coalesce(b, true) then 1 else 0 end) over (partition by doc_id order by line_no))::bigint as paragraph
  from (select *, lag(blank) over (partition by doc_id order by line_no) as b from f))
select doc_id, paragraph, min(line_no) as line_start, max(line_no) as line_end from x group by doc_id, paragraph""")
def t21_paragraphs(spark, sf_dir):
    return lines.paragraphs(document_lines(spark, sf_dir), "doc_id")


@query(LINES + r""", m as (select *, regexp_matches(line, '^\s*(```|~~~)') as mark from f),
x as (select *, coalesce(sum(case when mark then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before from m),
b as (select doc_id, case when mark or before % 2 = 1 then 'fence' when blank then 'blank' when regexp_matches(line, '^#{1,6}\s') then 'heading' when regexp_matches(line, '^\s*(---+|\*\*\*+)\s*$') then 'rule'
  when regexp_matches(line, '^\s*([-*+]|\d+[.)])\s') then 'list' when regexp_matches(line, '^\s*\|') then 'table' else 'paragraph' end as block from x)
select doc_id, block, count(*) as n from b group by all""")
def t25_markdown_blocks(spark, sf_dir):
    return lines.markdown_blocks(document_lines(spark, sf_dir), "doc_id").groupBy("doc_id", "block").agg(F.count("*").alias("n"))


@query(LINES + r""", m as (select *, regexp_matches(line, '^\s*(```|~~~)') as mark from f),
x as (select *, coalesce(sum(case when mark then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before from m),
h as (select *, not mark and before % 2 = 0 and not blank and regexp_matches(line, '^#{1,6}\s') as heading from x),
s as (select *, sum(case when heading then 1 else 0 end) over (partition by doc_id order by line_no)::bigint as section_no from h)
select doc_id, section_no, max(case when heading then replace(regexp_replace(line, '^#+\s*', ''), '`', '') end) as title, min(line_no) as line_start, max(line_no) as line_end from s group by doc_id, section_no""")
def t12_sections(spark, sf_dir):
    rows = document_lines(spark, sf_dir)
    return lines.sections(rows, lines.markdown_blocks(rows, "doc_id"), "doc_id")


@query(r"""with l as (select distinct file, line_start, source from code where source is not null and file is not null),
p as (select file, line_start, string_split(replace(source, chr(13), ''), chr(10)) as ls from l), x as (select file, line_start + i as line_no, ls[i + 1] as line from p, unnest(range(len(ls))) as t(i)),
f as (select file, line_no, regexp_matches(line, '^[ \t\n\v\f\r]*$') as blank, regexp_matches(line, '^\s*(\}|\)|\]|</)') as closes,
  list_reduce(list_prepend(0, list_transform(list_filter(string_split(regexp_extract(line, '^([ \t]*)', 1), ''), lambda c: c <> ''), lambda c: case when c = chr(9) then -1 else 1 end)), lambda n, c: case when c = -1 then n + 4 - n % 4 else n + 1 end) as indent from x),
t as (select *, lead(indent) over (partition by file order by line_no) as next_indent from f where not blank),
o as (select * from t where next_indent > indent and not closes), e as (select file, max(line_no) as last_no from f group by file),
s as (select o.file, o.line_no, min(t.line_no) as stop from o join t on t.file = o.file and t.line_no > o.line_no and t.indent <= o.indent group by o.file, o.line_no)
select o.file, o.line_no, case when s.stop is null then e.last_no when t.closes and t.indent = o.indent then s.stop else s.stop - 1 end as end_no
from o join e using (file) left join s on s.file = o.file and s.line_no = o.line_no left join t on t.file = s.file and t.line_no = s.stop""")
def t17_block_ends(spark, sf_dir):
    """The SQL compares every line with all later ones of its file."""
    from treeloom.lineage import written

    files = table(spark, sf_dir, "code").where("source is not null and file is not null").select("file", "line_start", "source").distinct()
    rows = files.select("file", "line_start", F.posexplode(F.split(F.regexp_replace("source", "\r", ""), "\n", -1))).select("file", (F.col("line_start") + F.col("pos")).alias("line_no"), F.col("col").alias("line"))
    return lines.block_ends(written(lines.line_features(rows), "lines"), "file")


@query(LINES + r"""select doc_id, count(*) as n_lines, count_if(blank)::bigint as n_blank, cast(max(length(line)) as int) as longest, cast(max(case when not blank then length(regexp_extract(line, '^( *)', 1)) end) as int) as deepest from f group by doc_id""")
def f1_line_counts(spark, sf_dir):
    rows = document_lines(spark, sf_dir)
    deepest = F.max(F.when(~F.col("blank"), F.length(F.regexp_extract("line", "^( *)", 1))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("blank").alias("n_blank"), F.max(F.length("line")).alias("longest"), deepest.alias("deepest"))


# --- symbols

SPACE = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
S = f"""with s as (select distinct node_id, nfc_normalize(regexp_replace(regexp_replace(symbol, '^{SPACE}+', ''), '{SPACE}+$', '')) as symbol, lower(regexp_replace(regexp_replace(kind, '^{SPACE}+', ''), '{SPACE}+$', '')) as kind from symbols where node_id is not null),
y as (select * from s where symbol <> '' and kind in ('call', 'var_ref')),
c as (select distinct * from code where id is not null)
"""
LANG = r""", k as (select distinct lower(extension) as ext, language as named from languages),
x as (select c.*, coalesce(nullif(lower(trim(c.language, ' ')), ''), k.named) as lang from c left join k on k.ext = lower(regexp_extract(c.file, '(\.[^./]+)$', 1)))
"""
SCOPES = """, fn as (select distinct id, file, line_start, line_end from c where kind in ('function', 'method') and file is not null and line_start <= line_end),
lf as (select distinct id, kind, file, line_start, line_end from c where source is not null and file is not null),
ar as (select lf.id, arg_min(fn.id, struct_pack(a := fn.line_end - fn.line_start, b := -fn.line_start, c := fn.id)) as f from lf join fn on lf.file = fn.file and fn.line_start <= lf.line_start and lf.line_end <= fn.line_end and fn.id <> lf.id where lf.kind not in ('function', 'method') group by lf.id),
sc as (select distinct lf.id, coalesce(ar.f, lf.id) as scope from lf left join ar using (id))
"""


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.clean_symbols(table(spark, sf_dir, "symbols"))


@query(S + "select symbol, count(distinct c.file) as n_files, count(*) as n_uses from y join c on y.node_id = c.id group by symbol")
def j1_symbol_files(spark, sf_dir):
    return uses(spark, sf_dir).join(code_rows(spark, sf_dir, "id", "file").withColumnRenamed("id", "node_id"), "node_id").groupBy("symbol").agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_uses"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of the code table with ``lang``."""
    return trees.language_of(table(spark, sf_dir, "code").where("id is not null").distinct(), table(spark, sf_dir, "languages"))


@query(S + LANG + "select distinct node_id, symbol, kind from y where symbol in (select name from x where kind in ('function', 'class', 'type', 'variable', 'import') and lang <> 'markdown' and name is not null)")
def u3_known_names(spark, sf_dir):
    return symbols.used_and_declared(uses(spark, sf_dir), symbols.known_names(spoken(spark, sf_dir))).select("node_id", "symbol", "kind")


@query(S + SCOPES + """, sp as (select distinct id as scope, file, line_start, line_end from c where file is not null and line_start <= line_end),
df as (select distinct sp.scope, n.name as symbol from sp join c n on n.file = sp.file and n.name is not null and sp.line_start <= n.line_start and n.line_start <= sp.line_end)
select distinct r.node_id, r.symbol from y r where r.kind = 'var_ref' and not exists (select 1 from y k where k.kind = 'call' and k.node_id = r.node_id and k.symbol = r.symbol)
and not exists (select 1 from sc join df on sc.scope = df.scope where sc.id = r.node_id and df.symbol = r.symbol)""")
def y7_free_references(spark, sf_dir):
    return symbols.free_references(uses(spark, sf_dir), symbols.scope_definitions(table(spark, sf_dir, "code").where("id is not null")))


@query(S + """, f as (select distinct id, name, split_part(id, '/', 1) as repository from c where kind in ('function', 'method'))
select f.repository, y.node_id as caller, f.id as callee, count(*) as n from y join f on y.symbol = f.name and split_part(y.node_id, '/', 1) = f.repository where y.kind = 'call' and y.node_id in (select id from f) group by all""")
def a6_call_edges(spark, sf_dir):
    return symbols.call_edges(uses(spark, sf_dir), table(spark, sf_dir, "code"))


@query(S + """, f as (select distinct name, split_part(id, '/', 1) as repository from c where kind in ('function', 'method') and name is not null),
k as (select split_part(node_id, '/', 1) as repository, symbol, count(*) as n, count(distinct node_id) as n_callers from y where kind = 'call' group by all)
select f.repository, f.name, coalesce(k.n, 0) as n_calls, coalesce(k.n_callers, 0) as n_callers from f left join k on f.repository = k.repository and f.name = k.symbol""")
def a5_callers(spark, sf_dir):
    f = code_rows(spark, sf_dir, "id", "kind", "name").where("kind in ('function', 'method') and name is not null").select(first_segment(F.col("id")).alias("repository"), "name").distinct()
    calls = uses(spark, sf_dir).where("kind = 'call'").groupBy(first_segment(F.col("node_id")).alias("repository"), F.col("symbol").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("m"))
    return f.join(calls, ["repository", "name"], "left").select("repository", "name", F.coalesce("n", F.lit(0)).alias("n_calls"), F.coalesce("m", F.lit(0)).alias("n_callers"))


@query(C + """, f as (select id, file, line_start, line_end from c where kind in ('function', 'method') and line_start <= line_end), x as (select * from c where source is not null and kind not in ('function', 'method') and file is not null)
select x.id, arg_min(f.id, struct_pack(a := f.line_end - f.line_start, b := -f.line_start, c := f.id)) as function_id from x join f on x.file = f.file and f.line_start <= x.line_start and x.line_end <= f.line_end and f.id <> x.id group by x.id""")
def j2_enclosing_functions(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "kind", "file", "line_start", "line_end", "source").where("file is not null")
    return trees.enclosing_functions(rows.where("source is not null and kind not in ('function', 'method')"), rows.where("kind in ('function', 'method')"))


@query(C + r""", t as (select id, unnest(regexp_extract_all(source, '([A-Za-z_][A-Za-z0-9_]*)[ ]*(\(?)')) as t from c where source is not null)
select id, regexp_extract(t, '^([A-Za-z0-9_]+)', 1) as token, case when ends_with(t, '(') then 'call' else 'var_ref' end as kind, count(*) as n from t group by all""")
def y10_text_tokens(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "source").where("source is not null")
    return symbols.text_tokens(rows, "id", "source")


@query(S + "select y.kind as use_kind, c.kind as node_kind, count(*) as n, count(distinct symbol) as n_symbols from y left join c on y.node_id = c.id group by all")
def j13_uses_by_node_kind(spark, sf_dir):
    nodes = code_rows(spark, sf_dir, "id", "kind").select(F.col("id").alias("node_id"), F.col("kind").alias("node_kind"))
    return uses(spark, sf_dir).join(nodes, "node_id", "left").groupBy(F.col("kind").alias("use_kind"), "node_kind").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))


# --- summaries and text

MARKS = r"'^([ \t]*(///|//|/\*|\*/|#|\*))*[ \t]*'"


@query(C + rf""", l as (select id, list_filter(list_transform(string_split(source, chr(10)), lambda x: rtrim(regexp_replace(regexp_replace(x, '\r$', ''), {MARKS}, ''), ' ')), lambda x: not contains(x, '\"\"\"') and regexp_matches(x, '[A-Za-z0-9]')) as ls from c where kind = 'comment' and source is not null),
s as (select id, case when len(ls) > 0 and regexp_matches(ls[1], '^[A-Za-z_][A-Za-z0-9_.!]*\(') then ls[2:] else ls end as ls from l)
select id, nullif(array_to_string(ls[1:3], ' '), '') as summary from s""".replace('\\"', '"'))
def d2_comment_summaries(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "kind", "source").where("kind = 'comment' and source is not null")
    return rows.select("id", summaries.comment_summary(F.col("source")).alias("summary"))


@query(C + r""", r as (select file, string_agg(source, chr(10) order by line_start) as t from c where source is not null and lower(file) like '%readme.md' group by file),
p as (select file, list_filter(list_transform(string_split_regex(replace(t, chr(13), ''), '\n[ \t]*\n'), lambda p: array_to_string(list_transform(list_filter(string_split(p, chr(10)), lambda x: not regexp_matches(x, '^\s*#') and trim(x, ' ') <> ''), lambda x: trim(x, ' ')), ' ')), lambda b: b <> '') as b from r)
select file, b[1] as summary from p""")
def d3_readme_summaries(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "file", "line_start", "source").where("source is not null and lower(file) like '%readme.md'")
    whole = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "source"))), lambda x: x["source"]), "\n").alias("t"))
    return whole.select("file", summaries.readme_paragraph(F.col("t")).alias("summary"))


@query(C + ", o as (select id, coalesce(nullif(trim(summary, ' '), ''), signature) as s from c) select c.id, coalesce(case when trim(c.summary, ' ') <> '' then c.summary end, c.signature) as summary from c")
def j9_summary_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "code").where("id is not null").distinct()
    return summaries.with_fallback(rows, rows.select("id", F.col("signature").alias("offer")))


@query(C + ", n as (select id, summary, case when length(summary) > 40 then left(summary, 40) when kind = 'class' then null else summary end as fresh from c) select id, fresh as summary from n where fresh is distinct from summary")
def e7_summary_overrides(spark, sf_dir):
    rows = table(spark, sf_dir, "code").where("id is not null").distinct()
    fresh = F.when(F.length("summary") > 40, F.left("summary", F.lit(40))).when(F.col("kind") == "class", None).otherwise(F.col("summary"))
    changes = summaries.overrides(rows.select("id", fresh.alias("summary")), rows.select("id", "summary"))
    return summaries.overrides(summaries.apply_overrides(rows.select("id", "summary"), changes), rows.select("id", "summary"))


@query("""with d as (select doc_id, max(text) as text from documents where text is not null and doc_id is not null group by doc_id)
select doc_id, greatest(1, length(text) // 4) as tokens, sha256(text) as hash, case when length(text) > 120 then left(text, 117) || '...' else text end as short, cast(len(string_split(text, ' ')) as int) as n_words from d""")
def f20_text_measures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    return d.select("doc_id", sessions.token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("hash"), scalars.shortened(F.col("text"), 120).alias("short"), F.size(F.split("text", " ", -1)).alias("n_words"))


@query(C + r"select id, coalesce(replace(replace(replace(replace(left(source, 200), chr(13), ' '), chr(10), '\n'), '|', '\|'), chr(9), ' '), 'missing') as cell, hex(encode(left(signature, 40))) as packed, nullif(regexp_extract(file, '([^/]+)$', 1), '') as base, case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '' end as folder from c")
def f14_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "code").where("id is not null").distinct()
    return rows.select("id", scalars.table_cell(F.left("source", F.lit(200))).alias("cell"), F.hex(F.encode(F.left("signature", F.lit(40)), "UTF-8")).alias("packed"), scalars.base_name(F.col("file")).alias("base"), scalars.folder(F.col("file")).alias("folder"))


@query(C + r"select id, coalesce(replace(replace(replace(replace(source, chr(13), ' '), chr(10), '\n'), '|', '\|'), chr(9), ' '), 'missing') as cell, hex(encode(signature)) as packed from c")
def f14_whole_cells(spark, sf_dir):
    """Cells and hex of the whole source and signature; :func:`f14_cells` shows their beginnings."""
    rows = code_rows(spark, sf_dir, "*")
    return rows.select("id", scalars.table_cell(F.col("source")).alias("cell"), F.hex(F.encode("signature", "UTF-8")).alias("packed"))


@query(C + r"select id, contains(signature, 'async ') as is_async, nullif(regexp_extract(signature, '\(([^()]*)\)', 1), '') as params, cast(len(regexp_extract_all(coalesce(source, ''), '\b(if|for|while|elif|elseif|case|catch|except)\b')) as int) as branches from c where kind in ('function', 'method')")
def pr8_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "code").where("id is not null and kind in ('function', 'method')").distinct()
    return rows.select("id", F.contains("signature", F.lit("async ")).alias("is_async"), scalars.parameters(F.col("signature")).alias("params"), scalars.branch_words(F.coalesce("source", F.lit(""))).alias("branches"))


# --- listings, status

@query(FILES + """select coalesce(a.path, b.path) as path, coalesce(b.snapshot_no, a.snapshot_no + 1) as snapshot_no, case when a.path is null then 'new' when b.path is null then 'deleted' when a.hash is not distinct from b.hash then 'unchanged' else 'changed' end as state
from (select * from f where snapshot_no < (select max(snapshot_no) from f)) a full join (select * from f where snapshot_no > (select min(snapshot_no) from f)) b on a.path = b.path and a.snapshot_no + 1 = b.snapshot_no""")
def j10_hash_states(spark, sf_dir):
    rows = listed(spark, sf_dir)
    ends = rows.agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi")).first()
    old = rows.where(F.col("snapshot_no") < ends["hi"]).select(F.struct("path", (F.col("snapshot_no") + 1).alias("no")).alias("key"), "hash")
    new = rows.where(F.col("snapshot_no") > ends["lo"]).select(F.struct("path", F.col("snapshot_no").alias("no")).alias("key"), "hash")
    return tables.compared(old, new, "key", "hash").select("key.path", F.col("key.no").alias("snapshot_no"), "state")


@query(FILES + ", p as (select max(snapshot_no) as m from f) select path, hash, snapshot_no from f, p where snapshot_no = m union all select path, hash, snapshot_no from f, p where snapshot_no = m - 1 and path not in (select path from f, p where snapshot_no = m)")
def u5_replaced_rows(spark, sf_dir):
    rows = listed(spark, sf_dir).select("path", "hash", "snapshot_no")
    last = rows.agg(F.max("snapshot_no")).first()[0] or 0
    return tables.replaced(rows.where(F.col("snapshot_no") == last - 1), rows.where(F.col("snapshot_no") == last), "path")


@query(FILES + "select split_part(path, '/', 1) as repository, path, count(*) as n_listings, count(distinct hash) as n_versions, min(snapshot_no) as first_no, max(snapshot_no) as last_no from f group by path")
def s14_file_histories(spark, sf_dir):
    return listed(spark, sf_dir).groupBy(first_segment(F.col("path")).alias("repository"), "path").agg(F.count("*").alias("n_listings"), F.countDistinct("hash").alias("n_versions"), F.min("snapshot_no").alias("first_no"), F.max("snapshot_no").alias("last_no"))


@query(FILES + r", x as (select path, max_by(hash, snapshot_no) as hash from f group by path), c as (select distinct file from code where file is not null) select coalesce(x.path, c.file) as path, x.path is not null as is_listed, c.file is not null as is_indexed from x full join c on x.path = c.file")
def j8_listed_and_indexed(spark, sf_dir):
    x = listed(spark, sf_dir).select("path").distinct().withColumn("a", F.lit(True))
    c = table(spark, sf_dir, "code").where("file is not null").select(F.col("file").alias("path")).distinct().withColumn("b", F.lit(True))
    return x.join(c, "path", "full").select("path", F.col("a").isNotNull().alias("is_listed"), F.col("b").isNotNull().alias("is_indexed"))


MERGED = """with d as (select distinct * from change_status where path is not null), r as (select *, case status when 'unmerged' then 0 when 'untracked' then 1 else 2 end as r from d), b as (select path, min(r) as best from r group by path),
t as (select r.path, case when min(status) = max(status) then min(status) else 'modified' end as status from r join b on r.path = b.path and r.r = b.best group by r.path),
m as (select d.path, t.status, max(old_path) as old_path, bool_or(is_binary) as is_binary, bool_or(is_indexed) as is_indexed, bool_or(git_has_staged) as git_has_staged, bool_or(git_has_unstaged) as git_has_unstaged from d join t using (path) group by d.path, t.status)
"""


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merged_status(table(spark, sf_dir, "change_status").where("path is not null").distinct())


@query(MERGED + "select * from m")
def g2_merged_status(spark, sf_dir):
    return statuses(spark, sf_dir)


@query(MERGED + """, x as (select path, 'all' as phase from m union all select path, 'staged' from m where git_has_staged union all select path, 'unstaged' from m where git_has_unstaged or status in ('untracked', 'unmerged'))
select split_part(path, '/', 1) as repository, phase, m.status, count(*) as n from x join m using (path) group by all""")
def g3_phases(spark, sf_dir):
    m = statuses(spark, sf_dir)
    phases = F.array_compact(F.array(F.lit("all"), F.when(F.col("git_has_staged"), "staged"), F.when(F.col("git_has_unstaged") | F.col("status").isin("untracked", "unmerged"), "unstaged")))
    return m.withColumn("phase", F.explode(phases)).groupBy(first_segment(F.col("path")).alias("repository"), "phase", "status").agg(F.count("*").alias("n"))


@query(MERGED.replace("with d as", "with recursive d as") + """, n as (select distinct id, parent, kind from code where id is not null), a as (select n.id, m.status, git_has_staged as has_staged, git_has_unstaged as has_unstaged from n join m on n.id = m.path where n.kind = 'file'),
up(id, anc) as (select a.id, n.parent from a join n using (id) where n.parent is not null union select up.id, n.parent from up join n on up.anc = n.id where n.parent is not null),
ok as (select * from up where id not in (select u.id from up u join up v on u.id = v.id and u.anc = v.anc join n on n.id = u.anc where n.parent = n.id or u.anc = u.id) and anc in (select id from n))
select * from a union all select ok.anc, 'modified', bool_or(has_staged), bool_or(has_unstaged) from ok join a using (id) group by ok.anc""")
def g5_rolled_up(spark, sf_dir):
    m = statuses(spark, sf_dir).select(F.col("path").alias("file"), "status", F.col("git_has_staged").alias("has_staged"), F.col("git_has_unstaged").alias("has_unstaged"))
    return trees.rolled_up_status(m, trees.nodes_of(table(spark, sf_dir, "code")))


# --- ignore rules, keywords, evidence

@query(FILES + r""", p as (select distinct path, regexp_replace(path, '^[^/]+/', '') as inner_path from f)
select path, regexp_matches(inner_path, '(^|/)build/') or regexp_matches(inner_path, '^dist/') or (regexp_matches(inner_path, '\.min\.js$') and not regexp_matches(inner_path, '(^|/)keep\.min\.js$')) as ignored from p""")
def s6_ignored_paths(spark, sf_dir):
    paths = listed(spark, sf_dir).select("path").distinct()
    return scalars.ignored(paths, "path", ["# outputs", "build/", "/dist/", "*.min.js", "!keep.min.js"])


@query("""with d as (select doc_id, lower(max(text)) as t from documents where text is not null and doc_id is not null group by doc_id),
k as (select doc_id, t, unnest(['cache', 'quota', 'retry', 'session']) as word from d),
n as (select doc_id, word, (length(t) - length(replace(t, word, ''))) // length(word) as n from k)
select doc_id, count_if(n > 0)::bigint as n_distinct, cast(sum(n) as bigint) as n_total from n group by doc_id""")
def a13_keyword_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    return evidence.keyword_scores(d, "doc_id", "text", ["cache", "quota", "retry", "session"])


@query()
def o11_batches(spark, sf_dir):
    """No SQL: batches are filled one after the other; tested against brute force on a fixture."""
    rows = code_rows(spark, sf_dir, "id", "kind", "file", "line_start", "source").where("source is not null and file is not null")
    return evidence.batches(rows.withColumn("size", F.length("source")), "file", ["line_start", "id"], "size", 3_000, 12)


@query(C + """, f as (select file, count(*) as n_nodes, count_if(summary is not null)::bigint as n_summaries, cast(sum(length(source)) as bigint) as n_chars from c where file is not null group by file)
select file, n_nodes || case when n_nodes = 1 then ' node' else ' nodes' end as said, n_summaries, n_chars from f""")
def f24_file_cards(spark, sf_dir):
    rows = table(spark, sf_dir, "code").where("id is not null and file is not null").distinct()
    cards = rows.groupBy("file").agg(F.count("*").alias("n"), F.count("summary").alias("n_summaries"), F.sum(F.length("source")).alias("n_chars"))
    return cards.select("file", scalars.counted(F.col("n"), "node").alias("said"), "n_summaries", "n_chars")


@query()
def v3_evidence(spark, sf_dir):
    """No SQL: nested JSON; tested by its round trip."""
    rows = code_rows(spark, sf_dir, "id", "parent", "kind", "name", "summary", "n_lines", "sibling_order", "file", "signature", "n_children")
    return evidence.cards(rows, 5)


# --- sessions

E = "with e as (select distinct * from events)\n"


@query(E + """, x as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 1800 * 1000000 then 1 else 0 end as new from e window w as (partition by user_id order by ts, event_id)),
y as (select *, sum(new) over (partition by user_id order by ts, event_id)::bigint as session_no from x)
select user_id, session_no, count(*) as n_events, round(sum(value), 4) as total, min(ts) as first_ts, max(ts) as last_ts from y group by all""")
def l6_user_sessions(spark, sf_dir):
    rows = sessions.sessions_by_gap(table(spark, sf_dir, "events").distinct(), "user_id", "ts", 1800)
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(E + "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 4) as total_so_far from e")
def a7_running_totals(spark, sf_dir):
    return sessions.running_totals(table(spark, sf_dir, "events").distinct(), "user_id", ["ts", "event_id"], "value", F.date_trunc("day", "ts")).select("event_id", F.round("total_so_far", 4).alias("total_so_far"))


@query("""with d as (select doc_id, max(text) as text, max(workspace) as workspace, max(written_at) as written_at from documents where doc_id is not null group by doc_id),
t as (select doc_id, workspace, written_at, greatest(1, length(coalesce(text, '')) // 4) as tokens from d where workspace is not null and written_at is not null),
x as (select *, row_number() over w as n, sum(tokens) over (w rows unbounded preceding) as front, sum(tokens) over (partition by workspace order by written_at desc, doc_id desc rows unbounded preceding) as back from t window w as (partition by workspace order by written_at, doc_id))
select workspace, doc_id, case when n <= 2 or front <= 16000 then 'initial' when back <= 8000 then 'final' else 'middle' end as block from x""")
def w5_budget_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("workspace").alias("workspace"), F.max("written_at").alias("written_at"))
    t = d.where("workspace is not null and written_at is not null").select("doc_id", "workspace", F.struct("written_at", "doc_id").alias("seq"), sessions.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return sessions.budget_blocks(t, "workspace", "seq", "tokens", 16_000, 8_000, F.date_trunc("day", "seq.written_at")).select("workspace", "doc_id", "block")


EVENTS = r"""with d as (select doc_id, max(text) as text from documents where text is not null and doc_id is not null group by doc_id),
l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from d),
r as (select doc_id, line_no, regexp_extract(line, '(\{"type": "[a-z_]+".*?"\})', 1) as raw from l where contains(line, '"type": "')),
e as (select doc_id, line_no, raw, json_extract_string(raw, '$.type') as type, json_extract_string(raw, '$.tool_call_id') as tool_call_id from r where raw <> '' and json_valid(raw))
"""


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    return sessions.json_events(d, "doc_id", "text")


@query(EVENTS + "select doc_id, type, count(*) as n, min(line_no) as first_line, max(line_no) as last_line from e where type is not null group by doc_id, type")
def s28_log_events(spark, sf_dir):
    return log_events(spark, sf_dir).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(EVENTS + ", k as (select * from e where type = 'tool_call'), o as (select doc_id, tool_call_id, min(line_no) as result_no from e where type = 'tool_result' group by all) select o.doc_id, o.tool_call_id, o.result_no, k.line_no as call_no from o left join k on o.doc_id = k.doc_id and o.tool_call_id = k.tool_call_id")
def j11_tool_results(spark, sf_dir):
    events = log_events(spark, sf_dir)
    pairs, orphans = sessions.call_pairs(events, "doc_id")
    met = pairs.where("result_no is not null").select("doc_id", "tool_call_id", "result_no", "call_no")
    return met.unionByName(orphans.select("doc_id", "tool_call_id", "result_no", F.lit(None).cast("int").alias("call_no")))


@query(E + "select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total, round(max(value), 4) as most from e group by all")
def a1_hourly(spark, sf_dir):
    return table(spark, sf_dir, "events").distinct().groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("most"))


@query(E + "select user_id, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from e group by all")
def f26_event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").distinct().groupBy("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


# --- tasks: one list per customer, an order is a task, the first order of a list is the parent of the others

T = """with o as (select o_custkey as list_id, o_orderkey as id, case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'in_progress' end as status, o_orderpriority as description,
  case when o_orderkey = min(o_orderkey) over (partition by o_custkey) then null else min(o_orderkey) over (partition by o_custkey) end as parent from orders)
"""


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("description"), F.when(F.col("o_orderkey") != first, first).alias("parent"))


@query(T + "select list_id, count_if(status = 'done')::bigint as done, count_if(status = 'in_progress')::bigint as in_progress, count_if(status = 'pending')::bigint as pending from o group by list_id")
def a4_task_progress(spark, sf_dir):
    return tasks.progress(task_rows(spark, sf_dir))


@query(T + """, a as (select * from o where status = 'in_progress')
select 'several_active' as problem, list_id, id from a where list_id in (select list_id from a group by list_id having count(*) > 1)
union all select 'active_with_children', list_id, id from a where exists (select 1 from o c where c.list_id = a.list_id and c.parent = a.id)
union all select 'missing_parent', list_id, id from o where parent is not null and not exists (select 1 from o p where p.list_id = o.list_id and p.id = o.parent)
union all select 'no_description', list_id, id from o where description is null or trim(description) = ''""")
def k2_task_problems(spark, sf_dir):
    return tasks.problems(task_rows(spark, sf_dir))


@query(T + """, lv as (select * from o where status = 'pending' and not exists (select 1 from o c where c.list_id = o.list_id and c.parent = o.id)), a as (select list_id, max(id) as after from o where status = 'in_progress' group by list_id)
select list_id, id from (select lv.list_id, lv.id, row_number() over (partition by lv.list_id order by case when lv.id > a.after then 0 else 1 end, lv.id) as n from lv left join a using (list_id)) where n = 1""")
def k6_next_tasks(spark, sf_dir):
    return tasks.next_pending(task_rows(spark, sf_dir), "id")


@query(T + ", d as (select list_id, parent as id from o where parent is not null group by all having bool_and(status = 'done')) select o.list_id, o.id from o join d using (list_id, id) where o.status <> 'done'")
def a11_closed_parents(spark, sf_dir):
    return tasks.closed_parents(task_rows(spark, sf_dir))


@query("select n.n_name as nation, r.r_name as region, count(distinct c.c_custkey) as n_customers, count(o.o_orderkey) as n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) as total from nation n join region r on n.n_regionkey = r.r_regionkey left join customer c on c.c_nationkey = n.n_nationkey left join orders o on o.o_custkey = c.c_custkey group by all")
def a1_nation_totals(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(
        F.countDistinct("c_custkey").alias("n_customers"), F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


# --- more of the same families

@query("""with recursive n as (select distinct id, parent from code where id is not null),
down(id, steps, path) as (select id, 0, id from n where parent is null or parent not in (select id from n) union all select n.id, steps + 1, path || ' > ' || n.id from n join down on n.parent = down.id)
select id, steps, path from down""")
def o2_paths(spark, sf_dir):
    from treeloom.operators.hierarchy import hierarchy

    placed = hierarchy(trees.nodes_of(table(spark, sf_dir, "code"))).where("line is not null")
    return placed.select("id", "steps", F.array_join(F.transform("line", lambda x: x["id"]), " > ").alias("path"))


@query(C + """, n as (select id, file, line_start, line_end from c where source is null and file is not null and line_start is not null), l as (select distinct file, line_start, line_end, source from c where source is not null)
select n.id, count(*) as n_leaves, md5(string_agg(l.source, chr(10) order by l.line_start)) as text_md5 from n join l on n.file = l.file and n.line_start <= l.line_start and l.line_end <= n.line_end group by n.id""")
def e1_node_sources(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "file", "line_start", "line_end", "source").where("file is not null and line_start is not null")
    nodes = rows.where("source is null").select("id", "file", F.col("line_start").alias("ns"), F.col("line_end").alias("ne"))
    leaves = rows.where("source is not null").select("file", "line_start", "line_end", "source").distinct()
    inside = leaves.join(nodes, "file").where("ns <= line_start and line_end <= ne")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "source"))), lambda x: x["source"]), "\n")
    return inside.groupBy("id").agg(F.count("*").alias("n_leaves"), F.md5(text).alias("text_md5"))


@query(FILES + """, p as (select distinct path from f), x as (select path, unnest(range(1, len(string_split(path, '/')))) as k from p)
select array_to_string(string_split(path, '/')[1:k], '/') as folder, count(*) as n_files from x group by 1""")
def j5_folder_totals(spark, sf_dir):
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return listed(spark, sf_dir).select("path").distinct().where(F.col("path").contains("/")).select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_files"))


@query(FILES + """, p as (select distinct path from f), d as (select path, regexp_extract(path, '([^/]+)$', 1) as name, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as folder from p)
select path, folder, row_number() over (partition by folder order by name, path) - 1 as sibling_order from d""")
def t28_file_positions(spark, sf_dir):
    d = listed(spark, sf_dir).select("path").distinct().select("path", scalars.base_name(F.col("path")).alias("name"), scalars.folder(F.col("path")).alias("folder"))
    return d.select("path", "folder", (F.row_number().over(Window.partitionBy("folder").orderBy("name", "path")) - 1).alias("sibling_order"))


@query("""select distinct path, case status when 'added' then 'A' when 'deleted' then 'D' when 'modified' then 'M' when 'renamed' then 'R' when 'copied' then 'C' when 'type_changed' then 'T' when 'unmerged' then 'U' end as letter,
path || case when old_path is not null then ' <- ' || old_path else '' end as said from change_status""")
def f16_status_letters(spark, sf_dir):
    letters = F.coalesce(*[F.when(F.col("status") == word, letter) for letter, word in tables.STATUS_LETTERS.items()])
    return table(spark, sf_dir, "change_status").select("path", letters.alias("letter"), F.concat("path", F.when(F.col("old_path").isNotNull(), F.concat(F.lit(" <- "), F.col("old_path"))).otherwise("")).alias("said")).distinct()


@query("""with d as (select doc_id, max(text) as text from documents where text is not null and doc_id is not null group by doc_id)
select doc_id, array_to_string(string_split(text, chr(10))[1:5], chr(10)) as head, greatest(0, len(string_split(text, chr(10))) - 5)::int as n_more from d""")
def o7_first_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    parts = F.split("text", "\n", -1)
    return d.select("doc_id", F.array_join(F.slice(parts, 1, 5), "\n").alias("head"), F.greatest(F.lit(0), F.size(parts) - 5).alias("n_more"))


@query(E + """select user_id, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type, min(ts) as first_ts, max(ts) as last_ts,
count(distinct event_type) as n_types, cast(date_diff('second', min(ts), max(ts)) as bigint) as seconds from e group by user_id""")
def j12_first_and_last(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").distinct().groupBy("user_id").agg(
        F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("event_type").alias("n_types"),
        F.expr("timestampdiff(SECOND, date_trunc('SECOND', min(ts)), date_trunc('SECOND', max(ts)))").alias("seconds"))


@query(LINES + r""", m as (select *, regexp_matches(line, '^\s*(```|~~~)') as mark from f),
x as (select *, coalesce(sum(case when mark then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before from m),
t as (select doc_id, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)[ ]*(\(?)')) as t from x where not mark and before % 2 = 1)
select doc_id, regexp_extract(t, '^([A-Za-z0-9_]+)', 1) as token, case when ends_with(t, '(') then 'call' else 'var_ref' end as kind, count(*) as n from t group by all""")
def y9_fenced_tokens(spark, sf_dir):
    rows = document_lines(spark, sf_dir)
    fenced = rows.join(lines.markdown_blocks(rows, "doc_id").where("block = 'fence'"), ["doc_id", "line_no"]).where(~F.col("line").rlike(r"^\s*(```|~~~)"))
    return symbols.text_tokens(fenced, "doc_id", "line")


@query(C + r""", r as (select file, string_agg(source, chr(10) order by line_start) as t from c where source is not null and lower(file) like '%/readme.md' group by file),
p as (select regexp_replace(file, '/[^/]*$', '') as id, list_filter(list_transform(string_split_regex(replace(t, chr(13), ''), '\n[ \t]*\n'), lambda p: array_to_string(list_transform(list_filter(string_split(p, chr(10)), lambda x: not regexp_matches(x, '^\s*#') and trim(x, ' ') <> ''), lambda x: trim(x, ' ')), ' ')), lambda b: b <> '')[1] as offer from r)
select c.id, coalesce(case when trim(c.summary, ' ') <> '' then c.summary end, p.offer) as summary from c left join p on c.id = p.id where c.kind in ('module', 'codebase')""")
def d4_module_summaries(spark, sf_dir):
    rows = code_rows(spark, sf_dir, "id", "kind", "summary", "file", "line_start", "source")
    leaves = rows.where("source is not null and lower(file) like '%/readme.md'")
    whole = leaves.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "source"))), lambda x: x["source"]), "\n").alias("t"))
    offers = whole.select(scalars.folder(F.col("file")).alias("id"), summaries.readme_paragraph(F.col("t")).alias("offer"))
    return summaries.with_fallback(rows.where("kind in ('module', 'codebase')").select("id", "summary"), offers)


@query()
def l1_histories(spark, sf_dir):
    """No SQL: a fold over ordered events; tested on fixtures."""
    from treeloom.streaming.logs import histories

    return histories(log_events(spark, sf_dir), "doc_id", "line_no")


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate from lineitem)
select l_partkey, l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from l) where rank <= 3""")
def o5_top_lines(spark, sf_dir):
    w = Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("""select o.o_orderkey, count(l.l_linenumber) as n_lines, round(coalesce(sum(l.l_extendedprice), 0), 2) as total from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by o.o_orderkey""")
def j13_order_totals(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n"), F.sum("l_extendedprice").alias("t"))
    return o.join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))
