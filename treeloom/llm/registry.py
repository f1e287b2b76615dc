"""Queries of this package and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import credentials, docs, mixing, origins, packing, parsing, spans, terms


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(_table(spark, sf_dir, "symbols")).where("mark is not null").select("symbol", "kind", "mark")


def p1_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(_table(spark, sf_dir, "symbols"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.invalid_files(_table(spark, sf_dir, "code"), _table(spark, sf_dir, "languages"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.invalid_rates(_table(spark, sf_dir, "code"), _table(spark, sf_dir, "languages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(_table(spark, sf_dir, "code"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_leaves(_table(spark, sf_dir, "code"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins.foreign_files(_table(spark, sf_dir, "code"), _table(spark, sf_dir, "languages"))


def p5_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins.file_origins(_table(spark, sf_dir, "code"), _table(spark, sf_dir, "languages"))


def p5_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins.hand_written_listing(_table(spark, sf_dir, "files"), _table(spark, sf_dir, "code"), _table(spark, sf_dir, "languages"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pairs(spark, sf_dir).select("id")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.documented_functions(_table(spark, sf_dir, "code"), _table(spark, sf_dir, "languages"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "containers"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "containers"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf_dir, "documents"))[0]


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amounts(_table(spark, sf_dir, "documents"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1:2].isdigit()}

_SPACE = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TERMS = f"""
with r as (
  select distinct node_id, file, symbol as s, kind as k,
    nfc_normalize(regexp_replace(regexp_replace(symbol, '^{_SPACE}+', ''), '{_SPACE}+$', '')) as symbol,
    lower(regexp_replace(regexp_replace(kind, '^{_SPACE}+', ''), '{_SPACE}+$', '')) as kind
  from symbols),
c as (select * from r where symbol <> '' and kind in ('call', 'var_ref')),
t as (select symbol, kind, count(*) as occurrences, count(distinct node_id) as nodes from c group by all),
m as (select *, case when nodes < 3 then 'rare' when nodes > 0.2 * (select count(distinct node_id) from c) then 'common' end as mark from t)
"""
_WINDOWS = """
with d as (select doc_id, max(text) as text from documents where text is not null and doc_id is not null group by doc_id),
w as (select doc_id, unnest(range(1, length(text) - 298)) as i, text from d where length(text) >= 300),
h as (select doc_id, i, md5(substr(text, i, 300)) as h from w),
s as (select h from h group by h having min(doc_id) < max(doc_id)),
k as (select h.* from h semi join s on h.h = s.h)
"""
SQL = {"p1_found": _TERMS + "select symbol, kind, mark from m where mark is not null", "p1_frequencies": _TERMS + "select * from m",
    "p10_found": _WINDOWS + ", u as (select distinct doc_id, h from k) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from u a join u b on a.h = b.h and a.doc_id < b.doc_id",
    "p10_shared": _WINDOWS + """, c as (select doc_id, least(300, coalesce(lead(i) over (partition by doc_id order by i) - i, 300)) as n from k), t as (select doc_id, sum(n)::int as n from c group by doc_id)
select d.doc_id, length(d.text)::int as n_chars, coalesce(t.n, 0) as shared_chars, case when length(d.text) > 0 then round(coalesce(t.n, 0) / length(d.text), 6) else 0 end as share from d left join t using (doc_id)"""}
