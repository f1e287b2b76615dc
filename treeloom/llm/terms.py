"""Frequency of every distinct term, by radix partitions that are split until each is small.

Terms go to partitions by bits of their hash; a partition above its bound is split by further
bits, one that holds a single term by bits of the node's hash, and one of a single node by bits of the row's. Each
partition is then aggregated by a DuckDB of its own, which spills to the shared folder; its rows never exceed the bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import composed
from treeloom.lineage import scratch, written

RARE_BELOW, COMMON_SHARE = 3, 0.2
PARTITION_ROWS, SPLIT_BITS, PARTS_PER_TASK, DUCKDB_MEMORY = 250_000, 4, 4, "300MB"
COUNTED = "base string, symbol string, kind string, occurrences bigint, nodes bigint"


def counting_rows(symbols: DataFrame) -> DataFrame:
    """``symbol, kind, n1, n2, r`` of the rows that count: cleaned, two hashes of the node (null for none), and one of the row as it stands, by which exact duplicates are told."""
    raw = [F.coalesce(c, F.lit("\u0000")) for c in ("file", "node_id", "symbol", "kind")]
    node = lambda seed: F.when(F.col("node_id").isNotNull(), F.xxhash64(F.lit(seed), "node_id"))
    rows = symbols.select(composed("symbol").alias("symbol"), F.lower(composed("kind")).alias("kind"), node(1).alias("n1"), node(2).alias("n2"), F.xxhash64(*raw).alias("r"))
    return rows.where("symbol <> '' and kind in ('call', 'var_ref')")


def _count_part(spill: str | None) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        import duckdb

        con = duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": spill or ""})  # without a folder that all machines share it must do in memory
        con.register("part", part)
        found = con.sql("""
            select any_value(base) as base, symbol, kind, sum(n)::bigint as occurrences, count(n1) as nodes
            from (select split_part(any_value(part), '~', 1) as base, symbol, kind, n1, n2, count(distinct r) as n from part group by symbol, kind, n1, n2) group by symbol, kind""")
        out = found.to_arrow_table() if hasattr(found, "to_arrow_table") else found.arrow()
        con.close()
        return out

    return run


def radix_partitions(rows: DataFrame, n_rows: int, partition_rows: int) -> tuple[DataFrame, int]:
    """``rows`` with a column ``part``, and how many parts there are: of at most ``partition_rows`` rows each.

    n_rows: how many rows there are at most. A part's name has the digits of its term, after a dot those of its node, after a tilde those of its rows; what is then still too large are
    copies of one row, which are counted once here. Only parts above the bound are written again; rows for one part come from many tasks, so that none has to hold a frequent term.
    """
    digits = max(0, math.ceil(math.log2(max(1, n_rows / partition_rows)) / SPLIT_BITS))
    hashes = {"k": F.xxhash64("symbol", "kind"), "i": F.xxhash64(F.lit(3), "n1", "n2", F.when(F.col("n1").isNull(), F.col("r"))), "j": F.xxhash64(F.lit(4), "r")}
    digit = lambda c, level: F.hex(F.expr(f"shiftrightunsigned(_{c}, greatest({64 - SPLIT_BITS} - {SPLIT_BITS} * {level}, 0)) & {2 ** SPLIT_BITS - 1}"))
    hashed = rows.select("*", *[h.alias(f"_{c}") for c, h in hashes.items()])
    now = written(hashed.select("*", F.concat(F.lit(""), *[digit("k", d) for d in range(digits)]).alias("part"), F.lit(digits).alias("_level")), "radix")
    done, n_parts = [], 0
    while True:
        one = [(F.min(f"_{c}") == F.max(f"_{c}")).alias(f"one_{c}") for c in hashes]
        sizes = written(now.groupBy("part").agg(F.count("*").alias("n"), *one), "sizes")
        large = sizes.where(F.col("n") > partition_rows)
        n_parts += sizes.count()
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, now.select(*rows.columns, "part")]), n_parts
        done.append(now.join(large, "part", "left_anti").select(*rows.columns, "part"))
        split = now.join(large.drop("n"), "part")
        done.append(split.where("one_k and one_i and one_j").select(*rows.columns, "part").distinct())  # the copies fall together before they are shuffled
        named = lambda c, mark: F.struct(F.concat("part", F.when(F.contains("part", F.lit(mark)), "").otherwise(mark), digit(c, "_level")).alias("part"), (F.col("_level") + 1).alias("level"))
        first = lambda mark: F.when(F.contains("part", F.lit(mark)), F.col("_level")).otherwise(0)
        split = split.where("not (one_k and one_i and one_j)").withColumn("_level", F.when(~F.col("one_k"), F.col("_level")).when(~F.col("one_i"), first(".")).otherwise(first("~")))
        by = F.when(~F.col("one_k"), named("k", "")).when(~F.col("one_i"), named("i", ".")).otherwise(named("j", "~"))
        now = written(split.withColumn("by", by).select(*rows.columns, *[f"_{c}" for c in hashes], F.col("by.part").alias("part"), F.col("by.level").alias("_level")), "radix")


def term_frequencies(symbols: DataFrame, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``symbol, kind, occurrences, nodes, mark`` for every counting (symbol, kind).

    occurrences: rows without exact duplicates; nodes: distinct node ids (null is none); mark: ``rare`` below ``rare_below`` nodes, ``common`` above
    ``common_share`` of all distinct nodes that have a counting row, else null. Rows whose cleaned symbol is empty or whose kind is neither call nor var_ref don't count,
    nor do nulls in these; node ids needn't be known. An empty table gives no rows; other columns are ignored.
    """
    spark = symbols.sparkSession
    parts, n_parts = radix_partitions(counting_rows(symbols), symbols.count(), partition_rows)
    n_nodes = parts.select("n1", "n2").where("n1 is not null").distinct().count()
    spill = scratch(spark, "duckdb")
    local = spill.removeprefix("file://") if spill.startswith(("file://", "/")) else None
    tasks = max(min(n_parts, spark.sparkContext.defaultParallelism), -(-n_parts // PARTS_PER_TASK), 1)
    counted = parts.repartition(tasks, "part").groupBy("part").applyInArrow(_count_part(local), COUNTED)
    # parts of one node differ in their rows only, so the node counts once; other parts of a term have no node in common
    by_node = counted.groupBy("symbol", "kind", "base").agg(F.sum("occurrences").alias("occurrences"), F.max("nodes").alias("nodes"))
    total = by_node.groupBy("symbol", "kind").agg(F.sum("occurrences").alias("occurrences"), F.sum("nodes").alias("nodes"))
    mark = F.when(F.col("nodes") < rare_below, "rare").when(F.col("nodes") > common_share * n_nodes, "common")
    return total.withColumn("mark", mark)
