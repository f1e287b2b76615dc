"""Evidence about nodes: keyword scores, batches of bounded size, nested cards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.trees import ranked_children


def keyword_scores(texts: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``key, n_distinct, n_total``: how many of the words a text holds, and how often in all, without regard to case."""
    low = F.lower(text)
    counts = [F.floor((F.length(low) - F.length(F.replace(low, F.lit(w)))) / len(w)) for w in words]
    distinct = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    return texts.select(key, distinct.cast("bigint").alias("n_distinct"), sum(counts, F.lit(0)).cast("bigint").alias("n_total"))


def _fill(limit: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, no, used, n = object(), 0, 0, 0
        for batch in batches:
            out = []
            for k, size in zip(batch["key"], batch["size"].tolist()):
                if k != key:
                    key, no, used, n = k, 0, 0, 0
                elif used + size > limit or n >= most:
                    no, used, n = no + 1, 0, 0
                used, n = used + size, n + 1
                out.append(no)
            yield batch[["key", "id", "size"]].assign(batch_no=pd.Series(out, batch.index, "int32"))

    return run


def batches(rows: DataFrame, key: str, order: list[str], size: str, limit: int, most: int) -> DataFrame:
    """``key, id, size, batch_no``: the rows of each key in order, a new batch where the next row would go over the limit or there are ``most`` rows; a row over the limit is alone.

    Rows stream through a task in order and nothing is held, so a key of any size fits.
    """
    sorted_rows = rows.select(F.col(key).alias("key"), "id", F.col(size).cast("bigint").alias("size"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]).repartition("key")
    sorted_rows = sorted_rows.sortWithinPartitions("key", *[f"_o{k}" for k in range(len(order))])
    done = sorted_rows.mapInPandas(_fill(limit, most), "key string, id string, size bigint, batch_no int")
    return done.withColumnRenamed("key", key)


def cards(nodes: DataFrame, k: int) -> DataFrame:
    """``id, card``: JSON of a node with its first ``k`` children by rank and counts of those left out."""
    first, omitted = ranked_children(nodes, k)
    children = first.groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("child_ids"))
    left = omitted.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", "n_omitted"))).alias("overflow"))
    card = F.to_json(F.struct("id", "kind", "name", "file", "signature", "n_children", "n_lines", "summary", "child_ids", "overflow"))
    return nodes.join(children, "id", "left").join(left, "id", "left").select("id", card.alias("card"))
