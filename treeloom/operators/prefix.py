"""Running sums that don't bring all rows of a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(rows: DataFrame, key: Sequence[str], slot: Column, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each item of ``values`` (new column -> summed column), the sum up to and with each row in ``order`` within ``key``, and ``<new column>_all`` for the key's whole sum.

    slot: a value that never falls along ``order`` (a day of a timestamp, leading bits of a hash). Rows are ordered within (key, slot) only, and sums of
    slots are added up in a second, small window, so a key with any share of the rows spreads over its slots. Nulls add nothing.
    """
    slotted = rows.withColumn("_slot", slot)
    by_slot = Window.partitionBy(*key).orderBy("_slot")
    sums = slotted.groupBy(*key, "_slot").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in values.items()])
    ahead = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in key], F.col("_slot").alias("_k_slot"),
        *[(F.coalesce(F.sum(f"_s_{n}").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(f"_a_{n}") for n in values],
        *[F.sum(f"_s_{n}").over(Window.partitionBy(*key)).alias(f"{n}_all") for n in values])
    inside = Window.partitionBy(*key, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = slotted
    for n, c in values.items():
        placed = placed.withColumn(f"_i_{n}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    met = F.lit(True)
    for k in key:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = placed.join(ahead, met & F.col("_slot").eqNullSafe(F.col("_k_slot")))
    return joined.select(*rows.columns, *[(F.col(f"_a_{n}") + F.col(f"_i_{n}")).alias(n) for n in values], *[f"{n}_all" for n in values])
