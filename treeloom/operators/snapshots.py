"""What changed between consecutive full snapshots of a keyed table.

Keys fall into hash ranges. A Merkle tree of digests over the ranges is compared from the root
down, and rows are looked at only in ranges whose digests differ. Every step groups by (snapshot,
hash range), so a group with any share of the rows spreads over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.text import clean_path, first_segment
from treeloom.lineage import written

STEP_BITS = 4


def latest_versions(rows: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` (null lowest); ties are broken by the payload, so the result doesn't depend on row order."""
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in payload])).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in payload])


def _facing(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each row twice: as part of the snapshot it belongs to, and as part of the one before the next."""
    return df.join(pairs, ["grp", "seq"]).select("*", F.explode(F.array(
        F.struct(F.col("seq").alias("at"), F.lit(True).alias("now")),
        F.struct(F.col("next_seq").alias("at"), F.lit(False).alias("now")),
    )).alias("_f")).select(*df.columns, "_f.at", "_f.now", "first_seq").where("at is not null and not (now and seq = first_seq)").drop("first_seq")


def snapshot_diff(rows: DataFrame, payload: Sequence[str], rows_per_leaf: int = 64, max_bits: int = 24) -> DataFrame:
    """Rows that differ between each snapshot and the last one before it of the same group.

    rows: ``grp, seq, key`` (unique together, none null) and the ``payload`` columns.
    Returns ``grp, seq, key, now, before``: the structs of the payload, null on the side that lacks the key.
    Only keys of hash ranges whose digests differ are returned, so equal rows may be among them: the caller decides what counts as a change.
    The first snapshot of a group has no row; an empty table gives an empty result.
    """
    hashed = rows.select("grp", "seq", "key", *payload, F.xxhash64("key").alias("h"))
    listings = hashed.groupBy("grp", "seq").agg(F.count("*").alias("n"))
    listings = written(listings, "listings")
    most = listings.agg(F.max("n")).first()[0] or 1
    bits = min(max_bits, STEP_BITS * max(1, math.ceil(math.log2(max(2, most / rows_per_leaf)) / STEP_BITS)))
    w = Window.partitionBy("grp").orderBy("seq")  # one row per snapshot of a group
    pairs = listings.select("grp", "seq", F.lead("seq").over(w).alias("next_seq"), F.min("seq").over(Window.partitionBy("grp")).alias("first_seq"))

    bits_of = [x for c in payload for x in (F.col(c), F.isnull(c))]  # a hash skips nulls, so their place is hashed too
    leaf = F.shiftrightunsigned("h", 64 - bits)
    level = hashed.groupBy("grp", "seq", leaf.alias("node")).agg(
        F.bit_xor(F.xxhash64("key", *bits_of)).alias("d1"), F.bit_xor(F.xxhash64(F.lit(7), "key", *bits_of)).alias("d2"), F.count("*").alias("n"))
    levels = [written(level, "leaves")]
    for _ in range(bits // STEP_BITS):  # from the leaves to the root
        levels.append(levels[-1].groupBy("grp", "seq", F.shiftright("node", STEP_BITS).alias("node")).agg(
            F.bit_xor(F.xxhash64("node", "d1", "n")).alias("d1"), F.bit_xor(F.xxhash64("node", "d2", "n")).alias("d2"), F.sum("n").alias("n")))

    differing = None
    for level in reversed(levels):  # from the root to the leaves
        sides = _facing(level, pairs)
        if differing is not None:
            parents = differing.select("grp", "at", F.col("node").alias("up"))
            sides = sides.withColumn("up", F.shiftright("node", STEP_BITS)).join(parents, ["grp", "at", "up"], "left_semi")
        digest = F.struct("d1", "d2", "n")
        differing = sides.groupBy("grp", "at", "node").agg(
            F.max(F.when(F.col("now"), digest)).alias("a"), F.max(F.when(~F.col("now"), digest)).alias("b")
        ).where(~F.col("a").eqNullSafe(F.col("b"))).select("grp", "at", "node")
    differing = written(differing, "differing")

    body = F.struct(*payload)
    sides = _facing(hashed.withColumn("node", leaf).drop("h"), pairs).join(differing, ["grp", "at", "node"], "left_semi")
    return sides.groupBy("grp", F.col("at").alias("seq"), "key").agg(
        F.max(F.when(F.col("now"), body)).alias("now"), F.max(F.when(~F.col("now"), body)).alias("before"))


def listing_changes(files: DataFrame) -> DataFrame:
    """Changes between consecutive listings of each repository: ``repository, path, snapshot_no, change``.

    change: ``added``, ``removed``, ``changed`` (hashes differ apart from case) or ``recommitted`` (both commit hashes are set and neither begins the other).
    Rows without ``path`` or ``snapshot_no`` belong to no listing and are left out; of several rows for a path and listing the one delivered last holds,
    at the same time the greater hash. A null hash equals only a null hash. Other columns of the table are ignored.
    """
    rows = files.select(clean_path(F.col("path")).alias("key"), F.col("snapshot_no").alias("seq"), "delivered_at", F.lower("hash").alias("hash"), F.lower("commit_hash").alias("commit_hash"))
    rows = rows.where("key is not null and key <> '' and seq is not null")
    held = latest_versions(rows, ["key", "seq"], "delivered_at", ["hash", "commit_hash"]).withColumn("grp", first_segment(F.col("key")))
    diff = snapshot_diff(written(held, "held"), ["hash", "commit_hash"])
    now, was = F.col("now"), F.col("before")
    other_commit = ~F.startswith(now["commit_hash"], was["commit_hash"]) & ~F.startswith(was["commit_hash"], now["commit_hash"])
    change = (
        F.when(was.isNull(), "added").when(now.isNull(), "removed")
        .when(~now["hash"].eqNullSafe(was["hash"]), "changed").when(other_commit, "recommitted"))
    return diff.select(F.col("grp").alias("repository"), F.col("key").alias("path"), F.col("seq").alias("snapshot_no"), change.alias("change")).where("change is not null")
