"""Long spans that stand letter for letter in more than one record, by a log-structured fingerprint index.

A record is fingerprinted by the smallest hash in every window of hashes, so that two records that
share a span of the least length share a fingerprint at the same place of it. Fingerprints live in
immutable runs sorted by hash; a new batch is merge-joined with the runs before it, what meets is
verified on the text, and runs of a level are compacted into one of the next when there are enough.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.lineage import removed, scratch, written

MIN_LENGTH = 300
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
LARGE_GROUP, PART_DOCS, BATCH_ROWS = 64, 1_000, 5_000
FINGERPRINTS, TEXTS = "h bigint, doc_id bigint, pos int", "doc_id bigint, text string"
MANIFEST = "version int, least int, fanout int, buckets int, n int, kind string, level int, path string"


class Powers:
    """Powers of the hash base and of its inverse, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            n = max(n, 2 * len(cls.up)) + 1
            with np.errstate(over="ignore"):
                cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (BASE, BACK))
        return cls.up, cls.down


def window_hashes(text: str, width: int) -> np.ndarray:
    """A hash of each run of ``width`` code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = Powers.of(n)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(points * up[:n])]
        h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)


def _extreme(x: np.ndarray, width: int, f: np.ufunc, fill: int) -> np.ndarray:
    n = len(x)
    blocks = np.r_[x, np.full(-n % width, fill, x.dtype)].reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1:n])


def fingerprints(text: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the fingerprints: each is the least in some window of places, and a shared span of ``least`` code points holds a whole window."""
    width = least // 2
    windows = least - width + 1
    h = window_hashes(text, width)
    if len(h) < windows:
        return h[:0], np.zeros(0, np.int64)
    low = _extreme(h, windows, np.minimum, (1 << 64) - 1)
    edge = np.zeros(windows - 1, np.uint64)
    at = np.flatnonzero(_extreme(np.r_[edge, low, edge], windows, np.maximum, 0) == h)
    return h[at], at


def _fingerprint(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for id_, text in zip(batch["doc_id"].tolist(), batch["text"]):
                h, at = fingerprints(text, least)
                held.append((h.view(np.int64), np.full(len(at), id_, np.int64), at.astype(np.int32)))
                n += len(at)
                if n >= 20 * BATCH_ROWS:
                    yield pd.DataFrame(dict(zip(("h", "doc_id", "pos"), map(np.concatenate, zip(*held)))))
                    held, n = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("h", "doc_id", "pos"), map(np.concatenate, zip(*held)))))

    return run


def _contexts(least: int):
    width = least // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, text, at in zip(batch["doc_id"].tolist(), batch["text"], batch["at"]):
                for a in at:
                    start = max(0, a["pos"] - (least - width))
                    rows.append((a["h"], id_, a["pos"], a["pos"] - start, text[start:a["pos"] + least], a["fresh"]))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=CONTEXT_COLUMNS)
                        rows = []
            yield pd.DataFrame(rows, columns=CONTEXT_COLUMNS)

    return run


def _common(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _match_groups(least: int):
    """Pairs within each small group of equal fingerprints, on the text around them. Rows come sorted by fingerprint."""

    def pairs(group: list[tuple]) -> Iterator[tuple]:
        sides = [(d, p, c[:n][::-1], c[n:], new) for d, p, n, c, new in group]
        for i, (a, pa, la, ra, new_a) in enumerate(sides):
            for b, pb, lb, rb, new_b in sides[i + 1:]:
                if a == b or not (new_a or new_b):
                    continue
                back, on = _common(la, lb), _common(ra, rb)
                if back + on >= least:
                    yield (a, b, pa - back, pb - back, back + on) if a < b else (b, a, pb - back, pa - back, back + on)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group = None, []
        for batch in batches:
            out = []
            for h, *row in zip(batch["h"].tolist(), batch["doc_id"].tolist(), batch["pos"].tolist(), batch["left"].tolist(), batch["context"], batch["fresh"].tolist()):
                if h != held:
                    out.extend(pairs(group))
                    held, group = h, []
                group.append(row)
            yield pd.DataFrame(out, columns=PAIR_COLUMNS)
        yield pd.DataFrame(list(pairs(group)), columns=PAIR_COLUMNS)

    return run


CONTEXT_COLUMNS = ["h", "doc_id", "pos", "left", "context", "fresh"]
PAIR_COLUMNS = ["doc_id_a", "doc_id_b", "start_a", "start_b", "length"]
PAIRS = "doc_id_a bigint, doc_id_b bigint, start_a int, start_b int, length int"


def _window_keys(least: int):
    """Every window of the least length around a fingerprint, as the two halves of a cryptographic digest of its text: for fingerprints that very many records have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, pos, left, context, fresh in zip(batch["doc_id"].tolist(), batch["pos"].tolist(), batch["left"].tolist(), batch["context"], batch["fresh"].tolist()):
                points = context.encode("utf-32-le", "surrogatepass")
                for k in range(len(context) - least + 1):
                    digest = blake2b(points[4 * k:4 * (k + least)], digest_size=16).digest()
                    rows.append((int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True), id_, pos - left + k, fresh))
                if len(rows) >= 10 * BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=["w1", "w2", "doc_id", "start", "fresh"])
                    rows = []
            yield pd.DataFrame(rows, columns=["w1", "w2", "doc_id", "start", "fresh"])

    return run


class SpanIndex:
    """Immutable runs of fingerprints, and the texts they are of, below one folder; :meth:`add` takes a batch of records and returns what it shares with itself and with all records before.

    fanout: runs of a level that are compacted into one of the next, so a fingerprint is rewritten once a level. buckets: files of a run, by hash; runs of equal buckets are joined without a shuffle.
    A manifest of the runs is written after each batch; :meth:`open` goes on from the last one. Each record enters once.
    """

    def __init__(self, spark, least: int = MIN_LENGTH, fanout: int = 2, buckets: int | None = None, folder: str | None = None):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or scratch(spark, "spans")
        self.version, self.runs, self.tables = 0, [], {}  # runs: (kind, level, path); tables: path -> name in the catalogue

    @classmethod
    def open(cls, spark, folder: str) -> SpanIndex:
        """The index a folder holds, as of its last complete batch."""
        every = spark.read.schema(MANIFEST).json(f"{folder}/manifest-*")
        rows = [r for r in every.orderBy("n").collect()]  # a row a run, whose number grows with the logarithm of the records
        last = [r for r in rows if r.version == max(x.version for x in rows)]
        index = cls(spark, last[0].least, last[0].fanout, last[0].buckets, folder)
        index.version = last[0].version
        for r in last:
            index.runs.append((r.kind, r.level, r.path))
        return index

    def _table(self, kind: str, path: str) -> DataFrame:
        if path not in self.tables:
            name, key = f"treeloom_{uuid.uuid4().hex[:12]}", "h" if kind == "run" else "doc_id"
            self.spark.sql(f"create table {name} ({FINGERPRINTS if kind == 'run' else TEXTS}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{path}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path])

    def _stored(self, kind: str, rows: DataFrame) -> str:
        key, name, path = "h" if kind == "run" else "doc_id", f"treeloom_{uuid.uuid4().hex[:12]}", f"{self.folder}/{kind}-{uuid.uuid4().hex[:12]}"
        rows.repartition(self.buckets, key).write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        self.tables[path] = name
        return path

    def stored_batches(self, texts: DataFrame, batches: int) -> list[str]:
        """Stores ``doc_id, text, batch`` at once; the places of batches 0 to ``batches`` - 1."""
        name, path = f"treeloom_{uuid.uuid4().hex[:12]}", f"{self.folder}/texts-{uuid.uuid4().hex[:12]}"
        empty = self.spark.range(batches).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("id").alias("batch"))  # so that no batch's folder is missing
        texts.select("doc_id", "text", F.col("batch").cast("bigint").alias("batch")).unionByName(empty).write.option("path", path).option("compression", "zstd").partitionBy("batch").bucketBy(self.buckets, "doc_id").sortBy("doc_id").saveAsTable(name)
        self.spark.sql(f"drop table {name}")
        return [f"{path}/batch={k}" for k in range(batches)]

    def _drop(self, path: str) -> None:
        self.spark.sql(f"drop table if exists {self.tables.pop(path)}")
        removed(self.spark, path)

    def close(self) -> None:
        """Takes the index's tables out of the session's catalogue; its folder stays."""
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables.clear()

    def discard(self) -> None:
        self.close()
        removed(self.spark, self.folder)

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``batch`` has ``doc_id, text``, one row per record. Returns the pairs (with one common span per fingerprint) and the spans of each record found elsewhere; both stay good when the index is closed or discarded."""
        return self.add_stored(self._stored("text", batch.where(F.length("text") >= self.least).select("doc_id", "text")))

    def add_stored(self, own: str) -> tuple[DataFrame, DataFrame]:
        """As :meth:`add`, for a batch whose texts lie below the index's folder, in its buckets."""
        path = self._stored("run", self._table("text", own).where("doc_id is not null").mapInPandas(_fingerprint(self.least), FINGERPRINTS))
        new, before = self._table("run", path), [self._table("run", p) for kind, _, p in self.runs if kind == "run"]
        held = new.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        shared = reduce(DataFrame.unionByName, [held.where("lo < hi").select("h"), *[held.join(run, "h", "left_semi").select("h") for run in before]]).distinct()
        fresh = new.join(shared, "h", "left_semi").withColumn("fresh", F.lit(True))
        hits = reduce(DataFrame.unionByName, [fresh, *[run.join(shared, "h", "left_semi").withColumn("fresh", F.lit(False)) for run in before]])
        places = written(hits.groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos", "fresh")).alias("at")), "places")
        self.runs += [("text", 0, own), ("run", 0, path)]
        texts = [self._table("text", p) for kind, _, p in self.runs if kind == "text"]  # by buckets of the id: only the places are shuffled to them
        contexts = [t.join(places, "doc_id").mapInPandas(_contexts(self.least), "h bigint, doc_id bigint, pos int, left int, context string, fresh boolean") for t in texts]
        around = written(reduce(DataFrame.unionByName, contexts), "contexts")
        self._compact()
        return self._verified(around)

    def _compact(self) -> None:
        """Runs of a level become one of the next where there are enough of them; then the manifest, then the old runs go."""
        old, level = [], 0
        while len(full := [r for r in self.runs if r[:2] == ("run", level)]) >= self.fanout:
            merged = self._stored("run", reduce(DataFrame.unionByName, [self._table("run", p) for _, _, p in full]))
            self.runs = [r for r in self.runs if r not in full] + [("run", level + 1, merged)]
            old += [p for _, _, p in full]
            level += 1
        self.version += 1
        rows = [(self.version, self.least, self.fanout, self.buckets, n, *r) for n, r in enumerate(self.runs)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{self.folder}/manifest-{self.version:06d}")
        for path in old:
            self._drop(path)

    def _verified(self, around: DataFrame) -> tuple[DataFrame, DataFrame]:
        large = written(around.groupBy("h").count().where(F.col("count") > LARGE_GROUP).select("h"), "large")
        small = around.join(large, "h", "left_anti").repartition("h").sortWithinPartitions("h")
        pairs = small.mapInPandas(_match_groups(self.least), PAIRS)
        spans = pairs.select(F.explode(F.array(
            F.struct(F.col("doc_id_a").alias("doc_id"), F.col("start_a").alias("start"), "length"), F.struct(F.col("doc_id_b").alias("doc_id"), F.col("start_b").alias("start"), "length"))).alias("s")).select("s.*")
        if large.isEmpty():
            return pairs.select("doc_id_a", "doc_id_b"), spans
        keys = written(around.join(large, "h", "left_semi").mapInPandas(_window_keys(self.least), "w1 bigint, w2 bigint, doc_id bigint, start int, fresh boolean").distinct(), "windows")
        members = keys.groupBy("w1", "w2", "doc_id").agg(F.max("fresh").alias("fresh"))
        sets = members.groupBy("w1", "w2").agg(
            F.bit_xor(F.xxhash64("doc_id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(5), "doc_id")).alias("s2"), F.count("*").alias("n"), F.max("fresh").alias("any_fresh")).where("n > 1")
        one = sets.where("any_fresh").groupBy("s1", "s2", "n").agg(F.min(F.struct("w1", "w2")).alias("w")).select("w.w1", "w.w2", "n")  # windows of the same records give the same pairs
        inside = written(members.join(one, ["w1", "w2"]).withColumn("parts", F.ceil(F.col("n") / PART_DOCS).cast("int")), "members")
        a = inside.select("w1", "w2", F.col("doc_id").alias("doc_id_a"), F.col("fresh").alias("f_a"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
        b = inside.select("w1", "w2", F.col("doc_id").alias("doc_id_b"), F.col("fresh").alias("f_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part"))
        more = a.join(b, ["w1", "w2", "part"]).where("doc_id_a < doc_id_b and (f_a or f_b)").select("doc_id_a", "doc_id_b")
        found = keys.join(sets.select("w1", "w2"), ["w1", "w2"], "left_semi").select("doc_id", "start", F.lit(self.least).alias("length"))
        return pairs.select("doc_id_a", "doc_id_b").unionByName(more), spans.unionByName(found)


def shared_spans(documents: DataFrame, least: int = MIN_LENGTH, batches: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """Pairs of records that share a run of ``least`` or more code points, ``doc_id_a < doc_id_b`` each once; and ``doc_id, start, length`` of spans that stand elsewhere too.

    documents: ``doc_id, text``; exact duplicates count once, of several texts for one id the greatest holds; rows without id or text, and texts shorter than ``least``, share nothing.
    The records enter the index in ``batches`` by a hash of their id, as deliveries would; three make it compact once.
    """
    index, found = SpanIndex(documents.sparkSession, least, **how), []
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text").repartition(index.buckets, "doc_id")  # one shuffle of the texts, into the buckets they stay in
    texts = rows.groupBy("doc_id").agg(F.max("text").alias("text")).where(F.length("text") >= least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    for path in index.stored_batches(texts, batches):
        found.append(index.add_stored(path))
    index.discard()
    return reduce(DataFrame.unionByName, [p for p, _ in found]).distinct(), reduce(DataFrame.unionByName, [s for _, s in found])


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for spans in batch["spans"]:
            end = total = 0
            for start, stop in sorted((s["start"], s["start"] + s["length"]) for s in spans):
                total += max(0, stop - max(start, end))
                end = max(end, stop)
            out.append(total)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": batch["n_chars"], "shared_chars": out})


def shared_amounts(documents: DataFrame, least: int = MIN_LENGTH, **how) -> DataFrame:
    """``doc_id, n_chars, shared_chars, share`` for every record with a text: how much of it stands in others too, in spans of at least ``least``."""
    _, spans = shared_spans(documents, least, **how)
    lengths = documents.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.length(F.max("text")).alias("n_chars"))
    rows = lengths.join(spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans")), "doc_id", "left")
    covered = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>"))).mapInPandas(_covered, "doc_id bigint, n_chars int, shared_chars int")
    return covered.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
