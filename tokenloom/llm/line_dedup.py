"""Incremental, reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.  Keys of at least ``min_chars`` code points
count.  The store holds, in versions that are written whole and then referred to,

- postings: (shard, key, doc_id), each once;
- references: (shard, key, n_docs, last_doc), the exact count of documents and the largest of them;
- filters: a cuckoo filter a shard over the keys with n_docs >= ``min_docs``, the ones whose lines may have to go.

``insert`` adds documents and ``delete`` takes them out: counts move, keys that reach or leave the threshold are put into or
deleted from their shard's filter, so a deletion undoes an insertion exactly.  ``apply`` looks lines up in the filters
and only the lines that pass (repeated ones and a few false positives) are joined to the exact table, which decides.

Filters are sent to all executors only while together they take at most ``broadcast_bytes``; beyond, all lines go straight to
the exact join and all texts to the join with what they lose, with the same result.  A hot line is one row a document in postings;
counts are combined before the shuffle, and the join reads written tables, so its partition can be split.

Edge cases: a null or empty text is one empty line; rows of one doc_id count as one document; a null doc_id counts
as one document below all others; repeated rows are answered one by one; texts of any length are processed whole; an empty
table gives no row; input columns named like an output, in any case of letters, give way.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, WS, slices, stored, texts_of, without, work_dir

MIN_CHARS, MIN_DOCS = 40, 5
BROADCAST_BYTES = 64 << 20


def key_hash(line: str, min_chars: int) -> tuple[int, int] | None:
    """Two signed halves of the key's 128-bit hash, or None for a short key."""
    s = line.strip(WS)
    if len(s) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(s.encode("utf-8").lower())
    hi, lo = h >> 64, h & ((1 << 64) - 1)
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets, each found from the other and the fingerprint."""

    SLOTS = 4

    def __init__(self, n_keys: int = 0, data: bytes | None = None):
        if data is None:
            need = max(1, -(-n_keys * 10 // (9 * self.SLOTS)))
            self.table = np.zeros((1 << (need - 1).bit_length(), self.SLOTS), dtype=np.uint16)
        else:
            self.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, self.SLOTS).copy()
        self.mask = np.uint64(len(self.table) - 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of uint64 hashes."""
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = keys & self.mask
        return prints, first, first ^ self.other(prints)

    def other(self, prints):
        return (np.uint64(0x5BD1E9955BD1E995) * np.asarray(prints, dtype=np.uint64) >> np.uint64(17)) & self.mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> CuckooFilter:
        """The filter with ``keys`` added: this one, or a larger one if they do not fit (the caller rebuilds from exact keys)."""
        table, seed = self.table, 1
        for p, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for kick in range(500):
                row = next((r for r in (a, b) if (table[r] == 0).any()), None)
                if row is not None:
                    table[row, int(np.argmax(table[row] == 0))] = p
                    break
                seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
                slot, row = (seed >> 8) % self.SLOTS, (a, b)[seed >> 16 & 1]
                p, table[row, slot] = int(table[row, slot]), p
                a = b = int(np.uint64(row) ^ self.other(p))
            else:
                raise OverflowError("the filter is full")
        return self

    def delete(self, keys: np.ndarray) -> CuckooFilter:
        for p, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for row in (a, b):
                at = np.flatnonzero(self.table[row] == p)
                if len(at):
                    self.table[row, at[0]] = 0
                    break
            else:
                raise KeyError("a key that was not inserted")
        return self

    def tobytes(self) -> bytes:
        return self.table.tobytes()


def filter_of(keys: np.ndarray) -> CuckooFilter:
    room = len(keys)
    while True:
        try:
            return CuckooFilter(room).insert(keys)
        except OverflowError:
            room = room * 2 + 8


KEY = ["shard", "k1", "k2"]


def long_lines(texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text, and the halves of the key's hash, of the distinct long lines of each text."""
    place, k1, k2 = [], [], []
    for i, t in enumerate(texts):
        if len(t) >= min_chars:
            keys = {key_hash(x, min_chars) for x in t.split("\n") if len(x) >= min_chars} - {None}
            place += [i] * len(keys)
            for a, b in keys:
                k1.append(a)
                k2.append(b)
    return np.array(place, np.int64), np.array(k1, np.int64), np.array(k2, np.int64)


def shard_of(k1: np.ndarray, shards: int) -> np.ndarray:
    return ((k1.view(np.uint64) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


class Filters:
    """The filters of a store, sent to all executors."""

    def __init__(self, store: LineStore, data: dict[int, bytes]):
        self.shards, self.sent = store.shards, store.spark.sparkContext.broadcast(data)
        self.made: dict[int, CuckooFilter] | None = None

    def __getstate__(self):
        return {"shards": self.shards, "sent": self.sent, "made": None}

    def lines(self, texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``long_lines`` returns, and which of these lines pass."""
        if self.made is None:
            self.made = {k: CuckooFilter(data=v) for k, v in self.sent.value.items()}
        place, k1, k2 = long_lines(texts, min_chars)
        shard, passed = shard_of(k1, self.shards), np.zeros(len(k1), dtype=bool)
        for s in np.unique(shard):
            if int(s) in self.made:
                at = np.flatnonzero(shard == s)
                passed[at] = self.made[int(s)].holds(k2[at].view(np.uint64))
        return place, k1, k2, passed


class LineStore:
    """The tables of one store; each change writes new versions of them below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, shards: int = 16, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES):
        self.spark, self.path = spark, path or work_dir(spark) + "/lines"
        self.shards, self.min_chars, self.min_docs, self.most = shards, min_chars, min_docs, broadcast_bytes
        self.version = 0
        self.postings = self.references = self.filters = None

    def pairs(self, df: DataFrame, doc_id: str, text: str, filters: Filters | None = None) -> DataFrame:
        """(shard, k1, k2, doc_id) of the long lines, each once a row of ``df``; with ``filters`` only of those that pass."""
        shards, min_chars = self.shards, self.min_chars

        def run(batches):
            for whole in batches:
                for batch in slices(whole, "text"):
                    ids = np.asarray(batch.column("doc_id"))
                    texts = texts_of(batch.column("text"))
                    if filters is not None:
                        place, k1, k2, passed = filters.lines(texts, min_chars)
                        place, k1, k2 = place[passed], k1[passed], k2[passed]
                    else:
                        place, k1, k2 = long_lines(texts, min_chars)
                    yield pa.RecordBatch.from_arrays([pa.array(shard_of(k1, shards)), pa.array(k1), pa.array(k2), pa.array(ids[place])], names=[*KEY, "doc_id"])

        rows = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text}`").alias("text"))
        return rows.mapInArrow(run, "shard int, k1 long, k2 long, doc_id long")

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        return stored(df, f"{self.path}/{name}-{self.version}")

    def _refilter(self, before: DataFrame | None) -> None:
        """Brings the filters up to date with the references: only keys that crossed the threshold are moved."""
        hot = self.references.where(F.col("n_docs") >= self.min_docs).select(*KEY)
        schema = "shard int, n_keys long, data binary"

        def update(key, changes, now):
            """A shard's filter after its changes; one that does not hold them has no data and is rebuilt."""
            way = np.asarray(changes.column("way"))
            k = np.asarray(changes.column("k2")).astype(np.int64).view(np.uint64)
            n, data = int(way.sum()), None
            if now.num_rows:
                n += now.column("n_keys")[0].as_py()
                made = CuckooFilter(data=now.column("data")[0].as_py()).delete(k[way < 0])
                if n * 10 <= made.table.size * 9:
                    with contextlib.suppress(OverflowError):
                        data = made.insert(k[way > 0]).tobytes()
            else:
                data = filter_of(k[way > 0]).tobytes()
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_keys": pa.array([n], pa.int64()), "data": pa.array([data], pa.binary())})

        fresh = lambda keys: keys.withColumn("way", F.lit(1)).groupBy("shard").applyInArrow(lambda key, t: update(key, t, pa.table({"n_keys": [], "data": []})), schema)
        if before is None:
            self.filters = self._keep("filters", fresh(hot))
            return
        old = before.where(F.col("n_docs") >= self.min_docs).select(*KEY)
        moved = hot.join(old, KEY, "left_anti").withColumn("way", F.lit(1)).unionByName(old.join(hot, KEY, "left_anti").withColumn("way", F.lit(-1)))
        changed = moved.groupBy("shard").cogroup(self.filters.groupBy("shard"))
        tried = self._keep("tried", changed.applyInArrow(lambda key, c, now: update(key, c, now) if c.num_rows else now.select(["shard", "n_keys", "data"]), schema))
        full = tried.where("data is null").select("shard")
        # from the exact table, at the next size
        rebuilt = fresh(hot.join(full, "shard", "left_semi"))
        self.filters = self._keep("filters", tried.where("data is not null").unionByName(rebuilt))

    def insert(self, df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> LineStore:
        """Adds documents; ids that are in the store already only add the lines they did not have."""
        self.version += 1
        new = self.pairs(df, doc_id, text).distinct()
        if self.postings is not None:
            new = new.join(self.postings, [*KEY, "doc_id"], "left_anti")
        new = self._keep("new", new)
        added = new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        before = self.references
        if before is not None:
            added = before.unionByName(added).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        self.references = self._keep("references", added)
        self.postings = new if self.postings is None else self.postings.unionByName(new)
        self._refilter(before)
        return self

    def delete(self, ids: DataFrame, *, doc_id: str = "doc_id") -> LineStore:
        """Takes documents out: the store is then as if they had never been inserted."""
        self.version += 1
        gone = ids.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        touched = self._keep("touched", self.postings.join(gone, "doc_id", "left_semi").select(*KEY).distinct())
        self.postings = self._keep("postings", self.postings.join(gone, "doc_id", "left_anti"))
        anew = self.postings.join(touched, KEY, "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        before = self.references
        self.references = self._keep("references", before.join(touched, KEY, "left_anti").unionByName(anew))
        self._refilter(before)
        return self

    def _lists(self, df: DataFrame, filters: Filters | None, doc_id: str, text: str) -> DataFrame:
        """(id_, gone_): for each document that loses lines the keys of these lines."""
        hits = self.pairs(df, doc_id, text, filters)
        exact = self.references.where(F.col("n_docs") >= self.min_docs).select(*KEY, "last_doc")
        gone = hits.join(exact, KEY).where(F.col("doc_id") != F.col("last_doc"))
        self.version += 1
        return self._keep("gone", gone.groupBy(F.col("doc_id").alias("id_")).agg(F.collect_set(F.struct("k1", "k2")).alias("gone_")))

    def apply(self, df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``df`` with ``text`` less its repeated lines, and ``n_lines`` (before) and ``n_dropped``.

        The filters also tell which documents can lose a line at all.  The others stay where they are; only texts
        with a line that passes are shuffled, by the same merge join at every size.
        """
        size = self.filters.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        filters = Filters(self, {r["shard"]: bytes(r["data"]) for r in self.filters.collect()}) if size <= self.most else None
        lists = self._lists(df, filters, doc_id, text)
        kept = without(df, "n_lines", "n_dropped")
        schema = T.StructType(kept + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        fields = [F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(kept) if f.name != text]
        rows = df.select(F.struct(*fields).alias("row"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id_"))
        min_chars = self.min_chars

        def passing(batch):
            """Which rows' documents hold a line that passes the filters."""
            place, _, _, passed = filters.lines(texts_of(batch.column("text")), min_chars)
            mark = np.zeros(batch.num_rows, dtype=bool)
            mark[place[passed]] = True
            return mark

        def cut(batch):
            values = iter(batch.column("row").flatten())
            lists = batch.column("gone_").to_pylist() if "gone_" in batch.schema.names else [None] * batch.num_rows
            texts, lines, dropped = [], [], []
            for t, gone in zip(batch.column("text").to_pylist(), lists, strict=True):
                n, k = (t or "").count("\n") + 1, 0
                if gone:
                    drop = {(g["k1"], g["k2"]) for g in gone}
                    stay = [x for x in t.split("\n") if len(x) < min_chars or key_hash(x, min_chars) not in drop]
                    k = n - len(stay)
                    t = "\n".join(stay)
                texts.append(t)
                lines.append(n)
                dropped.append(k)
            arrays = [pa.array(texts, pa.string()) if f.name == text else next(values) for f in kept] + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

        def each(f):
            """``f`` of every slice, in one Python function a task: a second one would need a worker of its own, which lives on with its memory."""
            return lambda batches: (f(batch) for whole in batches for batch in slices(whole, "text"))

        touched = rows.mapInArrow(each(lambda batch: batch.filter(pa.array(passing(batch)))), rows.schema) if filters else rows
        merged = touched.join(lists.hint("merge"), "id_", "left").select("row", "text", "gone_").mapInArrow(each(cut), schema)
        if not filters:
            return merged
        return merged.unionByName(rows.select("row", "text").mapInArrow(each(lambda batch: cut(batch.filter(pa.array(~passing(batch))))), schema))


def dedup_lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> DataFrame:
    """One batch: a new store of ``df`` applied to ``df``."""
    shards = shards or max(4, df.rdd.getNumPartitions())
    store = LineStore(df.sparkSession, shards=shards, min_chars=min_chars, min_docs=min_docs)
    return store.insert(df, doc_id=doc_id, text=text).apply(df, doc_id=doc_id, text=text)
