"""Token ids in binary files: one concatenated id array a segment, document boundaries Elias-Fano encoded.

A segment file is

    magic "TLEF\\x01\\0\\0\\0" | header: 8 little-endian u64 | ids | boundaries | doc ids | "\\n"

with header (documents, null doc ids, bytes an id, bytes of the ids, bytes of the boundaries, bytes of the doc
ids, smallest doc id as two's complement, 0).  Boundaries are the n+1 ascending offsets into the id array, doc ids the
ascending ids less the smallest.  Either is an Elias-Fano sequence: of each value the ``l`` low bits are packed, the
rest is coded in unary in a bit vector of at most 2n+1 bits, beside which the place of every 64th one is kept;
``select`` jumps there and scans a few bytes, so an offset costs O(1) and n offsets about n(2 + log2(ids/n)) bits.

Files are written by Spark's own writer as rows of raw bytes (the final newline is the row's end), so any
Hadoop file system, task retries and commits work as for other tables.  The names of the partition folders carry each
segment's counts, so the global offset of a segment comes from a listing alone.

Order is ascending doc_id over all segments (null first), then by a hash of the text.  Edge cases: a null or empty text is
the end id alone; repeated rows are documents of their own; an empty table gives no segment and no row; a segment is cut
when it holds ``segment_ids`` ids, but a document is never split, however long; columns other than the two used are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, work_dir
from .stretches import encoder

MAGIC = b"TLEF\x01\0\0\0"
EVERY = 64
SEGMENT_IDS = 4_000_000
#: Up to so many segments (16 bytes each) the starts go to all executors; beyond, the files are shuffled to them.
MOST_SENT = 1_000_000


# --- Elias-Fano
def ef_encode(values: np.ndarray) -> bytes:
    """An ascending sequence of uint64 from 0 on."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, dtype=np.uint8)
    bits[high] = 1
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.empty(0, np.uint8)
    low_bytes, high_bytes = np.packbits(lows.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes()
    samples = high[::EVERY].astype("<u8").tobytes()
    return struct.pack("<5Q", n, low, len(low_bytes), len(high_bytes), len(samples)) + low_bytes + high_bytes + samples


class EliasFano:
    """A read-only view of an encoded sequence."""

    def __init__(self, data: memoryview | bytes):
        data = memoryview(data)
        self.n, self.low, a, b, c = struct.unpack_from("<5Q", data)
        self.lows, self.highs, self.samples = data[40 : 40 + a], data[40 + a : 40 + a + b], np.frombuffer(data[40 + a + b : 40 + a + b + c], dtype="<u8")

    def select(self, i: int) -> int:
        """The place of the i-th one of the upper bit vector."""
        at = int(self.samples[i // EVERY])
        left = i % EVERY
        if not left:
            return at
        byte, start = divmod(at + 1, 8)
        word = self.highs[byte] >> start << start
        while (ones := word.bit_count()) < left:
            left -= ones
            byte += 1
            word = self.highs[byte]
        for _ in range(left - 1):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first, last = i * self.low, (i + 1) * self.low
        part = int.from_bytes(self.lows[first // 8 : -(-last // 8)], "little") >> (first % 8) & ((1 << self.low) - 1)
        return (self.select(i) - i) << self.low | part

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little")).astype(np.uint64)
        values = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.uint64)
            values |= (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return values


# --- segments
def pack(doc_ids: list[int | None], parts: list[bytes], width: int) -> tuple[bytes, int]:
    """The bytes of a segment file without the final newline, and its number of ids; null doc ids stand first."""
    ends = np.cumsum([0] + [len(p) // width for p in parts]).astype(np.uint64)
    nulls = sum(d is None for d in doc_ids)
    known = doc_ids[nulls:]
    least = known[0] if known else 0
    ids, bounds, docs = b"".join(parts), ef_encode(ends), ef_encode(np.array([d - least for d in known], dtype=np.uint64))
    return b"".join((MAGIC, struct.pack("<6QqQ", len(parts), nulls, width, len(ids), len(bounds), len(docs), least, 0), ids, bounds, docs)), int(ends[-1])


class Segment:
    """Reads a segment file without unpacking more than is asked for."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC or view[-1] != 10:
            raise ValueError("not a segment file")
        self.n, self.nulls, self.width, a, b, c, self.least, _ = struct.unpack_from("<6QqQ", view, 8)
        self.ids = np.frombuffer(view[72 : 72 + a], dtype=f"<u{self.width}")
        self.bounds, self.docs = EliasFano(view[72 + a : 72 + a + b]), EliasFano(view[72 + a + b : 72 + a + b + c])

    def doc_id(self, i: int) -> int | None:
        return self.least + self.docs[i - self.nulls] if i >= self.nulls else None

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + int(x) for x in self.docs.all()]

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def write_token_segments(df: DataFrame, path: str, vocabulary: str, *, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the segments of ``df`` below ``path``, in ascending order of ``doc_id``."""
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    # the row's place only deals out repeats of one and the same row
    ordered = rows.withColumns({"h": F.xxhash64("text"), "r": F.xxhash64(F.monotonically_increasing_id())}).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h", "r").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def run(batches):
        own = encoder(vocabulary)
        end = np.array([end_id], dtype=f"<u{own.width}").tobytes() if end_id is not None else b""
        first, count = TaskContext.get().partitionId() << 32, 0
        docs, ids, size = [], [], 0

        def out():
            data, n = pack(docs, ids, own.width)
            return pa.RecordBatch.from_arrays([pa.array([first + count]), pa.array([len(docs)]), pa.array([n]), pa.array([data], pa.binary())], names=["segment", "n_docs", "n_tokens", "data"])

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                flat, bounds = own.ids(batch.column("text"))
                bounds = bounds.tolist()
                for d, a, b in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                    docs.append(d)
                    ids.append(flat[a:b].tobytes() + end)
                    size += len(ids[-1])
                    if size >= segment_ids * own.width:
                        yield out()
                        docs, ids, size, count = [], [], 0, count + 1
        if docs:
            yield out()

    made = ordered.mapInArrow(run, "segment long, n_docs long, n_tokens long, data binary")
    made.withColumn("data", F.col("data").cast("string")).write.mode("overwrite").partitionBy("segment", "n_docs", "n_tokens").text(path)


SEGMENT_COLUMNS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_segments(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, start (ids before it in all segments), n_tokens, ids_crc32 and, if asked for, the ids."""
    names = ["n_docs", "n_tokens", "segment"]
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    schema = SEGMENT_COLUMNS + (", ids array<long>" if with_ids else "")
    if "segment" not in files.columns:  # no segment, so no folder that names one
        return spark.createDataFrame([], schema)
    files = files.withColumns({n: F.col(n).cast("long") for n in names})
    starts, before = [], 0
    for segment, n in sorted((r["segment"], r["n_tokens"]) for r in files.select(*names).collect()):  # a listing: a row a segment
        starts.append((segment, before))
        before += n

    def run(batches):
        for batch in batches:
            for data, base in zip(batch.column("content"), batch.column("base").to_pylist(), strict=True):
                s = Segment(data.as_py())
                bounds = s.bounds.all().astype(np.int64)
                ids = s.ids.astype("<u4")
                ends = bounds.tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                arrays = [pa.array(s.doc_ids(), pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*SEGMENT_COLUMNS.replace(" long", "").split(", "), "ids"][: len(arrays)])

    bases = spark.createDataFrame(starts, "segment long, base long")
    based = files.join(F.broadcast(bases) if len(starts) <= MOST_SENT else bases, "segment")
    return based.select("content", "base").mapInArrow(run, schema)


def token_files(df: DataFrame, vocabulary: str, *, path: str | None = None, **options) -> DataFrame:
    """Writes segments (below a new work folder unless ``path`` is given) and reads them back."""
    spark = df.sparkSession
    path = path or work_dir(spark) + "/segments"
    write_token_segments(df, path, vocabulary, **options)
    return read_token_segments(spark, path)
