"""What the operators of this subpackage share: work folders, row packing and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the contracts, ``[\x20\x09-\x0D]``.
WS = " \t\n\x0b\x0c\r"
#: A doc_id of null sorts below every other and compares equal to itself.
NO_ID = -(1 << 63)


def work_dir(spark: SparkSession) -> str:
    """A new folder for tables and checkpoints, in the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is empty is a folder of our own made and set: below the warehouse, which all executors share.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_tokenloom_dir", None)
        if base is None:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tokenloom-{uuid.uuid4().hex}"
            spark.sparkContext._tokenloom_dir = base
            spark.sparkContext.setCheckpointDir(base)
            atexit.register(_forget, spark, base)
    return f"{base.rstrip('/')}/tokenloom-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, base: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session leaves its folder
        remove_dir(spark, base)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a work folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder (Spark removes it once nothing refers to it)."""
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        work_dir(df.sparkSession)
    return df.checkpoint()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def without(df: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of ``df`` but for ``names``, in any case of letters: an input column named like an output gives way."""
    low = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in low]


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by position, which clash with nothing, and the name that each column now has."""
    names = [f"column{i}_" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def with_columns_after(df: DataFrame, packed: str, outputs: dict[str, F.Column]) -> DataFrame:
    """Unpacks struct ``packed`` and appends ``outputs``; an input column of an output's name gives way."""
    names = {n.lower() for n in outputs}
    fields = [f.name for f in df.schema[packed].dataType.fields if f.name.lower() not in names]
    kept = [F.col(packed).getField(n).alias(n) for n in fields]
    return df.select(*kept, *[c.alias(n) for n, c in outputs.items()])


def texts_of(array) -> list[str]:
    """Python strings of an Arrow column; null counts as an empty text."""
    return [x if x is not None else "" for x in array.to_pylist()]


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Freed memory goes back to the system: workers live on, and what their allocators keep adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch, column: str, most_bytes: int = 4 << 20):
    """Cuts an Arrow batch into runs of rows whose texts stay near ``most_bytes``; a longer text is a run alone."""
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(n):
        if total and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


#: Fixed odd multipliers of the multilinear shingle hash and the finishing constants of a 64-bit mixer.
_MUL = np.random.default_rng(20240229).integers(1, 1 << 63, size=16, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = words[:n] * _MUL[0]
    for j in range(1, k):
        total = total + words[j : j + n] * _MUL[j]
    return mixed(total)


#: Words are hashed in stretches of so many bytes, which bounds the memory of a text of any length.
STRETCH = 1 << 17
_SPACE = np.isin(np.arange(256), list(WS.encode()))
_BYTE = np.random.default_rng(65537).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (np.r_[np.uint64(1), np.cumprod(np.full(STRETCH, x, dtype=np.uint64))] for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes begin and end."""
    edges = np.ones(len(data) + 2, dtype=np.int8)
    edges[1:-1] = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.diff(edges)
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: polynomials over random values of their bytes, from running sums.  A word longer than a stretch is hashed alone."""
    import xxhash

    view, out, i = np.frombuffer(data, dtype=np.uint8), np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        first = int(starts[i])
        j = int(np.searchsorted(ends, first + STRETCH, "right"))
        if j <= i:
            out[i] = xxhash.xxh3_64_intdigest(data[first : int(ends[i])])
            i += 1
            continue
        sums = np.zeros(int(ends[j - 1]) - first + 1, dtype=np.uint64)
        np.cumsum(_BYTE[view[first : int(ends[j - 1])]] * _POWERS[: len(sums) - 1], out=sums[1:])
        a = starts[i:j] - first
        out[i:j] = mixed((sums[ends[i:j] - first] - sums[a]) * _INVERSES[a])
        i = j
    return out


def shingle_set(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles, A-Z lower-cased; fewer words make one shingle, none make no set."""
    data = text.encode("utf-8", "surrogatepass").lower()
    bounds = word_bounds(data)
    if not len(bounds[0]):
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(data, *bounds)
    return np.unique(windows(h, k)) if len(h) >= k else windows(h, len(h))


LONG, INT, STR, BIN = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()
