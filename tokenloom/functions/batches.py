"""Arrow batches that are small, and a part of them at a time: what a Python worker holds does not follow the input's size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of a batch that Spark hands to a worker.  By default it is 64 MB, and a worker holds several such at a time.
MOST_BYTES = 4 << 20
#: So many items of lists, or bytes of text, are worked on at a time; a row of more is a part of its own.
MOST_ITEMS = 250_000


def small_batches() -> None:
    """The session's batches have ``MOST_BYTES`` at most (or one row) from now on; a smaller limit stays."""
    conf, name = SparkSession.active().conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or not (now.removesuffix("b").isdigit() and 0 < int(now.removesuffix("b")) <= MOST_BYTES):
        conf.set(name, f"{MOST_BYTES}b")


def in_parts(run: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``run`` over whole rows of the columns in turn; the first column's items are counted.  What it gives is put together."""
    kind = columns[0].type
    length = pc.binary_length if pa.types.is_string(kind) or pa.types.is_binary(kind) else pc.list_value_length
    ends = np.cumsum(np.asarray(pc.fill_null(length(columns[0]), 0)).astype(np.int64))
    parts, start = [], 0
    while start < len(ends) or not parts:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + MOST_ITEMS, side="right")))
        parts.append(run(*(c.slice(start, stop - start) for c in columns)))
        start = stop
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
