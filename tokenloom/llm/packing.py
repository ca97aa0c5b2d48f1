"""Variable-capacity best-fit packing of documents into bins of several permitted lengths.

Items are placed in order of falling length, each into the open bin that it leaves fullest.  An item that fits none opens a
bin.  Its size is chosen for all permitted lengths at once: the one whose cost for each token that the remaining items
of the group can put there is least (a bin of length c costs ``per_bin + c + quadratic * c * c``: a short bin must earn its
fixed cost, a long one its attention).  At the end every bin is cut down to the smallest permitted length that still holds its contents.

Documents longer than the longest bin are cut into pieces of it; nothing is dropped.  Groups of about ``group_items``
pieces, dealt by a hash of (doc_id, piece), are packed apart, one task each, so memory is bounded and no key is hot; a group loses at most
a few part-filled bins.

Edge cases: a null length counts as 0 and is placed like any item; a null doc_id is an id of its own; repeated rows are items of
their own; an empty table gives no row; columns other than the two used are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, slices, stored, work_dir
from .stretches import encoder

CAPACITIES = (512, 1024, 2048, 4096, 8192)
PER_BIN = 256
QUADRATIC = 1 / 16384
GROUP_ITEMS = 20_000


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, per_bin: float = PER_BIN, quadratic: float = QUADRATIC) -> tuple[list[int], list[int]]:
    """For each item its bin, and for each bin its length; ``lengths`` must fall and fit the longest bin."""
    sizes = sorted(capacities)
    cost = {c: per_bin + c + quadratic * c * c for c in sizes}
    left_of_all = sum(lengths)
    bins_of, filled, capacity = [], [], []
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    for n in lengths:
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            # what a bin of each size could take of the items not yet placed
            c = min((c for c in sizes if c >= n), key=lambda c: (cost[c] / max(1, min(c, left_of_all)), c))
            b, room = len(filled), c
            filled.append(0)
            capacity.append(c)
        bins_of.append(b)
        filled[b] += n
        left_of_all -= n
        if room > n:
            insort(open_bins, (room - n, b))
    return bins_of, [next(c for c in sizes if c >= used) for used in filled]


def best_fit_bins(df: DataFrame, *, doc_id: str = "doc_id", length: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, per_bin: float = PER_BIN, quadratic: float = QUADRATIC, group_items: int = GROUP_ITEMS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, bin_id, bin_capacity, bin_offset, bin_used."""
    most = max(capacities)
    items = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    # ids of a written table's rows, so that a task run again deals alike; they part repeats of one and the same row
    items = items.withColumn("place", F.monotonically_increasing_id())
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)).cast("int"))))
    items = items.select("doc_id", "place", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.col("n") - F.col("piece").cast("long") * most, F.lit(most)).alias("length"))
    groups = max(1, -(-df.count() // group_items))
    items = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length", "place"), F.lit(groups)))

    def run(key, rows):
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = rows["length"].tolist()
        bins_of, sizes = pack(lengths, capacities, per_bin, quadratic)
        used, offsets = [0] * len(sizes), []
        for b, n in zip(bins_of, lengths, strict=True):
            offsets.append(used[b])
            used[b] += n
        return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["piece"], "start": rows["start"], "length": rows["length"], "bin_id": [f"{key[0]}-{b}" for b in bins_of], "bin_capacity": [sizes[b] for b in bins_of], "bin_offset": offsets, "bin_used": [used[b] for b in bins_of]})

    packed = items.groupBy("group").applyInPandas(run, "doc_id long, piece int, start long, length long, bin_id string, bin_capacity int, bin_offset long, bin_used long")
    return packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def token_lengths(df: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the exact token counts of the whole texts under ``vocabulary``, an end token a document included."""

    def run(batches):
        own = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.counts(batch.column("text")) + 1)], names=["doc_id", "n_tokens"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def pack_documents(df: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Packs by exact token counts of the whole texts under ``vocabulary``, one end token a document included."""
    lengths = stored(token_lengths(df, vocabulary, doc_id=doc_id, text=text), work_dir(df.sparkSession) + "/lengths")
    return best_fit_bins(lengths, **options)
