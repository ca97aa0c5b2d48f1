"""Proportional stratified interleaving: shards whose mixture of sources is that of the whole table.

Rows of a source are ranked in the order of a seeded hash.  Row r of a source of n rows gets the
fractional rank (2r - 1) / 2n; sorting all rows by it interleaves the sources in proportion, so that
any contiguous run holds each source's share.  The order is cut into runs of equal length.

Both rankings are distributed.  A rank is the number of rows in the buckets before (a small table of
counts, summed in hash-range buckets) plus a row number within the bucket.  Buckets are ranges of the hash or
of the fractional rank, both uniform, so a source with a third of all rows just fills its buckets
with several times as many rows as another: no task holds a whole source.

Edge cases: a null source is a stratum of its own; a null key is hashed as the text "null"; repeated rows
are interchangeable and take neighbouring ranks; an empty table gives an empty result; input columns named like an
output (``shard``, ``slot``) give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_columns_after, work_dir

#: Rows that one ranking bucket holds on average.
BUCKET_ROWS = 20_000
#: Bound on the buckets, and so on what the driver gathers and sends of them (16 bytes each); with more rows buckets hold more.
MOST_BUCKETS = 100_000
#: The hash is the first 15 hexadecimal digits of an MD5, below 2^60.
HASH_BITS = 60


def seeded_hash(key: F.Column, seed: int) -> F.Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def stratified_shards(df: DataFrame, n_shards: int, *, key: str = "doc_id", stratum: str = "source", seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard); counts differ by one at most."""
    spark = df.sparkSession
    path = work_dir(spark)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("")).alias("s"),
        seeded_hash(F.col(f"`{key}`"), seed).alias("h"),
    ).withColumn("tie", F.xxhash64(F.to_json("row")))
    rows = stored(rows, f"{path}/rows")
    total = rows.count()
    buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_rows)))
    # rank within the stratum
    first = rows.withColumn("b", F.floor(F.col("h") / F.lit(float(1 << HASH_BITS)) * F.lit(buckets)).cast("long"))
    counts = first.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, f"{path}/strata")
    in_stratum = Window.partitionBy("s")
    offsets = counts.select("s", "b", (F.sum("n").over(in_stratum.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(in_stratum).alias("of"))
    # a bucket of a stratum is ranked in one task, so the counts join where the rows already are
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "tie"))).join(offsets, ["s", "b"])
    ranked = ranked.withColumn("f", (2 * (F.col("before") + F.col("r")) - 1).cast("double") / (2 * F.col("of")).cast("double"))
    ranked = stored(ranked.select("row", "s", "h", "tie", "f", F.least(F.floor(F.col("f") * F.lit(buckets)), F.lit(buckets - 1)).cast("long").alias("fb")), f"{path}/ranked")
    # rank over all rows: as many counts as buckets, so one small window
    before, sofar = [], 0
    for b, n in sorted((r["fb"], r["n"]) for r in ranked.groupBy("fb").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((b, sofar))
        sofar += n
    starts = spark.createDataFrame(before, "fb long, start long")
    placed = ranked.withColumn("r", F.row_number().over(Window.partitionBy("fb").orderBy("f", "s", "h", "tie"))).join(F.broadcast(starts), "fb")
    position = F.col("start") + F.col("r") - 1
    shard = F.expr(f"cast(({n_shards} * (start + r) - 1) div {max(total, 1)} as int)")
    placed = placed.withColumn("shard_", shard).withColumn("slot_", position - F.expr(f"(shard_ * {total}L) div {n_shards}"))
    return with_columns_after(placed, "row", {"shard": F.col("shard_"), "slot": F.col("slot_").cast("long")})


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """Writes the rows of each shard, in slot order, below ``path/shard=i``; each shard may take several files."""
    placed = stratified_shards(df, n_shards, **options)
    files = max(1, placed.sparkSession.sparkContext.defaultParallelism)
    placed.repartitionByRange(max(files, n_shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
