"""Vocabulary tables as relations: lookups both ways, constraints, and merge rules resolved by joins.

A lookup joins a dimension of a checked size: up to ``BROADCAST_ROWS`` rows it is sent to all executors, beyond that
the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def dimension(table: DataFrame) -> DataFrame:
    """With the hint to send it to all executors if it is small enough."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def look_up_tokens(rows: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """``rows`` with ``id`` of their token bytes, null if there is none."""
    return rows.join(dimension(vocabulary.select(F.col("token").alias(token), "id")), token, "left")


def look_up_ids(rows: DataFrame, vocabulary: DataFrame, specials: DataFrame | None = None, id_: str = "id") -> DataFrame:
    """``rows`` with the bytes ``piece`` of their id: a regular token before a special one, null if neither."""
    out = rows.join(dimension(vocabulary.select(F.col("id").alias(id_), F.col("token").alias("regular_"))), id_, "left")
    if specials is not None:
        out = out.join(dimension(specials.select(F.col("id").alias(id_), F.encode("token", "UTF-8").alias("special_"))), id_, "left")
        return out.withColumn("piece", F.coalesce("regular_", "special_")).drop("regular_", "special_")
    return out.withColumnRenamed("regular_", "piece")


def without_specials(vocabulary: DataFrame, specials: DataFrame) -> DataFrame:
    """Entries whose id no special has."""
    return vocabulary.join(dimension(specials.select("id")), "id", "left_anti")


def resolve_merges(merges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``rank, first_id, second_id, merged, merged_id`` of the rules whose three texts are tokens; the first of a pair wins.

    ``merges`` has position, first, second; ``vocabulary`` has token (text) and id.
    """
    side = lambda name: dimension(vocabulary.select(F.col("token").alias(name), F.col("id").alias(f"{name}_id")))
    rules = merges.withColumn("merged", F.concat("first", "second")).join(side("first"), "first").join(side("second"), "second").join(side("merged"), "merged")
    first = Window.partitionBy("first_id", "second_id").orderBy("position")
    return rules.withColumn("n_", F.row_number().over(first)).where("n_ = 1").select(F.col("position").alias("rank"), "first_id", "second_id", "merged", "merged_id")


def merge_ranks(rules: DataFrame) -> DataFrame:
    """The least rank of each merged text."""
    return rules.groupBy("merged").agg(F.min("rank").alias("rank"))

