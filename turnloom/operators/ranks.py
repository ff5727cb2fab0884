"""Positions of rows in a global order, without a task that holds more than its share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnloom.sources.sinks import staged

_IN_PARTITION = (1 << 33) - 1


def ranked(df: DataFrame, *order: Column | str, name: str = "rank", total: str | None = None) -> DataFrame:
    """The rows with their 0-based position in the given order (which must have no ties for a stable result).

    ``total`` names a column for the number of all rows.

    One range-partitioned sort, written with the partition and the place in it. Partitions are ranges of the order, so a
    row's position is its place plus the sizes of the partitions before: a table of one row per partition.
    """
    place = F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION)
    placed = staged(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ranked")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_total"))
    own = [*df.columns, (F.col("_before") + F.col("_place")).alias(name)] + ([F.col("_total").alias(total)] if total else [])
    return placed.join(F.broadcast(offsets), "_part").select(*own)


def with_rank(df: DataFrame, key: str, *order: Column | str, name: str = "rank", total: str = "_total") -> DataFrame:
    """``df`` with the rank of its rows by expressions over a unique, non-null ``key``.

    Only the keys are sorted and numbered; the ranks, narrow rows, are hashed per partition and met by the wide rows.
    """
    ranks = ranked(df.select(key), *order, name=name, total=total)
    return df.join(ranks.hint("shuffle_hash"), key)
