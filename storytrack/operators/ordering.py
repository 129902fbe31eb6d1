"""Positions in a total order without a single-partition window.

``Window.orderBy(...)`` with no partition key pulls every row into one task. Here the
rows are range-partitioned and sorted (the sort splits even a single hot key across
tasks), each row's (partition, offset-in-partition) comes from
``monotonically_increasing_id``, and per-partition row counts — one tiny row per
partition — are prefix-summed into partition offsets and broadcast back. The size of
that broadcast is bounded by the number of partitions, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storytrack.session import checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Add a 0-based, gap-free position of each row in ``order`` (which must be total).

    The sorted, id-stamped frame is read twice (counts and rows). Range-partition
    sampling is not stable when the input's in-partition order isn't (e.g. after a
    shuffle join), so the frame is written once with a reliable ``checkpoint()`` to the
    cluster's checkpoint folder; both reads — and any task retry after an executor
    loss — then see the same partitions.
    """
    checkpoint_dir(df.sparkSession)
    ranked = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    ranked = (ranked.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
              .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranked.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_off") + F.col("_row"))
            .drop("_mid", "_part", "_row", "_off"))


def position_within(df: DataFrame, key: str, order: list[Column], name: str = "seq") -> DataFrame:
    """1-based position of each row inside its ``key`` group, ordered by ``order``.

    Unlike ``row_number().over(partitionBy(key))`` no task ever holds a whole group:
    the global index is computed as above, each group's first index is a partial
    aggregate (one row per key), and the position is the difference.
    """
    indexed = global_index(df, [F.col(key)] + list(order), "_gidx")
    starts = indexed.groupBy(key).agg(F.min("_gidx").alias("_start"))
    return (indexed.join(starts, key)
            .withColumn(name, F.col("_gidx") - F.col("_start") + F.lit(1))
            .drop("_gidx", "_start"))


def ordered_batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Fixed-size batches in a total order (batch = position // size, pos within batch)."""
    with_pos = global_index(df, order, "_p")
    return (with_pos.withColumn("batch", F.floor(F.col("_p") / F.lit(size)).cast("long"))
            .withColumn("pos_in_batch", (F.col("_p") % F.lit(size)).cast("int"))
            .drop("_p"))
