"""Distributions as stored sketches that merge, and as samples that favour recent values.

A run stores one quantile sketch per (group, day) instead of keeping its rows: later reports
merge the sketches of the days they cover and never read rows again. A decaying reservoir is a
weighted sample in which a value's weight grows by ``exp(ALPHA)`` per second of its time; it
is the ``RESERVOIR`` rows with the largest priorities, drawn from a hash of each row's id, so
it is the same in every run, can be topped up from another reservoir, and never depends on how
rows are dealt out. Exact forms are in :mod:`storytrack.operators.metrics`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storytrack.functions import scalars as X
from storytrack.operators.metrics import QUANTILES

SKETCH_K = 1000  # rank error of a merged sketch about 0.3 % (bytes grow with it, not with rows)
RESERVOIR = 1028
ALPHA = 0.015  # per second


def latency_ms() -> Column:
    return F.unix_millis("discovered_at") - F.unix_millis("created_at")


def daily_sketches(rows: DataFrame, value: Column, ts_col: str, group: str = "feed", k: int = SKETCH_K) -> DataFrame:
    """(group, day, n, min, max, total, sketch): one row for each group and day of ``ts_col``.

    Sketches are partial aggregates: a task sends one binary for each group and day it saw.
    Null values are not counted.
    """
    held = rows.select(F.col(group), F.to_date(F.col(ts_col)).alias("day"), value.cast("long").alias("_v"))
    return held.filter(F.col("_v").isNotNull()).groupBy(group, "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.sum("_v").alias("total"),
        F.kll_sketch_agg_bigint("_v", F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, group: str = "feed", qs=QUANTILES) -> DataFrame:
    """(group, n, min, max, mean, p50 …) of stored sketches: reads one row per group and day."""
    merged = sketches.groupBy(group).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("_total"),
        F.kll_merge_agg_bigint("sketch").alias("_s"))
    return merged.select(group, "n", "min", "max", (F.col("_total") / F.col("n")).alias("mean"), *[
        F.kll_sketch_get_quantile_bigint("_s", F.lit(q)).cast("double").alias(name) for q, name in qs])


def uniform(ident: Column) -> Column:
    """A number in (0, 1) from an id, the same in every engine: 52 bits of its MD5 digest."""
    return (F.conv(F.substring(F.md5(ident.cast("string").cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def decaying_reservoir(rows: DataFrame, value: Column, ts_col: str, id_col: str, group: str = "feed",
                       as_of=None, size: int = RESERVOIR, alpha: float = ALPHA) -> DataFrame:
    """(group, id, at, value, priority, rank): the ``size`` rows of each group with the largest priorities.

    The priority is ``alpha * seconds - ln(u)`` with u from the row's id: the logarithm of the
    row's weight over u, which never overflows and needs no rescaling. ``as_of`` cuts off
    later rows. The row_number filter keeps ``size`` rows of a group in every task before the
    shuffle, however many rows the group has; ties go to the smaller id.
    """
    held = rows.select(F.col(group), F.col(id_col).alias("id"), F.col(ts_col).alias("at"), value.alias("value"))
    held = held.filter(F.col("at").isNotNull() & F.col("value").isNotNull())
    if as_of is not None:
        held = held.filter(F.col("at") <= X.as_ts(as_of))
    priority = F.unix_micros("at") / F.lit(1e6) * F.lit(alpha) - F.log(uniform(F.col("id")))
    return merge_reservoirs(held.withColumn("priority", priority), group=group, size=size)


def merge_reservoirs(*samples: DataFrame, group: str = "feed", size: int = RESERVOIR) -> DataFrame:
    """The reservoir of all rows that the given ones (of disjoint rows) were drawn from."""
    rows = samples[0].drop("rank")
    for more in samples[1:]:
        rows = rows.unionByName(more.drop("rank"))
    order = Window.partitionBy(group).orderBy(F.col("priority").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def reservoir_quantiles(sample: DataFrame, group: str = "feed", alpha: float = ALPHA, qs=QUANTILES) -> DataFrame:
    """(group, n, mean, p50 …) of a reservoir, its values weighted by their age.

    A quantile is the smallest value at which the weights add up to its share. Weights are
    relative to the group's newest row, so they lie in (0, 1]; a group has ``size`` rows at most.
    """
    newest = F.max("at").over(Window.partitionBy(group))
    aged = sample.withColumn("_w", F.exp((F.unix_micros("at") - F.unix_micros(newest)) / F.lit(1e6) * F.lit(alpha)))
    order = Window.partitionBy(group).orderBy("value", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_w").over(Window.partitionBy(group))
    held = aged.withColumn("_share", F.sum("_w").over(order) / total)
    return held.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("mean"),
        *[F.coalesce(F.min(F.when(F.col("_share") >= q, F.col("value"))), F.max("value")).cast("double").alias(name)
          for q, name in qs])
