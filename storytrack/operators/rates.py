"""Moving-average event rates, as a scan over blocks of ticks.

A meter keeps, for a period of m minutes, the average that is moved at every tick of 5
seconds by ``alpha * (count / 5 - rate)`` with ``alpha = 1 - exp(-5 / (60 * m))``; its first
tick sets the rate. Written out, the rate at a tick is the sum of all former ticks' terms,
each decayed by ``q = exp(-5 / (60 * m))`` per tick since then. Such sums are associative: a
stretch of ticks is a pair (decay over it, sum at its end), and the pairs of neighbouring
stretches combine. So ticks are cut into blocks of ``BLOCK``; a block is scanned in
log2(BLOCK) steps inside one window partition that is never larger than a block; the blocks'
ends are the ticks of the next level, and what a level finds is carried back into its blocks.
No task ever holds a group's whole time line, and empty ticks cost nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storytrack.functions import scalars as X

TICK_S = 5
BLOCK = 256  # ticks of a block; a power of two


def decayed_sums(rows: DataFrame, group: str, place: str, value: str, log_decay: float, span: int,
                 block: int = BLOCK) -> DataFrame:
    """``rows`` with _sum and _before: sums of the group's values, decayed by ``exp(log_decay)`` per place.

    ``_sum`` is taken at the row's place, its own value included, ``_before`` one place
    earlier. One row per (group, place); places are whole numbers from 0 to ``span``.
    """
    start = F.col("_block") * block
    held = rows.withColumn("_block", F.floor(F.col(place) / block).cast("long"))
    inside = Window.partitionBy(group, "_block").orderBy(place)

    def fade(places):
        return F.exp(places * F.lit(log_decay))

    # Doubling: after the step k, _s sums the 2 * k rows up to this one.
    held, k = held.withColumn("_s", F.col(value).cast("double")), 1
    while k < block:
        held = held.withColumn("_s", F.col("_s") + F.coalesce(
            F.lag("_s", k).over(inside) * fade(F.col(place) - F.lag(place, k).over(inside)), F.lit(0.0)))
        k *= 2
    held = held.withColumn("_p", F.coalesce(F.lag("_s").over(inside) * fade(
        F.col(place) - F.lag(place).over(inside) - 1), F.lit(0.0)))
    if span < block:
        return held.withColumnsRenamed({"_s": "_sum", "_p": "_before"}).drop("_block")
    last = F.max_by(F.struct("_s", F.col(place).alias("_at")), place)
    ends = (held.groupBy(group, "_block").agg(last.alias("_e"))
            .select(group, F.col("_block").alias("_place"),
                    (F.col("_e._s") * fade(start + (block - 1) - F.col("_e._at"))).alias("_value")))
    above = decayed_sums(ends, group, "_place", "_value", log_decay * block, span // block, block)
    carry = above.select(F.col(group).alias("_group"), F.col("_place").alias("_of"), F.col("_before").alias("_carry"))
    # The carry stands at the end of the block before: one place before this block's first.
    joined = held.join(carry, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of")))
    return (joined.withColumn("_sum", F.col("_s") + F.col("_carry") * fade(F.col(place) - start + 1))
            .withColumn("_before", F.col("_p") + F.col("_carry") * fade(F.col(place) - start))
            .drop("_block", "_s", "_p", "_group", "_of", "_carry"))


def moving_rates(rows: DataFrame, ts_col: str = "seen_at", group: str = "feed", minutes: tuple[int, ...] = (1, 5),
                 tick_s: int = TICK_S, block: int = BLOCK) -> DataFrame:
    """(group, tick_end, n, rate_<m>m …): the moving averages per second at every tick that has events.

    Ticks are aligned to the epoch. A null group is a group of its own; null times count
    nowhere. Between two ticks a rate only fades, see :func:`rates_at`.
    """
    tick = F.floor(F.unix_micros(F.col(ts_col)) / F.lit(tick_s * 1_000_000)).cast("long")
    counts = (rows.filter(F.col(ts_col).isNotNull()).select(F.col(group), tick.alias("_tick"))
              .groupBy(group, "_tick").agg(F.count(F.lit(1)).alias("n")))
    ends = counts.agg(F.min("_tick").alias("a"), F.max("_tick").alias("b")).first()
    base, span = (ends["a"], ends["b"] - ends["a"]) if ends["a"] is not None else (0, 0)
    first = counts.groupBy(F.col(group).alias("_g")).agg(F.min("_tick").alias("_first"))
    held = (counts.join(first, F.col(group).eqNullSafe(F.col("_g")))
            .select(group, "n", (F.col("_tick") - base).alias("_at"), (F.col("_tick") == F.col("_first")).alias("_is_first")))
    for m in minutes:
        log_decay = -tick_s / (60.0 * m)
        alpha = 1 - math.exp(log_decay)
        term = F.col("n") / F.lit(float(tick_s)) * F.when(F.col("_is_first"), 1.0).otherwise(F.lit(alpha))
        held = (decayed_sums(held.withColumn("_v", term), group, "_at", "_v", log_decay, span, block)
                .withColumnRenamed("_sum", f"rate_{m}m").drop("_v", "_before"))
    end = F.timestamp_seconds((F.col("_at") + base + 1) * tick_s)
    return held.select(group, end.alias("tick_end"), "n", *[f"rate_{m}m" for m in minutes])


def rates_at(rates: DataFrame, as_of, group: str = "feed", tick_s: int = TICK_S) -> DataFrame:
    """(group, rate …) at ``as_of``: the last tick that has ended by then, faded since."""
    now = X.as_ts(as_of)
    names = [c for c in rates.columns if c.startswith("rate_")]
    last = (rates.filter(F.col("tick_end") <= now).groupBy(group)
            .agg(F.max_by(F.struct("tick_end", *names), "tick_end").alias("_r")))
    empty = F.floor((F.unix_micros(now) - F.unix_micros("_r.tick_end")) / F.lit(tick_s * 1_000_000))
    return last.select(group, *[(F.col(f"_r.{c}") * F.exp(empty * F.lit(-tick_s / (60.0 * int(c[5:-1]))))).alias(c)
                                for c in names])
