"""Backward as-of join: for each probe, the latest history row of the same key strictly
before the probe time, else (optionally) the key's first-ever row.

Spark has no public as-of join, and ``Window.partitionBy(key)`` would put a hot key —
one community with a third of all samples — into a single task. This version keeps
every window bounded:

1. Probes and history rows are unioned and given a global position in
   (key, time, probe-before-history, tie) order (:func:`global_index`; the range sort
   splits a hot key across tasks).
2. Positions are cut into blocks of ``block_rows``; inside a block, a forward fill
   (``last(…, ignorenulls)`` over a block-partitioned window) finds the latest history
   row before each probe. Windows never exceed ``block_rows`` rows.
3. For probes whose block holds no earlier history row, the carry is the last history
   row of all earlier blocks (a window over one row per block). Because keys are
   contiguous in the order, that row belongs to the probe's key iff the key has any
   earlier history.
4. The first-ever row per key (a partial aggregate) is the fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storytrack.operators.ordering import global_index

DEFAULT_BLOCK_ROWS = 4_000_000


def asof_backward(probes: DataFrame, history: DataFrame, key: str, probe_ts: str, hist_ts: str,
                  probe_id: str, hist_tie: str, hist_cols: list[str], fallback_first: bool = True,
                  block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Attach ``h_<col>`` for each of ``hist_cols`` (plus ``h_<hist_ts>``) and ``match``
    ('before' | 'first' | NULL) to every probe row. ``probe_id`` / ``hist_tie`` make the
    order total; probe columns pass through unchanged."""
    carried = [hist_ts, hist_tie] + [c for c in hist_cols if c not in (hist_ts, hist_tie)]
    h_struct = F.struct(F.col(key).alias("_key"), *[F.col(c).alias(c) for c in carried])
    null_h = F.lit(None).cast(history.select(h_struct.alias("h")).schema["h"].dataType)
    p_side = probes.select(F.col(key).alias("_key"), F.col(probe_ts).alias("_t"), F.lit(0).alias("_k"),
                           F.col(probe_id).cast("long").alias("_o"), F.col(probe_id).alias("_pid"),
                           null_h.alias("_h"))
    h_side = history.select(F.col(key).alias("_key"), F.col(hist_ts).alias("_t"), F.lit(1).alias("_k"),
                            F.col(hist_tie).cast("long").alias("_o"),
                            F.lit(None).cast(probes.schema[probe_id].dataType).alias("_pid"),
                            h_struct.alias("_h"))
    both = global_index(p_side.unionByName(h_side),
                        [F.col("_key"), F.col("_t"), F.col("_k"), F.col("_o")], "_idx")
    both = both.withColumn("_blk", F.floor(F.col("_idx") / F.lit(block_rows)).cast("long"))

    # (2) forward fill inside each block
    w = Window.partitionBy("_blk").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    filled = both.withColumn("_prev", F.last("_h", ignorenulls=True).over(w)).filter(F.col("_k") == 0)

    # (3) last history row of all earlier blocks (one row per block)
    tails = both.groupBy("_blk").agg(F.max_by("_h", F.when(F.col("_k") == 1, F.col("_idx"))).alias("_tail"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_blk", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))

    j = filled.join(carry, "_blk", "left")

    def same(c):  # a carried history row that belongs to the probe's own key
        return c.isNotNull() & (c["_key"] == F.col("_key"))

    match_h = F.when(F.col("_prev").isNotNull(),
                     F.when(same(F.col("_prev")), F.col("_prev"))).otherwise(
        F.when(same(F.col("_carry")), F.col("_carry")))
    found = j.select("_pid", "_key", match_h.alias("_m"))

    if fallback_first:
        firsts = history.groupBy(F.col(key).alias("_key")).agg(
            F.min_by(h_struct, F.struct(F.col(hist_ts), F.col(hist_tie))).alias("_first"))
        found = found.join(firsts, "_key", "left").select("_pid", F.col("_m"), F.col("_first"))
    else:
        found = found.select("_pid", "_m", F.lit(None).cast(found.schema["_m"].dataType).alias("_first"))

    chosen = F.coalesce(F.col("_m"), F.col("_first"))
    out = probes.join(found.withColumnRenamed("_pid", probe_id), probe_id, "left")
    return out.select(
        *[F.col(c) for c in probes.columns],
        *[chosen[c].alias("h_" + c) for c in carried],
        F.when(F.col("_m").isNotNull(), F.lit("before"))
        .when(F.col("_first").isNotNull(), F.lit("first")).alias("match"))


SUB_STATS = ["subscribers", "active", "comment_hide_mins"]


def _sub_history(sub_history: DataFrame) -> DataFrame:
    return sub_history.select(F.col("subreddit").alias("subreddit_key"), "timestamp",
                              F.col("id").alias("hist_id"), *SUB_STATS)


def asof_subreddit_history(subreddit: DataFrame, sub_history: DataFrame, at) -> DataFrame:
    """Each community's last sample strictly before ``at`` (one time for all), else its
    first sample ever. One partial aggregate over the history and one join."""
    hist = _sub_history(sub_history)
    sample = F.struct(*[F.col(c) for c in ["timestamp", "hist_id", *SUB_STATS]])
    order = F.struct("timestamp", "hist_id")
    found = hist.groupBy(F.col("subreddit_key").alias("id")).agg(
        F.max_by(sample, F.when(F.col("timestamp") < at, order)).alias("_m"),
        F.min_by(sample, order).alias("_first"))
    chosen = F.coalesce("_m", "_first")
    return subreddit.select("id").join(found, "id", "left").select(
        "id", *[chosen[c].alias("h_" + c) for c in ["timestamp", "hist_id", *SUB_STATS]],
        F.when(F.col("_m").isNotNull(), F.lit("before"))
        .when(F.col("_first").isNotNull(), F.lit("first")).alias("match"))


def asof_story_context(story: DataFrame, sub_history: DataFrame) -> DataFrame:
    """Every story with its community's stats as they stood before it was created."""
    probes = story.select("id", F.col("subreddit").alias("subreddit_key"), "created_at")
    return asof_backward(probes, _sub_history(sub_history), key="subreddit_key", probe_ts="created_at",
                         hist_ts="timestamp", probe_id="id", hist_tie="hist_id", hist_cols=SUB_STATS)
