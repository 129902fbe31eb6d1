"""Operational statistics re-expressed as aggregations over the job outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


QUANTILES = ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))


def exact_quantiles(df: DataFrame, group: str, value: str, qs=QUANTILES) -> DataFrame:
    """Exact, linearly interpolated quantiles per group (the definition of SQL's
    ``percentile`` / ``quantile_cont``) without holding a group's values in one task.

    Rows get their 1-based position in (group, value) order from :func:`position_within`
    (a range sort, so a huge group spans many tasks); each quantile q needs only the rows
    at positions ⌊q(n−1)⌋+1 and ⌈q(n−1)⌉+1, which are picked out and interpolated.
    """
    from storytrack.operators.ordering import position_within
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = position_within(df.select(group, value), group, [F.col(value)], "_seq").join(counts, group)
    seq, v = F.col("_seq"), F.col(value).cast("double")
    bounds = []
    for q, name in qs:
        h = (F.col("_n") - 1) * F.lit(q)
        bounds.append((name, F.floor(h) + 1, F.ceil(h) + 1, h - F.floor(h)))
    wanted = F.lit(False)
    for _, lo, hi, _w in bounds:
        wanted = wanted | (seq == lo) | (seq == hi)
    aggs = []
    for name, lo, hi, w in bounds:
        aggs += [F.max(F.when(seq == lo, v)).alias(f"{name}_lo"), F.max(F.when(seq == hi, v)).alias(f"{name}_hi"),
                 F.max(w).alias(f"{name}_w")]
    picked = ranked.filter(wanted).groupBy(group).agg(*aggs)
    return picked.select(group, *[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_w")).alias(n) for n, *_ in bounds])


def exact_quantiles_global(df: DataFrame, value: str, qs=QUANTILES) -> DataFrame:
    """Exact quantiles over all rows (one output row), from global positions.

    The row count enters as a scalar subquery, so nothing is joined on a constant key
    (which the optimiser would turn into a cartesian product).
    """
    from storytrack.operators.ordering import global_index
    n = df.select(F.count(F.lit(1))).scalar()
    ranked = global_index(df.select(value), [F.col(value)], "_idx").withColumn("_n", n)
    idx, v = F.col("_idx"), F.col(value).cast("double")
    bounds = []
    for q, name in qs:
        h = (F.col("_n") - 1) * F.lit(q)
        bounds.append((name, F.floor(h), F.ceil(h), h - F.floor(h)))
    wanted = F.lit(False)
    for _, lo, hi, _w in bounds:
        wanted = wanted | (idx == lo) | (idx == hi)
    picked = ranked.filter(wanted).withColumn("_w", F.lit(0.0))
    aggs = []
    for name, lo, hi, w in bounds:
        aggs += [F.max(F.when(idx == lo, v)).alias(f"{name}_lo"), F.max(F.when(idx == hi, v)).alias(f"{name}_hi"),
                 F.max(F.when(idx == lo, w)).alias(f"{name}_w")]
    out = picked.agg(*aggs)
    return out.select(*[(F.col(f"{n_}_lo") + (F.col(f"{n_}_hi") - F.col(f"{n_}_lo")) * F.col(f"{n_}_w")).alias(n_)
                        for n_, *_ in bounds])


def _quantile_cols(df: DataFrame, group: str, value: str, approx: bool, accuracy: int = 10000):
    """Quantile columns joined onto per-group stats: exact (positions) or approx (sketch)."""
    if approx:
        return df.groupBy(group).agg(
            *[F.percentile_approx(value, q, accuracy).cast("double").alias(n) for q, n in QUANTILES])
    return exact_quantiles(df, group, value)


def discovery_latency(story: DataFrame, approx: bool = False) -> DataFrame:
    """count/min/max/mean/median/p95/p99 of discovered − created (ms), per feed.

    Exact by default (positions in sorted order, see :func:`exact_quantiles`); ``approx``
    switches to a fixed-size sketch per group (one pass, no sort)."""
    ms = (F.unix_millis("discovered_at") - F.unix_millis("created_at")).alias("latency_ms")
    lat = story.select("feed", ms)
    stats = lat.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.min("latency_ms").alias("min_ms"),
                                    F.max("latency_ms").alias("max_ms"), F.avg("latency_ms").alias("mean_ms"))
    return stats.join(_quantile_cols(lat, "feed", "latency_ms", approx), "feed")


def run_counters(*frames: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """(counter, n) of outcome frames, each with its counters' conditions.

    Every frame is read once and reduced to one row of counts (partial aggregates) before
    the union, so nothing but counts is shuffled.
    """
    parts = []
    for df, counters in frames:
        sums = df.agg(*[F.count_if(cond).alias(name) for name, cond in counters.items()])
        parts.append(sums.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("counter"), F.col(name).alias("n")) for name in counters])).alias("_c"))
            .select("_c.counter", "_c.n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_size_stats(rows: DataFrame, batch_col: str = "tick", approx: bool = False) -> DataFrame:
    """A10: distribution of batch sizes (rows per batch)."""
    sizes = rows.groupBy(batch_col).agg(F.count(F.lit(1)).alias("size"))
    stats = sizes.agg(F.count(F.lit(1)).alias("batches"), F.min("size").alias("min_size"),
                      F.max("size").alias("max_size"), F.avg("size").alias("mean_size"))
    if approx:
        q = sizes.agg(*[F.percentile_approx("size", p, 10000).cast("double").alias(n) for p, n in QUANTILES])
    else:
        q = exact_quantiles_global(sizes, "size")
    # The one-row result attaches as a single scalar subquery (no join on a constant key).
    qs = q.select(F.struct(*[F.col(n) for _, n in QUANTILES])).scalar()
    with_q = stats.select("*", qs.alias("_q"))
    return with_q.select(*stats.columns, *[F.col("_q")[n].alias(n) for _, n in QUANTILES])


def event_rate(rows: DataFrame, ts_col: str = "seen_at", minutes: int = 1) -> DataFrame:
    """Events per tumbling window and the per-second rate over the window."""
    dur = f"{minutes} minute" if minutes == 1 else f"{minutes} minutes"
    return (rows.groupBy(F.window(ts_col, dur).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                    (F.col("n") / F.lit(60.0 * minutes)).alias("rate_per_s")))
