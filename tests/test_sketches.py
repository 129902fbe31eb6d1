"""Stored sketches and decaying reservoirs."""

import datetime as dt
import hashlib
import math
import random

from pyspark.sql import functions as F

from conftest import ts
from storytrack.operators import sketches as SK

T0 = ts("2020-01-01 00:00:00")


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, "hot" if i % 3 else "new", T0 + dt.timedelta(seconds=rng.randrange(4 * 86400)), rng.randrange(10**6))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, feed string, at timestamp, v long").repartition(6)


def test_merged_sketches_are_within_the_rank_error(spark, tmp_path):
    """Days stored by separate runs, one of them twice as two halves, merge to the whole."""
    rows = rows_of(20_000)
    df = frame(spark, rows)
    cut = F.col("id") < 7000
    for run, part in enumerate((df.filter(cut), df.filter(~cut))):
        SK.daily_sketches(part, F.col("v"), "at").write.parquet(str(tmp_path / f"run={run}"))
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == 2 * 2 * 4  # feeds, days, runs: never rows
    for r in SK.merged_quantiles(stored).collect():
        vals = sorted(v for _, f, _, v in rows if f == r.feed)
        assert (r.n, r.min, r.max) == (len(vals), vals[0], vals[-1])
        assert math.isclose(r["mean"], sum(vals) / len(vals))
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            rank = sum(v <= r[name] for v in vals) / len(vals)
            assert abs(rank - q) < 0.01


def test_sketches_of_nulls_and_nothing(spark):
    df = frame(spark, [(1, "hot", T0, None), (2, "hot", T0, 5), (3, None, T0, 7)])
    got = {r.feed: (r.n, r.p50) for r in SK.merged_quantiles(SK.daily_sketches(df, F.col("v"), "at")).collect()}
    assert got == {"hot": (1, 5.0), None: (1, 7.0)}
    assert SK.merged_quantiles(SK.daily_sketches(df.limit(0), F.col("v"), "at")).collect() == []


def plain_reservoir(rows, size, alpha):
    """Priority sample: the largest weight / u, with exact exponents kept as logarithms."""
    def priority(i, at):
        u = (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return (at - dt.datetime(1970, 1, 1)).total_seconds() * alpha - math.log(u)
    out = {}
    for feed in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == feed), key=lambda r: (-priority(r[0], r[2]), r[0]))
        out[feed] = [(r[0], r[3]) for r in own[:size]]
    return out


def test_reservoir_equals_a_plain_priority_sample(spark):
    rows = rows_of(3000)
    for alpha in (1e-5, SK.ALPHA):
        whole = SK.decaying_reservoir(frame(spark, rows), F.col("v"), "at", "id", size=100, alpha=alpha)
        got = {}
        for r in whole.orderBy("feed", "rank").collect():
            got.setdefault(r.feed, []).append((r.id, r.value))
        assert got == plain_reservoir(rows, 100, alpha)
        df = frame(spark, rows)
        parts = [SK.decaying_reservoir(df.filter(F.col("id") % 3 == k), F.col("v"), "at", "id", size=100, alpha=alpha)
                 for k in range(3)]
        key = F.struct("feed", "id", "rank")
        assert set(SK.merge_reservoirs(*parts, size=100).select(key).collect()) == set(whole.select(key).collect())


def test_reservoir_quantiles_favour_recent_values(spark):
    rows = [(i, "hot", T0 + dt.timedelta(seconds=i), i) for i in range(1000)]
    sample = SK.decaying_reservoir(frame(spark, rows), F.col("v"), "at", "id", size=1000)
    got = SK.reservoir_quantiles(sample).first()
    weights = [math.exp(SK.ALPHA * (i - 999)) for i in range(1000)]
    assert got.n == 1000 and math.isclose(got["mean"], sum(w * i for i, w in enumerate(weights)) / sum(weights))
    upto, share = 0.0, {}
    for i, w in enumerate(weights):
        upto += w / sum(weights)
        for q in (0.5, 0.95, 0.99):
            if upto >= q:
                share.setdefault(q, i)
    assert [got.p50, got.p95, got.p99] == [share[0.5], share[0.95], share[0.99]]


def test_reservoir_cuts_off_later_rows_and_nulls(spark):
    rows = [(1, "hot", T0, 5), (2, "hot", T0 + dt.timedelta(days=1), 6), (3, "hot", None, 7), (4, "hot", T0, None)]
    got = SK.decaying_reservoir(frame(spark, rows), F.col("v"), "at", "id", as_of=T0).collect()
    assert [(r.id, r["rank"]) for r in got] == [(1, 1)]
