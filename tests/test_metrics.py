import random

import numpy as np
from pyspark.sql import functions as F

from conftest import ts
from storytrack.operators import metrics as MET


def test_exact_quantiles_match_numpy_with_hot_group(spark):
    rnd = random.Random(11)
    rows = [("hot" if i % 3 else f"g{i % 5}", rnd.randint(-50, 5000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: (r.p50, r.p95, r.p99) for r in MET.exact_quantiles(df, "g", "v").collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g], dtype=float)
        expect = tuple(float(np.quantile(vals, q)) for q in (0.5, 0.95, 0.99))
        assert np.allclose(got[g], expect), g


def test_latency_exact_and_approx(spark):
    t0 = ts("2020-01-01 00:00:00")
    import datetime as dt
    rows = [("new" if i % 2 else "hot", t0, t0 + dt.timedelta(seconds=i)) for i in range(101)]
    df = spark.createDataFrame(rows, "feed string, created_at timestamp, discovered_at timestamp")
    ex = {r.feed: r for r in MET.discovery_latency(df).collect()}
    assert ex["hot"].n == 51 and ex["hot"].min_ms == 0 and ex["hot"].p50 == 50000.0
    ap = {r.feed: r for r in MET.discovery_latency(df, approx=True).collect()}
    assert abs(ap["hot"].p50 - 50000.0) <= 2000.0


def test_rates_and_batches(spark):
    t0 = ts("2020-01-01 00:00:00")
    import datetime as dt
    rows = [(t0 + dt.timedelta(seconds=20 * i), t0 + dt.timedelta(days=i // 10)) for i in range(30)]
    df = spark.createDataFrame(rows, "seen_at timestamp, tick timestamp")
    r1 = {r.window_start: r.n for r in MET.event_rate(df, "seen_at", 1).collect()}
    assert r1[t0] == 3 and sum(r1.values()) == 30
    b = MET.batch_size_stats(df, "tick").first()
    assert (b.batches, b.min_size, b.max_size, b.p50) == (3, 10, 10, 10.0)
    c = {r.counter: r.n for r in MET.run_counters((df, {"a": F.lit(True), "c": F.lit(False)}),
                                                     (df.limit(0), {"b": F.lit(True)})).collect()}
    assert c == {"a": 30, "b": 0, "c": 0}


def test_global_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    vals = [rnd.randint(0, 1000) for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    r = MET.exact_quantiles_global(df, "v").first()
    assert np.allclose((r.p50, r.p95, r.p99), [np.quantile(np.array(vals, float), q) for q in (0.5, 0.95, 0.99)])
