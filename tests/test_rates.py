"""Moving-average rates against the plain meter, tick by tick."""

import datetime as dt
import math
import random
from collections import Counter

import pytest

from conftest import ts
from storytrack.operators import rates as R

T0 = ts("2020-01-01 00:00:00")


def meter(times, minutes, tick_s=5):
    """The meter as it runs: every tick moves the average, empty ones too."""
    epoch = dt.datetime(1970, 1, 1)
    ticks = Counter(int((t - epoch).total_seconds() // tick_s) for t in times)
    alpha, rate, out = 1 - math.exp(-tick_s / 60 / minutes), None, {}
    for k in range(min(ticks), max(ticks) + 1):
        now = ticks.get(k, 0) / tick_s
        rate = now if rate is None else rate + alpha * (now - rate)
        if k in ticks:
            out[epoch + dt.timedelta(seconds=(k + 1) * tick_s)] = rate
    return out


def events(seed, spread_s, n):
    rng = random.Random(seed)
    rows = [("a", T0 + dt.timedelta(seconds=rng.random() * spread_s)) for _ in range(n)]
    rows += [("b", T0 + dt.timedelta(seconds=7200 + rng.random() * 60)) for _ in range(n)]  # a burst
    return rows + [("c", T0), (None, T0 + dt.timedelta(hours=30)), (None, T0), ("a", None)]


@pytest.mark.parametrize("block, spread", [(4, 3000), (16, 20_000), (256, 90_000)])
def test_rates_equal_the_meter(spark, block, spread):
    """Small blocks need several levels; gaps, bursts, single events and a null group."""
    rows = events(block, spread, 300)
    df = spark.createDataFrame(rows, "feed string, seen_at timestamp").repartition(5)
    got = R.moving_rates(df, minutes=(1, 5, 15), block=block).collect()
    for m in (1, 5, 15):
        for feed in ("a", "b", "c", None):
            want = meter([t for f, t in rows if f == feed and t], m)
            have = {r.tick_end: r[f"rate_{m}m"] for r in got if r.feed == feed}
            assert have.keys() == want.keys()
            assert all(math.isclose(have[t], want[t], rel_tol=1e-9, abs_tol=1e-300) for t in want)


def test_rates_fade_after_the_last_tick(spark):
    df = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(seconds=11))], "feed string, seen_at timestamp")
    rates = R.moving_rates(df)
    last = max(rates.collect(), key=lambda r: r.tick_end)
    now = R.rates_at(rates, last.tick_end + dt.timedelta(seconds=62)).first()
    assert math.isclose(now.rate_1m, last.rate_1m * math.exp(-1)) and math.isclose(now.rate_5m, last.rate_5m * math.exp(-0.2))
    early = R.rates_at(rates, T0 + dt.timedelta(seconds=5)).first()
    assert early.rate_1m == 0.2  # the first tick sets the rate


def test_no_events(spark):
    df = spark.createDataFrame([], "feed string, seen_at timestamp")
    assert R.moving_rates(df).collect() == []


def test_a_block_is_the_largest_window_partition(spark):
    """Every window of the plan is partitioned by group and block."""
    df = spark.createDataFrame(events(1, 5000, 50), "feed string, seen_at timestamp")
    plan = R.moving_rates(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("_block" in x for x in windows)
