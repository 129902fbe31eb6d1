import random

from pyspark.sql import functions as F

from conftest import ts
from storytrack.operators.asof import asof_backward


def brute(probes, hist):
    out = {}
    for pid, key, t in probes:
        rows = [h for h in hist if h[0] == key]
        before = [h for h in rows if h[1] < t]
        if before:
            out[pid] = (max(before, key=lambda h: (h[1], h[2]))[2], "before")
        elif rows:
            out[pid] = (min(rows, key=lambda h: (h[1], h[2]))[2], "first")
        else:
            out[pid] = (None, None)
    return out


def test_asof_matches_brute_force_with_hot_key_and_tiny_blocks(spark):
    rnd = random.Random(3)
    base = ts("2020-01-01 00:00:00").timestamp()
    import datetime as dt
    day = lambda d: dt.datetime.fromtimestamp(base + d * 86400, dt.timezone.utc).replace(tzinfo=None)
    hist = []
    for hid in range(400):
        key = 0 if hid % 3 == 0 else rnd.randint(1, 12)           # a third of all rows on key 0
        hist.append((key, day(rnd.randint(0, 30)), hid, rnd.randint(0, 1000)))
    probes = [(pid, 0 if pid % 2 else rnd.randint(0, 14), day(rnd.randint(-2, 33))) for pid in range(150)]
    hdf = spark.createDataFrame(hist, "k long, t timestamp, hid long, v int")
    pdf = spark.createDataFrame(probes, "pid long, k long, pt timestamp")
    out = asof_backward(pdf, hdf, key="k", probe_ts="pt", hist_ts="t", probe_id="pid", hist_tie="hid",
                        hist_cols=["v"], block_rows=37)
    got = {r.pid: (r.h_hid, r.match) for r in out.collect()}
    assert got == brute(probes, [(h[0], h[1], h[2]) for h in hist])


def test_asof_strict_before(spark):
    t = ts("2020-01-01 00:00:00")
    hdf = spark.createDataFrame([(1, t, 1, 5)], "k long, t timestamp, hid long, v int")
    pdf = spark.createDataFrame([(0, 1, t)], "pid long, k long, pt timestamp")
    r = asof_backward(pdf, hdf, "k", "pt", "t", "pid", "hid", ["v"]).first()
    assert (r.h_hid, r.match) == (1, "first")
    r2 = asof_backward(pdf, hdf, "k", "pt", "t", "pid", "hid", ["v"], fallback_first=False).first()
    assert r2.match is None


def test_one_probe_time_equals_brute_force(spark):
    from pyspark.sql import functions as F
    from storytrack.operators.asof import asof_subreddit_history
    rnd = random.Random(8)
    rows = [(i, ts(f"2020-01-{rnd.randint(1, 28):02d} 00:00:00"), 0 if i % 3 == 0 else rnd.randint(1, 9), i, 1, 2)
            for i in range(200)]
    hist = spark.createDataFrame(rows, "id long, timestamp timestamp, subreddit long, subscribers long, active int, "
                                       "comment_hide_mins int")
    subs = spark.createDataFrame([(k,) for k in range(12)], "id long")
    for at in ("2020-01-01 00:00:00", "2020-01-14 00:00:00", "2020-02-01 00:00:00"):
        out = asof_subreddit_history(subs, hist, F.lit(ts(at)))
        got = {r.id: (r.h_hist_id, r.match) for r in out.collect()}
        assert got == brute([(k, k, ts(at)) for k in range(12)], [(r[2], r[1], r[0]) for r in rows])
