"""Streams on Spark's own state against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF, ts
from storytrack.operators import merge as M
from storytrack.sources import payload as P
from storytrack.sources import tables as T
from storytrack.streaming import jobs as STR
from storytrack.streaming import native as N
from storytrack.streaming.landing import land_in_order

T0 = ts("2020-01-01 00:00:00")
DAY = dt.timedelta(days=1)


def pages(spark):
    return T.landed_listing_pages(spark, SF).select("feed", "page", "tick", "value")


@pytest.mark.parametrize("track_days", [3, 40])
def test_sightings_equal_the_table_stream_where_the_rules_agree(spark, tmp_path, track_days):
    """In 40 days, more than the input has, no story comes back; in 3, some are held back longer."""
    root = str(tmp_path)
    land_in_order(pages(spark), f"{root}/landing", "tick", "json", steps_per_file=1)
    track = track_days * 86400
    STR.await_done(N.sightings_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/cp", track, max_files=1))
    got = [(r.short_id, r.tick) for r in spark.read.parquet(f"{root}/out").collect()]
    assert len(got) == len(set(got))
    ticks = {}
    for r in P.parse_story_pages(pages(spark)).select("short_id", "tick").distinct().collect():
        ticks.setdefault(r.short_id, []).append(r.tick)
    found = {}
    for s, t in got:
        found.setdefault(s, []).append(t)
    for s, seen in ticks.items():
        seen, plain = sorted(seen), []
        for t in seen:
            if not plain or t >= plain[-1] + dt.timedelta(seconds=track):
                plain.append(t)
        mine = sorted(found[s])
        assert mine[0] == seen[0] and set(mine) <= set(seen)
        assert all(b - a >= dt.timedelta(seconds=track) for a, b in zip(mine, mine[1:], strict=False))
        if len(plain) == 1:  # the story stays away for less than the tracking time, or for good
            assert mine == plain
        assert track_days < 40 or len(plain) == 1


def test_union_of_feeds_that_land_apart(spark, tmp_path):
    """The new feed lands in steps of another size; two late scrapes end the input."""
    root, every = str(tmp_path), pages(spark)
    last = every.agg(F.max("tick")).first()[0]
    ends = [every.filter(F.col("tick") == last).withColumn("tick", F.lit(last + k * 4 * DAY)) for k in (1, 2)]
    for feed, step in (("hot", 3), ("new", 5)):
        land_in_order(every.filter(F.col("feed") == feed), f"{root}/{feed}", "tick", "json", steps_per_file=step, prefix="data")
        for k, end in enumerate(ends):
            land_in_order(end.withColumn("feed", F.lit(feed)), f"{root}/{feed}", "tick", "json", prefix=f"end{k}")
    STR.await_done(N.union_stream(spark, f"{root}/hot", f"{root}/new", f"{root}/out", f"{root}/cp", max_files=1))
    out = spark.read.parquet(f"{root}/out").filter(F.col("tick") <= F.lit(last))
    want = M.union_feeds(P.parse_story_pages(every.filter(F.col("feed").isin("hot", "new"))).drop("before", "after", "kind"))
    columns = ["tick", "short_id", "feed", "page", "pos", "in_new", "score"]
    assert sorted(out.select(columns).collect()) == sorted(want.select(columns).collect())
    assert out.filter("feed = 'hot' and in_new").count() > 0


def land(df, folder, step):
    land_in_order(df, folder, step, "parquet")


def test_samples_meet_their_stories(spark, tmp_path):
    root, hour = str(tmp_path), dt.timedelta(hours=1)
    stories = [(i, T0 + i * 5 * hour, f"t{i}") for i in range(20)]
    samples = [(i, T0 + i * 5 * hour + k * 20 * hour, k) for i in range(22) for k in range(4)]  # k = 3 is outside
    far = T0 + 30 * DAY
    s = spark.createDataFrame([*stories, (900, far, "end"), (901, far + 9 * DAY, "end")], "id long, created_at timestamp, title string")
    h = spark.createDataFrame([*samples, (900, far, 0), (901, far + 9 * DAY, 0)], "story long, timestamp timestamp, score int")
    land(s, f"{root}/stories", "created_at")
    land(h, f"{root}/samples", "timestamp")
    STR.await_done(N.samples_with_stories(spark, f"{root}/samples", h.schema, f"{root}/stories", s.schema, f"{root}/out",
                                          f"{root}/cp", max_files=6))
    got = spark.read.parquet(f"{root}/out").filter("story < 900")
    inside = {(i, t, k): f"t{i}" for i, t, k in samples if i < 20 and k < 3}
    assert sorted((r.story, r.timestamp, r.score, r.title or "") for r in got.collect()) == sorted(
        (i, t, k, inside.get((i, t, k), "")) for i, t, k in samples)


def test_stories_get_the_last_community_sample(spark, tmp_path):
    root, hour = str(tmp_path), dt.timedelta(hours=1)
    stories = [(i, i % 3, T0 + i * 3 * hour) for i in range(30)]
    samples = [(100 + i, T0 + (i * 7 // 2) * hour, i % 2, i, i + 1) for i in range(25)]  # community 2 has none
    far = T0 + 30 * DAY
    s = spark.createDataFrame([*stories, (900, 9, far), (901, 9, far + DAY)], "id long, subreddit long, created_at timestamp")
    h = spark.createDataFrame([*samples, (900, far, 9, 0, 0), (901, far + DAY, 9, 0, 0)],
                              "id long, timestamp timestamp, subreddit long, subscribers long, active int")
    land(s, f"{root}/stories", "created_at")
    land(h, f"{root}/samples", "timestamp")
    within = 10 * 3600
    STR.await_done(N.stories_with_context(spark, f"{root}/stories", s.schema, f"{root}/samples", h.schema, f"{root}/out",
                                          f"{root}/cp", within, max_files=8))
    got = {r.id: r["sample"] for r in spark.read.parquet(f"{root}/out").filter("id < 900").collect()}
    want = {}
    for i, sub, at in stories:
        near = [(t, k) for k, t, c, *_ in samples if c == sub and dt.timedelta(0) <= at - t <= dt.timedelta(seconds=within)]
        want[i] = max(near)[1] if near else None
    assert got == want and None in want.values()
