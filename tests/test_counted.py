"""Affected rows, counted while tables are written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF, ts
from storytrack.operators import merge as M
from storytrack.plans import catalog, counted, jobs
from storytrack.sources import tables as T

T0 = ts("2020-01-01 00:00:00")


@pytest.fixture()
def out(spark, tmp_path):
    return counted.Counted(spark, str(tmp_path / "run"))


def test_counts_tell_what_was_written(spark, out):
    df = spark.range(10).withColumn("_odd", F.col("id") % 2 == 1).withColumn("_none", F.lit(None).cast("boolean"))
    left = out.write("t", df, drop=F.col("_odd"), odd=F.col("_odd"), every=counted.EVERY(True), none=F.col("_none"))
    assert left.columns == ["id"] and left.count() == 5
    assert out.counts == {"odd": 5, "every": 10, "none": 0}
    out.write("u", df.limit(0), odd=F.col("_odd"))
    assert out.counts["odd"] == 5
    assert {(r.counter, r.n) for r in out.affected().collect()} == {("odd", 5), ("every", 10), ("none", 0)}


def test_deletion_counts_and_tables(spark, out):
    story = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "id long, name string")
    history = spark.createDataFrame([(i % 6, i) for i in range(30)] + [(99, 1)], "story long, score int")
    doomed = spark.createDataFrame([(1,), (1,), (4,), (77,)], "id long")
    made = counted.write_deletion(story, history, doomed, out)
    want = M.delete_stories(story, history, doomed)
    for got, plain in zip((made["story"], made["history"]), want, strict=True):
        assert sorted(got.collect()) == sorted(plain.collect())
    assert out.counts == {"stories_deleted": 2, "samples_cascaded": 10}


def test_subreddit_deletion_counts_every_level(spark, out):
    sub = spark.createDataFrame([(0,), (1,)], "id long")
    sub_history = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "subreddit long, active int")
    story = spark.createDataFrame([(10, 0), (11, 1), (12, 0)], "id long, subreddit long")
    history = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (12, 2)], "story long, score int")
    made = counted.write_subreddit_deletion(sub, sub_history, story, history, spark.createDataFrame([(0,)], "id long"), out)
    assert out.counts == {"subreddits_deleted": 1, "sub_samples_cascaded": 2, "stories_cascaded": 2, "story_samples_cascaded": 3}
    assert [sorted(map(tuple, made[k].collect())) for k in ("subreddit", "sub_history", "story", "history")] == [
        [(1,)], [(1, 3)], [(11, 1)], [(11, 1)]]


def test_discovery_writes_what_it_counts(spark, out):
    story, sub = T.stories(spark, SF), T.subreddits(spark, SF)
    found = jobs.discovery(T.landed_listing_pages(spark, SF), story, sub)
    made = counted.write_discovery(found, story, out)
    c = out.counts
    assert made["new_stories"].count() == c["discovered"] == c["first_samples"]
    assert made["samples"].count() == c["samples_appended"] == c["auto_updated"] + c["first_samples"] + c["later_samples"]
    assert made["samples"].columns == found.samples.columns
    before = {r.id: r.updated_at for r in story.select("id", "updated_at").collect()}
    after = made["story"].select("id", "updated_at").collect()
    assert len(after) == len(before) and sum(r.updated_at > before[r.id] for r in after) <= c["stories_refreshed"]
    assert c["stories_refreshed"] > 0


def test_update_counts_both_branches(spark, out):
    story, done = catalog._update_from(spark, SF)
    counted.write_update(story, done, out, catalog.UPD_AS_OF)
    by = {r.outcome: r["count"] for r in done.outcomes.groupBy("outcome").count().collect()}
    assert out.counts["stories_updated"] == out.counts["update_samples"] == by.get("updated", 0)
    assert out.counts["stories_checked_only"] == by.get("checked", 0)


def test_discovery_without_communities_is_an_error(spark):
    sub = T.subreddits(spark, SF)
    with pytest.raises(ValueError, match="nothing to scrape for"):
        jobs.discovery(T.landed_listing_pages(spark, SF), T.stories(spark, SF), sub.limit(0))
    with pytest.raises(ValueError, match="nothing to scrape for"):
        jobs.discovery(T.landed_listing_pages(spark, SF), T.stories(spark, SF), sub, dt.datetime(2030, 1, 1))
