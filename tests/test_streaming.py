import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF, ts
from storytrack.plans import catalog, jobs
from storytrack.session import AS_OF
from storytrack.sources import archive as A
from storytrack.sources import tables as T
from storytrack.streaming import jobs as STR
from storytrack.streaming.landing import land_in_order, landings


def test_stream_discovery_equals_batch(spark):
    batch = jobs.discovery(T.landed_listing_pages(spark, SF), T.stories(spark, SF), T.subreddits(spark, SF), AS_OF)
    root = A.scratch_path(spark, "t-stream")
    land_in_order(T.landed_listing_pages(spark, SF), f"{root}/landing", "tick", "json", steps_per_file=4)
    q = STR.discovery_stream(spark, f"{root}/landing", T.stories(spark, SF), T.subreddits(spark, SF),
                             f"{root}/out", f"{root}/ck", as_of=AS_OF, max_files=1)
    STR.await_done(q)
    cols = ["story", "timestamp", "score", "comments", "gilded"]
    s = spark.read.parquet(f"{root}/out/samples").select(*cols)
    b = batch.samples.select(*cols)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
    n = spark.read.parquet(f"{root}/out/new_stories").select("id", "reddit_short_id")
    assert n.exceptAll(batch.new_stories.select("id", "reddit_short_id")).count() == 0
    # A replayed run from the same checkpoint processes nothing new.
    STR.await_done(STR.discovery_stream(spark, f"{root}/landing", T.stories(spark, SF), T.subreddits(spark, SF),
                                        f"{root}/out", f"{root}/ck", as_of=AS_OF, max_files=1))
    assert spark.read.parquet(f"{root}/out/samples").count() == b.count()


SAMPLE = ("story long, timestamp timestamp, tie1 long, score int, comments int, gilded int, "
          "created_at timestamp, step int")
STORY = ("id long, reddit_short_id string, subreddit long, title string, author string, url string, permalink string, "
         "domain string, thumbnail string, distinguished string, over18 boolean, is_self boolean, selftext string, "
         "stickied boolean, created_at timestamp, score int, hotness double, comments int, gilded int, "
         "discovered_at timestamp")
H1 = dt.timedelta(hours=1)


def a_story(i, created):
    return (i, str(i), 1, "t", None, "u", "p", "d", None, None, False, False, None, False, created, 5, 1.0, 0, 0, created)


def run_archive(spark, rows, story, delay_s=3600, files=1):
    root = A.scratch_path(spark, "t-expiry")
    df = spark.createDataFrame(rows, SAMPLE)
    land_in_order(df, f"{root}/landing", "step", "parquet")
    sub = spark.createDataFrame([(1, "news")], "id long, name string")
    STR.await_done(STR.archive_stream(spark, f"{root}/landing", df.schema, f"{root}/out", f"{root}/ck",
                                      story=story, subreddit=sub, delay_s=delay_s, max_files=files))
    recs = {int(r.summary.id): r.history.score for r in
            A.read_archive(spark, f"{root}/out/archive", batched=True).collect()}
    late = sorted((r.story, r.score, r.reason) for r in spark.read.parquet(f"{root}/out/late").collect())
    return recs, late


def test_expiry_archives_every_closed_story_once(spark):
    c1, c2 = ts("2020-01-01 00:00:00"), ts("2020-01-01 12:00:00")
    rows = [
        (1, c1 + H1, 1, 10, 0, 0, c1, 0), (2, c2 + H1, 1, 20, 0, 0, c2, 0),
        (1, c1 + 30 * H1, 2, 11, 0, 0, c1, 1), (2, c2 + 30 * H1, 2, 21, 0, 0, c2, 1),
        (1, c1 + 47 * H1, 3, 12, 0, 0, c1, 2),
        (1, c1 + 9 * H1, 5, 13, 0, 0, c1, 3),                 # two batches late, inside its window: kept
        (1, c1 + 49 * H1, 4, 99, 0, 0, c1, 3),                # beyond story 1's window
        (3, c1 + 80 * H1, 1, 30, 0, 0, c1 + 70 * H1, 4),      # moves the clock past both windows
        (2, c2 + 40 * H1, 3, 77, 0, 0, c2, 5),                # story 2 is archived by now
        (3, c1 + 200 * H1, 2, 31, 0, 0, c1 + 70 * H1, 6),
    ]
    stories = [a_story(1, c1), a_story(2, c2), a_story(3, c1 + 70 * H1), a_story(4, c1 + 5 * H1),  # 4: no samples
               a_story(5, c1 + 190 * H1)]                                                          # 5: not closed
    recs, late = run_archive(spark, rows, spark.createDataFrame(stories, STORY))
    assert recs == {1: [10, 13, 11, 12], 2: [20, 21], 3: [30], 4: []}
    assert late == [(1, 99, "outside_window"), (2, 77, "already_archived"), (3, 31, "outside_window")]


def test_expiry_waits_for_the_delay_and_sees_new_stories(spark):
    c = ts("2020-01-01 00:00:00")
    rows = [(9, c + 60 * H1, 1, 1, 0, 0, c + 50 * H1, 0), (1, c + 3 * H1, 1, 5, 0, 0, c, 1),
            (9, c + 75 * H1, 2, 2, 0, 0, c + 50 * H1, 2)]
    calls = []

    def story():
        calls.append(1)  # story 2 is discovered after the stream has started
        return spark.createDataFrame([a_story(1, c), a_story(9, c + 50 * H1)] + [a_story(2, c)] * (len(calls) > 1), STORY)
    recs, late = run_archive(spark, rows, story, delay_s=24 * 3600)
    assert recs == {1: [5], 2: []} and late == []


def test_stream_archive_equals_the_batch_archive(spark):
    """The same records as one batch archive of the in-window samples."""
    got = catalog.QUERIES["stream_archive"](spark, SF)
    story, hist = T.stories(spark, SF), T.story_history(spark, SF)
    last = hist.agg(F.max("timestamp")).first()[0] - H1
    kept = hist.join(story.select(F.col("id").alias("story"), "created_at"), "story").filter(
        "timestamp < created_at + INTERVAL 2 DAYS").drop("created_at")
    run = jobs.archive(spark, story, T.subreddits(spark, SF), kept, A.scratch_path(spark, "t-batch"), last)
    batch = run.details.select(F.col("id"), F.size("history.timestamp").alias("n"))
    mine = got.select("id", F.col("n_points").alias("n"))
    assert mine.exceptAll(batch).count() == 0 and batch.exceptAll(mine).count() == 0
    assert mine.filter("n = 0").count() > 0


def test_discoveries_once_per_tracking_period(spark):
    df = catalog.QUERIES["stream_discoveries"](spark, SF)
    pairs = df.groupBy("short_id").agg(F.sort_array(F.collect_list("tick")).alias("t")).collect()
    for r in pairs:
        for a, b in zip(r.t, r.t[1:]):
            assert (b - a).total_seconds() >= 2 * 86400   # again only after tracking has ended
    firsts = {r.short_id: r.t[0] for r in pairs}
    seen = (T.feed_observations(spark, SF).filter(F.col("kind") == "t3")
            .groupBy("short_id").agg(F.min("tick").alias("t0")).collect())
    assert {r.short_id: r.t0 for r in seen} == firsts


def test_state_stream_writes_only_what_changed_and_folds(spark):
    root = A.scratch_path(spark, "t-state")
    samples = T.story_history(spark, SF).withColumn("year", F.year("timestamp"))
    land_in_order(samples, f"{root}/landing", "year", "parquet", steps_per_file=3)
    story0 = T.stories(spark, SF)

    def run():
        STR.await_done(STR.state_stream(spark, f"{root}/landing", samples.schema, story0, f"{root}/out", f"{root}/ck",
                                        max_files=1))
    run()
    deltas = spark.read.parquet(f"{root}/out/story_delta")
    years = sorted(r.year for r in samples.select("year").distinct().collect())
    seen = samples.filter(F.col("year").isin(years[:3])).join(story0.select(F.col("id").alias("story")), "story")
    assert deltas.filter("batch = 0").count() == seen.select("story").distinct().count()
    assert deltas.select("batch").distinct().count() == -(-len(years) // 3)
    first = STR.current(spark, story0, f"{root}/out")
    assert first.count() == story0.count() and first.select("id").distinct().count() == story0.count()
    before = first.select("id", "score", "updated_at").collect()
    run()                                                  # a restart from the checkpoint changes nothing
    again = STR.current(spark, story0, f"{root}/out").select("id", "score", "updated_at").collect()
    assert sorted(before) == sorted(again)
    folded = STR.fold_deltas(spark, story0, f"{root}/out", f"{root}/base")
    assert sorted(folded.select("id", "score", "updated_at").collect()) == sorted(before)
    assert sorted(STR.current(spark, folded, f"{root}/out").select("id", "score", "updated_at").collect()) == sorted(before)


def test_sampling_goes_on_as_time_passes(spark):
    rounds = catalog.QUERIES["stream_subreddit_rounds"](spark, SF)
    per_round = {r.timestamp: r["count"] for r in rounds.groupBy("timestamp").count().collect()}
    assert len(per_round) == 2 and min(per_round.values()) > 0


def test_guard_sees_a_community_added_between_batches(spark):
    root = A.scratch_path(spark, "t-guard")
    pages = T.landed_listing_pages(spark, SF)
    land_in_order(pages, f"{root}/landing", "tick", "json", steps_per_file=4)
    known = T.subreddits(spark, SF).withColumn("seen_at", F.lit(AS_OF))
    calls = []

    def subreddit():
        calls.append(1)
        return known.limit(0) if len(calls) == 1 else known
    STR.await_done(STR.discovery_stream(spark, f"{root}/landing", T.stories(spark, SF), subreddit, f"{root}/out",
                                        f"{root}/ck", as_of=AS_OF, max_files=1))
    new = spark.read.parquet(f"{root}/out/new_stories").groupBy("batch").count().collect()
    assert min(r.batch for r in new) == 1


def test_a_stream_that_does_not_end_raises(spark):
    class Stuck:
        stopped = False

        def awaitTermination(self, s):
            return False

        def stop(self):
            self.stopped = True
    q = Stuck()
    with pytest.raises(TimeoutError):
        STR.await_done(q, 1)
    assert q.stopped


def test_a_landing_appears_whole_and_in_as_many_files_as_tasks_wrote_it(spark):
    root = A.scratch_path(spark, "t-landings")
    rows = spark.range(0, 60, 1, 3).select("id", (F.col("id") % 5 * 3).cast("int").alias("step")).unionByName(
        spark.createDataFrame([(99, None)], "id long, step int"))  # a row without a step never lands
    seen = []
    for number in landings(rows, f"{root}/landing", "step", "parquet", steps_at_once=2):
        landed = spark.read.schema("id long, step int").parquet(f"{root}/landing/step")
        seen.append((number, sorted(r.step for r in landed.select("step").distinct().collect()), landed.count()))
        assert len(landed.inputFiles()) == 3 * len(seen[-1][1])     # no task wrote a whole group
    assert seen == [(0, [0, 3], 24), (1, [0, 3, 6, 9], 48), (2, [0, 3, 6, 9, 12], 60)]


def test_state_deltas_hold_only_what_a_sample_changes(spark):
    root, at = A.scratch_path(spark, "t-narrow"), ts("2020-01-01 00:00:00")
    story0 = (spark.createDataFrame([a_story(1, at), a_story(2, at), a_story(2, at), a_story(3, at), a_story(3, at)], STORY)
              .withColumn("updated_at", F.lit(at)).withColumn("checked_at", F.lit(at)))
    rows = [(s, at + k * H1, k, 10 * s + k, 0, 0, at, k) for k in (0, 1) for s in (1, 2)]
    samples = spark.createDataFrame(rows, SAMPLE).withColumn("hotness", F.lit(2.0))
    for _ in landings(samples, f"{root}/landing", "step", "parquet"):
        STR.await_done(STR.state_stream(spark, f"{root}/landing", samples.schema, story0, f"{root}/out", f"{root}/ck"))
    delta = spark.read.parquet(f"{root}/out/story_delta")
    assert set(delta.columns) == {"id", *STR.STATE, "state_only", "batch"}
    assert {r.batch for r in delta.select("batch").distinct().collect()} == {0, 1}
    got = STR.current(spark, story0, f"{root}/out")
    assert got.columns == story0.columns
    assert sorted((r.id, r.title, r.score, r.updated_at) for r in got.collect()) == [
        (1, "t", 11, at + H1), (2, "t", 21, at + H1), (3, "t", 5, at), (3, "t", 5, at)]
    # A whole row of a later batch counts for all columns, and a later state on top of it.
    whole = story0.filter("id = 1").withColumn("title", F.lit("new")).withColumn("score", F.lit(70))
    STR._write_delta(whole, f"{root}/out", 2)
    assert [(r.title, r.score) for r in STR.current(spark, story0, f"{root}/out").filter("id = 1").collect()] == [("new", 70)]
    STR._write_delta(delta.filter("batch = 1 AND id = 1").drop("batch"), f"{root}/out", 3)
    assert [(r.title, r.score) for r in STR.current(spark, story0, f"{root}/out").filter("id = 1").collect()] == [("new", 11)]
