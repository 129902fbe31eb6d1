import pytest
from pyspark.sql import functions as F

from conftest import ts
from storytrack.operators import merge as M

T0, T1 = ts("2020-01-01 00:00:00"), ts("2020-01-02 00:00:00")
OBS = "tick timestamp, short_id string, feed string, page long, pos int, score int, subreddit_name string"


def test_union_feeds_hot_wins_and_flags_new(spark):
    obs = spark.createDataFrame([(T0, "a", "new", 0, 0, 1, "x"), (T0, "a", "hot", 5, 9, 2, "x"),
                                 (T0, "b", "new", 0, 1, 3, "x"), (T0, "b", "new", 1, 0, 4, "x")], OBS)
    got = {r.short_id: (r.feed, r.score, r.in_new) for r in M.union_feeds(obs).collect()}
    assert got == {"a": ("hot", 2, True), "b": ("new", 3, True)}


def test_dedup_first_and_last(spark):
    obs = spark.createDataFrame([(T0, "a", "new", 1, 0, 1, "x"), (T0, "a", "new", 0, 5, 2, "x")], OBS)
    assert M.dedup_first_seen(obs).first().score == 2
    last = obs.withColumn("arrival", F.col("page") * 100 + F.col("pos"))
    assert M.dedup_last_wins(last, keys=("short_id",)).first().score == 1


def pages_fixture(spark, n_pages, per_page, repeat_from=None):
    rows, k = [], 0
    for p in range(n_pages):
        for i in range(per_page):
            sid = f"s{k}" if repeat_from is None or p < repeat_from else f"s{i}"
            rows.append(("hot", p, i, sid))
            k += 1
    return spark.createDataFrame(rows, "feed string, page long, pos int, short_id string")


@pytest.mark.parametrize("limit", [50, 200, 250])
def test_paging_sizes(spark, limit):
    ch = pages_fixture(spark, 4, 100)
    got = M.paged_listing(ch, limit).collect()
    assert len(got) == limit and sorted(r.rank for r in got) == list(range(1, limit + 1))


def test_paging_stops_when_a_page_adds_nothing(spark):
    ch = pages_fixture(spark, 4, 100, repeat_from=1)  # pages 1.. repeat page 0's ids
    assert len(M.paged_listing(ch, 250).collect()) == 100


def story_table(spark, rows):
    return spark.createDataFrame(rows, "id long, reddit_short_id string, score int, hotness double, comments int, "
                                       "gilded int, updated_at timestamp, checked_at timestamp")


def test_apply_samples_latest_wins_and_older_ignored(spark):
    st = story_table(spark, [(1, "a", 1, 1.0, 1, 0, T1, T1), (2, "b", 1, 1.0, 1, 0, T0, T0)])
    smp = spark.createDataFrame([(1, T0, 9, 9.0, 9, 9), (2, T1, 7, 7.0, 7, 7), (3, T1, 5, 5.0, 5, 5)],
                                "story long, timestamp timestamp, score int, hotness double, comments int, gilded int")
    got = {r.id: (r.score, r.updated_at) for r in M.apply_samples(st, M.live_samples(smp, st)).collect()}
    assert got == {1: (1, T1), 2: (7, T1)}


def test_check_outcomes_branches(spark):
    st = story_table(spark, [(1, "a", 1, 1.0, 1, 0, T0, T0), (2, "b", 1, 1.0, 1, 0, T0, T0)])
    ret = spark.createDataFrame([("a", 5, 5.0, 5, 5)], "short_id string, score int, hotness double, comments int, gilded int")
    out = M.check_outcomes(st, ret)
    after = {r.id: (r.score, r.updated_at, r.checked_at) for r in M.apply_checks(st, out, T1).collect()}
    assert after == {1: (5, T1, T1), 2: (1, T0, T1)}


def test_discover_insert_continues_ids(spark):
    acc = spark.createDataFrame(
        [(T0, "n1", "x", "t", "u", "l", "p", "d", None, None, False, False, None, False, T0, 3, 1.0, 0, 0),
         (T1, "n1", "x", "t", "u", "l", "p", "d", None, None, False, False, None, False, T0, 4, 2.0, 0, 0),
         (T0, "n0", "x", "t", "u", "l", "p", "d", None, None, False, False, None, False, T0, 1, 1.0, 0, 0)],
        "tick timestamp, short_id string, subreddit_name string, title string, author string, url string, "
        "permalink string, domain string, thumbnail string, distinguished string, over18 boolean, is_self boolean, "
        "selftext string, stickied boolean, created_at timestamp, score int, hotness double, comments int, gilded int")
    st = spark.createDataFrame([(41, "old")], "id long, reddit_short_id string")
    sub = spark.createDataFrame([(5, "x")], "id long, name string")
    new, first, later = M.discover_insert(acc, st, sub)
    assert {r.reddit_short_id: r.id for r in new.collect()} == {"n0": 42, "n1": 43}
    assert [(r.story, r.score) for r in later.collect()] == [(43, 4)]
    assert sorted(r.story for r in first.collect()) == [42, 43]


def test_guard_and_empty_dimension(spark):
    un = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "short_id string, subreddit_name string")
    known = spark.createDataFrame([("x",)], "name string")
    acc, rej = M.guard_known(un, known)
    assert [r.short_id for r in acc.collect()] == ["a"] and sorted(r.short_id for r in rej.collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        M.require_known(known.filter(F.lit(False)))


def test_subreddit_upsert_and_history(spark):
    sub = spark.createDataFrame([(1, "1", "news", "N", "/r/news/", None, "d", "any", T0, T0, T0)],
                                "id long, reddit_short_id string, name string, title string, url string, summary string, "
                                "description string, submission_type string, created_at timestamp, updated_at timestamp, "
                                "seen_at timestamp")
    abouts = spark.createDataFrame(
        [("pics", 200, "9", "pics", "P", None, "d", "any", "/r/pics/", 4, 5, 6),
         ("news", 403, "1", "news", "N", None, "d", "any", "/r/news/", 1, 1, 1)],
        "requested string, status int, reddit_short_id string, name string, title string, summary string, "
        "description string, submission_type string, url string, comment_hide_mins int, active int, subscribers long")
    names = spark.createDataFrame([("news",), ("pics",)], "name string")
    snap = {r.name: (r.id, r.action, r.seen_at, r.created_at) for r in M.subreddit_upsert(names, sub, abouts, T1).collect()}
    assert snap == {"news": (1, "seen", T1, T0), "pics": (2, "inserted", T1, T1)}
    stale = sub.select("id", "name")
    assert M.subreddit_history_append(stale, abouts, T1).count() == 0          # 403 → skipped
    bad = spark.createDataFrame([(r.asDict() | {"status": 500}) for r in abouts.collect()], abouts.schema)
    with pytest.raises(Exception):
        M.subreddit_history_append(stale, bad, T1, strict=True).collect()


def test_cascades(spark):
    sub = spark.createDataFrame([(1,), (2,)], "id long")
    sh = spark.createDataFrame([(1, 1), (2, 2)], "subreddit long, x int")
    st = spark.createDataFrame([(10, 1), (20, 2)], "id long, subreddit long")
    h = spark.createDataFrame([(10, 0), (20, 0), (20, 1)], "story long, x int")
    doomed = spark.createDataFrame([(2,)], "id long")
    s2, sh2, st2, h2 = M.delete_subreddits(sub, sh, st, h, doomed)
    assert [r.id for r in s2.collect()] == [1] and sh2.count() == 1
    assert [r.id for r in st2.collect()] == [10] and [r.story for r in h2.collect()] == [10]
    st3, h3 = M.delete_stories(st, h, spark.createDataFrame([(20,)], "id long"))
    assert st3.count() == 1 and h3.count() == 1


def test_paging_above_group_limit_threshold(spark):
    ch = pages_fixture(spark, 13, 100)
    got = M.paged_listing(ch, 1200).collect()
    assert len(got) == 1200 and sorted(r.rank for r in got) == list(range(1, 1201))


def test_union_feeds_unknown_feed_ranks_last(spark):
    obs = spark.createDataFrame([(T0, "a", "front", 0, 0, 1, "x"), (T0, "a", "new", 3, 3, 2, "x")], OBS)
    assert M.union_feeds(obs).first().feed == "new"


def test_paging_stops_at_an_empty_page(spark):
    ch = pages_fixture(spark, 4, 100).filter(F.col("page") != 1)     # page 1 landed empty
    pages = spark.createDataFrame([("hot", p) for p in range(4)], "feed string, page long")
    assert len(M.paged_listing(ch, 250, pages=pages).collect()) == 100
    assert len(M.paged_listing(ch, 250).collect()) == 250              # without the page list it can't know


def test_every_scrape_is_a_walk_of_its_own(spark):
    rows = [("hot", T0, 0, 0, "a"), ("hot", T0, 0, 1, "b"), ("hot", T0, 1, 0, "a"), ("hot", T0, 2, 0, "never read"),
            ("hot", T1, 3, 0, "c"), ("hot", T1, 4, 0, "d"), ("hot", T1, 5, 0, "a")]
    ch = spark.createDataFrame(rows, "feed string, tick timestamp, page long, pos int, short_id string")
    got = {(r.tick, r.rank, r.short_id) for r in M.paged_listing(ch, 250).collect()}
    assert got == {(T0, 1, "a"), (T0, 2, "b"), (T1, 1, "c"), (T1, 2, "d"), (T1, 3, "a")}


def test_front_page_is_the_last_scrape(spark):
    rows = [("hot", T0, 0, 0, "a", "x"), ("hot", T1, 1, 0, "b", "y"), ("hot", T1, 1, 1, "c", "z")]
    hot = spark.createDataFrame(rows, "feed string, tick timestamp, page long, pos int, short_id string, subreddit_name string")
    assert {r.name for r in M.front_page_subreddits(hot).collect()} == {"y", "z"}
    assert {r.name for r in M.front_page_subreddits(hot, 1).collect()} == {"y"}
    assert {r.name for r in M.front_page_subreddits(hot, as_of=T0).collect()} == {"x"}


def test_update_pass_takes_only_records_since_the_check(spark):
    from storytrack.plans import jobs
    T2 = ts("2020-01-03 00:00:00")
    st = spark.createDataFrame(
        [(1, "a", 500, 5.0, 1, 0, T0, T1, T1), (2, "b", 1, 1.0, 1, 0, T0, T0, T0), (3, "c", 1, 1.0, 1, 0, T0, T0, T0)],
        "id long, reddit_short_id string, score int, hotness double, comments int, gilded int, discovered_at timestamp, "
        "updated_at timestamp, checked_at timestamp")
    landed = spark.createDataFrame(
        [("a", T0, 1, 1.0, 0, 0, 1), ("b", T1, 7, 7.0, 7, 7, 2), ("b", T0, 3, 3.0, 3, 3, 3), ("c", T2, 9, 9.0, 9, 9, 4)],
        "short_id string, tick timestamp, score int, hotness double, comments int, gilded int, arrival long")
    now = ts("2020-01-02 12:00:00")
    run = jobs.update_pass(st, landed, now)
    assert {r.id: r.outcome for r in run.outcomes.collect()} == {1: "checked", 2: "updated", 3: "checked"}
    assert [tuple(r) for r in run.samples.collect()] == [(2, now, 7, 7.0, 7, 7)]
    after = {r.id: (r.score, r.updated_at, r.checked_at) for r in run.story_after.collect()}
    assert after == {1: (500, T1, now), 2: (7, now, now), 3: (1, T0, now)}


def test_later_sightings_do_not_look_for_the_first_ones_again(spark):
    """The samples of later sightings join the inserted stories; rows are as many as sightings."""
    columns = ["title", "author", "url", "permalink", "domain", "thumbnail", "distinguished", "selftext"]
    flags = ["over18", "is_self", "stickied"]
    accepted = spark.createDataFrame(
        [(T0, "a", "x", 1), (T1, "a", "x", 2), (T1, "b", "x", 3), (T1, None, "x", 4)],
        "tick timestamp, short_id string, subreddit_name string, score int")
    accepted = accepted.select(
        "*", *[F.lit("w").alias(c) for c in columns], *[F.lit(False).alias(c) for c in flags],
        F.col("tick").alias("created_at"), F.lit(0.5).alias("hotness"), F.lit(1).alias("comments"),
        F.lit(0).alias("gilded"))
    story = spark.createDataFrame([(10,)], "id long")
    subs = spark.createDataFrame([(1, "x")], "id long, name string")
    new, first, later = M.discover_insert(accepted, story, subs)
    ids = {r.reddit_short_id: r.id for r in new.collect()}
    assert sorted(ids.values()) == [11, 12, 13] and first.count() == 3
    assert [(r.story, r.timestamp, r.score) for r in later.collect()] == [(ids["a"], T1, 2)]
    assert "min_by" not in later._jdf.queryExecution().optimizedPlan().toString()
