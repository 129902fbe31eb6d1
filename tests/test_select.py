from pyspark.sql import functions as F

from conftest import ts
from storytrack.operators import select as sel

AS_OF = ts("2020-01-01 00:00:00")


def subs(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, seen_at timestamp, updated_at timestamp")


def test_recently_seen_is_exclusive(spark):
    df = subs(spark, [(1, "a", ts("2019-12-31 21:00:00"), AS_OF), (2, "b", ts("2019-12-31 21:00:01"), AS_OF)])
    assert [r.id for r in sel.subreddits_recently_seen(df, AS_OF).collect()] == [2]


def test_stale_is_exclusive(spark):
    df = subs(spark, [(1, "a", AS_OF, ts("2019-12-31 23:45:00")), (2, "b", AS_OF, ts("2019-12-31 23:44:59"))])
    assert [r.id for r in sel.subreddits_stale(df, AS_OF).collect()] == [2]


def stories(spark, rows):
    return spark.createDataFrame(
        rows, "id long, hotness double, checked_at timestamp, discovered_at timestamp, created_at timestamp, score int")


def test_needing_update_bounds_inclusive_and_ties(spark):
    rows = [
        (1, 5.0, ts("2019-12-31 23:58:00"), ts("2019-12-30 00:00:00"), AS_OF, 1),   # both bounds equal → in
        (2, 5.0, ts("2019-12-31 23:58:01"), ts("2019-12-30 00:00:00"), AS_OF, 1),   # checked too recently
        (3, 9.0, ts("2019-12-31 00:00:00"), ts("2019-12-29 23:59:59"), AS_OF, 1),   # discovered too long ago
        (0, 5.0, ts("2019-12-31 00:00:00"), ts("2019-12-31 00:00:00"), AS_OF, 1),   # tie on hotness: id 0 first
    ]
    got = [r.id for r in sel.stories_needing_update(stories(spark, rows), AS_OF, limit=2).collect()]
    assert got == [0, 1]


def test_archivable_inclusive(spark):
    rows = [(1, 1.0, AS_OF, AS_OF, ts("2019-12-30 00:00:00"), 1), (2, 1.0, AS_OF, AS_OF, ts("2019-12-30 00:00:01"), 1)]
    assert [r.id for r in sel.stories_archivable(stories(spark, rows), AS_OF).collect()] == [1]


def test_hottest_left_join_keeps_orphans(spark):
    st = spark.createDataFrame([(1, 3.0, 10), (2, 2.0, 99), (3, 1.0, 10)], "id long, hotness double, subreddit long")
    sb = spark.createDataFrame([(10, "news")], "id long, name string")
    got = [(r.id, r.subreddit_name) for r in sel.hottest_stories(st, sb, 2).orderBy(F.desc("hotness")).collect()]
    assert got == [(1, "news"), (2, None)]


def test_listing_sorts(spark):
    rows = [(1, 1.0, AS_OF, AS_OF, ts("2019-12-31 12:00:00"), 50), (2, 9.0, AS_OF, AS_OF, ts("2019-12-20 00:00:00"), 90),
            (3, 5.0, AS_OF, AS_OF, ts("2020-01-02 00:00:00"), 99)]
    df = stories(spark, rows)
    assert [r.id for r in sel.listing(df, "top", "day", AS_OF).collect()] == [1]
    assert [r.id for r in sel.listing(df, "top", "all", AS_OF).collect()] == [2, 1]
    assert [r.id for r in sel.listing(df, "new", "all", AS_OF).collect()] == [1, 2]
    assert [r.id for r in sel.listing(df, "hot", "all", AS_OF).collect()] == [2, 1]


def test_lookup_status(spark):
    req = spark.createDataFrame([("a",), ("b",), ("a",)], "short_id string")
    st = spark.createDataFrame([(7, "a")], "id long, reddit_short_id string")
    got = {r.short_id: (r.found, r.status) for r in sel.lookup_status(req, st).collect()}
    assert got == {"a": (True, 200), "b": (False, 404)}
