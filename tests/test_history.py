import random

from pyspark.sql import functions as F

from conftest import ts
from storytrack.operators import history as H
from storytrack.operators.ordering import global_index, ordered_batches, position_within

HIST = "story long, timestamp timestamp, tie1 long, tie2 long, tie3 long, score int, hotness double, comments int, gilded int"


def hist(spark, rows):
    return spark.createDataFrame(rows, HIST)


def test_arrays_sorted_with_ties(spark):
    rows = [(1, ts("2020-01-02 00:00:00"), 1, 0, 0, 20, 2.0, 2, 0),
            (1, ts("2020-01-01 00:00:00"), 2, 0, 0, 11, 1.1, 1, 1),
            (1, ts("2020-01-01 00:00:00"), 1, 0, 0, 10, 1.0, 0, 0)]
    r = H.history_arrays(hist(spark, rows)).first()
    assert r.score == [10, 11, 20] and r.gilded == [0, 1, 0] and r.comments == [0, 1, 2]
    assert r.timestamp[0] == r.timestamp[1] < r.timestamp[2]


def test_latest_and_first_state_total_order(spark):
    rows = [(1, ts("2020-01-01 00:00:00"), 1, 0, 0, 10, 1.0, 0, 0),
            (1, ts("2020-01-01 00:00:00"), 2, 0, 0, 11, 1.1, 1, 1)]
    assert H.latest_state(hist(spark, rows)).first().score == 11
    assert H.first_state(hist(spark, rows)).first().score == 10
    assert H.latest_state(hist(spark, rows)).first().n_samples == 2


def test_detail_empty_history_gives_empty_arrays(spark):
    story = spark.createDataFrame(
        [(1, "a", 10, "t", None, "u", "p", "d", None, None, False, False, None, False, ts("2020-01-01 00:00:00"),
          5, 1.0, 0, 0, ts("2020-01-01 00:01:00"))],
        "id long, reddit_short_id string, subreddit long, title string, author string, url string, permalink string, "
        "domain string, thumbnail string, distinguished string, over18 boolean, is_self boolean, selftext string, "
        "stickied boolean, created_at timestamp, score int, hotness double, comments int, gilded int, discovered_at timestamp")
    sub = spark.createDataFrame([(10, "news")], "id long, name string")
    d = H.story_detail(story, sub, hist(spark, [])).first()
    assert d.history.timestamp == [] and d.history.score == [] and d.subreddit == "news"
    js = H.detail_json(H.story_detail(story, sub, hist(spark, []))).first().json
    assert '"author":null' in js and '"history":{"timestamp":[]' in js


def test_chunked_arrays_are_bounded_and_complete(spark):
    rnd = random.Random(7)
    rows = [(1 if i % 3 else rnd.randint(2, 5), ts("2020-01-01 00:00:00"), i, 0, 0, i, 0.0, 0, 0) for i in range(300)]
    arr = H.history_arrays(hist(spark, rows), max_points=17).collect()
    assert max(len(r.score) for r in arr) <= 17
    assert sorted(s for r in arr for s in r.score) == list(range(300))
    hot = sorted((r.chunk, r.score) for r in arr if r.story == 1)
    flat = [s for _, sc in hot for s in sc]
    assert flat == sorted(flat)


def test_global_index_gap_free_under_hot_key(spark):
    # A third of the rows share one key.
    df = spark.range(0, 3000, 1, 6).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")))
    got = global_index(df, [F.col("k"), F.col("id")]).collect()
    assert sorted(r.idx for r in got) == list(range(3000))
    by_idx = [(r.k, r.id) for r in sorted(got, key=lambda r: r.idx)]
    assert by_idx == sorted(by_idx)


def test_position_within_matches_row_number(spark):
    df = spark.range(0, 500, 1, 5).withColumn("g", (F.col("id") % 4 == 0).cast("int") * 0 + F.col("id") % 7)
    got = {(r.g, r.id): r.seq for r in position_within(df, "g", [F.col("id")]).collect()}
    expect = {}
    for g in range(7):
        ids = sorted(i for i in range(500) if i % 7 == g)
        expect.update({(g, i): n + 1 for n, i in enumerate(ids)})
    assert got == expect


def test_ordered_batches(spark):
    df = spark.range(0, 250, 1, 3)
    got = {r.id: (r.batch, r.pos_in_batch) for r in ordered_batches(df, [F.col("id").desc()], 100).collect()}
    assert got[249] == (0, 0) and got[150] == (0, 99) and got[0] == (2, 49)
    small = ordered_batches(df.limit(10), [F.col("id")], 4).collect()
    assert sorted((r.batch, r.pos_in_batch) for r in small)[-1] == (2, 1)


def test_offsets_and_delay(spark):
    h = hist(spark, [(1, ts("2020-01-01 00:00:00"), 1, 0, 0, 1, 0.0, 0, 0)])
    st = spark.createDataFrame([(1, ts("2020-01-02 00:00:00"), ts("2020-01-02 00:10:00.6"))],
                               "id long, created_at timestamp, discovered_at timestamp")
    assert H.history_offsets(h, st).first().offset_s == -86400.0
    assert H.discovery_delay(st).first().discovery_delay_s == 601.0


def test_positions_across_days_and_ties(spark):
    rnd = random.Random(11)
    rows = [(s, ts(f"2020-01-{rnd.randint(1, 9):02d} 0{rnd.randint(0, 2)}:00:00"), i, 0, 0, i, 0.0, 0, 0)
            for i, s in enumerate([1] * 120 + [2] * 30 + [3])]
    expect = {}
    for story in (1, 2, 3):
        own = sorted((r[1], r[2]) for r in rows if r[0] == story)
        expect.update({(story, tie): n + 1 for n, (_, tie) in enumerate(own)})
    assert {(r.story, r.tie1): r.seq for r in H.history_ordered(hist(spark, rows)).collect()} == expect


def test_a_history_without_long_stories_is_read_and_shuffled_once(spark, tmp_path):
    rows = [(s, ts("2020-01-01 00:00:00"), i, 0, 0, i, 0.0, 0, 0) for s in range(5) for i in range(4)]
    hist(spark, rows).write.parquet(f"{tmp_path}/h")
    arr = H.history_arrays(spark.read.parquet(f"{tmp_path}/h"))
    plan = arr._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(") == 1
    assert sorted((r.story, r.chunk, r.score) for r in arr.collect()) == [(s, 0, [0, 1, 2, 3]) for s in range(5)]


def test_a_lookup_broadcasts_the_few_ids_it_asks_for(spark, tmp_path):
    spark.range(4000).select(F.col("id"), F.col("id").cast("string").alias("reddit_short_id"), F.lit(1).cast("long").alias("subreddit"),
                             *[F.lit("x").alias(c) for c in ("title", "author", "domain", "url", "thumbnail", "permalink", "selftext",
                                                             "distinguished")],
                             *[F.lit(ts("2020-01-01 00:00:00")).alias(c) for c in ("created_at", "discovered_at")],
                             *[F.lit(1).alias(c) for c in ("score", "comments", "gilded")], F.lit(0.5).alias("hotness"),
                             *[F.lit(False).alias(c) for c in ("is_self", "over18", "stickied")]).write.parquet(f"{tmp_path}/s")
    hist(spark, [(s, ts("2020-01-01 00:00:00"), i, 0, 0, i, 0.0, 0, 0) for s in range(50) for i in range(3)]).write.parquet(f"{tmp_path}/h")
    sub = spark.createDataFrame([(1, "news")], "id long, name string")
    ids = spark.createDataFrame([(str(i),) for i in (7, 7, 9, 60, 9999)], "short_id string").repartition(3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")  # the stories' file is larger, the ids' are smaller
    try:
        det = H.story_detail(spark.read.parquet(f"{tmp_path}/s"), sub, spark.read.parquet(f"{tmp_path}/h"), ids)
        plan = det._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.story_id, r.history.score) for r in det.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == [(7, [0, 1, 2]), (9, [0, 1, 2]), (60, [])]
    assert "LeftSemi, BuildRight" in plan  # the history is cut before any of it is shuffled
