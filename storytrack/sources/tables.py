"""Canonical tables bound onto the driver's parquet files.

The engine's own tables are ``subreddit``, ``subreddit_history``, ``story`` and
``story_history`` (plus feed observations). A deployment stores them as parquet
(see :func:`write_canonical`); for tests and the benchmark they are derived from
the TPC-H-shaped driver tables with the mapping below. These functions only
shape rows into the expected schema — they do none of the operators' work.

Driver timestamps load as TIMESTAMP_NTZ; they are cast to TIMESTAMP (session
zone UTC) because event-time operators (watermarks) reject NTZ.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from storytrack.functions import scalars as X
from storytrack.session import AS_OF, checkpoint_dir

# Fixed values of the binding (mirrored in storytrack.plans.oracle).
SCORE_OFFSET = 250000
SUBREDDIT_CREATED_DAYS_BEFORE = 30
FEED_BY_EVENT = {"view": "new", "signup": "new", "click": "hot", "purchase": "hot", "error": "hot"}
WRONG_KIND_EVENT = "error"
STORY_ID_STRIDE = 211
PAGE_SIZE = 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(c: str):
    return F.col(c).cast("timestamp")


def subreddits(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """subreddit ← customer."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    now = X.as_ts(as_of)
    return c.select(
        k.alias("id"),
        k.cast("string").alias("reddit_short_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("title"),
        F.concat(F.lit("/r/"), F.col("c_name"), F.lit("/")).alias("url"),
        F.lit(None).cast("string").alias("summary"),
        F.col("c_mktsegment").alias("description"),
        F.lit("any").alias("submission_type"),
        X.minus_seconds(now, SUBREDDIT_CREATED_DAYS_BEFORE * 86400).alias("created_at"),
        X.minus_seconds(now, (k * 11) % 3600).alias("updated_at"),
        X.minus_seconds(now, (k * 977) % 21600).alias("seen_at"),
    )


def subreddit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subreddit_history ← orders (one sample per order)."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        _ts("o_orderdate").alias("timestamp"),
        F.col("o_custkey").alias("subreddit"),
        F.col("o_orderkey").alias("subscribers"),
        F.floor("o_totalprice").cast("int").alias("active"),
        (F.col("o_orderkey") % 60).cast("int").alias("comment_hide_mins"),
    )


def _thumbnail(id_col):
    r = id_col % 6
    return (F.when(r == 0, F.lit(None).cast("string"))
            .when(r == 1, F.lit(""))
            .when(r == 2, F.lit("default"))
            .when(r == 3, F.lit("self"))
            .when(r == 4, F.lit("nsfw"))
            .otherwise(F.concat(F.lit("http://t/"), id_col.cast("string"))))


def stories(spark: SparkSession, sf_dir: str, with_feed: bool = False) -> DataFrame:
    """story ← orders. Current state columns (score, hotness, …) as stored."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    created = _ts("o_orderdate")
    score = (F.floor("o_totalprice").cast("int") - F.lit(SCORE_OFFSET)).cast("int")
    cols = [
        k.alias("id"),
        k.cast("string").alias("reddit_short_id"),
        F.col("o_custkey").alias("subreddit"),
        F.col("o_orderpriority").alias("title"),
        F.lit("anon").alias("author"),
        F.concat(F.lit("http://t/"), k.cast("string")).alias("url"),
        F.concat(F.lit("/comments/"), k.cast("string")).alias("permalink"),
        F.lit("t").alias("domain"),
        _thumbnail(k).alias("thumbnail"),
        F.lit(None).cast("string").alias("distinguished"),
        (F.col("o_orderstatus") == "F").alias("over18"),
        (F.col("o_orderstatus") == "O").alias("is_self"),
        F.lit(None).cast("string").alias("selftext"),
        F.lit(False).alias("stickied"),
        created.alias("created_at"),
        score.alias("score"),
        X.hotness(score, created).alias("hotness"),
        (k % 500).cast("int").alias("comments"),
        (k % 7).cast("int").alias("gilded"),
        X.plus_seconds(created, k % 3600).alias("discovered_at"),
        X.plus_seconds(created, k % 172800).alias("updated_at"),
        X.plus_seconds(created, k % 172800).alias("checked_at"),
    ]
    if with_feed:
        cols.append(F.when(F.col("o_orderstatus") == "O", "new").otherwise("hot").alias("feed"))
    return o.select(*cols)


def story_history(spark: SparkSession, sf_dir: str, with_hotness: bool = True) -> DataFrame:
    """story_history ← lineitem (one sample per line item).

    Hotness of a sample needs its story's creation time, so the full binding joins
    orders; operators that never read hotness use ``with_hotness=False`` and skip it.
    """
    li = read(spark, sf_dir, "lineitem")
    score = F.floor("l_extendedprice").cast("int")
    h = li.select(
        F.col("l_orderkey").alias("story"),
        _ts("l_shipdate").alias("timestamp"),
        F.col("l_linenumber").cast("long").alias("tie1"),
        F.col("l_partkey").alias("tie2"),
        F.col("l_suppkey").alias("tie3"),
        score.alias("score"),
        F.floor("l_quantity").cast("int").alias("comments"),
        (F.col("l_returnflag") == "R").cast("int").alias("gilded"),
    )
    if not with_hotness:
        return h.withColumn("hotness", F.lit(None).cast("double"))
    created = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("story"), _ts("o_orderdate").alias("_created"))
    return (h.join(created, "story", "inner")
            .withColumn("hotness", X.hotness("score", "_created"))
            .drop("_created")
            .select("story", "timestamp", "tie1", "tie2", "tie3", "score", "hotness", "comments", "gilded"))


def feed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed observations ← events: one story seen on one feed page at one tick.

    Columns: arrival, feed, page, pos, tick, kind, short_id, subreddit (name) and the
    story payload fields (raw names). ``error`` events become wrong-kind children.
    """
    e = read(spark, sf_dir, "events")
    cust = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("subreddit"))
    ev = F.col("event_id")
    feed_expr = F.lit(None).cast("string")
    for src, dst in FEED_BY_EVENT.items():
        feed_expr = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(feed_expr)
    # A page is fetched once: its tick is the UTC day of its earliest event. Pages hold at
    # most PAGE_SIZE events, so this window's groups are bounded.
    page_w = Window.partitionBy("feed", "page")
    short_id = (F.col("user_id") * STORY_ID_STRIDE).cast("string")
    score = F.when(ev % 25 == 0, F.lit(None).cast("int")).otherwise(F.floor("value").cast("int"))
    # The names are joined before the window, whose partitions by page then serve what follows;
    # the other columns are made behind it.
    e = (e.withColumn("feed", feed_expr).withColumn("page", F.floor(ev / PAGE_SIZE).cast("long"))
         .join(cust, "user_id", "left").withColumn("_first", F.min(_ts("ts")).over(page_w)))
    tick = F.date_trunc("day", "_first")
    obs = e.select(
        ev.alias("arrival"),
        F.col("feed"),
        F.col("page"),
        (ev % PAGE_SIZE).cast("int").alias("pos"),
        tick.alias("tick"),
        F.when(F.col("event_type") == WRONG_KIND_EVENT, "t5").otherwise("t3").alias("kind"),
        short_id.alias("short_id"),
        F.col("subreddit"),
        F.col("event_type").alias("title"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        (F.unix_seconds(tick) - (ev % 2880) * 60).cast("double").alias("created_utc"),
        F.lit("example.com").alias("domain"),
        F.get_json_object("props", "$.k").cast("int").alias("num_comments"),
        (ev % 3).cast("int").alias("gilded"),
        score.alias("score"),
        F.concat(F.lit("/r/"), F.col("subreddit"), F.lit("/comments/"), short_id).alias("permalink"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.lit("text")).alias("selftext"),
        F.when(ev % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("http://i/"), short_id)).alias("thumbnail"),
        F.concat(F.lit("http://t/"), short_id).alias("url"),
        F.lit(None).cast("string").alias("distinguished"),
        (F.col("event_type") == "view").alias("is_self"),
        (ev % 10 == 0).alias("over_18"),
        (ev % 50 == 0).alias("sticked"),
        _ts("ts").alias("seen_at"),
    )
    return obs


_LANDED: dict[str, str] = {}


def _landed_once(spark: SparkSession, key: str, build) -> DataFrame:
    """Write a stand-in landing set once (as a crawler would have), then read it back."""
    path = _LANDED.get(key)
    if path is None or not _exists(spark, path):
        path = f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
        build().write.mode("overwrite").parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # lists the folder; fails when it is missing
        return True
    except Exception:  # noqa: BLE001 - AnalysisException (path not found)
        return False


def landed_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed payload text: one listing envelope per (feed, page), as a JSON string.

    Stand-in for payload files (``spark.read.text``): rows (feed, page, tick, value),
    written once per test folder and read back like landed files.
    """
    return _landed_once(spark, f"pages:{sf_dir}", lambda: _build_listing_pages(spark, sf_dir))


def _build_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each page groups at most PAGE_SIZE children, so the grouping is bounded.
    obs = feed_observations(spark, sf_dir)
    payload_fields = ["id", "title", "author", "created_utc", "domain", "num_comments", "gilded",
                      "score", "permalink", "selftext", "subreddit", "thumbnail", "url",
                      "distinguished", "is_self", "over_18", "sticked"]
    child = F.struct(
        F.col("pos"),
        F.col("tick"),
        F.struct(F.col("kind").alias("kind"),
                 F.struct(*[(F.col("short_id") if f == "id" else F.col(f)).alias(f)
                            for f in payload_fields]).alias("data")).alias("thing"))
    pages = obs.groupBy("feed", "page").agg(
        F.array_sort(F.collect_list(child)).alias("children"),
        F.max_by(F.concat(F.lit("t3_"), F.col("short_id")), F.col("pos")).alias("after"))
    envelope = F.struct(
        F.lit("Listing").alias("kind"),
        F.struct(F.lit("").alias("before"), F.col("after"),
                 F.transform("children", lambda c: c["thing"]).alias("children")).alias("data"))
    return pages.select(
        "feed", "page",
        F.element_at("children", 1)["tick"].alias("tick"),
        F.to_json(envelope).alias("value"))


def landed_subreddit_abouts(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """Landed ``about`` payloads (kind t5), one per customer: rows (requested, status, value)."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    data = F.struct(
        k.cast("string").alias("id"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("title"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("about "), F.col("c_name"))).alias("public_description"),
        F.col("c_mktsegment").alias("description"),
        F.lit("public").alias("subreddit_type"),
        F.lit("any").alias("submission_type"),
        F.concat(F.lit("/r/"), F.col("c_name"), F.lit("/")).alias("url"),
        (F.unix_seconds(X.as_ts(as_of)) - k * 3600).cast("double").alias("created"),
        (k % 60).cast("int").alias("comment_score_hide_mins"),
        F.col("c_nationkey").alias("accounts_active"),
        (k * 13).alias("subscribers"),
        (k % 9 == 0).alias("over18"),
    )
    status = F.when(F.col("c_nationkey") == 0, F.lit(403)).otherwise(F.lit(200))
    return c.select(
        F.col("c_name").alias("requested"),
        status.alias("status"),
        F.to_json(F.struct(F.lit("t5").alias("kind"), data.alias("data"))).alias("value"))


def write_bucketed(spark: SparkSession, sf_dir: str, out_dir: str, buckets: int,
                   prefix: str = "st") -> dict[str, str]:
    """Write ``story`` bucketed by ``id`` and ``story_history`` bucketed by ``story`` (sorted by
    story, time) as catalog tables at ``out_dir``. Per-story aggregates over the history and
    story ⋈ history joins then read co-located buckets and skip the shuffle. Returns the
    table names (use ``spark.table(name)``)."""
    names = {"story": f"{prefix}_story", "story_history": f"{prefix}_story_history"}
    (stories(spark, sf_dir).write.mode("overwrite").bucketBy(buckets, "id").sortBy("id")
     .option("path", f"{out_dir}/story").saveAsTable(names["story"]))
    (story_history(spark, sf_dir).write.mode("overwrite").bucketBy(buckets, "story")
     .sortBy("story", "timestamp").option("path", f"{out_dir}/story_history")
     .saveAsTable(names["story_history"]))
    return names


def write_canonical(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """Materialise the canonical tables in their storage layout.

    History tables are partitioned by UTC day and sorted by (key, time) inside files,
    so time-range filters prune whole directories and per-key reads skip row groups.
    Range partitioning on (day, key, time) splits a hot day over several tasks.
    """
    subreddits(spark, sf_dir).write.mode("overwrite").parquet(f"{out_dir}/subreddit")
    stories(spark, sf_dir).write.mode("overwrite").parquet(f"{out_dir}/story")
    (story_history(spark, sf_dir)
     .withColumn("day", X.utc_day("timestamp"))
     .repartitionByRange("day", "story", "timestamp").sortWithinPartitions("story", "timestamp")
     .write.mode("overwrite").partitionBy("day").parquet(f"{out_dir}/story_history"))
    (subreddit_history(spark, sf_dir)
     .withColumn("day", X.utc_day("timestamp"))
     .repartitionByRange("day", "subreddit", "timestamp").sortWithinPartitions("subreddit", "timestamp")
     .write.mode("overwrite").partitionBy("day").parquet(f"{out_dir}/subreddit_history"))


def read_canonical(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Open the canonical tables written by :func:`write_canonical` (day partitions are
    discovered, so time filters on ``day`` prune folders)."""
    return {name: spark.read.parquet(f"{root}/{name}")
            for name in ("subreddit", "story", "story_history", "subreddit_history")}
