"""Filters, top-k listings and lookups over the current-state tables.

Every limit is given a total order (id as the last key) so results are deterministic.
Top-k plans compile to TakeOrderedAndProject: each task keeps its own k best rows and
only k·tasks rows meet in the final merge — no full sort, no skew exposure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storytrack.functions import scalars as X
from storytrack.session import AS_OF, checkpoint_dir

# Fixed defaults of the tracked-story life cycle (seconds).
SUBREDDIT_EXPIRY_S = 10800
SUBREDDIT_SAMPLE_INTERVAL_S = 1800
STORY_RECHECK_S = 120
STORY_TRACK_AGE_S = 172800
UPDATE_WORKERS = 4
PAGE_SIZE = 100

# Listing time ranges (seconds); None = no lower bound.
TIME_RANGES = {"hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400,
               "year": 365 * 86400, "all": None}


# Rows of a result that may be broadcast to look up a dimension.
MAX_LOOKUP_ROWS = 100_000


def small_lookup_join(small: DataFrame, k: int, dim: DataFrame, small_key: str, dim_key: str,
                      how: str = "left") -> DataFrame:
    """Join a result of at most ``k`` rows to a dimension of any size.

    Up to ``MAX_LOOKUP_ROWS`` the rows are computed once (written to the shared checkpoint
    folder); their keys are broadcast to cut down the dimension without shuffling it, and
    its matches, at most one per row because ``dim_key`` is its primary key, are broadcast
    back. A larger ``k`` is an ordinary join with the same result.
    """
    if k > MAX_LOOKUP_ROWS:
        return small.join(dim, small[small_key] == dim[dim_key], how)
    checkpoint_dir(small.sparkSession)
    small = small.checkpoint()
    keys = small.select(F.col(small_key).alias(dim_key)).distinct()
    hit = dim.join(F.broadcast(keys), dim_key, "left_semi")
    return small.join(F.broadcast(hit), small[small_key] == hit[dim_key], how)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


# -- F1, F2: point lookups ---------------------------------------------------

def story_by_short_id(story: DataFrame, short_id: str) -> DataFrame:
    return story.filter(F.col("reddit_short_id") == F.lit(short_id))


def subreddit_by_name(subreddit: DataFrame, name: str) -> DataFrame:
    return subreddit.filter(F.col("name") == F.lit(name))


# -- F3, F4: dimension freshness ---------------------------------------------

def subreddits_recently_seen(subreddit: DataFrame, as_of=AS_OF,
                             expiry_s: int = SUBREDDIT_EXPIRY_S) -> DataFrame:
    """seen_at > as_of − expiry (exclusive)."""
    return subreddit.filter(F.col("seen_at") > X.minus_seconds(X.as_ts(as_of), expiry_s))


def subreddits_stale(subreddit: DataFrame, as_of=AS_OF,
                     interval_s: int = SUBREDDIT_SAMPLE_INTERVAL_S) -> DataFrame:
    """updated_at < as_of − interval/2 (exclusive)."""
    return subreddit.filter(F.col("updated_at") < X.minus_seconds(X.as_ts(as_of), interval_s // 2))


# -- F5/T2, F6/T3 ------------------------------------------------------------

def stories_needing_update(story: DataFrame, as_of=AS_OF, recheck_s: int = STORY_RECHECK_S,
                           track_age_s: int = STORY_TRACK_AGE_S,
                           limit: int | None = UPDATE_WORKERS * PAGE_SIZE) -> DataFrame:
    """checked_at <= as_of − recheck AND discovered_at >= as_of − track_age (both inclusive),
    hottest first. The bound is on *discovered* time (the producer's code, not its doc)."""
    now = X.as_ts(as_of)
    cand = story.filter((F.col("checked_at") <= X.minus_seconds(now, recheck_s))
                        & (F.col("discovered_at") >= X.minus_seconds(now, track_age_s)))
    if limit is None:
        return cand
    return top_k(cand, limit, F.col("hotness").desc(), F.col("id").asc())


def stories_archivable(story: DataFrame, as_of=AS_OF, age_s: int = STORY_TRACK_AGE_S,
                       limit: int | None = None) -> DataFrame:
    """created_at <= as_of − age (inclusive). Batch jobs take all; a limit orders by (created_at, id)."""
    cand = story.filter(F.col("created_at") <= X.minus_seconds(X.as_ts(as_of), age_s))
    if limit is None:
        return cand
    return top_k(cand, limit, F.col("created_at").asc(), F.col("id").asc())


# -- T1 + J1: hottest stories with their community ----------------------------

def hottest_stories(story: DataFrame, subreddit: DataFrame, n: int = 100) -> DataFrame:
    """Top-n by hotness (ties by id), each with its subreddit name (left join after the top-k)."""
    top = top_k(story, n, F.col("hotness").desc(), F.col("id").asc())
    sub = subreddit.select(F.col("id").alias("sub_id"), F.col("name").alias("subreddit_name"))
    return small_lookup_join(top, n, sub, "subreddit", "sub_id", "left").drop("sub_id")


# -- S11: listings over our own story table ---------------------------------

def listing(story: DataFrame, sort: str, time_range: str = "all", as_of=AS_OF,
            limit: int = PAGE_SIZE) -> DataFrame:
    """TOP (score), HOT (hotness), NEW (created_at) listings as of a time.

    The range bounds creation time to (as_of − range, as_of]; like the site, it only
    narrows TOP. CONTROVERSIAL needs vote counts the model lacks and is not offered.
    """
    sort = sort.lower()
    now = X.as_ts(as_of)
    live = story.filter(F.col("created_at") <= now)
    if sort == "top":
        span = TIME_RANGES[time_range.lower()]
        if span is not None:
            live = live.filter(F.col("created_at") > X.minus_seconds(now, span))
        order = [F.col("score").desc(), F.col("id").asc()]
    elif sort == "hot":
        order = [F.col("hotness").desc(), F.col("id").asc()]
    elif sort == "new":
        order = [F.col("created_at").desc(), F.col("id").asc()]
    else:
        raise ValueError(f"unsupported sort {sort!r}")
    return top_k(live, limit, *order)


# -- F9, P1, P2 --------------------------------------------------------------

def with_show_thumbnail(story: DataFrame) -> DataFrame:
    return story.withColumn("show_thumbnail", X.show_thumbnail("thumbnail"))


def summary_columns(story: DataFrame, subreddit: DataFrame) -> DataFrame:
    """P1 (+J2): the 19 summary fields; the subreddit is a required reference (inner join).

    The dimension join is left to the planner: AQE broadcasts it when its measured size
    is under the threshold and falls back to a shuffle join otherwise.
    """
    sub = subreddit.select(F.col("id").alias("_sid"), F.col("name").alias("_sname"))
    j = story.join(sub, story["subreddit"] == sub["_sid"], "inner")
    return j.select(
        F.col("id").alias("story_id"),
        F.col("reddit_short_id").alias("id"),
        "title", "author",
        X.to_millis("created_at").alias("createdAt"),
        X.to_millis("discovered_at").alias("discoveredAt"),
        "domain", "url", "thumbnail", "permalink", "score", "comments", "hotness", "gilded",
        F.col("_sname").alias("subreddit"),
        F.col("is_self").alias("isSelf"),
        F.col("selftext").alias("selfText"),
        F.col("over18").alias("isOver18"),
        F.col("stickied").alias("isStickied"),
        "distinguished",
    )


SUMMARY_FIELDS = ["id", "title", "author", "createdAt", "discoveredAt", "domain", "url", "thumbnail",
                  "permalink", "score", "comments", "hotness", "gilded", "subreddit", "isSelf",
                  "selfText", "isOver18", "isStickied", "distinguished"]


def summary_struct() -> Column:
    return F.struct(*[F.col(f) for f in SUMMARY_FIELDS])


def summary_json(summaries: DataFrame) -> DataFrame:
    """Serialise summaries; NULL fields are written as explicit nulls."""
    return summaries.select("story_id", F.to_json(summary_struct(), {"ignoreNullFields": "false"}).alias("json"))


def lookup_status(requested: DataFrame, story: DataFrame, id_col: str = "short_id") -> DataFrame:
    """Each requested short id → found flag and HTTP-style status (200 / 404)."""
    req = requested.select(F.col(id_col).alias("short_id")).distinct()
    # Cut the story table to the requested ids first (AQE broadcasts them when few), so
    # the left join pairs two small frames instead of shuffling the whole table.
    hit = (story.select(F.col("reddit_short_id").alias("short_id"), F.col("id").alias("story_id"))
           .join(req, "short_id", "left_semi"))
    j = req.join(hit, "short_id", "left")
    return j.select("short_id", "story_id",
                    F.col("story_id").isNotNull().alias("found"),
                    F.when(F.col("story_id").isNotNull(), 200).otherwise(404).alias("status"))


def name_lists(subs: DataFrame, per_request: int = PAGE_SIZE) -> DataFrame:
    """X6: '+'-joined names, one list per request of at most ``per_request`` names (name
    order). Batches come from global positions, so every group is bounded."""
    from storytrack.operators.ordering import ordered_batches
    b = ordered_batches(subs.select("name"), [F.col("name")], per_request)
    return (b.groupBy("batch").agg(F.count(F.lit(1)).alias("n_names"),
                                   F.array_join(F.array_sort(F.collect_list("name")), "+").alias("names")))
