"""Registered queries: name → (Spark callable, DuckDB oracle SQL or None).

Each callable takes (spark, sf_dir), binds the canonical tables from the driver
parquet files and runs library operators over the whole tables. Doubles are rounded
to 6 decimals in the final projection so two engines' last-ulp differences don't
matter; arrays are rendered as comma-joined text (integers exact, doubles '%.6f').
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.functions import scalars as X
from storytrack.operators import cascade as C
from storytrack.operators import history as H
from storytrack.operators import merge as M
from storytrack.operators import metrics as MET
from storytrack.operators import rates as RATES
from storytrack.operators import select as sel
from storytrack.operators import sketches as SK
from storytrack.operators.asof import asof_story_context, asof_subreddit_history
from storytrack.operators.ordering import ordered_batches
from storytrack.plans import counted, jobs
from storytrack.plans.oracle import AS_OF as SQL_AS_OF
from storytrack.plans.oracle import hot, minus_s, with_tables
from storytrack.session import AS_OF
from storytrack.sources import archive as A
from storytrack.sources import ledger as L
from storytrack.sources import payload as P
from storytrack.sources import tables as T
from storytrack.streaming import jobs as STR
from storytrack.streaming import native as NAT
from storytrack.streaming.landing import land_in_order, landings

QUANTILE_RANKS = [(name, q) for q, name in MET.QUANTILES]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(arr, fmt: str | None = None) -> F.Column:
    col = F.col(arr) if isinstance(arr, str) else arr
    if fmt:
        col = F.transform(col, lambda x: F.format_string(fmt, x))
    return F.array_join(col.cast("array<string>"), ",")


# -- M0 ------------------------------------------------------------------------

@register("hotness", with_tables("story") + f"""
SELECT id, score, created_at, round({hot('score', 'created_at')}, 6) AS hotness FROM story""")
def q_hotness(spark, d):
    s = T.stories(spark, d)
    return s.select("id", "score", "created_at", r6(X.hotness("score", "created_at")).alias("hotness"))


@register("hottest_stories", with_tables("story", "sub") + """
, top AS (SELECT * FROM story ORDER BY hotness DESC, id ASC LIMIT 100)
SELECT top.id, top.reddit_short_id, top.score, round(top.hotness, 6) AS hotness, sub.name AS subreddit_name
FROM top LEFT JOIN sub ON top.subreddit = sub.id""")
def q_hottest(spark, d):
    out = sel.hottest_stories(T.stories(spark, d), T.subreddits(spark, d), 100)
    return out.select("id", "reddit_short_id", "score", r6("hotness").alias("hotness"), "subreddit_name")


SUMMARY_SQL_COLS = """s.reddit_short_id AS id, s.title, s.author, epoch_ms(s.created_at) AS "createdAt",
  epoch_ms(s.discovered_at) AS "discoveredAt", s.domain, s.url, s.thumbnail, s.permalink, s.score,
  s.comments, round(s.hotness, 6) AS hotness, s.gilded, sub.name AS subreddit, s.is_self AS "isSelf",
  s.selftext AS "selfText", s.over18 AS "isOver18", s.stickied AS "isStickied", s.distinguished"""


def _summary_out(df: DataFrame) -> DataFrame:
    return df.select(*[r6("hotness").alias("hotness") if c == "hotness" else F.col(c)
                       for c in sel.SUMMARY_FIELDS])


@register("story_summary", with_tables("story", "sub") + f"""
SELECT {SUMMARY_SQL_COLS} FROM story s JOIN sub ON s.subreddit = sub.id""")
def q_summary(spark, d):
    return _summary_out(sel.summary_columns(T.stories(spark, d), T.subreddits(spark, d)))


# -- M1: filters / top-k ------------------------------------------------------------

STORY_BRIEF = ["id", "reddit_short_id", "subreddit", "title", "created_at", "score", "comments", "gilded"]


@register("story_by_short_id", with_tables("story") + f"""
SELECT {', '.join(STORY_BRIEF)} FROM story WHERE reddit_short_id = '42'""")
def q_story_by_id(spark, d):
    return sel.story_by_short_id(T.stories(spark, d), "42").select(*STORY_BRIEF)


@register("subreddit_by_name", with_tables("sub") + """
SELECT id, name, title, seen_at, updated_at FROM sub WHERE name = 'Customer#000000042'""")
def q_sub_by_name(spark, d):
    return sel.subreddit_by_name(T.subreddits(spark, d), "Customer#000000042").select(
        "id", "name", "title", "seen_at", "updated_at")


@register("subreddits_recently_seen", with_tables("sub") + f"""
SELECT id, name, seen_at FROM sub WHERE seen_at > {minus_s(SQL_AS_OF, '10800')}""")
def q_recent(spark, d):
    return sel.subreddits_recently_seen(T.subreddits(spark, d), AS_OF).select("id", "name", "seen_at")


@register("subreddits_stale", with_tables("sub") + f"""
SELECT id, name, updated_at FROM sub WHERE updated_at < {minus_s(SQL_AS_OF, '900')}""")
def q_stale(spark, d):
    return sel.subreddits_stale(T.subreddits(spark, d), AS_OF).select("id", "name", "updated_at")


@register("stories_needing_update", with_tables("story") + f"""
SELECT id, reddit_short_id, round(hotness, 6) AS hotness, checked_at, discovered_at FROM story
WHERE checked_at <= {minus_s(SQL_AS_OF, '120')} AND discovered_at >= {minus_s(SQL_AS_OF, '172800')}
ORDER BY hotness DESC, id ASC LIMIT 400""")
def q_needing_update(spark, d):
    out = sel.stories_needing_update(T.stories(spark, d), AS_OF)
    return out.select("id", "reddit_short_id", r6("hotness").alias("hotness"), "checked_at", "discovered_at")


@register("stories_archivable", with_tables("story") + f"""
SELECT id, reddit_short_id, created_at FROM story WHERE created_at <= {minus_s(SQL_AS_OF, '172800')}""")
def q_archivable(spark, d):
    return sel.stories_archivable(T.stories(spark, d), AS_OF).select("id", "reddit_short_id", "created_at")


LISTING_COLS = "id, reddit_short_id, score, round(hotness, 6) AS hotness, created_at"


def _listing_out(df):
    return df.select("id", "reddit_short_id", "score", r6("hotness").alias("hotness"), "created_at")


@register("listing_top_day", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} AND created_at > {minus_s(SQL_AS_OF, '86400')}
ORDER BY score DESC, id ASC LIMIT 100""")
def q_top_day(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "top", "day", AS_OF))


@register("listing_top_week", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} AND created_at > {minus_s(SQL_AS_OF, '604800')}
ORDER BY score DESC, id ASC LIMIT 100""")
def q_top_week(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "top", "week", AS_OF))


@register("listing_top_hour", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} AND created_at > {minus_s(SQL_AS_OF, '3600')}
ORDER BY score DESC, id ASC LIMIT 100""")
def q_top_hour(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "top", "hour", AS_OF))


@register("listing_top_month", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} AND created_at > {minus_s(SQL_AS_OF, '2592000')}
ORDER BY score DESC, id ASC LIMIT 100""")
def q_top_month(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "top", "month", AS_OF))


@register("listing_top_year", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} AND created_at > {minus_s(SQL_AS_OF, '31536000')}
ORDER BY score DESC, id ASC LIMIT 100""")
def q_top_year(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "top", "year", AS_OF))


@register("listing_top_all", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} ORDER BY score DESC, id ASC LIMIT 100""")
def q_top_all(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "top", "all", AS_OF))


@register("listing_new", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} ORDER BY created_at DESC, id ASC LIMIT 100""")
def q_new(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "new", "all", AS_OF))


@register("listing_hot", with_tables("story") + f"""
SELECT {LISTING_COLS} FROM story WHERE created_at <= {SQL_AS_OF} ORDER BY hotness DESC, id ASC LIMIT 100""")
def q_hot(spark, d):
    return _listing_out(sel.listing(T.stories(spark, d), "hot", "all", AS_OF))


@register("show_thumbnail", with_tables("story") + """
SELECT id, thumbnail, COALESCE(NOT (thumbnail IN ('', 'default', 'self', 'nsfw')), false) AS show_thumbnail
FROM story""")
def q_show_thumb(spark, d):
    return sel.with_show_thumbnail(T.stories(spark, d)).select("id", "thumbnail", "show_thumbnail")


@register("story_lookup_status", with_tables("story", "obs") + """
, req AS (SELECT DISTINCT short_id FROM obs)
SELECT req.short_id, story.id AS story_id, story.id IS NOT NULL AS found,
       CASE WHEN story.id IS NOT NULL THEN 200 ELSE 404 END AS status
FROM req LEFT JOIN story ON req.short_id = story.reddit_short_id""")
def q_lookup_status(spark, d):
    return sel.lookup_status(T.feed_observations(spark, d), T.stories(spark, d))


@register("full_id", with_tables("story") + """
SELECT id, 't3_' || reddit_short_id AS full_id FROM story""")
def q_full_id(spark, d):
    return T.stories(spark, d).select("id", X.full_id("t3", "reddit_short_id").alias("full_id"))


@register("display_time", with_tables("story") + """
SELECT id, strftime(created_at - INTERVAL 5 HOUR, '%-m/%-d/%y %-I:%M %p') AS display_time FROM story""")
def q_display_time(spark, d):
    return T.stories(spark, d).select("id", X.display_time("created_at").alias("display_time"))


@register("discovery_delay", with_tables("story") + """
SELECT id, round((epoch_ms(discovered_at) - epoch_ms(created_at)) / 1000.0, 0) AS discovery_delay_s FROM story""")
def q_discovery_delay(spark, d):
    return H.discovery_delay(T.stories(spark, d))


# -- M2: history -------------------------------------------------------------------

HIST_ARR_SQL = """n_points, ts_ms, scores, hotness, gilded, comments"""


def _arrays_sql(source: str) -> str:
    return f"""
SELECT story, count(*) AS n_points,
  array_to_string(list(epoch_ms(timestamp) ORDER BY timestamp, tie1, tie2, tie3), ',') AS ts_ms,
  array_to_string(list(score ORDER BY timestamp, tie1, tie2, tie3), ',') AS scores,
  array_to_string(list(printf('%.6f', hotness) ORDER BY timestamp, tie1, tie2, tie3), ',') AS hotness,
  array_to_string(list(gilded ORDER BY timestamp, tie1, tie2, tie3), ',') AS gilded,
  array_to_string(list(comments ORDER BY timestamp, tie1, tie2, tie3), ',') AS comments
FROM {source} GROUP BY story"""


def _arrays_out(df: DataFrame, keys=("story",)) -> DataFrame:
    return df.select(*keys, F.size("timestamp").alias("n_points"), joined("timestamp").alias("ts_ms"),
                     joined("score").alias("scores"), joined("hotness", "%.6f").alias("hotness"),
                     joined("gilded").alias("gilded"), joined("comments").alias("comments"))


@register("history_arrays", with_tables("hist") + _arrays_sql("hist"))
def q_history_arrays(spark, d):
    return _arrays_out(H.history_arrays(T.story_history(spark, d)))  # default bound: one chunk per story here


@register("history_arrays_chunked", with_tables("hist") + """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY timestamp, tie1, tie2, tie3) AS seq FROM hist)
SELECT story, (seq - 1) // 3 AS chunk, count(*) AS n_points,
  array_to_string(list(epoch_ms(timestamp) ORDER BY seq), ',') AS ts_ms,
  array_to_string(list(score ORDER BY seq), ',') AS scores,
  array_to_string(list(printf('%.6f', hotness) ORDER BY seq), ',') AS hotness,
  array_to_string(list(gilded ORDER BY seq), ',') AS gilded,
  array_to_string(list(comments ORDER BY seq), ',') AS comments
FROM numbered GROUP BY story, chunk""")
def q_history_arrays_chunked(spark, d):
    return _arrays_out(H.history_arrays(T.story_history(spark, d), max_points=3), ("story", "chunk"))


@register("story_detail", with_tables("story", "sub", "hist") + f"""
, arr AS ({_arrays_sql('hist')})
SELECT s.id AS story_id, {SUMMARY_SQL_COLS},
  COALESCE(arr.n_points, 0) AS n_points, COALESCE(arr.ts_ms, '') AS ts_ms, COALESCE(arr.scores, '') AS scores,
  COALESCE(arr.hotness, '') AS h_hotness, COALESCE(arr.gilded, '') AS h_gilded, COALESCE(arr.comments, '') AS h_comments
FROM story s JOIN sub ON s.subreddit = sub.id LEFT JOIN arr ON arr.story = s.id""")
def q_story_detail(spark, d):
    det = H.story_detail(T.stories(spark, d), T.subreddits(spark, d), T.story_history(spark, d))
    return det.select(
        "story_id", *[r6("hotness").alias("hotness") if c == "hotness" else F.col(c) for c in sel.SUMMARY_FIELDS],
        F.size("history.timestamp").alias("n_points"), joined("history.timestamp").alias("ts_ms"),
        joined("history.score").alias("scores"), joined("history.hotness", "%.6f").alias("h_hotness"),
        joined("history.gilded").alias("h_gilded"), joined("history.comments").alias("h_comments"))


@register("latest_state", with_tables("hist") + """
SELECT story, timestamp AS updated_at, score, round(hotness, 6) AS hotness, comments, gilded, n_samples FROM (
  SELECT *, row_number() OVER (PARTITION BY story ORDER BY timestamp DESC, tie1 DESC, tie2 DESC, tie3 DESC) AS rn,
         count(*) OVER (PARTITION BY story) AS n_samples FROM hist) WHERE rn = 1""")
def q_latest_state(spark, d):
    out = H.latest_state(T.story_history(spark, d))
    return out.select("story", "updated_at", "score", r6("hotness").alias("hotness"), "comments", "gilded",
                      "n_samples")


@register("first_state", with_tables("hist") + """
SELECT story, timestamp AS discovered_at, score, round(hotness, 6) AS hotness, comments, gilded FROM (
  SELECT *, row_number() OVER (PARTITION BY story ORDER BY timestamp, tie1, tie2, tie3) AS rn FROM hist) WHERE rn = 1""")
def q_first_state(spark, d):
    out = H.first_state(T.story_history(spark, d))
    return out.select("story", "discovered_at", "score", r6("hotness").alias("hotness"), "comments", "gilded")


@register("story_history_ordered", with_tables("hist") + """
SELECT story, timestamp, tie1, tie2, tie3, score,
       row_number() OVER (PARTITION BY story ORDER BY timestamp, tie1, tie2, tie3) AS seq FROM hist""")
def q_history_ordered(spark, d):
    out = H.history_ordered(T.story_history(spark, d, with_hotness=False))
    return out.select("story", "timestamp", "tie1", "tie2", "tie3", "score", "seq")


@register("history_offsets", with_tables("hist", "story") + """
SELECT h.story, h.timestamp, h.tie1, h.tie2, h.tie3,
       (epoch_ms(h.timestamp) - epoch_ms(s.created_at)) / 1000.0 AS offset_s
FROM hist h JOIN story s ON h.story = s.id""")
def q_history_offsets(spark, d):
    out = H.history_offsets(T.story_history(spark, d, with_hotness=False), T.stories(spark, d))
    return out.select("story", "timestamp", "tie1", "tie2", "tie3", "offset_s")


# -- M3: payloads, paging, de-dup, feed union ----------------------------------------

def _pages(spark, d):
    return T.landed_listing_pages(spark, d)


@register("parse_listing", with_tables("obs") + """
, pg AS (SELECT feed, page, tick, arrival, kind,
                'Listing' AS env_kind,
                't3_' || arg_max(short_id, pos) OVER (PARTITION BY feed, page) AS after,
                CAST(row_number() OVER (PARTITION BY feed, page ORDER BY pos) - 1 AS INTEGER) AS pos
         FROM obs)
SELECT feed, page, tick, '' AS before, after, pos, kind FROM pg""")
def q_parse_listing(spark, d):
    return P.parse_listing(_pages(spark, d)).select("feed", "page", "tick", "before", "after", "pos", "kind")


@register("parse_thing", with_tables("parsed") + """
SELECT feed, page, pos, short_id AS id, title, subreddit_name AS subreddit FROM parsed""")
def q_parse_thing(spark, d):
    things = P.parse_things(P.parse_listing(_pages(spark, d)))
    return things.select("feed", "page", "pos", F.col("thing.id").alias("id"), F.col("thing.title").alias("title"),
                         F.col("thing.subreddit").alias("subreddit"))


@register("parse_rejects", with_tables("parsed") + """
SELECT feed, page, pos, kind, 'wrong_kind' AS reason FROM parsed_all WHERE kind <> 't3'""")
def q_parse_rejects(spark, d):
    return P.thing_rejects(P.parse_listing(_pages(spark, d))).select("feed", "page", "pos", "kind", "reason")


# Damaged landings: every 7th page is cut short, every 11th is an envelope of another kind, and
# children lose their title, get a text score or a creation time in microseconds.
def _damaged_pages(spark, d):
    n, v = F.col("page"), F.col("value")
    return _pages(spark, d).withColumn("value", F.when(n % 7 == 0, F.substr(v, F.lit(1), F.length(v) - 3))
        .when(n % 11 == 0, F.replace(v, F.lit('"Listing"'), F.lit('"more"')))
        .when(n % 13 == 0, F.replace(v, F.lit('"title":'), F.lit('"other":')))
        .when(n % 17 == 0, F.regexp_replace(v, r'"score":(\d+)', r'"score":"n$1"'))
        .when(n % 19 == 0, F.regexp_replace(v, r'"created_utc":[0-9.E]+', r'"created_utc":1.4E15')).otherwise(v))


@register("listing_page_rejects", with_tables("parsed") + """
SELECT DISTINCT feed, page, tick, CASE WHEN page % 7 = 0 THEN 'malformed' ELSE 'not_listing' END AS reason
FROM parsed_all WHERE page % 7 = 0 OR page % 11 = 0""")
def q_page_rejects(spark, d):
    return P.listing_page_rejects(_damaged_pages(spark, d)).select("feed", "page", "tick", "reason")


@register("thing_rejects_by_reason", with_tables("parsed") + """
, bad AS (SELECT CASE WHEN kind <> 't3' THEN 'wrong_kind' WHEN page % 13 = 0 THEN 'missing_field'
                      WHEN page % 17 = 0 AND rawscore IS NOT NULL THEN 'bad_value'
                      WHEN page % 17 <> 0 AND page % 19 = 0 THEN 'bad_value' END AS reason
          FROM (SELECT p.*, o.score AS rawscore FROM parsed_all p JOIN obs o USING (arrival))
          WHERE page % 7 <> 0 AND page % 11 <> 0)
SELECT reason, count(*) AS n FROM bad WHERE reason IS NOT NULL GROUP BY reason""")
def q_thing_rejects(spark, d):
    rejects = P.thing_rejects(P.parse_listing(_damaged_pages(spark, d)))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("about_rejects", with_tables("abouts") + """
SELECT name AS requested, 'wrong_kind' AS reason FROM abouts WHERE CAST(reddit_short_id AS BIGINT) % 5 = 0
UNION ALL SELECT name, 'malformed' FROM abouts
WHERE CAST(reddit_short_id AS BIGINT) % 5 <> 0 AND CAST(reddit_short_id AS BIGINT) % 9 = 0""")
def q_about_rejects(spark, d):
    key = F.regexp_extract("requested", "([0-9]+)$", 1).cast("long")
    landed = T.landed_subreddit_abouts(spark, d, AS_OF).withColumn("value", F.when(
        key % 5 == 0, F.replace("value", F.lit('"t5"'), F.lit('"t1"'))).when(
        key % 9 == 0, F.replace("value", F.lit('"data":{'), F.lit('"data":"none","was":{'))).otherwise(F.col("value")))
    return P.about_rejects(landed).select("requested", "reason")


STORY_PROJ = ["feed", "page", "pos", "tick", "short_id", "title", "author", "created_at", "domain", "comments",
              "gilded", "score", "hotness", "permalink", "selftext", "subreddit_name", "thumbnail", "url",
              "distinguished", "is_self", "over18", "stickied"]


@register("story_projection", with_tables("parsed") + f"""
SELECT {', '.join('round(hotness, 6) AS hotness' if c == 'hotness' else c for c in STORY_PROJ)} FROM parsed""")
def q_story_projection(spark, d):
    return P.parse_story_pages(_pages(spark, d)).select(
        *[r6("hotness").alias("hotness") if c == "hotness" else F.col(c) for c in STORY_PROJ])


SUB_PROJ = ["name", "status", "reddit_short_id", "title", "summary", "description", "subreddit_type",
            "submission_type", "url", "created", "comment_hide_mins", "active", "subscribers", "over18"]


@register("subreddit_projection", with_tables("abouts") + f"""
SELECT {', '.join(SUB_PROJ)} FROM abouts""")
def q_subreddit_projection(spark, d):
    return P.parse_about(T.landed_subreddit_abouts(spark, d, AS_OF)).select(*SUB_PROJ)


# The walk of one scrape (feed, tick): pages are read in order until one adds no new story;
# ``seen`` is how many distinct stories the pages up to a page hold.
PAGED_SQL = """
, firsts AS (SELECT feed, tick, short_id, min(page * 1000 + pos) AS place FROM parsed GROUP BY ALL),
walk AS (SELECT p.feed, p.tick, p.page,
                (SELECT count(*) FROM firsts f WHERE f.feed = p.feed AND f.tick = p.tick AND f.place < (p.page + 1) * 1000)
                AS seen FROM (SELECT DISTINCT feed, tick, page FROM parsed) p),
steps AS (SELECT *, seen > coalesce(lag(seen) OVER (PARTITION BY feed, tick ORDER BY page), 0) AS grew FROM walk),
read_pages AS (SELECT * FROM (SELECT *, bool_and(grew) OVER (PARTITION BY feed, tick ORDER BY page) AS going FROM steps)
               WHERE going),
ranked AS (SELECT f.feed, f.tick, f.short_id, CAST(f.place // 1000 AS BIGINT) AS page, CAST(f.place % 1000 AS INTEGER) AS pos,
                  row_number() OVER (PARTITION BY f.feed, f.tick ORDER BY f.place) AS rank
           FROM firsts f JOIN read_pages r ON r.feed = f.feed AND r.tick = f.tick AND r.page = f.place // 1000)
"""


@register("paged_listing", with_tables("parsed") + PAGED_SQL + """
SELECT feed, tick, rank, page, pos, short_id FROM ranked WHERE rank <= 250""")
def q_paged_listing(spark, d):
    pages = _pages(spark, d)
    return M.paged_listing(P.parse_story_pages(pages), 250, pages=pages)


FRONT_SQL = PAGED_SQL + """
, front AS (SELECT tick, short_id FROM ranked WHERE feed = 'hot' AND rank <= 300
            AND tick = (SELECT max(tick) FROM parsed WHERE feed = 'hot')),
fp AS (SELECT DISTINCT p.subreddit_name AS name FROM parsed p JOIN front f USING (tick, short_id) WHERE p.feed = 'hot')
"""


@register("front_page_subreddits", with_tables("parsed") + FRONT_SQL + """
SELECT name FROM fp""")
def q_front_page(spark, d):
    return _front_names(spark, d)


def _front_names(spark, d):
    parsed = P.parse_story_pages(_pages(spark, d))
    return M.front_page_subreddits(parsed.filter(F.col("feed") == "hot"), 300)


@register("subreddit_lookup", with_tables("parsed", "abouts") + FRONT_SQL + """
, asked AS (SELECT name FROM fp UNION SELECT name FROM abouts WHERE status = 403 UNION SELECT 'nobody')
SELECT k.name, a.status, coalesce(a.status = 200, false) AS found,
  CASE WHEN a.status = 200 THEN a.title END AS title, CASE WHEN a.status = 200 THEN a.subscribers END AS subscribers
FROM asked k LEFT JOIN abouts a ON a.name = k.name""")
def q_subreddit_lookup(spark, d):
    """Lookup by name over landed about payloads: found, forbidden and never landed ones."""
    landed = T.landed_subreddit_abouts(spark, d, AS_OF)
    names = (_front_names(spark, d).select("name")
             .union(landed.filter(F.col("status") == 403).select("requested"))
             .union(spark.createDataFrame([("nobody",)], "name string")))
    return P.lookup_about(landed, names).select("name", "status", "found", "title", "subscribers")


@register("stories_by_id", with_tables("parsed", "story") + """
, hits AS (SELECT p.*, row_number() OVER (PARTITION BY short_id ORDER BY tick DESC, page DESC, pos DESC, feed DESC) AS rn
           FROM parsed p WHERE short_id IN (SELECT reddit_short_id FROM story))
SELECT short_id, tick, feed, page, pos, score, comments, gilded, round(hotness, 6) AS hotness FROM hits WHERE rn = 1""")
def q_stories_by_id(spark, d):
    landed = jobs.landed_snapshot(_pages(spark, d))
    ids = T.stories(spark, d).select(F.col("reddit_short_id").alias("short_id"))
    out = M.stories_by_id(landed, ids)
    return out.select("short_id", "tick", "feed", "page", "pos", "score", "comments", "gilded",
                      r6("hotness").alias("hotness"))


@register("dedup_first_seen", with_tables("obs") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY feed, tick, short_id ORDER BY page, pos) AS rn,
               count(*) OVER (PARTITION BY feed, tick, short_id) AS copies FROM obs WHERE kind = 't3')
SELECT feed, tick, short_id, page, pos, arrival, score, copies FROM r WHERE rn = 1""")
def q_dedup_first(spark, d):
    obs = T.feed_observations(spark, d).filter(F.col("kind") == "t3")
    out = M.dedup_first_seen(obs.select("feed", "tick", "short_id", "page", "pos", "arrival", "score"))
    return out.select("feed", "tick", "short_id", "page", "pos", "arrival", "score", "copies")


@register("dedup_last_wins", with_tables("obs") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY tick, short_id ORDER BY arrival DESC) AS rn FROM obs WHERE kind = 't3')
SELECT tick, short_id, arrival, feed, score FROM r WHERE rn = 1""")
def q_dedup_last(spark, d):
    obs = T.feed_observations(spark, d).filter(F.col("kind") == "t3")
    out = M.dedup_last_wins(obs.select("tick", "short_id", "arrival", "feed", "score"), keys=("tick", "short_id"))
    return out.select("tick", "short_id", "arrival", "feed", "score")


@register("union_feeds", with_tables("feedu") + """
SELECT tick, short_id, feed, page, pos, score, round(hotness, 6) AS hotness, in_new FROM feedu""")
def q_union_feeds(spark, d):
    parsed = P.parse_story_pages(_pages(spark, d)).drop("before", "after", "kind")
    out = M.union_feeds(parsed)
    return out.select("tick", "short_id", "feed", "page", "pos", "score", r6("hotness").alias("hotness"), "in_new")


@register("name_list", with_tables("sub") + f"""
, r AS (SELECT name, (row_number() OVER (ORDER BY name) - 1) // 100 AS batch FROM sub
        WHERE seen_at > {minus_s(SQL_AS_OF, '10800')})
SELECT batch, count(*) AS n_names, string_agg(name, '+' ORDER BY name) AS names FROM r GROUP BY batch""")
def q_name_list(spark, d):
    recent = sel.subreddits_recently_seen(T.subreddits(spark, d), AS_OF)
    return sel.name_lists(recent)


# -- M4: discovery / update merges ----------------------------------------------------

def _discovery(spark, d):
    return jobs.discovery(_pages(spark, d), T.stories(spark, d), T.subreddits(spark, d), AS_OF)


DISC_SQL = f"""
, matched AS (SELECT f.*, s.id AS story_id FROM feedu f JOIN story s ON f.short_id = s.reddit_short_id),
unmatched AS (SELECT f.* FROM feedu f WHERE NOT EXISTS (SELECT 1 FROM story s WHERE s.reddit_short_id = f.short_id)),
recent AS (SELECT name FROM sub WHERE seen_at > {minus_s(SQL_AS_OF, '10800')}),
accepted AS (SELECT u.* FROM unmatched u WHERE EXISTS (SELECT 1 FROM recent r WHERE r.name = u.subreddit_name)),
rejected AS (SELECT u.* FROM unmatched u WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.name = u.subreddit_name)),
firsts AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY short_id ORDER BY tick) AS _r FROM accepted a) WHERE _r = 1),
newst AS (SELECT (SELECT max(id) FROM story) + row_number() OVER (ORDER BY f.tick, f.short_id) AS id,
                 f.short_id AS reddit_short_id, sub.id AS subreddit, f.created_at, f.tick AS discovered_at,
                 f.score, f.comments, f.gilded, f.hotness
          FROM firsts f JOIN sub ON sub.name = f.subreddit_name),
samples AS (SELECT story_id AS story, tick AS timestamp, score, comments, gilded, hotness FROM matched
            UNION ALL
            SELECT n.id, a.tick, a.score, a.comments, a.gilded, a.hotness
            FROM accepted a JOIN newst n ON a.short_id = n.reddit_short_id)
"""
DISC_TABLES = ("story", "sub", "feedu")


@register("scrape_matched", with_tables(*DISC_TABLES) + DISC_SQL + """
SELECT tick, short_id, story_id, score, comments, gilded, round(hotness, 6) AS hotness FROM matched""")
def q_scrape_matched(spark, d):
    m = _discovery(spark, d).matched
    return m.select("tick", "short_id", "story_id", "score", "comments", "gilded", r6("hotness").alias("hotness"))


@register("scrape_unmatched", with_tables(*DISC_TABLES) + DISC_SQL + """
SELECT tick, short_id, subreddit_name FROM unmatched""")
def q_scrape_unmatched(spark, d):
    return _discovery(spark, d).unmatched.select("tick", "short_id", "subreddit_name")


@register("guard_accept", with_tables(*DISC_TABLES) + DISC_SQL + """
SELECT tick, short_id, subreddit_name FROM accepted""")
def q_guard_accept(spark, d):
    return _discovery(spark, d).accepted.select("tick", "short_id", "subreddit_name")


@register("guard_reject", with_tables(*DISC_TABLES) + DISC_SQL + """
SELECT tick, short_id, subreddit_name FROM rejected""")
def q_guard_reject(spark, d):
    return _discovery(spark, d).rejected.select("tick", "short_id", "subreddit_name")


@register("discover_insert", with_tables(*DISC_TABLES) + DISC_SQL + """
SELECT id, reddit_short_id, subreddit, created_at, discovered_at, score, comments, gilded,
       round(hotness, 6) AS hotness FROM newst""")
def q_discover_insert(spark, d):
    n = _discovery(spark, d).new_stories
    return n.select("id", "reddit_short_id", "subreddit", "created_at", "discovered_at", "score", "comments",
                    "gilded", r6("hotness").alias("hotness"))


@register("history_append", with_tables(*DISC_TABLES) + DISC_SQL + """
SELECT story, timestamp, score, comments, gilded, round(hotness, 6) AS hotness FROM samples""")
def q_history_append(spark, d):
    smp = _discovery(spark, d).samples
    return smp.select("story", "timestamp", "score", "comments", "gilded", r6("hotness").alias("hotness"))


@register("apply_observations", with_tables(*DISC_TABLES) + DISC_SQL + """
, newest AS (SELECT * FROM (SELECT story_id, tick AS ts, score, hotness, comments, gilded,
                                   row_number() OVER (PARTITION BY story_id ORDER BY tick DESC) AS rn FROM matched)
             WHERE rn = 1)
SELECT s.id,
  CASE WHEN n.ts >= s.updated_at THEN n.score ELSE s.score END AS score,
  round(CASE WHEN n.ts >= s.updated_at THEN n.hotness ELSE s.hotness END, 6) AS hotness,
  CASE WHEN n.ts >= s.updated_at THEN n.comments ELSE s.comments END AS comments,
  CASE WHEN n.ts >= s.updated_at THEN n.gilded ELSE s.gilded END AS gilded,
  CASE WHEN n.ts >= s.updated_at THEN n.ts ELSE s.updated_at END AS updated_at,
  CASE WHEN n.ts >= s.updated_at THEN n.ts ELSE s.checked_at END AS checked_at
FROM story s LEFT JOIN newest n ON n.story_id = s.id""")
def q_apply_observations(spark, d):
    a = _discovery(spark, d).story_after
    return a.select("id", "score", r6("hotness").alias("hotness"), "comments", "gilded", "updated_at", "checked_at")


# The update pass runs at noon of the second day of scrapes, after the first day's discovery:
# its stale stories are those discovered on the first day, its records those landed since.
UPD_AS_OF = dt.datetime(2024, 1, 2, 12, 0, 0)
UPD_FIRST_DAY = dt.datetime(2024, 1, 1)
UPD_SQL_AS_OF = "TIMESTAMP '2024-01-02 12:00:00'"
UPD_SQL = f"""
, day1 AS (SELECT * FROM feedu WHERE tick <= TIMESTAMP '2024-01-01 00:00:00'),
new1 AS (SELECT (SELECT max(id) FROM story) + row_number() OVER (ORDER BY f.tick, f.short_id) AS id,
                f.short_id AS reddit_short_id, f.score, f.hotness, f.comments, f.gilded,
                f.tick AS discovered_at, f.tick AS updated_at, f.tick AS checked_at
         FROM day1 f JOIN sub ON sub.name = f.subreddit_name
         WHERE sub.seen_at > {minus_s(SQL_AS_OF, '10800')}
           AND NOT EXISTS (SELECT 1 FROM story s WHERE s.reddit_short_id = f.short_id)),
st AS (SELECT s.id, s.reddit_short_id, coalesce(f.score, s.score) AS score, coalesce(f.hotness, s.hotness) AS hotness,
              coalesce(f.comments, s.comments) AS comments, coalesce(f.gilded, s.gilded) AS gilded, s.discovered_at,
              coalesce(f.tick, s.updated_at) AS updated_at, coalesce(f.tick, s.checked_at) AS checked_at
       FROM story s LEFT JOIN day1 f ON f.short_id = s.reddit_short_id
       UNION ALL SELECT * FROM new1),
cand AS (SELECT * FROM st WHERE checked_at <= {minus_s(UPD_SQL_AS_OF, '120')}
         AND discovered_at >= {minus_s(UPD_SQL_AS_OF, '172800')}),
ret AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.short_id
                              ORDER BY p.tick DESC, p.page DESC, p.pos DESC, p.feed DESC) AS rn
                       FROM parsed p JOIN cand c ON c.reddit_short_id = p.short_id
                       WHERE p.tick > c.checked_at AND p.tick <= {UPD_SQL_AS_OF}) WHERE rn = 1),
outc AS (SELECT c.id, c.reddit_short_id, r.score AS new_score, r.comments AS new_comments, r.gilded AS new_gilded,
                r.hotness AS new_hotness,
                CASE WHEN r.score IS NOT NULL THEN 'updated' ELSE 'checked' END AS outcome
         FROM cand c LEFT JOIN ret r ON r.short_id = c.reddit_short_id)
"""
UPD_TABLES = ("story", "sub", "feedu")


def _update_from(spark, d):
    """The story table before the update pass, and the pass."""
    pages = _pages(spark, d)
    first = jobs.discovery(pages.filter(F.col("tick") <= F.lit(UPD_FIRST_DAY)), T.stories(spark, d),
                           T.subreddits(spark, d), AS_OF)
    story = first.story_after.unionByName(first.new_stories)
    return story, jobs.update_pass(story, jobs.landed_snapshot(pages), UPD_AS_OF)


def _update(spark, d):
    return _update_from(spark, d)[1]


@register("check_outcomes", with_tables(*UPD_TABLES) + UPD_SQL + """
SELECT id, reddit_short_id, outcome, new_score, new_comments, new_gilded, round(new_hotness, 6) AS new_hotness
FROM outc""")
def q_check_outcomes(spark, d):
    o = _update(spark, d).outcomes
    return o.select("id", "reddit_short_id", "outcome", "new_score", "new_comments", "new_gilded",
                    r6("new_hotness").alias("new_hotness"))


@register("update_pass_samples", with_tables(*UPD_TABLES) + UPD_SQL + f"""
SELECT id AS story, {UPD_SQL_AS_OF} AS timestamp, new_score AS score, round(new_hotness, 6) AS hotness,
       new_comments AS comments, new_gilded AS gilded FROM outc WHERE outcome = 'updated'""")
def q_update_samples(spark, d):
    smp = _update(spark, d).samples
    return smp.select("story", "timestamp", "score", r6("hotness").alias("hotness"), "comments", "gilded")


@register("update_pass_state", with_tables(*UPD_TABLES) + UPD_SQL + f"""
SELECT s.id,
  CASE WHEN o.outcome = 'updated' THEN o.new_score ELSE s.score END AS score,
  round(CASE WHEN o.outcome = 'updated' THEN o.new_hotness ELSE s.hotness END, 6) AS hotness,
  CASE WHEN o.outcome = 'updated' THEN {UPD_SQL_AS_OF} ELSE s.updated_at END AS updated_at,
  CASE WHEN o.outcome IS NOT NULL THEN {UPD_SQL_AS_OF} ELSE s.checked_at END AS checked_at
FROM st s LEFT JOIN outc o ON o.id = s.id""")
def q_update_state(spark, d):
    a = _update(spark, d).story_after
    return a.select("id", "score", r6("hotness").alias("hotness"), "updated_at", "checked_at")


@register("ordered_batches", with_tables("story") + f"""
, r AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS p FROM story
        WHERE created_at <= {minus_s(SQL_AS_OF, '172800')})
SELECT id, p // 50 AS batch, CAST(p % 50 AS INTEGER) AS pos_in_batch FROM r""")
def q_ordered_batches(spark, d):
    arch = sel.stories_archivable(T.stories(spark, d), AS_OF).select("id", "created_at")
    return ordered_batches(arch, [F.col("created_at"), F.col("id")], 50).select("id", "batch", "pos_in_batch")


# Communities that the subreddit table lacks here, so that the front page can insert some.
UNSEEN_EVERY = 7


@register("subreddit_upsert", with_tables("parsed", "sub", "abouts") + FRONT_SQL + f"""
, held AS (SELECT * FROM sub WHERE id % {UNSEEN_EVERY} <> 0)
SELECT s.id, s.name, {SQL_AS_OF} AS seen_at, 'seen' AS action FROM held s WHERE s.name IN (SELECT name FROM fp)
UNION ALL
SELECT (SELECT max(id) FROM held) + row_number() OVER (ORDER BY a.name) AS id, a.name, {SQL_AS_OF} AS seen_at,
       'inserted' AS action
FROM abouts a WHERE a.status = 200 AND a.name IN (SELECT name FROM fp) AND a.name NOT IN (SELECT name FROM held)""")
def q_subreddit_upsert(spark, d):
    abouts = P.parse_about(T.landed_subreddit_abouts(spark, d, AS_OF))
    held = T.subreddits(spark, d).filter(F.col("id") % UNSEEN_EVERY != 0)
    snap = M.subreddit_upsert(_front_names(spark, d), held, abouts, AS_OF)
    return snap.filter(F.col("action").isNotNull()).select("id", "name", "seen_at", "action")


@register("subreddit_history_append", with_tables("sub", "abouts") + f"""
SELECT s.id AS subreddit, s.name, {SQL_AS_OF} AS timestamp, a.subscribers, a.active, a.comment_hide_mins
FROM sub s JOIN abouts a ON a.name = s.name
WHERE s.updated_at < {minus_s(SQL_AS_OF, '900')} AND a.status = 200""")
def q_subreddit_history_append(spark, d):
    stale = sel.subreddits_stale(T.subreddits(spark, d), AS_OF)
    abouts = P.parse_about(T.landed_subreddit_abouts(spark, d, AS_OF))
    return M.subreddit_history_append(stale, abouts, AS_OF)


@register("run_counters", with_tables(*DISC_TABLES, "abouts") + DISC_SQL + UPD_SQL + FRONT_SQL.replace("firsts", "wfirsts") + f"""
, held AS (SELECT * FROM sub WHERE id % {UNSEEN_EVERY} <> 0)
SELECT 'feed_stories' AS counter, count(*) AS n FROM feedu
UNION ALL SELECT 'auto_updated', count(*) FROM matched
UNION ALL SELECT 'discovered', count(*) FROM newst
UNION ALL SELECT 'guard_rejected', count(*) FROM rejected
UNION ALL SELECT 'samples_appended', count(*) FROM samples
UNION ALL SELECT 'update_checked', count(*) FROM outc
UNION ALL SELECT 'update_updated', count(*) FROM outc WHERE outcome = 'updated'
UNION ALL SELECT 'update_bailed', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM cand
UNION ALL SELECT 'archivable', count(*) FROM story WHERE created_at <= {minus_s(SQL_AS_OF, '172800')}
UNION ALL SELECT 'archived', count(*) FROM story WHERE created_at <= {minus_s(SQL_AS_OF, '172800')}
  AND subreddit IN (SELECT id FROM sub)
UNION ALL SELECT 'subreddits_seen', count(*) FROM held WHERE name IN (SELECT name FROM fp)
UNION ALL SELECT 'subreddits_discovered', count(*) FROM abouts WHERE status = 200 AND name IN (SELECT name FROM fp)
  AND name NOT IN (SELECT name FROM held)
UNION ALL SELECT 'subreddits_updated', count(*) FROM sub s JOIN abouts a ON a.name = s.name
  WHERE s.updated_at < {minus_s(SQL_AS_OF, '900')} AND a.status = 200""")
def q_run_counters(spark, d):
    disc = _discovery(spark, d)
    upd = _update(spark, d)
    story, sub = T.stories(spark, d), T.subreddits(spark, d)
    abouts = P.parse_about(T.landed_subreddit_abouts(spark, d, AS_OF))
    held = sub.filter(F.col("id") % UNSEEN_EVERY != 0)
    doomed = sel.stories_archivable(story, AS_OF)
    # Frames whose rows differ by outcome are scanned once and counted per outcome.
    upserts = M.subreddit_upsert(_front_names(spark, d), held, abouts, AS_OF)
    one = F.lit(True)
    return MET.run_counters(
        (disc.feed_stories, {"feed_stories": one}), (disc.matched, {"auto_updated": one}),
        (disc.new_stories, {"discovered": one}), (disc.rejected, {"guard_rejected": one}),
        (disc.samples, {"samples_appended": one}),
        (upd.outcomes, {"update_checked": one, "update_updated": F.col("outcome") == "updated"}),
        (upd.candidates.agg(F.count(F.lit(1)).alias("n")), {"update_bailed": F.col("n") == 0}),
        (doomed, {"archivable": one}),
        (doomed.join(sub.select(F.col("id").alias("subreddit")), "subreddit", "left_semi"), {"archived": one}),
        (upserts, {"subreddits_seen": F.col("action") == "seen",
                   "subreddits_discovered": F.col("action") == "inserted"}),
        (M.subreddit_history_append(sel.subreddits_stale(sub, AS_OF), abouts, AS_OF), {"subreddits_updated": one}))


# -- M5: archive, cascading deletes -------------------------------------------------

def _archive_run(spark, d, batch_id=None):
    root = A.scratch_path(spark, "archive")
    run = jobs.archive(spark, T.stories(spark, d), T.subreddits(spark, d), T.story_history(spark, d),
                       root, AS_OF, batch_id=batch_id)
    return root, run


ARCH_SQL = f"""
, doomed AS (SELECT * FROM story WHERE created_at <= {minus_s(SQL_AS_OF, '172800')}),
agg AS (SELECT story, count(*) AS n_points, min(epoch_ms(timestamp)) AS first_ts, max(epoch_ms(timestamp)) AS last_ts,
               sum(score) AS score_sum FROM hist GROUP BY story),
recs AS (SELECT strftime(s.created_at, '%Y-%m-%d') AS archive_date, s.reddit_short_id AS id,
                epoch_ms(s.created_at) AS "createdAt", sub.name AS subreddit, s.score,
                COALESCE(a.n_points, 0) AS n_points, a.first_ts, a.last_ts, COALESCE(a.score_sum, 0) AS score_sum
         FROM doomed s JOIN sub ON s.subreddit = sub.id LEFT JOIN agg a ON a.story = s.id)
"""
ARCH_TABLES = ("story", "sub", "hist")


@register("archive_records", with_tables(*ARCH_TABLES) + ARCH_SQL + "SELECT * FROM recs")
def q_archive_records(spark, d):
    root, _ = _archive_run(spark, d)
    return A.record_columns(A.read_archive(spark, root, batched=True))


@register("archive_roundtrip", with_tables(*ARCH_TABLES) + ARCH_SQL + """
SELECT archive_date, id, true AS same FROM recs""")
def q_archive_roundtrip(spark, d):
    root, run = _archive_run(spark, d)
    back = A.read_archive(spark, root, batched=True).select(
        "archive_date", F.col("summary.id").alias("id"), F.struct("summary", "history").alias("_b"))
    mem = A.archive_frame(run.details).select(
        "archive_date", F.col("summary.id").alias("id"), F.struct("summary", "history").alias("_m"))
    j = back.join(mem, ["archive_date", "id"], "full_outer")
    return j.select("archive_date", "id", F.coalesce(F.col("_b") == F.col("_m"), F.lit(False)).alias("same"))


@register("archive_day_counts", with_tables(*ARCH_TABLES) + ARCH_SQL + """
SELECT archive_date, count(*) AS n_records FROM recs GROUP BY archive_date""")
def q_archive_day_counts(spark, d):
    doomed = sel.stories_archivable(T.stories(spark, d), AS_OF)
    hist = T.story_history(spark, d).join(doomed.select(F.col("id").alias("story")), "story", "left_semi")
    return A.archive_day_counts(H.story_detail(doomed, T.subreddits(spark, d), hist))


@register("archive_compact", with_tables(*ARCH_TABLES) + ARCH_SQL + """
SELECT archive_date, count(*) AS n_records, sum(n_points) AS n_points FROM recs GROUP BY archive_date""")
def q_archive_compact(spark, d):
    # An at-least-once run: the same stories archived three times (a crash between write and
    # delete), without samples, with some of them and with all; compaction keeps one record
    # per story, day and chunk, the one with most samples.
    story, sub, hist = T.stories(spark, d), T.subreddits(spark, d), T.story_history(spark, d)
    root = A.scratch_path(spark, "archive")
    doomed = sel.stories_archivable(story, AS_OF)
    held = hist.join(doomed.select(F.col("id").alias("story")), "story", "left_semi")
    for batch, part in enumerate((held.limit(0), held, held.filter(F.col("tie1") <= 2))):
        A.write_archive(H.story_detail(doomed, sub, part), root, batch_id=batch)
    out = A.compact_archive(spark, root, A.scratch_path(spark, "composed"), batched=True)
    return out.groupBy("archive_date").agg(F.count(F.lit(1)).alias("n_records"),
                                           F.sum(F.size("history.timestamp")).alias("n_points"))


LEDGER_BATCH = 896659200000  # AS_OF in milliseconds


def _committed(spark, d):
    """The finished stories archived with a ledger; (root, detail records)."""
    root = A.scratch_path(spark, "archive")
    doomed = sel.stories_archivable(T.stories(spark, d), AS_OF)
    hist = T.story_history(spark, d).join(doomed.select(F.col("id").alias("story")), "story", "left_semi")
    details = H.story_detail(doomed, T.subreddits(spark, d), hist)
    L.write_committed(spark, details, root, LEDGER_BATCH)
    return root, details


@register("archive_ledger", with_tables(*ARCH_TABLES) + ARCH_SQL + f"""
SELECT archive_date AS day, {LEDGER_BATCH} AS batch, count(*) AS records, true AS whole FROM recs GROUP BY archive_date""")
def q_archive_ledger(spark, d):
    """K1: one row per committed day; whole: its files hold what was committed."""
    root, _ = _committed(spark, d)
    broken = L.damaged(spark, root).select("day", F.lit(True).alias("_broken"))
    held = L.read_ledger(spark, root).join(broken, "day", "left")
    return held.select("day", "batch", "records", F.col("_broken").isNull().alias("whole"))


@register("archive_compact_new", with_tables(*ARCH_TABLES) + ARCH_SQL + """
, twice AS (SELECT max(archive_date) AS day FROM recs)
SELECT archive_date, count(*) AS n_records, sum(n_points) AS n_points,
       CASE WHEN archive_date = (SELECT day FROM twice) THEN 2 ELSE 1 END AS times_rewritten
FROM recs GROUP BY archive_date""")
def q_archive_compact_new(spark, d):
    """K4 by marks: all days once, then only the last day, whose stories came again without
    samples (their fuller records stay), then none."""
    root, details = _committed(spark, d)
    out = A.scratch_path(spark, "composed")
    runs = [L.compact_new(spark, root, out)]
    day = X.utc_day(F.timestamp_millis(F.col("createdAt")))
    none = F.struct(*[F.slice(f"history.{f.name}", 1, 0).alias(f.name) for f in details.schema["history"].dataType])
    L.write_committed(spark, details.filter(day == runs[0][-1]).withColumn("history", none), root, LEDGER_BATCH + 1)
    runs += [L.compact_new(spark, root, out), L.compact_new(spark, root, out)]
    again = [x for run in runs[1:] for x in run]
    return (A.read_archive(spark, out).groupBy("archive_date").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.size("history.timestamp")).alias("n_points"))
        .withColumn("times_rewritten", F.when(F.col("archive_date").isin(again), len(again) + 1).otherwise(1)))


def _keyed_tables(spark, d):
    return {"subreddit": T.subreddits(spark, d), "subreddit_history": T.subreddit_history(spark, d),
            "story": T.stories(spark, d), "story_history": T.story_history(spark, d, with_hotness=False)}


@register("cascade_by_keys", with_tables("story", "hist", "sub", "subhist", "abouts") + """
, doomed AS (SELECT s.id FROM sub s JOIN abouts a ON a.name = s.name WHERE a.status = 403),
gone AS (SELECT id FROM story WHERE subreddit IN (SELECT id FROM doomed) OR id % 5 = 0)
SELECT 'subreddit' AS "table", count(*) AS rows, count(*) FILTER (id IN (SELECT id FROM doomed)) AS gone FROM sub
UNION ALL SELECT 'subreddit_history', count(*), count(*) FILTER (subreddit IN (SELECT id FROM doomed)) FROM subhist
UNION ALL SELECT 'story', count(*), count(*) FILTER (id IN (SELECT id FROM gone)) FROM story
UNION ALL SELECT 'story_history', count(*), count(*) FILTER (story IN (SELECT id FROM gone)) FROM hist""")
def q_cascade_by_keys(spark, d):
    """K10 and K11 in one delete: forbidden communities, and some stories by their own id."""
    tables = _keyed_tables(spark, d)
    forbidden = T.landed_subreddit_abouts(spark, d, AS_OF).filter(F.col("status") == 403)
    doomed = {"subreddit": tables["subreddit"].join(forbidden.select(F.col("requested").alias("name")), "name", "left_semi"),
              "story": tables["story"].filter(F.col("id") % 5 == 0)}
    parts = [rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("_gone").alias("gone")).select(
        F.lit(name).alias("table"), "rows", "gone") for name, rows in C.flagged(tables, doomed).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register("orphan_audit", with_tables("story", "hist", "sub", "subhist") + """
, held AS (SELECT id FROM sub WHERE id % 7 <> 0), stories AS (SELECT * FROM story WHERE id % 3 <> 0)
SELECT 'story' AS child, 'subreddit' AS "column", 'subreddit' AS parent, count(*) AS "references",
       count(*) FILTER (subreddit NOT IN (SELECT id FROM held)) AS orphans FROM stories
UNION ALL SELECT 'story_history', 'story', 'story', count(*), count(*) FILTER (story NOT IN (SELECT id FROM stories)) FROM hist
UNION ALL SELECT 'subreddit_history', 'subreddit', 'subreddit', count(*),
                 count(*) FILTER (subreddit NOT IN (SELECT id FROM held)) FROM subhist""")
def q_orphan_audit(spark, d):
    """The audit over tables that lost some parents without a cascade."""
    tables = _keyed_tables(spark, d)
    return C.orphans(dict(tables, subreddit=tables["subreddit"].filter(F.col("id") % 7 != 0),
                          story=tables["story"].filter(F.col("id") % 3 != 0)))


@register("delete_cascade_story", with_tables("story") + f"""
SELECT id, reddit_short_id FROM story WHERE NOT (created_at <= {minus_s(SQL_AS_OF, '172800')})""")
def q_delete_story(spark, d):
    _, run = _archive_run(spark, d)
    return run.story_after.select("id", "reddit_short_id")


@register("delete_cascade_history", with_tables("story", "hist") + f"""
SELECT story, timestamp, tie1, tie2, tie3 FROM hist
WHERE story NOT IN (SELECT id FROM story WHERE created_at <= {minus_s(SQL_AS_OF, '172800')})""")
def q_delete_history(spark, d):
    _, run = _archive_run(spark, d)
    return run.history_after.select("story", "timestamp", "tie1", "tie2", "tie3")


@register("delete_cascade_subreddit", with_tables("story", "hist", "sub", "abouts") + """
, doomed AS (SELECT s.id FROM sub s JOIN abouts a ON a.name = s.name WHERE a.status = 403),
gone AS (SELECT id FROM story WHERE subreddit IN (SELECT id FROM doomed))
SELECT story, timestamp, tie1, tie2, tie3 FROM hist WHERE story NOT IN (SELECT id FROM gone)""")
def q_delete_subreddit(spark, d):
    sub = T.subreddits(spark, d)
    landed = T.landed_subreddit_abouts(spark, d, AS_OF)
    forbidden = landed.filter(F.col("status") == 403).select(F.col("requested").alias("name"))
    doomed = sub.join(forbidden, "name", "left_semi").select("id")
    _, _, _, left_hist = M.delete_subreddits(sub, T.subreddit_history(spark, d), T.stories(spark, d),
                                             T.story_history(spark, d, with_hotness=False), doomed)
    return left_hist.select("story", "timestamp", "tie1", "tie2", "tie3")


# -- M6: as-of, metrics ----------------------------------------------------------------

ASOF_COLS = ["h_timestamp", "h_hist_id", "h_subscribers", "h_active", "h_comment_hide_mins", "match"]


@register("asof_subreddit_history", with_tables("sub", "subhist") + f"""
, b AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY subreddit ORDER BY timestamp DESC, id DESC) rn
                       FROM subhist h WHERE timestamp < {SQL_AS_OF}) WHERE rn = 1),
f AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY subreddit ORDER BY timestamp, id) rn
                     FROM subhist h) WHERE rn = 1)
SELECT s.id, COALESCE(b.timestamp, f.timestamp) AS h_timestamp, COALESCE(b.id, f.id) AS h_hist_id,
       COALESCE(b.subscribers, f.subscribers) AS h_subscribers, COALESCE(b.active, f.active) AS h_active,
       COALESCE(b.comment_hide_mins, f.comment_hide_mins) AS h_comment_hide_mins,
       CASE WHEN b.id IS NOT NULL THEN 'before' WHEN f.id IS NOT NULL THEN 'first' END AS match
FROM sub s LEFT JOIN b ON b.subreddit = s.id LEFT JOIN f ON f.subreddit = s.id""")
def q_asof_subreddit(spark, d):
    out = asof_subreddit_history(T.subreddits(spark, d), T.subreddit_history(spark, d), X.as_ts(AS_OF))
    return out.select("id", *ASOF_COLS)


@register("asof_story_context", with_tables("story", "subhist") + """
, b AS (SELECT * FROM (SELECT s.id AS sid, h.*, row_number() OVER (PARTITION BY s.id ORDER BY h.timestamp DESC, h.id DESC) rn
                       FROM story s JOIN subhist h ON h.subreddit = s.subreddit AND h.timestamp < s.created_at)
        WHERE rn = 1),
f AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY subreddit ORDER BY timestamp, id) rn
                     FROM subhist h) WHERE rn = 1)
SELECT s.id, COALESCE(b.timestamp, f.timestamp) AS h_timestamp, COALESCE(b.id, f.id) AS h_hist_id,
       COALESCE(b.subscribers, f.subscribers) AS h_subscribers, COALESCE(b.active, f.active) AS h_active,
       COALESCE(b.comment_hide_mins, f.comment_hide_mins) AS h_comment_hide_mins,
       CASE WHEN b.id IS NOT NULL THEN 'before' WHEN f.id IS NOT NULL THEN 'first' END AS match
FROM story s LEFT JOIN b ON b.sid = s.id LEFT JOIN f ON f.subreddit = s.subreddit""")
def q_asof_story(spark, d):
    out = asof_story_context(T.stories(spark, d), T.subreddit_history(spark, d))
    return out.select("id", *ASOF_COLS)


@register("discovery_latency", with_tables("story") + """
, l AS (SELECT feed, epoch_ms(discovered_at) - epoch_ms(created_at) AS latency_ms FROM story)
SELECT feed, count(*) AS n, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 6) AS mean_ms,
       round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99
FROM l GROUP BY feed""")
def q_discovery_latency(spark, d):
    out = MET.discovery_latency(T.stories(spark, d, with_feed=True))
    return out.select("feed", "n", "min_ms", "max_ms", *[r6(c).alias(c) for c in ("mean_ms", "p50", "p95", "p99")])


@register("batch_size_stats", with_tables("obs") + """
, sizes AS (SELECT tick, count(*) AS size FROM obs WHERE kind = 't3' GROUP BY tick)
SELECT count(*) AS batches, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size,
       round(quantile_cont(size, 0.5), 6) AS p50, round(quantile_cont(size, 0.95), 6) AS p95,
       round(quantile_cont(size, 0.99), 6) AS p99
FROM sizes""")
def q_batch_size_stats(spark, d):
    obs = T.feed_observations(spark, d).filter(F.col("kind") == "t3")
    out = MET.batch_size_stats(obs, "tick")
    return out.select("batches", "min_size", "max_size", *[r6(c).alias(c) for c in ("mean_size", "p50", "p95", "p99")])


def _rate_sql(minutes: int) -> str:
    return with_tables("obs") + f"""
SELECT time_bucket(INTERVAL '{minutes} minutes', seen_at) AS window_start,
       time_bucket(INTERVAL '{minutes} minutes', seen_at) + INTERVAL '{minutes} minutes' AS window_end,
       count(*) AS n, round(count(*) / {60.0 * minutes}, 6) AS rate_per_s
FROM obs GROUP BY 1, 2"""


@register("event_rate_1m", _rate_sql(1))
def q_rate_1m(spark, d):
    out = MET.event_rate(T.feed_observations(spark, d), "seen_at", 1)
    return out.select("window_start", "window_end", "n", r6("rate_per_s").alias("rate_per_s"))


@register("event_rate_5m", _rate_sql(5))
def q_rate_5m(spark, d):
    out = MET.event_rate(T.feed_observations(spark, d), "seen_at", 5)
    return out.select("window_start", "window_end", "n", r6("rate_per_s").alias("rate_per_s"))


def _moving_sql(minutes: int) -> str:
    """The average by its definition: every former tick's term, faded to this tick (terms
    that have faded below a double's precision are left out)."""
    return with_tables("obs") + f"""
, ticks AS (SELECT feed, epoch_us(seen_at) // 5000000 AS k, count(*) AS n FROM obs GROUP BY 1, 2),
terms AS (SELECT *, n / 5.0 * CASE WHEN k = min(k) OVER (PARTITION BY feed) THEN 1.0
                                   ELSE 1 - exp(-5 / {60.0 * minutes}) END AS v FROM ticks)
SELECT a.feed, make_timestamp((a.k + 1) * 5000000) AS tick_end, a.n,
       round(sum(b.v * exp((b.k - a.k) * 5 / {60.0 * minutes})), 6) AS rate_per_s
FROM terms a JOIN terms b ON a.feed IS NOT DISTINCT FROM b.feed AND b.k <= a.k AND b.k > a.k - {600 * minutes}
GROUP BY a.feed, a.k, a.n"""


def _moving(spark, d, minutes: int):
    out = RATES.moving_rates(T.feed_observations(spark, d), "seen_at", "feed", (minutes,))
    return out.select("feed", "tick_end", "n", r6(f"rate_{minutes}m").alias("rate_per_s"))


@register("moving_rate_1m", _moving_sql(1))
def q_moving_1m(spark, d):
    """One-minute moving average of each feed's events, at every tick that has some."""
    return _moving(spark, d, 1)


@register("moving_rate_5m", _moving_sql(5))
def q_moving_5m(spark, d):
    return _moving(spark, d, 5)


# -- A8/A10 from stored sketches and reservoirs -------------------------------------------

def _stored_sketches(spark, rows, value, ts_col, group):
    """Sketches as a daily run leaves them: written, and read back by the report."""
    path = A.scratch_path(spark, "sketches")
    SK.daily_sketches(rows, value, ts_col, group).write.parquet(path)
    return spark.read.parquet(path)


def _rank_flags(rows, value, found, group, share=0.01):
    """Whether each quantile's rank lies within ``share`` of the rows around the exact one."""
    held = rows.select(group, value.alias("_v")).join(found.select(group, *[q for q, _ in QUANTILE_RANKS]), group)
    ranks = held.groupBy(group).agg(*[x for q, _ in QUANTILE_RANKS for x in (
        F.count_if(F.col("_v") < F.col(q)).alias(f"{q}_below"), F.count_if(F.col("_v") <= F.col(q)).alias(f"{q}_upto"))])
    slack = F.ceil(F.col("n") * share) + 1
    return found.join(ranks, group).select(group, "n", "min", "max", r6("mean").alias("mean"), *[
        ((F.col(f"{q}_below") <= p * F.col("n") + slack) & (F.col(f"{q}_upto") >= p * F.col("n") - slack)).alias(f"{q}_ok")
        for q, p in QUANTILE_RANKS])


@register("latency_sketches", with_tables("story") + """
, l AS (SELECT feed, epoch_ms(discovered_at) - epoch_ms(created_at) AS ms FROM story)
SELECT feed, count(*) AS n, min(ms) AS min, max(ms) AS max, round(avg(ms), 6) AS mean,
       true AS p50_ok, true AS p95_ok, true AS p99_ok FROM l GROUP BY feed""")
def q_latency_sketches(spark, d):
    """A8 from one stored sketch per feed and day, merged over all days."""
    story = T.stories(spark, d, with_feed=True)
    found = SK.merged_quantiles(_stored_sketches(spark, story, SK.latency_ms(), "discovered_at", "feed"))
    return _rank_flags(story, SK.latency_ms(), found, "feed")


@register("batch_size_sketches", with_tables("obs") + """
, sizes AS (SELECT feed, tick, count(*) AS size FROM obs WHERE kind = 't3' GROUP BY feed, tick)
SELECT feed, count(*) AS n, min(size) AS min, max(size) AS max, round(avg(size), 6) AS mean,
       true AS p50_ok, true AS p95_ok, true AS p99_ok FROM sizes WHERE feed IS NOT NULL GROUP BY feed""")
def q_batch_size_sketches(spark, d):
    """A10 from one stored sketch per feed and day."""
    obs = T.feed_observations(spark, d).filter((F.col("kind") == "t3") & F.col("feed").isNotNull())
    sizes = obs.groupBy("feed", "tick").agg(F.count(F.lit(1)).alias("size"))
    found = SK.merged_quantiles(_stored_sketches(spark, sizes, F.col("size"), "tick", "feed"))
    return _rank_flags(sizes, F.col("size"), found, "feed")


@register("latency_reservoir", with_tables("story") + f"""
, p AS (SELECT feed, id, epoch_ms(discovered_at) - epoch_ms(created_at) AS value,
               epoch_us(discovered_at) / 1e6 * {SK.ALPHA}
                 - ln((CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS priority
        FROM story)
SELECT feed, id, value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY feed ORDER BY priority DESC, id) AS INTEGER) AS rank FROM p)
WHERE rank <= {SK.RESERVOIR}""")
def q_latency_reservoir(spark, d):
    """A8's decaying reservoir: drawn per half of the stories and merged, as two runs would."""
    story = T.stories(spark, d, with_feed=True)
    halves = [SK.decaying_reservoir(story.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == h), SK.latency_ms(),
                                    "discovered_at", "id") for h in (0, 1)]
    return SK.merge_reservoirs(*halves).select("feed", "id", "value", "rank")


# -- A9/A12/K10: affected rows, counted while written --------------------------------------

@register("affected_rows_discovery", with_tables(*DISC_TABLES) + DISC_SQL + """
SELECT 'discovered' AS counter, count(*) AS n FROM newst
UNION ALL SELECT 'guard_rejected', count(*) FROM rejected
UNION ALL SELECT 'samples_appended', count(*) FROM samples
UNION ALL SELECT 'auto_updated', count(*) FROM matched
UNION ALL SELECT 'first_samples', count(*) FROM newst
UNION ALL SELECT 'later_samples', (SELECT count(*) FROM samples) - (SELECT count(*) FROM matched) - (SELECT count(*) FROM newst)
UNION ALL SELECT 'stories_refreshed', count(*) FROM story s
  WHERE s.updated_at <= (SELECT max(tick) FROM matched m WHERE m.story_id = s.id)""")
def q_affected_discovery(spark, d):
    out = counted.scratch(spark, "affected-discovery")
    counted.write_discovery(_discovery(spark, d), T.stories(spark, d), out)
    return out.affected()


@register("affected_rows_update", with_tables(*UPD_TABLES) + UPD_SQL + """
SELECT 'update_samples' AS counter, count(*) AS n FROM outc WHERE outcome = 'updated'
UNION ALL SELECT 'stories_updated', count(*) FROM outc WHERE outcome = 'updated'
UNION ALL SELECT 'stories_checked_only', count(*) FROM outc WHERE outcome = 'checked'""")
def q_affected_update(spark, d):
    out = counted.scratch(spark, "affected-update")
    story, done = _update_from(spark, d)
    counted.write_update(story, done, out, UPD_AS_OF)
    return out.affected()


@register("affected_rows_archive", with_tables(*ARCH_TABLES) + ARCH_SQL + """
, gone AS (SELECT id FROM doomed WHERE subreddit IN (SELECT id FROM sub))
SELECT 'archived' AS counter, count(*) AS n FROM recs
UNION ALL SELECT 'stories_deleted', count(*) FROM gone
UNION ALL SELECT 'samples_cascaded', count(*) FROM hist WHERE story IN (SELECT id FROM gone)""")
def q_affected_archive(spark, d):
    out = counted.scratch(spark, "affected-archive")
    counted.write_archive(spark, T.stories(spark, d), T.subreddits(spark, d), T.story_history(spark, d),
                          A.scratch_path(spark, "archive"), out, AS_OF)
    return out.affected()


@register("affected_rows_subreddit_delete", with_tables("story", "hist", "sub", "subhist", "abouts") + """
, doomed AS (SELECT s.id FROM sub s JOIN abouts a ON a.name = s.name WHERE a.status = 403),
gone AS (SELECT id FROM story WHERE subreddit IN (SELECT id FROM doomed))
SELECT 'subreddits_deleted' AS counter, count(*) AS n FROM doomed
UNION ALL SELECT 'sub_samples_cascaded', count(*) FROM subhist WHERE subreddit IN (SELECT id FROM doomed)
UNION ALL SELECT 'stories_cascaded', count(*) FROM gone
UNION ALL SELECT 'story_samples_cascaded', count(*) FROM hist WHERE story IN (SELECT id FROM gone)""")
def q_affected_subreddit_delete(spark, d):
    sub = T.subreddits(spark, d)
    forbidden = T.landed_subreddit_abouts(spark, d, AS_OF).filter(F.col("status") == 403)
    doomed = sub.join(forbidden.select(F.col("requested").alias("name")), "name", "left_semi").select("id")
    out = counted.scratch(spark, "affected-subreddits")
    counted.write_subreddit_deletion(sub, T.subreddit_history(spark, d), T.stories(spark, d),
                                     T.story_history(spark, d, with_hotness=False), doomed, out)
    return out.affected()


# -- M7: streaming (run with availableNow after every landing, return the sink's rows) ---

def _landed_with_ends(df, folder, step_col, fmt, steps_at_once, ends):
    """Land ``df`` group by group, then each of the few rows that end a test input."""
    yield from landings(df, folder, step_col, fmt, steps_at_once, prefix="data")
    for k, end in enumerate(ends):
        yield from landings(end, folder, step_col, fmt, prefix=f"end{k}")


def _stream_discovery(spark, d):
    root = A.scratch_path(spark, "stream-discovery")
    # The communities of the test tables were seen in 1998, so "now" is fixed to that.
    for _ in landings(_pages(spark, d), f"{root}/landing", "tick", "json", steps_at_once=10):
        STR.await_done(STR.discovery_stream(spark, f"{root}/landing", T.stories(spark, d), T.subreddits(spark, d),
                                            f"{root}/out", f"{root}/checkpoint", as_of=AS_OF))
    return root


@register("stream_discovery_samples", ORACLE["history_append"])
def q_stream_samples(spark, d):
    root = _stream_discovery(spark, d)
    smp = spark.read.parquet(f"{root}/out/samples")
    return smp.select("story", "timestamp", "score", "comments", "gilded", r6("hotness").alias("hotness"))


@register("stream_new_stories", ORACLE["discover_insert"])
def q_stream_new(spark, d):
    root = _stream_discovery(spark, d)
    n = spark.read.parquet(f"{root}/out/new_stories")
    return n.select("id", "reddit_short_id", "subreddit", "created_at", "discovered_at", "score", "comments",
                    "gilded", r6("hotness").alias("hotness"))


# ST2 as a rule: a story is discovered at its first sighting, and again at its first sighting
# two days or more after it was last discovered.
STREAM_FIRSTS_SQL = with_tables("feedu").replace("WITH ", "WITH RECURSIVE ", 1) + """
, rec(short_id, tick) AS (
  SELECT short_id, min(tick) FROM feedu GROUP BY short_id
  UNION ALL
  SELECT r.short_id, (SELECT min(x.tick) FROM feedu x WHERE x.short_id = r.short_id AND x.tick >= r.tick + INTERVAL 2 DAY)
  FROM rec r
  WHERE EXISTS (SELECT 1 FROM feedu x WHERE x.short_id = r.short_id AND x.tick >= r.tick + INTERVAL 2 DAY))
SELECT r.tick, r.short_id, f.feed, f.page, f.subreddit_name FROM rec r JOIN feedu f USING (short_id, tick)"""


@register("stream_discoveries", STREAM_FIRSTS_SQL)
def q_stream_discoveries(spark, d):
    """ST2: discoveries while tracked, three scrape ticks per micro-batch."""
    root = A.scratch_path(spark, "stream-firsts")
    for _ in landings(_pages(spark, d), f"{root}/landing", "tick", "json", steps_at_once=3):
        STR.await_done(STR.discoveries_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out/discoveries").select("tick", "short_id", "feed", "page", "subreddit_name")


@register("stream_rate_5m", ORACLE["event_rate_5m"])
def q_stream_rate(spark, d):
    root = A.scratch_path(spark, "stream-rate")
    obs = T.feed_observations(spark, d).select("seen_at", "tick")
    # Two more rows after the last one, days later, end the test input: the first closes every
    # open window; the second (a later micro-batch) makes them emit, since availableNow runs no
    # trailing no-data batch. Their own windows are not part of the result.
    last = obs.agg(F.max("seen_at").alias("m"))
    ends = [last.select((F.col("m") + F.expr(f"INTERVAL {k} DAYS")).alias("seen_at"),
                        (F.date_trunc("day", F.col("m")) + F.expr(f"INTERVAL {k} DAYS")).alias("tick")) for k in (2, 3)]
    land_in_order(obs, f"{root}/landing", "tick", "parquet", steps_per_file=7, prefix="data")
    for k, end in enumerate(ends):
        land_in_order(end, f"{root}/landing", "tick", "parquet", prefix=f"end{k}")
    STR.await_done(STR.rate_stream(spark, f"{root}/landing", obs.schema, f"{root}/out",
                                   f"{root}/checkpoint", minutes=5, max_files=1))
    out = spark.read.parquet(f"{root}/out").filter(F.col("window_start") <= last.scalar())
    return out.select("window_start", "window_end", "n", r6("rate_per_s").alias("rate_per_s"))


@register("stream_archive", with_tables("story", "sub", "hist") + """
, s AS (SELECT h.story, h.timestamp, st.created_at FROM hist h JOIN story st ON h.story = st.id),
inwin AS (SELECT story, count(*) AS n, min(epoch_ms(timestamp)) AS first_ts, max(epoch_ms(timestamp)) AS last_ts
          FROM s WHERE timestamp < created_at + INTERVAL 2 DAY GROUP BY story)
SELECT st.reddit_short_id AS id, st.created_at, CAST(coalesce(n, 0) AS INTEGER) AS n_points, first_ts, last_ts
FROM story st JOIN sub ON st.subreddit = sub.id LEFT JOIN inwin i ON i.story = st.id
WHERE st.created_at + INTERVAL 2 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM s)""")
def q_stream_archive(spark, d):
    """ST3/ST4/ST6: samples land in time order (two-year steps); every story whose window has
    closed is archived once, with its in-window samples, also without any."""
    root = A.scratch_path(spark, "stream-archive")
    story = T.stories(spark, d)
    created = story.select(F.col("id").alias("story"), "created_at")
    samples = (T.story_history(spark, d).join(created, "story")
               .withColumn("year", F.year("timestamp")))
    for _ in landings(samples, f"{root}/landing", "year", "parquet", steps_at_once=2):
        STR.await_done(STR.archive_stream(spark, f"{root}/landing", samples.schema, f"{root}/out", f"{root}/checkpoint",
                                          story=story, subreddit=T.subreddits(spark, d)))
    recs = A.read_archive(spark, f"{root}/out/archive", batched=True)
    return recs.select(F.col("summary.id").alias("id"), F.timestamp_millis("summary.createdAt").alias("created_at"),
                       F.size("history.timestamp").alias("n_points"),
                       F.array_min("history.timestamp").alias("first_ts"),
                       F.array_max("history.timestamp").alias("last_ts"))


def _stream_abouts(spark, d, rounds):
    """Landed about records, one full round at each of the given times, one round a file."""
    root = A.scratch_path(spark, "stream-about")
    abouts = T.landed_subreddit_abouts(spark, d, AS_OF)
    times = F.array(*[F.lit(AS_OF + dt.timedelta(seconds=s)) for s in rounds])
    landed = abouts.select("*", F.explode(times).alias("landed_at"))
    for _ in landings(landed, f"{root}/landing", "landed_at", "json"):
        STR.await_done(STR.subreddit_sampling_stream(spark, f"{root}/landing", T.subreddits(spark, d),
                                                     f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out/samples").select(
        "subreddit", "name", "timestamp", "subscribers", "active", "comment_hide_mins")


@register("stream_subreddit_samples", ORACLE["subreddit_history_append"])
def q_stream_sub_samples(spark, d):
    return _stream_abouts(spark, d, (0,))


@register("stream_subreddit_rounds", with_tables("sub", "abouts") + f"""
, one AS (SELECT s.id, a.* FROM sub s JOIN abouts a ON a.name = s.name WHERE a.status = 200
          AND s.updated_at < {minus_s(SQL_AS_OF, '900')}),
two AS (SELECT s.id, a.* FROM sub s JOIN abouts a ON a.name = s.name WHERE a.status = 200
        AND (s.id IN (SELECT id FROM one) OR s.updated_at < {minus_s(SQL_AS_OF, '-900')}))
SELECT id AS subreddit, name, {SQL_AS_OF} AS timestamp, subscribers, active, comment_hide_mins FROM one
UNION ALL
SELECT id, name, {minus_s(SQL_AS_OF, '-1800')}, subscribers, active, comment_hide_mins FROM two""")
def q_stream_sub_rounds(spark, d):
    """ST8 over two rounds 1 800 s apart: "now" moves, so the second round samples again."""
    return _stream_abouts(spark, d, (0, 1800))


# -- ranking page and JSON records -----------------------------------------------------

@register("ranking_page", with_tables("story", "sub") + """
, top AS (SELECT * FROM story ORDER BY hotness DESC, id ASC LIMIT 100)
SELECT top.id, top.title, top.score, top.comments, top.gilded, sub.name AS subreddit_name,
       'http://reddit.com' || top.permalink AS link,
       strftime(top.created_at - INTERVAL 5 HOUR, '%-m/%-d/%y %-I:%M %p') AS display_time,
       round((epoch_ms(top.discovered_at) - epoch_ms(top.created_at)) / 1000.0, 0) AS discovery_delay_s,
       COALESCE(NOT (top.thumbnail IN ('', 'default', 'self', 'nsfw')), false) AS show_thumbnail
FROM top LEFT JOIN sub ON top.subreddit = sub.id""")
def q_ranking_page(spark, d):
    """The ranking page's rows: hottest 100 with link, display time, delay and thumbnail flag."""
    top = sel.hottest_stories(T.stories(spark, d), T.subreddits(spark, d), 100)
    return top.select(
        "id", "title", "score", "comments", "gilded", "subreddit_name",
        X.permalink_url("permalink").alias("link"), X.display_time("created_at").alias("display_time"),
        F.round(X.seconds_between("discovered_at", "created_at"), 0).alias("discovery_delay_s"),
        X.show_thumbnail("thumbnail").alias("show_thumbnail"))


@register("story_detail_json", with_tables("story", "sub", "hist") + """
, arr AS (SELECT story, list(epoch_ms(timestamp) ORDER BY timestamp, tie1, tie2, tie3) AS ts,
                 list(score ORDER BY timestamp, tie1, tie2, tie3) AS sc,
                 list(round(hotness, 6) ORDER BY timestamp, tie1, tie2, tie3) AS ho,
                 list(gilded ORDER BY timestamp, tie1, tie2, tie3) AS gi,
                 list(comments ORDER BY timestamp, tie1, tie2, tie3) AS co FROM hist GROUP BY story)
SELECT s.id AS story_id, to_json({'summary': {'id': s.reddit_short_id, 'title': s.title, 'author': s.author,
  'createdAt': epoch_ms(s.created_at), 'discoveredAt': epoch_ms(s.discovered_at), 'domain': s.domain, 'url': s.url,
  'thumbnail': s.thumbnail, 'permalink': s.permalink, 'score': s.score, 'comments': s.comments,
  'hotness': round(s.hotness, 6), 'gilded': s.gilded, 'subreddit': sub.name, 'isSelf': s.is_self,
  'selfText': s.selftext, 'isOver18': s.over18, 'isStickied': s.stickied, 'distinguished': s.distinguished},
  'history': {'timestamp': COALESCE(arr.ts, []), 'score': COALESCE(arr.sc, []), 'hotness': COALESCE(arr.ho, []),
              'gilded': COALESCE(arr.gi, []), 'comments': COALESCE(arr.co, [])}, 'chunk': 0}) AS json
FROM story s JOIN sub ON s.subreddit = sub.id LEFT JOIN arr ON arr.story = s.id""")
def q_story_detail_json(spark, d):
    """Detail records serialised as JSON text with explicit nulls (the archive line format);
    hotness rounded to 6 decimals before serialising, as in every other key."""
    det = H.story_detail(T.stories(spark, d), T.subreddits(spark, d), T.story_history(spark, d))
    det = det.withColumn("hotness", r6("hotness")).withColumn(
        "history", F.col("history").withField("hotness", F.transform("history.hotness", lambda x: F.round(x, 6))))
    return H.detail_json(det)


@register("subreddit_refresh", with_tables("sub", "abouts") + f"""
, sampled AS (SELECT s.id FROM sub s JOIN abouts a ON a.name = s.name
              WHERE s.updated_at < {minus_s(SQL_AS_OF, '900')} AND a.status = 200)
SELECT id, name, CASE WHEN id IN (SELECT id FROM sampled) THEN {SQL_AS_OF} ELSE updated_at END AS updated_at,
       seen_at FROM sub""")
def q_subreddit_refresh(spark, d):
    """K8 end to end: sample the stale communities, then refresh their updated_at."""
    sub = T.subreddits(spark, d)
    abouts = P.parse_about(T.landed_subreddit_abouts(spark, d, AS_OF))
    samples = M.subreddit_history_append(sel.subreddits_stale(sub, AS_OF), abouts, AS_OF)
    return M.refresh_sampled(sub, samples, AS_OF).select("id", "name", "updated_at", "seen_at")


@register("discovery_latency_approx", with_tables("story") + """
, l AS (SELECT feed, epoch_ms(discovered_at) - epoch_ms(created_at) AS ms FROM story)
SELECT feed, count(*) AS n, min(ms) AS min_ms, max(ms) AS max_ms, round(avg(ms), 6) AS mean_ms,
       true AS p50_ok, true AS p95_ok, true AS p99_ok FROM l GROUP BY feed""")
def q_discovery_latency_approx(spark, d):
    """A8 with fixed-size quantile sketches (one pass, no sort). The sketch of accuracy 10 000
    promises a rank within n / 10 000 of the quantile's; each flag says that this holds."""
    story = T.stories(spark, d, with_feed=True)
    out = MET.discovery_latency(story, approx=True)
    ms = F.unix_millis("discovered_at") - F.unix_millis("created_at")
    ranks = (story.select("feed", ms.alias("ms")).join(out.select("feed", *[q for q, _ in QUANTILE_RANKS]), "feed")
             .groupBy("feed").agg(*[x for q, _ in QUANTILE_RANKS for x in (
                 F.count_if(F.col("ms") < F.col(q)).alias(f"{q}_below"), F.count_if(F.col("ms") <= F.col(q)).alias(f"{q}_upto"))]))
    slack = F.ceil(F.col("n") / 10_000) + 1
    held = out.join(ranks, "feed")
    return held.select("feed", "n", "min_ms", "max_ms", r6("mean_ms").alias("mean_ms"), *[
        ((F.col(f"{q}_below") <= p * F.col("n") + slack) & (F.col(f"{q}_upto") >= p * F.col("n") - slack)).alias(f"{q}_ok")
        for q, p in QUANTILE_RANKS])


@register("story_detail_lookup", with_tables("story", "sub", "hist", "obs") + f"""
, arr AS ({_arrays_sql('hist')})
SELECT s.id AS story_id, {SUMMARY_SQL_COLS},
  COALESCE(arr.n_points, 0) AS n_points, COALESCE(arr.ts_ms, '') AS ts_ms, COALESCE(arr.scores, '') AS scores
FROM story s JOIN sub ON s.subreddit = sub.id LEFT JOIN arr ON arr.story = s.id
WHERE s.reddit_short_id IN (SELECT short_id FROM obs)""")
def q_story_detail_lookup(spark, d):
    """F1 → T4 → A2 for the ids the feeds asked about (missing ids: see story_lookup_status)."""
    ids = T.feed_observations(spark, d).select("short_id")
    det = H.story_detail(T.stories(spark, d), T.subreddits(spark, d), T.story_history(spark, d), ids)
    return det.select(
        "story_id", *[r6("hotness").alias("hotness") if c == "hotness" else F.col(c) for c in sel.SUMMARY_FIELDS],
        F.size("history.timestamp").alias("n_points"), joined("history.timestamp").alias("ts_ms"),
        joined("history.score").alias("scores"))


@register("stream_latest_state", with_tables("story", "hist") + """
, newest AS (SELECT * FROM (SELECT story, timestamp AS ts, score, hotness, comments, gilded,
                 row_number() OVER (PARTITION BY story ORDER BY timestamp DESC, score DESC, hotness DESC,
                                    comments DESC, gilded DESC) AS rn FROM hist) WHERE rn = 1)
SELECT s.id,
  CASE WHEN n.ts >= s.updated_at THEN n.score ELSE s.score END AS score,
  round(CASE WHEN n.ts >= s.updated_at THEN n.hotness ELSE s.hotness END, 6) AS hotness,
  CASE WHEN n.ts >= s.updated_at THEN n.comments ELSE s.comments END AS comments,
  CASE WHEN n.ts >= s.updated_at THEN n.gilded ELSE s.gilded END AS gilded,
  CASE WHEN n.ts >= s.updated_at THEN n.ts ELSE s.updated_at END AS updated_at,
  CASE WHEN n.ts >= s.updated_at THEN n.ts ELSE s.checked_at END AS checked_at
FROM story s LEFT JOIN newest n ON n.story = s.id""")
def q_stream_latest_state(spark, d):
    """ST5: the sample stream (landed by ship year) refreshes the story table batch by
    batch; the final snapshot equals applying every sample at once."""
    root = A.scratch_path(spark, "stream-state")
    samples = T.story_history(spark, d).withColumn("year", F.year("timestamp"))
    for _ in landings(samples, f"{root}/landing", "year", "parquet", steps_at_once=2):
        STR.await_done(STR.state_stream(spark, f"{root}/landing", samples.schema, T.stories(spark, d),
                                        f"{root}/out", f"{root}/checkpoint"))
    snap = STR.current(spark, T.stories(spark, d), f"{root}/out")
    return snap.select("id", "score", r6("hotness").alias("hotness"), "comments", "gilded", "updated_at",
                       "checked_at")


# -- M8: streams on Spark's own state ---------------------------------------------------

def _ends(df, time_cols, step_days=400, **fixed):
    """Two rows far behind ``df``'s last time, in files of their own: they move the watermark
    past all that came before (availableNow runs no trailing no-data batch)."""
    last = df.agg(F.max(time_cols[0]).alias("m")).first()["m"]
    row = df.limit(1)
    return last, [row.select(*[
        F.lit(last + dt.timedelta(days=k * step_days)).alias(c) if c in time_cols else fixed[c].alias(c) if c in fixed
        else F.col(c) for c in df.columns]) for k in (1, 2)]


@register("stream_sightings", with_tables("obs", "parsed") + """
SELECT short_id, min(tick) AS tick FROM parsed GROUP BY short_id""")
def q_stream_sightings(spark, d):
    """ST2 on Spark's de-duplication, tracked for longer than the input lasts."""
    root = A.scratch_path(spark, "stream-sightings")
    land_in_order(_pages(spark, d), f"{root}/landing", "tick", "json", steps_per_file=1)
    STR.await_done(NAT.sightings_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/checkpoint", 400 * 86400, max_files=1))
    return spark.read.parquet(f"{root}/out").select("short_id", "tick")


@register("stream_union_feeds", with_tables("feedu") + """
SELECT tick, short_id, feed, page, pos, in_new, score FROM feedu WHERE feed IN ('hot', 'new')""")
def q_stream_union_feeds(spark, d):
    """ST1/U1 over two feeds that land apart, in steps of different sizes."""
    root = A.scratch_path(spark, "stream-union")
    pages = _pages(spark, d).filter(F.col("feed").isin("hot", "new"))
    last, ends = _ends(pages, ["tick"])
    for feed, steps in (("hot", 7), ("new", 10)):
        land_in_order(pages.filter(F.col("feed") == feed), f"{root}/{feed}", "tick", "json", steps_per_file=steps, prefix="data")
        for k, end in enumerate(ends):
            land_in_order(end.withColumn("feed", F.lit(feed)), f"{root}/{feed}", "tick", "json", prefix=f"end{k}")
    STR.await_done(NAT.union_stream(spark, f"{root}/hot", f"{root}/new", f"{root}/out", f"{root}/checkpoint", max_files=1))
    out = spark.read.parquet(f"{root}/out").filter(F.col("tick") <= F.lit(last))
    return out.select("tick", "short_id", "feed", "page", "pos", "in_new", "score")


def _land_years(df, folder, time_col, ends):
    stepped = df.withColumn("_year", F.year(time_col))
    land_in_order(stepped, folder, "_year", "parquet", steps_per_file=2, prefix="data")
    for k, end in enumerate(ends):
        land_in_order(end.withColumn("_year", F.year(time_col)), folder, "_year", "parquet", prefix=f"end{k}")


def _landed_years(df, folder, time_col, ends):
    stepped = [x.withColumn("_year", F.year(time_col)) for x in (df, *ends)]
    return _landed_with_ends(stepped[0], folder, "_year", "parquet", 2, stepped[1:])


@register("stream_samples_with_stories", with_tables("story", "hist") + """
SELECT h.story, h.timestamp, h.tie1, h.score, s.id AS story_id, s.created_at
FROM hist h LEFT JOIN story s ON s.id = h.story AND h.timestamp >= s.created_at
  AND h.timestamp < s.created_at + INTERVAL 5 DAY""")
def q_stream_samples_with_stories(spark, d):
    """ST3/J2 as a stream-stream join, samples of five days after a story's creation."""
    root = A.scratch_path(spark, "stream-join")
    samples = T.story_history(spark, d, with_hotness=False).select("story", "timestamp", "tie1", "score")
    stories = T.stories(spark, d).select("id", "created_at")
    end, gone = F.lit(-1).cast("long"), F.lit(-2).cast("long")
    _, late = _ends(samples, ["timestamp"], story=end)
    _, late_stories = _ends(stories, ["created_at"], step_days=500, id=gone)
    for _ in zip_longest(_landed_years(samples, f"{root}/samples", "timestamp", late),
                         _landed_years(stories, f"{root}/stories", "created_at", late_stories)):
        STR.await_done(NAT.samples_with_stories(spark, f"{root}/samples", samples.schema, f"{root}/stories", stories.schema,
                                                f"{root}/out", f"{root}/checkpoint", 5 * 86400))
    out = spark.read.parquet(f"{root}/out").filter(F.col("story") >= 0)
    return out.select("story", "timestamp", "tie1", "score", F.col("id").alias("story_id"), "created_at")


@register("stream_stories_with_context", with_tables("story", "subhist") + """
, held AS (SELECT s.id, s.subreddit, s.created_at, max({'t': h.timestamp, 'id': h.id}) AS l
           FROM story s LEFT JOIN subhist h ON h.subreddit = s.subreddit AND h.timestamp <= s.created_at
             AND h.timestamp >= s.created_at - INTERVAL 60 DAY GROUP BY ALL)
SELECT held.id, held.subreddit, held.created_at, l.id AS sample, l.t AS sampled_at, h.subscribers, h.active
FROM held LEFT JOIN subhist h ON h.id = l.id""")
def q_stream_stories_with_context(spark, d):
    """ST3/J8 as a stream-stream join and aggregate: the last community sample of 60 days."""
    root = A.scratch_path(spark, "stream-asof")
    stories = T.stories(spark, d).select("id", "subreddit", "created_at")
    samples = T.subreddit_history(spark, d).select("id", "subreddit", "timestamp", "subscribers", "active")
    none = F.lit(-1).cast("long")
    _, late = _ends(stories, ["created_at"], subreddit=none, id=none)
    _, late_samples = _ends(samples, ["timestamp"], subreddit=F.lit(-2).cast("long"), id=none)
    _land_years(stories, f"{root}/stories", "created_at", late)
    _land_years(samples, f"{root}/samples", "timestamp", late_samples)
    STR.await_done(NAT.stories_with_context(spark, f"{root}/stories", stories.schema, f"{root}/samples", samples.schema,
                                            f"{root}/out", f"{root}/checkpoint", 60 * 86400, max_files=1))
    return spark.read.parquet(f"{root}/out").filter(F.col("id") >= 0)
