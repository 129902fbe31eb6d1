"""Explicit schemas: landed payloads, canonical tables and the archive record.

Readers never infer: unknown payload keys are ignored by projecting onto these.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
KIND_LISTING = "Listing"
KIND_STORY = "t3"
KIND_SUBREDDIT = "t5"
# Epoch second that the ranking formula measures age from, and its time divisor.
HOTNESS_EPOCH_S = 1134028003
HOTNESS_DIVISOR_S = 45000.0

# -- landed payloads -------------------------------------------------------

# Story "thing" body. created_utc is declared double: payloads may carry 1435795200.0,
# which a bigint field would turn into NULL.
STORY_DATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("domain", T.StringType()),
    T.StructField("num_comments", T.IntegerType()),
    T.StructField("gilded", T.IntegerType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("thumbnail", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("over_18", T.BooleanType()),
    # The producer spells the flag "sticked"; the site itself sends "stickied". Both are read.
    T.StructField("sticked", T.BooleanType()),
    T.StructField("stickied", T.BooleanType()),
])

SUBREDDIT_DATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("public_description", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("subreddit_type", T.StringType()),
    T.StructField("submission_type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("created", T.DoubleType()),
    T.StructField("comment_score_hide_mins", T.IntegerType()),
    T.StructField("accounts_active", T.IntegerType()),
    T.StructField("subscribers", T.LongType()),
    T.StructField("over18", T.BooleanType()),
])

# Numeric / boolean keys whose absence means 0 / false (primitive constructor parameters).
STORY_DEFAULTED_NUMBERS = ("num_comments", "gilded", "score")
STORY_DEFAULTED_FLAGS = ("is_self", "over_18", "sticked", "stickied")
EPOCH_FIELDS = ("created_utc", "created")  # epoch seconds in story and community bodies
STORY_REQUIRED = ("id", "title", "created_utc", "subreddit")

# A child is kept as raw JSON text first so that "absent" and "malformed" can be told apart.
RAW_THING = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("data", T.StringType()),
])

LISTING_ENVELOPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("children", T.ArrayType(RAW_THING)),
    ])),
])

# -- canonical tables ------------------------------------------------------

SUBREDDIT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("reddit_short_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("submission_type", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("seen_at", T.TimestampType()),
])

SUBREDDIT_HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("subreddit", T.LongType()),
    T.StructField("subscribers", T.LongType()),
    T.StructField("active", T.IntegerType()),
    T.StructField("comment_hide_mins", T.IntegerType()),
])

STORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("reddit_short_id", T.StringType()),
    T.StructField("subreddit", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("thumbnail", T.StringType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("over18", T.BooleanType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("stickied", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("hotness", T.DoubleType()),
    T.StructField("comments", T.IntegerType()),
    T.StructField("gilded", T.IntegerType()),
    T.StructField("discovered_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("checked_at", T.TimestampType()),
])

# History rows carry a tie-break key (tie1..tie3) so "latest" and "ordered" are total orders.
STORY_HISTORY = T.StructType([
    T.StructField("story", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("tie1", T.LongType()),
    T.StructField("tie2", T.LongType()),
    T.StructField("tie3", T.LongType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("hotness", T.DoubleType()),
    T.StructField("comments", T.IntegerType()),
    T.StructField("gilded", T.IntegerType()),
])

# -- archive record --------------------------------------------------------

SUMMARY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("createdAt", T.LongType()),
    T.StructField("discoveredAt", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("thumbnail", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("comments", T.IntegerType()),
    T.StructField("hotness", T.DoubleType()),
    T.StructField("gilded", T.IntegerType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("isSelf", T.BooleanType()),
    T.StructField("selfText", T.StringType()),
    T.StructField("isOver18", T.BooleanType()),
    T.StructField("isStickied", T.BooleanType()),
    T.StructField("distinguished", T.StringType()),
])

HISTORY_ARRAYS = T.StructType([
    T.StructField("timestamp", T.ArrayType(T.LongType())),
    T.StructField("score", T.ArrayType(T.IntegerType())),
    T.StructField("hotness", T.ArrayType(T.DoubleType())),
    T.StructField("gilded", T.ArrayType(T.IntegerType())),
    T.StructField("comments", T.ArrayType(T.IntegerType())),
])

DETAIL = T.StructType([
    T.StructField("summary", SUMMARY),
    T.StructField("history", HISTORY_ARRAYS),
    T.StructField("chunk", T.LongType()),
])
