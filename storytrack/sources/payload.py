"""Landed JSON payloads → typed rows (listing envelope, things, story / subreddit fields).

Payload files are read with ``spark.read.text`` (one envelope per line) or
``spark.read.text(path, wholetext=True)`` (one envelope per file); every function
here takes a DataFrame with a string column holding the envelope text, so the same
code serves batch and ``readStream`` inputs.

Malformed input never aborts a job by default: bad pages and bad children go to a
reject frame with a reason. ``strict=True`` raises instead (the producer's behaviour).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storytrack import schemas as S
from storytrack.functions import scalars as X

REASON_MALFORMED = "malformed"
REASON_NOT_LISTING = "not_listing"
REASON_WRONG_KIND = "wrong_kind"
REASON_MISSING = "missing_field"
REASON_BAD_VALUE = "bad_value"


def read_landed(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Read landed payload files; column ``value`` holds the envelope text, ``source`` the file."""
    df = spark.read.text(path, wholetext=whole_file)
    return df.select("value", F.col("_metadata.file_path").alias("source"))


def _envelope(value: Column) -> Column:
    return F.from_json(value, S.LISTING_ENVELOPE)


def _parse_once(df: DataFrame, keep: list[str], parsed: dict[str, Column]) -> DataFrame:
    """Evaluate each parse expression exactly once per row.

    Predicates on a projected ``from_json`` are pushed through the projection with the
    expression substituted for every reference (and the JSON optimiser then splits it into
    one pruned parse per field), so a reject check would re-parse the text dozens of times.
    A one-row generator is a boundary the optimiser does not inline across: the parse runs
    once in its input and later filters read the generated columns.
    """
    row = F.struct(*[e.alias(n) for n, e in parsed.items()])
    return df.select(*keep, F.inline(F.array(row)))


def parse_listing(pages: DataFrame, value_col: str = "value", strict: bool = False) -> DataFrame:
    """Envelope → one row per child (pos = index within the page).

    Keeps every non-payload column of ``pages``; adds before/after cursors ('' when
    absent), pos, kind and the child body as raw JSON text (``data``).
    """
    keep = [c for c in pages.columns if c != value_col]
    env = _parse_once(pages, keep, {"_env": _envelope(F.col(value_col))})
    ok = F.coalesce(F.col("_env.kind") == F.lit(S.KIND_LISTING), F.lit(False))
    if strict:
        env = env.filter(X.fail_if(~ok, "payload is not a Listing"))
    listed = env.filter(ok).select(
        *keep,
        F.coalesce(F.col("_env.data.before"), F.lit("")).alias("before"),
        F.coalesce(F.col("_env.data.after"), F.lit("")).alias("after"),
        F.posexplode(F.coalesce(F.col("_env.data.children"), F.array().cast(T.ArrayType(S.RAW_THING)))),
    )
    return listed.select(*keep, "before", "after", "pos",
                         F.col("col.kind").alias("kind"), F.col("col.data").alias("data"))


def listing_page_rejects(pages: DataFrame, value_col: str = "value") -> DataFrame:
    """Pages that are not a Listing envelope (or not JSON at all), with a reason."""
    keep = [c for c in pages.columns if c != value_col]
    env = _parse_once(pages, keep, {"payload": F.col(value_col), "_env": _envelope(F.col(value_col))})
    return (env.filter(~F.coalesce(F.col("_env.kind") == F.lit(S.KIND_LISTING), F.lit(False)))
            .select(*keep, "payload",
                    F.when(F.col("_env.kind").isNull(), F.lit(REASON_MALFORMED))
                    .otherwise(F.lit(REASON_NOT_LISTING)).alias("reason")))


def _reject_reason(kind: str, schema: T.StructType, required: tuple[str, ...]) -> Column:
    """Why a child can't be bound to ``schema`` (NULL when it can)."""
    typed = F.col("_typed")
    raw = F.col("_raw")
    missing = F.lit(False)
    for f in required:
        missing = missing | typed[f].isNull()
    bad = F.lit(False)
    for f in schema.fieldNames():
        # Present with a non-null value that did not convert to the declared type.
        bad = bad | (typed[f].isNull() & raw[f].isNotNull())
    for f in S.EPOCH_FIELDS:
        if f in schema.fieldNames():  # a number, but no point in time (e.g. microseconds)
            bad = bad | F.coalesce(~X.valid_epoch(typed[f]), F.lit(False))
    return (F.when(~F.coalesce(F.col("kind") == F.lit(kind), F.lit(False)), F.lit(REASON_WRONG_KIND))
            .when(F.col("_raw").isNull() | typed.isNull(), F.lit(REASON_MALFORMED))
            .when(missing, F.lit(REASON_MISSING))
            .when(bad, F.lit(REASON_BAD_VALUE)))


def _bind(children: DataFrame, kind: str, schema: T.StructType,
          required: tuple[str, ...]) -> DataFrame:
    keep = [c for c in children.columns if c != "data"]
    typed = _parse_once(children, keep, {
        "data": F.col("data"),
        "_typed": F.from_json("data", schema),
        "_raw": F.from_json("data", T.MapType(T.StringType(), T.StringType())),
    })
    return typed.withColumn("reason", _reject_reason(kind, schema, required))


def parse_things(children: DataFrame, kind: str = S.KIND_STORY, strict: bool = False) -> DataFrame:
    """Bind child bodies of the expected kind; keeps all columns + struct ``thing``."""
    schema, required = _thing_schema(kind)
    bound = _bind(children, kind, schema, required)
    if strict:
        bound = bound.filter(X.fail_if(F.col("reason").isNotNull(), "cannot bind a child to its kind"))
    keep = [c for c in children.columns if c not in ("data",)]
    return bound.filter(F.col("reason").isNull()).select(*keep, F.col("_typed").alias("thing"))


def thing_rejects(children: DataFrame, kind: str = S.KIND_STORY) -> DataFrame:
    """S2 complement: children that can't be bound, with the raw body and a reason."""
    schema, required = _thing_schema(kind)
    bound = _bind(children, kind, schema, required)
    keep = [c for c in children.columns if c != "data"]
    return bound.filter(F.col("reason").isNotNull()).select(*keep, "data", "reason")


def _thing_schema(kind: str):
    if kind == S.KIND_STORY:
        return S.STORY_DATA, S.STORY_REQUIRED
    if kind == S.KIND_SUBREDDIT:
        return S.SUBREDDIT_DATA, ("id", "display_name")
    raise ValueError(f"unknown kind {kind!r}")


def story_fields(things: DataFrame) -> DataFrame:
    """S3: typed story body → story columns (renames, epoch → ts, '' → NULL, absent → 0/false)."""
    keep = [c for c in things.columns if c != "thing"]
    t = F.col("thing")
    created = X.epoch_seconds_to_ts(t["created_utc"])
    score = F.coalesce(t["score"], F.lit(0))
    return things.select(
        *keep,
        t["id"].alias("short_id"),
        t["title"].alias("title"),
        t["author"].alias("author"),
        created.alias("created_at"),
        t["domain"].alias("domain"),
        F.coalesce(t["num_comments"], F.lit(0)).alias("comments"),
        F.coalesce(t["gilded"], F.lit(0)).alias("gilded"),
        score.alias("score"),
        X.hotness(score, created).alias("hotness"),
        t["permalink"].alias("permalink"),
        X.empty_to_null(t["selftext"]).alias("selftext"),
        t["subreddit"].alias("subreddit_name"),
        X.empty_to_null(t["thumbnail"]).alias("thumbnail"),
        t["url"].alias("url"),
        t["distinguished"].alias("distinguished"),
        F.coalesce(t["is_self"], F.lit(False)).alias("is_self"),
        F.coalesce(t["over_18"], F.lit(False)).alias("over18"),
        F.coalesce(t["stickied"], t["sticked"], F.lit(False)).alias("stickied"),
    )


def subreddit_fields(things: DataFrame) -> DataFrame:
    """Typed subreddit body → subreddit columns."""
    keep = [c for c in things.columns if c != "thing"]
    t = F.col("thing")
    return things.select(
        *keep,
        t["id"].alias("reddit_short_id"),
        t["display_name"].alias("name"),
        t["title"].alias("title"),
        X.empty_to_null(t["public_description"]).alias("summary"),
        t["description"].alias("description"),
        t["subreddit_type"].alias("subreddit_type"),
        t["submission_type"].alias("submission_type"),
        t["url"].alias("url"),
        X.epoch_seconds_to_ts(t["created"]).alias("created"),
        F.coalesce(t["comment_score_hide_mins"], F.lit(0)).alias("comment_hide_mins"),
        F.coalesce(t["accounts_active"], F.lit(0)).alias("active"),
        F.coalesce(t["subscribers"], F.lit(0).cast("long")).alias("subscribers"),
        F.coalesce(t["over18"], F.lit(False)).alias("over18"),
    )


def parse_story_pages(pages: DataFrame, value_col: str = "value", strict: bool = False) -> DataFrame:
    """S1 → S2 → S3 in one call: landed listing pages → one story row per accepted child."""
    return story_fields(parse_things(parse_listing(pages, value_col, strict), S.KIND_STORY, strict))


def parse_about(abouts: DataFrame, value_col: str = "value", strict: bool = False) -> DataFrame:
    """Single-thing ``about`` payloads (kind t5) → subreddit rows."""
    keep = [c for c in abouts.columns if c != value_col]
    things = abouts.select(*keep, F.from_json(F.col(value_col), S.RAW_THING).alias("_t")).select(
        *keep, F.col("_t.kind").alias("kind"), F.col("_t.data").alias("data"))
    return subreddit_fields(parse_things(things, S.KIND_SUBREDDIT, strict))


def lookup_about(landed: DataFrame, names: DataFrame, value_col: str = "value") -> DataFrame:
    """One row per asked name: name, status, found and the community's fields.

    ``landed`` has (requested, status, payload), one row per request. The landed payloads are
    cut down to the asked names before any is parsed. found is true for status 200 with a
    payload of the right kind; other names (never landed: status null) have null fields.
    """
    asked = names.select("name").distinct()
    own = landed.join(asked.select(F.col("name").alias("requested")), "requested", "left_semi")
    parsed = parse_about(own.filter(F.col("status") == 200), value_col).drop("name", "status")
    status = own.select(F.col("requested").alias("name"), "status")
    return (asked.join(status, "name", "left").join(parsed.withColumnRenamed("requested", "name")
                                                    .withColumn("found", F.lit(True)), "name", "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def about_rejects(abouts: DataFrame, value_col: str = "value") -> DataFrame:
    keep = [c for c in abouts.columns if c != value_col]
    things = abouts.select(*keep, F.from_json(F.col(value_col), S.RAW_THING).alias("_t")).select(
        *keep, F.col("_t.kind").alias("kind"), F.col("_t.data").alias("data"))
    return thing_rejects(things, S.KIND_SUBREDDIT)
