"""Per-story time series: ordered arrays, latest / first state, offsets, detail records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storytrack.functions import scalars as X
from storytrack.operators import select as sel
from storytrack.session import stored

HISTORY_FIELDS = ["timestamp", "score", "hotness", "gilded", "comments"]
ORDER_KEYS = ["timestamp", "tie1", "tie2", "tie3"]


def _sample_struct():
    # Field order = sort order: time first, then the tie-break key, then the payload.
    return F.struct(*[F.col(c) for c in ORDER_KEYS],
                    F.col("score"), F.col("hotness"), F.col("gilded"), F.col("comments"))


DEFAULT_MAX_POINTS = 100_000


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(_sample_struct())).alias("_s"))
    return grouped.select(
        *keys,
        F.transform("_s", lambda s: F.unix_millis(s["timestamp"])).alias("timestamp"),
        F.transform("_s", lambda s: s["score"]).alias("score"),
        F.transform("_s", lambda s: s["hotness"]).alias("hotness"),
        F.transform("_s", lambda s: s["gilded"]).alias("gilded"),
        F.transform("_s", lambda s: s["comments"]).alias("comments"),
    )


def with_ties(samples: DataFrame) -> DataFrame:
    """Samples with the columns a history has: missing tie keys are 0, a missing hotness NULL."""
    for c in ORDER_KEYS[1:]:
        if c not in samples.columns:
            samples = samples.withColumn(c, F.lit(0).cast("long"))
    return samples if "hotness" in samples.columns else samples.withColumn("hotness", F.lit(None).cast("double"))


def positions(history: DataFrame, name: str = "seq") -> DataFrame:
    """1-based position of every sample in its story's time order.

    Samples per (story, day) are counted (a partial aggregate) and summed over the earlier
    days; the position inside a day is a window over one day of one story. The history is
    shuffled once and no task holds more of a story than a day of it.
    """
    day = F.to_date("timestamp").alias("_day")
    counts = history.groupBy("story", day).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("story").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("story", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("story", "_day").orderBy(*ORDER_KEYS)
    return (history.select("*", day).join(before, ["story", "_day"])
            .withColumn(name, F.col("_before") + F.row_number().over(own)).drop("_day", "_before"))


def history_arrays(history: DataFrame, max_points: int = DEFAULT_MAX_POINTS) -> DataFrame:
    """A1: per story and chunk, five parallel arrays sorted by time (ties by the tie key).

    Chunk n (0, 1, …) holds the story's samples n·max_points + 1 to (n + 1)·max_points in
    time order, so no array exceeds ``max_points`` and nothing is dropped. Only stories with
    more samples than that need positions (:func:`positions`) to know a sample's chunk; for
    the others it is 0. Which they are is counted first, so that the history is not prepared
    and shuffled a second time for long stories that it does not have.
    """
    many = stored(history.groupBy("story").agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > F.lit(max_points)).select("story"), "long-stories")
    if many.isEmpty():  # no story needs a second chunk: the history is read and shuffled once
        return _fold(history, ["story"]).withColumn("chunk", F.lit(0).cast("long"))
    one = history.join(many, "story", "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    cut = positions(history.join(many, "story", "left_semi"), "_seq").withColumn(
        "chunk", F.floor((F.col("_seq") - 1) / F.lit(max_points)).cast("long")).drop("_seq")
    return _fold(one, ["story", "chunk"]).unionByName(_fold(cut, ["story", "chunk"]))


def history_struct(arrays: DataFrame) -> DataFrame:
    return arrays.select("story", F.struct(*[F.col(c) for c in HISTORY_FIELDS]).alias("history"))


def story_detail(story: DataFrame, subreddit: DataFrame, history: DataFrame,
                 short_ids: DataFrame | None = None) -> DataFrame:
    """A2 (+J2, J3): summary fields + history arrays; stories without samples get empty arrays.

    With ``short_ids`` (a frame with column ``short_id``) only those stories are built: the
    story table and the history are cut down to them before anything is folded, so a
    lookup of a few ids never aggregates the whole history. The ids and their stories are
    written first (:func:`stored`), so that a few of them are broadcast and the tables they cut
    are not shuffled.
    """
    if short_ids is not None:
        wanted = stored(short_ids.select(F.col("short_id").alias("reddit_short_id")).distinct(), "wanted-ids")
        story = stored(story.join(wanted, "reddit_short_id", "left_semi"), "wanted-stories")
        history = history.join(story.select(F.col("id").alias("story")), "story", "left_semi")
    summaries = sel.summary_columns(story, subreddit)
    arrays = history_arrays(history)
    j = summaries.join(arrays.withColumnRenamed("story", "story_id")
                       .select("story_id", "chunk", *[F.col(c).alias("h_" + c) for c in HISTORY_FIELDS]),
                       "story_id", "left")
    empties = {
        "timestamp": F.array().cast("array<bigint>"), "score": F.array().cast("array<int>"),
        "hotness": F.array().cast("array<double>"), "gilded": F.array().cast("array<int>"),
        "comments": F.array().cast("array<int>"),
    }
    hist = F.struct(*[F.coalesce(F.col("h_" + c), empties[c]).alias(c) for c in HISTORY_FIELDS])
    # A story over the array bound yields one record per chunk (consecutive time slices).
    return j.select("story_id", *[F.col(c) for c in sel.SUMMARY_FIELDS if c != "story_id"],
                    F.coalesce(F.col("chunk"), F.lit(0).cast("long")).alias("chunk"), hist.alias("history"))


def detail_record(details: DataFrame) -> DataFrame:
    """Nest into the archive record shape {summary{…}, history{…}, chunk}."""
    return details.select("story_id", F.struct(sel.summary_struct().alias("summary"), F.col("history"),
                                               F.col("chunk")).alias("record"))


def detail_json(details: DataFrame) -> DataFrame:
    return detail_record(details).select(
        "story_id", F.to_json("record", {"ignoreNullFields": "false"}).alias("json"))


def latest_state(history: DataFrame) -> DataFrame:
    """Newest sample per story (the state the current-state table must hold)."""
    order = F.struct(*[F.col(c) for c in ORDER_KEYS])
    agg = history.groupBy("story").agg(
        F.max_by(_sample_struct(), order).alias("s"), F.count(F.lit(1)).alias("n_samples"))
    return agg.select("story", F.col("s.timestamp").alias("updated_at"), "s.score", "s.hotness",
                      "s.comments", "s.gilded", "n_samples")


def first_state(history: DataFrame) -> DataFrame:
    """First sample per story (the discovery row)."""
    order = F.struct(*[F.col(c) for c in ORDER_KEYS])
    agg = history.groupBy("story").agg(F.min_by(_sample_struct(), order).alias("s"))
    return agg.select("story", F.col("s.timestamp").alias("discovered_at"), "s.score",
                      "s.hotness", "s.comments", "s.gilded")


def history_ordered(history: DataFrame) -> DataFrame:
    """T4: every sample with its 1-based position in its story's time order."""
    return positions(history)


def history_offsets(history: DataFrame, story: DataFrame) -> DataFrame:
    """D3: seconds from the story's creation to each sample (negative when earlier)."""
    created = story.select(F.col("id").alias("story"), "created_at")
    return (history.join(created, "story", "inner")
            .withColumn("offset_s", X.seconds_between("timestamp", "created_at")))


def discovery_delay(story: DataFrame) -> DataFrame:
    """Discovery delay in whole seconds (rounded for display)."""
    return story.select("id", F.round(X.seconds_between("discovered_at", "created_at"), 0)
                        .alias("discovery_delay_s"))
