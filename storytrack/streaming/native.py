"""Streams on Spark's own state: de-duplication, event-time union and stream-stream joins.

The jobs in :mod:`storytrack.streaming.jobs` keep their state in tables, so that it can be read
and repaired. These keep it in Spark's state store instead: no table to fold, exactly-once file
sinks, and state that the watermark evicts. What they emit, they emit when the watermark has
passed, so a result comes one watermark delay later; rows older than the watermark are dropped
by Spark and counted in the query's progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storytrack.operators import merge as M
from storytrack.operators import select as sel
from storytrack.sources import payload as P
from storytrack.streaming.jobs import _glob, _source, read_landed_pages

FEED_DELAY = "1 day"


def _append(df: DataFrame, out: str, checkpoint: str, trigger_s: int | None = None):
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_s is None else writer.trigger(processingTime=f"{trigger_s} seconds")
    return writer.outputMode("append").start()


def sightings_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, track_s: int = sel.STORY_TRACK_AGE_S,
                     max_files: int | None = None, trigger_s: int | None = None):
    """ST2 on Spark's de-duplication: (tick, short_id) of stories seen for the first time while tracked.

    ``dropDuplicatesWithinWatermark`` keeps a story's first sighting for at least ``track_s``
    seconds of event time. It forgets a story when the watermark passes that time, so one that
    comes back later than ``track_s`` but before the watermark (another ``track_s`` behind the
    newest tick, and moved only between batches) is still held back; ``discoveries_stream``
    discovers it anew. Stories that stay away for less than ``track_s``, or for good, are
    found alike. Of a batch of several ticks any copy may come first: give one tick a batch
    where the tick itself matters.
    """
    parsed = P.parse_story_pages(read_landed_pages(spark, landing, max_files))
    seen = (parsed.select("tick", "short_id").withWatermark("tick", f"{track_s} seconds")
            .dropDuplicatesWithinWatermark(["short_id"]))
    return _append(seen, out, checkpoint, trigger_s)


def union_stream(spark: SparkSession, hot: str, new: str, out: str, checkpoint: str, delay: str = FEED_DELAY,
                 max_files: int | None = None, trigger_s: int | None = None):
    """ST1/U1: the union of two feeds that land apart, one row per (tick, story).

    Each feed has a watermark of its own; the query's is the smaller of the two, so a scrape
    is complete only when both feeds have moved ``delay`` past it. The hot copy wins, within a
    feed the first; in_new tells that the new feed carried the story. A feed that stops landing
    holds the union back: that is what a complete scrape means.
    """
    sides = [P.parse_story_pages(read_landed_pages(spark, folder, max_files)).drop("before", "after", "kind")
             .withWatermark("tick", delay) for folder in (hot, new)]
    return _append(M.union_feeds(sides[0].unionByName(sides[1])), out, checkpoint, trigger_s)


def samples_with_stories(spark: SparkSession, samples: str, sample_schema: T.StructType, stories: str,
                         story_schema: T.StructType, out: str, checkpoint: str, track_s: int = sel.STORY_TRACK_AGE_S,
                         delay: str = "1 hour", max_files: int | None = None, trigger_s: int | None = None):
    """ST3/J2: every sample with its story (null fields for a sample outside its story's window).

    A stream-stream left outer join on the story's id and the time bound ``created_at <=
    timestamp < created_at + track_s``. The bound tells how long either side must be kept:
    state holds the samples and stories of one tracking time, whatever the streams' length.
    """
    left = _source(spark, sample_schema, max_files).parquet(_glob(samples)).withWatermark("timestamp", delay)
    right = _source(spark, story_schema, max_files).parquet(_glob(stories)).withWatermark("created_at", delay)
    inside = ((F.col("timestamp") >= F.col("created_at"))
              & (F.col("timestamp") < F.col("created_at") + F.expr(f"INTERVAL {track_s} SECONDS")))
    return _append(left.join(right, (F.col("story") == F.col("id")) & inside, "left"), out, checkpoint, trigger_s)


def stories_with_context(spark: SparkSession, stories: str, story_schema: T.StructType, samples: str,
                         sample_schema: T.StructType, out: str, checkpoint: str, within_s: int,
                         delay: str = "1 hour", max_files: int | None = None, trigger_s: int | None = None):
    """ST3/J8: every story with its community's last sample of the ``within_s`` seconds before its creation.

    The join finds all samples of that time; the aggregate behind it keeps the last one (ties:
    larger id) once the watermark has passed the story. Story columns: id, subreddit,
    created_at; sample columns: subreddit, id, timestamp, subscribers, active.
    """
    left = _source(spark, story_schema, max_files).parquet(_glob(stories)).withWatermark("created_at", delay)
    right = (_source(spark, sample_schema, max_files).parquet(_glob(samples))
             .select(F.col("subreddit").alias("_sub"), F.col("id").alias("sample"), F.col("timestamp").alias("sampled_at"),
                     "subscribers", "active").withWatermark("sampled_at", delay))
    before = ((F.col("sampled_at") <= F.col("created_at"))
              & (F.col("sampled_at") >= F.col("created_at") - F.expr(f"INTERVAL {within_s} SECONDS")))
    both = left.join(right, (F.col("subreddit") == F.col("_sub")) & before, "left")
    last = F.max_by(F.struct("sample", "sampled_at", "subscribers", "active"), F.struct("sampled_at", "sample"))
    found = both.groupBy("created_at", "id", "subreddit").agg(last.alias("_l"))
    return _append(found.select("id", "subreddit", "created_at", "_l.sample", "_l.sampled_at", "_l.subscribers", "_l.active"),
                   out, checkpoint, trigger_s)
