"""Day-partitioned, gzip-compressed JSON-lines archive of finished stories.

Layout: ``<root>/archive_date=yyyy-MM-dd/[batch=<id>/]part-*.json.gz``, one record
``{"summary": {…}, "history": {…}, "chunk": 0}`` per line (``chunk`` counts the
records of a story whose history is over the array bound), nulls written explicitly. Any Hadoop
path works (local, HDFS, object stores). Gzip is not splittable, so files are bounded
with ``maxRecordsPerFile``; a write rebalances on the day so a hot day is split over
several tasks instead of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storytrack import schemas as S
from storytrack.functions import scalars as X
from storytrack.operators import select as sel
from storytrack.session import checkpoint_dir

MAX_RECORDS_PER_FILE = 50_000
GZIP_LEVEL = "BEST_SPEED"  # writing records is mostly compression
ARCHIVE_READ_SCHEMA = T.StructType(S.DETAIL.fields + [T.StructField("archive_date", T.StringType())])
ARCHIVE_BATCH_SCHEMA = T.StructType(ARCHIVE_READ_SCHEMA.fields + [T.StructField("batch", T.LongType())])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def archive_frame(details: DataFrame) -> DataFrame:
    """Detail rows (see history.story_detail) → (archive_date, summary, history).

    The day is the story's UTC creation day. Details hold one row per story (the story
    id is the table's key); copies written by replays collapse in :func:`compact_archive`.
    """
    return details.select(
        X.utc_day(F.timestamp_millis(F.col("createdAt"))).alias("archive_date"),
        sel.summary_struct().alias("summary"),
        F.col("history"), F.col("chunk"))


def _spread_days(rec: DataFrame) -> DataFrame:
    """Cluster records by day for the partitioned writer. AQE sizes the writer tasks from
    the data (advisory partition size) and splits a skewed (hot-day) partition."""
    return rec.hint("rebalance", "archive_date")


def write_archive(details: DataFrame, root: str, batch_id: int | None = None,
                  replace_batch: bool = False, max_records_per_file: int = MAX_RECORDS_PER_FILE,
                  overwrite_root: bool = False) -> None:
    """K2/K3: append records under their day. With ``batch_id`` the batch gets its own
    sub-partition; ``replace_batch=True`` writes it with dynamic partition overwrite so a
    replayed batch replaces its own files (idempotent) — at the price of a staging-folder
    rename per partition, so plain appends are the default."""
    rec = archive_frame(details)
    parts = ["archive_date"]
    mode = "overwrite" if overwrite_root else "append"  # overwrite_root: ``root`` belongs to one batch
    if batch_id is not None:
        rec = rec.withColumn("batch", F.lit(int(batch_id)).cast("long"))
        parts.append("batch")
        mode = "overwrite" if replace_batch else "append"
    (_spread_days(rec)
     .write.mode(mode)
     .option("partitionOverwriteMode", "dynamic")
     .option("compression", "gzip")
     .option("zlib.compress.level", GZIP_LEVEL)
     .option("ignoreNullFields", "false")
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(*parts)
     .json(root))


def read_archive(spark: SparkSession, root: str, batched: bool = False) -> DataFrame:
    """Read records back with an explicit schema; ``archive_date`` from the path."""
    schema = ARCHIVE_BATCH_SCHEMA if batched else ARCHIVE_READ_SCHEMA
    return spark.read.schema(schema).json(root)


def compact_archive(spark: SparkSession, root: str, out: str, batched: bool = False,
                    max_records_per_file: int = MAX_RECORDS_PER_FILE, days: list[str] | None = None) -> DataFrame:
    """K4: rewrite the archive as few large files per day, one record per story and chunk.

    At-least-once archiving can write a story twice (a crash between write and delete, or a
    story that came back late): of the records with equal (day, story, chunk) the one with
    the most samples stays (ties: later batch). ``days`` (yyyy-MM-dd) names the days to
    rewrite, read by partition; default all. Dynamic partition overwrite replaces only the
    days that were read.
    """
    recs = read_archive(spark, root, batched)
    if days is not None:
        recs = recs.filter(F.col("archive_date").isin(days))
    write_compacted(best_records(recs if batched else recs.withColumn("batch", F.lit(0).cast("long"))),
                    out, max_records_per_file)
    return read_archive(spark, out)


def best_records(recs: DataFrame) -> DataFrame:
    """Of batched records with equal (day, story, chunk) the one with the most samples (ties: later batch)."""
    return (recs.groupBy("archive_date", F.col("summary.id").alias("_sid"),
                         F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"))
            .agg(F.max_by(F.struct("summary", "history"),
                          F.struct(F.size("history.timestamp"), F.col("batch"))).alias("_r"))
            .select("archive_date", "_r.summary", "_r.history", "chunk"))


def write_compacted(best: DataFrame, out: str, max_records_per_file: int = MAX_RECORDS_PER_FILE) -> None:
    """Replace the days of ``best`` under ``out``; other days stay as they are."""
    (_spread_days(best)
     .write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .option("compression", "gzip")
     .option("zlib.compress.level", GZIP_LEVEL)
     .option("ignoreNullFields", "false")
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("archive_date")
     .json(out))


def archive_day_counts(details: DataFrame) -> DataFrame:
    """A4: records per UTC creation day."""
    return archive_frame(details).groupBy("archive_date").agg(F.count(F.lit(1)).alias("n_records"))


def record_columns(records: DataFrame) -> DataFrame:
    """Flatten read-back records into scalar columns (for checks and reports)."""
    return records.select(
        "archive_date",
        F.col("summary.id").alias("id"),
        F.col("summary.createdAt").alias("createdAt"),
        F.col("summary.subreddit").alias("subreddit"),
        F.col("summary.score").alias("score"),
        F.size("history.timestamp").alias("n_points"),
        F.array_min("history.timestamp").alias("first_ts"),
        F.array_max("history.timestamp").alias("last_ts"),
        F.aggregate("history.score", F.lit(0).cast("long"), lambda a, x: a + x).alias("score_sum"),
    )
