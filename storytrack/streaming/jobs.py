"""Structured Streaming jobs: continuous discovery, tracked-story expiry, rates, sampling.

Inputs are landed records in a folder (JSON lines with page metadata and the raw
payload text), read with ``readStream`` and an explicit schema. Sinks are
``foreachBatch`` writers keyed by ``batchId`` (a replayed batch overwrites its own
output, so re-execution after a failure is idempotent) or append-mode file sinks.
Checkpoints live under the cluster's shared checkpoint folder.

"Now" is taken anew for every micro-batch: the newest landing time of the batch, unless
the caller fixes it (``as_of``) or gives a function of (batch, batch id). Tables that the
crawler changes meanwhile are given as functions too, and are read anew for every batch.

Current-state tables change by deltas: a batch writes the rows it changed, and only those,
to ``<name>_delta/batch=N`` (whole rows, or id and state where nothing else can change);
:func:`current` reads base and deltas together and
:func:`fold_deltas` folds them into a new base.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storytrack.functions import scalars as X
from storytrack.operators import history as H
from storytrack.operators import merge as M
from storytrack.operators import select as sel
from storytrack.plans import jobs
from storytrack.sources import archive as A
from storytrack.sources import payload as P

LANDED_PAGE = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("page", T.LongType()),
    T.StructField("tick", T.TimestampType()),
    T.StructField("value", T.StringType()),
])
Table = DataFrame | Callable[[], DataFrame]
Clock = _dt.datetime | str | None | Callable[[DataFrame, int], _dt.datetime]


def _glob(folder: str) -> str:
    """Files one or two levels below ``folder`` (producers land into sub-folders)."""
    return f"{folder.rstrip('/')}/*/*"


def _source(spark: SparkSession, schema: T.StructType, max_files: int | None):
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def read_landed_pages(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    return _source(spark, LANDED_PAGE, max_files).json(_glob(landing))


def await_done(query, timeout_s: int = 1800):
    """Wait for a query to end; one that is still running after ``timeout_s`` is stopped and raises."""
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream was still running after {timeout_s} s")
    if query.exception() is not None:
        raise query.exception()
    return query


def _start(df: DataFrame, process, checkpoint: str, trigger_s: int | None = None):
    """Run ``process`` for every micro-batch: once over what has landed, or every ``trigger_s`` seconds."""
    writer = df.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_s is None else writer.trigger(
        processingTime=f"{trigger_s} seconds")
    return writer.start()


def _now(as_of: Clock, batch: DataFrame, batch_id: int, landed_col: str):
    if callable(as_of):
        return as_of(batch, batch_id)
    return batch.agg(F.max(landed_col)).first()[0] if as_of is None else as_of  # one value


def _read(table: Table) -> DataFrame:
    return table() if callable(table) else table


def _written(spark: SparkSession, root: str, before: int, schema: T.StructType) -> DataFrame:
    """Rows under ``root/batch=N`` of the batches N < ``before`` (none yet: no rows)."""
    schema = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root).filter(F.col("batch") < before)


# -- delta snapshots -------------------------------------------------------------------

FOREVER = 2 ** 31 - 1
STATE = [*M.STATE_FIELDS, "updated_at", "checked_at"]  # what a sample may change
STATE_ONLY = T.StructField("state_only", T.BooleanType())  # true: the delta row holds id and STATE, no more


def current(spark: SparkSession, base: DataFrame, out_root: str, name: str = "story",
            before: int = FOREVER) -> DataFrame:
    """``base`` with the rows that batches before ``before`` changed or added (newest batch wins)."""
    deltas = _written(spark, f"{out_root}/{name}_delta", before, T.StructType([*base.schema.fields, STATE_ONLY]))
    whole = deltas.filter("state_only IS NULL")
    rest = [c for c in base.columns if c != "id"]
    newest = (whole.groupBy("id").agg(F.max_by(F.struct(*rest), "batch").alias("_r"), F.max("batch").alias("_at"))
              .select(*[F.col("id") if c == "id" else F.col("_r")[c].alias(c) for c in base.columns], "_at"))
    rows = (base.join(whole.select("id").distinct(), "id", "left_anti").select(*base.columns, F.lit(-1).alias("_at"))
            .unionByName(newest))
    if not set(STATE) <= set(base.columns):
        return rows.select(base.columns)
    states = deltas.filter("state_only").groupBy("id").agg(
        F.max_by(F.struct(*STATE), "batch").alias("_s"), F.max("batch").alias("_batch"))
    # An id that a batch has changed has one row, as with whole rows, also if the base repeats it.
    copy = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    held = rows.join(states, "id", "left").withColumn("_copy", copy).filter("_batch IS NULL OR _copy = 1")
    take = F.col("_batch") > F.col("_at")
    return held.select(*[F.when(take, F.col("_s")[c]).otherwise(F.col(c)).alias(c) if c in STATE else F.col(c)
                         for c in base.columns])


def _write_delta(df: DataFrame, out_root: str, batch_id: int, name: str = "story") -> None:
    df.write.mode("overwrite").parquet(f"{out_root}/{name}_delta/batch={batch_id}")


def fold_deltas(spark: SparkSession, base: DataFrame, out_root: str, new_base: str, name: str = "story") -> DataFrame:
    """Write base and deltas as one table at ``new_base`` and remove the folded deltas.

    Run it while the stream is stopped; the stream then goes on with the table returned."""
    current(spark, base, out_root, name).write.mode("overwrite").parquet(new_base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_root}/{name}_delta")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.parquet(new_base)


# -- ST1 (+ST5): continuous discovery ------------------------------------------------

def discovery_stream(spark: SparkSession, landing: str, story0: DataFrame, subreddit: Table,
                     out_root: str, checkpoint: str, as_of: Clock = None, max_files: int | None = None,
                     trigger_s: int | None = None):
    """ST1: each micro-batch of landed pages runs the discovery job (E1) against the stories
    as the previous batches left them and writes, under ``out_root``: ``samples/batch=N``,
    ``new_stories/batch=N`` and the changed and new rows as ``story_delta/batch=N``. Pages
    that landed before any community is known are guarded as others: the stream goes on."""

    def process(batch: DataFrame, batch_id: int) -> None:
        story = current(spark, story0, out_root, before=batch_id)
        run = jobs.discovery(batch, story, _read(subreddit), _now(as_of, batch, batch_id, "tick"), need_known=False)
        # A scrape's outputs are small (≤ one row per story seen); each is computed once
        # and reused by the writes below.
        samples = run.samples.persist(StorageLevel.MEMORY_AND_DISK)
        new_stories = run.new_stories.persist(StorageLevel.MEMORY_AND_DISK)
        samples.write.mode("overwrite").parquet(f"{out_root}/samples/batch={batch_id}")
        new_stories.write.mode("overwrite").parquet(f"{out_root}/new_stories/batch={batch_id}")
        # Only the stories this scrape saw are read, refreshed (K6) and written again.
        seen = M.restrict(story, samples.select(F.col("story").alias("id")), "id").select(story.columns)
        changed = M.apply_samples(seen.unionByName(new_stories.select(story.columns)), samples)
        _write_delta(changed, out_root, batch_id)
        for df in (samples, new_stories, run.feed_stories):
            df.unpersist()

    return _start(read_landed_pages(spark, landing, max_files), process, checkpoint, trigger_s)


def state_stream(spark: SparkSession, samples_src: str, schema: T.StructType, story0: DataFrame,
                 out_root: str, checkpoint: str, max_files: int | None = None, trigger_s: int | None = None):
    """ST5: an append-only stream of samples keeps the current-state table fresh. Each
    micro-batch reduces its samples to the newest per story (a partial aggregate), applies
    them to those stories (K6: a sample older than the stored state changes nothing; samples
    of deleted stories change nothing) and writes their ids and states as
    ``story_delta/batch=N``: the other columns never change here and are not shuffled."""

    def process(batch: DataFrame, batch_id: int) -> None:
        samples = batch.select("story", "timestamp", *M.STATE_FIELDS)
        story = current(spark, story0, out_root, before=batch_id).select("id", *STATE)
        seen = M.restrict(story, samples.select(F.col("story").alias("id")), "id").select(story.columns)
        _write_delta(M.apply_samples(seen, samples).withColumn("state_only", F.lit(True)), out_root, batch_id)

    return _start(_source(spark, schema, max_files).parquet(_glob(samples_src)), process, checkpoint, trigger_s)


# -- ST2: discovered once while tracked ------------------------------------------------

TRACKED = T.StructType([T.StructField("short_id", T.StringType()), T.StructField("discovered_at", T.TimestampType())])


def discoveries_stream(spark: SparkSession, landing: str, out_root: str, checkpoint: str,
                       track_s: int = sel.STORY_TRACK_AGE_S, max_files: int | None = None,
                       trigger_s: int | None = None):
    """ST2: a story is discovered when a scrape sees it and it is not tracked; it is tracked
    for ``track_s`` seconds from then on (after which the archive has taken and deleted it).

    Of each (tick, story) the feed union (U1) decides which copy counts. A batch of several
    ticks is taken in tick order. Writes ``discoveries/batch=N`` and the stories still tracked
    after it, ``tracked/batch=N`` (as many as are discovered in the tracking time)."""

    def process(batch: DataFrame, batch_id: int) -> None:
        feed = M.union_feeds(P.parse_story_pages(batch).drop("before", "after", "kind"))
        held = _written(spark, f"{out_root}/tracked", batch_id, TRACKED).filter(F.col("batch") == batch_id - 1)
        ticks = feed.groupBy("short_id").agg(F.array_sort(F.collect_set("tick")).alias("_ticks"))  # a batch's ticks
        since = ticks.join(held.select("short_id", "discovered_at"), "short_id", "left")
        start = F.struct(F.col("discovered_at").alias("last"), F.array().cast("array<timestamp>").alias("found"))

        def step(acc, tick):
            new = acc["last"].isNull() | (tick >= X.plus_seconds(acc["last"], track_s))
            return F.struct(F.when(new, tick).otherwise(acc["last"]).alias("last"),
                            F.when(new, F.concat(acc["found"], F.array(tick))).otherwise(acc["found"]).alias("found"))

        firsts = (since.select("short_id", F.explode(F.aggregate("_ticks", start, step)["found"]).alias("tick"))
                  .persist(StorageLevel.MEMORY_AND_DISK))
        (feed.join(firsts, ["short_id", "tick"])
         .select("tick", "feed", "page", "pos", "short_id", "subreddit_name", "created_at")
         .write.mode("overwrite").parquet(f"{out_root}/discoveries/batch={batch_id}"))
        last = batch.select(F.max("tick")).scalar()
        (held.select("short_id", "discovered_at").unionByName(firsts.withColumnRenamed("tick", "discovered_at"))
         .groupBy("short_id").agg(F.max("discovered_at").alias("discovered_at"))
         .filter(X.plus_seconds("discovered_at", track_s) > last)
         .write.mode("overwrite").parquet(f"{out_root}/tracked/batch={batch_id}"))
        firsts.unpersist()

    return _start(read_landed_pages(spark, landing, max_files), process, checkpoint, trigger_s)


# -- ST7: meter rates ------------------------------------------------------------------

def rate_stream(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
                minutes: int = 5, delay: str = "10 minutes", ts_col: str = "seen_at",
                max_files: int | None = None):
    """ST7: tumbling-window counts with a watermark, append mode (each window is final
    when emitted; state is bounded by the watermark)."""
    rows = _source(spark, schema, max_files).parquet(_glob(source)).withWatermark(ts_col, delay)
    counts = (rows.groupBy(F.window(ts_col, f"{minutes} minutes").alias("w"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                      (F.col("n") / F.lit(60.0 * minutes)).alias("rate_per_s")))
    return (counts.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


# -- ST3 + ST4 + ST6: tracked-story expiry to the archive ------------------------------

ARCHIVE_DELAY_S = 3600
ARCHIVED = T.StructType([T.StructField("id", T.LongType())])
CLOCK = T.StructType([T.StructField("clock", T.TimestampType())])


def archive_stream(spark: SparkSession, samples_src: str, schema: T.StructType, out_root: str,
                   checkpoint: str, story: Table, subreddit: Table, track_s: int = sel.STORY_TRACK_AGE_S,
                   delay_s: int = ARCHIVE_DELAY_S, max_files: int | None = None, trigger_s: int | None = None):
    """ST3/ST4/ST6: samples are kept until their story's window (created_at + ``track_s``)
    has closed, then the story is archived once, as the batch archive would do it.

    Every micro-batch appends its samples to ``samples/batch=N`` (by creation day), moves the
    event clock to the newest sample time so far less ``delay_s``, and archives every story
    of the story table (read anew) whose window has closed by then: also those without
    samples, first seen late or discovered meanwhile. Records go to ``archive/batch=N`` (gzip
    JSON lines by day), their ids, read back from the records, to ``archived/batch=N``.
    Samples after their story's window, or of stories archived before they came, go to
    ``late/batch=N`` with a reason, so none is lost unseen."""

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("created_day", X.utc_day("created_at")).persist(StorageLevel.MEMORY_AND_DISK)
        done = _written(spark, f"{out_root}/archived", batch_id, ARCHIVED).select("id")
        gone = rows.join(M.restrict(done, rows.select(F.col("story").alias("id")), "id")
                         .select(F.col("id").alias("story"), F.lit(True).alias("_gone")), "story", "left")
        outside = F.col("timestamp") >= X.plus_seconds("created_at", track_s)
        reason = F.when(outside, F.lit("outside_window")).when(F.col("_gone"), F.lit("already_archived"))
        marked = gone.withColumn("reason", reason).drop("_gone").persist(StorageLevel.MEMORY_AND_DISK)
        marked.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{out_root}/late/batch={batch_id}")
        # Clustered by day: a batch writes about one file a day, not one for each task and day.
        (marked.filter("reason IS NULL").drop("reason").hint("rebalance", "created_day")
         .write.mode("overwrite").partitionBy("created_day").parquet(f"{out_root}/samples/batch={batch_id}"))
        # The clock of the batch before holds the newest time of all batches before.
        moved = rows.select(F.max("timestamp").alias("clock")).unionByName(
            _written(spark, f"{out_root}/clock", batch_id, CLOCK).filter(F.col("batch") == batch_id - 1).select("clock"))
        moved.agg(F.max("clock").alias("clock")).write.mode("overwrite").parquet(f"{out_root}/clock/batch={batch_id}")
        clock = spark.read.parquet(f"{out_root}/clock/batch={batch_id}").first()[0]
        if clock is not None:
            closed = X.minus_seconds(F.lit(clock), delay_s)
            due = (_read(story).filter(X.plus_seconds("created_at", track_s) <= closed)
                   .join(done, "id", "left_anti"))
            days = due.select(F.col("id").alias("story"), X.utc_day("created_at").alias("created_day"))
            held_schema = T.StructType([*schema.fields, T.StructField("created_day", T.StringType())])
            held = _written(spark, f"{out_root}/samples", batch_id + 1, held_schema)
            hist = held.join(days, ["story", "created_day"], "left_semi")
            details = H.story_detail(due, _read(subreddit), H.with_ties(hist))
            # Each batch owns archive/batch=N/ (days inside), replaced on replay.
            A.write_archive(details, f"{out_root}/archive/batch={batch_id}", overwrite_root=True)
            jobs.archived_ids(due, A.read_archive(spark, f"{out_root}/archive/batch={batch_id}")).write.mode(
                "overwrite").parquet(f"{out_root}/archived/batch={batch_id}")
        marked.unpersist()
        rows.unpersist()

    return _start(_source(spark, schema, max_files).parquet(_glob(samples_src)), process, checkpoint, trigger_s)


# -- ST8: subreddit sampling ---------------------------------------------------------

LANDED_ABOUT = T.StructType([
    T.StructField("requested", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("landed_at", T.TimestampType()),
])


def subreddit_sampling_stream(spark: SparkSession, landing: str, subreddit0: DataFrame, out_root: str,
                              checkpoint: str, as_of: Clock = None, strict: bool = False,
                              max_files: int | None = None, trigger_s: int | None = None):
    """ST8: landed ``about`` records → one sample per stale subreddit per batch (K8), stamped
    with the batch's landing time, and the sampled communities' ``updated_at`` refreshed in
    ``subreddit_delta/batch=N``; 403 responses skip the subreddit; other failures raise when
    ``strict``. Of several records of a community in a batch the last landed counts."""

    def process(batch: DataFrame, batch_id: int) -> None:
        now = _now(as_of, batch, batch_id, "landed_at")
        prev = current(spark, subreddit0, out_root, "subreddit", batch_id)
        last = M.dedup_last_wins(batch, keys=("requested",), order=("landed_at", "status", "value"))
        parsed = P.parse_about(last.filter(F.col("status") == 200).drop("landed_at"))
        failed = last.filter(F.col("status") != 200)
        rows = M.subreddit_history_append(sel.subreddits_stale(prev, now), parsed.unionByName(
            failed.select("requested", "status").withColumn("name", F.lit(None).cast("string")),
            allowMissingColumns=True), now, strict)
        rows.write.mode("overwrite").parquet(f"{out_root}/samples/batch={batch_id}")
        written = spark.read.parquet(f"{out_root}/samples/batch={batch_id}")
        hit = M.restrict(prev, written.select(F.col("subreddit").alias("id")), "id").select(prev.columns)
        _write_delta(M.refresh_sampled(hit, written, now).select(prev.columns), out_root, batch_id, "subreddit")

    return _start(_source(spark, LANDED_ABOUT, max_files).json(_glob(landing)), process, checkpoint, trigger_s)
