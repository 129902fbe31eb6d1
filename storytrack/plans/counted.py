"""Jobs that write their tables and report affected rows from the same pass.

Every count is a metric observed on rows on their way into a file (``DataFrame.observe``), so
nothing is read or computed a second time to be counted, and a count tells what was written.
Rows that a write leaves out (deleted stories, cascaded samples) are flagged, counted and then
filtered in one pass over the table. A count is known once its write has ended; a stage that
is repeated after a lost executor may observe rows again, so counts are reports, not ledgers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from storytrack.operators import merge as M
from storytrack.plans import jobs
from storytrack.session import AS_OF
from storytrack.sources import archive as A

EVERY = F.lit  # a counter's condition that holds for every row: EVERY(True)


@dataclass
class Counted:
    """Tables written under ``root``, and the counters observed meanwhile."""

    spark: SparkSession
    root: str
    counts: dict[str, int] = field(default_factory=dict)

    def write(self, name: str, df: DataFrame, drop: Column | None = None, **counters: Column) -> DataFrame:
        """Write ``df`` without the rows that ``drop`` names and without columns that start with ``_``.

        ``counters`` are conditions; each counts the rows, dropped ones included, that meet it.
        """
        path = f"{self.root}/{name}"
        seen = Observation()
        held = df.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counters.items()]) if counters else df
        if drop is not None:
            held = held.filter(~F.coalesce(drop, F.lit(False)))
        held.select(*[c for c in held.columns if not c.startswith("_")]).write.parquet(path)
        for n in counters:
            self.counts[n] = self.counts.get(n, 0) + (seen.get.get(n) or 0)
        return self.spark.read.parquet(path)

    def affected(self) -> DataFrame:
        """(counter, n), a row for each counter."""
        return self.spark.createDataFrame(sorted(self.counts.items()), "counter string, n long")


def write_discovery(found: jobs.Discovery, story: DataFrame, out: Counted) -> dict[str, DataFrame]:
    """Writes new stories, rejects, samples and the refreshed story table.

    Counters: discovered, guard_rejected, samples_appended and, of these, auto_updated,
    first_samples and later_samples; stories_refreshed.
    """
    new = out.write("new_stories", found.new_stories, discovered=EVERY(True))
    out.write("rejected", found.rejected, guard_rejected=EVERY(True))
    auto = M.auto_update_rows(found.matched).withColumn("_from", F.lit("auto"))
    samples = auto.unionByName(found.samples_inserted.withColumn("_from", F.lit("first"))).unionByName(
        found.samples_later.withColumn("_from", F.lit("later")))
    by = F.col("_from")
    written = out.write("samples", samples, samples_appended=EVERY(True), auto_updated=by == "auto",
                        first_samples=by == "first", later_samples=by == "later")
    state = M.apply_samples(story, M.auto_update_rows(found.matched), flag="_refreshed")
    return {"new_stories": new, "samples": written,
            "story": out.write("story", state, stories_refreshed=F.col("_refreshed"))}


def write_update(story: DataFrame, done: jobs.UpdatePass, out: Counted, as_of=AS_OF) -> dict[str, DataFrame]:
    """Writes the samples and the story table.

    Counters: update_samples, stories_updated and stories_checked_only (the two branches of K6).
    """
    samples = out.write("update_samples", done.samples, update_samples=EVERY(True))
    state = M.apply_checks(story, done.outcomes, as_of, flag="_outcome")
    after = out.write("update_story", state, stories_updated=F.col("_outcome") == "updated",
                      stories_checked_only=F.col("_outcome") == "checked")
    return {"samples": samples, "story": after}


def _flagged(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``table`` with _gone: whether its ``key`` is among ``ids`` (id, distinct)."""
    return table.join(ids.select(F.col("id").alias(key), F.lit(True).alias("_gone")), key, "left").select(
        *table.columns, "_gone")


def write_deletion(story: DataFrame, history: DataFrame, doomed_ids: DataFrame, out: Counted) -> dict[str, DataFrame]:
    """Writes the stories and samples that stay; counters stories_deleted, samples_cascaded.

    The ids are the stories' own: an id without a story deletes nothing and counts nothing.
    """
    ids = doomed_ids.select("id").distinct()
    gone = F.col("_gone")
    return {"story": out.write("story_left", _flagged(story, ids, "id"), drop=gone, stories_deleted=gone),
            "history": out.write("history_left", _flagged(history, ids, "story"), drop=gone, samples_cascaded=gone)}


def write_subreddit_deletion(subreddit: DataFrame, sub_history: DataFrame, story: DataFrame, history: DataFrame,
                             doomed_ids: DataFrame, out: Counted) -> dict[str, DataFrame]:
    """Communities, their samples, their stories and the stories' samples, counted like K10.

    The deleted stories' ids come from the pass that drops them: they are written beside it.
    """
    ids, gone = doomed_ids.select("id").distinct(), F.col("_gone")
    doomed = out.write("doomed_stories", story.join(ids.withColumnRenamed("id", "subreddit"), "subreddit", "left_semi").select("id"))
    return {
        "subreddit": out.write("subreddit_left", _flagged(subreddit, ids, "id"), drop=gone, subreddits_deleted=gone),
        "sub_history": out.write("sub_history_left", _flagged(sub_history, ids, "subreddit"), drop=gone,
                                 sub_samples_cascaded=gone),
        "story": out.write("sub_story_left", _flagged(story, ids, "subreddit"), drop=gone, stories_cascaded=gone),
        "history": out.write("sub_story_history_left", _flagged(history, doomed, "story"), drop=gone,
                             story_samples_cascaded=gone)}


def write_archive(spark: SparkSession, story: DataFrame, subreddit: DataFrame, history: DataFrame, root: str,
                  out: Counted, as_of=AS_OF, batch_id: int | None = None) -> dict[str, DataFrame]:
    """Archives, then deletes what the committed batch names; counters archived and K10's."""
    seen = Observation()
    run = jobs.archive(spark, story, subreddit, history, root, as_of, batch_id,
                       watch=lambda details: details.observe(seen, F.count(F.lit(1)).alias("archived")))
    out.counts["archived"] = seen.get["archived"]
    return write_deletion(story, history, run.archived, out)


def scratch(spark: SparkSession, name: str) -> Counted:
    """A :class:`Counted` in a fresh folder of the shared checkpoint storage."""
    return Counted(spark, A.scratch_path(spark, name))
