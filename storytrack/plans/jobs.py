"""End-to-end batch jobs: discovery (E1), history update pass (E2), archive.

Each job is a set of lazily composed DataFrames; nothing is collected to the driver.
Callers write the returned frames as new snapshots (parquet has no in-place update).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.operators import history as H
from storytrack.operators import merge as M
from storytrack.operators import select as sel
from storytrack.session import AS_OF
from storytrack.sources import archive as A
from storytrack.sources import payload as P


@dataclass
class Discovery:
    feed_stories: DataFrame   # U1: one row per (tick, short_id)
    matched: DataFrame        # J4: already tracked
    unmatched: DataFrame      # J4: not tracked yet
    accepted: DataFrame       # F7: unmatched, subreddit known
    rejected: DataFrame       # F7: unmatched, subreddit unknown
    new_stories: DataFrame    # K5: story rows to insert
    samples: DataFrame        # K5 first rows + later sightings + auto-updates (K6)
    samples_inserted: DataFrame  # of these, K5's first rows
    samples_later: DataFrame     # of these, later sightings of new stories
    story_after: DataFrame    # K6 applied to the existing table


def discovery(pages: DataFrame, story: DataFrame, subreddit: DataFrame, as_of=AS_OF,
              strict: bool = False, need_known: bool = True) -> Discovery:
    """Landed feed pages → parsed stories → feed union → match / guard / insert / sample.

    Without any community seen recently there is nothing to scrape for: an error (F8). Without
    ``need_known`` the guard then rejects every new story."""
    known = sel.subreddits_recently_seen(subreddit, as_of)
    if need_known:
        M.require_known(known)
    parsed = P.parse_story_pages(pages, strict=strict)
    # Read by every branch below (match, guard, insert, samples): computed once. The
    # union is one row per (tick, story) of the scrape, small next to the tables.
    feed_stories = M.union_feeds(parsed.drop("before", "after", "kind"),
                                 keys=("tick", "short_id")).persist(StorageLevel.MEMORY_AND_DISK)
    matched, unmatched = M.scrape_split(feed_stories, story)
    accepted, rejected = M.guard_known(unmatched, known)
    new_story, first_hist, later_hist = M.discover_insert(accepted, story, subreddit)
    auto = M.auto_update_rows(matched)
    samples = auto.unionByName(first_hist).unionByName(later_hist)
    story_after = M.apply_samples(story, auto)  # matched rows: their stories exist
    return Discovery(feed_stories, matched, unmatched, accepted, rejected, new_story, samples,
                     first_hist, later_hist, story_after)


@dataclass
class UpdatePass:
    candidates: DataFrame
    returned: DataFrame
    outcomes: DataFrame
    samples: DataFrame        # K6: one history row per updated story
    story_after: DataFrame


def update_pass(story: DataFrame, landed: DataFrame, as_of=AS_OF, limit: int | None = None) -> UpdatePass:
    """Every stale story → by-id lookup in the landed records since its last check →
    updated / checked-only outcomes → history rows and new state.

    The crawler drains the stale stories in batches until none is left; here one pass takes
    them all. ``limit`` restricts a pass to the hottest stale stories (T2)."""
    cand = sel.stories_needing_update(story, as_of, limit=limit)
    returned = M.records_since_check(landed, cand, as_of)
    outcomes = M.check_outcomes(cand, returned)
    return UpdatePass(cand, returned, outcomes, M.outcome_samples(outcomes, as_of),
                      M.apply_checks(story, outcomes, as_of))


def landed_snapshot(pages: DataFrame) -> DataFrame:
    """Parsed landed story records with an arrival order (tick, page, pos, feed)."""
    parsed = P.parse_story_pages(pages)
    return parsed.withColumn("arrival", F.struct("tick", "page", "pos", "feed"))


@dataclass
class ArchiveRun:
    archivable: DataFrame
    details: DataFrame
    archived: DataFrame       # J9: ids that the committed batch names
    story_after: DataFrame
    history_after: DataFrame


def archive(spark: SparkSession, story: DataFrame, subreddit: DataFrame, history: DataFrame,
            root: str, as_of=AS_OF, batch_id: int | None = None,
            watch: Callable[[DataFrame], DataFrame] = lambda details: details) -> ArchiveRun:
    """Archivable stories → detail records → day-partitioned archive → delete what the
    committed write contained (J9 + K10).

    Each run writes under its own ``batch=<id>`` sub-partition (default: ``as_of`` in epoch
    ms). The ids to delete are read back from that committed batch, so a story that the
    write did not contain is never deleted, whatever happens to the tables meanwhile; a
    failed write raises before anything is deleted (at-least-once). ``watch`` may observe
    the records on their way into the archive (A9)."""
    if batch_id is None:
        when = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.fromisoformat(str(as_of))
        batch_id = int(when.replace(tzinfo=_dt.timezone.utc).timestamp() * 1000)
    doomed = sel.stories_archivable(story, as_of)
    doomed_hist = history.join(doomed.select(F.col("id").alias("story")), "story", "left_semi")
    details = H.story_detail(doomed, subreddit, doomed_hist)
    A.write_archive(watch(details), root, batch_id=batch_id)
    committed = A.read_archive(spark, root, batched=True).filter(F.col("batch") == batch_id)
    gone = archived_ids(story, committed)
    story_after, history_after = M.delete_stories(story, history, gone)
    return ArchiveRun(doomed, details, gone, story_after, history_after)


def archived_ids(story: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of the stories that archive records name."""
    names = records.select(F.col("summary.id").alias("reddit_short_id")).distinct()
    return story.join(names, "reddit_short_id", "left_semi").select("id")
