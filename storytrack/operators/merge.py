"""Feed de-duplication, feed union, upserts and cascading deletes.

The producer applies these row by row inside transactions; here each is one join or
one aggregate per batch. Parquet has no MERGE, so an upsert produces a new snapshot
(``full_outer``/``left`` join + ``coalesce``) that the caller writes to a new path.
All de-duplications are ``min_by``/``max_by`` aggregates: they combine map-side, so a
story repeated in a third of all rows still reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storytrack.functions import scalars as X
from storytrack.operators.ordering import global_index
from storytrack.session import AS_OF

FEED_PRIORITY = {"hot": 0, "new": 1}  # the hot copy wins when a story is on both feeds
STATE_FIELDS = ["score", "hotness", "comments", "gilded"]


def _payload_cols(df: DataFrame, exclude: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def dedup_first_seen(obs: DataFrame, keys=("feed", "tick", "short_id"),
                     order=("page", "pos")) -> DataFrame:
    """Keep the first copy of each id in arrival order (a set ignores repeats)."""
    rest = _payload_cols(obs, tuple(keys))
    agg = obs.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_r"),
        F.count(F.lit(1)).alias("copies"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], "copies")


def dedup_last_wins(obs: DataFrame, keys=("short_id",), order=("arrival",)) -> DataFrame:
    """Keep the last copy of each id (a map ``put`` overwrites)."""
    rest = _payload_cols(obs, tuple(keys))
    agg = obs.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def union_feeds(obs: DataFrame, keys=("tick", "short_id")) -> DataFrame:
    """U1 + U2: id-based union of the feeds of one scrape; hot copy wins, ``in_new`` flags
    stories that the new feed also carried. Within a feed the first copy wins (D1)."""
    prio = F.lit(len(FEED_PRIORITY))  # any other feed ranks after the known ones
    for feed, p in FEED_PRIORITY.items():
        prio = F.when(F.col("feed") == feed, F.lit(p)).otherwise(prio)
    rest = _payload_cols(obs, tuple(keys))
    agg = obs.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]),
                 F.struct(prio, F.col("page"), F.col("pos"))).alias("_r"),
        F.bool_or(F.col("feed") == "new").alias("in_new"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], "in_new")


def paged_listing(children: DataFrame, limit: int, keys: tuple[str, ...] | None = None,
                  pages: DataFrame | None = None) -> DataFrame:
    """S5/S6 + T5: per scrape, the first ``limit`` distinct stories in page order.

    A scrape is one walk: one (feed, tick), or what ``keys`` names (default: those of feed
    and tick that the input has). A walk ends at the first page that adds no new story or is
    empty. Input: one row per accepted child with the keys, page, pos, short_id; ``pages``
    lists every landed page including empty ones (default: the pages that have children).
    """
    keys = keys or tuple(c for c in ("feed", "tick") if c in children.columns)
    firsts = dedup_first_seen(children.select(*keys, "page", "pos", "short_id"), keys=(*keys, "short_id"))
    # Pages that contributed at least one first-seen story, and every landed page.
    growing = firsts.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("_new"))
    pages = (children if pages is None else pages).select(*keys, "page").distinct()
    stalled = (pages.join(growing, [*keys, "page"], "left")
               .filter(F.col("_new").isNull())
               .groupBy(*keys).agg(F.min("page").alias("_stop")))
    kept = (firsts.join(stalled, list(keys), "left")
            .filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))))
    # A group is one walk; the row_number filter is a WindowGroupLimit before the shuffle
    # (each task keeps ``limit`` rows of a walk) up to Spark's threshold for it.
    w = Window.partitionBy(*keys).orderBy("page", "pos")
    return (kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .select(*keys, "rank", "page", "pos", "short_id"))


def latest_scrape(children: DataFrame, as_of=None) -> DataFrame:
    """The children of the last tick (at or before ``as_of``, if given)."""
    known = children if as_of is None else children.filter(F.col("tick") <= X.as_ts(as_of))
    return known.filter(F.col("tick") == known.select(F.max("tick")).scalar())


def stories_by_id(snapshot: DataFrame, ids: DataFrame, id_col: str = "short_id") -> DataFrame:
    """Latest landed record for each requested id; ids with no record are absent."""
    hits = snapshot.join(ids.select(F.col(id_col).alias("short_id")).distinct(), "short_id", "left_semi")
    return dedup_last_wins(hits, keys=("short_id",), order=("arrival",))


def front_page_subreddits(hot: DataFrame, n: int = 300, as_of=None) -> DataFrame:
    """A3: distinct subreddits over the first n distinct stories of the last front-page scrape.

    ``hot``: accepted front-page children (feed, tick, page, pos, short_id, subreddit_name).
    """
    last = latest_scrape(hot, as_of)
    front = paged_listing(last, n).select("short_id")
    return last.join(front, "short_id", "left_semi").select(F.col("subreddit_name").alias("name")).distinct()


# -- discovery (E1): match feed stories against the story table ------------------

def restrict(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose ``key`` occurs in ``small``.

    The semi-join's build side is the small frame's distinct keys, so when a scrape or a
    batch of samples is small, AQE broadcasts those keys and the big table is only
    scanned (no shuffle); when it is large, the planner falls back to a shuffle join.
    """
    return big.join(small.select(key).distinct(), key, "left_semi")


def scrape_split(feed_stories: DataFrame, story: DataFrame):
    """(matched, unmatched) on short id. Matched rows carry the story's id.

    The story table is first cut down to the ids this scrape mentions (see
    :func:`restrict`); the split itself then joins two small frames.
    """
    keys = story.select(F.col("reddit_short_id").alias("short_id"), F.col("id").alias("story_id"))
    hit = restrict(keys, feed_stories, "short_id")
    matched = feed_stories.join(hit, "short_id", "inner")
    unmatched = feed_stories.join(hit, "short_id", "left_anti")
    return matched, unmatched


def guard_known(unmatched: DataFrame, known_subreddits: DataFrame):
    """new stories are kept only when their subreddit is in the known set."""
    names = known_subreddits.select(F.col("name").alias("subreddit_name"))
    return (unmatched.join(names, "subreddit_name", "left_semi"),
            unmatched.join(names, "subreddit_name", "left_anti"))


def require_known(known_subreddits: DataFrame) -> None:
    """F8: an empty known set is an error (nothing to scrape for)."""
    if known_subreddits.isEmpty():
        raise ValueError("no recently seen subreddits: nothing to scrape for")


def discover_insert(accepted: DataFrame, story: DataFrame, subreddit: DataFrame):
    """K5: first sighting of each new story → a story row and its first history row.

    Ids continue the table's sequence (max id + position in (tick, short_id) order);
    later sightings of the same story become ordinary samples (returned third).
    """
    first = dedup_first_seen(accepted, keys=("short_id",), order=("tick",))
    max_id = story.select(F.coalesce(F.max("id"), F.lit(-1))).scalar()  # scalar subquery
    numbered = global_index(first, [F.col("tick"), F.col("short_id")], "_i").withColumn("_max", max_id)
    sub = subreddit.select(F.col("id").alias("subreddit"), F.col("name").alias("subreddit_name"))
    rows = numbered.join(sub, "subreddit_name", "inner")
    new_story = rows.select(
        (F.col("_max") + F.col("_i") + F.lit(1)).alias("id"),
        F.col("short_id").alias("reddit_short_id"), "subreddit", "title", "author", "url",
        "permalink", "domain", "thumbnail", "distinguished", "over18", "is_self", "selftext",
        "stickied", "created_at", "score", "hotness", "comments", "gilded",
        F.col("tick").alias("discovered_at"), F.col("tick").alias("updated_at"),
        F.col("tick").alias("checked_at"))
    first_hist = new_story.select(F.col("id").alias("story"), F.col("discovered_at").alias("timestamp"),
                                  *STATE_FIELDS)
    # A new story was discovered at its first sighting, which is not looked for a second time.
    inserted = new_story.select(F.col("reddit_short_id").alias("short_id"), F.col("id").alias("story"), "discovered_at")
    later_hist = (accepted.join(inserted, "short_id").filter(F.col("tick") > F.col("discovered_at"))
                  .select("story", F.col("tick").alias("timestamp"), *STATE_FIELDS))
    return new_story, first_hist, later_hist


def auto_update_rows(matched: DataFrame) -> DataFrame:
    """Matched feed stories become samples stamped with the scrape tick."""
    return matched.select(F.col("story_id").alias("story"), F.col("tick").alias("timestamp"), *STATE_FIELDS)


def apply_samples(story: DataFrame, samples: DataFrame, flag: str | None = None) -> DataFrame:
    """K6 (non-null branch): refresh the six state columns from each story's newest sample.

    Returns the new snapshot of ``story``; a sample older than the stored state does not
    overwrite it, and samples for stories that no longer exist change nothing. ``flag``
    names a further column that tells which rows were refreshed (A12).
    """
    state = F.struct(*[F.col(c) for c in STATE_FIELDS])
    newest = samples.groupBy("story").agg(
        F.max_by(state, F.struct(F.col("timestamp"), state)).alias("_s"),  # ties: deterministic
        F.max("timestamp").alias("_ts"))
    j = story.join(newest.withColumnRenamed("story", "id"), "id", "left")
    take = F.col("_ts").isNotNull() & (F.col("_ts") >= F.col("updated_at"))
    cols = []
    for c in story.columns:
        if c in STATE_FIELDS:
            cols.append(F.when(take, F.col("_s")[c]).otherwise(F.col(c)).alias(c))
        elif c in ("updated_at", "checked_at"):
            cols.append(F.when(take, F.col("_ts")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols, *([take.alias(flag)] if flag else []))


def live_samples(samples: DataFrame, story: DataFrame) -> DataFrame:
    """Samples whose story still exists (an update to a deleted story changes 0 rows)."""
    alive = restrict(story.select(F.col("id").alias("story")), samples, "story")
    return samples.join(alive, "story", "left_semi")


def records_since_check(landed: DataFrame, candidates: DataFrame, as_of=AS_OF) -> DataFrame:
    """S7 for an update pass: each candidate's last landed record after its last check and
    not after ``as_of``. Older records never replace a newer state."""
    own = candidates.select(F.col("reddit_short_id").alias("short_id"), F.col("checked_at").alias("_checked"))
    known = restrict(landed.filter(F.col("tick") <= X.as_ts(as_of)), own, "short_id").join(own, "short_id")
    return dedup_last_wins(known.filter(F.col("tick") > F.col("_checked")).drop("_checked"),
                           keys=("short_id",), order=("arrival",))


def check_outcomes(candidates: DataFrame, returned: DataFrame) -> DataFrame:
    """Each requested story → 'updated' (a record came back) or 'checked' (none did)."""
    ret = returned.select(F.col("short_id").alias("reddit_short_id"),
                          *[F.col(c).alias("new_" + c) for c in STATE_FIELDS])
    j = candidates.select("id", "reddit_short_id").join(ret, "reddit_short_id", "left")
    return j.withColumn("outcome", F.when(F.col("new_score").isNotNull(), "updated").otherwise("checked"))


def outcome_samples(outcomes: DataFrame, as_of=AS_OF) -> DataFrame:
    """K6 (append): one history row, stamped ``as_of``, per updated story."""
    return outcomes.filter(F.col("outcome") == "updated").select(
        F.col("id").alias("story"), X.as_ts(as_of).alias("timestamp"),
        *[F.col("new_" + c).alias(c) for c in STATE_FIELDS])


def apply_checks(story: DataFrame, outcomes: DataFrame, as_of=AS_OF, flag: str | None = None) -> DataFrame:
    """K6 (both branches) for one update pass at ``as_of``: updated → six columns,
    checked-only → ``checked_at = as_of``. ``flag`` names a further column with each row's
    outcome, null for untouched rows (A12)."""
    now = X.as_ts(as_of)
    o = outcomes.select(F.col("id"), "outcome", *[F.col("new_" + c) for c in STATE_FIELDS])
    j = story.join(o, "id", "left")
    cols = []
    for c in story.columns:
        if c in STATE_FIELDS:
            cols.append(F.when(F.col("outcome") == "updated", F.col("new_" + c)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(F.col("outcome") == "updated", now).otherwise(F.col(c)).alias(c))
        elif c == "checked_at":
            cols.append(F.when(F.col("outcome").isNotNull(), now).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols, *([F.col("outcome").alias(flag)] if flag else []))


# -- subreddits (K7, K8, K9, J5) ------------------------------------------------

def subreddit_upsert(front_names: DataFrame, subreddit: DataFrame, abouts: DataFrame,
                     as_of=AS_OF) -> DataFrame:
    """J5 + K7 + K9: known names are marked seen; unknown ones are inserted from their
    ``about`` record with created = updated = seen = as_of. Returns the new snapshot
    plus an ``action`` column (seen / inserted / NULL for untouched rows)."""
    now = X.as_ts(as_of)
    names = front_names.select("name").distinct()
    flagged = subreddit.join(names.withColumn("_hit", F.lit(True)), "name", "left")
    updated = flagged.select(
        *[(F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c) if c == "seen_at" else F.col(c))
          for c in subreddit.columns],
        F.when(F.col("_hit"), F.lit("seen")).alias("action"))
    new_names = names.join(subreddit.select("name"), "name", "left_anti")
    fresh = abouts.filter(F.col("status") == 200).join(new_names, "name", "inner")
    max_id = subreddit.select(F.coalesce(F.max("id"), F.lit(-1))).scalar()  # scalar subquery
    fresh = global_index(fresh, [F.col("name")], "_i").withColumn("_max", max_id)
    inserted = fresh.select(
        (F.col("_max") + F.col("_i") + F.lit(1)).alias("id"), "reddit_short_id", "name", "title",
        "url", "summary", "description", "submission_type",
        now.alias("created_at"), now.alias("updated_at"), now.alias("seen_at"),
        F.lit("inserted").alias("action"))
    return updated.unionByName(inserted)


def subreddit_history_append(stale: DataFrame, abouts: DataFrame, as_of=AS_OF,
                             strict: bool = False) -> DataFrame:
    """K8 + ST8: one sample per stale subreddit stamped ``as_of``. A forbidden (403) about
    record skips the subreddit; any other non-200 status raises when ``strict``."""
    now = X.as_ts(as_of)
    fetched = abouts.drop("name").withColumnRenamed("requested", "name")
    j = stale.select(F.col("id").alias("subreddit"), "name").join(fetched, "name", "inner")
    if strict:
        j = j.filter(X.fail_if(~F.col("status").isin(200, 403), "about fetch failed"))
    ok = j.filter(F.col("status") == 200)
    return ok.select("subreddit", "name", now.alias("timestamp"), "subscribers", "active",
                     "comment_hide_mins")


def refresh_sampled(subreddit: DataFrame, samples: DataFrame, as_of=AS_OF) -> DataFrame:
    """K8 (parent side): communities that received a sample get ``updated_at = as_of``;
    returns the new snapshot of ``subreddit``."""
    now = X.as_ts(as_of)
    hit = samples.select(F.col("subreddit").alias("id")).distinct().withColumn("_hit", F.lit(True))
    j = subreddit.join(hit, "id", "left")
    return j.select(*[(F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c))
                      for c in subreddit.columns])


# -- deletes (K10, K11) -----------------------------------------------------------

def delete_stories(story: DataFrame, history: DataFrame, doomed_ids: DataFrame):
    """Drop stories by id; their samples go with them (declared cascade)."""
    ids = doomed_ids.select(F.col("id")).distinct()
    return (story.join(ids, "id", "left_anti"),
            history.join(ids.withColumnRenamed("id", "story"), "story", "left_anti"))


def delete_subreddits(subreddit: DataFrame, sub_history: DataFrame, story: DataFrame,
                      history: DataFrame, doomed_ids: DataFrame):
    """Subreddit → its samples, its stories → their samples."""
    ids = doomed_ids.select("id").distinct()
    left_sub = subreddit.join(ids, "id", "left_anti")
    left_sub_hist = sub_history.join(ids.withColumnRenamed("id", "subreddit"), "subreddit", "left_anti")
    left_story = story.join(ids.withColumnRenamed("id", "subreddit"), "subreddit", "left_anti")
    gone = story.join(ids.withColumnRenamed("id", "subreddit"), "subreddit", "left_semi").select("id")
    left_hist = history.join(gone.withColumnRenamed("id", "story"), "story", "left_anti")
    return left_sub, left_sub_hist, left_story, left_hist
