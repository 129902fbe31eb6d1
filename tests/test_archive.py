import glob
import gzip
import json

from pyspark.sql import functions as F

from conftest import SF, ts
from storytrack.operators import history as H
from storytrack.operators import select as sel
from storytrack.plans import jobs
from storytrack.session import AS_OF
from storytrack.sources import archive as A
from storytrack.sources import tables as T


def details(spark):
    story = T.stories(spark, SF)
    doomed = sel.stories_archivable(story, AS_OF)
    return H.story_detail(doomed, T.subreddits(spark, SF), T.story_history(spark, SF))


def test_layout_gzip_and_explicit_nulls(spark):
    root = A.scratch_path(spark, "t-archive")
    A.write_archive(details(spark), root)
    files = glob.glob(f"{root}/archive_date=*/*.json.gz")
    assert files
    line = gzip.open(files[0], "rt").readline()
    rec = json.loads(line)
    assert set(rec) == {"summary", "history", "chunk"} and rec["chunk"] == 0 and "selfText" in rec["summary"] and rec["summary"]["selfText"] is None
    assert list(rec["history"]) == ["timestamp", "score", "hotness", "gilded", "comments"]


def test_roundtrip_equals_input(spark):
    root = A.scratch_path(spark, "t-archive")
    d = details(spark)
    A.write_archive(d, root)
    back = A.read_archive(spark, root).select("archive_date", "summary", "history", "chunk")
    mem = A.archive_frame(d)
    assert back.exceptAll(mem).count() == 0 and mem.exceptAll(back).count() == 0


def test_replay_is_idempotent_and_compaction_dedups(spark):
    root = A.scratch_path(spark, "t-archive")
    d = details(spark)
    for _ in range(2):                                 # the same batch replayed
        A.write_archive(d, root, batch_id=7, replace_batch=True)
    A.write_archive(d, root, batch_id=8)               # re-archived by a later batch
    raw = A.read_archive(spark, root, batched=True)
    assert raw.count() == 2 * d.count()
    out = A.compact_archive(spark, root, A.scratch_path(spark, "t-composed"), batched=True)
    assert out.count() == d.count()
    assert out.select("summary.id").distinct().count() == d.count()


def test_archive_job_deletes_only_what_was_written(spark):
    root = A.scratch_path(spark, "t-archive")
    story, hist = T.stories(spark, SF), T.story_history(spark, SF)
    run = jobs.archive(spark, story, T.subreddits(spark, SF), hist, root, AS_OF)
    n_arch = sel.stories_archivable(story, AS_OF).count()
    assert run.story_after.count() == story.count() - n_arch
    left = run.history_after.join(run.archivable.select(F.col("id").alias("story")), "story", "left_semi")
    assert left.count() == 0


def test_compaction_keeps_every_chunk_of_a_split_story(spark):
    from storytrack.operators import select as sel2
    story = T.stories(spark, SF)
    doomed = sel2.stories_archivable(story, AS_OF).orderBy("id").limit(5)
    sub, hist = T.subreddits(spark, SF), T.story_history(spark, SF)
    summaries = sel2.summary_columns(doomed, sub)
    arrays = H.history_arrays(hist.join(doomed.select(F.col("id").alias("story")), "story", "left_semi"),
                              max_points=2)
    hist_struct = F.struct(*[F.col(c) for c in H.HISTORY_FIELDS]).alias("history")
    details = summaries.join(arrays.select(F.col("story").alias("story_id"), "chunk", hist_struct), "story_id")
    root = A.scratch_path(spark, "t-chunks")
    A.write_archive(details, root, batch_id=1)
    A.write_archive(details, root, batch_id=2)            # a replayed run
    out = A.compact_archive(spark, root, A.scratch_path(spark, "t-chunks-out"), batched=True)
    assert out.count() == details.count() and details.count() > doomed.count()


def test_compaction_of_unequal_copies_and_named_days(spark):
    """A story archived empty, then late, then whole: the whole record stays; other days stay as they are."""
    story, sub, hist = T.stories(spark, SF), T.subreddits(spark, SF), T.story_history(spark, SF)
    many = hist.groupBy("story").count().filter("count > 2").select(F.col("story").alias("id"))
    doomed = sel.stories_archivable(story, AS_OF).join(many, "id", "left_semi").orderBy("id").limit(6)
    own = hist.join(doomed.select(F.col("id").alias("story")), "story", "left_semi")
    root, out = A.scratch_path(spark, "t-unequal"), A.scratch_path(spark, "t-unequal-out")
    for batch, part in enumerate((own.limit(0), own.filter("tie1 = 1"), own)):
        A.write_archive(H.story_detail(doomed, sub, part), root, batch_id=batch)
    whole = {r.story: r["count"] for r in own.groupBy("story").count().collect()}
    got = {int(r.summary.id): len(r.history.timestamp) for r in A.compact_archive(spark, root, out, batched=True).collect()}
    assert got == whole
    day = A.read_archive(spark, root, batched=True).first().archive_date
    one = A.compact_archive(spark, root, A.scratch_path(spark, "t-day"), batched=True, days=[day])
    assert {r.archive_date for r in one.collect()} == {day}


def test_only_committed_stories_are_deleted(spark):
    """Stories that become archivable after the write stay."""
    root = A.scratch_path(spark, "t-commit")
    story, hist = T.stories(spark, SF), T.story_history(spark, SF)
    run = jobs.archive(spark, story, T.subreddits(spark, SF), hist, root, AS_OF)
    committed = A.read_archive(spark, root, batched=True).select(F.col("summary.id").cast("long")).distinct()
    assert run.archived.exceptAll(committed).count() == 0 and committed.exceptAll(run.archived).count() == 0
