"""The archive's ledger, runs that die, and compaction by marks."""

import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF
from storytrack.operators import history as H
from storytrack.operators import select as sel
from storytrack.plans import jobs
from storytrack.session import AS_OF
from storytrack.sources import archive as A
from storytrack.sources import ledger as L
from storytrack.sources import tables as T


@pytest.fixture(scope="module")
def details(spark):
    doomed = sel.stories_archivable(T.stories(spark, SF), AS_OF).orderBy("created_at", "id").limit(24).cache()
    hist = T.story_history(spark, SF).join(doomed.select(F.col("id").alias("story")), "story", "left_semi")
    return H.story_detail(doomed, T.subreddits(spark, SF), hist).cache()


def named(records):
    return sorted(r[0] for r in records.select("summary.id").collect())


class Killed(Exception):
    pass


def test_a_run_killed_between_two_days_commits_only_whole_days(spark, details, tmp_path, monkeypatch):
    root, groups = str(tmp_path / "archive"), list(L.day_groups(details, 2))
    assert len(groups) > 3
    real, calls = L.commit, []

    def dies(*args):
        if len(calls) == 2:  # the third group's files are written, its commit is not
            raise Killed
        calls.append(args[-1])
        real(*args)
    monkeypatch.setattr(L, "commit", dies)
    with pytest.raises(Killed):
        L.write_committed(spark, details, root, 7, records_per_commit=2)
    whole = {d for g in groups[:2] for d in g}
    assert {r.day for r in L.read_ledger(spark, root).collect()} == whole
    day = F.to_date(F.timestamp_millis("createdAt")).cast("string")
    committed = named(L.committed_records(spark, root))
    assert committed == sorted(r.id for r in details.filter(day.isin(list(whole))).select("id").collect())
    assert len(named(A.read_archive(spark, root, batched=True))) > len(committed)  # files that nobody may trust
    # Only what is committed is deleted.
    story = T.stories(spark, SF)
    gone = jobs.archived_ids(story, L.committed_records(spark, root, 7))
    assert gone.count() == len(committed)
    # The next attempt takes the run up where it stopped; nothing is there twice.
    monkeypatch.setattr(L, "commit", real)
    L.write_committed(spark, details, root, 7, records_per_commit=2)
    assert named(L.committed_records(spark, root, 7)) == sorted(r.id for r in details.select("id").collect())
    L.write_committed(spark, details, root, 7, records_per_commit=2)
    assert L.read_ledger(spark, root).count() == sum(map(len, groups))
    assert L.damaged(spark, root).count() == 0


def test_ledger_tells_files_records_bytes_and_damage(spark, details, tmp_path):
    root = str(tmp_path / "archive")
    L.write_committed(spark, details, root, 1)
    rows = L.read_ledger(spark, root).collect()
    want = {r.archive_date: r.n_records for r in A.archive_day_counts(details).collect()}
    assert {r.day: r.records for r in rows} == want
    for r in rows:
        files = list((tmp_path / "archive" / f"archive_date={r.day}" / "batch=1").glob("part-*"))
        assert (r.files, r.bytes) == (len(files), sum(f.stat().st_size for f in files))
    lost = sorted(want)[0]
    shutil.rmtree(tmp_path / "archive" / f"archive_date={lost}")
    assert [r.day for r in L.damaged(spark, root).collect()] == [lost]


def test_compaction_reads_only_days_with_new_batches(spark, details, tmp_path):
    root, out = str(tmp_path / "archive"), str(tmp_path / "composed")
    days = sorted(r.archive_date for r in A.archive_day_counts(details).collect())
    L.write_committed(spark, details, root, 1)
    assert L.compact_new(spark, root, out) == days
    first = named(A.read_archive(spark, out))
    assert first == sorted(r.id for r in details.select("id").collect())
    # Without new batches nothing is read: the records may even be gone.
    keep = tmp_path / "away"
    (tmp_path / "archive" / f"archive_date={days[0]}").rename(keep)
    assert L.compact_new(spark, root, out) == []
    keep.rename(tmp_path / "archive" / f"archive_date={days[0]}")
    # A later batch of one day rewrites that day from its compacted records and the batch.
    day = F.to_date(F.timestamp_millis("createdAt")).cast("string")
    L.write_committed(spark, details.filter(day == days[1]), root, 2)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "composed").rglob("part-*.gz")}
    assert L.compact_new(spark, root, out) == [days[1]]
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "composed").rglob("part-*.gz")}
    same = {f for f in before if days[1] not in str(f)}
    assert same and all(after[f] == before[f] for f in same)
    assert named(A.read_archive(spark, out)) == first
    # Batches that are not committed are not taken in.
    A.write_archive(details.filter(day == days[2]), root, batch_id=3)
    assert L.compact_new(spark, root, out) == []


def test_nothing_to_archive(spark, details, tmp_path):
    root = str(tmp_path / "archive")
    L.write_committed(spark, details.limit(0), root, 1)
    assert L.read_ledger(spark, root).collect() == [] and L.compact_new(spark, root, str(tmp_path / "out")) == []
