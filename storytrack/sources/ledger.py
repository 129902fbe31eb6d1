"""K1/K4: what an archive has completely written, kept as a ledger beside its records.

The ledger (``<root>/_ledger``, Parquet, append-only) has one row for each day and batch whose
records are whole: files, records, bytes and a digest, taken from the files themselves after
they were committed. A day without a row is not archived, whatever lies in its folder: a run
that is killed between two groups of days leaves only the groups it had committed, deletes
nothing else, and its successor writes the rest again. Readers of ``<root>`` never see the
ledger (names with a leading underscore are hidden to them).

Compaction keeps a mark per day, the last batch it has taken in (``<out>/_marks``). Days whose
ledger has no newer batch are not read at all; the others are merged from their compacted
records and the batches behind the mark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.functions import scalars as X
from storytrack.sources import archive as A

LEDGER = "day string, batch long, files long, records long, bytes long, digest long"
MARKS = "day string, upto long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """(day, batch, files, records, bytes, digest); a replayed commit counts once."""
    return _read(spark, f"{root}/_ledger", LEDGER).distinct()


def measured(records: DataFrame) -> DataFrame:
    """Ledger rows of read-back batched records: one pass, a row for each file before the last sum.

    The digest does not depend on the order of records or on how they are dealt into files.
    """
    by_file = (records.select(F.col("archive_date").alias("day"), "batch", F.col("_metadata.file_path").alias("file"),
                              F.col("_metadata.file_size").alias("size"), F.xxhash64("summary", "history", "chunk").alias("h"))
               .groupBy("day", "batch", "file", "size").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x")))
    return by_file.groupBy("day", "batch").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("records"), F.sum("size").alias("bytes"), F.bit_xor("x").alias("digest"))


def commit(spark: SparkSession, root: str, batch_id: int, days: list[str]) -> None:
    """Enter the batch's records of ``days`` into the ledger, from their files as they are now."""
    own = A.read_archive(spark, root, batched=True).filter((F.col("batch") == batch_id) & F.col("archive_date").isin(days))
    measured(own).coalesce(1).write.mode("append").parquet(f"{root}/_ledger")


def committed_records(spark: SparkSession, root: str, batch_id: int | None = None) -> DataFrame:
    """The archive's records of committed days and batches only."""
    held = read_ledger(spark, root).select(F.col("day").alias("archive_date"), "batch")
    records = A.read_archive(spark, root, batched=True)
    if batch_id is not None:
        records, held = records.filter(F.col("batch") == batch_id), held.filter(F.col("batch") == batch_id)
    return records.join(held, ["archive_date", "batch"], "left_semi")


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """Ledger rows whose files no longer hold what was committed (reads every record)."""
    now = measured(A.read_archive(spark, root, batched=True)).select(
        "day", "batch", F.col("records").alias("_r"), F.col("digest").alias("_d"))
    return (read_ledger(spark, root).join(now, ["day", "batch"], "left")
            .filter(~(F.col("records").eqNullSafe(F.col("_r")) & F.col("digest").eqNullSafe(F.col("_d"))))
            .drop("_r", "_d"))


def day_groups(details: DataFrame, records_per_commit: int) -> Iterator[list[str]]:
    """The days of the records in order, grouped to about so many records a commit.

    One row per day comes to the driver; a day is never split.
    """
    rows = A.archive_day_counts(details).orderBy("archive_date").collect()
    group: list[str] = []
    held = 0
    for row in rows:
        if group and held + row["n_records"] > records_per_commit:
            yield group
            group, held = [], 0
        group.append(row["archive_date"])
        held += row["n_records"]
    if group:
        yield group


def write_committed(spark: SparkSession, details: DataFrame, root: str, batch_id: int,
                    records_per_commit: int = 50_000_000) -> None:
    """K1: write the records in groups of days, each entered into the ledger once it is whole.

    Days that the ledger already has for this batch are left out, so a run that died is taken
    up where it stopped; a day that was being written then is replaced.
    """
    done = {r["day"] for r in read_ledger(spark, root).filter(F.col("batch") == batch_id).select("day").collect()}
    begun = _days_of(spark, root, batch_id) - done  # folders of a run that died; plain appends elsewhere
    day = X.utc_day(F.timestamp_millis(F.col("createdAt")))
    for group in day_groups(details, records_per_commit):
        left = [d for d in group if d not in done]
        if left:
            A.write_archive(details.filter(day.isin(left)), root, batch_id=batch_id, replace_batch=not begun.isdisjoint(left))
            commit(spark, root, batch_id, left)


def _days_of(spark: SparkSession, root: str, batch_id: int) -> set[str]:
    """The days that have a folder of the batch."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/archive_date=*/batch={batch_id}")
    folders = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    return {f.getPath().getParent().getName().removeprefix("archive_date=") for f in folders}


def compact_new(spark: SparkSession, root: str, out: str) -> list[str]:
    """K4: take the batches since the last compaction into ``out``; returns the days rewritten.

    Of the records with equal (day, story, chunk) the one with the most samples stays (ties:
    later batch). Only the ledger and the marks are read to find the days that have something
    new; without any, no record is read and nothing is written.
    """
    marks = _read(spark, f"{out}/_marks", MARKS).groupBy("day").agg(F.max("upto").alias("upto"))
    ledger = read_ledger(spark, root).groupBy("day").agg(F.max("batch").alias("batch"))
    due = (ledger.join(marks, "day", "left").filter(F.col("upto").isNull() | (F.col("batch") > F.col("upto")))
           .select("day", "batch", "upto").collect())  # one row per day with something new
    if not due:
        return []
    days = sorted(r["day"] for r in due)
    table = spark.createDataFrame([(r["day"], r["upto"], r["batch"]) for r in due], "archive_date string, _upto long, _last long")
    fresh = (committed_records(spark, root).filter(F.col("archive_date").isin(days)).join(F.broadcast(table), "archive_date")
             .filter((F.col("_upto").isNull() | (F.col("batch") > F.col("_upto"))) & (F.col("batch") <= F.col("_last")))
             .select("archive_date", "batch", "summary", "history", "chunk"))
    known = [r["day"] for r in due if r["upto"] is not None]
    if known:
        old = A.read_archive(spark, out).filter(F.col("archive_date").isin(known))
        fresh = fresh.unionByName(old.withColumn("batch", F.lit(-1).cast("long")).select(fresh.columns))
    A.write_compacted(A.best_records(fresh), out)
    table.select(F.col("archive_date").alias("day"), F.col("_last").alias("upto")).coalesce(1).write.mode("append").parquet(f"{out}/_marks")
    return days
