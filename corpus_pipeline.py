"""Corpus pipeline: five operators of ``storytrack.llm``, each over all that the one before kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Between stages the rows are written as Parquet and
read again, so a stage's lineage ends there and a lost executor repeats little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm import langid, line_dedup, near_dedup, pieces
from storytrack.llm.common import Scratch, broadcast_if_small, cut, fold, fresh, small_batches, table
from storytrack.llm.decontaminate import contaminated

# Near-duplicates of the corpus are documents whose word shingles are similar to 0.8 or more.
NEAR_DUPLICATE = 80
# Executors still hold what earlier stages left: the last one keeps fewer words than it does alone.
CACHE_BYTES = 8 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; 'und' and very unsure ones go.

    Null and empty texts, and texts without letters, are 'und' and go. Null languages teach
    nothing; without any labelled text no document is identified. Equal rows fare alike; rows
    without an id are judged like all others; an empty table stays empty.
    """
    with small_batches(spark, langid.TEXTS_AT_ONCE):
        model = langid.fit(docs.filter(fold(F.col("doc_id"), 3) != 1))
        return cut(langid.reject_undetermined(docs, model))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; n_chars follows the text.

    Copies of a document are one page of the source: the next stage keeps one of them, whole.
    Every row stays, if need be with an empty text; a null text stays null; rows without a
    source form one source; repeated rows are copies; an empty table stays empty.
    """
    kept = line_dedup.drop_boilerplate(docs, "source", "text", copies_once=True)
    changed = F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.select(*[changed.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
                         for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Null, empty and blank texts have no near-duplicates and stay, as do rows without an id.
    Rows that share an id are one document and stay or go together, repeated rows too. An
    empty table stays empty; texts of any length are compared whole.
    """
    return near_dedup.keep_one_of_each(docs, threshold=NEAR_DUPLICATE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Rows are judged one by one, under a number of their own: of rows that share an id, or have
    none, only those with a passage go. Null and empty texts stay; an empty benchmark removes
    nothing; an empty table stays empty; texts of any length are searched whole.
    """
    row = fresh(docs, "_row")
    # The table is read from files, so that a row has the same number in both readings.
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    bad = cut(contaminated(numbered, table(spark, sf_dir, "benchmark"), row).select(row).distinct())
    kept = numbered.join(broadcast_if_small(bad, near_dedup.MAX_BROADCAST_IDS), row, "left_anti")
    return kept.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row doc_id, n_tokens, ids_crc32 and whether the ids decode to the text.

    Null and empty texts have no tokens; repeated rows and null ids stay; an empty table
    gives no rows; texts of over a chunk go through the scan, whole.
    """
    return pieces.encoded_and_decoded(docs, spark, cache_bytes=CACHE_BYTES)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("sentencepiece", tokens),
]

# Trained models and minhashes are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if n:
            scratch.drop(STAGES[n - 1][0])  # a stage's table is read by the next stage only
    return docs
