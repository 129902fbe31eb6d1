"""Exact de-duplication with a heavy-hitter split.

A Misra-Gries summary (Spark's ``freqItems``) names the digests that may hold more than
``support`` of all rows: at most ``1 / support`` of them. A second pass verifies their
counts and smallest ids exactly; those winners are broadcast, so rows of heavy groups are
resolved where they lie and never meet in one task. All other digests, each with at most
``support`` of the rows, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import cut, table

SUPPORT = 1e-3
# A lone space stays as it is; every other run of white space becomes one space.
WHITE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as '', each run of ``[\\x20\\x09-\\x0D]`` as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def heavy_winners(digests: DataFrame, key: str, id_col: str, support: float = SUPPORT) -> DataFrame:
    """(key, _keep, _size) of the keys that hold more than ``support`` of the rows; ≤ 1/support rows."""
    total = digests.count()
    found = digests.freqItems([key], support).select(F.explode(F.col(f"{key}_freqItems")).alias(key))
    exact = (digests.join(F.broadcast(found), key)
             .groupBy(key).agg(F.min(id_col).alias("_keep"), F.count(F.lit(1)).alias("_size")))
    return cut(exact.filter(F.col("_size") > support * total))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the smallest id of a group stays.
    Null text counts as ''. A null id loses to any other id; a group with null ids only has
    keep_id null and keeps its rows. Rows that repeat both id and text are marked alike and
    each counts in group_size. Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"),
                           F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")))
    winners = heavy_winners(rows, "text_sha256", "doc_id", support)
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("_keep"),
                                             F.count(F.lit(1)).alias("_size"))
    marked = heavy.unionByName(rest.join(groups, "text_sha256"))
    return marked.select(F.col("doc_id").alias(id_col), F.col("_keep").alias("keep_id"),
                         F.col("_size").alias("group_size"),
                         F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
