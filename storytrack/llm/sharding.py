"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a key from a hash of key and shard; weighted by the shard's
weight, the highest draw has the record. A draw depends on nothing else, so a new shard takes
records only into itself, a removed one gives up its own only, and a changed weight moves
records only to or from that shard, in proportion to the change.

Shards are folders of Parquet files with whole records. Rows are rebalanced by shard before
the write, so a file holds one shard's rows, a large shard is many files, and no task gets
more than the advisory partition size. A record's slot is its place in its shard: the rows of
the files before its own, plus its row number in the file. The files are the numbering, so it
needs no global sort and no window over a shard, and reading again gives the same slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from storytrack.llm.common import Scratch, fresh, table

SHARDS = 8
LAW = "key"
SALT = "rendezvous-1"


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0 … n-1 (int) of a key; shards of weight 0 get nothing, one weight must be above 0.

    The key is hashed as text. A null key counts as the empty text: all null keys share a shard.
    """
    live = [(shard, float(w)) for shard, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(SALT), F.lit(shard), text), 11)
        even = (bits.cast("double") + 0.5) / float(1 << 53)  # in (0, 1), exactly from 53 bits
        return F.struct((-F.log(even) / weight).alias("draw"), F.lit(shard).alias("shard"))

    draws = [draw(*x) for x in live]
    return (F.least(*draws) if len(draws) > 1 else draws[0]).getField("shard").cast("int")


def write_shards(docs: DataFrame, path: str, key_col: str, weights: Sequence[float]) -> None:
    """Write all columns of ``docs`` to ``path/records/<shard column>=<n>/`` and a manifest.

    The folder column is ``shard``; if ``docs`` has one of that name, ``shard_`` and so on.
    ``path/manifest`` has a row (shard, file, rows, start) for each file: start is the slot of
    its first row. Files count in the order of their paths; their rows are counted from the
    files' footers, without reading a column.
    """
    spark = docs.sparkSession
    name = fresh(docs, "shard")
    placed = docs.withColumn(name, rendezvous(F.col(f"`{key_col}`"), weights))
    placed.hint("rebalance", F.col(name)).write.partitionBy(name).parquet(f"{path}/records")
    files = (_records(spark, path, docs.schema).select(F.col(name).alias("shard"), F.col("_metadata.file_path").alias("file"))
             .groupBy("shard", "file").agg(F.count(F.lit(1)).alias("rows")))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("file").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    files.withColumn("start", before).write.parquet(f"{path}/manifest")


def _records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    shard = StructField(fresh(spark.createDataFrame([], schema), "shard"), IntegerType())
    return spark.read.schema(StructType([*schema, shard])).parquet(f"{path}/records")


def read_shards(spark: SparkSession, path: str, schema: StructType, columns: Sequence[Column]) -> DataFrame:
    """``columns`` over the records (of ``schema``) with _shard int and _slot long, gapless from 0 in a shard."""
    records = _records(spark, path, schema)
    rows = records.select(*columns, F.col(f"`{records.columns[-1]}`").alias("_shard"),
                          F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    starts = spark.read.schema("file string, start long").parquet(f"{path}/manifest").toDF("_file", "_start")
    return rows.join(starts, "_file").withColumn("_slot", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    weights: Sequence[float] = (1.0,) * SHARDS, path: str | None = None) -> DataFrame:
    """One row per input row, from the written shards: id, size, text_crc32, law, shard, slot, grown_shard.

    The shard follows from the id and the weights alone (law ``key``): rows that share an id,
    and all rows without one, share a shard. size is the text's UTF-8 bytes plus 1, a null text
    having none and the crc32 of no bytes, 0. grown_shard is the shard with one more of weight 1.
    Repeated rows have slots of their own; other columns are written too, whatever their names;
    an empty table gives no rows. Without ``path`` the shards go to the shared checkpoint folder.
    """
    spark = docs.sparkSession
    path = path or Scratch(spark, "shards").root
    write_shards(docs, path, id_col, weights)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    key = F.col(f"`{id_col}`")
    rows = read_shards(spark, path, docs.schema, [
        key.alias(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit(LAW).alias("law"), rendezvous(key, [*weights, 1.0]).alias("grown_shard")])
    return rows.select(id_col, "size", "text_crc32", "law", F.col("_shard").alias("shard"),
                       F.col("_slot").alias("slot"), "grown_shard")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
