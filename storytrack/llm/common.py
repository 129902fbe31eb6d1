"""Small helpers shared by the operators: lineage cuts, checked broadcasts, hold-out folds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.session import checkpoint_dir


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors' Python workers, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_storytrack_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="storytrack-"), "storytrack_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._storytrack_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder (lineage ends there)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one run, as Parquet in a folder of its own under the shared checkpoint folder.

    Reading a table again never repeats what made it, and tables that are no longer needed can
    be dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df``, written and read again; with ``rows`` in partitions of about so many rows.

        Small tables of iterations are then one partition, which joins and aggregates with its
        like without an exchange; large ones have as many partitions as they need.
        """
        made = self.paths.setdefault(name, [])
        made.append(f"{self.root}/{name}-{uuid.uuid4().hex[:8]}")
        df.write.parquet(made[-1])
        table = self.spark.read.schema(df.schema).parquet(made[-1])
        return table if rows is None else table.coalesce(max(1, -(-table.count() // rows)))

    def renew(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """:meth:`write`, then drop the older tables of that name (``df`` may read them)."""
        before = self.paths.pop(name, [])
        made = self.write(df, name, rows)
        self._delete(before)
        return made

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name, []))

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint for a materialised ``df`` of at most ``max_rows`` rows, else ``df`` as it is.

    Both ways give the same rows; beyond the bound Spark shuffles both sides (and AQE splits
    hot partitions).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_if_bytes(df: DataFrame, max_bytes: int) -> DataFrame:
    """A broadcast hint for a materialised ``df`` whose values take at most ``max_bytes``, else ``df``.

    Strings, binaries and arrays count with their real lengths, each row with 48 bytes besides.
    """
    size = F.lit(48)
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array":
            item = F.transform(c, lambda x: F.lit(16) + F.coalesce(F.octet_length(x.cast("string")), F.lit(0)))
            size = size + F.coalesce(F.aggregate(item, F.lit(0), lambda a, x: a + x), F.lit(0))
        else:
            size = size + F.lit(16)
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def fit_in_task(sample: DataFrame, train, order: list[str]) -> bytes:
    """Run ``train(iterator of pandas frames) -> bytes`` once over a bounded, ordered sample.

    The sample (its bound is the caller's documented parameter) goes to one task; the model's
    bytes come back. A lost executor only repeats the task, with the same rows in the same order.
    """
    import pandas as pd

    def run(frames):
        trim_memory()
        yield pd.DataFrame({"model": [train(frames)]})
        trim_memory()

    ship(sample.sparkSession)
    ordered = sample.repartition(1).sortWithinPartitions(*order)
    made = ordered.mapInPandas(run, "model binary").first()
    return bytes(made["model"]) if made else train(iter(()))  # no task runs over an empty sample


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replace_columns(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` with the named columns added, or replaced where ``df`` has columns of these names."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in new}],
                     *[v.alias(k) for k, v in new.items()])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    max_rows: int) -> DataFrame:
    """(doc_id, label, _place, text) of the ``max_rows`` labels with the smallest id hashes.

    Only these labels, at most ``max_rows`` ids, are broadcast; the documents are not shuffled.
    """
    place = F.xxhash64(F.col(id_col))
    chosen = (labels.filter(F.col(label_col).isNotNull())
              .select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"), place.alias("_place"))
              .orderBy("_place", "doc_id", "label").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


# What a Python worker keeps from task to task: dictionaries by a file's path.
KEPT: list[dict] = []


def trim_memory(own: dict | None = None) -> None:
    """Give memory back to the system: Python workers live on for the stages that follow.

    What earlier stages kept in the worker (``KEPT``) goes too, but for ``own``.
    """
    import ctypes
    import gc

    import pyarrow as pa

    for kept in KEPT:
        if kept is not own:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Actions inside send at most ``rows`` rows at a time to Python: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
