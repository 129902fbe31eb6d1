"""Stand-in producers for the streaming jobs: land files in arrival order.

A crawler lands payload files as it fetches them; this lands the test tables' rows the
same way. :func:`landings` lands group after group of arrival steps, each as many files that
appear at once, for a stream that is run after every landing. :func:`land_in_order` lands
small inputs at once: one file per group, with modification times in step order so that the
file source replays them in sequence. They shape input only; the jobs do all the work.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def landings(df: DataFrame, folder: str, step_col: str, fmt: str = "json", steps_at_once: int = 1,
             prefix: str = "step") -> Iterator[int]:
    """Land ``df`` in groups of ``steps_at_once`` distinct ``step_col`` values, in their order; a
    group lands when the iterator is asked for it, and its number is returned.

    All rows with a step are written once beside ``folder``, by the tasks that compute them (no
    shuffle: a task writes a file for each step it has, so no task holds a whole group), and a
    landing renames its steps' folders into place. ``step_col`` is a time or a whole number.
    """
    step = F.col(step_col)
    if df.schema[step_col].dataType.typeName() == "timestamp":
        step = F.unix_micros(step)
    staged = f"{folder.rstrip('/')}-{prefix}"
    (df.filter(F.col(step_col).isNotNull()).withColumn("land", step.cast("long"))
     .write.mode("overwrite").partitionBy("land").format(fmt).save(staged))
    hadoop, conf = df.sparkSession._jvm.org.apache.hadoop.fs, df.sparkSession._jsc.hadoopConfiguration()
    fs = hadoop.Path(staged).getFileSystem(conf)
    steps = sorted((s.getPath() for s in fs.listStatus(hadoop.Path(staged)) if s.isDirectory()),
                   key=lambda p: int(p.getName().split("=")[1]))
    target = hadoop.Path(f"{folder.rstrip('/')}/{prefix}")
    fs.mkdirs(target)
    for number, first in enumerate(range(0, len(steps), steps_at_once)):
        for path in steps[first:first + steps_at_once]:
            if not fs.rename(path, hadoop.Path(target, path.getName())):
                raise OSError(f"{path.toString()} could not be landed")
        yield number


def land_in_order(df: DataFrame, folder: str, step_col: str, fmt: str = "json", steps_per_file: int = 1,
                  prefix: str = "step") -> int:
    """Write ``df`` once, with one file per group of ``steps_per_file`` distinct ``step_col``
    values; a group's file is younger than those of earlier groups and earlier calls.
    Returns the number of files."""
    number = F.row_number().over(Window.orderBy(step_col)) - 1  # of the distinct steps
    steps = df.select(step_col).distinct().select(step_col, F.floor(number / steps_per_file).cast("int").alias("land"))
    landed = df.join(steps, step_col).select(*df.columns, "land")
    root = f"{folder.rstrip('/')}/{prefix}"
    landed.repartition("land").write.mode("overwrite").partitionBy("land").format(fmt).save(root)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    folders = sorted((s.getPath() for s in fs.listStatus(path) if s.isDirectory()),
                     key=lambda p: int(p.getName().split("=")[1]))
    start = max([int(time.time() * 1000), *(
        f.getModificationTime() for s in fs.listStatus(path.getParent()) if s.isDirectory()
        for d in fs.listStatus(s.getPath()) if d.isDirectory() for f in fs.listStatus(d.getPath()))])
    for i, p in enumerate(folders):
        for f in fs.listStatus(p):
            fs.setTimes(f.getPath(), start + 1000 * (i + 1), -1)
    return len(folders)
