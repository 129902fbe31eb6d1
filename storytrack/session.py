"""Session construction and cluster-facing settings."""

from __future__ import annotations

import atexit
import datetime as _dt
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Fixed evaluation instant used by the canonical bindings and the oracle SQL.
AS_OF = _dt.datetime(1998, 6, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"

# Defaults for a large cluster; tests and bench override partitions to the core count.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rebalance hot partitions before writes (archive sink) instead of one huge file.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Size-checked broadcast: only plans whose estimated size is under this are broadcast.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.executorEnv.PYTHONWARNINGS": "ignore::FutureWarning",
}


def _driver_memory() -> str:
    """Local-mode heap: 60 % of the machine's memory, between 1 and 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    for limit_file in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            with open(limit_file) as fh:
                text = fh.read().strip()
            if text.isdigit():
                total = min(total, int(text))  # a container limit below the host's memory
        except OSError:
            pass
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "storytrack", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    The partition count here suits local runs. On a cluster, submit with
    ``spark.sql.shuffle.partitions`` near (largest shuffle size / 128 MB) — AQE coalesces
    small stages down from it and splits skewed partitions — and point
    ``spark.checkpoint.dir`` at shared storage.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(CLUSTER_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = _driver_memory()
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage, else this raises. Only a
    session whose master is ``local`` (as in tests) gets a scratch folder of its own when
    the setting is unset; it is removed when the program ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="storytrack-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        try:
            spark.conf.set("spark.checkpoint.dir", path)  # remembered for later calls
        except Exception:  # noqa: BLE001 - a core config may be read-only at runtime
            pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    The planner then knows the frame's true size before it plans what reads it: a small one is
    broadcast, where an estimate would have had the other side shuffled as well.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
