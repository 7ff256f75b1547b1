"""Session helpers.

The library never creates its own cluster settings on a real cluster: it only
fills in values that are unset (local runs, tests, bench).  The checkpoint
folder is read from ``spark.checkpoint.dir``; a scratch folder is chosen only
when the session has none, which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on for correct results (not tuning knobs).
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with repeated keys keep the last one, as Python's json does.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Tuning defaults for local runs; a cluster's own values win.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "crease", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**LOCAL_CONF, **SEMANTIC_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("CREASE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_semantics(spark)
    return spark


def apply_semantics(spark: SparkSession) -> None:
    """Set the settings results depend on (idempotent, cheap)."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


_LOCAL_ROOT: str | None = None


def is_single_machine(master: str) -> bool:
    """Driver and tasks share one process (local, local[4], ...; not local-cluster)."""
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage and written intermediate tables.

    Uses ``spark.checkpoint.dir`` when the session names one; otherwise a
    scratch folder is created once per process, on a local master alone: on a
    cluster every executor would write to its own disk, so that raises.  The
    setting itself is not modified (it is a core setting, fixed at start-up).
    """
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_single_machine(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="crease-ckpt-")
        root = _LOCAL_ROOT
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


ROWS_PER_TASK = 500_000


def tasks_for_rows(spark: SparkSession, rows: int) -> int:
    """Tasks of at most about ``ROWS_PER_TASK`` rows each, so that a task's sort stays in memory whatever the
    table's size and the session's number of shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable (shared-storage) checkpoint."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
