"""Session helpers: a local session for tests and benches, and checkpoint-dir handling.

On a cluster the session is created by the caller; nothing here overrides its settings
except `ensure_checkpoint_dir`, which only fills `spark.checkpoint.dir` when it is unset.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "icx") -> SparkSession:
    """Local session used by tests and bench.py (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256KB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ICX_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only when the cluster named none.

    The shared folder configured as `spark.checkpoint.dir` always wins. Only a local master,
    whose driver and tasks are one machine, gets a fresh scratch folder when it is unset; on
    a cluster a folder of one machine would lose data, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        configured = tempfile.mkdtemp(prefix="icx-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query that has ended leaves no shuffle files: what it made is written or checkpointed.

    Spark's own switch, put back as it was afterwards. Without it the files stay until the
    driver happens to collect its garbage, those of all steps side by side.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_UNITS = {"": 0, "b": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}


def byte_setting(spark: SparkSession, name: str, default: int) -> int:
    """A size setting in bytes, whatever unit it is written in (`64MB`, `1g`, `-1`)."""
    raw = str(spark.conf.get(name, str(default))).strip().lower()
    m = re.fullmatch(r"(-?\d+)([kmgtp]?)(?:i?b)?", raw)
    if not m:
        raise ValueError(f"{name} is no size: {raw!r}")
    return int(m[1]) << (10 * _UNITS[m[2]])
