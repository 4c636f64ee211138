"""Session helpers: shared scratch space and a test session builder.

Library code never builds its own session or changes global settings of the
one it is given.  The only thing it needs from the cluster is a *shared*
folder for checkpoints and intermediate tables; that folder is whatever
``spark.checkpoint.dir`` names.  Only when the setting is absent (local tests)
do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CKPT_KEY, None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"{_CKPT_KEY} must name a folder that all executors share on {sc.master}")
        configured = tempfile.mkdtemp(prefix="millwright-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint root for one written table."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/millwright/{name}-{uuid.uuid4().hex[:12]}"


def build_local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "millwright") -> SparkSession:
    """Session for tests and the bench: UI off, UTC, AQE on, ANSI on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MILLWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark
