"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="ledgerfield-")
    return _local[app]


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path of this application's own below the checkpoint folder."""
    return "/".join([checkpoint_root(spark), spark.sparkContext.applicationId, *parts])
