"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, or the one the session was given."""
    return spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
