"""What is computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a folder of our own, which only a session on one machine shares."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise EngineError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_fernweave_dir", None)
    if own is None:
        own = spark.sparkContext._fernweave_dir = tempfile.mkdtemp(prefix="fernweave-")
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """Computed now, with fixed partitions, and safe from lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
