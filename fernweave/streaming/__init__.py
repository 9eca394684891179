"""Streams of changes: micro-batches of rows and patches applied to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..api import Collection
from ..schema import ID


def insert_stream(collection: Collection, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that adds each micro-batch of a streaming frame as one version, once; empty ones make none.

    The store keeps the number of the last batch under the name of the checkpoint, so one that a failed run repeats is not added
    again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if batch.head(1):
            collection.insert_rows(batch, once=(checkpoint, number))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def patch_stream(collection: Collection, patches: DataFrame, order: str, checkpoint: str) -> DataStreamWriter:
    """A writer that applies each micro-batch of patches; of several for one id in a batch the last by ``order`` counts.

    Patches name values, so a batch that a failed run repeats changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        fields = [c for c in batch.columns if c not in (ID, order)]
        last = batch.groupBy(ID).agg(F.max_by(F.struct(*fields), order).alias("last")).select(ID, "last.*")
        if last.head(1):
            collection.update_rows(last)

    return patches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
