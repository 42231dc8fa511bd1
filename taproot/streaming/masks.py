"""Masks that arrive as a stream.

Counts add, views add and distances take the least, so a batch of new masks is a table of partial
voxels of the same shape, and partial tables are merged whenever the volume is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taproot.operators.volume import View, accumulate

KEY = ["arbor_id", "vx", "vy", "vz"]


def merged(partials: DataFrame) -> DataFrame:
    """Partial voxel tables as one."""
    return partials.groupBy(*KEY).agg(
        F.sum("seg_count").cast("int").alias("seg_count"), F.sum("view_count").cast("int").alias("view_count"), F.min("distance").alias("distance")
    )


def accumulating(masks: DataFrame, nodes: DataFrame, view: View, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of ``masks`` as a partial voxel table under ``path/batch=<id>``.

    A node must have all its mask voxels in one batch, as a file of one segmenter task has.  A batch
    that is run again overwrites its own folder, so every mask counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        filled = nodes.join(batch.select("arbor_id", "nid").distinct(), ["arbor_id", "nid"], "left_semi")
        accumulate(filled, batch, view).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return masks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
