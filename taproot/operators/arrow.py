"""Running a vectorised kernel over whole arbors, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Kernel = Callable[[pa.Table], pa.Table]


def by_arbor(df: DataFrame, kernel: Kernel, schema: str, key: str = "arbor_id", order: tuple[str, ...] = ("nid",), chunk: int = 50_000) -> DataFrame:
    """Applies ``kernel`` to tables that hold whole arbors, sorted by ``key`` and ``order``.

    One shuffle on ``key``.  A table is cut as soon as it has ``chunk`` rows and the arbor ends, so
    thousands of small arbors share one call, and memory is bounded by the largest arbor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk:
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last arbor may go on
            if cut:
                yield from kernel(whole.slice(0, cut)).to_batches()
                held = whole.slice(cut).to_batches()
                rows -= cut
        if held:
            yield from kernel(pa.Table.from_batches(held)).to_batches()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
