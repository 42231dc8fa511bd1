"""Masks for the nodes of a forest, from a fragment graph or from a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot import schemas
from taproot.operators import graph
from taproot.operators.volume import View, region_of, to_voxels


class Segmenter(Protocol):
    """A source of masks: nodes in, ``arbor_id, nid, i, j, k, v`` out; nodes without a mask have no row."""

    def segment(self, nodes: DataFrame) -> DataFrame: ...


class FragmentSegmenter:
    """Masks from a table of labelled voxels and a scored graph between the labels.

    All regions are joined to the fragments at once; a region with nothing at its middle yields no
    mask.  ``shift`` moves regions, in voxels, before they are read.
    """

    def __init__(self, fragments: DataFrame, edges: DataFrame, view: View, threshold: float = 0.3, shift: tuple[int, int, int] = (0, 0, 0)):
        self.fragments, self.edges, self.view, self.threshold, self.shift = fragments, edges, view, threshold, shift

    def regions(self, nodes: DataFrame) -> DataFrame:
        boxes = to_voxels(region_of(nodes, self.view), self.view.voxel)
        moved = {f"{m}_{a}": F.col(f"{m}_{a}") + s for m in ("lo", "hi") for a, s in zip("xyz", self.shift, strict=True)}
        return boxes.withColumns(moved).withColumn("roi_id", F.concat_ws("/", F.col("arbor_id").cast("string"), F.col("nid").cast("string")))

    def segment(self, nodes: DataFrame) -> DataFrame:
        found = graph.center_object(self.regions(nodes), self.fragments, self.edges, self.threshold, max(4, max(self.view.fov)))
        return found.select("arbor_id", "nid", "i", "j", "k", "v")


class ModelSegmenter:
    """Masks from a function that loads once per task: ``load()`` gives ``predict(nodes) -> masks``.

    ``predict`` takes a pandas frame of nodes and returns rows ``arbor_id, nid, i, j, k, v``.  Masks
    that are empty, or that do not hold the middle voxel, are dropped as failures.
    """

    def __init__(self, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], view: View):
        self.load, self.view = load, view

    def segment(self, nodes: DataFrame) -> DataFrame:
        load = self.load

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = load()
            for f in frames:
                yield predict(f)

        found = nodes.select("arbor_id", "nid", "x", "y", "z").mapInPandas(run, schemas.MASKS)
        return seeded(found, self.view)


def seeded(masks: DataFrame, view: View) -> DataFrame:
    """Masks that hold their middle voxel."""
    h = view.half
    good = masks.where((F.col("i") == h[0]) & (F.col("j") == h[1]) & (F.col("k") == h[2]) & (F.col("v") == 1))
    return masks.join(good.select("arbor_id", "nid").distinct(), ["arbor_id", "nid"], "left_semi")
