"""End-to-end jobs: nodes to rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taproot.config import Config
from taproot.operators import dense, mesh, resample, scores, topology, volume
from taproot.operators.blocks import confidence_bytes
from taproot.operators.lineage import cut
from taproot.operators.segment import FragmentSegmenter, Segmenter
from taproot.sources import artefacts, ingest


def prepared(nodes: DataFrame, config: Config) -> DataFrame:
    """Trees built and, if asked for, filtered by order and resampled; indexed."""
    c = config.skeleton
    trees = topology.index(nodes)
    ingest.require_trees(nodes, trees)
    if c.strahler_filter and (c.min_strahler > 1 or c.max_strahler < 10_000):
        trees = topology.filter_by_order(trees, c.min_strahler, c.max_strahler)
    if c.resample:
        trees = topology.index(resample.resampled(trees, c.resample_delta, c.resample_sigma, c.smoothing))
    return trees


#: Voxels of a field of view from which volumes are summed and scored block by block.
LARGE = 10_000


def ranked(trees: DataFrame, source: Segmenter, config: Config) -> dict[str, DataFrame]:
    """Masks, voxels, rankings, confidences and the surface of prepared trees.

    Masks and voxels are read several times and are checkpointed once.  A large field of view goes through
    dense blocks; interpolation along edges is for small ones.
    """
    view, use = volume.View.of(config.segmentations), config.skeleton.use_consensus
    masks = cut(source.segment(trees))
    if view.fov[0] * view.fov[1] * view.fov[2] >= LARGE and not view.interpolate:
        leaf = tuple(config.segmentations.leaf_shape_voxels)
        bits = cut(dense.packed(masks, view))
        sums = cut(dense.accumulate(trees, bits, view, leaf))
        voxels, rankings = dense.to_voxels(sums, leaf), dense.ranking(trees, bits, sums, view, leaf, use)
    else:
        voxels = cut(volume.accumulate(trees, masks, view))
        rankings = scores.ranking(trees, masks, voxels, view, use)
    counts = voxels.where("seg_count > 0").select("arbor_id", "vx", "vy", "vz", voxels["seg_count"].alias("value"))
    return {
        "nodes": trees, "masks": masks, "voxels": voxels, "rankings": rankings,
        "confidence": confidence_bytes(voxels, view.incr_denom),
        "triangles": mesh.surface(counts, 0.5, view.voxel),
    }


def from_fragments(spark: SparkSession, config: Config, fragments: str, edges: str, csv: str | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """The whole job over a CSV of nodes and Parquet tables of fragments and edges; saved under ``out``."""
    nodes = ingest.read_csv(spark, csv or config.skeleton.csv)
    trees = prepared(nodes, config)
    view = volume.View.of(config.segmentations)
    source = FragmentSegmenter(spark.read.parquet(fragments), spark.read.parquet(edges), view, config.fragments.threshold, config.fragments.shift)
    tables = ranked(trees, source, config)
    if out or config.skeleton.output_file_base:
        artefacts.save(out or config.skeleton.output_file_base, config, **tables)
    return tables


def from_model(spark: SparkSession, config: Config, source: Segmenter, csv: str | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """The same with any other source of masks."""
    tables = ranked(prepared(ingest.read_csv(spark, csv or config.skeleton.csv), config), source, config)
    if out or config.skeleton.output_file_base:
        artefacts.save(out or config.skeleton.output_file_base, config, **tables)
    return tables
