"""Saving a run's tables and reading them back."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from taproot.config import Config

log = logging.getLogger(__name__)
TABLES = ("nodes", "masks", "rankings", "voxels", "confidence", "triangles")


def save(base: str, config: Config, **tables: DataFrame | None) -> None:
    """Writes each given table under ``base`` as Parquet, a folder each, which must not exist yet.

    Voxels are laid out by block, so that readers can skip by ``bx, by, bz``.  The configuration goes
    along as text if the ``skeleton`` section asks for it; so do the tables it has a flag for.
    """
    flags = config.skeleton
    wanted = {"nodes": flags.save_nodes, "masks": flags.save_masks, "rankings": flags.save_rankings, "triangles": flags.save_meshes}
    spark = None
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"no artefact is named {name}")
        if df is None or not wanted.get(name, flags.save_segmentations):
            continue
        spark = df.sparkSession
        out = df
        if name in ("voxels", "confidence"):
            leaf = config.segmentations.leaf_shape_voxels
            out = df.withColumns({"b" + a: F.floor(F.col("v" + a) / n).cast("bigint") for a, n in zip("xyz", leaf, strict=True)})
            out = out.repartitionByRange("arbor_id", "bx", "by", "bz").sortWithinPartitions("arbor_id", "bx", "by", "bz")
        out.write.mode("errorifexists").parquet(f"{base}/{name}")
    if flags.save_config and spark is not None:
        spark.createDataFrame([(config.to_toml(),)], "toml string").coalesce(1).write.mode("errorifexists").parquet(f"{base}/config")


def load(spark: SparkSession, base: str) -> dict[str, DataFrame | Config | None]:
    """What ``save`` wrote; what is missing is None and logged."""
    out: dict[str, DataFrame | Config | None] = {}
    for name in (*TABLES, "config"):
        try:
            out[name] = spark.read.parquet(f"{base}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("%s has no %s", base, name)
            out[name] = None
    if out["config"] is not None:
        import tomllib

        out["config"] = Config.of(tomllib.loads(out["config"].first().toml))
    return out


def voxels_in(spark: SparkSession, base: str, lo: tuple[int, int, int], hi: tuple[int, int, int], leaf: tuple[int, int, int]) -> DataFrame:
    """Saved voxels of a box; the block keys are compared with literals, so files are skipped."""
    df = spark.read.parquet(f"{base}/voxels")
    for a, p, q, n in zip("xyz", lo, hi, leaf, strict=True):
        df = df.where(F.col("b" + a).between(p // n, (q - 1) // n) & (F.col("v" + a) >= p) & (F.col("v" + a) < q))
    return df.drop("bx", "by", "bz")


def load_volumes(spark: SparkSession, volumes: dict[str, dict[str, str]], name: str | None = None, in_memory: bool = False) -> dict[str, DataFrame]:
    """Block tables by volume name: ``{name: {"path": .., "format": ..}}``, those whose name matches.

    Image stacks and arrays come as ``binaryFile``, all else in Spark's own formats.
    """
    out = {}
    for key, v in volumes.items():
        if name is None or re.search(name, key):
            df = spark.read.format(v.get("format", "parquet")).load(v["path"])
            out[key] = df.cache() if in_memory else df
    return out
