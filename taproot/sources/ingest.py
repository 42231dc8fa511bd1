"""Reading node tables and bringing them into one shape."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot import schemas
from taproot.operators import topology

CSV_SCHEMA = "nid string, pid string, x string, y string, z string"


def whole(c: Column) -> Column:
    """A number's text as a whole number, truncated towards zero."""
    return F.trim(c).cast("double").cast("bigint")


def normalised(raw: DataFrame) -> DataFrame:
    """Nodes from five text columns: numbers truncated; a parent that is ``null``, ``none`` (blanks
    aside) or the node's own id as text means a root."""
    none = F.col("pid").isNull() | F.trim("pid").isin("null", "none") | (F.trim("pid") == F.trim("nid"))
    keys = [F.col("arbor_id") if "arbor_id" in raw.columns else F.lit(0).cast("bigint").alias("arbor_id")]
    more = [c for c in raw.columns if c not in ("arbor_id", "nid", "pid", "x", "y", "z")]
    return raw.select(
        *keys, whole(F.col("nid")).alias("nid"), F.when(~none, whole(F.col("pid"))).alias("pid"),
        *[whole(F.col(c)).cast("double").alias(c) for c in "xyz"], *more,
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file without header, columns ``nid, pid, x, y, z``, comma and ``|`` as delimiter and quote."""
    return normalised(spark.read.schema(CSV_SCHEMA).csv(path, sep=",", quote="|", header=False))


def parse_csv(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same from a column of lines; other columns stay."""
    row = F.from_csv(column, F.lit(CSV_SCHEMA), {"sep": ",", "quote": "|"})
    return normalised(lines.withColumn("row_", row).select(*[c for c in lines.columns if c != column], "row_.*"))


def from_id_pairs(spark: SparkSession, pairs: DataFrame | Iterable[tuple[int, int | None]], arbor_id: int = 0) -> DataFrame:
    """Topology alone; centres are null.  ``pairs`` is a table ``arbor_id, nid, pid``, or rows of one arbor."""
    if isinstance(pairs, DataFrame):
        ids = [F.col(c).cast("bigint").alias(c) for c in ("arbor_id", "nid", "pid")]
        return pairs.select(*ids, *[F.lit(None).cast("double").alias(c) for c in "xyz"])
    return from_rows(spark, [(n, p, None, None, None) for n, p in pairs], arbor_id)


def from_rows(spark: SparkSession, rows: Iterable[tuple], arbor_id: int = 0) -> DataFrame:
    """Nodes from ``(nid, pid, x, y, z)`` or, with given Strahler numbers, six values."""
    rows = [(arbor_id, *r[:2], *(None if v is None else float(v) for v in r[2:5]), *r[5:]) for r in rows]
    return spark.createDataFrame(rows, schemas.NODES_STRAHLER if rows and len(rows[0]) == 7 else schemas.NODES)


def last_wins(nodes: DataFrame, ordinal: str) -> DataFrame:
    """Of rows that share a node id, the one of greatest ``ordinal``."""
    rest = [c for c in nodes.columns if c not in ("arbor_id", "nid")]
    best = nodes.groupBy("arbor_id", "nid").agg(F.max_by(F.struct(*rest), ordinal).alias("row_"))
    return best.select("arbor_id", "nid", *[F.col("row_")[c].alias(c) for c in rest if c != ordinal])


def with_centers(nodes: DataFrame, centers: DataFrame) -> DataFrame:
    """Nodes whose missing centres are filled in from ``centers(arbor_id, nid, x, y, z)``; set ones stay."""
    new = centers.select("arbor_id", "nid", *[F.col(c).alias("new_" + c) for c in "xyz"])
    both = nodes.join(new, ["arbor_id", "nid"], "left")
    return both.withColumns({c: F.coalesce(c, "new_" + c) for c in "xyz"}).drop("new_x", "new_y", "new_z")


def build_tree(nodes: DataFrame) -> DataFrame:
    """The largest tree of each arbor, indexed; see ``topology.index``."""
    return topology.index(nodes)


def excluded(nodes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per arbor, how many nodes are in no kept tree: smaller components and cycles."""
    n = nodes.groupBy("arbor_id").agg(F.count(F.lit(1)).alias("n"))
    kept = indexed.groupBy("arbor_id").agg(F.count(F.lit(1)).alias("kept"))
    return n.join(kept, "arbor_id", "left").select("arbor_id", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("excluded"))


def require_trees(nodes: DataFrame, indexed: DataFrame) -> None:
    """Raises where an arbor has nodes but no root at all."""
    gone = nodes.select("arbor_id").distinct().join(indexed.select("arbor_id"), "arbor_id", "left_anti").limit(5).collect()
    if gone or nodes.isEmpty():
        raise ValueError(f"no root in arbors {[r.arbor_id for r in gone]}" if gone else "no nodes")


def extract(nodes: DataFrame, masks: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows ``arbor_id, nid, pid, x, y, z, strahler`` and the masks that are there."""
    order = F.col("order_no") if "order_no" in nodes.columns else F.col("strahler")
    rows = nodes.select("arbor_id", "nid", "pid", "x", "y", "z", order.cast("int").alias("strahler"))
    return rows, None if masks is None else masks.where("v is not null")
