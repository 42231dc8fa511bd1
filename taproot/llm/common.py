"""Plumbing shared by the corpus operators: reading, shared scratch tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_taproot_scratch", None)
        if base is None:
            master = spark.sparkContext.master
            if not re.match(r"local($|\[)", master):
                raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
            base = spark._taproot_scratch = "file://" + tempfile.mkdtemp(prefix="taproot-")
    return base.rstrip("/")


#: Settings of a write: the shuffle files go as soon as it has ended, and Arrow batches of long texts
#: stay small, so that what Python and the JVM hold of them does not grow with the texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


#: Options of a write of rows of some MB: else 100 rows are held before a row group is looked at for its size, by the task
#: that writes them and by those that read.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe against lost executors.

    The shuffle files behind it go with the end of the write, instead of some later garbage collection
    on the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taproot/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._taproot_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes ``written`` tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._taproot_path)
        path.getFileSystem(conf).delete(path, True)


def hash_sample(df: DataFrame, columns: list[str], most: int, by: str | None = None) -> DataFrame:
    """About ``most`` rows of ``df``, those whose hash of ``columns`` is least, each once however often it repeats.

    With ``by``, as many of each of its values, all rows of a value that has fewer.  The share is set
    from counts and a hot value is thinned by the other columns, so neither the sample nor any
    partition's part of it grows with the table.  The same rows give the same sample.
    """
    spread = 1 << 40
    place = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(spread))
    if by is None:
        n = df.count()
        chosen = df.where(place < (min(spread, -(-spread * most // n)) if n else spread))
    else:
        sizes = {r[by]: r["n"] for r in df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            return df.limit(0)
        each = -(-most // len(sizes))
        shares = F.create_map(*[F.lit(x) for v, n in sorted(sizes.items()) for x in (v, min(spread, -(-spread * each // n)))])
        chosen = df.where(place < shares[F.col(by)])
    return chosen.withColumn("place_", F.xxhash64(*df.columns)).dropDuplicates(["place_"]).drop("place_")


def blocked(df: DataFrame, key: str, by: str, most: int, weight: str | None = None, heaviest: int = 0) -> DataFrame:
    """Rows of ``df`` dealt out and sorted so that every two rows of one ``key`` meet in a group.

    A group is a run of rows of equal ``key, p, q``.  Keys of at most ``most`` rows are one group,
    keys of one row are left out, and a larger key is cut by a hash of ``by`` into blocks of about
    that size, each pair ``(p, q)`` of which is a group.  ``own`` is the row's block.  With
    ``weight``, blocks are also to weigh no more than ``heaviest`` together.
    """
    heavy = F.sum(weight) / heaviest if weight else F.lit(0.0)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_"), heavy.alias("heavy_")).where("rows_ > 1")
    cuts = F.least(F.col("rows_"), F.ceil(F.greatest(F.col("rows_") / most, F.col("heavy_"))))
    sizes = sizes.select(key, cuts.cast("int").alias("cuts_"))
    m = df.join(loosened(sizes, key), key)
    m = m.withColumn("own", F.pmod(F.xxhash64(by), F.col("cuts_")).cast("int"))
    m = m.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("cuts_") - 1)))
    m = m.withColumn("p", F.least("own", "other_")).withColumn("q", F.greatest("own", "other_"))
    m = m.select(key, "p", "q", "own", *[c for c in df.columns if c != key])
    return m.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", by)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal first ``keys`` columns (whole numbers), as tables."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if name != (here := tuple(k[s].tolist())):
                if held:
                    yield name, pa.Table.from_batches(held)
                held, name = [], here
            held.append(batch.slice(s, e - s))
    if held:
        yield name, pa.Table.from_batches(held)


def vectors_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays over its own buffers, without a Python object per number."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        cuts, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def loosened(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt evenly, but not by the aggregation key ``key`` itself.

    A join on that key then shuffles both sides, so that Spark can split the other side's skewed
    partitions; joined as it stands, it would hold all rows of a frequent key to one task.
    """
    return df.repartition(F.xxhash64(key, F.lit(1)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``; a component's name is its least node.

    Alternates large-star and small-star rewriting, which halves path lengths, until the edge set
    is unchanged.  Every round is a shuffle over the edges and is written to the shared folder, where it
    replaces the round before; only a count and a checksum come back to the driver.  Self-loops and
    repeated edges are ignored.
    """
    e = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def mark(x: DataFrame):
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours join the least node of the neighbourhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (
            both.where("v > u").join(loosened(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        # small star: smaller neighbours and the node itself join the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(loosened(low, "u"), "u")
            .select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e, old = written(small), e
        discard(old)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.select(F.col("u").alias("node"), "component").union(roots)


__all__ = ["DataFrame", "F", "SparkSession", "Window", "blocked", "components", "discard", "hash_sample", "loosened", "runs", "shared_dir", "table", "vectors_of", "written"]
