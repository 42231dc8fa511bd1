"""Sharding along a Hilbert curve, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from taproot.llm.common import F, written


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """The curve of ``n`` dimensions as a machine: for state and orthant, the rank and the next state.

    A state is an entry corner ``e`` and a direction ``d``.  Each level undoes their reflection and
    rotation, reads the orthant's rank off the Gray code, and turns to the sub-cube of that rank.
    """
    full = (1 << n) - 1
    rotate = lambda x, k: (x << k % n | x >> (n - k % n)) & full
    gray = lambda x: x ^ x >> 1
    rank_of = {gray(w): w for w in range(1 << n)}
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    ranks, states = [], []
    for e in range(1 << n):
        for d in range(n):
            for orthant in range(1 << n):
                w = rank_of[rotate(orthant ^ e, n - (d + 1) % n)]
                entry = gray((w - 1) // 2 * 2) if w else 0
                turn = 0 if not w else ones(w if w % 2 else w - 1) % n
                ranks.append(w)
                states.append((e ^ rotate(entry, d + 1)) * n + (d + turn + 1) % n)
    return ranks, states


def hilbert(codes: list[Column], bits: int) -> Column:
    """The curve index of whole numbers below ``2**bits``, one per dimension."""
    n = len(codes)
    ranks, states = (F.array(*[F.lit(v) for v in t]) for t in curve_tables(n))
    levels = F.array(*[
        sum(F.shiftright(c.cast("int"), i).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(codes)) for i in range(bits - 1, -1, -1)
    ])

    def step(at: Column, orthant: Column) -> Column:
        k = at["state"] * (1 << n) + orthant
        return F.struct((at["h"] * (1 << n) + F.get(ranks, k)).alias("h"), F.get(states, k).alias("state"))

    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("state"))
    return F.aggregate(levels, start, step, lambda at: at["h"])


def by_size(c: Column, bits: int, per_doubling: float = 2.0) -> Column:
    """Quantises a size on a logarithmic scale; null and less than one are the first step."""
    step = F.floor(F.log2(F.greatest(F.coalesce(c.cast("double"), F.lit(1.0)), F.lit(1.0))) * per_doubling)
    return F.least(step, F.lit((1 << bits) - 1)).cast("int")


def by_value(c: Column, bits: int) -> Column:
    """Quantises a category by its hash, so that equal values stay together; null is one value."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("int")


def placed(rows: DataFrame, curve: Column, key: str, shards: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``h, shard, slot``: sorted by curve index and cut into runs of equal counts.

    Rows of one index are ordered by a hash of ``key``, ``key`` itself and ``ties``, so that a cell with a
    third of all rows is split by the range partitioner as any other, and places do not depend on the read.  The sorted rows are written
    with their partition's number; positions are the partition's offset plus the rank inside it.
    Only a count per partition is gathered.  Shard counts differ by one at most.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = rows.withColumn("h", curve).withColumn("tie_", F.xxhash64(F.col(key)))
    order = [F.col("h"), F.col("tie_"), F.col(key), *[F.col(c) for c in ties]]
    ranged = keyed.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id())
    fixed = written(ranged)
    sizes = fixed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"), F.sum("n_").over(Window.partitionBy()).alias("all_"))
    rank = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    at = fixed.withColumn("rank_", rank).join(F.broadcast(offsets), "part_").withColumn("pos_", F.col("offset_") + F.col("rank_") - 1)
    shard = F.expr(f"pos_ * {shards} div all_")
    at = at.withColumn("shard", shard.cast("int"))
    slot = F.col("pos_") - F.expr(f"(shard * all_ + {shards} - 1) div {shards}")
    return at.withColumn("slot", slot.cast("bigint")).drop("tie_", "part_", "offset_", "all_", "rank_", "pos_")


def hilbert_shards(docs: DataFrame, *, shards: int = 8, bits: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every document, under law ``rows``.

    The curve runs over text size, language and source.  ``size`` is the text's UTF-8 bytes plus one,
    a null text has none.  ``slot`` counts from 0 without gaps in each shard.  Null languages, sources
    and ids are values like others.  Rows that repeat an id are ordered by size, text_crc32 and a digest of
    the text; wholly equal rows are placed one after another.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(x) + 1).cast("bigint")
    curve = hilbert([by_size(F.col("size"), bits), by_value(F.col("lang_"), bits), by_value(F.col("source_"), bits)], bits)
    rows = docs.select(key, size.alias("size"), F.crc32(x.cast("binary")).alias("text_crc32"), F.xxhash64(x).alias("digest_"), F.col("lang").alias("lang_"), F.col("source").alias("source_"))
    out = placed(rows, curve, key, shards, ("size", "text_crc32", "digest_"))
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed_rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes ``docs`` under ``path``, a folder per shard, in curve order, so that readers can skip
    files by several columns at once.  Ids must be distinct."""
    spots = placed_rows.select(F.col(key).alias("k_"), "shard", "slot")
    full = docs.join(spots, docs[key].eqNullSafe(spots["k_"])).drop("k_")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
