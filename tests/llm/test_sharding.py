import itertools
import zlib

import pytest

from taproot.llm import sharding
from taproot.llm.common import F


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, [f"x{k}" for k in range(n)])
    got = df.withColumn("h", sharding.hilbert([F.col(f"x{k}") for k in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(p[:n], q[:n], strict=True)) == 1 for p, q in zip(got, got[1:], strict=False))


def rows(n):
    out = [(i, ("x" * (i * 37 % 900)) + "é", ["en", "fr", None][i % 3], f"s{i % 5 if i % 3 else 0}", 1, "a") for i in range(n)]
    return [*out, (n, None, "en", None, 1, "a"), (n + 1, "", None, "s0", 1, "a"), (n + 2, "word " * 50000, "en", "s0", 1, "a")]


SCHEMA = "doc_id long, text string, lang string, source string, size int, shard string"


@pytest.mark.parametrize("n", [0, 5, 403])
def test_rows_law(spark, n):
    data = rows(n)
    got = sharding.hilbert_shards(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == sorted(x[0] for x in data)
    counts = [0] * 8
    for r in got:
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    texts = {x[0]: (x[1] or "").encode() for x in data}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in got)


def test_order_follows_curve_and_brute_force(spark):
    data = rows(200)
    df = spark.createDataFrame(data, SCHEMA)
    codes = df.select("doc_id", sharding.hilbert([sharding.by_size(F.octet_length(F.coalesce("text", F.lit(""))) + 1, 5), sharding.by_value(F.col("lang"), 5), sharding.by_value(F.col("source"), 5)], 5).alias("h"), F.xxhash64("doc_id").alias("t"))
    want = [r.doc_id for r in sorted(codes.collect(), key=lambda r: (r.h, r.t))]
    got = [r.doc_id for r in sorted(sharding.hilbert_shards(df).collect(), key=lambda r: (r.shard, r.slot))]
    assert got == want


def test_repeats_and_empty(spark):
    same = spark.createDataFrame([(7, "t", "en", "s", 1, "a")] * 21 + [(None, "t", "en", "s", 1, "a")] * 2, SCHEMA)
    got = sharding.hilbert_shards(same).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [2, 3, 3, 3, 3, 3, 3, 3]
    assert sharding.hilbert_shards(same.limit(0)).count() == 0


def test_files_prune(spark, tmp_path):
    df = spark.createDataFrame(rows(100), SCHEMA).drop("shard", "size")
    sharding.write_shards(df, sharding.hilbert_shards(df), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 103 and set(back.columns) == {"doc_id", "text", "lang", "source", "shard"}


def test_repeated_ids_do_not_depend_on_the_read(spark):
    df = spark.createDataFrame([(5, f"text {i:03d}", "en", "s", 1, "a") for i in range(200)], SCHEMA)
    at = lambda d: {r.text_crc32: (r.shard, r.slot) for r in sharding.hilbert_shards(d).collect()}
    assert at(df.repartition(3)) == at(df.orderBy(F.desc("text")).repartition(5))
