"""Forests derived from the shared tables, as text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS = """
SELECT o_custkey AS arbor_id, rn AS nid,
       CASE WHEN rn = 1 THEN NULL ELSE CAST(floor(rn / 2.0) AS BIGINT) END AS pid,
       CAST(floor(o_totalprice / 1000) AS DOUBLE) AS x,
       CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS DOUBLE) AS y,
       CAST(o_custkey % 7 AS DOUBLE) AS z
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders) AS ranked
"""
EVENTS = """
SELECT user_id AS arbor_id, rn AS nid,
       CASE WHEN rn = 0 THEN NULL WHEN rn % 9 = 0 THEN CAST(floor(rn / 2.0) AS BIGINT) ELSE rn - 1 END AS pid,
       CAST(10 * rn AS DOUBLE) AS x, CAST(floor(value / 10) AS DOUBLE) AS y,
       CAST(user_id % 7 AS DOUBLE) AS z
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS rn FROM events) AS ranked
"""


def forest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``orders``: bushy trees of depth about 4; ``events``: long segments, depth about 23."""
    table, text = {"orders": ("orders", ORDERS), "events": ("events", EVENTS)}[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.replace(f"FROM {table})", "FROM {source})"), source=source)
