"""Which blocks a range touches, and what reading them costs. Leaves and queries are small tables of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touched(leaves: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, leaf, n: leaves (leaf, n, lo, hi) that a query's closed range (query_id, q_lo, q_hi) meets."""
    on = (F.col("q_lo") <= F.col("hi")) & (F.col("lo") <= F.col("q_hi"))
    return queries.join(F.broadcast(leaves), on).select("query_id", "leaf", "n")


def scan_cost(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.sum("n").alias("cost"), F.count("*").alias("blocks"))


def scan_ratio(hits: DataFrame, rows: DataFrame, n_queries: int) -> DataFrame:
    return hits.agg(F.sum("n").alias("read")).crossJoin(F.broadcast(rows)).select(F.round(F.col("read") / F.col("n_rows") / n_queries, 9).alias("ratio"))
