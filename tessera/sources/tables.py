"""Tables, their dimensions and candidate join keys; Parquet, CSV and layout sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
# The columns that serve as dimensions, and the candidate join keys.
DIMS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"],
}
CANDIDATES = {
    "nation": ["n_nationkey", "n_regionkey"],
    "region": ["r_regionkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_partkey", "l_orderkey", "l_suppkey"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
}
DATES = {"o_orderdate", "l_shipdate"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all relational tables."""
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def is_dimension(kind: str) -> bool:
    return kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp"))


def axis(name: str) -> Column:
    """A dimension as a number: dates as days since 1970."""
    return F.unix_date(F.col(name).cast("date")).cast("double") if name in DATES else F.col(name).cast("double")


def axes(df: DataFrame, table: str, *keep: str) -> DataFrame:
    """Only the dimensions of a table, as numbers."""
    return df.select(*(F.col(k) for k in keep), *(axis(d).alias(d) for d in DIMS[table]))


def sample_rate(rows: list[int], most: int, small: int) -> float:
    large = [n for n in rows if n > small]
    return min(1.0, most / max(large)) if large else 1.0


def sampled(df: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    return df if rate >= 1 else df.sample(False, rate, seed)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_layout(df: DataFrame, block: Column, path: str) -> None:
    """One folder for each block; rows of a block meet in few files. Large blocks are split by rebalancing."""
    df.withColumn("block_id", block).hint("rebalance", "block_id").write.partitionBy("block_id").mode("overwrite").parquet(path)


def read_layout(spark: SparkSession, path: str, blocks: list[int] | None = None) -> DataFrame:
    """Rows of the chosen blocks: the choice becomes a partition filter, so other folders aren't opened."""
    df = spark.read.parquet(path)
    return df if blocks is None else df.where(F.col("block_id").isin(blocks))


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> None:
    """Replica for joins on key: two tables with equal buckets join without an exchange."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
