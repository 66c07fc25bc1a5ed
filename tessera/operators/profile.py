"""Profiles and cleaning: one pass over a table for all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import axis, is_dimension


def _long(df: DataFrame, names: list[str], *values: str) -> DataFrame:
    """One row for each name, from columns `<value>_<position>` of a one-row table."""
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), *(F.col(f"{v}_{i}").alias(v) for v in values)) for i, n in enumerate(names)))
    return df.select(F.explode(rows).alias("r")).select("r.*")


def min_max(df: DataFrame, dims: list[str], table: str) -> DataFrame:
    """table_name, column_name, lo, hi of each dimension that isn't all null."""
    stats = df.agg(*(f(axis(d)).alias(f"{n}_{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))))
    return _long(stats, dims, "lo", "hi").filter("lo is not null").select(F.lit(table).alias("table_name"), "column_name", "lo", "hi")


def widths(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """table_name, column_name, width: the longest text of each column, 0 if there is none."""
    stats = df.agg(*(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).cast("long").alias(f"width_{i}") for i, c in enumerate(columns)))
    return _long(stats, columns, "width").select(F.lit(table).alias("table_name"), "column_name", "width")


def row_count(df: DataFrame, table: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("table_name"), "n_rows")


def kinds(df: DataFrame, table: str) -> list[tuple[str, str, str]]:
    return [(table, c, "dimension" if is_dimension(k) else "text") for c, k in df.dtypes]


def null_census(df: DataFrame, table: str) -> DataFrame:
    stats = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_nulls_{i}") for i, c in enumerate(df.columns)))
    return _long(stats, df.columns, "n_nulls").select(F.lit(table).alias("table_name"), "column_name", "n_nulls")


def drop_nulls(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.na.drop(subset=dims)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
