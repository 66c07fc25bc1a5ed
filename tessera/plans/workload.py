"""Declared workload: filters for each table and equi-join edges; its boxes, their propagation and frequencies."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import Box
from tessera.operators.profile import union
from tessera.sources.tables import DIMS, axis, load

Edge = tuple[str, str, str, str]

#: query -> ({table: filter or None}, edges (left table, column, right table, column))
WORKLOAD: dict[int, tuple[dict[str, str | None], list[Edge]]] = {
    1: ({"lineitem": "l_shipdate <= DATE '1998-09-24'"}, []),
    2: ({"customer": "c_mktsegment = 'FURNITURE'", "orders": "o_orderdate < DATE '1997-03-17'", "lineitem": "l_shipdate > DATE '1997-03-17'"}, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]),
    3: ({"region": "r_name = 'AMERICA'", "nation": None, "customer": None, "orders": None, "lineitem": None, "supplier": None}, [("region", "r_regionkey", "nation", "n_regionkey"), ("nation", "n_nationkey", "customer", "c_nationkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]),
    4: ({"lineitem": "l_discount BETWEEN 0.06 AND 0.08 AND l_quantity < 25 AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'"}, []),
    5: ({"orders": "o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'", "lineitem": None}, [("orders", "o_orderkey", "lineitem", "l_orderkey")]),
    6: ({"part": "p_size = 38", "lineitem": None}, [("part", "p_partkey", "lineitem", "l_partkey")]),
    7: ({"orders": "o_totalprice BETWEEN 100000 AND 200000", "customer": "c_acctbal BETWEEN 0 AND 2500"}, [("customer", "c_custkey", "orders", "o_custkey")]),
    8: ({"lineitem": None}, []),
}


def filtered_ranges(spark: SparkSession, sf_dir: str, declared: dict | None = None) -> DataFrame:
    """query_id, table_name, dim, lo, hi: the ranges that each query's own filters leave; one pass over each table."""
    parts = []
    for table, dims in DIMS.items():
        asks = [(q, tables[table]) for q, (tables, _) in (declared or WORKLOAD).items() if tables.get(table)]
        if not asks:
            continue
        aggs, rows = [], []
        for q, pred in asks:
            for d in dims:
                i = len(rows)
                value = F.when(F.expr(pred), axis(d))
                aggs += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
                rows.append(F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(table).alias("table_name"), F.lit(d).alias("dim"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")))
        parts.append(load(spark, sf_dir, table).agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return union(parts).where("lo is not null")


def edges(spark: SparkSession, declared: dict | None = None) -> DataFrame:
    rows = [(q, i, *e) for q, (_, es) in (declared or WORKLOAD).items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "query_id long, ord long, left_table string, left_col string, right_table string, right_col string")


def dedup_edges(df: DataFrame) -> DataFrame:
    """Without loops, and each pair of tables once for a query: its first edge."""
    pair = [F.least("left_table", "right_table"), F.greatest("left_table", "right_table")]
    first = df.where("left_table <> right_table OR left_col <> right_col").groupBy("query_id", *(p.alias(f"t{i}") for i, p in enumerate(pair))).agg(F.min("ord").alias("ord"))
    return df.join(first.select("query_id", "ord"), ["query_id", "ord"], "left_semi")


def propagate(ranges: dict[int, dict[str, Box]], domains: dict[str, Box]) -> dict[int, dict[str, Box]]:
    """Boxes with every class of joined columns cut down to its common range; untouched dimensions are left out.

    Workload metadata: a row for each query, table and dimension, however large the tables are.
    """
    out = {}
    for q, (tables, es) in WORKLOAD.items():
        top: dict[tuple, tuple] = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for lt, lc, rt, rc in es:
            top[find((rt, rc))] = find((lt, lc))
        boxes = {t: dict(ranges.get(q, {}).get(t, {})) for t in tables}
        classes: dict[tuple, list[tuple]] = {}
        for x in list(top):
            classes.setdefault(find(x), []).append(x)
        for members in classes.values():
            have = [boxes.setdefault(t, {})[c] for t, c in members if c in boxes.get(t, {})]
            if have:
                common = max(lo for lo, _ in have), min(hi for _, hi in have)
                for t, c in members:
                    boxes[t][c] = common
        out[q] = {t: {d: r for d, r in b.items() if r != domains[t][d]} for t, b in boxes.items()}
    return out


def as_boxes(df: DataFrame) -> dict[int, dict[str, Box]]:
    out: dict[int, dict[str, Box]] = {}
    for r in df.collect():
        out.setdefault(r.query_id, {}).setdefault(r.table_name, {})[r.dim] = (r.lo, r.hi)
    return out


def as_rows(spark: SparkSession, boxes: dict[int, dict[str, Box]]) -> DataFrame:
    rows = [(q, t, d, float(lo), float(hi)) for q, ts in boxes.items() for t, b in ts.items() for d, (lo, hi) in b.items()]
    return spark.createDataFrame(rows, "query_id long, table_name string, dim string, lo double, hi double")


def key_use(df: DataFrame) -> DataFrame:
    """table_name, col, n: how often each column is joined on."""
    both = df.select(F.col("left_table").alias("table_name"), F.col("left_col").alias("col")).unionByName(df.select(F.col("right_table").alias("table_name"), F.col("right_col").alias("col")))
    return both.groupBy("table_name", "col").agg(F.count("*").alias("n"))


def key_pairs(df: DataFrame) -> DataFrame:
    """key1, key2, n: both directions of every joined pair of columns."""
    a, b = F.concat_ws(".", "left_table", "left_col"), F.concat_ws(".", "right_table", "right_col")
    both = df.select(a.alias("key1"), b.alias("key2")).unionByName(df.select(b.alias("key1"), a.alias("key2")))
    return both.groupBy("key1", "key2").agg(F.count("*").alias("n"))


def variant(name: str, es: list[Edge], seed: int = 7) -> list[Edge]:
    """Edge order of a workload variant: only mto shuffles."""
    es = list(es)
    if name == "mto":
        random.Random(seed).shuffle(es)
    return es


def save(spark: SparkSession, path: str, profile: DataFrame, ranges: DataFrame, joins: DataFrame) -> None:
    """A workload's metadata as three Parquet tables: column profiles, query ranges and join edges."""
    for name, df in (("profile", profile), ("ranges", ranges), ("edges", joins)):
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("profile", "ranges", "edges"))
