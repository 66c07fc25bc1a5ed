"""Which join keys each table is laid out by, and the cost report of the three ways to choose."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.operators import joins, trees
from tessera.plans import order, workload
from tessera.sources.tables import CANDIDATES, DIMS, axes, load, write_csv


def candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c, i) for t, cs in CANDIDATES.items() for i, c in enumerate(cs)], "table_name string, col string, ord int")


def first_used(edges: DataFrame) -> DataFrame:
    """table_name, col: the first column a table is joined on, if it is a candidate."""
    spark = edges.sparkSession
    one = lambda s, k: edges.select("query_id", "ord", F.lit(k).alias("side"), F.col(f"{s}_table").alias("table_name"), F.col(f"{s}_col").alias("col"))
    first = one("left", 0).unionByName(one("right", 1)).groupBy("table_name").agg(F.min_by("col", F.struct("query_id", "ord", "side")).alias("col"))
    return first.join(candidates(spark), ["table_name", "col"], "left_semi")


def ranked_keys(edges: DataFrame, rows: DataFrame, replication: int) -> DataFrame:
    """table_name, col, score, place: candidate keys by frequency times partner rows, `replication` for a table."""
    spark = edges.sparkSession
    one = lambda a, b: edges.select(F.col(f"{a}_table").alias("table_name"), F.col(f"{a}_col").alias("col"), F.col(f"{b}_table").alias("partner"))
    each = one("left", "right").unionByName(one("right", "left")).join(rows.withColumnRenamed("table_name", "partner"), "partner")
    score = each.groupBy("table_name", "col").agg(F.sum("n_rows").alias("score")).join(candidates(spark), ["table_name", "col"], "left_semi")
    return score.withColumn("place", F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("score"), "col")).cast("long")).where(F.col("place") <= replication)


class Evaluation:
    """Block layouts of all tables under one strategy, and what the workload reads with them."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT, block_share: int = 32):
        self.spark, self.settings = spark, settings
        self.used = sorted({t for tables, _ in workload.WORKLOAD.values() for t in tables})
        self.frames = {t: axes(load(spark, sf_dir, t), t) for t in self.used}
        self.roots = {t: trees.root(self.frames[t], DIMS[t]) for t in self.used}
        self.rows = {t: self.roots[t].nodes[1].size for t in self.used}
        self.own = workload.as_boxes(workload.filtered_ranges(spark, sf_dir))
        self.domains = {t: self.roots[t].nodes[1].box for t in self.used}
        self.propagated = workload.propagate(self.own, self.domains)
        self.block = {t: max(1, self.rows[t] // block_share) for t in self.used}
        self._trees: dict = {}
        self.build_s: dict = {}
        self.table_costs: dict[tuple[str, str], list[int]] = {}
        self.used_trees: set[tuple] = set()

    def prepare(self, wanted: set[tuple[str, str | None]]) -> None:
        """Build trees side by side: their jobs are small, so several fit the cluster at once."""
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(lambda x: self.tree(*x), sorted(wanted - set(self._trees), key=str)))

    def tree(self, table: str, key: str | None) -> trees.Tree:
        """Query-driven (no key), or medians of the key above query-driven cuts."""
        if (table, key) not in self._trees:
            boxes = self.own if key is None else self.propagated
            queries = [b[table] for b in boxes.values() if b.get(table)]
            df, b, began = self.frames[table], self.block[table], time.time()
            if key is None:
                made = trees.query_tree(df, DIMS[table], queries, b)
            else:
                made = trees.pac_tree(df, key, DIMS[table], queries, b, trees.join_tree_depth(self.settings.machines))
            self._trees[table, key], self.build_s[table, key] = made, time.time() - began
        return self._trees[table, key]

    def report(self, model: str, selected: dict[str, list[str]], propagated: bool, mst: bool, affinity: bool) -> list[tuple]:
        """(model, query, reading cost of blocks, chain cost, co-partitioned joins, shuffled joins)."""
        out, boxes = [], self.propagated if propagated else self.own
        pick = lambda t, c: None if not propagated else c if c in selected.get(t, []) else (selected.get(t) or CANDIDATES[t])[0]
        pairs = {(t, pick(t, c)) for _, es in workload.WORKLOAD.values() for a, ca, b, cb in es for t, c in ((a, ca), (b, cb))}
        self.prepare(pairs | {(t, None) for tables, es in workload.WORKLOAD.values() if not es for t in tables})
        self.used_trees = self.used_trees | {(model, *x) for x in pairs}

        def charge(a, b, kind, cost):
            for t in (a, b):
                own = self.table_costs.setdefault((model, t), [0, 0, 0])
                own[kind] += 1
                own[2] += cost // 2

        for q, (tables, es) in workload.WORKLOAD.items():
            box = {t: boxes.get(q, {}).get(t, {}) for t in tables}
            if not es:
                out.append((model, q, sum(n.size for t in tables for n in self.tree(t, None).touched(box[t])), 0, 0, 0))
                continue
            touched = lambda t, c: self.tree(t, pick(t, c)).touched(box[t])
            if mst:
                blocks: dict = {}
                for a, ca, b, cb in es:
                    blocks.setdefault(a, {})[ca] = len(touched(a, ca))
                    blocks.setdefault(b, {})[cb] = len(touched(b, cb))
                path = order.spanning(blocks, es, selected)[1]
            else:
                path = order.syntactic([(a, b) for a, _, b, _ in es])
            cols = {(a, b): (ca, cb) for a, ca, b, cb in es} | {(b, a): (cb, ca) for a, ca, b, cb in es}
            read = chain = hyper = shuffled = 0
            held = None
            for a, b, label in path:
                ca, cb = cols[a, b]
                x, y = touched(a, ca), touched(b, cb)
                if label == 1 or held is None:
                    real = propagated and ca in selected.get(a, []) and cb in selected.get(b, [])
                    meets = {n.nid: frozenset(m.nid for m in y if n.box[ca][0] <= m.box[cb][1] and m.box[cb][0] <= n.box[ca][1]) for n in x}
                    meets = {k: v for k, v in meets.items() if v}
                    sizes, others = {n.nid: n.size for n in x}, {m.nid: m.size for m in y}
                    if real:
                        groups = (joins.group_affinity if affinity else joins.group_greedy)(meets, self.settings.group_blocks)
                        cost = sum(sum(sizes[i] for i in g) + sum(others[j] for j in frozenset().union(*(meets[i] for i in g))) for g in groups)
                        hyper += 1
                    else:
                        cost = self.settings.shuffle_weight * (sum(sizes[i] for i in meets) + sum(others[j] for j in frozenset().union(*meets.values()))) if meets else 0
                        shuffled += 1
                    read += cost
                    charge(a, b, int(real), cost)
                    held = min(sum(sizes.values()), sum(others.values()))
                else:
                    cost = joins.step_cost(sum(m.size for m in y), held)
                    chain += cost
                    charge(a, b, 0, cost)
                    held = min(held, sum(m.size for m in y))
                    shuffled += 1
            out.append((model, q, read, chain, hyper, shuffled))
        return out

    def compare(self) -> DataFrame:
        """The three strategies side by side, by query."""
        es = workload.edges(self.spark)
        sizes = self.spark.createDataFrame(list(self.rows.items()), "table_name string, n_rows long")
        keys: dict[str, dict[str, list[str]]] = {"first": {}, "ranked": {}}
        for r in first_used(es).collect():
            keys["first"].setdefault(r.table_name, []).append(r.col)
        for r in ranked_keys(es, sizes, self.settings.replication).orderBy("place").collect():
            keys["ranked"].setdefault(r.table_name, []).append(r.col)
        self.table_costs.clear()
        self.used_trees = set()
        rows = self.report("paw", {}, False, False, False) + self.report("ad_mto", keys["first"], True, False, False) + self.report("pac", keys["ranked"], True, True, True)
        return self.spark.createDataFrame(rows, "model string, query_id long, read_rows long, chain_rows long, hyper_joins long, shuffle_joins long")

    def tables(self) -> DataFrame:
        """By table, after compare(): joins of both kinds and half the cost of each, and the tables' average as `avg`."""
        rows = [(m, t, *map(float, v)) for (m, t), v in sorted(self.table_costs.items())]
        for m in dict.fromkeys(r[0] for r in rows):
            own = [r for r in rows if r[0] == m and r[1] != "avg"]
            rows.append((m, "avg", *(sum(r[i] for r in own) / len(own) for i in (2, 3, 4))))
        return self.spark.createDataFrame(rows, "model string, table_name string, shuffle_times double, hyper_times double, join_cost double")

    def times(self) -> DataFrame:
        """Seconds to build the trees that each strategy uses, after compare()."""
        rows = [(m, sum(self.build_s[t, k] for x, t, k in self.used_trees if x == m)) for m in ("paw", "ad_mto", "pac")]
        return self.spark.createDataFrame(rows, "model string, build_s double")

    def save(self, path: str) -> None:
        """The whole report as CSV: costs by query and by table, and times."""
        for name, df in (("query_cost", self.compare()), ("table_cost", self.tables()), ("time_cost", self.times())):
            write_csv(df.coalesce(1), f"{path}/{name}")


def sweep(spark: SparkSession, sf_dir: str, shares: list[int], replications: list[int], skip: tuple[int, ...] = ()) -> DataFrame:
    """Average rows per query of each strategy, for several numbers of blocks a table and of replicas; queries to skip are
    left out of the average."""
    parts = []
    for share in shares:
        one = Evaluation(spark, sf_dir, DEFAULT, share)
        for k in replications:
            one.settings = replace(DEFAULT, replication=k)
            cost = one.compare().where(~F.col("query_id").isin(list(skip)))
            parts.append(cost.groupBy("model").agg(F.avg(F.col("read_rows") + F.col("chain_rows")).alias("rows_per_query")).select(F.lit(share).alias("blocks"), F.lit(k).alias("replicas"), "model", "rows_per_query"))
    return reduce(DataFrame.unionByName, parts)


def pivot(report: DataFrame) -> DataFrame:
    return report.groupBy("query_id").pivot("model", ["paw", "ad_mto", "pac"]).agg(F.sum(F.col("read_rows") + F.col("chain_rows")))
