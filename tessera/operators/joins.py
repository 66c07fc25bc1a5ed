"""Block joins: first-match joins, overlap graphs of blocks, their grouping, and the cost of both kinds of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT


def first_match(small: DataFrame, large: DataFrame, small_key: str, large_key: str) -> DataFrame:
    """Inner join in which a key of the larger side counts once: its first row in the order of all columns."""
    first = large.groupBy(F.col(large_key).alias("__key")).agg(F.min(F.struct(*large.columns)).alias("__row"))
    return small.join(first, small[small_key] == first["__key"]).select(*(small[c] for c in small.columns), *(F.col(f"__row.{c}").alias(c) for c in large.columns))


def overlap_graph(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_leaf, a_n, b_leaf, b_n of leaves (leaf, n, lo, hi) whose closed ranges meet. Leaves are tree metadata."""
    x, y = a.alias("x"), b.alias("y")
    on = (F.col("x.lo") <= F.col("y.hi")) & (F.col("y.lo") <= F.col("x.hi"))
    return x.join(F.broadcast(y), on).select(F.col("x.leaf").alias("a_leaf"), F.col("x.n").alias("a_n"), F.col("y.leaf").alias("b_leaf"), F.col("y.n").alias("b_n"))


def affinity(overlap: DataFrame) -> DataFrame:
    """a1, a2, shared: blocks that two blocks of the first side have in common."""
    x, y = overlap.select(F.col("a_leaf").alias("a1"), "b_leaf"), overlap.select(F.col("a_leaf").alias("a2"), "b_leaf")
    return x.join(y, "b_leaf").where("a1 < a2").groupBy("a1", "a2").agg(F.count("*").alias("shared"))


def group_greedy(chunks: dict[int, frozenset], size: int = DEFAULT.group_blocks) -> list[list[int]]:
    """Groups of `size` blocks; the next block is always the one that shares most with its group (ties: the first)."""
    left, out = sorted(chunks), []
    while left:
        group, seen = [], set()
        while left and len(group) < size:
            pick = max(left, key=lambda a: (len(chunks[a] & seen), -a))
            left.remove(pick)
            group.append(pick)
            seen |= chunks[pick]
        out.append(group)
    return out


def group_affinity(chunks: dict[int, frozenset], size: int = DEFAULT.group_blocks) -> list[list[int]]:
    """Blocks that share nothing fill groups in order; the others merge, closest pair first, while a pair fits."""
    ids = sorted(chunks)
    alone = [a for a in ids if not any(chunks[a] & chunks[b] for b in ids if b != a)]
    out = [alone[i : i + size] for i in range(0, len(alone), size)]
    live = {a: ([a], chunks[a]) for a in ids if a not in set(alone)}
    while True:
        best = None
        keys = sorted(live)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if len(live[a][0]) + len(live[b][0]) <= size:
                    rank = (len(live[a][1] & live[b][1]), max(len(live[a][0]), len(live[b][0])))
                    if rank[0] and (best is None or rank > best[0]):
                        best = rank, a, b
        if best is None:
            return out + [g for g, _ in live.values()]
        _, a, b = best
        g, c = live.pop(b)
        live[a] = (live[a][0] + g, live[a][1] | c)


def hyper_cost(overlap: DataFrame, groups: DataFrame) -> DataFrame:
    """a_rows, b_rows, cost: every group reads its own blocks and each different partner block once."""
    g = overlap.join(F.broadcast(groups), "a_leaf")
    a = g.select("grp", "a_leaf", "a_n").distinct().agg(F.sum("a_n").alias("a_rows"))
    b = g.select("grp", "b_leaf", "b_n").distinct().agg(F.sum("b_n").alias("b_rows"))
    return a.crossJoin(b).select("a_rows", "b_rows", (F.col("a_rows") + F.col("b_rows")).alias("cost"))


def shuffle_cost(overlap: DataFrame, weight: int = DEFAULT.shuffle_weight) -> DataFrame:
    a = overlap.select("a_leaf", "a_n").distinct().agg(F.sum("a_n").alias("a_rows"))
    b = overlap.select("b_leaf", "b_n").distinct().agg(F.sum("b_n").alias("b_rows"))
    return a.crossJoin(b).select("a_rows", "b_rows", (weight * (F.col("a_rows") + F.col("b_rows"))).alias("cost"))


def step_cost(right_rows: int, rows: int, rate: float = 1.0, weight: int = DEFAULT.shuffle_weight) -> int:
    return int((weight * right_rows + rows) / rate)


def chain(first: DataFrame, steps: list[tuple[DataFrame, str, str]], rows: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """First-match joins one after another, and for each step (rows so far, rows of the next table, cost).

    steps: (table, column of what is joined so far, column of the table). A step whose key is there already is left out.
    One count for each table and step; what a step yields is counted, not held.
    """
    out, costs = first, []
    held = first.count() if rows is None else rows
    for table, left, right in steps:
        if right in out.columns:
            continue
        n = table.count()
        costs.append((held, n, step_cost(n, held)))
        out = first_match(out, table, left, right) if held <= n else first_match(table, out, right, left)
        held = out.count()
    return out, costs


def main_table_rows(blocks: dict[int, int], asked: list[set[int]]) -> int:
    """Rows that hyper joins read of the main table: the blocks of each query, whatever their partners."""
    return sum(blocks[i] for ids in asked for i in ids)


def side_report(tree, queries: list, key: str, depth: int) -> list[tuple[int, int, int, float]]:
    """For each query: top-layer nodes that it touches, blocks, rows, and how long the nodes' key ranges are together."""
    out = []
    for box in queries:
        tops = [n for n in tree.layer(depth) if all(lo <= n.box[d][1] and n.box[d][0] <= hi for d, (lo, hi) in box.items())]
        leaves = tree.touched(box)
        out.append((len(tops), len(leaves), sum(n.size for n in leaves), float(sum(n.box[key][1] - n.box[key][0] for n in tops))))
    return out


def smaller_left(a: tuple[str, str, int], b: tuple[str, str, int]) -> tuple[tuple[str, str, int], tuple[str, str, int]]:
    """Two sides (table, column, blocks) with the one of fewer blocks first; equals stay."""
    return (b, a) if a[2] > b[2] else (a, b)


def static_cost(left_rows: int, right_rows: int, hyper: bool, weight: int = DEFAULT.shuffle_weight) -> int:
    """What a join is expected to read: both sides once if co-partitioned, else the right one also through a shuffle."""
    return left_rows + right_rows if hyper else left_rows + weight * right_rows
