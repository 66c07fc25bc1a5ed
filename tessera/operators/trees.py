"""Partition trees, built level by level. The tree is small and stays on the driver; rows get their leaf by a CASE
expression, so routing needs no join and no shuffle. Leaf ids are heap ids: root 1, children 2p and 2p + 1; a row at
the split value goes right, and both children's boxes hold the value."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions.boxes import Box, inside, merge_open


@dataclass
class Node:
    nid: int
    box: Box
    size: int
    depth: int = 0
    dim: str | None = None
    value: float | None = None
    irregular: bool = False
    #: Boxes within an irregular leaf and their rows; the rest of its rows is a block of its own.
    parts: list[tuple[Box, int]] = field(default_factory=list)

    @property
    def rest(self) -> int:
        return self.size - sum(n for _, n in self.parts)


#: A leaf's id times PARTS, plus the number of a box in it (from 1; 0 is the rest), names a block.
PARTS = 64


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=dict)
    join_depth: int = 0

    @property
    def leaves(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.dim is None]

    @property
    def depth(self) -> int:
        return max(n.depth for n in self.nodes.values())

    def leaf(self, nid: int = 1) -> Column:
        """The leaf of a row, as one expression over its dimensions."""
        n = self.nodes[nid]
        if n.dim is None:
            return F.lit(nid).cast("long")
        return F.when(F.col(n.dim) < n.value, self.leaf(2 * nid)).otherwise(self.leaf(2 * nid + 1))

    def split(self, nid: int, dim: str, value: float, left: int) -> None:
        n = self.nodes[nid]
        n.dim, n.value = dim, value
        lo, hi = n.box[dim]
        self.nodes[2 * nid] = Node(2 * nid, n.box | {dim: (lo, value)}, left, n.depth + 1)
        self.nodes[2 * nid + 1] = Node(2 * nid + 1, n.box | {dim: (value, hi)}, n.size - left, n.depth + 1)

    def layer(self, depth: int) -> list[Node]:
        """Nodes at a depth, and leaves above it."""
        return [n for n in self.nodes.values() if n.depth == depth or n.dim is None and n.depth < depth]

    def touched(self, box: Box) -> list[Node]:
        """Leaves that a box touches, by descent."""
        out, todo = [], [1]
        while todo:
            n = self.nodes[todo.pop()]
            if all(lo <= n.box[d][1] and n.box[d][0] <= hi for d, (lo, hi) in box.items()):
                if n.dim is None:
                    out.append(n)
                else:
                    todo += [2 * n.nid + 1, 2 * n.nid]
        return out

    def block(self) -> Column:
        """The block of a row: its leaf, and in an irregular leaf the box that it lies in, or the rest."""
        out = self.leaf() * PARTS
        for n in self.leaves:
            for i, (box, _) in enumerate(n.parts):
                out = F.when((self.leaf() == n.nid) & inside(box), n.nid * PARTS + i + 1).otherwise(out)
        return out

    def blocks(self) -> dict[int, int]:
        """Rows of each block that has any."""
        out = {}
        for n in self.leaves:
            out |= {n.nid * PARTS: n.rest} | {n.nid * PARTS + i + 1: size for i, (_, size) in enumerate(n.parts)}
        return {k: v for k, v in out.items() if v}

    def read(self, box: Box) -> int:
        """Rows of the blocks that a box touches. The rest of an irregular leaf is spared if a box in it holds the query."""
        total = 0
        for n in self.touched(box):
            own = {d: (max(lo, n.box[d][0]), min(hi, n.box[d][1])) for d, (lo, hi) in box.items()}
            total += sum(size for part, size in n.parts if all(own[d][0] <= part[d][1] and part[d][0] <= own[d][1] for d in own))
            held = any(all(d in own and part[d][0] <= own[d][0] and own[d][1] <= part[d][1] for d in part if part[d] != n.box[d]) for part, _ in n.parts)
            total += 0 if held else n.rest
        return total

    def table(self, spark: SparkSession, tree_id: str = "t") -> DataFrame:
        """tree_id, nid, pid, depth, is_leaf, node_size, split dim and value, bounds: also the form in which trees are saved."""
        bounds = lambda box: [(d, float(lo), float(hi)) for d, (lo, hi) in box.items()]
        rows = [
            (tree_id, n.nid, n.nid // 2 or -1, n.depth, n.dim is None, n.size, n.dim, n.value, bounds(n.box), n.irregular, self.join_depth, [(bounds(box), size) for box, size in n.parts])
            for n in self.nodes.values()
        ]
        box = "array<struct<dim:string,lo:double,hi:double>>"
        kinds = "tree_id string, nid long, pid long, depth int, is_leaf boolean, node_size long, dim string, value double"
        return spark.createDataFrame(rows, f"{kinds}, bounds {box}, irregular boolean, join_depth int, parts array<struct<bounds:{box},size:long>>")

    @staticmethod
    def load(table: DataFrame) -> Tree:
        box = lambda bounds: {b.dim: (b.lo, b.hi) for b in bounds}
        rows = table.collect()  # nodes of one tree
        nodes = {r.nid: Node(r.nid, box(r.bounds), r.node_size, r.depth, r.dim, r.value, r.irregular, [(box(p.bounds), p.size) for p in r.parts]) for r in rows}
        return Tree(nodes, rows[0].join_depth if rows else 0)

    def leaf_table(self, spark: SparkSession, dims: list[str]) -> DataFrame:
        """leaf, n, and lo_/hi_ of each dimension."""
        kinds = "leaf long, n long" + "".join(f", lo_{d} double, hi_{d} double" for d in dims)
        return spark.createDataFrame([(n.nid, n.size, *(float(x) for d in dims for x in n.box[d])) for n in self.leaves], kinds)


def root(df: DataFrame, dims: list[str]) -> Tree:
    r = df.agg(F.count("*").alias("n"), *(f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max)))).first()
    return Tree({1: Node(1, {d: (float(r[f"lo_{d}"] or 0), float(r[f"hi_{d}"] or 0)) for d in dims}, r.n)})


def medians_of(df: DataFrame, group: str, keys: list[str], sizes: dict, bound: int = DEFAULT.median_rows) -> dict[str, dict]:
    """Exact medians of several keys in each group, whose rows are known: one job if no group has over `bound` rows."""
    if max(sizes.values(), default=0) > bound:
        return {k: exact_medians(df.select(group, k), group, k, bound) for k in keys}
    rows = df.groupBy(group).agg(*(F.percentile(k, 0.5).alias(f"m{i}") for i, k in enumerate(keys))).collect()
    return {k: {r[group]: r[f"m{i}"] for r in rows if r[f"m{i}"] is not None} for i, k in enumerate(keys)}


def exact_medians(df: DataFrame, group: str, key: str, bound: int = DEFAULT.median_rows) -> dict:
    """Exact median of key in each group. Groups are few; a group of over `bound` rows is first narrowed around its
    middle by approximate quantiles and counts, so no task ever sorts or holds more than about `bound` rows of one."""
    sizes = {r[group]: r.n for r in df.groupBy(group).agg(F.count(key).alias("n")).collect()}
    if max(sizes.values(), default=0) <= bound:
        return {r[group]: r.m for r in df.groupBy(group).agg(F.percentile(key, 0.5).alias("m")).collect()}
    spark, span = df.sparkSession, {g: (None, None, 0, n) for g, n in sizes.items()}
    kinds = f"{group} {dict(df.dtypes)[group]}, lo double, hi double"
    while True:
        near = spark.createDataFrame([(g, lo, hi) for g, (lo, hi, _, _) in span.items()], kinds)
        rows = df.join(F.broadcast(near), group).where((F.col("lo").isNull() | (F.col(key) >= F.col("lo"))) & (F.col("hi").isNull() | (F.col(key) <= F.col("hi"))))
        if all(m <= bound or lo is not None and lo == hi for lo, hi, _, m in span.values()):
            break
        quantiles = []
        for g, (_, _, below, m) in span.items():
            p = ((sizes[g] - 1) / 2 - below) / max(m - 1, 1)
            quantiles.append((g, [max(0.0, p - 0.001), min(1.0, p + 0.001)]))
        approx = {r[group]: r.q for r in rows.groupBy(group).agg(F.percentile_approx(key, F.array(*(F.lit(x / 1000) for x in range(1001))), 100_000).alias("q")).collect()}
        new = {}
        for g, (a, b) in quantiles:
            q = approx[g]
            new[g] = (float(q[max(0, int(a * 1000) - 1)]), float(q[min(1000, int(b * 1000) + 2)]))
        # The middle ranks must lie within the new span; exact counts tell.
        edge = spark.createDataFrame([(g, *v) for g, v in new.items()], kinds.replace("lo", "x").replace("hi", "y"))
        count = {r[group]: r for r in df.join(F.broadcast(edge), group).groupBy(group).agg(F.count_if(F.col(key) < F.col("x")).alias("below"), F.count_if(F.col(key).between(F.col("x"), F.col("y"))).alias("m")).collect()}
        done = True
        for g, (lo, hi) in new.items():
            c, mid = count[g], (sizes[g] - 1) // 2
            if c.below <= mid and sizes[g] // 2 < c.below + c.m and c.m < span[g][3]:
                span[g], done = (lo, hi, c.below, c.m), False
        if done:
            break
    near = spark.createDataFrame([(g, lo, hi, below, sizes[g]) for g, (lo, hi, below, _) in span.items()], kinds + ", below long, n long")
    rows = df.join(F.broadcast(near), group).where((F.col("lo").isNull() | (F.col(key) >= F.col("lo"))) & (F.col("hi").isNull() | (F.col(key) <= F.col("hi"))))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1 + F.col("below"))
    middle = ranked.where((F.col("r") == F.floor((F.col("n") - 1) / 2)) | (F.col("r") == F.floor(F.col("n") / 2)))
    return {r[group]: r.m for r in middle.groupBy(group).agg(F.avg(key).alias("m")).collect()}


def median_tree(df: DataFrame, key: str, levels: int, b: int, dims: list[str] | None = None) -> Tree:
    """Split on the median of key where both halves hold b rows, for a number of levels."""
    tree = root(df, dims or [key])
    tree.join_depth = levels
    for depth in range(levels):
        open_ = [n for n in tree.leaves if n.depth == depth and n.size >= 2 * b]
        if not open_:
            break
        rows = df.select(key, tree.leaf().alias("leaf")).where(F.col("leaf").isin([n.nid for n in open_]))
        medians = medians_of(rows, "leaf", [key], {n.nid: n.size for n in open_})[key]
        cut = F.element_at(F.create_map(*(F.lit(x) for g, m in medians.items() for x in (g, float(m)))), F.col("leaf"))
        for r in rows.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if(F.col(key) < cut).alias("nl")).collect():
            if r.nl >= b and r.n - r.nl >= b:
                tree.split(r.leaf, key, float(medians[r.leaf]), r.nl)
    return tree


def candidate_cuts(box: Box, queries: list[Box]) -> list[tuple[str, float]]:
    """Ends of queries strictly inside a box: by query, dimension, and lower before upper."""
    out = []
    for q in queries:
        for d, (lo, hi) in q.items():
            out += [(d, float(v)) for v in (lo, hi) if box[d][0] < v < box[d][1]]
    return list(dict.fromkeys(out))


def key_cuts(box: Box, queries: list[Box], key: str, median: float | None) -> list[float]:
    """Ends of queries on a join key that lie in a box, its ends included, query by query, and the rows' median last."""
    ends = [float(v) for q in queries for v in q.get(key, ()) if box[key][0] <= v <= box[key][1]]
    return ends if median is None else [*ends, float(median)]


def gain(queries: list[Box], box: Box, dim: str, value: float, n: int, left: int) -> int:
    """Rows that a cut spares the queries of a node."""
    whole = box[dim]
    ranges = [q.get(dim, whole) for q in queries]
    right_only = sum(lo >= value for lo, _ in ranges)
    left_only = sum(lo < value and hi <= value for lo, hi in ranges)
    return len(queries) * n - (len(queries) - right_only) * left - (len(queries) - left_only) * (n - left)


def _touch(box: Box, queries: list[Box]) -> list[Box]:
    return [q for q in queries if all(lo <= box[d][1] and box[d][0] <= hi for d, (lo, hi) in q.items())]


#: Cuts that one aggregate counts by an expression each; more are counted by their ranges.
CUTS = 64


def left_counts(rows: DataFrame, cuts: dict[int, list[tuple[str, float]]]) -> dict[tuple, int]:
    """(leaf, cut) -> rows of the leaf below the cut, for all cuts of all leaves in one job.

    Many cuts are sorted for each dimension, a row finds its range by binary search, and what lies below a cut is a
    prefix of the ranges' counts.
    """
    every = list(dict.fromkeys(c for cs in cuts.values() for c in cs))
    if len(every) <= CUTS:
        aggs = [F.count_if(F.col(d) < v).alias(f"c{i}") for i, (d, v) in enumerate(every)]
        found = {r.leaf: r for r in rows.groupBy("leaf").agg(F.count("*").alias("n"), *aggs).collect()}
        return {(leaf, c): found[leaf][f"c{every.index(c)}"] if leaf in found else 0 for leaf, cs in cuts.items() for c in cs}
    from pyspark.ml.feature import Bucketizer

    ends = {d: sorted({v for x, v in every if x == d}) for d in dict.fromkeys(d for d, _ in every)}
    ranged = rows
    for i, (d, vs) in enumerate(ends.items()):
        ranged = Bucketizer(splits=[-float("inf"), *vs, float("inf")], inputCol=d, outputCol=f"__range{i}", handleInvalid="keep").transform(ranged)
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"__range{i}").cast("int").alias("range")) for i, d in enumerate(ends))))
    below = {(leaf, d): [0] * (len(vs) + 2) for leaf in cuts for d, vs in ends.items()}
    for r in ranged.select("leaf", each.alias("r")).groupBy("leaf", "r.dim", "r.range").agg(F.count("*").alias("n")).collect():  # a row for each range
        if r.range is not None:
            below[r.leaf, r.dim][r.range] += r.n
    return {(leaf, (d, v)): sum(below[leaf, d][: ends[d].index(v) + 1]) for leaf, cs in cuts.items() for d, v in cs}


def query_tree(df: DataFrame, dims: list[str], queries: list[Box], b: int, tree: Tree | None = None, medians: bool = False, least_gain: int = 0, max_levels: int = 32) -> Tree:
    """Greedy query-driven tree: every sweep splits each leaf at its best cut (ties: the first one).

    One job counts all cuts of all leaves of a sweep. medians adds each dimension's median as a cut.
    """
    tree = tree or root(df, dims)
    closed: set[int] = set()
    for _ in range(max_levels):
        todo = [n for n in tree.leaves if n.nid not in closed and n.size >= 2 * b]
        cuts = {n.nid: candidate_cuts(n.box, _touch(n.box, queries)) for n in todo}
        rows = df.withColumn("leaf", tree.leaf()).where(F.col("leaf").isin([n.nid for n in todo])) if todo else None
        if medians and todo:
            for d, found in medians_of(rows, "leaf", dims, {n.nid: n.size for n in todo}).items():
                for nid, m in found.items():
                    cuts[nid].append((d, float(m)))
        if not any(cuts.values()):
            break
        counted = left_counts(rows, cuts)
        split = False
        for n in todo:
            own, best = _touch(n.box, queries), None
            for d, v in cuts[n.nid]:
                left = counted[n.nid, (d, v)]
                if left >= b and n.size - left >= b:
                    g = gain(own, n.box, d, v, n.size, left)
                    if g >= least_gain and (best is None or g > best[0]):
                        best = g, d, v, left
            if best:
                tree.split(n.nid, *best[1:])
                split = True
            else:
                closed.add(n.nid)
        if not split:
            break
    return tree


def join_tree_depth(machines: int) -> int:
    """i + 1 for the least i with 2^i >= machines."""
    i = 0
    while 2**i < machines:
        i += 1
    return i + 1


def pac_tree(df: DataFrame, key: str, dims: list[str], queries: list[Box], b: int, depth: int) -> Tree:
    """Medians of the join key above, query-driven cuts below; other depths of the top give the other join trees."""
    return query_tree(df, dims, queries, b, median_tree(df, key, depth, b, dims))


def best_depth(df: DataFrame, key: str, dims: list[str], queries: list[Box], b: int, machines: int) -> tuple[int, Tree]:
    """Of the depths for 1 to 4 times the machines, that whose tree reads least."""
    tried = []
    for d in sorted({join_tree_depth(k * machines) for k in range(1, 5)}):
        t = pac_tree(df, key, dims, queries, b, d)
        tried.append((sum(n.size for q in queries for n in t.touched(q)), d, t))
    _, d, t = min(tried, key=lambda x: x[:2])
    return d, t


def around(queries: list[Box], box: Box) -> Box:
    """The bounding box of the queries, within a box."""
    return {d: (max(lo, min(q.get(d, (lo, hi))[0] for q in queries)), min(hi, max(q.get(d, (lo, hi))[1] for q in queries))) for d, (lo, hi) in box.items()}


def overlaps(a: Box, b: Box) -> bool:
    return all(lo <= b[d][1] and b[d][0] <= hi for d, (lo, hi) in a.items() if d in b)


def sides(queries: list[Box], box: Box, dim: str, value: float) -> tuple[list[Box], list[Box], list[Box]]:
    """Queries wholly left of a cut, wholly right of it, and across it."""
    left, right, across = [], [], []
    for q in queries:
        lo, hi = q.get(dim, box[dim])
        (right if lo >= value else left if hi <= value else across).append(q)
    return left, right, across


def merged_boxes(queries: list[Box], box: Box) -> list[tuple[Box, int]]:
    """Bounding boxes, within a box, of the sets of queries that overlap openly, and how many queries each holds."""
    whole = [{d: q.get(d, r) for d, r in box.items()} for q in queries]
    groups = merge_open(whole)
    count = lambda g: sum(all(g[d][0] <= q[d][0] and q[d][1] <= g[d][1] for d in g) for q in whole)
    return [(around([g], box), count(g)) for g in groups]


def cut_merged(queries: list[Box], box: Box, dim: str, value: float) -> tuple[list[Box], list[Box]]:
    """What lies left and right of a cut of the bounding boxes of queries that overlap openly. A bounding box across the
    cut is taken apart: its queries that reach a side are merged anew there, unclipped."""
    whole = [{d: q.get(d, r) for d, r in box.items()} for q in queries]
    left, right, across = sides(merge_open(whole), box, dim, value)
    apart = [q for q in whole if any(all(g[d][0] <= q[d][0] and q[d][1] <= g[d][1] for d in g) for g in across)]
    return left + merge_open([q for q in apart if q[dim][0] < value]), right + merge_open([q for q in apart if q[dim][1] > value])


def forced_merge(groups: list[tuple[Box, int]], count, b: int) -> list[tuple[Box, int, int]]:
    """(box, queries, rows): boxes merged, the pair of least queries x rows first, until each holds b rows or one is left.

    count: rows of each box of a list, in one pass.
    """
    have = [(box, n, size) for (box, n), size in zip(groups, count([g for g, _ in groups]))]
    while len(have) > 1 and any(size < b for _, _, size in have):
        pairs = [(i, j) for i in range(len(have)) for j in range(i + 1, len(have))]
        joined = [{d: (min(lo, have[j][0][d][0]), max(hi, have[j][0][d][1])) for d, (lo, hi) in have[i][0].items()} for i, j in pairs]
        sizes = count(joined)
        k = min(range(len(pairs)), key=lambda k: ((have[pairs[k][0]][1] + have[pairs[k][1]][1]) * sizes[k], pairs[k]))
        i, j = pairs[k]
        new = joined[k], have[i][1] + have[j][1], sizes[k]
        have = [h for x, h in enumerate(have) if x not in (i, j)] + [new]
    return have


def _leaf_counts(df: DataFrame, tree: Tree, todo: dict[int, list[Box]]) -> dict[int, list[int]]:
    """Rows of boxes in leaves, for all leaves in one pass."""
    if not todo:
        return {}
    width = max(map(len, todo.values()))
    ones = [F.count_if(reduce(lambda a, k: a | ((F.col("leaf") == k) & inside(todo[k][i])), (k for k in todo if len(todo[k]) > i), F.lit(False))).alias(f"n{i}") for i in range(width)]
    rows = df.withColumn("leaf", tree.leaf()).where(F.col("leaf").isin(list(todo))).groupBy("leaf").agg(*ones).collect()
    found = {r.leaf: [r[f"n{i}"] for i in range(len(todo[r.leaf]))] for r in rows}
    return {k: found.get(k, [0] * len(v)) for k, v in todo.items()}


def dual_split(node: Node, queries: list[Box], dim: str, value: float, left: int, sizes: dict, b: int) -> tuple[int, list[tuple[Box, int]]] | None:
    """(rows spared, [(left box, rows), (right box, rows)]) of a split into two bounding boxes and the rest, or None if a
    part holds under b rows. left: rows left of the cut; sizes: rows of the boxes around either side's queries."""
    own_left, own_right, across = sides(queries, node.box, dim, value)
    boxes, rows = [], []
    for own, naive, half in ((own_left, left, (node.box[dim][0], value)), (own_right, node.size - left, (value, node.box[dim][1]))):
        boxes.append(around(own, node.box) if own else node.box | {dim: half})
        rows.append(sizes[_key(boxes[-1])] if own else naive)
    rest = node.size - sum(rows)
    if min(*rows, rest) < b:
        return None
    cost = len(own_left) * rows[0] + len(own_right) * rows[1] + len(across) * rest
    for q in across:
        cost += sum(n for own, box, n in zip((own_left, own_right), boxes, rows) if not own or overlaps(box, q))
    return len(queries) * node.size - cost, list(zip(boxes, rows))


def _key(box: Box) -> tuple:
    return tuple(sorted(box.items()))


def nora_tree(df: DataFrame, dims: list[str], queries: list[Box], b: int, max_levels: int = 32) -> Tree:
    """Query-driven cuts that spare rows; medians are cuts too in leaves of under 4b rows. A leaf of under 3b rows may
    instead become a bounding box of its queries and a rest, one of under 4b rows, cut into halves of under 2b, two boxes
    and a rest: an irregular leaf, which isn't split any more. What spares most wins, a plain cut among equals.

    A sweep takes two jobs: one counts all cuts of all leaves, one the boxes that they suggest.
    """
    tree, closed = root(df, dims), set()
    for _ in range(max_levels):
        todo = [n for n in tree.leaves if n.nid not in closed and not n.irregular and n.size >= 2 * b]
        if not todo:
            break
        own = {n.nid: _touch(n.box, queries) for n in todo}
        cuts = {n.nid: candidate_cuts(n.box, own[n.nid]) for n in todo}
        rows = df.withColumn("leaf", tree.leaf()).where(F.col("leaf").isin([n.nid for n in todo]))
        small = [n.nid for n in todo if n.size < 4 * b]
        own_medians = medians_of(rows.where(F.col("leaf").isin(small)), "leaf", dims, {n.nid: n.size for n in todo if n.nid in small}) if small else {}
        for d, found in own_medians.items():
            for nid, m in found.items():
                if tree.nodes[nid].box[d][0] < m < tree.nodes[nid].box[d][1]:
                    cuts[nid].append((d, float(m)))
        left = left_counts(rows, cuts)
        ask: dict[int, dict] = {}
        for n in todo:
            boxes = [around(own[n.nid], n.box)] if own[n.nid] and n.size < 3 * b else []
            if 3 * b <= n.size < 4 * b:
                boxes += [around(side, n.box) for d, v in cuts[n.nid] if max(left[n.nid, (d, v)], n.size - left[n.nid, (d, v)]) < 2 * b for side in sides(own[n.nid], n.box, d, v)[:2] if side]
            if boxes:
                ask[n.nid] = {_key(x): x for x in boxes}
        sizes = {k: dict(zip(ask[k], v)) for k, v in _leaf_counts(df, tree, {k: list(v.values()) for k, v in ask.items()}).items()}
        split = False
        for n in todo:
            best = None
            for d, v in cuts[n.nid]:
                lo = left[n.nid, (d, v)]
                if lo >= b and n.size - lo >= b and (g := gain(own[n.nid], n.box, d, v, n.size, lo)) > (best[0] if best else 0):
                    best = g, (d, v, lo), None
                if n.size < 3 * b and own[n.nid]:
                    box = around(own[n.nid], n.box)
                    size = sizes[n.nid][_key(box)]
                    if size >= b and n.size - size >= b and (g := len(own[n.nid]) * (n.size - size)) > (best[0] if best else 0):
                        best = g, None, [(box, size)]
                elif 3 * b <= n.size < 4 * b and max(lo, n.size - lo) < 2 * b:
                    found = dual_split(n, own[n.nid], d, v, lo, sizes.get(n.nid, {}), b)
                    if found and found[0] > (best[0] if best else 0):
                        best = found[0], None, found[1]
            if best is None:
                closed.add(n.nid)
            elif best[1]:
                tree.split(n.nid, *best[1])
                split = True
            else:
                n.irregular, n.parts = True, best[2]
        if not split:
            break
    return tree


def paw_tree(df: DataFrame, key: str | None, dims: list[str], queries: list[Box], b: int, depth: int = 0, medians: bool = True, bounding: float = 0) -> Tree:
    """The join tree to the full: medians of the key to a depth (none with bounding splits), then query-driven cuts, with
    each dimension's median among them if wished. With `bounding`, leaves of 2b to bounding x b rows that no cut halves
    become irregular where group_split() allows it."""
    top = median_tree(df, key, depth, b, dims) if key and not bounding else root(df, dims)
    tree = query_tree(df, dims, queries, b, top, medians)
    for n in tree.leaves:
        if 2 * b <= n.size <= bounding * b:
            group_split(df, tree, n.nid, queries, b)
    return tree


def group_split(df: DataFrame, tree: Tree, nid: int, queries: list[Box], b: int) -> int | None:
    """Makes a leaf irregular, a block for each merged box of its queries and a rest, if all of these hold b rows; the
    rows that this spares its queries, or None."""
    n = tree.nodes[nid]
    own = _touch(n.box, queries)
    if not own:
        return None
    parts = forced_merge(merged_boxes(own, n.box), lambda boxes: _leaf_counts(df, tree, {nid: boxes})[nid], b)
    if min(size for _, _, size in parts) < b or n.size - sum(size for _, _, size in parts) < b:
        return None
    n.irregular, n.parts = True, [(box, size) for box, _, size in parts]
    return len(own) * n.size - sum(k * size for _, k, size in parts)


def adaptdb_tree(df: DataFrame, key: str, dims: list[str], queries: list[Box], b: int, levels: int = 2) -> Tree:
    """Medians of the join key for a fixed number of levels, query-driven cuts below."""
    return pac_tree(df, key, dims, queries, b, levels)


def join_cost(tree: Tree, asks: list[tuple[Box, set[str]]], keys: set[str], workers: int) -> float:
    """Twice the rows that a workload's queries (box, join keys) read of a tree, rounded up to whole rounds of the workers;
    infinite if a query joins on none of the keys."""
    if any(not used & keys for _, used in asks):
        return float("inf")
    return -(-2 * sum(tree.read(box) for box, _ in asks) // workers) * workers


def pando_cuts(queries: list[Box], dim: str, lo: float, hi: float, max_depth: int) -> list[float]:
    """Cuts of one dimension's tree, to a depth. A range is cut at the query end (the smallest of equals) where the
    numbers of queries that reach into either side, by more than a point, differ least, as long as both sides have some."""
    ends = sorted({x for q in queries if dim in q and q[dim][0] < q[dim][1] for x in q[dim]})
    best = None
    for v in ends if max_depth else []:
        if lo < v < hi:
            left = sum(max(lo, q[dim][0]) < min(v, q[dim][1]) for q in queries if dim in q)
            right = sum(max(v, q[dim][0]) < min(hi, q[dim][1]) for q in queries if dim in q)
            if left and right and (best is None or abs(left - right) < best[0]):
                best = abs(left - right), v
    if best is None:
        return []
    v = best[1]
    return [*pando_cuts(queries, dim, lo, v, max_depth - 1), v, *pando_cuts(queries, dim, v, hi, max_depth - 1)]


def pando_leaf(dim: str, cuts: list[float]) -> Column:
    """Index of the one-dimensional leaf: how many cuts are at or below the value."""
    return sum(((F.col(dim) >= v).cast("int") for v in cuts), F.lit(0)).cast("long")


def pando_blocks(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    names = {d: f"leaf_{d}" for d in cuts}
    return df.select(*(pando_leaf(d, c).alias(names[d]) for d, c in cuts.items())).groupBy(*names.values()).agg(F.count("*").alias("n"))
