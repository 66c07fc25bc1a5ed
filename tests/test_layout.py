"""Invariants of trees, routing, grouping, orders and costs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import boxes
from tessera.operators import joins, trees
from tessera.plans import order, select
from tessera.sources import tables as T

DIMS = ["l_orderkey", "l_quantity"]


@pytest.fixture(scope="module")
def lines(spark, sf):
    return T.axes(T.load(spark, sf, "lineitem"), "lineitem").cache()


BOXES = [{"l_orderkey": (100.0, 600.0), "l_quantity": (5.0, 20.0)}, {"l_orderkey": (500.0, 900.0), "l_quantity": (10.0, 30.0)}]


@pytest.mark.parametrize("make", [lambda df: trees.median_tree(df, "l_orderkey", 3, 200, DIMS), lambda df: trees.query_tree(df, DIMS, BOXES, 200), lambda df: trees.pac_tree(df, "l_orderkey", DIMS, BOXES, 200, 2), lambda df: trees.best_depth(df, "l_orderkey", DIMS, BOXES, 200, 2)[1], lambda df: trees.query_tree(df, DIMS, BOXES, 200, medians=True)])
def test_tree(spark, lines, make):
    tree = make(lines)
    n = {r.leaf: r.n for r in lines.groupBy(tree.leaf().alias("leaf")).agg(F.count("*").alias("n")).collect()}
    assert n == {x.nid: x.size for x in tree.leaves} and sum(n.values()) == lines.count() and min(n.values()) >= 200
    for box in BOXES:
        hit = {r.leaf for r in lines.where(boxes.inside(box)).select(tree.leaf().alias("leaf")).distinct().collect()}
        assert hit <= {x.nid for x in tree.touched(box)}
    again = trees.Tree.load(tree.table(spark))
    assert {x.nid: x.box for x in again.leaves} == {x.nid: x.box for x in tree.leaves}


def test_first_cut_is_best(lines):
    v = np.array([tuple(r) for r in lines.select(*DIMS).collect()])
    tree, best = trees.query_tree(lines, DIMS, BOXES, 200, max_levels=1), None
    for d, x in trees.candidate_cuts(trees.root(lines, DIMS).nodes[1].box, BOXES):
        left = int((v[:, DIMS.index(d)] < x).sum())
        if left >= 200 and len(v) - left >= 200:
            read = sum((left if b[d][0] < x else 0) + (len(v) - left if b[d][1] > x else 0) for b in BOXES)
            if best is None or read < best[0]:
                best = read, d, x
    assert (tree.nodes[1].dim, tree.nodes[1].value) == best[1:]


def test_many_cuts(lines, monkeypatch):
    rng = np.random.default_rng(5)
    rows = lines.select(*DIMS).withColumn("leaf", F.when(F.col("l_quantity") < 20, 2).otherwise(3).cast("long"))
    cuts = {leaf: [("l_orderkey", float(x)) for x in rng.integers(0, 1500, 60)] + [("l_quantity", float(x)) for x in rng.integers(1, 51, 9)] for leaf in (2, 3)}
    few = trees.left_counts(rows, {k: v[:20] for k, v in cuts.items()})
    many = trees.left_counts(rows, cuts)
    assert len(many) > trees.CUTS and all(many[k] == n for k, n in few.items())
    tree = trees.query_tree(lines, DIMS, BOXES, 150)
    monkeypatch.setattr(trees, "CUTS", 0)
    again = trees.query_tree(lines, DIMS, BOXES, 150)
    assert {n.nid: (n.size, n.dim, n.value) for n in tree.nodes.values()} == {n.nid: (n.size, n.dim, n.value) for n in again.nodes.values()}


def test_medians_of_large_groups(lines):
    df = lines.select("l_linenumber", "l_extendedprice")
    assert trees.exact_medians(df, "l_linenumber", "l_extendedprice", bound=50) == pytest.approx(trees.exact_medians(df, "l_linenumber", "l_extendedprice"))


def check_blocks(lines, tree, queries):
    """Blocks hold the rows that the tree says, and what a query touches holds all that it asks for."""
    own = lines.withColumn("block", tree.block())
    assert {r.block: r.n for r in own.groupBy("block").agg(F.count("*").alias("n")).collect()} == tree.blocks()
    for q in queries:
        hit = {r.block: r.n for r in own.where(boxes.inside(q)).groupBy("block").agg(F.count("*").alias("n")).collect()}
        assert tree.read(q) >= sum(tree.blocks()[b] for b in hit)


@pytest.mark.parametrize("b", [150, 400, 1500])
def test_nora(spark, lines, b):
    tree = trees.nora_tree(lines, DIMS, BOXES, b)
    check_blocks(lines, tree, BOXES)
    assert min(tree.blocks().values()) >= b and (b != 1500 or any(n.irregular for n in tree.leaves))
    plain = trees.query_tree(lines, DIMS, BOXES, b, least_gain=1)
    cost = lambda t: sum(t.read(q) for q in BOXES)
    assert cost(tree) <= cost(plain)
    again = trees.Tree.load(tree.table(spark))
    assert again.blocks() == tree.blocks() and [again.read(q) for q in BOXES] == [tree.read(q) for q in BOXES]
    assert {n.nid for n in again.leaves if n.irregular} == {n.nid for n in tree.leaves if n.irregular}


def test_dual_split_by_hand():
    node = trees.Node(1, {"x": (0.0, 100.0)}, 40)
    queries = [{"x": (5.0, 10.0)}, {"x": (8.0, 20.0)}, {"x": (70.0, 90.0)}, {"x": (15.0, 75.0)}]
    sizes = {trees._key({"x": (5.0, 20.0)}): 12, trees._key({"x": (70.0, 90.0)}): 13}
    spared, parts = trees.dual_split(node, queries, "x", 50.0, 19, sizes, 10)
    # Before: 4 x 40. After: two queries read 12, one 13, and the one across all of 15, 12 and 13.
    assert spared == 160 - (2 * 12 + 13 + 15 + 12 + 13) and [n for _, n in parts] == [12, 13]
    assert trees.dual_split(node, queries, "x", 50.0, 19, sizes, 13) is None
    none_left = trees.dual_split(node, queries[2:3], "x", 50.0, 14, sizes, 10)
    assert none_left == (40 - 13, [({"x": (0.0, 50.0)}, 14), ({"x": (70.0, 90.0)}, 13)])


def test_forced_merge():
    rows = np.arange(100)
    count = lambda bs: [int(((rows >= b["x"][0]) & (rows <= b["x"][1])).sum()) for b in bs]
    groups = trees.merged_boxes([{"x": (0.0, 5.0)}, {"x": (3.0, 8.0)}, {"x": (12.0, 14.0)}, {"x": (60.0, 80.0)}, {"x": (-9.0, -1.0)}], {"x": (0.0, 99.0)})
    assert groups[:3] == [({"x": (0.0, 8.0)}, 2), ({"x": (12.0, 14.0)}, 1), ({"x": (60.0, 80.0)}, 1)]
    assert trees.forced_merge(groups[:3], count, 12) == [({"x": (60.0, 80.0)}, 1, 21), ({"x": (0.0, 14.0)}, 3, 15)]
    assert trees.forced_merge(groups[:3], count, 3) == [({"x": (0.0, 8.0)}, 2, 9), ({"x": (12.0, 14.0)}, 1, 3), ({"x": (60.0, 80.0)}, 1, 21)]


def test_group_split(lines):
    tree = trees.root(lines, DIMS)
    n = tree.nodes[1].size
    spared = trees.group_split(lines, tree, 1, BOXES, 50)
    assert tree.nodes[1].irregular and spared == len(BOXES) * (n - tree.nodes[1].parts[0][1])
    check_blocks(lines, tree, [*BOXES, {"l_orderkey": (0.0, 50.0)}, {"l_quantity": (1.0, 2.0)}])
    assert trees.group_split(lines, trees.root(lines, DIMS), 1, BOXES, n) is None and trees.group_split(lines, trees.root(lines, DIMS), 1, [], 1) is None
    check_blocks(lines, trees.paw_tree(lines, None, DIMS, BOXES, 300, bounding=6), BOXES)
    check_blocks(lines, trees.paw_tree(lines, "l_orderkey", DIMS, BOXES, 300, depth=2), BOXES)


def test_pando_cuts():
    q = [{"x": (0.0, 10.0)}, {"x": (5.0, 20.0)}]
    # At 5 one query reaches left and two right, at 10 two left and one right: equals, so the smaller; then 10 on its right.
    assert trees.pando_cuts(q, "x", -1e9, 1e9, 3) == [5.0, 10.0] and trees.pando_cuts(q, "x", -1e9, 1e9, 0) == []
    assert trees.pando_cuts([{"x": (3.0, 3.0)}, {"y": (0.0, 1.0)}], "x", -9.0, 9.0, 3) == []


def test_extend_sides(lines):
    domain = trees.root(lines, DIMS).nodes[1].box
    box = {"l_orderkey": (700.0, 710.0), "l_quantity": (20.0, 25.0)}
    for b in (1, 40, 700, 3000, 10**9):
        out, n = boxes.extend_sides(lines, box, domain, b)
        assert n == lines.where(boxes.inside(out)).count() and (n >= b or out == domain)
        assert all(out[d][0] <= box[d][0] and box[d][1] <= out[d][1] for d in box)
    assert boxes.extend_sides(lines, box, domain, 40)[0]["l_quantity"] == (20.0, 25.0)


def test_join_cost(lines):
    tree = trees.adaptdb_tree(lines, "l_orderkey", DIMS, BOXES, 200)
    read = sum(tree.read(b) for b in BOXES)
    assert trees.join_cost(tree, [(b, {"l_orderkey"}) for b in BOXES], {"l_orderkey"}, 7) == -(-2 * read // 7) * 7
    assert trees.join_cost(tree, [(BOXES[0], {"l_partkey"})], {"l_orderkey"}, 7) == float("inf")


def test_groups():
    chunks = {1: {1, 2}, 2: {2, 3}, 3: {9}, 4: {1, 2}, 5: {3}}
    chunks = {k: frozenset(v) for k, v in chunks.items()}
    for how in (joins.group_greedy, joins.group_affinity):
        groups = how(chunks, 2)
        assert sorted(x for g in groups for x in g) == [1, 2, 3, 4, 5] and max(map(len, groups)) <= 2
        assert any(set(g) == {1, 4} for g in groups)


def test_orders():
    edges = [("a", "x", "b", "x"), ("c", "y", "d", "y"), ("b", "z", "c", "z")]
    path = order.syntactic([(a, b) for a, _, b, _ in edges])
    assert {t for p in path for t in p[:2]} == set("abcd") and path[0] == ("a", "b", 1)
    blocks = {"a": {"x": 5}, "b": {"x": 9, "z": 9}, "c": {"y": 4, "z": 4}, "d": {"y": 7}}
    total, path = order.spanning(blocks, edges, {"a": ["x"], "b": ["x"]})
    assert len(path) == 3 and total > 0
    assert order.edge_weight(10, 20, True) == (70, 36) and order.edge_weight(10, 20, False) == (70, 70)
    # Parts that nothing joins are ordered one after another.
    assert len(order.spanning(blocks, edges[:2], {})[1]) >= 2 and len(order.syntactic([("a", "b"), ("c", "d")])) == 2


def test_costs():
    assert joins.step_cost(150_000, 1_500_000) == 1_950_000 and joins.step_cost(25, 10_000) == 10_075


def test_layout_io(spark, sf, tmp_path, lines):
    tree = trees.median_tree(lines, "l_orderkey", 2, 200)
    df = T.load(spark, sf, "lineitem")
    T.write_layout(df, tree.leaf(), str(tmp_path / "l"))
    hit = [n.nid for n in tree.touched({"l_orderkey": (100.0, 200.0)})]
    pruned = T.read_layout(spark, str(tmp_path / "l"), hit)
    assert len(hit) < len(tree.leaves) and "PartitionFilters: [" in pruned._jdf.queryExecution().toString()
    assert pruned.where("l_orderkey BETWEEN 100 AND 200").count() == df.where("l_orderkey BETWEEN 100 AND 200").count()
    assert T.read_layout(spark, str(tmp_path / "l")).count() == df.count()


def test_pivot(spark):
    df = spark.createDataFrame([("paw", 1, 5, 1), ("pac", 1, 2, 0), ("ad_mto", 1, 3, 0)], "model string, query_id long, read_rows long, chain_rows long")
    assert select.pivot(df).collect()[0].asDict() == {"query_id": 1, "paw": 6, "ad_mto": 3, "pac": 2}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_statements(spark, tmp_path):
    from tessera.plans import compile as C

    text = "-- select 1;\nselect a -- b;\nfrom t;\nnoise;\nCREATE  VIEW v AS\nselect 1;\n\nwith x as (select 2)\nselect * from x;\nselect unfinished"
    want = ["select a\nfrom t", "CREATE  VIEW v AS\nselect 1", "with x as (select 2)\nselect * from x"]
    assert C.statements(text) == want and C.statements("") == []
    (tmp_path / "b.sql").write_text("select 3;")
    (tmp_path / "a.sql").write_text(text)
    (tmp_path / "c.txt").write_text("select 4;")
    assert C.read_statements(spark, str(tmp_path)) == [*want, "select 3"]


def test_join_kinds(spark, sf):
    from tessera.plans import compile as C

    T.register(spark, sf)
    sql = """select o_orderkey, q from orders left join (select max(l_quantity) as q, l_orderkey as k from lineitem group by l_orderkey) on o_orderkey = k
        where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0) and o_totalprice > o_custkey"""
    found = {tuple(r)[2:] for r in C.edge_table(spark, [sql]).collect()}
    assert found == {("orders", "o_orderkey", "lineitem", "l_orderkey", "LEFT OUTER"), ("customer", "c_custkey", "orders", "o_custkey", "LEFT ANTI")}
    assert [t for t, _ in C.Plan(spark, sql).predicates] == ["orders", "customer"]
    assert C.Plan(spark, "select 1 as x").edges == [] and C.workload(spark, []) == {}


def test_metadata_and_reports(spark, sf, tmp_path):
    from tessera import registry as R
    from tessera.plans import workload

    made = [R.QUERIES[n](spark, sf) for n in ("profile_minmax", "filtered_ranges")] + [workload.edges(spark)]
    workload.save(spark, str(tmp_path / "w"), *made)
    for a, b in zip(made, workload.restore(spark, str(tmp_path / "w"))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    report = select.Evaluation(spark, sf)
    report.save(str(tmp_path / "r"))
    query, table, times = (spark.read.option("header", True).csv(str(tmp_path / "r" / n)) for n in ("query_cost", "table_cost", "time_cost"))
    assert query.count() == 24 and times.count() == 3 and table.where("table_name = 'avg'").count() == 3
    # Each step is charged to two tables by halves.
    halves = {r.model: r.c for r in table.where("table_name <> 'avg'").groupBy("model").agg(F.sum(F.col("join_cost").cast("double")).alias("c")).collect()}
    joined = [q for q, (_, es) in workload.WORKLOAD.items() if es]
    whole = {r.model: r.c for r in query.where(F.col("query_id").isin(joined)).groupBy("model").agg(F.sum(F.col("read_rows").cast("long") + F.col("chain_rows").cast("long")).alias("c")).collect()}
    assert all(0 <= whole[m] - halves[m] <= 40 for m in whole)


def test_sources(spark, sf, tmp_path):
    df = T.load(spark, sf, "lineitem")
    assert T.sampled(df, 1.0) is df and abs(T.sampled(df, 0.25, 3).count() - df.count() / 4) < 6 * (df.count() * 3 / 16) ** 0.5
    assert T.sample_rate([5, 40_000, 20_000], 10_000, 10_000) == 0.25 and T.sample_rate([5], 1, 10) == 1.0
    spark.sql("drop table if exists lay_l")
    spark.sql("drop table if exists lay_o")
    try:
        T.write_bucketed(df, "l_orderkey", 4, "lay_l")
        T.write_bucketed(T.load(spark, sf, "orders"), "o_orderkey", 4, "lay_o")
        joined = spark.table("lay_l").hint("merge").join(spark.table("lay_o"), F.col("l_orderkey") == F.col("o_orderkey"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == df.count()
    finally:
        spark.sql("drop table if exists lay_l")
        spark.sql("drop table if exists lay_o")


def test_reductions_and_sweeps(spark, sf):
    from tessera import registry as R

    rows = R.QUERIES["query_cost_report"](spark, sf).collect()
    cost = lambda m, skip=(): np.mean([r.read_rows + r.chain_rows for r in rows if r.model == m and r.query_id not in skip])
    got = {r.model: r for r in R.QUERIES["model_reduction"](spark, sf).collect()}
    for m in ("paw", "ad_mto", "pac"):
        assert got[m].rows_per_query == pytest.approx(cost(m)) and got[m].fewer_pct == pytest.approx(100 * (1 - cost(m) / cost("paw")), abs=0.06)
    swept = {(r.blocks, r.replicas, r.model): r.rows_per_query for r in select.sweep(spark, sf, [32], [3], skip=(8,)).collect()}
    assert swept == {(32, 3, m): pytest.approx(cost(m, (8,))) for m in got}
    assert R.QUERIES["keys_paw"](spark, sf).count() == 0


def test_cuts_by_hand():
    box = {"x": (0.0, 10.0), "y": (0.0, 10.0)}
    own = [{"x": (1.0, 4.0), "y": (0.0, 2.0)}, {"x": (3.0, 8.0), "y": (1.0, 3.0)}, {"x": (7.0, 9.0), "y": (2.0, 5.0)}, {"x": (0.0, 2.0), "y": (8.0, 9.0)}, {"x": (5.0, 6.0), "y": (7.0, 8.0)}]
    left, right = trees.cut_merged(own, box, "x", 5.0)
    assert left == [own[3], {"x": (1.0, 8.0), "y": (0.0, 3.0)}]
    assert right == [own[4], {"x": (3.0, 9.0), "y": (1.0, 5.0)}]
    assert trees.cut_merged([], box, "x", 5.0) == ([], [])
    assert trees.key_cuts(box, [*own[:2], {"y": (0.0, 1.0)}, {"x": (-1.0, 10.0)}], "x", 4.5) == [1.0, 4.0, 3.0, 8.0, 10.0, 4.5]
    assert trees.key_cuts(box, [], "x", None) == []
