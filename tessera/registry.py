"""Queries by name over the tables of a folder, and SQL that gives the same rows in an independent engine."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import boxes
from tessera.operators import joins, profile, prune, trees
from tessera.plans import compile as compiler
from tessera.plans import order, select, workload
from tessera.plans.corpus import SQL
from tessera.sources import tables as T

#: Boxes over lineitem that serve the geometric operators; order keys as of a table of 1500 orders, see _boxes().
BOXES = [
    {"l_orderkey": (100.0, 900.0), "l_quantity": (5.0, 20.0)},
    {"l_orderkey": (500.0, 1200.0), "l_quantity": (10.0, 30.0)},
    {"l_orderkey": (0.0, 300.0), "l_quantity": (40.0, 50.0)},
    {"l_orderkey": (1000.0, 1400.0), "l_quantity": (1.0, 50.0)},
]
POINTS = [(600.0, 15.0), (100.0, 5.0), (1100.0, 45.0), (50.0, 1.0)]
BLOCKS, LEVELS = 32, 3  # a block holds rows / BLOCKS; levels of the median trees below
TREES = {"a": ("orders", "o_orderkey", LEVELS), "b": ("lineitem", "l_orderkey", LEVELS)}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _corpus(text: str):
    def run(spark, sf_dir):
        T.register(spark, sf_dir)
        return spark.sql(text)

    return run


for _name, _text in SQL.items():
    QUERIES[_name], ORACLE_SQL[_name] = _corpus(_text), _text


def _axis_sql(d: str) -> str:
    return f"CAST(date_diff('day', DATE '1970-01-01', CAST({d} AS DATE)) AS DOUBLE)" if d in T.DATES else f"CAST({d} AS DOUBLE)"


def _values(rows, names: str) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else "NULL" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"
    return f"(VALUES {', '.join('(' + ', '.join(text(v) for v in r) + ')' for r in rows)}) AS v({names})"


def _scale(spark, sf_dir) -> float:
    """How much larger the domain of order keys is than that of 1500 orders."""
    return (T.load(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("m")).first().m + 1) / 1500


def _boxes(spark, sf_dir) -> list[dict]:
    s = _scale(spark, sf_dir)
    return [{d: tuple(math.floor(x * s) * 1.0 for x in r) if d == "l_orderkey" else r for d, r in b.items()} for b in BOXES]


def _box_table(spark, sf_dir) -> DataFrame:
    rows = [(i, d, lo, hi) for i, b in enumerate(_boxes(spark, sf_dir)) for d, (lo, hi) in b.items()]
    return spark.createDataFrame(rows, "box_id long, dim string, lo double, hi double")


_UNIT_SQL = _values([(i, d, lo, hi) for i, b in enumerate(BOXES) for d, (lo, hi) in b.items()], "box_id, dim, lo, hi")
_SCALE_SQL = "(SELECT (max(l_orderkey) + 1) / 1500.0 AS s FROM lineitem)"
_BOX_SQL = f"""(SELECT box_id, dim, CASE WHEN dim = 'l_orderkey' THEN floor(lo * s) ELSE lo END AS lo,
    CASE WHEN dim = 'l_orderkey' THEN floor(hi * s) ELSE hi END AS hi FROM {_UNIT_SQL} CROSS JOIN {_SCALE_SQL} z)"""
#: A row for each box: its ends on both dimensions, k for order keys and q for quantities.
_WIDE_SQL = f"""(SELECT box_id, max(lo) FILTER (WHERE dim = 'l_orderkey') AS lo_k, max(hi) FILTER (WHERE dim = 'l_orderkey') AS hi_k,
    max(lo) FILTER (WHERE dim = 'l_quantity') AS lo_q, max(hi) FILTER (WHERE dim = 'l_quantity') AS hi_q FROM {_BOX_SQL} w GROUP BY box_id)"""
_DOMAIN_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dim, min({_axis_sql(d)}) AS lo, max({_axis_sql(d)}) AS hi FROM lineitem" for d in ("l_orderkey", "l_quantity"))
_EDGE_ROWS = [(q, i, *e) for q, (_, es) in workload.WORKLOAD.items() for i, e in enumerate(es)]
_EDGE_SQL = f"(SELECT * FROM {_values(_EDGE_ROWS, 'query_id, ord, left_table, left_col, right_table, right_col')})"
_RANGE_SQL = " UNION ALL ".join(
    f"SELECT CAST({q} AS BIGINT) AS query_id, '{t}' AS table_name, '{d}' AS dim, min({_axis_sql(d)}) AS lo, max({_axis_sql(d)}) AS hi FROM {t} WHERE {p}" for q, (ts, _) in workload.WORKLOAD.items() for t, p in ts.items() if p for d in T.DIMS[t]
)


def _domain(spark, sf_dir) -> DataFrame:
    return profile.min_max(T.load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity"], "lineitem").select(F.col("column_name").alias("dim"), F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi"))


# Profiles and cleaning


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{d}' AS column_name, min({_axis_sql(d)}) AS lo, max({_axis_sql(d)}) AS hi FROM {t}" for t, ds in T.DIMS.items() for d in ds))
def profile_minmax(spark, sf_dir):
    return profile.union([profile.min_max(T.load(spark, sf_dir, t), ds, t) for t, ds in T.DIMS.items()])


_TEXTS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "orders": ["o_orderkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_linenumber", "l_returnflag"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(coalesce(max(length(CAST({c} AS VARCHAR))), 0) AS BIGINT) AS width FROM {t}" for t, cs in _TEXTS.items() for c in cs))
def profile_widths_text(spark, sf_dir):
    return profile.union([profile.widths(T.load(spark, sf_dir, t), cs, t) for t, cs in _TEXTS.items()])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in T.DIMS))
def profile_rowcounts(spark, sf_dir):
    return profile.union([profile.row_count(T.load(spark, sf_dir, t), t) for t in T.DIMS])


@query(" UNION ALL ".join(f"SELECT 'events' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_nulls FROM (SELECT event_id, nullif(event_type, 'click') AS event_type, CASE WHEN value > 50 THEN value END AS value FROM events) e" for c in ("event_id", "event_type", "value")))
def null_census(spark, sf_dir):
    e = T.load(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return profile.null_census(e, "events")


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN value > 50 THEN value END AS value FROM events) e WHERE value IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return profile.drop_nulls(T.load(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("value")), ["value"])


@query("SELECT least(1.0, 20000.0 / max(n)) AS rate FROM (" + " UNION ALL ".join(f"SELECT CAST(count(*) AS DOUBLE) AS n FROM {t}" for t in T.DIMS) + ") x WHERE n > 10000")
def sample_rate_global(spark, sf_dir):
    rows = [r.n_rows for r in profile_rowcounts(spark, sf_dir).collect()]  # a row for each table
    return spark.createDataFrame([(float(T.sample_rate(rows, 20000, 10000)),)], "rate double")


_KIND_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
_TEXT_COLUMNS = ("c_name", "c_mktsegment", "s_name", "n_name", "r_name")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{'text' if c in _TEXT_COLUMNS else 'dimension'}' AS kind" for t, cs in _KIND_COLUMNS.items() for c in cs))
def column_kinds(spark, sf_dir):
    return spark.createDataFrame([r for t in ("region", "nation", "customer", "supplier") for r in profile.kinds(T.load(spark, sf_dir, t), t)], "table_name string, column_name string, kind string")


_LISTED = "('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')"


@query(f"SELECT table_name, column_name, CAST(ordinal_position - 1 AS BIGINT) AS position FROM information_schema.columns WHERE table_name IN {_LISTED}")
def catalog_columns(spark, sf_dir):
    T.register(spark, sf_dir)
    names = [t.name for t in spark.catalog.listTables() if t.name in T.TABLES]
    return spark.createDataFrame([(t, c.name, i) for t in names for i, c in enumerate(spark.catalog.listColumns(t))], "table_name string, column_name string, position long")


# Boxes


_IN_BOX = "l_orderkey BETWEEN b.lo_k AND b.hi_k AND l_quantity BETWEEN b.lo_q AND b.hi_q"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN {_WIDE_SQL} b ON b.box_id = 0 AND {_IN_BOX}")
def box_filter_rows(spark, sf_dir):
    return T.load(spark, sf_dir, "lineitem").where(boxes.inside(_boxes(spark, sf_dir)[0])).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT b.box_id, count(l_orderkey) AS n FROM {_WIDE_SQL} b LEFT JOIN lineitem ON {_IN_BOX} GROUP BY b.box_id")
def box_counts_exact(spark, sf_dir):
    return boxes.counts(T.load(spark, sf_dir, "lineitem"), _boxes(spark, sf_dir))


@query(f"SELECT b.box_id, CAST(floor(exp(sum(ln((b.hi - b.lo) / (d.hi - d.lo)))) * (SELECT count(*) FROM lineitem) + 1e-6) AS BIGINT) AS n FROM {_BOX_SQL} b JOIN ({_DOMAIN_SQL}) d ON b.dim = d.dim GROUP BY b.box_id")
def box_counts_uniform(spark, sf_dir):
    share = F.exp(F.sum(F.log(boxes.uniform_count(F.col("lo"), F.col("hi"), F.col("d_lo"), F.col("d_hi")))))
    n = profile.row_count(T.load(spark, sf_dir, "lineitem"), "lineitem")
    return _box_table(spark, sf_dir).join(F.broadcast(_domain(spark, sf_dir)), "dim").groupBy("box_id").agg(share.alias("share")).crossJoin(F.broadcast(n)).select("box_id", F.floor(F.col("share") * F.col("n_rows") + 1e-6).alias("n"))


@query(f"SELECT a.box_id AS q, b.box_id AS p, min(CASE WHEN a.lo > b.hi OR a.hi < b.lo THEN 0 WHEN a.lo >= b.lo AND a.hi <= b.hi THEN 2 ELSE 1 END) AS class FROM {_BOX_SQL} a JOIN {_BOX_SQL} b ON a.dim = b.dim GROUP BY a.box_id, b.box_id")
def box_overlap_class(spark, sf_dir):
    a, b = _box_table(spark, sf_dir).alias("a"), _box_table(spark, sf_dir).alias("b")
    kind = boxes.overlap_class(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))
    return a.join(b, F.col("a.dim") == F.col("b.dim")).groupBy(F.col("a.box_id").alias("q"), F.col("b.box_id").alias("p")).agg(F.min(kind).alias("class"))


@query(f"SELECT b.box_id, b.dim, greatest(b.lo, d.lo) AS lo, least(b.hi, d.hi) AS hi FROM {_BOX_SQL} b JOIN ({_DOMAIN_SQL}) d ON b.dim = d.dim")
def box_clip(spark, sf_dir):
    lo, hi = boxes.clip(F.col("lo"), F.col("hi"), F.col("d_lo"), F.col("d_hi"))
    return _box_table(spark, sf_dir).join(F.broadcast(_domain(spark, sf_dir)), "dim").select("box_id", "dim", lo.alias("lo"), hi.alias("hi"))


@query(f"SELECT dim, min(lo) AS lo, max(hi) AS hi FROM {_BOX_SQL} b GROUP BY dim")
def mbr_of_boxes(spark, sf_dir):
    return boxes.bounding(_box_table(spark, sf_dir))


def _merged_sql(rounds: int, name: str = "m", of: str = _WIDE_SQL, by: str = "box_id") -> str:
    """CTEs m0 to m<rounds>: every box grows to hold all that overlap it openly, so equal boxes are left in the end. Only
    boxes that are equal in what `by` names besides the id can meet."""
    same = [c for c in by.split(", ") if c != "box_id"]
    meets = " AND ".join(["a.lo_k < b.hi_k AND b.lo_k < a.hi_k AND a.lo_q < b.hi_q AND b.lo_q < a.hi_q", *(f"a.{c} = b.{c}" for c in same)])
    keys = ", ".join(f"a.{c}" for c in by.split(", "))
    grow = f"{keys}, min(b.lo_k) AS lo_k, max(b.hi_k) AS hi_k, min(b.lo_q) AS lo_q, max(b.hi_q) AS hi_q"
    return f"{name}0 AS {of}, " + ", ".join(f"{name}{i + 1} AS (SELECT {grow} FROM {name}{i} a JOIN {name}{i} b ON {meets} GROUP BY {keys})" for i in range(rounds))


@query(f"""WITH {_merged_sql(4)}, b AS (SELECT DISTINCT lo_k, hi_k, lo_q, hi_q FROM m4)
    SELECT row_number() OVER (ORDER BY b.lo_k) - 1 AS mbr, b.lo_k AS lo, b.hi_k AS hi, count(l_orderkey) AS n FROM b LEFT JOIN lineitem ON {_IN_BOX} GROUP BY b.lo_k, b.hi_k, b.lo_q, b.hi_q""")
def mbr_merge(spark, sf_dir):
    merged = sorted(boxes.merge_open(_boxes(spark, sf_dir)), key=lambda b: b["l_orderkey"][0])
    n = boxes.counts(T.load(spark, sf_dir, "lineitem"), merged)
    rows = spark.createDataFrame([(i, *b["l_orderkey"]) for i, b in enumerate(merged)], "mbr long, lo double, hi double")
    return rows.join(n, F.col("mbr") == F.col("box_id")).select("mbr", "lo", "hi", "n")


_POINT_SQL = f"(SELECT i, floor(x * s) AS x, y FROM {_values([(i, *p) for i, p in enumerate(POINTS)], 'i, x, y')} CROSS JOIN {_SCALE_SQL} z)"


@query(f"SELECT p.i AS point_id, count(*) AS n FROM {_POINT_SQL} p JOIN {_WIDE_SQL} b ON p.x BETWEEN b.lo_k AND b.hi_k AND p.y BETWEEN b.lo_q AND b.hi_q GROUP BY p.i")
def point_in_box_counts(spark, sf_dir):
    s = _scale(spark, sf_dir)
    points = spark.createDataFrame([(i, math.floor(x * s) * 1.0, y) for i, (x, y) in enumerate(POINTS)], "point_id long, l_orderkey double, l_quantity double")
    n = reduce(lambda a, b: a + b, (boxes.inside(b).cast("long") for b in _boxes(spark, sf_dir)))
    return points.select("point_id", n.alias("n")).where("n > 0")


@query(f"SELECT box_id, CASE WHEN lo >= floor(500 * s) THEN 'R' WHEN hi <= floor(500 * s) THEN 'L' ELSE 'M' END AS side FROM {_BOX_SQL} b CROSS JOIN {_SCALE_SQL} y WHERE dim = 'l_orderkey'")
def query_split_3way(spark, sf_dir):
    cut = F.lit(math.floor(500 * _scale(spark, sf_dir)) * 1.0)
    return _box_table(spark, sf_dir).where("dim = 'l_orderkey'").select("box_id", boxes.side_of_cut(F.col("lo"), F.col("hi"), cut).alias("side"))


@query(f"SELECT v, count(*) FILTER (WHERE lo < v AND hi > v) AS n FROM {_BOX_SQL} b CROSS JOIN (SELECT DISTINCT lo AS v FROM {_BOX_SQL} c WHERE dim = 'l_orderkey') c WHERE dim = 'l_orderkey' GROUP BY v")
def crossing_counts(spark, sf_dir):
    b = _box_table(spark, sf_dir).where("dim = 'l_orderkey'")
    return b.select(F.col("lo").alias("v")).distinct().join(F.broadcast(b), how="cross").groupBy("v").agg(F.count_if((F.col("lo") < F.col("v")) & (F.col("hi") > F.col("v"))).alias("n"))


@query(f"""SELECT round(max(f), 9) AS scale FROM (SELECT greatest(abs(l_orderkey - (lo_k + hi_k) / 2) / ((hi_k - lo_k) / 2), abs(l_quantity - 12.5) / 7.5) AS f
    FROM lineitem JOIN {_WIDE_SQL} b ON b.box_id = 0 ORDER BY 1 LIMIT 501) x""")
def extend_bound_chebyshev(spark, sf_dir):
    return spark.createDataFrame([(round(boxes.extend_chebyshev(T.load(spark, sf_dir, "lineitem"), _boxes(spark, sf_dir)[0], 500), 9),)], "scale double")


#: The box that is extended side by side: the middle of the first box, which holds too few rows. Its lower key side gets
#: to the domain's end with too few rows as well, so the answer lies on the upper side.
@query(f"""WITH z AS (SELECT box_id, lo_k + (hi_k - lo_k) / 4 AS lo, lo_k + (hi_k - lo_k) / 2 AS hi FROM {_WIDE_SQL} w WHERE box_id = 0), n AS (SELECT CAST(floor(count(*) / 8.0) AS BIGINT) AS b FROM lineitem),
    low AS (SELECT l_orderkey FROM lineitem, z WHERE l_orderkey <= hi AND l_quantity BETWEEN 5 AND 20), d AS (SELECT min(l_orderkey) AS first FROM lineitem),
    up AS (SELECT l_orderkey AS x, row_number() OVER (ORDER BY l_orderkey) AS r FROM lineitem, z WHERE l_orderkey > hi AND l_quantity BETWEEN 5 AND 20),
    edge AS (SELECT x FROM up, n WHERE r = b - (SELECT count(*) FROM low))
    SELECT CAST(first AS DOUBLE) AS lo, CAST(x AS DOUBLE) AS hi, (SELECT count(*) FROM lineitem, edge e WHERE l_orderkey <= e.x AND l_quantity BETWEEN 5 AND 20) AS n FROM d, edge""")
def extend_bound_sides(spark, sf_dir):
    df = T.axes(T.load(spark, sf_dir, "lineitem"), "lineitem").select("l_orderkey", "l_quantity")
    lo, hi = _boxes(spark, sf_dir)[0]["l_orderkey"]
    box = {"l_orderkey": (lo + (hi - lo) / 4, lo + (hi - lo) / 2), "l_quantity": (5.0, 20.0)}
    domain = trees.root(df, list(box)).nodes[1]
    out, n = boxes.extend_sides(df, box, domain.box, domain.size // 8)
    return spark.createDataFrame([(*out["l_orderkey"], n)], "lo double, hi double, n long")


# Workload


@query(_RANGE_SQL)
def filtered_ranges(spark, sf_dir):
    return workload.filtered_ranges(spark, sf_dir)


def _boxes_of(spark, sf_dir):
    own = workload.as_boxes(workload.filtered_ranges(spark, sf_dir))
    domains: dict = {}
    for r in profile_minmax(spark, sf_dir).collect():
        domains.setdefault(r.table_name, {})[r.column_name] = (r.lo, r.hi)
    return own, domains


def _class_sql() -> str:
    """The joined columns of each query, with the name of their class."""
    rows = []
    for q, (_, es) in workload.WORKLOAD.items():
        classes: list[set] = []
        for lt, lc, rt, rc in es:
            hit = [c for c in classes if (lt, lc) in c or (rt, rc) in c]
            classes = [c for c in classes if c not in hit] + [set().union(*hit, {(lt, lc), (rt, rc)})]
        rows += [(q, i, t, c) for i, cl in enumerate(classes) for t, c in sorted(cl)]
    return f"(SELECT * FROM {_values(rows, 'query_id, cls, table_name, dim')})"


@query(f"""WITH r AS ({_RANGE_SQL}), k AS {_class_sql()}, d AS ({ORACLE_SQL['profile_minmax']}),
    m AS (SELECT k.query_id, k.cls, max(r.lo) AS lo, min(r.hi) AS hi FROM k JOIN r ON k.query_id = r.query_id AND k.table_name = r.table_name AND k.dim = r.dim GROUP BY 1, 2),
    p AS (SELECT k.query_id, k.table_name, k.dim, m.lo, m.hi FROM k JOIN m ON k.query_id = m.query_id AND k.cls = m.cls
          UNION ALL SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = r.query_id AND k.table_name = r.table_name AND k.dim = r.dim))
    SELECT p.* FROM p JOIN d ON p.table_name = d.table_name AND p.dim = d.column_name WHERE p.lo <> d.lo OR p.hi <> d.hi""")
def range_propagation(spark, sf_dir):
    return workload.as_rows(spark, workload.propagate(*_boxes_of(spark, sf_dir)))


@query(f"SELECT r.* FROM ({_RANGE_SQL}) r JOIN ({ORACLE_SQL['profile_minmax']}) d ON r.table_name = d.table_name AND r.dim = d.column_name WHERE r.lo <> d.lo OR r.hi <> d.hi")
def range_minimise(spark, sf_dir):
    domain = profile_minmax(spark, sf_dir).select("table_name", F.col("column_name").alias("dim"), F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi"))
    return workload.filtered_ranges(spark, sf_dir).join(F.broadcast(domain), ["table_name", "dim"]).where("lo <> d_lo OR hi <> d_hi").select("query_id", "table_name", "dim", "lo", "hi")


@query(f"SELECT query_id, min(ord) AS ord, least(left_table, right_table) AS t1, greatest(left_table, right_table) AS t2 FROM {_EDGE_SQL} e GROUP BY query_id, least(left_table, right_table), greatest(left_table, right_table)")
def join_edges_dedup(spark, sf_dir):
    return workload.dedup_edges(workload.edges(spark)).select("query_id", "ord", F.least("left_table", "right_table").alias("t1"), F.greatest("left_table", "right_table").alias("t2"))


@query(f"SELECT table_name, col, count(*) AS n FROM (SELECT left_table AS table_name, left_col AS col FROM {_EDGE_SQL} a UNION ALL SELECT right_table, right_col FROM {_EDGE_SQL} b) x GROUP BY table_name, col")
def join_freqs(spark, sf_dir):
    return workload.key_use(workload.edges(spark))


@query(f"SELECT key1, key2, count(*) AS n FROM (SELECT left_table || '.' || left_col AS key1, right_table || '.' || right_col AS key2 FROM {_EDGE_SQL} a UNION ALL SELECT right_table || '.' || right_col, left_table || '.' || left_col FROM {_EDGE_SQL} b) x GROUP BY key1, key2")
def key_adjacency(spark, sf_dir):
    return workload.key_pairs(workload.edges(spark))


# Workload compiled from SQL text

#: Statements with aliases, subqueries, a view, renamed columns, both sides of one table, and lines that are none.
STATEMENTS = """
-- orders of one quarter that some late line belongs to
select o_orderpriority, count(*) as n
from orders o
where o.o_orderdate >= date '1996-07-01' and o.o_orderdate < date '1996-10-01'
  and exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 30)
group by o_orderpriority;

create view asia as
select n_nationkey as key, n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA';

this line is no statement
select n_name, sum(l_extendedprice * (1 - l_discount)) as revenue
from customer, orders, lineitem, asia
where c_custkey = o_custkey and l_orderkey = o_orderkey and c_nationkey = asia.key
  and c_acctbal between 0 and 2500 and l_shipdate <= date '1998-09-24'
group by n_name;

with big as (select p_partkey, p_size from part where p_size in (38, 40))
select count(*) as n from lineitem join big on l_partkey = p_partkey
where l_quantity < (select avg(l_quantity) from lineitem) and l_discount = l_tax;

SELECT a.c_custkey FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_acctbal < b.c_acctbal WHERE b.c_custkey = 7;
"""


def _compiled(spark, sf_dir) -> dict:
    T.register(spark, sf_dir)
    return compiler.workload(spark, compiler.statements(STATEMENTS))


#: By hand, from the statements: which columns are joined. The two sides of an edge are in the order of their names.
_JOINED = [
    (1, "lineitem.l_orderkey", "orders.o_orderkey"),
    (2, "customer.c_custkey", "orders.o_custkey"),
    (2, "lineitem.l_orderkey", "orders.o_orderkey"),
    (2, "customer.c_nationkey", "nation.n_nationkey"),
    (2, "nation.n_regionkey", "region.r_regionkey"),
    (3, "lineitem.l_partkey", "part.p_partkey"),
    (4, "customer.c_nationkey", "customer.c_nationkey"),
]
#: By hand: each statement's conditions on one table, column against column and subqueries left out.
_CONDITIONS = [
    (1, "orders", "o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'"),
    (1, "lineitem", "l_quantity > 30"),
    (2, "customer", "c_acctbal BETWEEN 0 AND 2500"),
    (2, "lineitem", "l_shipdate <= DATE '1998-09-24'"),
    (2, "region", "r_name = 'ASIA'"),
    (3, "part", "p_size IN (38, 40)"),
    (4, "customer", "c_custkey = 7"),
]


@query(f"SELECT * FROM {_values(_JOINED, 'query_id, key1, key2')}")
def compiled_edges(spark, sf_dir):
    """Joins found in the text, as pairs of columns in the order of their names."""
    rows = [(q, *sorted((f"{a}.{x}", f"{b}.{y}"))) for q, (_, es) in _compiled(spark, sf_dir).items() for a, x, b, y in es]
    return spark.createDataFrame(rows, "query_id long, key1 string, key2 string")


@query(" UNION ALL ".join(f"SELECT CAST({q} AS BIGINT) AS query_id, '{t}' AS table_name, '{d}' AS dim, min({_axis_sql(d)}) AS lo, max({_axis_sql(d)}) AS hi FROM {t} WHERE {c}" for q, t, c in _CONDITIONS for d in T.DIMS[t]))
def compiled_ranges(spark, sf_dir):
    return workload.filtered_ranges(spark, sf_dir, _compiled(spark, sf_dir))


@query(f"SELECT query_id, left_table, left_col, right_table, right_col FROM {_EDGE_SQL} e")
def variant_edges(spark, sf_dir):
    """The edges of the variant that shuffles their order: the same ones."""
    rows = [(q, *e) for q, (_, es) in workload.WORKLOAD.items() for e in workload.variant("mto", es)]
    return spark.createDataFrame(rows, "query_id long, left_table string, left_col string, right_table string, right_col string")


# Layouts


def _frame(spark, sf_dir, table):
    df = T.axes(T.load(spark, sf_dir, table), table)
    n = T.load(spark, sf_dir, table).count()
    return df, max(1, n // BLOCKS)


def _median(spark, sf_dir, table, key, levels):
    df, b = _frame(spark, sf_dir, table)
    return trees.median_tree(df, key, levels, b)


def _tree_sql(table: str, key: str, levels: int) -> str:
    """CTEs whose last, a<levels>, holds k, leaf, lo, hi of every row."""
    ctes = [f"p AS (SELECT greatest(1, floor(count(*) / {BLOCKS})) AS b, min(CAST({key} AS DOUBLE)) AS lo, max(CAST({key} AS DOUBLE)) AS hi FROM {table})", f"a0 AS (SELECT CAST({key} AS DOUBLE) AS k, CAST(1 AS BIGINT) AS leaf, p.lo, p.hi FROM {table} CROSS JOIN p)"]
    for i in range(levels):
        ctes.append(f"s{i} AS (SELECT leaf, count(*) AS n, median(k) AS m FROM a{i} GROUP BY leaf)")
        ctes.append(f"c{i} AS (SELECT a.leaf, s.n, s.m, sum(CASE WHEN a.k < s.m THEN 1 ELSE 0 END) AS nl FROM a{i} a JOIN s{i} s ON a.leaf = s.leaf GROUP BY a.leaf, s.n, s.m)")
        ok = f"(c.nl >= p.b AND c.n - c.nl >= p.b AND c.leaf >= {2**i})"
        leaf = f"CAST(CASE WHEN {ok} THEN 2 * a.leaf + CASE WHEN a.k < c.m THEN 0 ELSE 1 END ELSE a.leaf END AS BIGINT) AS leaf"
        ends = f"CASE WHEN {ok} AND a.k >= c.m THEN c.m ELSE a.lo END AS lo, CASE WHEN {ok} AND a.k < c.m THEN c.m ELSE a.hi END AS hi"
        ctes.append(f"a{i + 1} AS (SELECT a.k, {leaf}, {ends} FROM a{i} a JOIN c{i} c ON a.leaf = c.leaf CROSS JOIN p)")
    return ", ".join(ctes)


def _leaf_sql(table: str, key: str, levels: int = LEVELS) -> str:
    return f"(WITH {_tree_sql(table, key, levels)} SELECT leaf, count(*) AS n, min(lo) AS lo, max(hi) AS hi FROM a{levels} GROUP BY leaf)"


def _leaves(spark, sf_dir, table, key, levels=LEVELS):
    return _median(spark, sf_dir, table, key, levels).leaf_table(spark, [key]).withColumnsRenamed({f"lo_{key}": "lo", f"hi_{key}": "hi"})


@query(f"SELECT * FROM {_leaf_sql('lineitem', 'l_orderkey', 4)} x")
def median_tree_leaves_lineitem_orderkey(spark, sf_dir):
    return _leaves(spark, sf_dir, "lineitem", "l_orderkey", 4)


@query(f"SELECT * FROM {_leaf_sql('orders', 'o_custkey')} x")
def median_tree_leaves_orders_custkey(spark, sf_dir):
    return _leaves(spark, sf_dir, "orders", "o_custkey")


@query(f"WITH {_tree_sql('orders', 'o_custkey', LEVELS)} SELECT k, leaf, count(*) AS n FROM a{LEVELS} GROUP BY k, leaf")
def median_tree_assign(spark, sf_dir):
    tree = _median(spark, sf_dir, "orders", "o_custkey", LEVELS)
    df, _ = _frame(spark, sf_dir, "orders")
    return df.select(F.col("o_custkey").alias("k"), tree.leaf().alias("leaf")).groupBy("k", "leaf").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(max(floor(log2(leaf))) AS BIGINT) AS depth, count(*) AS leaves FROM {_leaf_sql('lineitem', 'l_orderkey', 4)} x")
def tree_depth(spark, sf_dir):
    t = _median(spark, sf_dir, "lineitem", "l_orderkey", 4)
    return spark.createDataFrame([(t.depth, len(t.leaves))], "depth long, leaves long")


@query(f"SELECT round(sum(n) / (count(*) * 2.0 * max(b)), 9) AS utilisation, count(*) AS blocks FROM {_leaf_sql('lineitem', 'l_orderkey', 4)} x CROSS JOIN (SELECT greatest(1, floor(count(*) / {BLOCKS})) AS b FROM lineitem) p")
def block_utilisation(spark, sf_dir):
    df, b = _frame(spark, sf_dir, "lineitem")
    leaves = _leaves(spark, sf_dir, "lineitem", "l_orderkey", 4)
    return leaves.agg(F.round(F.sum("n") / (F.count("*") * 2.0 * b), 9).alias("utilisation"), F.count("*").alias("blocks"))


_DIMS = ["l_orderkey", "l_quantity"]
#: Ends of boxes: by box, dimension, and lower before upper; a value that comes again is left out.
_CUT_SQL = f"""(SELECT row_number() OVER (ORDER BY min(pos)) - 1 AS ord, dim, v FROM (
    SELECT 4 * box_id + CASE WHEN dim = 'l_orderkey' THEN 0 ELSE 2 END AS pos, dim, lo AS v FROM {_BOX_SQL} x
    UNION ALL SELECT 4 * box_id + CASE WHEN dim = 'l_orderkey' THEN 1 ELSE 3 END, dim, hi FROM {_BOX_SQL} y) e GROUP BY dim, v)"""


@query(f"""WITH c AS MATERIALIZED {_CUT_SQL}, g AS (SELECT c.ord, c.dim, c.v, count(*) AS nq, count(*) FILTER (WHERE lo >= v) AS qr, count(*) FILTER (WHERE lo < v AND hi <= v) AS ql FROM c JOIN {_BOX_SQL} b ON b.dim = c.dim GROUP BY ALL),
    l AS (SELECT c.ord, count(*) AS n, count(*) FILTER (WHERE CASE WHEN c.dim = 'l_orderkey' THEN l_orderkey ELSE l_quantity END < c.v) AS n_left FROM c CROSS JOIN lineitem GROUP BY c.ord)
    SELECT g.ord, g.dim, g.v, l.n_left, nq * n - (nq - qr) * n_left - (nq - ql) * (n - n_left) AS gain FROM g JOIN l ON g.ord = l.ord""")
def split_gain_table(spark, sf_dir):
    whole, own = {d: (-1e18, 1e18) for d in _DIMS}, _boxes(spark, sf_dir)
    cuts = trees.candidate_cuts(whole, own)
    one = T.load(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), *(F.count_if(F.col(d) < v).alias(f"c{i}") for i, (d, v) in enumerate(cuts))).first()
    rows = [(i, d, v, one[f"c{i}"], trees.gain(own, whole, d, v, one.n, one[f"c{i}"])) for i, (d, v) in enumerate(cuts)]
    return spark.createDataFrame(rows, "ord long, dim string, v double, n_left long, gain long")


@query(f"SELECT * FROM {_CUT_SQL} c")
def candidate_cuts(spark, sf_dir):
    cuts = trees.candidate_cuts({d: (-1e18, 1e18) for d in _DIMS}, _boxes(spark, sf_dir))
    return spark.createDataFrame([(i, d, v) for i, (d, v) in enumerate(cuts)], "ord long, dim string, v double")


_SIDES_SQL = """(SELECT 'L' AS side, w.box_id, w.lo_k, w.hi_k, w.lo_q, w.hi_q FROM m0 w JOIN m4 m ON m.box_id = w.box_id, z WHERE m.lo_k < v AND m.hi_k > v AND w.lo_k < v
    UNION ALL SELECT 'R', w.box_id, w.lo_k, w.hi_k, w.lo_q, w.hi_q FROM m0 w JOIN m4 m ON m.box_id = w.box_id, z WHERE m.lo_k < v AND m.hi_k > v AND w.hi_k > v)"""


#: The cut goes through a bounding box of three boxes, of which one lies across it too.
@query(f"""WITH {_merged_sql(4)}, z AS (SELECT floor(950 * s) AS v FROM {_SCALE_SQL} y), {_merged_sql(4, "s", _SIDES_SQL, "side, box_id")},
    b AS (SELECT DISTINCT side, lo_k, hi_k, lo_q, hi_q FROM s4 UNION SELECT CASE WHEN lo_k >= v THEN 'R' ELSE 'L' END, lo_k, hi_k, lo_q, hi_q FROM m4, z WHERE lo_k >= v OR hi_k <= v)
    SELECT side, b.lo_k, b.hi_k, b.lo_q, b.hi_q, count(l_orderkey) AS n FROM b LEFT JOIN lineitem ON {_IN_BOX} GROUP BY side, b.lo_k, b.hi_k, b.lo_q, b.hi_q""")
def mbr_split(spark, sf_dir):
    own = _boxes(spark, sf_dir)
    parts = trees.cut_merged(own, {d: (-1e18, 1e18) for d in _DIMS}, "l_orderkey", math.floor(950 * _scale(spark, sf_dir)))
    found = [(side, b) for side, bs in zip("LR", parts) for b in bs]
    n = boxes.counts(T.load(spark, sf_dir, "lineitem"), [b for _, b in found])
    rows = spark.createDataFrame([(i, side, *b["l_orderkey"], *b["l_quantity"]) for i, (side, b) in enumerate(found)], "box_id long, side string, lo_k double, hi_k double, lo_q double, hi_q double")
    return rows.join(n, "box_id").select("side", "lo_k", "hi_k", "lo_q", "hi_q", "n")


@query(f"""WITH d AS (SELECT min(l_orderkey) AS first, max(l_orderkey) AS last, median(CAST(l_orderkey AS DOUBLE)) AS m FROM lineitem),
    e AS (SELECT 2 * box_id AS pos, lo_k AS v FROM {_WIDE_SQL} a UNION ALL SELECT 2 * box_id + 1, hi_k FROM {_WIDE_SQL} b UNION ALL SELECT 1000, m FROM d)
    SELECT row_number() OVER (ORDER BY pos) - 1 AS ord, v FROM e, d WHERE v BETWEEN first AND last""")
def join_key_cuts(spark, sf_dir):
    df = T.axes(T.load(spark, sf_dir, "lineitem"), "lineitem").select("l_orderkey", F.lit(1).alias("leaf"))
    whole = trees.root(df, ["l_orderkey"]).nodes[1]
    median = trees.medians_of(df, "leaf", ["l_orderkey"], {1: whole.size})["l_orderkey"].get(1)
    cuts = trees.key_cuts(whole.box, _boxes(spark, sf_dir), "l_orderkey", median)
    return spark.createDataFrame(list(enumerate(cuts)), "ord long, v double")


def _query_tree_sql(levels: int, medians: int = 0) -> str:
    """CTEs whose last, n<medians + levels>, holds a query-driven tree's leaves; medians: levels of key medians on top."""
    side = lambda x: f"CASE WHEN c.dim = 'l_orderkey' THEN {x}.k ELSE {x}.q END"
    ctes = [
        f"box AS MATERIALIZED {_WIDE_SQL}",
        f"p AS MATERIALIZED (SELECT greatest(1, floor(count(*) / {BLOCKS})) AS b FROM lineitem)",
        "r0 AS MATERIALIZED (SELECT CAST(l_orderkey AS DOUBLE) AS k, CAST(l_quantity AS DOUBLE) AS q, CAST(1 AS BIGINT) AS leaf FROM lineitem)",
        "n0 AS MATERIALIZED (SELECT leaf, count(*) AS n, min(k) AS lo_k, max(k) AS hi_k, min(q) AS lo_q, max(q) AS hi_q FROM r0 GROUP BY leaf)",
    ]
    for i in range(medians + levels):
        if i < medians:
            ctes.append(f"c{i} AS MATERIALIZED (SELECT leaf, 'l_orderkey' AS dim, median(k) AS v, 0 AS pos, 0 AS gain FROM r{i} GROUP BY leaf)")
        else:
            ctes += [
                f"t{i} AS MATERIALIZED (SELECT n.leaf, b.* FROM n{i} n JOIN box b ON b.lo_k <= n.hi_k AND n.lo_k <= b.hi_k AND b.lo_q <= n.hi_q AND n.lo_q <= b.hi_q)",
                f"e{i} AS (SELECT leaf, 'l_orderkey' AS dim, lo_k AS v, 4 * box_id AS pos FROM t{i} UNION ALL SELECT leaf, 'l_orderkey', hi_k, 4 * box_id + 1 FROM t{i} "
                f"UNION ALL SELECT leaf, 'l_quantity', lo_q, 4 * box_id + 2 FROM t{i} UNION ALL SELECT leaf, 'l_quantity', hi_q, 4 * box_id + 3 FROM t{i})",
                f"d{i} AS MATERIALIZED (SELECT e.leaf, e.dim, e.v, min(e.pos) AS pos FROM e{i} e JOIN n{i} n ON n.leaf = e.leaf WHERE CASE WHEN dim = 'l_orderkey' THEN lo_k < v AND v < hi_k ELSE lo_q < v AND v < hi_q END GROUP BY ALL)",
                f"c{i} AS MATERIALIZED (SELECT d.leaf, d.dim, d.v, d.pos, count(*) AS nq, count(*) FILTER (WHERE CASE WHEN dim = 'l_orderkey' THEN lo_k ELSE lo_q END >= v) AS qr, "
                f"count(*) FILTER (WHERE CASE WHEN dim = 'l_orderkey' THEN lo_k < v AND hi_k <= v ELSE lo_q < v AND hi_q <= v END) AS ql FROM d{i} d JOIN t{i} t ON t.leaf = d.leaf GROUP BY ALL)",
            ]
        gain = "0" if i < medians else "nq * n - (nq - qr) * nl - (nq - ql) * (n - nl)"
        ctes += [
            f"l{i} AS MATERIALIZED (SELECT c.*, count(*) AS n, count(*) FILTER (WHERE {side('r')} < c.v) AS nl FROM c{i} c JOIN r{i} r ON r.leaf = c.leaf GROUP BY ALL)",
            f"w{i} AS MATERIALIZED (SELECT leaf, dim, v, n, nl FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY {gain} DESC, pos) AS rank FROM l{i}, p "
            f"WHERE n >= 2 * b AND nl >= b AND n - nl >= b AND {gain} >= 0 AND leaf >= {2**i if i < medians else 1}) x WHERE rank = 1)",
            f"r{i + 1} AS MATERIALIZED (SELECT r.k, r.q, CAST(CASE WHEN c.leaf IS NULL THEN r.leaf WHEN {side('r')} < c.v THEN 2 * r.leaf ELSE 2 * r.leaf + 1 END AS BIGINT) AS leaf FROM r{i} r LEFT JOIN w{i} c ON c.leaf = r.leaf)",
            f"n{i + 1} AS MATERIALIZED (SELECT n.* FROM n{i} n WHERE leaf NOT IN (SELECT leaf FROM w{i}) "
            f"UNION ALL SELECT 2 * n.leaf, w.nl, lo_k, CASE WHEN dim = 'l_orderkey' THEN v ELSE hi_k END, lo_q, CASE WHEN dim = 'l_quantity' THEN v ELSE hi_q END FROM n{i} n JOIN w{i} w ON w.leaf = n.leaf "
            f"UNION ALL SELECT 2 * n.leaf + 1, w.n - w.nl, CASE WHEN dim = 'l_orderkey' THEN v ELSE lo_k END, hi_k, CASE WHEN dim = 'l_quantity' THEN v ELSE lo_q END, hi_q FROM n{i} n JOIN w{i} w ON w.leaf = n.leaf)",
        ]
    return ", ".join(ctes)


def _query_leaves_sql(levels: int, medians: int = 0) -> str:
    return f"WITH {_query_tree_sql(levels, medians)} SELECT leaf, n, lo_k AS lo_l_orderkey, hi_k AS hi_l_orderkey, lo_q AS lo_l_quantity, hi_q AS hi_l_quantity FROM n{levels + medians}"


@query(f"SELECT leaf, n FROM ({_query_leaves_sql(1)}) x")
def qdtree_level1(spark, sf_dir):
    df, b = _frame(spark, sf_dir, "lineitem")
    tree = trees.query_tree(df, _DIMS, _boxes(spark, sf_dir), b, max_levels=1)
    return df.select(tree.leaf().alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))


@query(_query_leaves_sql(12))
def qdtree_leaves(spark, sf_dir):
    df, b = _frame(spark, sf_dir, "lineitem")
    return trees.query_tree(df, _DIMS, _boxes(spark, sf_dir), b).leaf_table(spark, _DIMS)


@query(_query_leaves_sql(11, 2))
def pactree_leaves(spark, sf_dir):
    df, b = _frame(spark, sf_dir, "lineitem")
    return trees.pac_tree(df, "l_orderkey", _DIMS, _boxes(spark, sf_dir), b, 2).leaf_table(spark, _DIMS)


@query(_query_leaves_sql(11, 2))
def adaptdb_leaves(spark, sf_dir):
    df, b = _frame(spark, sf_dir, "lineitem")
    return trees.adaptdb_tree(df, "l_orderkey", _DIMS, _boxes(spark, sf_dir), b).leaf_table(spark, _DIMS)


def _block_rows(spark, df, tree):
    """block, n as the tree has it, and as the rows' own blocks say."""
    own = df.groupBy(tree.block().alias("block")).agg(F.count("*").alias("rows"))
    return spark.createDataFrame(list(tree.blocks().items()), "block long, n long").join(own, "block", "full").select("block", "n", "rows")


@query()
def nora_leaves(spark, sf_dir):
    df, b = _frame(spark, sf_dir, "lineitem")
    return _block_rows(spark, df, trees.nora_tree(df, _DIMS, _boxes(spark, sf_dir), b))


@query()
def paw_leaves(spark, sf_dir):
    """The join tree with medians and bounding splits, of leaves of up to 3b rows."""
    df, b = _frame(spark, sf_dir, "lineitem")
    return _block_rows(spark, df, trees.paw_tree(df, None, _DIMS, _boxes(spark, sf_dir), b, bounding=3))


def _nodes_sql(table: str, key: str, levels: int) -> str:
    """All nodes of a median tree."""
    ok = "c.nl >= p.b AND c.n - c.nl >= p.b"
    parts = []
    for d in range(levels + 1):
        split = f"LEFT JOIN (SELECT c.leaf, c.m FROM c{d} c CROSS JOIN p WHERE {ok}) s ON s.leaf = a.leaf" if d < levels else "CROSS JOIN (SELECT NULL AS m) s"
        parts.append(
            f"SELECT 't' AS tree_id, a.leaf AS nid, CASE WHEN a.leaf = 1 THEN -1 ELSE a.leaf // 2 END AS pid, {d} AS depth, s.m IS NULL AS is_leaf, count(*) AS node_size, CASE WHEN s.m IS NOT NULL THEN '{key}' END AS dim, "
            f"CAST(s.m AS DOUBLE) AS value, min(a.lo) AS lo, max(a.hi) AS hi FROM a{d} a {split} WHERE a.leaf >= {2**d} GROUP BY a.leaf, s.m"
        )
    return f"WITH {_tree_sql(table, key, levels)} " + " UNION ALL ".join(parts)


@query(_nodes_sql("orders", "o_custkey", LEVELS))
def tree_table(spark, sf_dir):
    nodes = _median(spark, sf_dir, "orders", "o_custkey", LEVELS).table(spark)
    return nodes.select("tree_id", "nid", "pid", "depth", "is_leaf", "node_size", "dim", "value", F.col("bounds")[0]["lo"].alias("lo"), F.col("bounds")[0]["hi"].alias("hi"))


def _pando_cuts_sql(dim: str, levels: int) -> str:
    """The cuts of one dimension's tree: each range at the end that best balances the boxes on its sides."""
    x = f"(SELECT lo, hi FROM {_BOX_SQL} b WHERE dim = '{dim}')"
    ctes = [f"x AS MATERIALIZED {x}", "e AS (SELECT DISTINCT v FROM (SELECT lo AS v FROM x WHERE lo < hi UNION ALL SELECT hi FROM x WHERE lo < hi) y)", "g0 AS (SELECT -1e18 AS a, 1e18 AS z)"]
    for i in range(levels):
        ctes.append(
            f"h{i} AS MATERIALIZED (SELECT a, z, v FROM (SELECT g.a, g.z, e.v, row_number() OVER (PARTITION BY g.a, g.z ORDER BY abs(count(*) FILTER (WHERE least(e.v, x.hi) > greatest(g.a, x.lo)) - count(*) FILTER (WHERE least(g.z, x.hi) > greatest(e.v, x.lo))), e.v) AS r "
            f"FROM g{i} g JOIN e ON g.a < e.v AND e.v < g.z CROSS JOIN x GROUP BY g.a, g.z, e.v HAVING count(*) FILTER (WHERE least(e.v, x.hi) > greatest(g.a, x.lo)) > 0 AND count(*) FILTER (WHERE least(g.z, x.hi) > greatest(e.v, x.lo)) > 0) y WHERE r = 1)"
        )
        ctes.append(f"g{i + 1} AS (SELECT a, v AS z FROM h{i} UNION ALL SELECT v, z FROM h{i})")
    return f"(WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT v FROM h{i}" for i in range(levels)) + ")"


_PANDO_SQL = {d: _pando_cuts_sql(d, 3) for d in _DIMS}


def _pando(spark, sf_dir) -> dict[str, list[float]]:
    own = _boxes(spark, sf_dir)
    return {d: trees.pando_cuts(own, d, -1e18, 1e18, 3) for d in _DIMS}


@query(" UNION ALL ".join(f"SELECT '{d}' AS dim, v FROM {c} x" for d, c in _PANDO_SQL.items()))
def pando_cuts(spark, sf_dir):
    return spark.createDataFrame([(d, v) for d, c in _pando(spark, sf_dir).items() for v in c], "dim string, v double")


def _pando_sql(rows: str = "lineitem") -> str:
    leaf = lambda d: f"CAST((SELECT count(*) FROM cut_{d} c WHERE c.v <= l.{d}) AS BIGINT) AS leaf_{d}"
    ctes = ", ".join(f"cut_{d} AS MATERIALIZED {c}" for d, c in _PANDO_SQL.items())
    return f"WITH {ctes}, blocks AS MATERIALIZED (SELECT {leaf('l_orderkey')}, {leaf('l_quantity')}, count(*) AS n FROM {rows} l GROUP BY 1, 2)"


@query(f"{_pando_sql()} SELECT * FROM blocks")
def pando_blocks(spark, sf_dir):
    return trees.pando_blocks(T.load(spark, sf_dir, "lineitem"), _pando(spark, sf_dir))


def _pando_hits(box, cuts):
    """Leaves of one dimension that a closed range touches."""
    edges = [-float("inf"), *cuts, float("inf")]
    return [i for i in range(len(edges) - 1) if box[0] <= edges[i + 1] and box[1] >= edges[i]]


def _pando_cost(spark, sf_dir, both: bool):
    cuts, own, rows = _pando(spark, sf_dir), _boxes(spark, sf_dir), T.load(spark, sf_dir, "lineitem").select(*_DIMS)
    blocks = trees.pando_blocks(rows if both else rows.distinct(), cuts)
    hit = [[F.col(f"leaf_{d}").isin(_pando_hits(b[d], cuts[d])) for d in cuts] for b in own]
    one = blocks.agg(*(F.coalesce(F.sum(F.when(h[0] & h[1] if both else h[0] | h[1], F.col("n"))), F.lit(0)).alias(f"n{i}") for i, h in enumerate(hit)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("box_id"), F.col(f"n{i}").alias("n")) for i in range(len(own))))).alias("r")).select("r.*")


def _pando_cost_sql(word: str) -> str:
    touch = lambda d, k: f"leaf_{d} BETWEEN (SELECT count(*) FROM cut_{d} c WHERE c.v < lo_{k}) AND (SELECT count(*) FROM cut_{d} c WHERE c.v <= hi_{k})"
    rows = "lineitem" if word == "AND" else "(SELECT DISTINCT l_orderkey, l_quantity FROM lineitem)"
    return f"{_pando_sql(rows)} SELECT box_id, CAST(coalesce(sum(n) FILTER (WHERE ({touch('l_orderkey', 'k')}) {word} ({touch('l_quantity', 'q')})), 0) AS BIGINT) AS n FROM {_WIDE_SQL} b CROSS JOIN blocks GROUP BY box_id"


@query(_pando_cost_sql("AND"))
def pando_and_cost(spark, sf_dir):
    return _pando_cost(spark, sf_dir, True)


@query(_pando_cost_sql("OR"))
def pando_or_cost(spark, sf_dir):
    return _pando_cost(spark, sf_dir, False)


# Pruning and cost

_ASK_SQL = f"(SELECT box_id AS query_id, lo AS q_lo, hi AS q_hi FROM {_BOX_SQL} b WHERE dim = 'l_orderkey')"


def _asks(spark, sf_dir):
    return _box_table(spark, sf_dir).where("dim = 'l_orderkey'").select(F.col("box_id").alias("query_id"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))


_TOUCH_SQL = f"(SELECT q.query_id, l.leaf, l.n FROM {_leaf_sql('lineitem', 'l_orderkey', 4)} l JOIN {_ASK_SQL} q ON q.q_lo <= l.hi AND l.lo <= q.q_hi)"


@query(f"SELECT query_id, leaf, n FROM {_TOUCH_SQL} x")
def blocks_touched(spark, sf_dir):
    return prune.touched(_leaves(spark, sf_dir, "lineitem", "l_orderkey", 4), _asks(spark, sf_dir))


@query(f"SELECT query_id, CAST(sum(n) AS BIGINT) AS cost, count(*) AS blocks FROM {_TOUCH_SQL} x GROUP BY query_id")
def scan_cost_per_query(spark, sf_dir):
    return prune.scan_cost(blocks_touched(spark, sf_dir))


@query(f"SELECT round(sum(n) / (SELECT count(*) FROM lineitem) / {len(BOXES)}.0, 9) AS ratio FROM {_TOUCH_SQL} x")
def scan_ratio_avg(spark, sf_dir):
    n = profile.row_count(T.load(spark, sf_dir, "lineitem"), "lineitem")
    return prune.scan_ratio(blocks_touched(spark, sf_dir), n, len(BOXES))


@query(f"SELECT DISTINCT q.query_id, CAST(CASE WHEN l.leaf >= 8 THEN floor(l.leaf / 2) ELSE l.leaf END AS BIGINT) AS node FROM {_leaf_sql('lineitem', 'l_orderkey', 3)} l JOIN {_ASK_SQL} q ON q.q_lo <= l.hi AND l.lo <= q.q_hi")
def toplayer_blocks(spark, sf_dir):
    t = _median(spark, sf_dir, "lineitem", "l_orderkey", 3)
    layer = spark.createDataFrame([(n.nid, n.size, *n.box["l_orderkey"]) for n in t.layer(2)], "leaf long, n long, lo double, hi double")
    return prune.touched(layer, _asks(spark, sf_dir)).select("query_id", F.col("leaf").alias("node"))


def _overlap(spark, sf_dir):
    return joins.overlap_graph(*(_leaves(spark, sf_dir, *TREES[k]) for k in "ab"))


_OVERLAP_SQL = f"(SELECT a.leaf AS a_leaf, a.n AS a_n, b.leaf AS b_leaf, b.n AS b_n FROM {_leaf_sql(*TREES['a'])} a JOIN {_leaf_sql(*TREES['b'])} b ON a.lo <= b.hi AND b.lo <= a.hi)"


@query(f"SELECT * FROM {_OVERLAP_SQL} x")
def overlap_chunks(spark, sf_dir):
    return _overlap(spark, sf_dir)


@query(f"SELECT x.a_leaf AS a1, y.a_leaf AS a2, count(*) AS shared FROM {_OVERLAP_SQL} x JOIN {_OVERLAP_SQL} y ON x.b_leaf = y.b_leaf AND x.a_leaf < y.a_leaf GROUP BY x.a_leaf, y.a_leaf")
def pairwise_affinity(spark, sf_dir):
    return joins.affinity(_overlap(spark, sf_dir))


@query(f"""WITH o AS {_OVERLAP_SQL}, g AS (SELECT *, floor((a_leaf - (SELECT min(a_leaf) FROM o)) / 3) AS grp FROM o),
    a AS (SELECT sum(a_n) AS a_rows FROM (SELECT DISTINCT grp, a_leaf, a_n FROM g) x), b AS (SELECT sum(b_n) AS b_rows FROM (SELECT DISTINCT grp, b_leaf, b_n FROM g) x)
    SELECT CAST(a_rows AS BIGINT) AS a_rows, CAST(b_rows AS BIGINT) AS b_rows, CAST(a_rows + b_rows AS BIGINT) AS cost FROM a, b""")
def hyper_cost(spark, sf_dir):
    o = _overlap(spark, sf_dir)
    leaves = sorted(r.a_leaf for r in o.select("a_leaf").distinct().collect())
    groups = spark.createDataFrame([(a, (a - leaves[0]) // 3) for a in leaves], "a_leaf long, grp long")
    return joins.hyper_cost(o, groups)


@query(f"""WITH o AS {_OVERLAP_SQL}, a AS (SELECT sum(a_n) AS a_rows FROM (SELECT DISTINCT a_leaf, a_n FROM o) x), b AS (SELECT sum(b_n) AS b_rows FROM (SELECT DISTINCT b_leaf, b_n FROM o) x)
    SELECT CAST(a_rows AS BIGINT) AS a_rows, CAST(b_rows AS BIGINT) AS b_rows, CAST(3 * (a_rows + b_rows) AS BIGINT) AS cost FROM a, b""")
def shuffle_cost(spark, sf_dir):
    return joins.shuffle_cost(_overlap(spark, sf_dir))


def _grouping(spark, sf_dir, how):
    meets: dict = {}
    for r in _overlap(spark, sf_dir).collect():  # leaves, not rows
        meets.setdefault(r.a_leaf, set()).add(r.b_leaf)
    groups = how({k: frozenset(v) for k, v in meets.items()}, 3)
    return spark.createDataFrame([(i, a) for i, g in enumerate(groups) for a in g], "grp long, a_leaf long")


#: Order keys make the leaves' overlaps a chain: each block shares partners with its neighbours alone, the more of them
#: the fewer blocks lie between. Both ways of grouping then take runs of three neighbours.
_RUNS_SQL = f"SELECT (row_number() OVER (ORDER BY a_leaf) - 1) // 3 AS grp, a_leaf FROM (SELECT DISTINCT a_leaf FROM {_OVERLAP_SQL} o) x"


@query(_RUNS_SQL)
def group_adaptdb(spark, sf_dir):
    return _grouping(spark, sf_dir, joins.group_greedy)


@query(_RUNS_SQL)
def group_qdg(spark, sf_dir):
    return _grouping(spark, sf_dir, joins.group_affinity)


@query("SELECT n_nationkey, n_name, c_custkey, c_nationkey, c_acctbal FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_nationkey, c_custkey, c_acctbal) AS r FROM customer) c ON n_nationkey = c_nationkey AND r = 1")
def first_match_join(spark, sf_dir):
    nation = T.load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = T.load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return joins.first_match(nation, customer, "n_nationkey", "c_nationkey")


_FIRST_SQL = """s1 AS (SELECT n_nationkey, c_custkey FROM nation JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) c ON n_nationkey = c_nationkey AND r = 1),
    s2 AS (SELECT o_orderkey FROM s1 JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o ON c_custkey = o_custkey AND r = 1)"""


@query(f"""WITH {_FIRST_SQL}, h AS (SELECT 0 AS step, (SELECT count(*) FROM nation) AS held, (SELECT count(*) FROM customer) AS other
    UNION ALL SELECT 1, (SELECT count(*) FROM s1), (SELECT count(*) FROM orders) UNION ALL SELECT 2, (SELECT count(*) FROM s2), (SELECT count(*) FROM lineitem))
    SELECT CAST(step AS BIGINT) AS step, held, other, CAST(3 * other + held AS BIGINT) AS cost FROM h""")
def chained_first_match(spark, sf_dir):
    """What each step of a chain of first-match joins reads, by the rows that the steps before it really leave."""
    load = lambda t, *c: T.load(spark, sf_dir, t).select(*c)
    steps = [
        (load("customer", "c_nationkey", "c_custkey"), "n_nationkey", "c_nationkey"),
        (load("orders", "o_custkey", "o_orderkey"), "c_custkey", "o_custkey"),
        (load("customer", "c_custkey"), "o_custkey", "c_custkey"),  # left out: its key is there already
        (load("lineitem", "l_orderkey", "l_linenumber", "l_partkey"), "o_orderkey", "l_orderkey"),
    ]
    _, costs = joins.chain(load("nation", "n_nationkey"), steps)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(costs)], "step long, held long, other long, cost long")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS main_rows, CAST(ceil(2 * sum(n) / 10.0) * 10 AS BIGINT) AS join_cost FROM {_TOUCH_SQL} x")
def tree_join_cost(spark, sf_dir):
    """Rows that hyper joins read of the main table, and the join cost of its tree for 10 workers."""
    t = _median(spark, sf_dir, "lineitem", "l_orderkey", 4)
    asks = [{"l_orderkey": b["l_orderkey"]} for b in _boxes(spark, sf_dir)]
    main = joins.main_table_rows({n.nid: n.size for n in t.leaves}, [{n.nid for n in t.touched(a)} for a in asks])
    cost = trees.join_cost(t, [(a, {"l_orderkey"}) for a in asks], {"l_orderkey"}, 10)
    return spark.createDataFrame([(main, int(cost))], "main_rows long, join_cost long")


@query(f"""WITH l AS {_leaf_sql('lineitem', 'l_orderkey', 3)}, t AS (SELECT CASE WHEN leaf >= 8 THEN leaf // 2 ELSE leaf END AS node, min(lo) AS lo, max(hi) AS hi FROM l GROUP BY 1)
    SELECT q.query_id, (SELECT count(*) FROM t WHERE q_lo <= hi AND lo <= q_hi) AS tops, (SELECT count(*) FROM l WHERE q_lo <= hi AND lo <= q_hi) AS blocks,
        (SELECT CAST(sum(n) AS BIGINT) FROM l WHERE q_lo <= hi AND lo <= q_hi) AS n_rows, (SELECT sum(hi - lo) FROM t WHERE q_lo <= hi AND lo <= q_hi) AS key_length FROM {_ASK_SQL} q""")
def join_side_report(spark, sf_dir):
    t = _median(spark, sf_dir, "lineitem", "l_orderkey", 3)
    found = joins.side_report(t, [{"l_orderkey": b["l_orderkey"]} for b in _boxes(spark, sf_dir)], "l_orderkey", 2)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "query_id long, tops long, blocks long, n_rows long, key_length double")


@query(f"""WITH a AS (SELECT q.query_id, count(*) AS blocks, sum(n) AS rows FROM {_leaf_sql(*TREES['a'])} l JOIN {_ASK_SQL} q ON q_lo <= hi AND lo <= q_hi GROUP BY 1),
    b AS (SELECT q.query_id, count(*) AS blocks, sum(n) AS rows FROM {_leaf_sql(*TREES['b'])} l JOIN {_ASK_SQL} q ON q_lo <= hi AND lo <= q_hi GROUP BY 1)
    SELECT a.query_id, CASE WHEN b.blocks >= a.blocks THEN 'orders' ELSE 'lineitem' END AS left_table, CAST(a.rows + b.rows AS BIGINT) AS hyper,
        CAST(CASE WHEN b.blocks >= a.blocks THEN a.rows + 3 * b.rows ELSE b.rows + 3 * a.rows END AS BIGINT) AS shuffled FROM a JOIN b ON a.query_id = b.query_id""")
def static_join_costs(spark, sf_dir):
    """Joins of orders and lineitem on the order key for each box's range, the side of fewer blocks on the left."""
    made, rows = {k: _median(spark, sf_dir, *TREES[k]) for k in "ab"}, []
    for i, box in enumerate(_boxes(spark, sf_dir)):
        sides, size = [], {}
        for table, key, _ in TREES.values():
            hit = made["a" if table == "orders" else "b"].touched({key: box["l_orderkey"]})
            sides.append((table, key, len(hit)))
            size[table] = sum(n.size for n in hit)
        left, right = joins.smaller_left(*sides)
        rows.append((i, left[0], *(joins.static_cost(size[left[0]], size[right[0]], h) for h in (True, False))))
    return spark.createDataFrame(rows, "query_id long, left_table string, hyper long, shuffled long")


@query("SELECT CAST(3 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier) x) AS BIGINT) AS cost")
def chain_shuffle_cost(spark, sf_dir):
    nation, supplier = T.load(spark, sf_dir, "nation"), T.load(spark, sf_dir, "supplier")
    held = supplier.select("s_nationkey").distinct().count()
    return spark.createDataFrame([(joins.step_cost(nation.count(), held),)], "cost long")


_KEY_WIDTHS = "max(length(CAST(o_orderkey AS VARCHAR))) + max(length(CAST(o_custkey AS VARCHAR)))"


@query(f"""SELECT round((SELECT count(*) FROM orders WHERE o_totalprice < 100000) * CAST(w AS DOUBLE) / (SELECT count(*) FROM orders) / CAST(t AS DOUBLE), 9) AS ratio
    FROM (SELECT {_KEY_WIDTHS} AS w, {_KEY_WIDTHS} + max(length(o_orderstatus)) + max(length(o_orderpriority)) AS t FROM orders) x""")
def bytes_ratio(spark, sf_dir):
    df = T.load(spark, sf_dir, "orders")
    width = lambda c: F.max(F.length(F.col(c).cast("string")))
    read, every = width("o_orderkey") + width("o_custkey"), width("o_orderkey") + width("o_custkey") + width("o_orderstatus") + width("o_orderpriority")
    return df.agg(F.round(F.count_if(F.col("o_totalprice") < 100000) * read.cast("double") / F.count("*") / every.cast("double"), 9).alias("ratio"))


# Selection, order and report

_CAND_SQL = f"(SELECT * FROM {_values([(t, c) for t, cs in T.CANDIDATES.items() for c in cs], 'table_name, col')})"
_SIDES_SQL = f"(SELECT query_id, ord, 0 AS side, left_table AS table_name, left_col AS col, right_table AS partner FROM {_EDGE_SQL} a UNION ALL SELECT query_id, ord, 1, right_table, right_col, left_table FROM {_EDGE_SQL} b)"


@query(f"SELECT f.table_name, f.col FROM (SELECT table_name, col, row_number() OVER (PARTITION BY table_name ORDER BY query_id, ord, side) AS r FROM {_SIDES_SQL} s) f JOIN {_CAND_SQL} c ON f.table_name = c.table_name AND f.col = c.col WHERE r = 1")
def keys_ad_mto(spark, sf_dir):
    return select.first_used(workload.edges(spark))


@query()
def keys_paw(spark, sf_dir):
    return spark.createDataFrame([], "table_name string, col string")


@query(f"""SELECT table_name, col, score, place FROM (
        SELECT s.table_name, s.col, CAST(sum(r.n_rows) AS BIGINT) AS score, row_number() OVER (PARTITION BY s.table_name ORDER BY sum(r.n_rows) DESC, s.col) AS place
        FROM {_SIDES_SQL} s JOIN ({ORACLE_SQL['profile_rowcounts']}) r ON s.partner = r.table_name JOIN {_CAND_SQL} c ON s.table_name = c.table_name AND s.col = c.col
        GROUP BY s.table_name, s.col) x WHERE place <= 2""")
def keys_topk(spark, sf_dir):
    return select.ranked_keys(workload.edges(spark), profile_rowcounts(spark, sf_dir), 2)


_LINKS = [("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("nation", "n_nationkey", "customer", "c_nationkey")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, x.n + 3.0 * y.n AS csy, {'1.2 * (x.n + y.n)' if i == 0 else 'x.n + 3.0 * y.n'} AS chy FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM {a}) x, (SELECT CAST(count(*) AS DOUBLE) AS n FROM {b}) y" for i, (a, _, b, _) in enumerate(_LINKS)))
def edge_weights(spark, sf_dir):
    n = {r.table_name: float(r.n_rows) for r in profile_rowcounts(spark, sf_dir).collect()}
    return spark.createDataFrame([(a, b, *order.edge_weight(n[a], n[b], i == 0)) for i, (a, _, b, _) in enumerate(_LINKS)], "a string, b string, csy double, chy double")


#: By hand: the hyper join of orders and lineitem spares most; then customer (orders + 3 customer) is cheaper than supplier
#: (lineitem + 3 supplier); nation follows customer without a shuffle, region after it, and supplier is left.
_SPANNING = [(0, "orders", "lineitem", 1), (1, "orders", "customer", -1), (2, "customer", "nation", 1), (3, "nation", "region", -1), (4, "lineitem", "supplier", -1)]
#: By hand: a chain of joins, of which every other one meets a table of the step before that has led none.
_WRITTEN = [(0, "region", "nation", 1), (1, "nation", "customer", -1), (2, "customer", "orders", 1), (3, "orders", "lineitem", -1), (4, "lineitem", "supplier", 1)]


@query(f"SELECT * FROM {_values(_SPANNING, 'step, seen, new, label')}")
def mst_order(spark, sf_dir):
    n = {r.table_name: r.n_rows for r in profile_rowcounts(spark, sf_dir).collect()}
    blocks: dict = {}
    for a, ca, b, cb in workload.WORKLOAD[3][1]:
        blocks.setdefault(a, {})[ca] = n[a]
        blocks.setdefault(b, {})[cb] = n[b]
    _, path = order.spanning(blocks, workload.WORKLOAD[3][1], {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"]})
    return spark.createDataFrame([(i, *p) for i, p in enumerate(path)], "step long, seen string, new string, label long")


@query(f"SELECT * FROM {_values(_WRITTEN, 'step, seen, new, label')}")
def syntactic_order(spark, sf_dir):
    path = order.syntactic([(a, b) for a, _, b, _ in workload.WORKLOAD[3][1]])
    return spark.createDataFrame([(i, *p) for i, p in enumerate(path)], "step long, seen string, new string, label long")


@query()
def query_cost_report(spark, sf_dir):
    return select.Evaluation(spark, sf_dir).compare()


@query()
def table_cost_report(spark, sf_dir):
    report = select.Evaluation(spark, sf_dir)
    report.compare()
    return report.tables()


@query()
def layout_build_times(spark, sf_dir):
    report = select.Evaluation(spark, sf_dir)
    report.compare()
    return report.times()


@query()
def block_size_sweep(spark, sf_dir):
    return select.sweep(spark, sf_dir, [8, 32], [1, 3], skip=(8,))


@query()
def model_reduction(spark, sf_dir):
    """Rows per query of each strategy, and how many per cent fewer than without join keys."""
    each = select.Evaluation(spark, sf_dir).compare().groupBy("model").agg(F.avg(F.col("read_rows") + F.col("chain_rows")).alias("rows_per_query"))
    paw = each.where("model = 'paw'").select(F.col("rows_per_query").alias("paw"))
    return each.crossJoin(F.broadcast(paw)).select("model", "rows_per_query", F.round(100 * (1 - F.col("rows_per_query") / F.col("paw")), 1).alias("fewer_pct"))


@query()
def model_pivot(spark, sf_dir):
    return select.pivot(query_cost_report(spark, sf_dir))
