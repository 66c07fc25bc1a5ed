"""Analytical SQL of the workloads, over the tables at hand. Each text runs in Spark and in an independent engine."""

from __future__ import annotations

SQL: dict[str, str] = {
    "tpch_q1": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS
            sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 4) AS
            avg_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
        FROM lineitem
        WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '68' DAY
        GROUP BY l_returnflag, l_linestatus
        ORDER BY 1, 2""",
    "tpch_q2": """
        SELECT s_name, p_partkey, round(l_extendedprice, 2) AS price
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON
            s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE p_size < 20 AND p_type LIKE '%O' AND r_name = 'EUROPE' AND l_extendedprice = (SELECT
            min(l2.l_extendedprice)
        FROM lineitem l2
        WHERE l2.l_partkey = p_partkey)""",
    "tpch_q3": """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(o_orderdate AS DATE) AS
            odate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'FURNITURE' AND o_orderdate < DATE '1997-03-17' AND l_shipdate > DATE '1997-03-17'
        GROUP BY l_orderkey, o_orderdate
        ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q4": """
        SELECT o_orderpriority, count(*) AS n
        FROM orders
        WHERE o_orderdate >= DATE '1996-05-01' AND o_orderdate < DATE '1996-05-01' + INTERVAL '3' MONTH AND EXISTS
            (SELECT 1
        FROM lineitem
        WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY)
        GROUP BY o_orderpriority
        ORDER BY 1""",
    "tpch_q5": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
            AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE
            '1996-01-01' AND o_orderdate < DATE '1997-01-01'
        GROUP BY n_name""",
    "tpch_q6": """
        SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue
        FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR AND l_discount
            BETWEEN 0.06 AND 0.08 AND l_quantity < 25""",
    "tpch_q7": """
        SELECT supp, cust, CAST(yr AS BIGINT) AS yr, round(sum(volume), 4) AS revenue
        FROM (SELECT n1.n_name AS supp, n2.n_name AS cust, extract(year
        FROM l_shipdate) AS yr, l_extendedprice * (1 - l_discount) AS volume
        FROM supplier, lineitem, orders, customer, nation n1, nation n2
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey =
            n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR
            (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE
            '1998-12-31') s
        GROUP BY supp, cust, yr""",
    "tpch_q8": """
        SELECT CAST(yr AS BIGINT) AS yr, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume),
            6) AS share
        FROM (SELECT extract(year
        FROM o_orderdate) AS yr, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
        FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND
            c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey =
            n2.n_nationkey AND p_type = 'PROMO') x
        GROUP BY yr""",
    "tpch_q9": """
        SELECT n_name, CAST(extract(year
        FROM o_orderdate) AS BIGINT) AS yr, round(sum(l_extendedprice * (1 - l_discount)), 4) AS profit
        FROM part, supplier, lineitem, orders, nation
        WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey
            AND p_name LIKE '%blue%'
        GROUP BY n_name, extract(year
        FROM o_orderdate)""",
    "tpch_q10": """
        SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
        FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate <
            DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name
        ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": """
        SELECT l_partkey, round(sum(l_extendedprice), 2) AS val
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey < 8
        GROUP BY l_partkey
        HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey < 8)""",
    "tpch_q12": """
        SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT)
            AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS
            low
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate
            < DATE '1997-01-01'
        GROUP BY l_returnflag""",
    "tpch_q13": """
        SELECT c_count, count(*) AS custdist
        FROM (SELECT c_custkey, count(o_orderkey)
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%'
        GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
        GROUP BY c_count
        ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": """
        SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) /
            sum(l_extendedprice * (1 - l_discount)), 6) AS promo
        FROM lineitem, part
        WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""",
    "tpch_q15": """
        SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt
        FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MED%' AND p_size IN (4, 9, 14, 19, 23,
            36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey
        FROM supplier
        WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size""",
    "tpch_q16": """
        SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly
        FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.6 * avg(l_quantity)
        FROM lineitem l2
        WHERE l2.l_partkey = p_partkey)""",
    "tpch_q17": """
        SELECT c_name, c_custkey, o_orderkey, round(o_totalprice, 2) AS price, round(sum(l_quantity), 2) AS qty
        FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey
        FROM lineitem
        GROUP BY l_orderkey
        HAVING sum(l_quantity) > 220) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_totalprice
        ORDER BY price DESC, o_orderkey LIMIT 100""",
    "tpch_q18": """
        SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND
            15) OR (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1
            AND 30) OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 40)""",
    "tpch_q19": """
        SELECT s_name
        FROM supplier, nation
        WHERE s_suppkey IN (SELECT l_suppkey
        FROM lineitem l0
        WHERE l0.l_partkey IN (SELECT p_partkey
        FROM part
        WHERE p_name LIKE 'b%') AND l0.l_quantity > (SELECT 0.5 * avg(l_quantity)
        FROM lineitem l1
        WHERE l1.l_partkey = l0.l_partkey AND l1.l_suppkey = l0.l_suppkey)) AND s_nationkey = n_nationkey AND n_name =
            'NATION_7'""",
    "tpch_q20": """
        SELECT s_name, count(*) AS numwait
        FROM supplier, lineitem l1, orders, nation
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate >
            o_orderdate + INTERVAL '60' DAY AND EXISTS (SELECT 1
        FROM lineitem l2
        WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1
        FROM lineitem l3
        WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL
            '60' DAY) AND s_nationkey = n_nationkey
        GROUP BY s_name
        ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q21": """
        SELECT code, count(*) AS n, round(sum(c_acctbal), 2) AS total
        FROM (SELECT substring(c_name
        FROM 10 FOR 2) AS code, c_acctbal
        FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal)
        FROM customer
        WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1
        FROM orders
        WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) x
        GROUP BY code""",
    "job_min": """
        SELECT min(c_name) AS first_customer, min(p_name) AS first_part, min(s_name) AS first_supplier
        FROM customer, orders, lineitem, part, supplier, nation, region
        WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND
            s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name IN ('ASIA', 'EUROPE') AND p_name NOT LIKE
            '%anvil%' AND p_size > 10 AND o_orderpriority LIKE '1%' AND l_quantity IS NOT NULL""",
    "job_count": """
        SELECT count(*) AS n
        FROM customer, orders, lineitem
        WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_acctbal > 5000 AND o_totalprice < 200000 AND
            l_quantity > 45""",
    "join_inner": """
        SELECT n_name, count(*) AS n
        FROM nation INNER JOIN customer ON n_nationkey = c_nationkey
        GROUP BY n_name""",
    "join_left": """
        SELECT c_custkey, o_orderkey
        FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000""",
    "join_full": """
        SELECT coalesce(a.k, b.k) AS k, a.n AS an, b.n AS bn
        FROM (SELECT o_custkey AS k, count(*) AS n
        FROM orders
        WHERE o_orderpriority = '1-URGENT'
        GROUP BY o_custkey) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n
        FROM orders
        WHERE o_orderpriority = '5-LOW'
        GROUP BY o_custkey) b ON a.k = b.k""",
    "join_semi": """
        SELECT count(*) AS n
        FROM orders
        WHERE o_custkey IN (SELECT c_custkey
        FROM customer
        WHERE c_mktsegment = 'BUILDING')""",
    "join_anti": """
        SELECT count(*) AS n
        FROM orders o
        WHERE NOT EXISTS (SELECT 1
        FROM lineitem
        WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')""",
    "join_null_aware_anti": """
        SELECT count(*) AS n
        FROM customer
        WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, -1)
        FROM nation
        WHERE n_regionkey = 1)""",
    "join_theta": """
        SELECT count(*) AS n
        FROM lineitem l1
        WHERE EXISTS (SELECT 1
        FROM lineitem l2
        WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)""",
    "join_cross": """
        SELECT a.n AS n_urgent, b.n AS n_low
        FROM (SELECT count(*) AS n
        FROM orders
        WHERE o_orderpriority = '1-URGENT') a, (SELECT count(*) AS n
        FROM orders
        WHERE o_orderpriority = '5-LOW') b""",
    "join_self": """
        SELECT a.n_name AS x, b.n_name AS y
        FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "join_disjunctive": """
        SELECT count(*) AS n
        FROM lineitem, orders
        WHERE (l_orderkey = o_orderkey AND o_orderstatus = 'F' AND l_quantity < 10) OR (l_orderkey = o_orderkey AND
            o_orderstatus = 'O' AND l_quantity > 40)""",
    "agg_rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q
        FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "agg_grouping": """
        SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS BIGINT) AS
            lvl, count(*) AS n
        FROM orders
        GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "agg_distinct": """
        SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts
        FROM lineitem
        GROUP BY l_returnflag""",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14",
    "agg_stddev": """
        SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(avg(l_quantity), 6) AS m,
            round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov
        FROM lineitem
        GROUP BY l_returnflag""",
    "agg_conditional": """
        SELECT CAST(sum(CASE WHEN l_quantity BETWEEN 1 AND 20 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN
            l_quantity BETWEEN 21 AND 40 THEN 1 ELSE 0 END) AS BIGINT) AS mid, round(avg(CASE WHEN l_returnflag = 'N'
            THEN l_extendedprice END), 4) AS n_price
        FROM lineitem""",
    "agg_two_level": """
        SELECT n, count(*) AS customers
        FROM (SELECT o_custkey, count(*) AS n
        FROM orders
        GROUP BY o_custkey) x
        GROUP BY n""",
    "agg_global": """
        SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_orderkey) AS n, round(avg(o_totalprice), 4) AS
            m
        FROM orders""",
    "win_rank": """
        SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey
        ORDER BY c_acctbal DESC) AS BIGINT) AS rk
        FROM customer""",
    "win_partition_ratio": """
        SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS rev, round(sum(p_retailprice) * 100 /
            sum(sum(p_retailprice)) OVER (PARTITION BY p_brand), 6) AS ratio
        FROM part
        GROUP BY p_brand, p_type""",
    "win_avg_deviation": """
        SELECT *
        FROM (SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS s, round(avg(sum(p_retailprice)) OVER (PARTITION
            BY p_brand), 6) AS a
        FROM part
        GROUP BY p_brand, p_type) x
        WHERE abs(s - a) / a > 0.1""",
    "win_cumulative": """
        SELECT odate, round(sum(s) OVER (ORDER BY odate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS
            running, max(n) OVER (ORDER BY odate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most
        FROM (SELECT CAST(o_orderdate AS DATE) AS odate, sum(o_totalprice) AS s, count(*) AS n
        FROM orders
        WHERE o_orderdate < DATE '1995-07-01'
        GROUP BY CAST(o_orderdate AS DATE)) x""",
    "win_topn": """
        SELECT *
        FROM (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS s, CAST(rank() OVER (PARTITION BY l_suppkey
        ORDER BY sum(l_extendedprice) DESC, l_partkey) AS BIGINT) AS rk
        FROM lineitem
        GROUP BY l_suppkey, l_partkey) x
        WHERE rk <= 3""",
    "win_both_ends": """
        SELECT a.rk, a.p_partkey AS best, b.p_partkey AS worst
        FROM (SELECT p_partkey, CAST(rank() OVER (ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rk
        FROM part) a JOIN (SELECT p_partkey, CAST(rank() OVER (ORDER BY p_retailprice, p_partkey) AS BIGINT) AS rk
        FROM part) b ON a.rk = b.rk
        WHERE a.rk <= 10""",
    "win_rank_offset": """
        WITH v AS (SELECT o_orderpriority AS pr, CAST(extract(year
        FROM o_orderdate) AS BIGINT) AS yr, count(*) AS n
        FROM orders
        GROUP BY o_orderpriority, extract(year
        FROM o_orderdate)), r AS (SELECT pr, yr, n, rank() OVER (PARTITION BY pr
        ORDER BY yr) AS rn
        FROM v) SELECT a.pr, a.yr, a.n, b.n AS psum, c.n AS nsum
        FROM r a, r b, r c
        WHERE a.pr = b.pr AND a.pr = c.pr AND a.rn = b.rn + 1 AND a.rn = c.rn - 1""",
    "win_rollup_rank": """
        SELECT l_returnflag, l_linestatus, n, CAST(rank() OVER (PARTITION BY lvl
        ORDER BY n DESC) AS BIGINT) AS rk
        FROM (SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS lvl,
            count(*) AS n
        FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus)) x""",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": """
        SELECT src, count(*) AS n
        FROM (SELECT 'c' AS src, c_nationkey AS k
        FROM customer
        UNION ALL SELECT 's', s_nationkey
        FROM supplier) x
        GROUP BY src""",
    "set_intersect": """
        SELECT o_custkey AS k
        FROM orders
        WHERE o_orderpriority = '1-URGENT'
        INTERSECT SELECT o_custkey
        FROM orders
        WHERE o_orderpriority = '5-LOW'""",
    "set_except": """
        SELECT o_custkey AS k
        FROM orders
        WHERE o_orderpriority = '1-URGENT'
        EXCEPT SELECT o_custkey
        FROM orders
        WHERE o_orderpriority = '5-LOW'""",
    "scalar_case": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS code, CASE WHEN o_totalprice
            > 250000 THEN 'high' ELSE 'low' END AS band
        FROM orders""",
    "scalar_coalesce": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer",
    "scalar_cast": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(round(CAST(o_totalprice AS DECIMAL(15, 4)), 2) AS
            DECIMAL(15, 2)) AS p, CAST(o_custkey AS INT) AS c
        FROM orders""",
    "scalar_substr": """
        SELECT c_custkey, substring(c_name, 1, 8) AS a, substring(c_mktsegment
        FROM 2 FOR 3) AS b, upper(c_name) AS u
        FROM customer""",
    "scalar_like": """
        SELECT p_partkey, p_name
        FROM part
        WHERE p_name LIKE '%a%l' AND p_name NOT LIKE 'b%' AND p_size IN (1, 5, 9) AND p_brand IS NOT NULL""",
    "scalar_date": """
        SELECT CAST(extract(year
        FROM o_orderdate) AS BIGINT) AS yr, CAST(extract(month
        FROM o_orderdate) AS BIGINT) AS mo, count(*) AS n
        FROM orders
        WHERE o_orderdate BETWEEN DATE '1996-01-31' - INTERVAL '14' DAY AND DATE '1996-01-31' + INTERVAL '10' MONTH
        GROUP BY extract(year
        FROM o_orderdate), extract(month
        FROM o_orderdate)""",
    "scalar_concat": """
        SELECT c_custkey, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR(10)) AS tag, CAST(length(c_name) AS BIGINT)
            AS len
        FROM customer""",
    "scalar_abs_round": """
        SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) * 1.0 AS c, greatest(s_acctbal, 0.0) AS g,
            least(s_acctbal, 0.0) AS l
        FROM supplier""",
    "subq_scalar": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)",
    "subq_case": """
        SELECT CASE WHEN (SELECT count(*)
        FROM lineitem
        WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_extendedprice), 4)
        FROM lineitem
        WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT round(avg(l_discount), 6)
        FROM lineitem) END AS bucket
        FROM region
        WHERE r_regionkey = 1""",
    "subq_correlated": """
        SELECT c_custkey
        FROM customer c
        WHERE c_acctbal > (SELECT 1.2 * avg(c2.c_acctbal)
        FROM customer c2
        WHERE c2.c_nationkey = c.c_nationkey)""",
    "subq_correlated_count": """
        SELECT s_suppkey
        FROM supplier
        WHERE (SELECT count(*)
        FROM lineitem
        WHERE l_suppkey = s_suppkey AND ((l_quantity < 5 AND l_returnflag = 'A') OR (l_quantity > 45 AND l_returnflag =
            'R'))) > 20""",
    "subq_exists": """
        SELECT count(*) AS n
        FROM customer
        WHERE EXISTS (SELECT 1
        FROM orders
        WHERE o_custkey = c_custkey AND o_totalprice > 450000)""",
    "subq_in_having": """
        SELECT o_custkey, round(sum(o_totalprice), 2) AS s
        FROM orders
        GROUP BY o_custkey
        HAVING sum(o_totalprice) > (SELECT 2 * avg(s)
        FROM (SELECT sum(o_totalprice) AS s
        FROM orders
        GROUP BY o_custkey) t)""",
    "cte_nested": """
        WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s
        FROM orders
        GROUP BY o_custkey), b AS (SELECT avg(s) AS m
        FROM a) SELECT count(*) AS n
        FROM a, b
        WHERE a.s > b.m""",
    "order_limit": "SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 100",
    "smoke_1": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey",
    "smoke_2": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC",
    "smoke_3": "SELECT p_type, count(*) AS n FROM part GROUP BY p_type",
    "smoke_4": "SELECT p_name, p_size FROM part WHERE p_size < 10",
    "smoke_5": """
        SELECT o_orderkey, c_name
        FROM orders INNER JOIN customer ON o_custkey = c_custkey
        ORDER BY o_orderkey""",
    "smoke_6": """
        SELECT l_orderkey, p_name, c_name, round(l_quantity * p_retailprice, 2) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON
            o_custkey = c_custkey""",
    "smoke_7": """
        SELECT c_name, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 1) AS mean
        FROM customer JOIN orders ON c_custkey = o_custkey
        GROUP BY c_name
        ORDER BY total DESC""",
    "smoke_8": """
        SELECT p_name, count(DISTINCT l_orderkey) AS orders_, round(sum(l_quantity), 2) AS q
        FROM part JOIN lineitem ON p_partkey = l_partkey
        GROUP BY p_name""",
    "smoke_9": """
        SELECT c_name, total, CAST(rank() OVER (ORDER BY total DESC) AS BIGINT) AS rk
        FROM (SELECT c_name, round(sum(o_totalprice), 2) AS total
        FROM customer JOIN orders ON c_custkey = o_custkey
        GROUP BY c_name) x""",
    "smoke_10": """
        SELECT c_name
        FROM customer
        WHERE c_custkey IN (SELECT o_custkey
        FROM orders
        GROUP BY o_custkey
        HAVING sum(o_totalprice) > 3000000)""",
    "smoke_11": """
        SELECT 'customer' AS t, count(*) AS n
        FROM customer
        UNION ALL SELECT 'orders', count(*)
        FROM orders
        UNION ALL SELECT 'part', count(*)
        FROM part""",
}
