"""Queries in the Oracle dialect over the benchmark's tables, each with its DuckDB equivalent.

``both(name, text)`` is a query that both read alike; ``pair(name, oracle, duckdb)`` one whose dialects differ.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}
DUCKDB: dict[str, str] = {}


def pair(name: str, oracle: str, duckdb: str) -> None:
    assert name not in ORACLE, name
    ORACLE[name], DUCKDB[name] = oracle, duckdb


def both(name: str, text: str) -> None:
    pair(name, text, text)


# flagship: (+) join, DECODE, NVL, ranking, null order

pair(
    "flagship_revenue",
    """
    SELECT n.n_name, DECODE(n.n_regionkey, 0, 'AFRICA', 1, 'AMERICA', 'OTHER') AS area, COUNT(DISTINCT c.c_custkey) AS customers,
           ROUND(SUM(NVL(l.l_extendedprice * (1 - l.l_discount), 0)), 2) AS revenue,
           CAST(RANK() OVER (ORDER BY SUM(NVL(l.l_extendedprice * (1 - l.l_discount), 0)) DESC) AS INTEGER) AS place
    FROM nation n, customer c, orders o, lineitem l
    WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey(+) AND o.o_orderkey = l.l_orderkey(+)
    GROUP BY n.n_name, n.n_regionkey
    HAVING COUNT(*) > 1
    ORDER BY revenue DESC
    """,
    """
    SELECT n.n_name, CASE n.n_regionkey WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' ELSE 'OTHER' END AS area, COUNT(DISTINCT c.c_custkey) AS customers,
           ROUND(SUM(COALESCE(l.l_extendedprice * (1 - l.l_discount), 0)), 2) AS revenue,
           CAST(RANK() OVER (ORDER BY SUM(COALESCE(l.l_extendedprice * (1 - l.l_discount), 0)) DESC) AS BIGINT) AS place
    FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
    GROUP BY n.n_name, n.n_regionkey
    HAVING COUNT(*) > 1
    """,
)

# scans, projection, filters

both("scan_star", "SELECT * FROM nation")
both("scan_qualified_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
both("project_alias", "SELECT c_custkey AS id, c_name nm, c_acctbal * 2 AS \"twice\" FROM customer")
both("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
pair("unique_rows", "SELECT UNIQUE o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
pair("dual_expression", "SELECT 1 + 2 * 3 AS a, 'x' || 'y' AS b FROM dual", "SELECT 1 + 2 * 3 AS a, 'x' || 'y' AS b")
pair("dual_sys", "SELECT 5 AS five FROM sys.dual", "SELECT 5 AS five")
both("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT (o_orderkey > 100 OR o_orderstatus = 'O')")
pair("filter_not_equal_forms", "SELECT n_nationkey FROM nation WHERE n_nationkey != 1 AND n_nationkey ^= 2 AND n_nationkey <> 3", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 2, 3)")
both("filter_in_list", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_size NOT IN (1, 2, 3)")
both("filter_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
both("filter_not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
both("filter_not_in_with_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 3) FROM region)")
both("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_custkey NOT BETWEEN 10 AND 500")
both("filter_between_dates", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'")
both("filter_like_escape", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_name NOT LIKE '%!_%' ESCAPE '!'")
both("filter_is_null", "SELECT p_partkey, NULLIF(p_size, 11) AS s FROM part WHERE NULLIF(p_size, 11) IS NULL OR NULLIF(p_size, 12) IS NOT NULL AND p_size < 3")
both("filter_exists_semi", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
both("filter_not_exists_anti", "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
pair("any_subquery", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_acctbal > 0)", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT min(c_acctbal) FROM customer WHERE c_acctbal > 0)")
pair("any_equal_subquery", "SELECT n_nationkey FROM nation WHERE n_regionkey = SOME (SELECT r_regionkey FROM region WHERE r_regionkey > 2)", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)")
pair("all_subquery", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT s_acctbal FROM supplier)", "SELECT s_suppkey FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)")
pair("all_empty_set", "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 100)", "SELECT COUNT(*) AS n FROM nation")
pair("all_with_null", "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey > ALL (SELECT NULLIF(r_regionkey, 4) FROM region)", "SELECT CAST(0 AS BIGINT) AS n")
pair("any_list", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (3, 5, 7) AND n_nationkey < ALL (6, 9)", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (3, 5)")
both("scalar_subquery_select", "SELECT r.r_regionkey, (SELECT COUNT(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS nations FROM region r")
both("scalar_subquery_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
both("correlated_subquery", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
both("derived_table", "SELECT t.k, t.n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) t WHERE t.n > 5")
both("nested_derived", "SELECT a.x + 1 AS y FROM (SELECT b.x FROM (SELECT n_nationkey AS x FROM nation WHERE n_nationkey < 10) b WHERE b.x > 2) a")
both("tuple_in", "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT l_orderkey, MIN(l_suppkey) FROM lineitem GROUP BY l_orderkey)")

# joins

both("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0")
both("join_theta", "SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey AND n.n_nationkey < 12")
both("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
both("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
both("join_right", "SELECT n.n_name, r.r_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20")
both("join_full", "SELECT a.k, b.j FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS j FROM nation WHERE n_nationkey > 10) b ON a.k = b.j")
both("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
both("join_natural", "SELECT k, v, w FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey AS w FROM nation) b")
both("join_using", "SELECT k, v, w FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT n_nationkey AS k, n_regionkey AS w FROM nation) b USING (k)")
both("join_self", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_four_way", "SELECT c.c_mktsegment, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2 GROUP BY c.c_mktsegment")
pair("plus_left", "SELECT o.o_orderkey, l.l_partkey FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey(+)", "SELECT o.o_orderkey, l.l_partkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
pair("plus_reversed", "SELECT o.o_orderkey, l.l_suppkey FROM orders o, lineitem l WHERE l.l_orderkey(+) = o.o_orderkey", "SELECT o.o_orderkey, l.l_suppkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
pair("plus_multi_column", "SELECT a.l_orderkey, b.l_partkey FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey(+) AND a.l_linenumber = b.l_linenumber(+)", "SELECT a.l_orderkey, b.l_partkey FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
pair("plus_chain", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r, nation n, supplier s WHERE r.r_regionkey = n.n_regionkey(+) AND n.n_nationkey = s.s_nationkey(+)", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey")
pair("plus_with_filter", "SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND c.c_acctbal > 5000", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 5000")
pair("plus_anti_idiom", "SELECT o.o_orderkey FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey(+) AND l.l_orderkey IS NULL", "SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE o.o_orderkey = l.l_orderkey)")
pair("plus_constant_in_on", "SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND o.o_orderstatus(+) = 'P'", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
pair("plus_mixed_inner", "SELECT n.n_name, c.c_custkey, o.o_orderkey FROM nation n, customer c, orders o WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey(+) AND n.n_regionkey = 3", "SELECT n.n_name, c.c_custkey, o.o_orderkey FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE n.n_regionkey = 3")
both("lateral_join", "SELECT r.r_regionkey, t.m FROM region r CROSS JOIN LATERAL (SELECT MAX(n.n_nationkey) AS m FROM nation n WHERE n.n_regionkey = r.r_regionkey) t")
pair("cross_apply", "SELECT r.r_regionkey, t.m FROM region r CROSS APPLY (SELECT MIN(n.n_nationkey) AS m FROM nation n WHERE n.n_regionkey = r.r_regionkey) t", "SELECT r.r_regionkey, min(n.n_nationkey) AS m FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey")

# aggregation

both("group_basic", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("group_ordinal", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2")
pair("group_expression", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)")
both("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MIN(o_totalprice) < 50000")
both("count_variants", "SELECT COUNT(*) AS a, COUNT(NULLIF(p_size, 11)) AS b, COUNT(DISTINCT p_brand) AS c, COUNT(DISTINCT NULLIF(p_type, 'PROMO')) AS d FROM part")
both("count_distinct_by_group", "SELECT c_nationkey, COUNT(DISTINCT c_mktsegment) AS segs, COUNT(DISTINCT c_custkey) AS custs FROM customer GROUP BY c_nationkey")
both("min_max_sum_avg", "SELECT p_type, MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi, ROUND(SUM(p_retailprice), 2) AS total, ROUND(AVG(p_retailprice), 4) AS mean FROM part GROUP BY p_type")
pair("sum_distinct", "SELECT p_type, SUM(DISTINCT p_size) AS s FROM part GROUP BY p_type", "SELECT p_type, CAST(SUM(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY p_type")
pair("stddev_variance", "SELECT p_brand, ROUND(STDDEV(p_retailprice), 4) AS sd, ROUND(VARIANCE(p_retailprice), 4) AS va, ROUND(VAR_POP(p_retailprice), 4) AS vp, ROUND(STDDEV_POP(p_retailprice), 4) AS sp FROM part GROUP BY p_brand", "SELECT p_brand, ROUND(COALESCE(stddev_samp(p_retailprice), 0), 4) AS sd, ROUND(COALESCE(var_samp(p_retailprice), 0), 4) AS va, ROUND(var_pop(p_retailprice), 4) AS vp, ROUND(stddev_pop(p_retailprice), 4) AS sp FROM part GROUP BY p_brand")
pair("stddev_single_row", "SELECT n_nationkey, STDDEV(n_regionkey) AS sd, VARIANCE(n_regionkey) AS va FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, CAST(0 AS DOUBLE) AS sd, CAST(0 AS DOUBLE) AS va FROM nation")
both("corr_covar", "SELECT l_returnflag, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c, ROUND(COVAR_POP(l_quantity, l_extendedprice), 2) AS cp, ROUND(COVAR_SAMP(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_returnflag")
both("regr", "SELECT l_linestatus, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS s, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 2) AS i, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY l_linestatus")
both("median_by_group", "SELECT c_mktsegment, ROUND(MEDIAN(c_acctbal), 4) AS m FROM customer GROUP BY c_mktsegment")
both("percentiles", "SELECT o_orderpriority, ROUND(PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS pc, PERCENTILE_DISC(0.75) WITHIN GROUP (ORDER BY o_totalprice) AS pd FROM orders GROUP BY o_orderpriority")
both("rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("grouping_sets", "SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
pair("grouping_id", "SELECT o_orderstatus, CAST(GROUPING(o_orderstatus) AS INTEGER) AS g, CAST(GROUPING_ID(o_orderstatus, o_orderpriority) AS INTEGER) AS gid, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, CAST(GROUPING(o_orderstatus) AS BIGINT) AS g, CAST(GROUPING(o_orderstatus, o_orderpriority) AS BIGINT) AS gid, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
pair("hypothetical_rank", "SELECT c_mktsegment, RANK(5000) WITHIN GROUP (ORDER BY c_acctbal) AS r, DENSE_RANK(5000) WITHIN GROUP (ORDER BY c_acctbal) AS dr, ROUND(PERCENT_RANK(5000) WITHIN GROUP (ORDER BY c_acctbal), 6) AS pr, ROUND(CUME_DIST(5000) WITHIN GROUP (ORDER BY c_acctbal), 6) AS cd FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, COUNT(*) FILTER (c_acctbal < 5000) + 1 AS r, COUNT(DISTINCT c_acctbal) FILTER (c_acctbal < 5000) + 1 AS dr, ROUND(COUNT(*) FILTER (c_acctbal < 5000) / COUNT(*), 6) AS pr, ROUND((COUNT(*) FILTER (c_acctbal <= 5000) + 1) / (COUNT(*) + 1), 6) AS cd FROM customer GROUP BY c_mktsegment")
pair("ratio_to_report", "SELECT s_suppkey, ROUND(RATIO_TO_REPORT(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS r FROM supplier", "SELECT s_suppkey, ROUND(s_acctbal / SUM(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS r FROM supplier")
pair("least_greatest_null_strict", "SELECT p_partkey, GREATEST(p_size, NULLIF(p_size, 11), 20) AS g, LEAST(p_size, NULLIF(p_size, 11), 20) AS l FROM part", "SELECT p_partkey, CASE WHEN p_size = 11 THEN NULL ELSE GREATEST(p_size, 20) END AS g, CASE WHEN p_size = 11 THEN NULL ELSE LEAST(p_size, 20) END AS l FROM part")
pair("listagg", "SELECT n_regionkey, LISTAGG(n_name, ', ') WITHIN GROUP (ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
pair("keep_first_last", "SELECT o_custkey, MIN(o_orderkey) KEEP (DENSE_RANK FIRST ORDER BY o_orderdate) AS f, MAX(o_orderkey) KEEP (DENSE_RANK LAST ORDER BY o_orderdate) AS l FROM orders GROUP BY o_custkey", "SELECT o_custkey, MIN(o_orderkey) FILTER (o_orderdate = lo) AS f, MAX(o_orderkey) FILTER (o_orderdate = hi) AS l FROM (SELECT *, MIN(o_orderdate) OVER (PARTITION BY o_custkey) AS lo, MAX(o_orderdate) OVER (PARTITION BY o_custkey) AS hi FROM orders) GROUP BY o_custkey")
pair("pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus = 'F') AS f, COUNT(*) FILTER (o_orderstatus = 'O') AS o, COUNT(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")

pair("unpivot", "SELECT k, what, price FROM (SELECT p_partkey AS k, p_retailprice AS a, NULLIF(p_retailprice * 2, p_retailprice * 2) AS b, p_retailprice * 3 AS c FROM part) UNPIVOT (price FOR what IN (a AS 'first', b, c AS 'third'))", "SELECT p_partkey AS k, 'first' AS what, p_retailprice AS price FROM part UNION ALL SELECT p_partkey, 'third', p_retailprice * 3 FROM part")

# windows

W = "PARTITION BY o_custkey ORDER BY o_orderkey"
pair("row_number", f"SELECT o_orderkey, ROW_NUMBER() OVER ({W}) AS rn FROM orders", f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER ({W}) AS INTEGER) AS rn FROM orders")
pair("rank_dense_rank", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part", "SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS d FROM part")
both("percent_rank_cume_dist", "SELECT s_suppkey, ROUND(PERCENT_RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd FROM supplier")
pair("ntile", "SELECT c_custkey, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer", "SELECT c_custkey, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS q FROM customer")
both("nth_value", "SELECT c_custkey, NTH_VALUE(c_name, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM customer")
both("lead_lag_default", f"SELECT o_orderkey, LAG(o_totalprice, 1, 0.0) OVER ({W}) AS prev, LEAD(o_totalprice, 2) OVER ({W}) AS later FROM orders")
both("first_last_value", f"SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER ({W}) AS f, LAST_VALUE(o_totalprice) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM orders")
pair("first_value_ignore_nulls", "SELECT p_partkey, FIRST_VALUE(NULLIF(p_size, 11)) IGNORE NULLS OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part", "SELECT p_partkey, FIRST_VALUE(NULLIF(p_size, 11) IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part")
pair("last_value_ignore_nulls_inside", "SELECT p_partkey, LAST_VALUE(NULLIF(p_size, 11) IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part", "SELECT p_partkey, LAST_VALUE(NULLIF(p_size, 11) IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part")
both("running_sum_rows", f"SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER ({W} ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders")
both("moving_avg_rows", f"SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
pair("range_interval_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS n FROM orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
both("range_numeric_frame", "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM customer")
both("frame_unbounded_following", f"SELECT o_orderkey, MAX(o_totalprice) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders")
both("partition_aggregates", "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n, MIN(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, MAX(c_acctbal) OVER (PARTITION BY c_mktsegment) - c_acctbal AS gap FROM customer")
pair("window_null_order", "SELECT p_partkey, RANK() OVER (ORDER BY NULLIF(p_size, 11) DESC) AS r FROM part", "SELECT p_partkey, CAST(RANK() OVER (ORDER BY NULLIF(p_size, 11) DESC NULLS FIRST) AS INTEGER) AS r FROM part")
both("top_n_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2")
pair("lag_diff", "SELECT event_id, ROUND(value - LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d FROM events", "SELECT event_id, ROUND(value - LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d FROM events")

# order and limits

pair("order_nulls_default_desc", "SELECT p_partkey, NULLIF(p_size, 11) AS s FROM part ORDER BY NULLIF(p_size, 11) DESC, p_partkey", "SELECT p_partkey, NULLIF(p_size, 11) AS s FROM part ORDER BY NULLIF(p_size, 11) DESC NULLS FIRST, p_partkey")
pair("order_nulls_default_asc", "SELECT p_partkey, NULLIF(p_size, 1) AS s FROM part ORDER BY NULLIF(p_size, 1), p_partkey", "SELECT p_partkey, NULLIF(p_size, 1) AS s FROM part ORDER BY NULLIF(p_size, 1) NULLS LAST, p_partkey")
pair("order_nulls_explicit", "SELECT p_partkey FROM part ORDER BY NULLIF(p_size, 11) DESC NULLS LAST, p_partkey", "SELECT p_partkey FROM part ORDER BY NULLIF(p_size, 11) DESC NULLS LAST, p_partkey")
pair("rownum_limit", "SELECT k FROM (SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DESC) WHERE ROWNUM <= 7", "SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DESC LIMIT 7")
pair("rownum_equals_one", "SELECT k FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey) WHERE ROWNUM = 1", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
pair("rownum_impossible", "SELECT COUNT(*) AS n FROM nation WHERE ROWNUM > 1", "SELECT CAST(0 AS BIGINT) AS n")
pair("rownum_before_aggregate", "SELECT COUNT(*) AS n FROM orders WHERE ROWNUM <= 25", "SELECT CAST(25 AS BIGINT) AS n")
pair("rownum_before_sort", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders WHERE ROWNUM < 11 ORDER BY o_totalprice)", "SELECT CAST(10 AS BIGINT) AS n")
pair("rownum_pagination", "SELECT k FROM (SELECT t.k, ROWNUM AS rn FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey) t WHERE ROWNUM <= 40) WHERE rn > 30", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 30")
pair("rownum_dense", "SELECT MIN(rn) AS lo, MAX(rn) AS hi, COUNT(DISTINCT rn) AS n FROM (SELECT ROWNUM AS rn, o_orderkey FROM orders)", "SELECT CAST(1 AS BIGINT) AS lo, COUNT(*) AS hi, COUNT(*) AS n FROM orders")
pair("top_k", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey FETCH FIRST 20 ROWS ONLY", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 20")
pair("offset_fetch", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey OFFSET 10 ROWS FETCH NEXT 15 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 10")
pair("fetch_with_ties", "SELECT p_partkey, p_size AS s FROM part ORDER BY s DESC FETCH FIRST 5 ROWS WITH TIES", "SELECT p_partkey, p_size AS s FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5")
both("order_by_alias_and_ordinal", "SELECT n_name AS label, n_regionkey FROM nation ORDER BY 2, label")

# set operations and factoring

both("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("intersect_rows", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
pair("minus_rows", "SELECT o_orderkey AS k FROM orders MINUS SELECT l_orderkey FROM lineitem", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
pair("set_chain_left_to_right", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 3", "(SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 3")
pair("set_parenthesised", "SELECT 1 AS k FROM dual UNION ALL (SELECT 2 FROM dual UNION ALL SELECT 2 FROM dual MINUS SELECT 3 FROM dual)", "SELECT 1 AS k UNION ALL (SELECT DISTINCT 2)")
both("cte_multi", "WITH a AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey), b AS (SELECT k FROM a WHERE n > 60) SELECT a.k, a.n FROM a JOIN b ON a.k = b.k")
both("cte_column_list", "WITH t (a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT b, a FROM t WHERE a < 6")
pair("recursive_cte", "WITH t (n, f) AS (SELECT 1, 1 FROM dual UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t", "WITH RECURSIVE t (n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t")
pair("recursive_cte_join", "WITH t (k, lvl) AS (SELECT n_nationkey, 1 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.lvl + 1 FROM nation n JOIN t ON FLOOR((n.n_nationkey - 1) / 3) = t.k WHERE n.n_nationkey > 0) SELECT k, lvl FROM t", "WITH RECURSIVE t (k, lvl) AS (SELECT n_nationkey, 1 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.lvl + 1 FROM nation n JOIN t ON (n.n_nationkey - 1) // 3 = t.k WHERE n.n_nationkey > 0) SELECT k, lvl FROM t")

# hierarchies: parent of k is floor((k - 1) / 3)

TREE = "(SELECT p_partkey AS id, p_name AS name, p_size AS sz, CASE WHEN p_partkey > 0 THEN FLOOR((p_partkey - 1) / 3) END AS parent FROM part)"
WALK = "WITH RECURSIVE h AS (SELECT id, name, sz, parent, 1 AS lvl, '/' || name AS path, name AS root, CAST(NULL AS VARCHAR) AS above FROM t WHERE {start} UNION ALL SELECT t.id, t.name, t.sz, t.parent, h.lvl + 1, h.path || '/' || t.name, h.root, h.name FROM t JOIN h ON t.parent = h.id {also})"
DTREE = "t AS (SELECT p_partkey AS id, p_name AS name, p_size AS sz, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent FROM part)"


def _walk(start: str, also: str = "") -> str:
    return WALK.format(start=start, also=also).replace("RECURSIVE h", f"RECURSIVE {DTREE}, h")


pair("connect_by_level", f"SELECT id, name, LEVEL AS lvl FROM {TREE} START WITH parent IS NULL CONNECT BY PRIOR id = parent", _walk("parent IS NULL") + " SELECT id, name, CAST(lvl AS BIGINT) AS lvl FROM h")
pair("connect_by_path", f"SELECT id, SYS_CONNECT_BY_PATH(name, '/') AS path FROM {TREE} START WITH id = 1 CONNECT BY PRIOR id = parent", _walk("id = 1") + " SELECT id, path FROM h")
pair("connect_by_where_after", f"SELECT id, LEVEL AS lvl FROM {TREE} WHERE sz > 20 AND LEVEL > 1 START WITH parent IS NULL CONNECT BY PRIOR id = parent", _walk("parent IS NULL") + " SELECT id, CAST(lvl AS BIGINT) AS lvl FROM h WHERE sz > 20 AND lvl > 1")
pair("connect_by_prior_right", f"SELECT id FROM {TREE} START WITH id IN (2, 3) CONNECT BY parent = PRIOR id", _walk("id IN (2, 3)") + " SELECT id FROM h")
pair("connect_by_filtered_edge", f"SELECT id, LEVEL * 10 AS l10 FROM {TREE} START WITH id = 0 CONNECT BY PRIOR id = parent AND sz > 10", _walk("id = 0", "WHERE t.sz > 10") + " SELECT id, CAST(lvl * 10 AS BIGINT) AS l10 FROM h")
pair("connect_by_upwards", f"SELECT id, LEVEL AS lvl FROM {TREE} START WITH id = 58 CONNECT BY PRIOR parent = id", f"WITH RECURSIVE {DTREE}, h AS (SELECT id, parent, 1 AS lvl FROM t WHERE id = 58 UNION ALL SELECT t.id, t.parent, h.lvl + 1 FROM t JOIN h ON t.id = h.parent) SELECT id, CAST(lvl AS BIGINT) AS lvl FROM h")
pair("connect_by_root_leaf", f"SELECT id, CONNECT_BY_ROOT name AS root, PRIOR name AS above, CONNECT_BY_ISLEAF AS leaf FROM {TREE} START WITH id IN (1, 2) CONNECT BY PRIOR id = parent", _walk("id IN (1, 2)") + " SELECT id, root, above, CAST(CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.parent = h.id) THEN 0 ELSE 1 END AS BIGINT) AS leaf FROM h")
pair("connect_by_order_siblings", f"SELECT name FROM (SELECT name, ROWNUM AS rn FROM (SELECT name FROM {TREE} START WITH id = 0 CONNECT BY PRIOR id = parent ORDER SIBLINGS BY id) WHERE ROWNUM <= 10) WHERE rn > 5", f"WITH RECURSIVE {DTREE}, h AS (SELECT id, name, [id] AS p FROM t WHERE id = 0 UNION ALL SELECT t.id, t.name, list_append(h.p, t.id) FROM t JOIN h ON t.parent = h.id) SELECT name FROM (SELECT name, row_number() OVER (ORDER BY p) AS rn FROM h) WHERE rn BETWEEN 6 AND 10")
pair("connect_by_aggregate", f"SELECT LEVEL AS lvl, COUNT(*) AS n, MAX(sz) AS hi FROM {TREE} START WITH parent IS NULL CONNECT BY PRIOR id = parent GROUP BY LEVEL", _walk("parent IS NULL") + " SELECT CAST(lvl AS BIGINT) AS lvl, COUNT(*) AS n, MAX(sz) AS hi FROM h GROUP BY lvl")
pair("connect_by_generator", "SELECT LEVEL AS n FROM dual CONNECT BY LEVEL <= 12", "SELECT CAST(range AS BIGINT) AS n FROM range(1, 13)")
pair("connect_by_nocycle", "SELECT id, LEVEL AS lvl FROM (SELECT n_nationkey AS id, MOD(n_nationkey + 1, 5) AS nxt FROM nation WHERE n_nationkey < 5) START WITH id = 0 CONNECT BY NOCYCLE PRIOR nxt = id", "SELECT CAST(range AS INTEGER) AS id, CAST(range + 1 AS BIGINT) AS lvl FROM range(5)")

# scalar functions

both("arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice * 2 + l_quantity / 4 - 1 AS charge, -l_quantity AS neg FROM lineitem")
pair("division_fractional", "SELECT n_nationkey, n_nationkey / 4 AS q FROM nation", "SELECT n_nationkey, n_nationkey / 4 AS q FROM nation")
pair("mod_power", "SELECT n_nationkey, MOD(n_nationkey, 7) AS m, MOD(-n_nationkey, 3) AS mn, MOD(n_nationkey, 0) AS mz, POWER(2, n_nationkey) AS p, n_nationkey ** 2 AS sq FROM nation", "SELECT n_nationkey, n_nationkey % 7 AS m, -n_nationkey % 3 AS mn, n_nationkey AS mz, power(2, n_nationkey) AS p, power(n_nationkey, 2) AS sq FROM nation")
pair("concat_null_safe", "SELECT p_partkey, p_name || NULLIF(p_brand, 'Brand#1') || ':' || NULLIF(p_type, 'PROMO') AS s, CONCAT(p_type, NULL) AS c FROM part", "SELECT p_partkey, p_name || COALESCE(NULLIF(p_brand, 'Brand#1'), '') || ':' || COALESCE(NULLIF(p_type, 'PROMO'), '') AS s, p_type AS c FROM part")
pair("nvl_nvl2_coalesce_nullif", "SELECT p_partkey, NVL(NULLIF(p_size, 11), -1) AS a, NVL2(NULLIF(p_type, 'PROMO'), 'set', 'unset') AS b, COALESCE(NULLIF(p_type, 'PROMO'), NULLIF(p_brand, 'Brand#1'), 'none') AS c FROM part", "SELECT p_partkey, COALESCE(NULLIF(p_size, 11), -1) AS a, CASE WHEN p_type = 'PROMO' THEN 'unset' ELSE 'set' END AS b, COALESCE(NULLIF(p_type, 'PROMO'), NULLIF(p_brand, 'Brand#1'), 'none') AS c FROM part")
pair("decode_null_matches", "SELECT p_partkey, DECODE(NULLIF(p_size, 11), NULL, 'eleven', 1, 'one', 2, 'two', 'many') AS d, DECODE(p_type, 'PROMO', 1) AS e FROM part", "SELECT p_partkey, CASE WHEN p_size = 11 THEN 'eleven' WHEN p_size = 1 THEN 'one' WHEN p_size = 2 THEN 'two' ELSE 'many' END AS d, CASE WHEN p_type = 'PROMO' THEN 1 END AS e FROM part")
both("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'part' END AS s FROM orders")
both("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' END AS s FROM customer")
pair("round_trunc_num", "SELECT s_suppkey, ROUND(s_acctbal, 1) AS r, TRUNC(s_acctbal) AS t0, TRUNC(s_acctbal, 1) AS t1, TRUNC(-s_acctbal, 1) AS tn, ROUND(s_acctbal / 1000) AS k FROM supplier", "SELECT s_suppkey, ROUND(s_acctbal, 1) AS r, trunc(s_acctbal) AS t0, CAST(sign(s_acctbal) * floor(CAST(abs(s_acctbal) AS DECIMAL(18, 4)) * 10) AS DOUBLE) / 10 AS t1, CAST(sign(-s_acctbal) * floor(CAST(abs(s_acctbal) AS DECIMAL(18, 4)) * 10) AS DOUBLE) / 10 AS tn, ROUND(s_acctbal / 1000) AS k FROM supplier")
pair("math_misc", "SELECT n_nationkey, ABS(n_nationkey - 12) AS a, CEIL(n_nationkey / 7) AS c, FLOOR(n_nationkey / 7) AS f, ROUND(SQRT(n_nationkey), 6) AS s, ROUND(EXP(n_nationkey / 10), 6) AS e, ROUND(LN(n_nationkey + 1), 6) AS l, ROUND(LOG(10, n_nationkey + 1), 6) AS lg, SIGN(n_nationkey - 3) AS sg FROM nation", "SELECT n_nationkey, abs(n_nationkey - 12) AS a, CAST(ceil(n_nationkey / 7) AS BIGINT) AS c, CAST(floor(n_nationkey / 7) AS BIGINT) AS f, round(sqrt(n_nationkey), 6) AS s, round(exp(n_nationkey / 10), 6) AS e, round(ln(n_nationkey + 1), 6) AS l, round(log10(n_nationkey + 1), 6) AS lg, CAST(sign(n_nationkey - 3) AS DOUBLE) AS sg FROM nation")
pair("substr_edge", "SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTR(p_name, 0, 2) AS b, SUBSTR(p_name, -3) AS c, SUBSTR(p_name, -4, 2) AS d FROM part", "SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, 1, 2) AS b, right(p_name, 3) AS c, substr(right(p_name, 4), 1, 2) AS d FROM part")
pair("instr_forms", "SELECT c_custkey, INSTR(c_name, '0') AS a, INSTR(c_name, '0', 12) AS b, INSTR(c_name, '0', 1, 3) AS c, INSTR(c_name, '#', -1) AS d, INSTR(c_name, 'zz', 3) AS e FROM customer", "SELECT c_custkey, CAST(instr(c_name, '0') AS INTEGER) AS a, CAST(CASE WHEN instr(substr(c_name, 12), '0') > 0 THEN instr(substr(c_name, 12), '0') + 11 ELSE 0 END AS INTEGER) AS b, CAST(instr(c_name, '0') + 2 AS INTEGER) AS c, CAST(instr(c_name, '#') AS INTEGER) AS d, CAST(0 AS INTEGER) AS e FROM customer")
pair("pad_translate_trim", "SELECT n_nationkey, LPAD(n_name, 12, '*') AS a, RPAD(n_name, 4) AS b, TRANSLATE(n_name, 'ABN', 'xy') AS c, TRIM(BOTH 'N' FROM n_name) AS d, LTRIM(n_name, 'NA') AS e, RTRIM('  x  ') AS f, TRIM('  y ') AS g FROM nation", "SELECT n_nationkey, lpad(n_name, 12, '*') AS a, rpad(n_name, 4, ' ') AS b, replace(replace(replace(n_name, 'A', 'x'), 'B', 'y'), 'N', '') AS c, trim(n_name, 'N') AS d, ltrim(n_name, 'NA') AS e, '  x' AS f, 'y' AS g FROM nation")
pair("case_functions", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_name) AS n, REPLACE(p_name, 'a', 'AA') AS r, REPLACE(p_name, 'a') AS q, ASCII(p_name) AS c, CHR(65) AS h FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INTEGER) AS n, replace(p_name, 'a', 'AA') AS r, replace(p_name, 'a', '') AS q, CAST(ascii(p_name) AS INTEGER) AS c, chr(65) AS h FROM part")
pair("initcap_words", "SELECT INITCAP('hello wORLD-foo bar9x') AS s FROM dual", "SELECT 'Hello World-Foo Bar9x' AS s")
pair("regexp_replace_all", "SELECT c_custkey, REGEXP_REPLACE(c_name, '[0-9]+', '<n>') AS a, REGEXP_REPLACE(c_name, '([A-Z])([a-z]+)', '\\2\\1') AS b, REGEXP_REPLACE(c_name, '0', 'o', 1, 1) AS c, REGEXP_REPLACE(c_name, 'CUST', 'x', 1, 0, 'i') AS d FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '<n>', 'g') AS a, regexp_replace(c_name, '([A-Z])([a-z]+)', '\\2\\1', 'g') AS b, regexp_replace(c_name, '0', 'o') AS c, regexp_replace(c_name, 'CUST', 'x', 'gi') AS d FROM customer")
pair("regexp_substr_count", "SELECT c_custkey, REGEXP_SUBSTR(c_name, '[1-9][0-9]*') AS a, REGEXP_COUNT(c_name, '0') AS n, REGEXP_INSTR(c_name, '[1-9]') AS i FROM customer WHERE c_custkey > 0", "SELECT c_custkey, regexp_extract(c_name, '[1-9][0-9]*') AS a, CAST(length(c_name) - length(replace(c_name, '0', '')) AS INTEGER) AS n, CAST(length(regexp_extract(c_name, '^[^1-9]*')) + 1 AS INTEGER) AS i FROM customer WHERE c_custkey > 0")
pair("regexp_like_filter", "SELECT p_partkey FROM part WHERE REGEXP_LIKE(p_name, '^[a-m].*[[:digit:]]$', 'i')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*[0-9]$')")
pair("regexp_substr_nth", "SELECT REGEXP_SUBSTR('alpha,beta,gamma', '[^,]+', 1, 2) AS second, REGEXP_SUBSTR('k=v', '(\\w)=(\\w)', 1, 1, 'c', 2) AS grp FROM dual", "SELECT 'beta' AS second, 'v' AS grp")
pair("to_char_date", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'YYYY-MM-DD') AS a, TO_CHAR(o_orderdate, 'DD/MM/YY HH24:MI:SS') AS b, TO_CHAR(o_orderdate, 'Q') AS q, TO_CHAR(o_orderdate, 'DDD') AS ddd, TO_CHAR(o_orderdate, 'FMMonth') AS m FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%d/%m/%y %H:%M:%S') AS b, CAST(quarter(o_orderdate) AS VARCHAR) AS q, strftime(o_orderdate, '%j') AS ddd, monthname(o_orderdate) AS m FROM orders")
pair("to_char_number", "SELECT TO_CHAR(1234.5, '9,999.99') AS a, TO_CHAR(-7, '099') AS b, TO_CHAR(0.5, 'FM990.99') AS c, TO_CHAR(12345, '999') AS d, TO_CHAR(42) AS e FROM dual", "SELECT ' 1,234.50' AS a, '-007' AS b, '0.5' AS c, '####' AS d, '42' AS e")
pair("to_date_formats", "SELECT TO_DATE('2024-03-05', 'YYYY-MM-DD') AS a, TO_DATE('05.03.2024 14:30', 'DD.MM.YYYY HH24:MI') AS b, TO_NUMBER('1,234.5', '9,999.9') AS c FROM dual", "SELECT TIMESTAMP '2024-03-05' AS a, TIMESTAMP '2024-03-05 14:30:00' AS b, CAST(1234.5 AS DOUBLE) AS c")
pair("to_date_from_column", "SELECT o_orderkey, TO_DATE(TO_CHAR(o_orderdate, 'YYYYMMDD'), 'YYYYMMDD') AS d FROM orders", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders")
pair("extract_fields", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi FROM events", "SELECT event_id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS m, CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(minute FROM ts) AS INTEGER) AS mi FROM events")
pair("date_plus_days", "SELECT o_orderkey, o_orderdate + 30 AS a, o_orderdate - 1.5 AS b, 7 + o_orderdate AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS a, o_orderdate - INTERVAL 36 HOUR AS b, o_orderdate + INTERVAL 7 DAY AS c FROM orders")
pair("date_minus_date", "SELECT o.o_orderkey, l.l_partkey, l.l_shipdate - o.o_orderdate AS days FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey", "SELECT o.o_orderkey, l.l_partkey, (epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000 AS days FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
pair("add_months", "SELECT o_orderkey, ADD_MONTHS(o_orderdate, 1) AS a, ADD_MONTHS(o_orderdate, -13) AS b FROM orders", "SELECT o_orderkey, CASE WHEN o_orderdate = last_day(o_orderdate) THEN CAST(last_day(o_orderdate + INTERVAL 1 MONTH) AS TIMESTAMP) ELSE o_orderdate + INTERVAL 1 MONTH END AS a, CASE WHEN o_orderdate = last_day(o_orderdate) THEN CAST(last_day(o_orderdate - INTERVAL 13 MONTH) AS TIMESTAMP) ELSE o_orderdate - INTERVAL 13 MONTH END AS b FROM orders")
pair("months_between", "SELECT MONTHS_BETWEEN(DATE '2024-03-31', DATE '2024-02-29') AS a, MONTHS_BETWEEN(DATE '2024-03-15', DATE '2024-02-15') AS b, ROUND(MONTHS_BETWEEN(DATE '2024-03-20', DATE '2024-01-05'), 6) AS c FROM dual", "SELECT 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, round(2 + 15 / 31, 6) AS c")
pair("last_next_day", "SELECT o_orderkey, LAST_DAY(o_orderdate) AS l, NEXT_DAY(o_orderdate, 'MONDAY') AS n FROM orders", "SELECT o_orderkey, CAST(last_day(o_orderdate) AS TIMESTAMP) AS l, date_trunc('day', o_orderdate)::TIMESTAMP + to_days(CAST(8 - isodow(o_orderdate) AS INTEGER)) AS n FROM orders")
pair("trunc_date_units", "SELECT event_id, TRUNC(ts) AS d, TRUNC(ts, 'MM') AS m, TRUNC(ts, 'Q') AS q, TRUNC(ts, 'YYYY') AS y, TRUNC(ts, 'HH24') AS h, TRUNC(ts, 'MI') AS mi, TRUNC(ts, 'IW') AS w FROM events", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('quarter', ts)::TIMESTAMP AS q, date_trunc('year', ts)::TIMESTAMP AS y, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('minute', ts)::TIMESTAMP AS mi, date_trunc('week', ts)::TIMESTAMP AS w FROM events")
pair("round_date_units", "SELECT event_id, ROUND(ts) AS d, ROUND(ts, 'MM') AS m, ROUND(ts, 'YYYY') AS y, ROUND(ts, 'HH') AS h FROM events", "SELECT event_id, date_trunc('day', ts + INTERVAL 12 HOUR)::TIMESTAMP AS d, CASE WHEN day(ts) >= 16 THEN (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP ELSE date_trunc('month', ts)::TIMESTAMP END AS m, CASE WHEN month(ts) >= 7 THEN (date_trunc('year', ts) + INTERVAL 1 YEAR)::TIMESTAMP ELSE date_trunc('year', ts)::TIMESTAMP END AS y, date_trunc('hour', ts + INTERVAL 30 MINUTE)::TIMESTAMP AS h FROM events")
pair("interval_literal", "SELECT event_id, ts + INTERVAL '2' DAY AS a, ts - INTERVAL '1 02:30' DAY TO MINUTE AS b FROM events", "SELECT event_id, ts + INTERVAL 2 DAY AS a, ts - INTERVAL 26 HOUR - INTERVAL 30 MINUTE AS b FROM events")
pair("cast_types", "SELECT p_partkey, CAST(p_size AS VARCHAR2(10)) AS a, CAST(p_retailprice AS NUMBER(10, 1)) AS b, CAST('12' AS INTEGER) AS c, CAST(p_size AS BINARY_DOUBLE) AS d FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(ROUND(CAST(p_retailprice AS DECIMAL(18, 4)), 1) AS DECIMAL(10, 1)) AS b, CAST('12' AS BIGINT) AS c, CAST(p_size AS DOUBLE) AS d FROM part")
pair("nan_infinite_tests", "SELECT COUNT(*) AS n FROM part WHERE p_retailprice IS NOT NAN AND p_retailprice IS NOT INFINITE", "SELECT COUNT(*) AS n FROM part")
pair("json_field", "SELECT event_id, JSON_VALUE(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
pair("bitand_width_bucket", "SELECT n_nationkey, BITAND(n_nationkey, 6) AS b, WIDTH_BUCKET(n_nationkey, 0, 25, 5) AS w FROM nation", "SELECT n_nationkey, CAST(n_nationkey & 6 AS BIGINT) AS b, CAST(n_nationkey // 5 + 1 AS BIGINT) AS w FROM nation")

# whole-table composites in the manner of the reference's composite tests

pair(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - 90 GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2",
    "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-01' - INTERVAL 90 DAY GROUP BY l_returnflag, l_linestatus",
)
pair(
    "shipping_priority",
    "SELECT * FROM (SELECT o.o_orderkey, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < DATE '1998-03-15' GROUP BY o.o_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderkey) WHERE ROWNUM <= 10",
    "SELECT o.o_orderkey, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < DATE '1998-03-15' GROUP BY o.o_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderkey LIMIT 10",
)

# forms that the queries above leave out

pair("regexp_instr", "SELECT c_custkey, REGEXP_INSTR(c_name, '[1-9]') AS first, REGEXP_INSTR(c_name, '0+', 1, 2) AS second FROM customer", "SELECT c_custkey, CAST(CASE WHEN regexp_matches(c_name, '[1-9]') THEN length(regexp_extract(c_name, '^[^1-9]*')) + 1 ELSE 0 END AS INTEGER) AS first, CAST(CASE WHEN regexp_matches(c_name, '0[^0]+0') THEN length(regexp_extract(c_name, '^[^0]*0+[^0]+')) + 1 ELSE 0 END AS INTEGER) AS second FROM customer")
pair("approx_distinct", "SELECT CASE WHEN APPROX_COUNT_DISTINCT(c_nationkey) BETWEEN 20 AND 30 THEN 'near' END AS n, COUNT(*) AS c FROM customer", "SELECT 'near' AS n, COUNT(*) AS c FROM customer")
pair("collect_sizes", "SELECT n_regionkey, CARDINALITY(COLLECT(n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(COUNT(n_name) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
pair("rawtohex_text", "SELECT c_custkey, RAWTOHEX(c_name) AS h FROM customer", "SELECT c_custkey, upper(hex(encode(c_name))) AS h FROM customer")
pair("only_table", "SELECT o_orderkey FROM ONLY (orders) WHERE o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
pair("current_times", "SELECT CASE WHEN SYSDATE > DATE '2000-01-01' AND SYSTIMESTAMP IS NOT NULL AND CURRENT_DATE IS NOT NULL THEN 'now' END AS n, SESSIONTIMEZONE AS s, DBTIMEZONE AS d FROM dual", "SELECT 'now' AS n, 'UTC' AS s, 'UTC' AS d")
pair("unary_signs", "SELECT c_custkey, +c_nationkey AS a, -(-c_nationkey) AS b, - c_custkey AS c FROM customer", "SELECT c_custkey, c_nationkey AS a, c_nationkey AS b, -c_custkey AS c FROM customer")
pair("chr_national", "SELECT CHR(233 USING NCHAR_CS) AS e, CHR(65) AS a FROM dual", "SELECT chr(233) AS e, 'A' AS a")
