"""Scans, filters, joins, set operations, subqueries: one entry for each operator.

Text in braces names a table; the same SQL without the braces is the oracle unless a
second text is given.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import joins, recursive
from larkspur.registry import Registry
from larkspur.session import table

#: name: (Spark SQL, oracle or None)
SQL: dict[str, tuple[str, str | None]] = {
    # scans and filters
    "scan_filter_project": (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_discount < 0.03",
        None,
    ),
    "point_lookup": ("SELECT * FROM {customer} WHERE c_custkey = 42", None),
    "range_scan": ("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey BETWEEN 100 AND 900", None),
    "composite_prefix_range": (
        "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_orderkey = 7 AND l_linenumber >= 2",
        None,
    ),
    "in_list": ("SELECT p_partkey, p_brand FROM {part} WHERE p_size IN (1, 7, 15, 49)", None),
    "tuple_in": (
        "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (CAST(l_orderkey AS INT), l_linenumber) IN ((1, 1), (2, 1), (3, 2))",
        None,
    ),
    "not_in_list_null": ("SELECT count(*) AS n FROM {users} WHERE age NOT IN (20, 30, 40)", None),
    "three_valued": (
        "SELECT id, CAST((age > 30) AND (score > 50) AS INT) AS a, CAST((age > 30) OR (score > 50) AS INT) AS o, "
        "CAST(NOT (age > 30) AS INT) AS n FROM {users}",
        None,
    ),
    "null_safe_equal": (
        "SELECT count(*) AS n FROM {users} WHERE age <=> NULL",
        "SELECT count(*) AS n FROM users WHERE age IS NOT DISTINCT FROM NULL",
    ),
    "is_tests": (
        "SELECT count_if(age IS NULL) AS nulls, count_if((age > 30) IS TRUE) AS yes, count_if((age > 30) IS NOT TRUE) AS no, "
        "count_if((age > 30) IS UNKNOWN) AS unknown FROM {users}",
        "SELECT count_if(age IS NULL)::BIGINT AS nulls, count_if((age > 30) IS TRUE)::BIGINT AS yes, "
        "count_if((age > 30) IS NOT TRUE)::BIGINT AS no, count_if((age > 30) IS NULL)::BIGINT AS unknown FROM users",
    ),
    "between_not": ("SELECT p_partkey FROM {part} WHERE p_size NOT BETWEEN 5 AND 45", None),
    "like_ci": (
        "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%1_'",
        None,
    ),
    "regexp_ci": (
        "SELECT id, name FROM {users} WHERE name RLIKE '(?i)^[a-d].*n$'",
        "SELECT id, name FROM users WHERE regexp_matches(name, '^[a-d].*n$', 'i')",
    ),
    "case_simple_searched": (
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS a, "
        "CASE WHEN o_totalprice > 100000 THEN 2 WHEN o_totalprice > 50000 THEN 1 END AS b FROM {orders}",
        None,
    ),
    "null_functions": (
        "SELECT id, if(age > 40, 'old', 'young') AS i, ifnull(age, -1) AS n, nullif(age, 30) AS f, "
        "coalesce(age, id, 0) AS c, CAST(isnull(age) AS INT) AS z FROM {users}",
        "SELECT id, CASE WHEN age > 40 THEN 'old' ELSE 'young' END AS i, ifnull(age, -1) AS n, nullif(age, 30) AS f, "
        "coalesce(age, id, 0) AS c, CAST(age IS NULL AS INT) AS z FROM users",
    ),
    "fromless_select": ("SELECT 1 AS one, 'a' AS text, CAST(NULL AS INT) AS nothing", None),
    "derived_table": (
        "SELECT brand, n FROM (SELECT p_brand AS brand, count(*) AS n FROM {part} GROUP BY p_brand) t WHERE n > 50",
        None,
    ),
    "values_table": ("SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b) WHERE a > 1", None),
    "count_star": ("SELECT count(*) AS n FROM {lineitem}", None),
    # joins
    "join_inner": (
        "SELECT o_orderkey, c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o_totalprice > 150000",
        None,
    ),
    "join_residual": (
        "SELECT o_orderkey, c_custkey FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20",
        None,
    ),
    "join_left_residual": (
        "SELECT c_custkey, o_orderkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000",
        None,
    ),
    "join_right": (
        "SELECT o_orderkey, c_custkey FROM {orders} o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
        None,
    ),
    "join_full": (
        "SELECT a.id AS a, b.user_id AS b FROM {users} a FULL JOIN (SELECT DISTINCT user_id FROM {shop_orders}) b ON a.id = b.user_id",
        None,
    ),
    "join_full_theta": (
        "SELECT r.r_regionkey AS r, n.n_nationkey AS n FROM {region} r FULL JOIN {nation} n ON r.r_regionkey > n.n_nationkey",
        None,
    ),
    "join_cross": ("SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", None),
    "join_comma": ("SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey", None),
    "join_expression_both_sides": (
        "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey + b.n_nationkey = 20",
        None,
    ),
    "join_null_keys": (
        "SELECT count(*) AS n FROM {users} a JOIN {users} b ON a.age = b.age AND a.score = b.score",
        None,
    ),
    "join_coercive_key": (
        "SELECT count(*) AS n FROM {nation} a JOIN (SELECT CAST(n_nationkey AS STRING) AS k FROM {nation}) b ON a.n_nationkey = CAST(b.k AS BIGINT)",
        "SELECT count(*) AS n FROM nation a JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation) b ON a.n_nationkey = CAST(b.k AS BIGINT)",
    ),
    "join_case_insensitive": (
        "SELECT count(*) AS n FROM (SELECT lower(trim(email)) AS e FROM {users}) a JOIN (SELECT DISTINCT lower(trim(email)) AS e FROM {users}) b ON a.e = b.e",
        None,
    ),
    "join_chain": (
        "SELECT r_name, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey "
        "JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name",
        None,
    ),
    "join_self": (
        "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
        None,
    ),
    "join_merge": (
        "SELECT /*+ MERGE(o) */ o_orderkey, l_linenumber FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l_quantity = 50",
        "SELECT o_orderkey, l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l_quantity = 50",
    ),
    "join_count_1n": ("SELECT count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey", None),
    "semi_exists": (
        "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 100000)",
        None,
    ),
    "semi_in": ("SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')", None),
    "anti_not_exists": (
        "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
        None,
    ),
    "anti_left_is_null": (
        "SELECT c_custkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL AND c_acctbal > 0",
        None,
    ),
    "exists_aggregate": (
        "SELECT count(*) AS n FROM {customer} c WHERE EXISTS (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_totalprice < 0)",
        "SELECT count(*) AS n FROM customer",
    ),
    "lateral": (
        "SELECT n_name, t.c_custkey FROM {nation}, LATERAL (SELECT c_custkey FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
        None,
    ),
    # sort, limit, distinct, set operations
    "order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", None),
    "order_nulls_first": (
        "SELECT id, age FROM {users} ORDER BY age, id LIMIT 50",
        "SELECT id, age FROM users ORDER BY age NULLS FIRST, id LIMIT 50",
    ),
    "order_nulls_last": (
        "SELECT id, age FROM {users} ORDER BY age DESC, id LIMIT 50",
        "SELECT id, age FROM users ORDER BY age DESC NULLS LAST, id LIMIT 50",
    ),
    "order_hidden_expression": ("SELECT o_orderkey FROM {orders} ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 5", None),
    "order_ordinal_alias": ("SELECT o_custkey, o_totalprice / 2 AS half FROM {orders} ORDER BY 2, half, o_custkey LIMIT 7", None),
    "order_text_topn": ("SELECT o_orderpriority, o_orderkey FROM {orders} ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100", None),
    "order_all": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice, l_orderkey, l_linenumber", None),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}", None),
    "distinct_ci": ("SELECT DISTINCT lower(status) AS status FROM {shop_orders}", None),
    "distinct_limit": ("SELECT DISTINCT p_brand FROM {part} ORDER BY p_brand LIMIT 3", None),
    "set_union_all": ("SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}", None),
    "set_union": ("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", None),
    "set_intersect": ("SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", None),
    "set_intersect_all": ("SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}", None),
    "set_except": ("SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0", None),
    "set_except_all": ("SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey FROM {customer}", None),
    "set_order_limit": (
        "SELECT p_partkey AS k FROM {part} UNION SELECT s_suppkey FROM {supplier} ORDER BY k DESC LIMIT 9",
        None,
    ),
    # subqueries and common table expressions
    "scalar_subquery": ("SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM {orders})", None),
    "scalar_empty": ("SELECT (SELECT c_custkey FROM {customer} WHERE c_custkey < 0) AS nothing", None),
    "scalar_correlated_select": (
        "SELECT c_custkey, (SELECT max(o_orderkey) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS last FROM {customer} c",
        None,
    ),
    "scalar_correlated_where": (
        "SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE l_quantity > (SELECT avg(l_quantity) * 1.8 FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)",
        None,
    ),
    "scalar_correlated_join": (
        "SELECT n_name, c_custkey FROM {nation} n JOIN {customer} c ON c_nationkey = n_nationkey "
        "WHERE c_acctbal = (SELECT max(c_acctbal) FROM {customer} x WHERE x.c_nationkey = n.n_nationkey)",
        None,
    ),
    "tuple_in_subquery": (
        "SELECT o_orderkey FROM {orders} WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, max(o_totalprice) FROM {orders} GROUP BY o_custkey)",
        None,
    ),
    "cte_chain": (
        "WITH a AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM {orders} GROUP BY o_custkey), "
        "b(k, s) AS (SELECT k, s FROM a WHERE s > 500000) SELECT count(*) AS n, CAST(max(s) AS DOUBLE) AS m FROM b",
        None,
    ),
    "cte_recursive_all": (
        "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
        None,
    ),
}

OPERATORS = {
    "anti_not_in_null_aware": "SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM shop_orders)",
    "anti_not_in": "SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM shop_orders WHERE user_id IS NOT NULL)",
    "join_natural": "SELECT count(*) AS n FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier)",
    "join_using_full": "SELECT k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_nationkey < 15 GROUP BY 1) "
    "FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_nationkey > 5 GROUP BY 1) USING (k)",
    "join_band": "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice BETWEEN p_retailprice * 100 AND p_retailprice * 100 + 20",
    "join_salted": "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "recursive_union": "WITH RECURSIVE t(a, b) AS (SELECT o_custkey % 50, (o_custkey * 7 + 3) % 50 FROM orders "
    "UNION SELECT t.a, (t.b * 7 + 3) % 50 FROM t) SELECT a, b FROM t",
}


def register(registry: Registry) -> None:
    for name, (text, oracle) in SQL.items():
        registry.sql(name, text, oracle)

    @registry.add("anti_not_in_null_aware", OPERATORS["anti_not_in_null_aware"])
    def _(spark, folder):
        return joins.not_in(table(spark, folder, "users").select("id"), table(spark, folder, "shop_orders"), "id", "user_id")

    @registry.add("anti_not_in", OPERATORS["anti_not_in"])
    def _(spark, folder):
        known = table(spark, folder, "shop_orders").where("user_id IS NOT NULL")
        return joins.not_in(table(spark, folder, "users").select("id"), known, "id", "user_id")

    @registry.add("join_natural", OPERATORS["join_natural"])
    def _(spark, folder):
        a = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
        b = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
        return joins.natural(a, b).agg(F.count(F.lit(1)).alias("n"))

    @registry.add("join_using_full", OPERATORS["join_using_full"])
    def _(spark, folder):
        a = table(spark, folder, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k"))
        b = table(spark, folder, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k"))
        return joins.using(a.agg(F.count(F.lit(1)).alias("a")), b.agg(F.count(F.lit(1)).alias("b")), ["k"], "full")

    @registry.add("join_band", OPERATORS["join_band"])
    def _(spark, folder):
        low = F.col("p_retailprice") * 100
        ranges = table(spark, folder, "part").select("p_partkey", low.alias("lo"), (low + 20).alias("hi"))
        found = joins.band(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "lo", "hi", 20)
        return found.select("o_orderkey", "p_partkey")

    @registry.add("join_salted", OPERATORS["join_salted"])
    def _(spark, folder):
        items = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber")
        found = joins.salted(items, table(spark, folder, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
        return found.select("l_orderkey", "l_linenumber", "s_name")

    @registry.add("recursive_union", OPERATORS["recursive_union"])
    def _(spark, folder):
        follow = lambda c: (c * 7 + 3) % 50
        seed = table(spark, folder, "orders").select((F.col("o_custkey") % 50).alias("a"), follow(F.col("o_custkey")).alias("b"))
        return recursive.fixpoint(seed, lambda new: new.select("a", follow(F.col("b")).alias("b")))
