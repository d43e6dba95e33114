"""Statements of the dialect, each with the SQL that must give the same rows."""

from __future__ import annotations

from larkspur.plans import frontend
from larkspur.plans.database import Database
from larkspur.registry import Registry
from larkspur.session import scratch, table

#: name: (statement, tables, oracle)
STATEMENTS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "sql_precedence": (
        "SELECT p_partkey, p_partkey * 3 DIV 2 AS a, p_partkey * 7 % 4 AS b, p_partkey + p_size * 2 DIV 3 AS c, -p_size % 7 + 1 AS d, "
        "p_partkey - p_size - 1 AS e, 2 + 3 * p_size MOD 5 AS f, (p_size + 1) * 2 DIV (p_size - 7) AS g FROM part",
        ("part",),
        "SELECT p_partkey, (p_partkey * 3) // 2 AS a, (p_partkey * 7) % 4 AS b, p_partkey + (p_size * 2) // 3 AS c, CAST(-p_size % 7 + 1 AS BIGINT) AS d, "
        "p_partkey - p_size - 1 AS e, CAST(2 + (3 * p_size) % 5 AS BIGINT) AS f, CAST(trunc(((p_size + 1) * 2) / nullif(p_size - 7, 0)) AS BIGINT) AS g FROM part",
    ),
    "sql_exact_division": (
        "SELECT p_partkey, CAST(p_partkey / p_size AS CHAR) AS a, CAST(p_partkey / (p_size - 7) AS CHAR) AS b, CAST(10 / 2.5 AS CHAR) AS c FROM part",
        ("part",),
        "SELECT p_partkey, CAST(CAST(round(CAST(p_partkey AS DOUBLE) / p_size, 4) AS DECIMAL(18,4)) AS VARCHAR) AS a, "
        "CAST(CAST(round(CAST(p_partkey AS DOUBLE) / nullif(p_size - 7, 0), 4) AS DECIMAL(18,4)) AS VARCHAR) AS b, '4.0000' AS c FROM part",
    ),
    "sql_over_aggregates": (
        "SELECT l_returnflag, CAST(SUM(l_linenumber) / COUNT(*) AS CHAR) AS a, SUM(l_linenumber) DIV COUNT(*) AS b, "
        "CASE WHEN COUNT(*) > 10 THEN MAX(l_linenumber) ELSE 0 END / 2 * 2 AS c, CAST(AVG(l_linenumber) AS CHAR) AS d, SUM(l_linenumber = 1) AS e FROM lineitem GROUP BY l_returnflag",
        ("lineitem",),
        "SELECT l_returnflag, CAST(CAST(round(sum(l_linenumber) / count(*), 4) AS DECIMAL(18,4)) AS VARCHAR) AS a, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS b, "
        "CAST(CASE WHEN count(*) > 10 THEN max(l_linenumber) ELSE 0 END AS DOUBLE) AS c, CAST(CAST(round(sum(l_linenumber) / count(*), 4) AS DECIMAL(18,4)) AS VARCHAR) AS d, "
        "CAST(count_if(l_linenumber = 1) AS BIGINT) AS e FROM lineitem GROUP BY l_returnflag",
    ),
    "sql_bits": (
        "SELECT p_partkey, CAST(p_partkey & 12 AS CHAR) AS a, CAST(p_partkey | 5 AS CHAR) AS b, CAST(p_partkey ^ 3 AS CHAR) AS c, CAST(~p_partkey AS CHAR) AS d, "
        "CAST(p_partkey << 2 AS CHAR) AS e, CAST(p_partkey >> 1 AS CHAR) AS f, BIT_COUNT(p_partkey) AS g FROM part",
        ("part",),
        "SELECT p_partkey, CAST(p_partkey & 12 AS VARCHAR) AS a, CAST(p_partkey | 5 AS VARCHAR) AS b, CAST(xor(p_partkey, 3) AS VARCHAR) AS c, "
        "CAST(18446744073709551615::HUGEINT - p_partkey AS VARCHAR) AS d, CAST(p_partkey << 2 AS VARCHAR) AS e, CAST(p_partkey >> 1 AS VARCHAR) AS f, CAST(bit_count(p_partkey) AS INT) AS g FROM part",
    ),
    "sql_bit_aggregates": (
        "SELECT CAST(BIT_AND(n_nationkey) AS CHAR) AS a, CAST(BIT_OR(n_nationkey) AS CHAR) AS b, CAST(BIT_XOR(n_nationkey) AS CHAR) AS c FROM nation WHERE n_nationkey < 0",
        ("nation",),
        "SELECT '18446744073709551615' AS a, '0' AS b, '0' AS c",
    ),
    "sql_texts": (
        "SELECT p_partkey, SUBSTRING(p_name, -3) AS a, SUBSTRING(p_name, -90, 3) AS b, SUBSTRING(p_name FROM 2 FOR 3) AS c, LEFT(p_name, 2) AS d, LPAD(p_size, 4, '0') AS e, "
        "CONCAT(p_brand, '/', p_size) AS f, CHAR_LENGTH(p_name) AS g, REVERSE(p_brand) AS h, UPPER(p_type) AS i, REPLACE(p_brand, '#', '-') AS j, FIELD(p_size, 1, 5, 9) AS k, "
        "ELT(p_size, 'one', 'two') AS l, INSTR(p_name, 'A') AS m, TRIM(LEADING 'B' FROM p_brand) AS n, ASCII(p_name) AS o, INSERT(p_brand, 2, 1, '__') AS q FROM part",
        ("part",),
        "SELECT p_partkey, p_name[-3:] AS a, '' AS b, substring(p_name, 2, 3) AS c, left(p_name, 2) AS d, lpad(CAST(p_size AS VARCHAR), 4, '0') AS e, p_brand || '/' || p_size AS f, "
        "CAST(length(p_name) AS INT) AS g, reverse(p_brand) AS h, upper(p_type) AS i, replace(p_brand, '#', '-') AS j, CASE p_size WHEN 1 THEN 1 WHEN 5 THEN 2 WHEN 9 THEN 3 ELSE 0 END AS k, "
        "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS l, CAST(instr(lower(p_name), 'a') AS INT) AS m, regexp_replace(p_brand, '^B+', '') AS n, CAST(ord(p_name) AS BIGINT) AS o, "
        "p_brand[1:1] || '__' || p_brand[3:] AS q FROM part",
    ),
    "sql_maths": (
        "SELECT p_partkey, CEIL(p_retailprice) AS a, FLOOR(-p_retailprice) AS b, ROUND(p_retailprice, 1) AS c, TRUNCATE(p_retailprice, 1) AS d, SQRT(p_size - 10) AS e, ROUND(LN(p_size - 10), 9) AS f, "
        "GREATEST(p_size, 10, 20) AS g, LEAST(p_size, NULL) AS h, SIGN(p_size - 10) AS i, POWER(p_size, 2) AS j, MOD(p_partkey, p_size - 1) AS k, TRUNCATE(12.3456, 2) AS l, ABS(-p_size) AS m FROM part",
        ("part",),
        "SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS a, CAST(floor(-p_retailprice) AS BIGINT) AS b, round(p_retailprice, 1) AS c, trunc(p_retailprice * 10) / 10 AS d, "
        "CASE WHEN p_size >= 10 THEN sqrt(p_size - 10) END AS e, CASE WHEN p_size > 10 THEN round(ln(p_size - 10), 9) END AS f, greatest(p_size, 20) AS g, NULL AS h, CAST(sign(p_size - 10) AS INT) AS i, "
        "power(p_size, 2) AS j, CASE WHEN p_size <> 1 THEN p_partkey % (p_size - 1) END AS k, 12.34 AS l, CAST(p_size AS BIGINT) AS m FROM part",
    ),
    "sql_moments": (
        "SELECT o_orderkey, YEAR(o_orderdate) AS a, WEEK(o_orderdate, 3) AS b, YEARWEEK(o_orderdate, 3) AS c, DAYNAME(o_orderdate) AS d, DATEDIFF(o_orderdate, '2020-01-01') AS e, LAST_DAY(o_orderdate) AS f, "
        "EXTRACT(MONTH FROM o_orderdate) AS g, TIMESTAMPDIFF(MONTH, '2000-01-01', o_orderdate) AS h, DATE(o_orderdate + INTERVAL 1 QUARTER) AS i, TIMESTAMPADD(DAY, 3, o_orderdate) AS j, "
        "TO_DAYS(o_orderdate) AS k, UNIX_TIMESTAMP(o_orderdate) AS l, FROM_UNIXTIME(86400, '%Y-%m-%d') AS m, TIME_TO_SEC('01:01:01') AS n, WEEKDAY(o_orderdate) AS o, DAYOFYEAR(o_orderdate) AS q FROM orders",
        ("orders",),
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS a, CAST(week(o_orderdate) AS INT) AS b, CAST(isoyear(o_orderdate) * 100 + week(o_orderdate) AS INT) AS c, dayname(o_orderdate) AS d, "
        "CAST(datediff('day', DATE '2020-01-01', CAST(o_orderdate AS DATE)) AS INT) AS e, last_day(o_orderdate) AS f, CAST(month(o_orderdate) AS INT) AS g, datesub('month', TIMESTAMP '2000-01-01', o_orderdate) AS h, "
        "CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS i, o_orderdate + INTERVAL 3 DAY AS j, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INT) AS k, "
        "CAST(epoch(o_orderdate) AS BIGINT) AS l, '1970-01-02' AS m, 3661 AS n, CAST((dayofweek(o_orderdate) + 6) % 7 AS INT) AS o, CAST(dayofyear(o_orderdate) AS INT) AS q FROM orders",
    ),
    "sql_json_edits": (
        "SELECT event_id, JSON_SET('{\"a\": 1.10}', '$.b', event_id) AS a, JSON_REMOVE(props, '$.k') AS b, JSON_EXTRACT('[1, {\"x\": 2.50}]', '$[1].x') AS c, JSON_LENGTH(props) AS d, "
        "JSON_OBJECT('id', event_id, 'kind', event_type) AS e, JSON_CONTAINS('[1, 2]', '2') AS f, JSON_KEYS('{\"a\\\\\"b\": 1}') AS g FROM events",
        ("events",),
        "SELECT event_id, '{\"a\": 1.10, \"b\": ' || event_id || '}' AS a, '{}' AS b, '2.50' AS c, 1 AS d, '{\"id\": ' || event_id || ', \"kind\": \"' || event_type || '\"}' AS e, 1 AS f, '[\"a\\\"b\"]' AS g FROM events",
    ),
    "sql_compare_text_number": (
        "SELECT id, name = UPPER(name) AS a, '10' > 9 AS b, 0 = 'abc' AS c, '12abc' + 1 AS d, name = 0 AS e, 'a' IN ('A', 'b') AS f FROM users",
        ("users",),
        "SELECT id, true AS a, true AS b, true AS c, 13.0::DOUBLE AS d, true AS e, true AS f FROM users",
    ),
    "sql_ci_group": (
        "SELECT UPPER(TRIM(status)) AS s, COUNT(*) AS n, COUNT(DISTINCT status) AS d FROM shop_orders GROUP BY UPPER(TRIM(status))",
        ("shop_orders",),
        "SELECT upper(trim(status)) AS s, count(*) AS n, count(DISTINCT lower(status)) AS d FROM shop_orders GROUP BY ALL",
    ),
    "sql_ci_distinct": (
        "SELECT COUNT(*) AS n FROM (SELECT DISTINCT status FROM shop_orders UNION SELECT UPPER(status) FROM shop_orders) AS t",
        ("shop_orders",),
        "SELECT count(DISTINCT lower(status)) + CAST(bool_or(status IS NULL) AS BIGINT) AS n FROM shop_orders",
    ),
    "sql_ci_where": (
        "SELECT id FROM shop_orders WHERE status = 'SHIPPED' AND status <> 'Cancelled'",
        ("shop_orders",),
        "SELECT id FROM shop_orders WHERE lower(status) = 'shipped'",
    ),
    "sql_bare_column": (
        "SELECT n_regionkey, COUNT(*) AS n, n_regionkey * 2 AS twice, MAX(n_name) AS last, r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey",
        ("nation", "region"),
        "SELECT n_regionkey, count(*) AS n, CAST(n_regionkey * 2 AS BIGINT) AS twice, max(n_name) AS last, any_value(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey",
    ),
    "sql_groups_frame": (
        "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders",
        ("orders",),
        "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders",
    ),
    "sql_recursive_union": (
        "WITH RECURSIVE r (n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT (n * 7 + 1) % 25 FROM r) SELECT n, n_name FROM r JOIN nation ON n = n_nationkey",
        ("nation",),
        "WITH RECURSIVE r (n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT CAST((n * 7 + 1) % 25 AS INT) FROM r) SELECT CAST(n AS BIGINT) AS n, n_name FROM r JOIN nation ON n = n_nationkey",
    ),
    "sql_recursive_all": (
        "WITH RECURSIVE c (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 300) SELECT COUNT(*) AS n, SUM(n) AS s FROM c",
        (),
        "SELECT 300 AS n, CAST(45150 AS BIGINT) AS s",
    ),
    "sql_facet": (
        "SELECT r_name, FACET(n_name, 2) AS f FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        ("nation", "region"),
        "SELECT r_name, '{' || string_agg('\"' || n_name || '\": 1', ', ' ORDER BY n_name) || '}' AS f FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS rn "
        "FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE rn <= 2 GROUP BY r_name",
    ),
    "sql_subqueries": (
        "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'f') AS f FROM customer c "
        "WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) ORDER BY c_custkey",
        ("customer", "orders"),
        "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS f FROM customer "
        "WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    ),
    "sql_joins": (
        "SELECT n.n_name, r.r_name, COUNT(c_custkey) AS n FROM region AS r STRAIGHT_JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 "
        "GROUP BY n.n_name, r.r_name HAVING n > 0 ORDER BY n DESC, 1 LIMIT 20",
        ("region", "nation", "customer"),
        "SELECT n_name, r_name, count(c_custkey) AS n FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 "
        "GROUP BY ALL HAVING count(c_custkey) > 0 ORDER BY n DESC, 1 LIMIT 20",
    ),
    "sql_set_operations": (
        "(SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 10) UNION ALL (SELECT r_regionkey FROM region) ORDER BY k DESC LIMIT 3, 7",
        ("nation", "region"),
        "SELECT k FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 10 UNION ALL SELECT r_regionkey FROM region) ORDER BY k DESC LIMIT 7 OFFSET 3",
    ),
    "sql_time_buckets": (
        "SELECT DATE_FORMAT(ts, '%Y-%m-%d %H:00') AS bucket, event_type, COUNT(*) AS n, SUM(value > 0) AS positive FROM events GROUP BY bucket, event_type",
        ("events",),
        "SELECT strftime(ts, '%Y-%m-%d %H:00') AS bucket, event_type, count(*) AS n, CAST(count_if(value > 0) AS BIGINT) AS positive FROM events GROUP BY ALL",
    ),
    "sql_casts_more": (
        "SELECT p_partkey, CAST(p_retailprice AS SIGNED) AS a, CAST(CAST(-p_partkey - 1 AS UNSIGNED) AS CHAR) AS b, CAST(p_retailprice AS DECIMAL(12,1)) + 0.00 AS c, CAST(p_name AS CHAR(3)) AS d, "
        "CAST('3.7x' AS SIGNED) AS e, CONVERT('2024-02-29 10:11:12', DATETIME) AS f FROM part",
        ("part",),
        "SELECT p_partkey, CAST(round(p_retailprice) AS BIGINT) AS a, CAST(18446744073709551615::HUGEINT - p_partkey AS VARCHAR) AS b, CAST(round(p_retailprice, 1) AS DOUBLE) AS c, left(p_name, 3) AS d, "
        "CAST(3 AS BIGINT) AS e, TIMESTAMP '2024-02-29 10:11:12' AS f FROM part",
    ),
}


#: name: (statements of which the last is a query, tables, oracle)
CHANGES: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "sql_upsert": (
        (
            "DROP TABLE IF EXISTS c",
            "CREATE TABLE c (k BIGINT PRIMARY KEY, name VARCHAR(60), bal DOUBLE DEFAULT 0)",
            "INSERT INTO c SELECT c_custkey, c_name, c_acctbal FROM customer",
            "INSERT INTO c (k, name, bal) SELECT c_custkey * 2, 'new', 1 FROM customer ON DUPLICATE KEY UPDATE name = CONCAT(name, '/', VALUES(name)), bal = bal + 1",
            "INSERT IGNORE INTO c (k, name) SELECT c_custkey * 3, 'ignored' FROM customer",
            "REPLACE INTO c (k, name) VALUES (1, 'one'), (-1, 'minus')",
            "SELECT k, name, bal FROM c",
        ),
        ("customer",),
        "WITH t AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer), u AS (SELECT c_custkey * 2 AS k FROM customer), "
        "a AS (SELECT t.k, CASE WHEN u.k IS NULL THEN t.name ELSE t.name || '/new' END AS name, CASE WHEN u.k IS NULL THEN t.bal ELSE t.bal + 1 END AS bal FROM t LEFT JOIN u USING (k) "
        "UNION ALL SELECT k, 'new', 1 FROM u WHERE k NOT IN (SELECT k FROM t)), "
        "b AS (FROM a UNION ALL SELECT c_custkey * 3, 'ignored', 0 FROM customer WHERE c_custkey * 3 NOT IN (SELECT k FROM a)) "
        "SELECT * FROM b WHERE k NOT IN (1, -1) UNION ALL VALUES (1, 'one', 0), (-1, 'minus', 0)",
    ),
    "sql_update_joined": (
        (
            "DROP TABLE IF EXISTS o",
            "CREATE TABLE o AS SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
            "UPDATE o JOIN customer ON o_custkey = c_custkey SET o_totalprice = c_custkey, o_orderstatus = 'x' WHERE c_mktsegment = 'building' AND o_orderstatus = 'f'",
            "UPDATE o SET o_custkey = -1 ORDER BY o_orderkey DESC LIMIT 10",
            "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM o",
        ),
        ("orders", "customer"),
        "WITH hit AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'), "
        "late AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10) "
        "SELECT o_orderkey, CASE WHEN o_orderkey IN (FROM late) THEN -1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey IN (FROM hit) THEN o_custkey ELSE o_totalprice END AS o_totalprice, "
        "CASE WHEN o_orderkey IN (FROM hit) THEN 'x' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    ),
    "sql_delete_joined": (
        (
            "DROP TABLE IF EXISTS p",
            "CREATE TABLE p AS SELECT p_partkey, p_size FROM part",
            "DELETE a FROM p AS a JOIN lineitem ON a.p_partkey = l_partkey WHERE l_quantity > 45",
            "DELETE FROM p WHERE p_size > 40 ORDER BY p_partkey LIMIT 5",
            "ALTER TABLE p ADD COLUMN double_size BIGINT",
            "UPDATE p SET double_size = p_size * 2",
            "SELECT p_partkey, double_size FROM p",
        ),
        ("part", "lineitem"),
        "WITH kept AS (SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)), "
        "gone AS (SELECT p_partkey FROM kept WHERE p_size > 40 ORDER BY p_partkey LIMIT 5) "
        "SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS double_size FROM kept WHERE p_partkey NOT IN (FROM gone)",
    ),
}


def register(registry: Registry) -> None:
    for name, (statement, tables, oracle) in STATEMENTS.items():
        _add(registry, name, statement, tables, oracle)
    for name, (statements, tables, oracle) in CHANGES.items():
        _changes(registry, name, statements, tables, oracle)


def _changes(registry: Registry, name: str, statements: tuple[str, ...], tables: tuple[str, ...], oracle: str) -> None:
    @registry.add(name, oracle)
    def _(spark, folder):
        base = Database(spark, scratch(spark, folder, name), {t: table(spark, folder, t) for t in tables})
        for statement in statements[:-1]:
            base.run(statement)
        return base.run(statements[-1])


def _add(registry: Registry, name: str, statement: str, tables: tuple[str, ...], oracle: str) -> None:
    @registry.add(name, oracle)
    def _(spark, folder):
        return frontend.run(spark, statement, {t: table(spark, folder, t) for t in tables})
