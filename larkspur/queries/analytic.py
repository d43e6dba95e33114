"""Aggregates and windows, and the shapes of the published OLAP measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import aggregates as A
from larkspur.operators import windows as W
from larkspur.registry import Registry
from larkspur.session import table

SQL: dict[str, tuple[str, str | None]] = {
    "groupby_sum": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, "
        "round(avg(l_extendedprice), 4) AS price FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' "
        "GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "global_aggregate": (
        "SELECT CAST(sum(l_partkey) AS BIGINT) AS s, round(avg(l_partkey), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem}",
        None,
    ),
    "groupby_low": ("SELECT l_suppkey % 100 AS g, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM {lineitem} GROUP BY l_suppkey % 100", None),
    "groupby_high_top10": (
        "SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s FROM {lineitem} GROUP BY l_partkey ORDER BY s DESC, l_partkey LIMIT 10",
        None,
    ),
    "filtered_aggregate": ("SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM {lineitem} WHERE l_quantity > 25", None),
    "count_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, count(o_custkey) AS c FROM {orders} GROUP BY o_orderstatus", None),
    "sum_distinct": ("SELECT l_returnflag, CAST(sum(DISTINCT l_quantity) AS DOUBLE) AS s FROM {lineitem} GROUP BY l_returnflag", None),
    "min_max_text": ("SELECT p_brand, min(p_name) AS lo, max(p_type) AS hi FROM {part} GROUP BY p_brand", None),
    "statistics": (
        "SELECT l_returnflag, round(stddev_pop(l_quantity), 4) AS std, round(stddev_samp(l_quantity), 4) AS sample, "
        "round(var_pop(l_discount), 8) AS variance, round(var_samp(l_discount), 8) AS var_sample FROM {lineitem} GROUP BY l_returnflag",
        None,
    ),
    "percentiles_exact": (
        "SELECT l_returnflag, round(p[0], 4) AS p95, round(p[1], 4) AS mid FROM (SELECT l_returnflag, "
        "percentile(l_extendedprice, array(0.95, 0.5)) AS p FROM {lineitem} GROUP BY l_returnflag) t",
        "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(median(l_extendedprice), 4) AS mid FROM lineitem GROUP BY l_returnflag",
    ),
    "conditional_sums": (
        "SELECT event_type, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS high, count_if(value <= 50) AS low, "
        "CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even FROM {events} GROUP BY event_type",
        "SELECT event_type, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS high, CAST(count_if(value <= 50) AS BIGINT) AS low, "
        "CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even FROM events GROUP BY event_type",
    ),
    "expression_over_aggregates": (
        "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM {orders} GROUP BY o_custkey",
        None,
    ),
    "groupby_expression_alias": ("SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY y", None),
    "having_alias": ("SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING n > 15 AND max(o_totalprice) > 1000", None),
    "empty_aggregate": ("SELECT count(*) AS n, sum(l_quantity) AS s, max(l_partkey) AS m FROM {lineitem} WHERE l_quantity < 0", None),
    "groupby_ci": (
        "SELECT lower(trim(status)) AS status, count(*) AS n FROM {shop_orders} GROUP BY lower(trim(status))",
        None,
    ),
    "rollup": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS a FROM {lineitem} GROUP BY l_returnflag, l_linestatus WITH ROLLUP",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "time_bucket": (
        "SELECT date_format(ts, 'yyyy-MM-dd HH:mm') AS minute, count(*) AS n, count_if(value >= 50) AS high FROM {events} GROUP BY minute",
        "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n, CAST(count_if(value >= 50) AS BIGINT) AS high FROM events GROUP BY minute",
    ),
    # windows
    "window_ranks": (
        "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, "
        "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, ntile(4) OVER w AS q "
        "FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
        None,
    ),
    "window_lag_lead": (
        "SELECT o_orderkey, lag(o_orderkey) OVER w AS a, lead(o_orderkey, 2, 0) OVER w AS b FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
        None,
    ),
    "window_first_last_nth": (
        "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 3) OVER w AS t "
        "FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        None,
    ),
    "window_partition_sum": (
        "SELECT l_orderkey, l_linenumber, CAST(sum(l_partkey) OVER (PARTITION BY l_suppkey) AS BIGINT) AS s, count(*) OVER (PARTITION BY l_suppkey) AS n FROM {lineitem}",
        None,
    ),
    "window_running_peers": (
        "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM {part}",
        None,
    ),
    "window_rows_frame": (
        "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM {orders}",
        None,
    ),
    "window_range_frame": (
        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM {part}",
        None,
    ),
    "window_range_desc_nulls": (
        "SELECT id, count(*) OVER (ORDER BY age DESC RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS n FROM {users}",
        "SELECT id, count(*) OVER (ORDER BY age DESC NULLS LAST RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS n FROM users",
    ),
    "window_percent": (
        "SELECT c_custkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
        None,
    ),
    "window_filter_rownumber": (
        "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn = 1",
        None,
    ),
    "window_in_expression": (
        "SELECT c_custkey, round(max(c_acctbal) OVER (PARTITION BY c_nationkey) - c_acctbal, 2) AS diff FROM {customer}",
        None,
    ),
}


def register(registry: Registry) -> None:
    for name, (text, oracle) in SQL.items():
        registry.sql(name, text, oracle)

    @registry.add(
        "avg_exact",
        "SELECT l_returnflag, CAST(round(CAST(sum(l_partkey) AS DECIMAL(30,4)) / count(*), 4) AS DOUBLE) AS a, "
        "CAST(sum(l_partkey) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag",
    )
    def _(spark, folder):
        return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
            A.avg_exact(F.col("l_partkey")).cast("double").alias("a"), A.sum_exact(F.col("l_partkey")).cast("double").alias("s")
        )

    @registry.add(
        "bit_aggregates",
        "SELECT p_brand, CAST(bit_or(p_partkey) AS DOUBLE) AS o, CAST(bit_and(p_partkey + 1024) AS DOUBLE) AS a, "
        "CAST(bit_xor(p_partkey) AS DOUBLE) AS x FROM part GROUP BY p_brand",
    )
    def _(spark, folder):
        k = F.col("p_partkey")
        return table(spark, folder, "part").groupBy("p_brand").agg(
            A.bit_or(k).cast("double").alias("o"), A.bit_and(k + 1024).cast("double").alias("a"), A.bit_xor(k).cast("double").alias("x")
        )

    @registry.add(
        "group_concat",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS a, string_agg(n_name, '; ' ORDER BY n_nationkey DESC) AS b FROM nation GROUP BY n_regionkey",
    )
    def _(spark, folder):
        return table(spark, folder, "nation").groupBy("n_regionkey").agg(
            A.group_concat(F.col("n_name")).alias("a"),
            A.group_concat(F.col("n_name"), "; ", F.col("n_nationkey"), descending=True).alias("b"),
        )

    @registry.add(
        "group_concat_distinct_cut",
        "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type)[1:20] AS t FROM part GROUP BY p_brand",
    )
    def _(spark, folder):
        return table(spark, folder, "part").groupBy("p_brand").agg(
            A.group_concat(F.col("p_type"), "|", distinct=True, limit=20).alias("t")
        )

    @registry.add(
        "facet",
        "SELECT c_nationkey, '{' || string_agg('\"' || c_mktsegment || '\": ' || n, ', ' ORDER BY n DESC, c_mktsegment) || '}' AS facet "
        "FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey",
    )
    def _(spark, folder):
        return A.facet(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment")

    @registry.add(
        "sum_distinct_salted",
        "SELECT l_linestatus, CAST(sum(DISTINCT l_partkey) AS BIGINT) AS sum_distinct FROM lineitem GROUP BY l_linestatus",
    )
    def _(spark, folder):
        return A.skewed_sum(table(spark, folder, "lineitem"), ["l_linestatus"], F.col("l_partkey"))

    @registry.add(
        "window_groups_frame",
        "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, "
        "CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part",
    )
    def _(spark, folder):
        parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
        out = W.groups_frame(
            parts, ["p_brand"], [F.col("p_size")], -1, 1, n=F.count(F.lit(1)), s=F.sum("p_partkey")
        )
        return out.select("p_partkey", "n", "s")

    @registry.add(
        "window_inherited",
        "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders",
    )
    def _(spark, folder):
        base = W.Named(partition=("o_custkey",))
        w = base.over(order=[F.col("o_totalprice").desc()]).spec()
        return table(spark, folder, "orders").select("o_orderkey", F.rank().over(w).alias("r"))

    @registry.add(
        "top_per_group",
        "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey "
        "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3",
    )
    def _(spark, folder):
        order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
        rows = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
        return W.top_per_group(rows, ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber")
