"""Search, table changes, file sources, statistics, streams and the SQL front end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import dml, search
from larkspur.plans import frontend
from larkspur.registry import Registry
from larkspur.session import scratch, table
from larkspur.streaming import events as streams

SQL_QUERY = "list_transform(range(0, len(embedding)), lambda i: CAST((i * 37) % 17 - 8 AS DOUBLE) / 10)"
VECTOR = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
L2 = f"list_sum(list_transform(list_zip({VECTOR}, {SQL_QUERY}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

#: Statements of the dialect: name: (statement, tables, oracle)
STATEMENTS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "sql_rollup_concat": (
        "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '|') AS names FROM nation GROUP BY n_regionkey",
        ("nation",),
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    ),
    "sql_limit_offset": (
        "SELECT `o_orderkey` FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10",
        ("orders",),
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    ),
    "sql_no_limit": (
        "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 20, 18446744073709551615",
        ("nation",),
        "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20",
    ),
    "sql_division": (
        "SELECT p_partkey, p_partkey DIV (p_size - 7) AS q, p_partkey % (p_size - 7) AS r, !(p_size > 7) AS n FROM part",
        ("part",),
        "SELECT p_partkey, CAST(trunc(CAST(p_partkey AS DOUBLE) / nullif(p_size - 7, 0)) AS BIGINT) AS q, "
        "CAST(p_partkey % nullif(p_size - 7, 0) AS BIGINT) AS r, NOT (p_size > 7) AS n FROM part",
    ),
    "sql_statistics_names": (
        "SELECT l_returnflag, ROUND(STD(l_quantity), 4) AS s, ROUND(VARIANCE(l_quantity), 4) AS v, PERCENTILE(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_returnflag",
        ("lineitem",),
        "SELECT l_returnflag, round(stddev_pop(l_quantity), 4) AS s, round(var_pop(l_quantity), 4) AS v, quantile_cont(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_returnflag",
    ),
    "sql_like_regexp": (
        "SELECT p_partkey FROM part WHERE p_type LIKE '%a%' && p_type REGEXP '^[s-z]'",
        ("part",),
        "SELECT p_partkey FROM part WHERE p_type ILIKE '%a%' AND regexp_matches(p_type, '^[s-z]', 'i')",
    ),
    "sql_dates": (
        "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m') AS ym, DATE(DATE_ADD(o_orderdate, INTERVAL 1 MONTH)) AS later FROM orders",
        ("orders",),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS ym, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS later FROM orders",
    ),
    "sql_casts": (
        "SELECT id, CAST('12abc' AS SIGNED) AS a, CAST(id AS CHAR) AS c, CONVERT('2024-02-30', DATE) AS d FROM users",
        ("users",),
        "SELECT id, CAST(12 AS BIGINT) AS a, CAST(id AS VARCHAR) AS c, CAST(NULL AS DATE) AS d FROM users",
    ),
    "sql_named_window": (
        "SELECT o_orderkey, RANK() OVER (w ORDER BY o_totalprice) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey)",
        ("orders",),
        "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders",
    ),
    "sql_json_arrow": (
        "SELECT event_id, props->>'$.k' AS k FROM events",
        ("events",),
        "SELECT event_id, props ->> '$.k' AS k FROM events",
    ),
}


def register(registry: Registry) -> None:
    for name, (statement, tables, oracle) in STATEMENTS.items():
        _statement(registry, name, statement, tables, oracle)

    @registry.add(
        "match_natural",
        f"SELECT doc_id, CAST(list_contains(w, 'valve') AS BIGINT) + CAST(list_contains(w, 'steel') AS BIGINT) * 2 AS score "
        f"FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE list_contains(w, 'valve') OR list_contains(w, 'steel')",
    )
    def _(spark, folder) -> DataFrame:
        score = search.match_score([F.col("text")], "valve steel Steel!")
        return table(spark, folder, "documents").select("doc_id", score.alias("score")).where("score > 0")

    @registry.add(
        "match_boolean",
        f"SELECT doc_id, CAST(1 AS BIGINT) + CAST(list_contains(w, 'rotor') AS BIGINT) AS score FROM (SELECT doc_id, {WORDS} AS w FROM documents) "
        "WHERE list_contains(w, 'valve') AND NOT list_contains(w, 'steel')",
    )
    def _(spark, folder) -> DataFrame:
        score = search.match_boolean([F.col("text")], "+valve rotor -steel")
        return table(spark, folder, "documents").select("doc_id", score.alias("score")).where("score > 0")

    @registry.add(
        "fulltext_index_lookup",
        f"SELECT doc_id, CAST(list_contains(w, 'gripper') AS BIGINT) + CAST(list_contains(w, 'felt') AS BIGINT) AS score "
        f"FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE list_contains(w, 'gripper') OR list_contains(w, 'felt')",
    )
    def _(spark, folder) -> DataFrame:
        index = search.postings(table(spark, folder, "documents"), "doc_id", ["text"])
        return search.lookup(index, "doc_id", "gripper felt")

    @registry.add(
        "match_stemmed",
        f"SELECT doc_id, CAST(2 AS BIGINT) AS score FROM (SELECT doc_id, {WORDS} AS w FROM documents) "
        "WHERE (list_contains(w, 'rotor') OR list_contains(w, 'rotors')) AND (list_contains(w, 'valve') OR list_contains(w, 'valves'))",
    )
    def _(spark, folder) -> DataFrame:
        score = search.match_score([F.col("text")], "rotors valves", stem=True)
        return table(spark, folder, "documents").select("doc_id", score.alias("score")).where("score = 2")

    for metric, distance in (
        ("l2", L2),
        ("cosine", f"1 - list_cosine_similarity({VECTOR}, {SQL_QUERY})"),
        ("inner", f"-list_inner_product({VECTOR}, {SQL_QUERY})"),
    ):
        _knn(registry, metric, distance)

    @registry.add(
        "hybrid_rrf",
        f"""WITH s AS (SELECT vec_id, label, {L2} AS d FROM embeddings),
        v AS (SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) AS r FROM s),
        t AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM s WHERE label = 3)
        SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (FROM v UNION ALL FROM t) GROUP BY vec_id
        ORDER BY score DESC, vec_id LIMIT 25""",
    )
    def _(spark, folder) -> DataFrame:
        rows = table(spark, folder, "embeddings")
        size = len(rows.select("embedding").first()[0])
        texts = rows.withColumn("words", F.concat(F.lit("label"), F.col("label")))
        found = search.hybrid(texts, "vec_id", ["words"], "label3", "embedding", _query(size))
        return found.select("vec_id", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "vec_id").limit(25)

    @registry.add(
        "upsert_replace",
        "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 "
        "UNION ALL SELECT c_custkey, 'new', c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0 "
        "UNION ALL SELECT 1000000 + c_custkey, 'new', c_acctbal + 1 FROM customer WHERE c_custkey % 50 = 0",
    )
    def _(spark, folder) -> DataFrame:
        base = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
        return dml.upsert(base, _changes(base), ["c_custkey"])

    @registry.add(
        "insert_ignore",
        "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL "
        "SELECT 1000000 + c_custkey, 'new', c_acctbal + 1 FROM customer WHERE c_custkey % 50 = 0",
    )
    def _(spark, folder) -> DataFrame:
        base = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
        return dml.upsert(base, _changes(base), ["c_custkey"], "ignore")

    @registry.add(
        "update_where",
        "SELECT id, CASE WHEN age > 40 THEN age + 1 ELSE age END AS age FROM users",
    )
    def _(spark, folder) -> DataFrame:
        return dml.update(table(spark, folder, "users").select("id", "age"), F.col("age") > 40, {"age": F.col("age") + 1})

    @registry.add("delete_where", "SELECT id, age FROM users WHERE NOT coalesce(age > 40, false)")
    def _(spark, folder) -> DataFrame:
        return dml.delete(table(spark, folder, "users").select("id", "age"), F.col("age") > 40)

    @registry.add(
        "delete_order_limit",
        "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)",
    )
    def _(spark, folder) -> DataFrame:
        rows = table(spark, folder, "orders")
        left = dml.delete_first(rows, F.col("o_orderstatus") == "F", [F.col("o_totalprice").desc()], 100, ["o_orderkey"])
        return left.select("o_orderkey")

    @registry.add("delete_joined", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
    def _(spark, folder) -> DataFrame:
        others = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
        return dml.delete_joined(table(spark, folder, "customer").select("c_custkey"), others, ["c_custkey"])

    @registry.add("check_duplicates", "SELECT id, count(*) AS n FROM shop_orders WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
    def _(spark, folder) -> DataFrame:
        return dml.duplicates(table(spark, folder, "shop_orders"), ["id"])

    @registry.add(
        "check_orphans",
        "SELECT id, user_id FROM shop_orders o WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = o.user_id)",
    )
    def _(spark, folder) -> DataFrame:
        found = dml.orphans(table(spark, folder, "shop_orders").select("id", "user_id"), "user_id", table(spark, folder, "users"), "id")
        return found.select("id", "user_id")

    @registry.add(
        "check_violations",
        "SELECT 'age' AS \"check\", CAST(count_if(NOT (age BETWEEN 0 AND 120)) AS BIGINT) AS n FROM users UNION ALL SELECT 'email', CAST(count_if(NOT (email <> '')) AS BIGINT) FROM users",
    )
    def _(spark, folder) -> DataFrame:
        return dml.violations(table(spark, folder, "users"), age=F.col("age").between(0, 120), email=F.col("email") != "")

    @registry.add(
        "analyze_table",
        " UNION ALL ".join(
            f"SELECT '{k}' AS name, count(*) AS \"rows\", count(DISTINCT {k}) AS ndv, CAST(count_if({k} IS NULL) AS BIGINT) AS nulls, "
            f"CAST(min({k}) AS VARCHAR) AS low, CAST(max({k}) AS VARCHAR) AS high FROM users"
            for k in ("id", "age", "name")
        ),
    )
    def _(spark, folder) -> DataFrame:
        return dml.column_statistics(table(spark, folder, "users"), ["id", "age", "name"])

    @registry.add(
        "partitioned_table",
        "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS lo FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus",
    )
    def _(spark, folder) -> DataFrame:
        place = scratch(spark, folder, "orders_by_status")
        rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
        rows.repartition("o_orderstatus", F.pmod("o_orderkey", F.lit(8))).sortWithinPartitions("o_orderkey").write.mode(
            "overwrite"
        ).partitionBy("o_orderstatus").parquet(place)
        kept = spark.read.parquet(place).where(F.col("o_orderstatus").isin("F", "P"))
        return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"))

    @registry.add(
        "materialized_view",
        "SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    )
    def _(spark, folder) -> DataFrame:
        sources = {t: f"{folder}/{t}.parquet" for t in ("customer", "nation")}
        text = "SELECT n_regionkey, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey"
        view = dml.MaterializedView(spark, scratch(spark, folder, "customers_by_region"), sources, text)
        view.read()
        return view.read()

    @registry.add(
        "stream_buckets_batch",
        "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    )
    def _(spark, folder) -> DataFrame:
        rows = table(spark, folder, "events")
        start = streams.bucket(F.col("ts"), "hour").cast("timestamp_ntz").alias("start")
        return rows.groupBy(start, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _changes(base: DataFrame) -> DataFrame:
    fresh = base.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("new")).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    more = fresh.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    return fresh.unionByName(more)


def _query(size: int) -> list[float]:
    return [((i * 37) % 17 - 8) / 10 for i in range(size)]


def _statement(registry: Registry, name: str, statement: str, tables: tuple[str, ...], oracle: str) -> None:
    @registry.add(name, oracle)
    def _(spark, folder) -> DataFrame:
        return frontend.run(spark, statement, {t: table(spark, folder, t) for t in tables})


def _knn(registry: Registry, metric: str, distance: str) -> None:
    @registry.add(f"knn_{metric}", f"SELECT vec_id, round({distance}, 4) AS distance FROM embeddings ORDER BY {distance}, vec_id LIMIT 10")
    def _(spark, folder) -> DataFrame:
        rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
        size = len(rows.select("embedding").first()[0])
        found = search.knn(rows, "embedding", _query(size), 10, "vec_id", metric)
        return found.select("vec_id", F.round("distance", 4).alias("distance"))
