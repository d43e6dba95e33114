"""Queries of the operators for training data (p4 to p9)."""

from __future__ import annotations

from larkspur.llm import distinct, leaks, mojibake, neighbours, quantiles, tokens
from larkspur.registry import Registry
from larkspur.session import table

USABLE = """
WITH points AS (
  SELECT vec_id, index_id, metric, dim, list_transform(vectors, lambda x: CAST(x AS DOUBLE)) AS v FROM index_snapshots
  WHERE node_key IS NOT NULL AND len(vectors) = dim AND len(list_filter(vectors, lambda x: x IS NOT NULL AND isfinite(x))) = dim
    AND len(list_filter(vectors, lambda x: x <> 0)) > 0
)"""

#: Every vector against every other of its index.
P4 = (
    USABLE
    + """, pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, CASE a.metric
    WHEN 0 THEN list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
    WHEN 1 THEN greatest(round(1 - list_cosine_similarity(a.v, b.v), 12), 0) ELSE -list_inner_product(a.v, b.v) END AS d
  FROM points a JOIN points b ON a.index_id = b.index_id AND a.metric = b.metric AND a.dim = b.dim AND a.vec_id <> b.vec_id
), ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM pairs)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM ranked WHERE r <= 5
"""
)
P4_RECALL = USABLE + "SELECT index_id, count(*) AS queries, true AS enough FROM points WHERE vec_id % 100 = 0 GROUP BY index_id"

NARROW = r"""
WITH known AS (
  SELECT *, CASE WHEN placed_at <> TIMESTAMP '1970-01-01 00:00:00' THEN CAST(placed_at AS DATE) END AS day,
    nullif(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), '') AS kind
  FROM shop_orders
)"""
P5_BOUNDS = (
    NARROW
    + """, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS rn FROM known) WHERE rn = 1 AND amount IS NOT NULL)
SELECT 'day' AS scope, day, kind AS status, count(*) AS n, true AS within FROM once GROUP BY ALL
UNION ALL SELECT 'all', NULL, kind, count(*), true FROM once GROUP BY ALL
"""
)
P6_BOUNDS = (
    NARROW
    + """, buyers AS (SELECT * FROM known WHERE user_id IS NOT NULL)
SELECT 'day_status' AS scope, day, kind AS status, count(DISTINCT user_id) AS exact, true AS within FROM buyers GROUP BY ALL
UNION ALL SELECT 'day', day, NULL, count(DISTINCT user_id), true FROM buyers GROUP BY ALL
UNION ALL SELECT 'status', NULL, kind, count(DISTINCT user_id), true FROM buyers GROUP BY ALL
UNION ALL SELECT 'all', NULL, NULL, count(DISTINCT user_id), true FROM buyers
"""
)


def register(registry: Registry) -> None:
    @registry.add("p4_found", P4)
    def _(spark, folder):
        return neighbours.neighbour_pairs(neighbours.forest_neighbours(table(spark, folder, "index_snapshots")))

    @registry.add("p4_recall", P4_RECALL)
    def _(spark, folder):
        measured = neighbours.recall(table(spark, folder, "index_snapshots"))
        return measured.selectExpr("index_id", "queries", "recall >= 0.9 AS enough")

    @registry.add("p5_percentiles")
    def _(spark, folder):
        return quantiles.order_percentiles(table(spark, folder, "shop_orders"))

    @registry.add("p5_digests")
    def _(spark, folder):
        return quantiles.order_digests(table(spark, folder, "shop_orders"))

    @registry.add("p5_bounds", P5_BOUNDS)
    def _(spark, folder):
        return quantiles.percentile_bounds(table(spark, folder, "shop_orders"))

    @registry.add("p6_registers")
    def _(spark, folder):
        return distinct.buyer_registers(table(spark, folder, "shop_orders"))

    @registry.add("p6_distinct")
    def _(spark, folder):
        return distinct.distinct_buyers(table(spark, folder, "shop_orders"))

    @registry.add("p6_bounds", P6_BOUNDS)
    def _(spark, folder):
        return distinct.distinct_bounds(table(spark, folder, "shop_orders"))

    @registry.add("p7_ids")
    def _(spark, folder):
        return tokens.encode(table(spark, folder, "documents"))

    @registry.add("p8_found")
    def _(spark, folder):
        return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "test_items"))

    @registry.add("p9_found")
    def _(spark, folder):
        return mojibake.find_garbled(table(spark, folder, "documents"))

    @registry.add("p9_restored")
    def _(spark, folder):
        return mojibake.restore_garbled(table(spark, folder, "documents"))
