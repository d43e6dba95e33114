"""Queries of the general data-processing operators (p1 to p3)."""

from __future__ import annotations

from larkspur.operators import changes, ledger, rolling
from larkspur.registry import Registry
from larkspur.session import table

P1 = """
WITH once AS (
  SELECT user_id, CAST(placed_at AS DATE) AS day, CAST(amount * 100 AS BIGINT) AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS rn FROM shop_orders)
  WHERE rn = 1 AND user_id IS NOT NULL AND placed_at IS NOT NULL
    AND placed_at <> TIMESTAMP '1970-01-01 00:00:00'
), daily AS (
  SELECT user_id, day, sum(c) AS c, count(c) AS v, count(*) AS n FROM once GROUP BY ALL
), calendar AS (
  SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT user_id, min(day) AS lo, max(day) AS hi FROM daily GROUP BY user_id)
), filled AS (
  SELECT user_id, day, coalesce(c, 0) AS c, coalesce(v, 0) AS v, coalesce(n, 0) AS n
  FROM calendar LEFT JOIN daily USING (user_id, day)
), rolled AS (
  SELECT user_id, day,
    sum(c) OVER w7 AS c7, sum(v) OVER w7 AS v7, sum(n) OVER w7 AS n7, count(*) OVER w7 AS d7,
    sum(c) OVER w30 AS c30, sum(v) OVER w30 AS v30, sum(n) OVER w30 AS n30, count(*) OVER w30 AS d30
  FROM filled
  WINDOW w7 AS (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING),
         w30 AS (PARTITION BY user_id ORDER BY day ROWS 29 PRECEDING)
)
SELECT user_id, day,
  CAST(n7 AS BIGINT) AS n_7, CAST(c7 AS DOUBLE) / 100 AS total_7,
  CASE WHEN v7 > 0 THEN CAST(c7 AS DOUBLE) / CAST(v7 AS DOUBLE) / 100 END AS avg_7, CAST(c7 AS DOUBLE) / d7 / 100 AS day_avg_7,
  CAST(n30 AS BIGINT) AS n_30, CAST(c30 AS DOUBLE) / 100 AS total_30,
  CASE WHEN v30 > 0 THEN CAST(c30 AS DOUBLE) / CAST(v30 AS DOUBLE) / 100 END AS avg_30, CAST(c30 AS DOUBLE) / d30 / 100 AS day_avg_30
FROM rolled
"""

#: Within one write-set deletes come first and the last put of a key stands.
STATE = """
WITH ops AS (
  SELECT origin, lsn, 1 AS rank, p.pos AS pos, p.x.k AS k, p.x.v AS v FROM (
    SELECT origin, lsn, unnest(list_transform(puts, lambda x, i: {{'pos': i, 'x': x}})) AS p
    FROM write_events WHERE lsn IS NOT NULL)
  UNION ALL
  SELECT origin, lsn, 0, 0, unnest(deletes), NULL FROM write_events WHERE lsn IS NOT NULL
), last AS (
  SELECT *, row_number() OVER (PARTITION BY origin, k ORDER BY lsn DESC, rank DESC, pos DESC) AS rn
  FROM ops WHERE k IS NOT NULL
)
SELECT {columns} FROM last WHERE rn = 1 AND rank = 1
"""

P3 = """
WITH settled AS (
  SELECT run_id, arg_max(row(replica_id, origin, started_at, from_lsn, lsn, state), logged_at) AS r
  FROM repl_runs GROUP BY run_id
), ok AS (
  SELECT r[1] AS replica_id, r[2] AS origin, r[3] AS started_at, r[4] AS lo, r[5] AS hi
  FROM settled WHERE r[6] = 'ok'
), items AS (
  SELECT origin, lsn, min(arrived_at) AS first_at FROM write_events WHERE lsn IS NOT NULL GROUP BY ALL
), follows AS (SELECT DISTINCT origin, replica_id FROM repl_runs)
SELECT i.origin, f.replica_id, i.lsn FROM items i JOIN follows f USING (origin)
WHERE NOT EXISTS (
  SELECT 1 FROM ok WHERE ok.origin = i.origin AND ok.replica_id = f.replica_id
    AND ok.lo < i.lsn AND i.lsn <= ok.hi AND i.first_at <= ok.started_at)
"""

#: States at one moment, with leases of six hours.
P3_STATES = P3[: P3.index("SELECT i.origin, f.replica_id")] + """, moment AS (SELECT TIMESTAMP '{now}' AS t), held AS (
  SELECT r[1] AS replica_id, r[2] AS origin, min(r[4]) AS lo FROM settled, moment
  WHERE r[6] = 'running' AND r[3] <= t AND r[3] > t - INTERVAL {seconds} SECOND GROUP BY ALL
), states AS (
  SELECT i.origin, f.replica_id, CASE WHEN EXISTS (
    SELECT 1 FROM ok WHERE ok.origin = i.origin AND ok.replica_id = f.replica_id
      AND ok.lo < i.lsn AND i.lsn <= ok.hi AND i.first_at <= ok.started_at) THEN 'done'
    WHEN i.lsn > h.lo THEN 'leased' ELSE 'pending' END AS state
  FROM items i JOIN follows f USING (origin) LEFT JOIN held h ON h.origin = i.origin AND h.replica_id = f.replica_id
)
SELECT origin, replica_id, CAST(count_if(state = 'pending') AS BIGINT) AS pending, CAST(count_if(state = 'leased') AS BIGINT) AS leased,
  CAST(count_if(state = 'done') AS BIGINT) AS done FROM states GROUP BY ALL
"""
NOW, LEASE = "2031-05-03 12:00:00", 3600 * 6


def register(registry: Registry) -> None:
    @registry.add("p1_rolling", P1)
    def _(spark, folder):
        return rolling.rolling_totals(table(spark, folder, "shop_orders"))

    @registry.add("p2_found", STATE.format(columns="origin, k, lsn"))
    def _(spark, folder):
        return changes.current_state(table(spark, folder, "write_events"), with_value=False)

    @registry.add("p2_state", STATE.format(columns="origin, k, v, lsn"))
    def _(spark, folder):
        return changes.current_state(table(spark, folder, "write_events"))

    @registry.add("p3_found", P3)
    def _(spark, folder):
        return ledger.open_items(table(spark, folder, "write_events"), table(spark, folder, "repl_runs"))

    @registry.add("p3_states", P3_STATES.format(now=NOW, seconds=LEASE))
    def _(spark, folder):
        events, runs = table(spark, folder, "write_events"), table(spark, folder, "repl_runs")
        return ledger.item_states(events, runs, NOW, LEASE)
