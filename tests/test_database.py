"""Statements that create and change tables, and how many rows they say they changed."""

from __future__ import annotations

from decimal import Decimal

import pytest

from larkspur.plans.database import ConstraintError, Database, information_schema
from larkspur.plans.frontend import Unsupported


@pytest.fixture
def base(spark, tmp_path):
    return Database(spark, str(tmp_path))


def rows(base, sql):
    return [tuple(r) for r in base.run(sql).collect()]


UPSERT = "ON DUPLICATE KEY UPDATE amount = VALUES(amount)"
#: What each statement in turn says it changed: 1 for a new row, 2 for one that an insert
#: updated or replaced, 0 for one that was so already.
CHANGES = [
    (f"INSERT INTO stock VALUES ('bolt', 5), ('nut', 6) {UPSERT}", 2),
    (f"INSERT INTO stock VALUES ('bolt', 8), ('nut', 6), ('pin', 1) {UPSERT}", 3),
    (f"INSERT INTO stock VALUES ('rod', 2), ('Rod', 3), ('rod', 3) {UPSERT}", 3),
    ("INSERT INTO stock VALUES ('bolt', 9), ('cap', 0) ON DUPLICATE KEY UPDATE amount = stock.amount + 10 * VALUES(amount)", 3),
    ("REPLACE INTO stock VALUES ('nut', 6), ('pin', 4), ('key', 7)", 4),
    ("INSERT IGNORE INTO stock VALUES ('key', 70), ('cam', 1), ('cam', 2)", 1),
    ("UPDATE stock SET amount = 4 WHERE amount <= 4", 3),
    ("UPDATE stock SET amount = amount - 1 WHERE item = 'none' OR amount > 90", 1),
    ("DELETE FROM stock WHERE amount = 4 AND item <> 'PIN'", 3),
    ("DELETE FROM stock WHERE amount < 0", 0),
]


def test_changed_rows(base):
    base.run("CREATE TABLE stock (item VARCHAR(8) PRIMARY KEY, amount INT)")
    assert [base.run(sql).rows for sql, _ in CHANGES] == [n for _, n in CHANGES]
    assert rows(base, "SELECT item, amount FROM stock ORDER BY item") == [("bolt", 97), ("key", 7), ("nut", 6), ("pin", 4)]
    with pytest.raises(ConstraintError):
        base.run("INSERT INTO stock VALUES ('Pin', 5)")


def test_keys_defaults_and_checks(base):
    base.run(
        "CREATE TABLE k (id BIGINT AUTO_INCREMENT PRIMARY KEY, `key` VARCHAR(4) UNIQUE, label TEXT, price DECIMAL(8,2) DEFAULT 1.5, kind ENUM('a','b') NOT NULL DEFAULT 'a', CHECK (price > 0))"
    )
    assert base.run("INSERT INTO k (`key`, label) VALUES ('a', 'old-a'), ('b', 'old-b')").rows == 2
    assert base.run("INSERT INTO k (`key`, label) VALUES ('A', 'new'), ('c', 'x') ON DUPLICATE KEY UPDATE label = CONCAT(label, '+', VALUES(label)), price = price * 2").rows == 3
    got = rows(base, "SELECT `key`, label, price, kind FROM k ORDER BY `key`")
    assert got == [("a", "old-a+new", Decimal("3.00"), "a"), ("b", "old-b", Decimal("1.50"), "a"), ("c", "x", Decimal("1.50"), "a")]
    for bad in ("INSERT INTO k SET `key` = 'd', price = -1", "INSERT INTO k SET `key` = 'toolong'", "INSERT INTO k SET kind = 'z'", "UPDATE k SET kind = NULL", "UPDATE k SET `key` = 'q'"):
        with pytest.raises(ConstraintError):
            base.run(bad)
    assert base.run("INSERT INTO k SET label = 'none'").rows == 1 and base.run("INSERT INTO k SET label = 'none'").rows == 1
    with pytest.raises(ConstraintError):
        base.run("ALTER TABLE k ADD UNIQUE (label)")


def test_joined_and_limited_changes(base, spark):
    base.given["dim"] = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, w string")
    base.run("CREATE TABLE t AS SELECT k, w, 0 AS n FROM dim")
    assert base.run("UPDATE t AS a JOIN dim ON a.k = dim.k SET a.n = dim.k * 10 WHERE dim.w <> 'X'").rows == 2
    assert sorted(rows(base, "SELECT w, n FROM t")) == [("x", 0), ("y", 20), ("z", 20)]
    assert base.run("UPDATE t SET n = 7 ORDER BY w DESC LIMIT 1").rows == 1
    assert rows(base, "SELECT w FROM t WHERE n = 7") == [("z",)]
    assert base.run("INSERT INTO t (w, k) SELECT UPPER(w), 9 FROM dim WHERE k = 2").rows == 2
    assert base.run("DELETE a FROM t AS a JOIN dim ON a.k = dim.k").rows == 3
    assert base.run("DELETE FROM t ORDER BY w LIMIT 1").rows == 1 and rows(base, "SELECT w, n FROM t") == [("Z", None)]
    assert base.run("TRUNCATE TABLE t").rows == 0 and rows(base, "SELECT COUNT(*) FROM t") == [(0,)]


def test_functions_hooks_and_streams(base, spark):
    from larkspur.functions import vectors
    from larkspur.session import cached, stream

    base.run("CREATE TABLE d (id INT PRIMARY KEY, body TEXT)")
    base.run("INSERT INTO d VALUES (1, 'Privacy first'), (2, 'none'), (3, NULL)")
    base.run("CREATE FUNCTION half(x INT) RETURNS DECIMAL(10,4) DETERMINISTIC RETURN x / 2")
    assert rows(base, "SELECT half(id) FROM d WHERE id = 1") == [(Decimal("0.5000"),)]
    vectors.embedder(spark, lambda texts: [[len(t), 0.0] for t in texts])
    assert [r[1] for r in rows(base, "SELECT id, ai_embed(body) FROM d ORDER BY id")] == [[13.0, 0.0], [4.0, 0.0], None]
    kept = cached(base.frame("d"))
    assert [len(b) for b in stream(kept.repartition(2), 2)] == [2, 1]
    kept.unpersist()


def test_hybrid_in_sql(base, spark):
    base.given["docs"] = spark.createDataFrame([(1, "Privacy law", [1.0, 0.0]), (2, "privacy", [0.0, 1.0]), (3, "other", [0.9, 0.0]), (4, None, None)], "id int, body string, v array<float>")
    got = rows(base, "SELECT id, HYBRID(body, 'privacy', v, '[1, 0]') AS score FROM docs WHERE id < 9 ORDER BY score DESC, id LIMIT 3")
    assert [i for i, _ in got] == [1, 2, 3]
    assert [s for _, s in got] == pytest.approx([1 / 61 + 1 / 61, 1 / 63 + 1 / 62, 1 / 62])


def test_definitions(base):
    base.run("CREATE TABLE a (id INT PRIMARY KEY, s VARCHAR(9) COLLATE utf8mb4_bin)")
    base.run("INSERT INTO a VALUES (1, 'x'), (2, 'X')")
    base.run("CREATE TABLE b LIKE a")
    base.run("INSERT INTO b SELECT * FROM a")
    base.run("ALTER TABLE b ADD COLUMN n INT DEFAULT 4 AFTER id, RENAME COLUMN s TO t, MODIFY n BIGINT")
    assert rows(base, "SELECT * FROM b ORDER BY id") == [(1, 4, "x"), (2, 4, "X")]
    base.run("ALTER TABLE b DROP COLUMN n")
    base.run("RENAME TABLE b TO c")
    base.run("CREATE VIEW v AS SELECT COUNT(*) AS n FROM a WHERE s = 'x'")
    base.run("INSERT INTO a VALUES (3, 'x')")
    assert rows(base, "SELECT n FROM v") == [(2,)]
    assert [r[0] for r in rows(base, "SHOW TABLES")] == ["a", "c", "v"]
    assert rows(base, "DESCRIBE a") == [("id", "int", "NO", "PRI", None), ("s", "string", "YES", "", None)]
    assert rows(base, "SHOW INDEX FROM a") == [("a", "PRIMARY", 1, "id")]
    assert "PRIMARY KEY (`id`)" in rows(base, "SHOW CREATE TABLE a")[0][1] and "Scan" in rows(base, "EXPLAIN SELECT * FROM a")[0][0]
    assert {r.name: (r.rows, r.ndv) for r in base.run("ANALYZE TABLE a").collect()} == {"id": (3, 3), "s": (3, 2)}
    base.run("SET @low = 1 + 1")
    assert rows(base, "SELECT id FROM a WHERE id > @low") == [(3,)]
    views = information_schema(base)
    assert views["columns"].count() == 4 and views["tables"].where("table_type = 'VIEW'").count() == 1
    base.run("DROP TABLE IF EXISTS c, nothing")
    with pytest.raises(LookupError):
        base.run("DROP TABLE c")
    with pytest.raises(Unsupported):
        base.run("GRANT ALL ON a TO b")
