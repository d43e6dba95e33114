"""Operators and functions on small fixtures with known answers."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspur.functions import datetimes as D
from larkspur.functions import jsons as J
from larkspur.functions import maths as M
from larkspur.functions import semantics as S
from larkspur.functions import strings as T
from larkspur.operators import aggregates as A
from larkspur.operators import dml, joins, recursive, search
from larkspur.operators import windows as W
from larkspur.plans import frontend
from larkspur.sources import files
from larkspur.streaming import events as streams


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_arithmetic(spark):
    ten, three = F.lit(10), F.lit(3)
    row = one(spark, S.divide(ten, three), S.divide(ten, F.lit(0)), S.int_divide(F.lit(-7), F.lit(2)), S.modulo(F.lit(-7), three))
    assert (float(row[0]), row[1], row[2], row[3]) == (3.3333, None, -3, -1)
    assert float(one(spark, S.divide(F.lit("7.00").cast("decimal(5,2)"), F.lit(2), 2))[0]) == 3.5
    bits = one(spark, S.bit_not(F.lit(5)), S.shift_left(F.lit(1), F.lit(63)), S.shift_right(F.lit(-1), F.lit(60)))
    assert [int(b) for b in bits] == [18446744073709551610, 9223372036854775808, 15]


def test_number_prefix_and_casts(spark):
    texts = ["2abc", "abc", "-3.5x", "1e2z", "", None, " 7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.num_prefix(F.col("t"))).collect()] == [2.0, 0.0, -3.5, 100.0, 0.0, None, 7.0]
    assert [r[0] for r in df.select(S.to_signed(F.col("t"))).collect()] == [2, 0, -3, 1, 0, None, 7]


def test_collation(spark):
    words = ["café", "CAFE", "Straße", "strasse", "cat", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert sorted(r[1] for r in df.groupBy(S.fold(F.col("w")).alias("k")).count().collect()) == [1, 1, 2, 2]
    assert df.where(T.like(F.col("w"), "ca%")).count() == 3
    assert df.where(T.like(F.col("w"), "ca!%", "!")).count() == 0


def test_week_modes(spark):
    days = [date(2024, 1, 1), date(2023, 1, 1), date(2024, 12, 30), date(2021, 1, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(*[D.week(F.col("d"), m) for m in range(8)]).collect()
    assert tuple(got[0]) == (0, 1, 53, 1, 1, 1, 1, 1)
    assert tuple(got[1]) == (1, 0, 1, 52, 1, 0, 1, 52)
    assert [r[0] for r in df.select(D.yearweek(F.col("d"), 3)).collect()] == [202401, 202252, 202501, 202053]


def test_date_patterns():
    assert D.pattern_of("%Y-%m-%d") == "yyyy'-'MM'-'dd"
    assert D.pattern_of("at %H o'clock %q %%") == "'at 'HH' o''clock %q %'"


def test_json_edits(spark):
    doc = F.lit('{"b": 1, "a": [1, {"x": null}]}')
    assert one(spark, J.extract(doc, "$.a"), J.set_value(doc, "$.c", True), J.remove(doc, "$.a[0]"), J.contains(doc, 1, "$.a")) == (
        '[1, {"x": null}]',
        '{"b": 1, "a": [1, {"x": null}], "c": true}',
        '{"b": 1, "a": [{"x": null}]}',
        1,
    )
    assert one(spark, J.extract(F.lit("{bad"), "$.a"), J.length(doc), J.type_of(doc)) == (None, 2, "OBJECT")


def test_rollup_and_average(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("b", 100)], "g string, v int")
    got = {r[0]: float(r[1]) for r in A.rollup(df, ["g"], A.avg_exact(F.col("v"))).collect()}
    assert got == {None: 40.0, "a": 20.0, "b": 100.0}


def test_facet_and_lists(spark):
    df = spark.createDataFrame([("x", "db"), ("x", "db"), ("x", "sys"), ("x", None), ("y", None)], "g string, v string")
    got = {r.g: r.facet for r in A.facet(df, ["g"], "v").collect()}
    assert got == {"x": '{"db": 2, "sys": 1}', "y": "{}"}
    assert A.facet(df, ["g"], "v", 1).where("g = 'x'").first().facet == '{"db": 2}'
    cut = df.groupBy("g").agg(A.group_concat(F.concat("v", F.lit("é")), limit=3).alias("l")).collect()
    assert {r.g: r.l for r in cut} == {"x": "db", "y": None}


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 101)] + [("b", v) for v in (10, 20, 30)], "s string, v int")
    got = {r[0]: r[1] for r in df.groupBy("s").agg(A.percentile(F.col("v"), 0.95)).collect()}
    assert got == {"a": pytest.approx(95.05), "b": pytest.approx(29.0)}


def test_bits_of_nothing(spark):
    row = spark.range(0).agg(A.bit_or(F.col("id")), A.bit_and(F.col("id")), A.bit_xor(F.col("id"))).first()
    assert [int(x) for x in row] == [0, 18446744073709551615, 0]


def test_groups_frame(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([None, None, 1, 1, 2, 3])], "id int, k int")
    out = W.groups_frame(df, [], [F.col("k")], -1, 0, n=F.count(F.lit(1)))
    assert [r.n for r in out.orderBy("id").collect()] == [2, 2, 4, 4, 3, 2]
    with pytest.raises(ValueError):
        W.groups_frame(df, [], [F.col("k")], 1, 0, n=F.count(F.lit(1)))
    with pytest.raises(ValueError):
        W.Named(partition=("a",)).over(partition=["b"])


def test_joins(spark):
    left = spark.createDataFrame([(1, 1.5), (2, None), (3, 9.0)], "id int, p double")
    right = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.5, 1.5), (3, None, 5.0), (4, 5.0, 1.0)], "r int, lo double, hi double")
    assert sorted((x.id, x.r) for x in joins.band(left, right, "p", "lo", "hi", 0.5).collect()) == [(1, 1), (1, 2)]
    assert sorted(x.id for x in joins.band(left, right, "p", "lo", "hi", 0.5, "left_anti").collect()) == [2, 3]
    far = spark.createDataFrame([(1, 0.0, 1e9), (2, 8.5, 9.5)], "r int, lo double, hi double")
    assert sorted((x.id, x.r) for x in joins.band(left, far, "p", "lo", "hi", 0.5).collect()) == [(1, 1), (3, 1), (3, 2)]
    assert sorted(x.id for x in joins.band(left, far, "p", "lo", "hi", 0.5, "left_semi").collect()) == [1, 3]
    assert [x.id for x in joins.band(left, far, "p", "lo", "hi", 0.5, "left_anti").collect()] == [2]
    assert joins.band(left, far.where("r > 9"), "p", "lo", "hi", 0.5).count() == 0
    assert joins.broadcast_if_small(far).count() == 2 and joins.broadcast_if_small(spark.range(9), 1).count() == 9
    hot = spark.createDataFrame([(1, i) for i in range(50)] + [(None, 0)], "k int, v int")
    assert joins.salted(hot, spark.createDataFrame([(1, "a"), (None, "n")], "k int, w string"), "k").count() == 50
    assert joins.natural(left, right.withColumnRenamed("r", "ID")).count() == 3


def test_fixpoint_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    step = lambda new: new.join(edges, new.n == edges.a).select(F.col("b").alias("n"))
    got = recursive.fixpoint(spark.createDataFrame([(1,)], "n int"), step)
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]
    with pytest.raises(recursive.TooDeep):
        recursive.fixpoint(spark.createDataFrame([(1,)], "n int"), lambda d: d.select((F.col("n") + 1).alias("n")), limit=3)


def test_search(spark):
    docs = spark.createDataFrame(
        [(1, "Red fox, red hen", [0.0, 1.0]), (2, "a fox", [1.0, 0.0]), (3, None, None), (4, "nothing", [5.0])],
        "id int, body string, v array<float>",
    )
    score = search.match_score([F.col("body")], "red red fox!")
    assert [r[0] for r in docs.orderBy("id").select(score).collect()] == [3, 1, 0, 0]
    strict = search.match_boolean([F.col("body")], "+fox -hen")
    assert [r[0] for r in docs.orderBy("id").select(strict).collect()] == [0, 1, 0, 0]
    assert [r.id for r in search.knn(docs, "v", [1.0, 0.1], 5, "id").collect()] == [2, 1]
    ranks = {r.id: r.score for r in search.hybrid(docs, "id", ["body"], "hen", "v", [1.0, 0.0]).collect()}
    assert ranks == {1: pytest.approx(1 / 61 + 1 / 62), 2: pytest.approx(1 / 61)}
    stemmed = search.match_score([F.col("body")], "foxes hens", stem=True)
    assert [r[0] for r in docs.orderBy("id").select(stemmed).collect()] == [2, 1, 0, 0]
    index = search.postings(docs, "id", ["body"])
    assert {r.id: r.score for r in search.lookup(index, "id", "red fox").collect()} == {1: 2, 2: 1}


STEMS = """consigned consign consistency consist knackeries knackeri knightly knight generously generous happy happi
skies sky dying die running run hopping hop hoped hope relational relat conditional condit rational ration
digitizer digit predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous sensitivity sensit sensibility sensibl communication communic ties tie cries cri gas gas
gaps gap kiwis kiwi agreed agre succeed succeed adoption adopt controlling control sleepily sleepili""".split()


def test_stems():
    from larkspur.functions.stemming import stem

    pairs = dict(zip(STEMS[::2], STEMS[1::2]))
    assert {w: stem(w) for w in pairs} == pairs


def test_table_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "m")], "k int, v string")
    order = F.col("v")
    replaced = sorted(dml.upsert(base, new, ["k"], order=order).collect(), key=str)
    assert sorted(map(tuple, replaced), key=str) == sorted([(1, "a"), (2, "x"), (3, "z"), (None, "n"), (None, "m")], key=str)
    kept = dml.upsert(base, new, ["k"], "ignore", order)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a"), (2, "b"), (3, "z"), (None, "n"), (None, "m")], key=str)
    assert dml.delete(base, F.col("k") > 1).count() == 2
    assert dml.update(base, F.col("k") > 1, {"v": F.lit("q")}).where("v = 'q'").count() == 1
    assert sum(r.n for r in dml.histogram(spark.range(100), "id", 4).collect()) == 100


def test_materialized_view_refreshes(spark, tmp_path):
    source = str(tmp_path / "t")
    spark.range(3).write.parquet(source)
    view = dml.MaterializedView(spark, str(tmp_path / "v"), {"t": source}, "SELECT count(*) AS n FROM {t}")
    assert view.read().first().n == 3 and not view.stale()
    spark.range(2).write.mode("append").parquet(source)
    assert view.stale() and view.read().first().n == 5
    uri = dml.MaterializedView(spark, f"file://{tmp_path}/u", {"t": f"file://{source}"}, "SELECT count(*) AS n FROM {t}")
    assert uri.stale() and uri.read().first().n == 5 and not uri.stale()


def test_load_delimited(spark, tmp_path):
    place = tmp_path / "in.txt"
    place.write_text('head\nsecond\n1,"a,b",\\N\nx,c,2.5\n')
    df = files.load_delimited(spark, str(place), "id int, extra string, t string, v double", ",", '"', lines="\n", ignore_lines=2, columns=["id", "t", "v"])
    assert [tuple(r) for r in df.collect()] == [(1, None, "a,b", None), (None, None, "c", 2.5)]
    out = files.create_table_as(df, str(tmp_path / "out"), order=["id"])
    files.insert_into(df, out)
    assert spark.read.parquet(out).count() == 4
    assert files.point_lookup(spark.read.parquet(out), id=1).count() == 2
    assert files.columns_view({"t": df}, spark).where("column_name = 'v'").first().data_type == "double"


def test_head_lines_of_many_files(spark, tmp_path):
    for i in range(16):
        (tmp_path / f"{i}.txt").write_text(f"head\nsecond\n{i},a\n{i},b\n")
    df = files.load_delimited(spark, str(tmp_path), "id int, t string", ",", lines="\n", ignore_lines=2)
    assert sorted(tuple(r) for r in df.collect()) == sorted((i, t) for i in range(16) for t in "ab")


def test_sorted_tables_skip_row_groups(spark, tmp_path):
    """CTAS in the order of a column leaves row groups of disjoint ranges, which a pushed
    filter skips."""
    import pyarrow.parquet as pq

    spark.conf.set("parquet.block.size", str(1 << 14))
    try:
        place = files.create_table_as(spark.range(0, 60000, 1, 1).selectExpr("(id * 7919) % 60000 AS k", "uuid() AS t"), str(tmp_path / "t"), order=["k"])
    finally:
        spark.conf.unset("parquet.block.size")
    meta = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata
    ranges = [(s.min, s.max) for s in (meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups))]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    found = files.point_lookup(spark.read.parquet(place), k=77)
    assert "EqualTo(k,77)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_numbers_without_one_task(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS v")
    out = W.numbered(df, [F.col("v").desc()], "n")
    assert all(r.n == 1000 - r.v for r in out.collect()) and out.count() == 1000
    assert W.numbered(df.where("id < 0"), [F.col("v")], "n").count() == 0


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "b int")
    assert joins.not_in(left, right, "a", "b").count() == 0
    assert [r.a for r in joins.not_in(left, right.where("b is not null"), "a", "b").collect()] == [2]
    assert joins.not_in(left, right.where("b > 5"), "a", "b").count() == 3


def test_stored_fulltext_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Red foxes"), (2, "a fox and a fox"), (3, None)], "id int, body string")
    place = search.write_index(docs, "id", ["body"], str(tmp_path / "i"), stem=True)
    assert {r.id: r.score for r in search.read_index(spark, place, "id", "fox red", stem=True).collect()} == {1: 2, 2: 1}
    assert search.read_index(spark, place, "id", "none").count() == 0


def test_plans_have_no_single_task_or_unsized_broadcast(spark):
    """What the texts of the plans must not show."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    users, orders = spark.range(100).toDF("id"), spark.range(300).toDF("user_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(joins.not_in(users, orders, "id", "user_id"))
        assert "Expand" not in plan(dml.column_statistics(users.selectExpr("id", "id % 3 AS k"), ["id", "k"]))
        top = A.facet(users.selectExpr("id % 7 AS g", "id % 5 AS v"), ["g"], "v", 2)
        assert "WindowGroupLimit" in plan(top)
        docs = users.selectExpr("id", "'red' AS body", "array(float(id)) AS v")
        assert "SinglePartition" not in plan(search.hybrid(docs, "id", ["body"], "red", "v", [1.0]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_limits_of_numbers(spark):
    wide = F.lit("18446744073709551615").cast("decimal(20,0)")
    row = one(spark, S.divide(F.lit(10), F.lit("2.5").cast("decimal(3,1)")), S.to_unsigned(wide), S.round_to_signed(F.lit(1e19)), M.truncate(F.lit(1e30), 2), M.truncate(F.lit(-12.78), 1))
    assert (float(row[0]), int(row[1]), row[2], row[3], row[4]) == (4.0, 18446744073709551615, None, 1e30, -12.7)
    texts = one(spark, J.keys(F.lit('{"a\\"b": 1}')), J.quote(F.lit(None).cast("string")), J.extract(F.lit('{"a": 1.10}'), "$.a"), J.extract(F.lit("NaN"), "$"))
    assert texts == ('["a\\"b"]', None, "1.10", None)


def test_streaming_matches_batch(spark, tmp_path):
    rows = [(i, datetime(2030, 1, 1, i % 5, i), i % 3, "click", float(i)) for i in range(50)]
    place = tmp_path / "events.parquet"
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(str(place))
    stream = streams.read_stream(spark, str(tmp_path), "events")
    for name, build in (("w", streams.windowed_counts), ("s", streams.sessions)):
        query = build(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append")
        running = query.trigger(availableNow=True).start()
        running.awaitTermination()
        assert running.exception() is None
    assert sum(r.n for r in spark.table("w").collect()) == 50
    place = str(tmp_path / "state")

    def fold(before, batch):
        new = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        both = new if before is None else before.unionByName(new)
        return both.groupBy("user_id").agg(F.sum("n").alias("n"))

    for more in range(2):
        streams.apply_changes(stream, place, fold, str(tmp_path / "c")).awaitTermination()
        assert streams.state(spark, place).agg(F.sum("n")).first()[0] == 50 * (more + 1)
        df.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    # A batch that is run again gives the same state.
    fold(streams.state(spark, place, 1), df).write.mode("overwrite").parquet(f"{place}/epoch=1")
    assert streams.state(spark, place).agg(F.sum("n")).first()[0] == 100


D4, D8 = Decimal("3.5000"), Decimal("18446744073709551615")
STATEMENTS = [
    ("SELECT 1 FROM DUAL", [(1,)]),
    ("SELECT 1 WHERE 2 > 3", []),
    ("SELECT !0 = 0, 7 DIV 0, 7 / 2, -7 % 3", [(False, None, D4, -1)]),
    ("SELECT 7 * 3 DIV 2, 10 * 7 % 4, 2 + 3 * 4 - 1, -2 * -3, 1 << 2 + 1", [(10, 2, 13, 6, Decimal(8))]),
    ("SELECT SUM(v) / COUNT(*), CASE WHEN 1 THEN 6 END / 2, AVG(v) FROM t", [(Decimal(20), Decimal(3), Decimal(20))]),
    ("SELECT GREATEST(1, NULL, 3), SUBSTRING('hello', 0), LENGTH('é'), IF(1 > 2, 'a', 'b')", [(None, "", 2, "b")]),
    ("SELECT SUBSTRING('hello', -9, 3), ASCII('é'), SQRT(-1), TRUNCATE(1e30, 1), CEIL(1.5), JSON_QUOTE(NULL)", [("", 195, None, 1e30, 2, None)]),
    ("SELECT CAST(18446744073709551615 AS UNSIGNED), CAST('1.10' AS DECIMAL(4,2)), 18446744073709551615 + 1, ~0", [(D8, Decimal("1.10"), Decimal(0), D8)]),
    ("SELECT DATE_FORMAT('2024-03-05 06:07:08', '%d.%m.%y %H:%i') AS f", [("05.03.24 06:07",)]),
    ("SELECT CAST('9x' AS SIGNED), CAST(-1 AS UNSIGNED), CAST('2024-02-30' AS DATE)", [(9, D8, None)]),
    ("SELECT '2024-01-31' + INTERVAL 1 MONTH, DATE '2024-03-31' - INTERVAL 1 MONTH", [(date(2024, 2, 29), date(2024, 2, 29))]),
    ("SELECT EXTRACT(WEEK FROM NULL), WEEK('2024-01-15'), YEARWEEK('2024-12-30', 3), FROM_UNIXTIME(0, '%Y'), SEC_TO_TIME(90061), TIME('2024-01-01 10:11:12')", [(None, 2, 202501, "1970", "25:01:01", "10:11:12")]),
    ("SELECT g, STD(v) AS s FROM t GROUP BY g WITH ROLLUP ORDER BY g LIMIT 1, 18446744073709551615", [("a", 5.0), ("b", 0.0)]),
    ("SELECT GROUP_CONCAT(DISTINCT v ORDER BY v DESC SEPARATOR '/') AS l FROM t", [("30/20/10",)]),
    ("SELECT v FROM t WHERE g LIKE 'A' && v REGEXP '^1'", [(10,)]),
    ("SELECT v FROM t WHERE g = 'A' AND NOT v > 10", [(10,)]),
    ("SELECT 'x', '@x' AS x, @x + 1 AS y", [("x", "@x", 8)]),
    ("SELECT MATCH(w) AGAINST('+red -blue' IN BOOLEAN MODE) AS m FROM t ORDER BY v", [(1,), (0,), (0,)]),
    ("SELECT ROUND(VEC_DISTANCE(array(1.0, 2.0), '[1, 4]'), 2) AS d", [(4.0,)]),
    ("SELECT JSON_EXTRACT('{\"a\": 1.10}', '$.a'), JSON_VALID('NaN'), JSON_KEYS('{\"a\\\\\"b\": 1}'), JSON_TYPE('[1]')", [("1.10", 0, '["a\\"b"]', "ARRAY")]),
    ("SELECT BIT_AND(v), AVG(DISTINCT v), MEDIAN(v), FACET(g) FROM t WHERE v < 0", [(D8, None, None, "{}")]),
    ("SELECT COUNT(*), w FROM t WHERE v = 10", [(1, "red")]),
    ("WITH a AS (SELECT v FROM t), b AS (SELECT MAX(v) AS m FROM a) SELECT v FROM a, b WHERE v = m", [(30,)]),
    ("SELECT x.s FROM (SELECT g, SUM(v) AS s FROM t GROUP BY g) AS x WHERE x.g = 'A'", [(30,)]),
]


@pytest.mark.parametrize("sql, want", STATEMENTS)
def test_statements(spark, sql, want):
    t = spark.createDataFrame([("a", 10, "red"), ("a", 20, "red blue"), ("b", 30, None)], "g string, v int, w string")
    variables = {"x": 7} if "@x" in sql else {}
    got = [tuple(r) for r in frontend.run(spark, sql, {"t": t}, **variables).collect()]
    assert got == want


def test_collation_of_statements(spark):
    """Equal without case and accents, one spelling of a group; columns in bytes by name."""
    rows = [(1, "a", "X"), (2, "a", "X"), (3, "b", "x"), (4, "A", "x"), (5, "á", "y")]
    u = {"u": spark.createDataFrame(rows, "id int, name string, g string")}

    def run(sql):
        return sorted(tuple(r) for r in frontend.run(spark, sql, u, binary=("g",)).collect())

    assert [n for _, n in run("SELECT name, COUNT(*) AS n FROM u GROUP BY name ORDER BY name")] == [4, 1]
    assert run("SELECT g, COUNT(*) FROM u GROUP BY g") == [("X", 2), ("x", 2), ("y", 1)]
    assert run("SELECT COUNT(DISTINCT name), COUNT(DISTINCT g), MIN(g) FROM u") == [(2, 3, "X")]
    assert run("SELECT id FROM u WHERE name = 'Á' AND g = 'x'") == [(4,)]
    assert len(run("SELECT DISTINCT name FROM u")) == 2 and len(run("SELECT name FROM u UNION SELECT UPPER(name) FROM u")) == 2
    assert run("SELECT a.id FROM u a JOIN u b ON a.name = b.name AND b.id = 3") == [(3,)]
    assert run("SELECT id FROM u WHERE name IN ('B', 'q') OR name COLLATE utf8mb4_bin = 'A'") == [(3,), (4,)]


def test_refused_statements():
    for sql in ("VALUES (1)", "TABLE t", "", "SELECT CAST('1' AS JSON)", "SELECT SUM(COUNT(*)) OVER", "SELECT RANK()", "SELECT 1 1"):
        with pytest.raises(frontend.Unsupported):
            frontend.rewrite(sql)


@pytest.mark.parametrize("partitions, threshold", [("1", "-1"), ("8", "-1"), ("8", "10m")])
def test_same_answers_whatever_the_plan(spark, partitions, threshold):
    """The same rows with one or many partitions, with and without broadcasts."""
    a = spark.range(500).selectExpr("id", "id % 7 as k")
    b = spark.range(50).selectExpr("id as k", "id * 2 as w")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = joins.using(a, b, ["k"]).groupBy("k").agg(F.sum("w").alias("w")).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [tuple(r) for r in got] == [(k, 2 * k * len(range(k, 500, 7))) for k in range(7)]
