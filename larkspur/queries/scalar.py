"""Scalar functions over table columns, by group: our Columns and, below each group, the
same rules in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import datetimes as D
from larkspur.functions import jsons as J
from larkspur.functions import maths as M
from larkspur.functions import semantics as S
from larkspur.functions import strings as T
from larkspur.functions import vectors as V
from larkspur.registry import Registry
from larkspur.session import table

Columns = dict[str, Column]


def c(name: str) -> Column:
    return F.col(name)


def lit(value) -> Column:
    return F.lit(value)


def arithmetic() -> Columns:
    a, b = c("p_partkey"), c("p_size")
    return {
        "quotient": S.divide(a, b - 7).cast("double"),
        "remainder": S.modulo(-a, b - 7).cast("bigint"),
        "whole": S.int_divide(-a, b - 7),
        "sum_bool": (a > 100).cast("int") + b,
        "inf": S.finite(F.pow(lit(2.0), b.cast("double") * 30)),
    }


ARITHMETIC_SQL = {
    "quotient": "CAST(round(CAST(p_partkey AS DECIMAL(20,6)) / nullif(p_size - 7, 0), 4) AS DOUBLE)",
    "remainder": "CAST(-p_partkey % nullif(p_size - 7, 0) AS BIGINT)",
    "whole": "CAST(trunc(CAST(-p_partkey AS DOUBLE) / nullif(p_size - 7, 0)) AS BIGINT)",
    "sum_bool": "CAST(p_partkey > 100 AS INT) + p_size",
    "inf": "CASE WHEN p_size * 30 < 1024 THEN pow(2.0, p_size * 30) END",
}


def bits() -> Columns:
    a, b = c("p_partkey"), c("p_size")
    return {
        "band": S.bit_and(a, b).cast("double"),
        "bor": S.bit_or(a, b).cast("double"),
        "bxor": S.bit_xor(a, b).cast("double"),
        "bnot": S.bit_not(a).cast("string"),
        "shl": S.shift_left(a, b % 8).cast("double"),
        "shr": S.shift_right(a, b % 8).cast("double"),
        "count": F.bit_count(a).cast("int"),
        "wrap": S.to_unsigned(-a).cast("string"),
        "uadd": S.unsigned_add(S.bit_not(a), a + 2).cast("string"),
    }


BITS_SQL = {
    "band": "CAST(p_partkey & p_size AS DOUBLE)",
    "bor": "CAST(p_partkey | p_size AS DOUBLE)",
    "bxor": "CAST(xor(p_partkey, CAST(p_size AS BIGINT)) AS DOUBLE)",
    "bnot": "CAST(18446744073709551615::HUGEINT - p_partkey AS VARCHAR)",
    "shl": "CAST(p_partkey * CAST(pow(2, p_size % 8) AS BIGINT) AS DOUBLE)",
    "shr": "CAST(p_partkey >> (p_size % 8) AS DOUBLE)",
    "count": "CAST(bit_count(p_partkey) AS INT)",
    "wrap": "CASE p_partkey WHEN 0 THEN '0' ELSE CAST(18446744073709551616::HUGEINT - p_partkey AS VARCHAR) END",
    "uadd": "'1'",
}


def conditions() -> Columns:
    return {
        "great": S.greatest(c("age"), c("id").cast("int"), lit(30)).cast("bigint"),
        "little": S.least(c("age"), lit(30)),
        "cond": S.truth(c("age") > 30),
        "prefix": S.num_prefix(F.concat(c("age").cast("string"), lit("abc"))),
        "none": S.num_prefix(F.concat(lit("x"), c("name"))),
        "signed": S.to_signed(F.concat(c("id").cast("string"), lit(".9z"))),
        "rounded": S.round_to_signed(c("id") / 2),
        "decimal": S.to_decimal(F.concat(c("id").cast("string"), lit(".455")), 12, 2).cast("double"),
        "bad_date": S.to_date(lit("2024-02-30")),
        "good_date": S.to_date(lit("2024-02-29")),
    }


CONDITIONS_SQL = {
    "great": "CASE WHEN age IS NOT NULL THEN greatest(age, id, 30) END",
    "little": "CASE WHEN age IS NOT NULL THEN least(age, 30) END",
    "cond": "CAST(CAST(age > 30 AS INT) AS BIGINT)",
    "prefix": "CAST(age AS DOUBLE)",
    "none": "CASE WHEN name IS NOT NULL THEN 0.0::DOUBLE END",
    "signed": "id",
    "rounded": "CAST(floor(id / 2.0 + 0.5) AS BIGINT)",
    "decimal": "CAST(id + 0.46 AS DOUBLE)",
    "bad_date": "CAST(NULL AS DATE)",
    "good_date": "DATE '2024-02-29'",
}


def text() -> Columns:
    n = c("p_name")
    return {
        "joined": F.concat(n, lit("/"), c("p_brand")),
        "joined_null": F.concat(n, lit(None)),
        "joined_ws": F.concat_ws("-", n, lit(None), c("p_type")),
        "up": F.upper(n),
        "down": F.lower(c("p_brand")),
        "bytes": F.octet_length(n).cast("bigint"),
        "chars": F.char_length(n).cast("bigint"),
        "back": F.reverse(n),
        "trimmed": F.trim(F.concat(lit("  "), n, lit(" "))),
        "ltrimmed": F.ltrim(F.concat(lit("  "), n)),
        "rtrimmed": F.rtrim(F.concat(n, lit("  "))),
        "lead": F.expr("trim(LEADING 'P' FROM p_name)"),
        "sub": T.substring(n, 2, 3),
        "sub_zero": T.substring(n, 0, 3),
        "sub_neg": T.substring(n, -3),
        "left": F.left(n, lit(4)),
        "right": F.right(n, lit(2)),
        "index": F.substring_index(c("p_type"), " ", 1),
        "replaced": F.replace(c("p_type"), lit("A"), lit("*")),
        "repeated": F.repeat(c("p_brand"), lit(2)),
        "spaces": F.concat(lit("["), F.repeat(lit(" "), c("p_size") % 5), lit("]")),
        "lpadded": F.lpad(n, 12, "*"),
        "rpadded": F.rpad(n, 3, "*"),
        "instr": F.instr(c("p_type"), "A").cast("bigint"),
        "locate": F.locate("E", c("p_type")).cast("bigint"),
    }


TEXT_SQL = {
    "joined": "p_name || '/' || p_brand",
    "joined_null": "CAST(NULL AS VARCHAR)",
    "joined_ws": "p_name || '-' || p_type",
    "up": "upper(p_name)",
    "down": "lower(p_brand)",
    "bytes": "CAST(octet_length(encode(p_name)) AS BIGINT)",
    "chars": "CAST(length(p_name) AS BIGINT)",
    "back": "reverse(p_name)",
    "trimmed": "trim('  ' || p_name || ' ')",
    "ltrimmed": "ltrim('  ' || p_name)",
    "rtrimmed": "rtrim(p_name || '  ')",
    "lead": "ltrim(p_name, 'P')",
    "sub": "substring(p_name, 2, 3)",
    "sub_zero": "''",
    "sub_neg": "right(p_name, 3)",
    "left": "left(p_name, 4)",
    "right": "right(p_name, 2)",
    "index": "split_part(p_type, ' ', 1)",
    "replaced": "replace(p_type, 'A', '*')",
    "repeated": "repeat(p_brand, 2)",
    "spaces": "'[' || repeat(' ', p_size % 5) || ']'",
    "lpadded": "lpad(p_name, 12, '*')",
    "rpadded": "rpad(p_name, 3, '*')",
    "instr": "CAST(instr(p_type, 'A') AS BIGINT)",
    "locate": "CAST(position('E' IN p_type) AS BIGINT)",
}


def text_more() -> Columns:
    n, t = c("p_name"), c("p_type")
    return {
        "ascii": T.ascii_code(lit("é")),
        "ascii_n": T.ascii_code(n),
        "ord": T.ord_code(lit("é")),
        "bin": F.bin(c("p_partkey")),
        "oct": T.octal(c("p_size")),
        "hex": F.hex(c("p_partkey")),
        "hex_text": F.hex(n),
        "unhex": F.decode(F.unhex(F.hex(n)), "utf-8"),
        "conv": F.conv(c("p_size").cast("string"), 10, 16),
        "crc": F.crc32(lit("hello")),
        "field": T.field(c("p_brand"), "Brand#12", "Brand#34").cast("int"),
        "elt": T.elt(c("p_size") % 4, lit("a"), lit("b")),
        "in_set": F.find_in_set(c("p_brand"), lit("Brand#11,Brand#12")).cast("int"),
        "char": T.char_of(lit(233), lit(8364)),
        "inserted": T.insert(n, 2, 1, lit("__")),
        "inserted_out": T.insert(n, 99, 1, lit("__")),
        "cmp": T.strcmp(lit("Straße"), lit("STRASSE")),
        "cmp_less": T.strcmp(t, lit("zzz")),
        "sound": T.soundex(lit("Tymczak")),
        "sound_long": T.soundex(lit("Robertson-Martin")),
        "formatted": T.format_number(c("p_partkey") * 1000.5, 2),
        "re_replaced": T.regexp_replace(t, "[aeiou]", "#"),
        "re_sub": T.regexp_substr(t, "[aeiou].."),
        "re_test": T.regexp(t, "^s.*l$"),
        "like_escape": T.like(F.concat(n, lit("%")), "%!%", "!"),
        "md5": F.md5(n),
        "sha1": F.sha1(n),
        "sha256": T.sha2(n, 0),
        "sha_none": T.sha2(n, 100),
    }


TEXT_MORE_SQL = {
    "ascii": "CAST(195 AS BIGINT)",
    "ascii_n": "CAST(ascii(p_name) AS BIGINT)",
    "ord": "CAST(50089 AS BIGINT)",
    "bin": "bin(p_partkey)",
    "oct": "printf('%o', p_size)",
    "hex": "hex(p_partkey)",
    "hex_text": "hex(p_name)",
    "unhex": "p_name",
    "conv": "hex(p_size)",
    "crc": "CAST(907060870 AS BIGINT)",
    "field": "CASE p_brand WHEN 'Brand#12' THEN 1 WHEN 'Brand#34' THEN 2 ELSE 0 END",
    "elt": "CASE p_size % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END",
    "in_set": "CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 0 END",
    "char": "'é€'",
    "inserted": "left(p_name, 1) || '__' || substring(p_name, 3)",
    "inserted_out": "p_name",
    "cmp": "0",
    "cmp_less": "-1",
    "sound": "'T522'",
    "sound_long": "'R16325635'",
    "formatted": "format('{:,.2f}', p_partkey * 1000.5)",
    "re_replaced": "regexp_replace(p_type, '[aeiou]', '#', 'gi')",
    "re_sub": "nullif(regexp_extract(p_type, '[aeiou]..', 0, 'i'), '')",
    "re_test": "regexp_matches(p_type, '^s.*l$', 'i')",
    "like_escape": "true",
    "md5": "md5(p_name)",
    "sha1": "sha1(p_name)",
    "sha256": "sha256(p_name)",
    "sha_none": "CAST(NULL AS VARCHAR)",
}


def maths() -> Columns:
    x = c("c_acctbal")
    return {
        "abs": F.abs(x),
        "ceil": M.ceil(x),
        "floor": M.floor(x),
        "rounded": M.round_half_away(x.cast("decimal(18,2)"), 1).cast("double"),
        "truncated": M.truncate(x.cast("decimal(18,2)"), 1).cast("double"),
        "sign": M.sign(x),
        "sqrt": F.round(M.sqrt(x), 6),
        "exp": F.round(M.exp(x / 10000), 8),
        "exp_over": M.exp(x * 0 + 1000),
        "ln": F.round(M.ln(x), 6),
        "log10": F.round(M.log10(x), 6),
        "log2": F.round(M.log2(x), 6),
        "power": F.round(M.power(x / 1000, lit(2)), 6),
        "pi": F.round(M.pi(), 10),
        "radians": F.round(F.radians(x), 6),
        "degrees": F.round(F.degrees(x / 1000), 6),
    }


MATHS_SQL = {
    "abs": "abs(c_acctbal)",
    "ceil": "CAST(ceil(c_acctbal) AS BIGINT)",
    "floor": "CAST(floor(c_acctbal) AS BIGINT)",
    "rounded": "CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE)",
    "truncated": "CAST(trunc(CAST(c_acctbal AS DECIMAL(18,2)) * 10) / 10 AS DOUBLE)",
    "sign": "CAST(sign(c_acctbal) AS INT)",
    "sqrt": "CASE WHEN c_acctbal >= 0 THEN round(sqrt(abs(c_acctbal)), 6) END",
    "exp": "round(exp(c_acctbal / 10000), 8)",
    "exp_over": "CAST(NULL AS DOUBLE)",
    "ln": "CASE WHEN c_acctbal > 0 THEN round(ln(greatest(c_acctbal, 0.001)), 6) END",
    "log10": "CASE WHEN c_acctbal > 0 THEN round(log10(greatest(c_acctbal, 0.001)), 6) END",
    "log2": "CASE WHEN c_acctbal > 0 THEN round(log2(greatest(c_acctbal, 0.001)), 6) END",
    "power": "round(pow(c_acctbal / 1000, 2), 6)",
    "pi": "round(pi(), 10)",
    "radians": "round(radians(c_acctbal), 6)",
    "degrees": "round(degrees(c_acctbal / 1000), 6)",
}


def dates() -> Columns:
    d = c("o_orderdate")
    day = d.cast("date")
    return {
        "y": F.year(d),
        "m": F.month(d),
        "dd": F.dayofmonth(d),
        "h": F.hour(d),
        "mi": F.minute(d),
        "s": F.second(d),
        "q": F.quarter(d),
        "dow": F.dayofweek(d),
        "wd": D.weekday(d),
        "doy": F.dayofyear(d),
        "date": day,
        "diff": F.datediff(day, lit("1995-01-01").cast("date")),
        "days": D.to_days(day),
        "last": F.last_day(day),
        "month_later": D.add_interval(day, 1, "month").cast("date"),
        "quarter_before": D.add_interval(day, -1, "quarter").cast("date"),
        "week_later": D.add_interval(d, 1, "week"),
        "hours": D.add_interval(d, 36, "hour"),
        "months_between": D.timestampdiff("MONTH", lit("1993-03-15").cast("timestamp_ntz"), d).cast("bigint"),
        "days_between": D.timestampdiff("DAY", lit("1993-03-15").cast("timestamp_ntz"), d).cast("bigint"),
        "week0": D.week(day, 0),
        "week3": D.week(day, 3),
        "week5": D.week(day, 5),
        "yearweek3": D.yearweek(day, 3),
        "formatted": D.date_format(d, "%d/%m/%Y %H:%i:%s %a %b %j week %%"),
        "parsed": D.str_to_date(D.date_format(d, "%Y-%m-%d"), "%Y-%m-%d"),
        "unparsed": D.str_to_date(lit("31/31/2020"), "%d/%m/%Y"),
        "day_name": D.dayname(d),
        "month_name": D.monthname(d),
        "secs": D.time_to_sec(d),
        "time": D.sec_to_time(c("o_orderkey") * 17),
        "unix": D.unix_timestamp(d.cast("string")),
        "unix_bad": D.unix_timestamp(lit("nonsense")),
        "from_unix": D.from_unixtime(c("o_orderkey")),
    }


DATES_SQL = {
    "y": "CAST(year(o_orderdate) AS INT)",
    "m": "CAST(month(o_orderdate) AS INT)",
    "dd": "CAST(day(o_orderdate) AS INT)",
    "h": "CAST(hour(o_orderdate) AS INT)",
    "mi": "CAST(minute(o_orderdate) AS INT)",
    "s": "CAST(second(o_orderdate) AS INT)",
    "q": "CAST(quarter(o_orderdate) AS INT)",
    "dow": "CAST(dayofweek(o_orderdate) + 1 AS INT)",
    "wd": "CAST(isodow(o_orderdate) - 1 AS INT)",
    "doy": "CAST(dayofyear(o_orderdate) AS INT)",
    "date": "CAST(o_orderdate AS DATE)",
    "diff": "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT)",
    "days": "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INT)",
    "last": "last_day(o_orderdate)",
    "month_later": "CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)",
    "quarter_before": "CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE)",
    "week_later": "o_orderdate + INTERVAL 7 DAY",
    "hours": "o_orderdate + INTERVAL 36 HOUR",
    "months_between": "CAST(datesub('month', TIMESTAMP '1993-03-15', o_orderdate) AS BIGINT)",
    "days_between": "CAST(datesub('day', TIMESTAMP '1993-03-15', o_orderdate) AS BIGINT)",
    "week0": "CAST(strftime(o_orderdate, '%U') AS INT)",
    "week3": "CAST(week(o_orderdate) AS INT)",
    "week5": "CAST(strftime(o_orderdate, '%W') AS INT)",
    "yearweek3": "CAST(yearweek(o_orderdate) AS INT)",
    "formatted": "strftime(o_orderdate, '%d/%m/%Y %H:%M:%S %a %b %j week %%')",
    "parsed": "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)",
    "unparsed": "CAST(NULL AS TIMESTAMP)",
    "day_name": "dayname(o_orderdate)",
    "month_name": "monthname(o_orderdate)",
    "secs": "CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS INT)",
    "time": "strftime(TIMESTAMP '2000-01-01' + to_seconds(o_orderkey * 17), '%H:%M:%S')",
    "unix": "CAST(epoch(o_orderdate) AS BIGINT)",
    "unix_bad": "CAST(0 AS BIGINT)",
    "from_unix": "TIMESTAMP '1970-01-01' + to_seconds(o_orderkey)",
}


def json_read() -> Columns:
    p = c("props")
    return {
        "text": J.value(p, "$.k"),
        "json": J.extract(p, "$.k"),
        "missing": J.extract(p, "$.nothing.here"),
        "len": J.length(p),
        "ok": J.valid(p),
        "bad": J.valid(lit("{oops")),
        "kind": J.type_of(p),
        "quoted": J.quote(c("event_type")),
        "arr": J.array(c("event_type"), c("user_id").cast("string")),
        "obj": J.object_of(a=c("event_type")),
    }


JSON_READ_SQL = {
    "text": "props ->> '$.k'",
    "json": "CAST(props -> '$.k' AS VARCHAR)",
    "missing": "CAST(NULL AS VARCHAR)",
    "len": "CAST(len(json_keys(props)) AS BIGINT)",
    "ok": "CAST(json_valid(props) AS INT)",
    "bad": "0",
    "kind": "json_type(props)",
    "quoted": "CAST(to_json(event_type) AS VARCHAR)",
    "arr": "'[' || to_json(event_type) || ', \"' || user_id || '\"]'",
    "obj": "'{\"a\": ' || to_json(event_type) || '}'",
}


def json_write() -> Columns:
    doc = F.format_string('{"a": %d, "b": {"c": [1, 2]}}', c("user_id"))
    return {
        "set": J.set_value(doc, "$.b.d", "x"),
        "ins": J.insert_value(doc, "$.a", 5),
        "rep": J.replace_value(doc, "$.b.c[1]", 9),
        "rem": J.remove(doc, "$.b"),
        "has": J.contains(doc, [2], "$.b.c"),
        "has_not": J.contains(doc, {"b": {"c": 7}}),
        "no_path": J.contains(doc, 1, "$.zz"),
        "keys": J.keys(doc),
        "scalar_len": J.length(lit("5")),
    }


JSON_WRITE_SQL = {
    "set": "'{\"a\": ' || user_id || ', \"b\": {\"c\": [1, 2], \"d\": \"x\"}}'",
    "ins": "'{\"a\": ' || user_id || ', \"b\": {\"c\": [1, 2]}}'",
    "rep": "'{\"a\": ' || user_id || ', \"b\": {\"c\": [1, 9]}}'",
    "rem": "'{\"a\": ' || user_id || '}'",
    "has": "CAST(1 AS BIGINT)",
    "has_not": "CAST(0 AS BIGINT)",
    "no_path": "CAST(NULL AS BIGINT)",
    "keys": "'[\"a\", \"b\"]'",
    "scalar_len": "CAST(1 AS BIGINT)",
}


def spatial() -> Columns:
    p = V.point(c("s_suppkey"), c("s_nationkey"))
    return {
        "wkt": p,
        "x": V.st_x(p),
        "y": V.st_y(p),
        "dist": F.round(V.st_distance(p, lit("POINT(3 4)")), 6),
        "geom": V.st_geomfromtext(p),
        "no_geom": V.st_geomfromtext(lit("LINE")),
    }


SPATIAL_SQL = {
    "wkt": "'POINT(' || s_suppkey || ' ' || s_nationkey || ')'",
    "x": "CAST(s_suppkey AS DOUBLE)",
    "y": "CAST(s_nationkey AS DOUBLE)",
    "dist": "round(sqrt(pow(s_suppkey - 3, 2) + pow(s_nationkey - 4, 2)), 6)",
    "geom": "'POINT(' || s_suppkey || ' ' || s_nationkey || ')'",
    "no_geom": "CAST(NULL AS VARCHAR)",
}


def vector() -> Columns:
    e, q = c("embedding"), F.transform(F.sequence(lit(1), F.size("embedding")), lambda i: (i % 3).cast("double"))
    return {
        "l2": F.round(V.l2_squared(e, q), 4),
        "cosine": F.round(V.cosine_distance(e, q), 6),
        "inner": F.round(V.negative_inner(e, q), 4),
    }


QUERY = "list_transform(range(1, len(embedding) + 1), lambda i: CAST(i % 3 AS DOUBLE))"
DOUBLES = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
VECTOR_SQL = {
    "l2": f"round(pow(list_distance({DOUBLES}, {QUERY}), 2), 4)",
    "cosine": f"round(1 - list_cosine_similarity({DOUBLES}, {QUERY}), 6)",
    "inner": f"round(-list_inner_product({DOUBLES}, {QUERY}), 4)",
}


#: name: (table, key, Columns, SQL)
GROUPS = {
    "fn_arithmetic": ("part", "p_partkey", arithmetic, ARITHMETIC_SQL),
    "fn_bits": ("part", "p_partkey", bits, BITS_SQL),
    "fn_conditions_casts": ("users", "id", conditions, CONDITIONS_SQL),
    "fn_text": ("part", "p_partkey", text, TEXT_SQL),
    "fn_text_more": ("part", "p_partkey", text_more, TEXT_MORE_SQL),
    "fn_math": ("customer", "c_custkey", maths, MATHS_SQL),
    "fn_dates": ("orders", "o_orderkey", dates, DATES_SQL),
    "fn_json_read": ("events", "event_id", json_read, JSON_READ_SQL),
    "fn_json_write": ("events", "event_id", json_write, JSON_WRITE_SQL),
    "fn_spatial": ("supplier", "s_suppkey", spatial, SPATIAL_SQL),
    "fn_vector": ("embeddings", "vec_id", vector, VECTOR_SQL),
}


def register(registry: Registry) -> None:
    for name, (source, key, columns, sql) in GROUPS.items():
        listed = ", ".join(f'{text} AS "{alias}"' for alias, text in sql.items())
        _add(registry, name, source, key, columns, f"SELECT {key}, {listed} FROM {source}")


def _add(registry: Registry, name: str, source: str, key: str, columns, oracle: str) -> None:
    @registry.add(name, oracle)
    def _(spark, folder) -> DataFrame:
        return table(spark, folder, source).select(key, *[col.alias(a) for a, col in columns().items()])
