"""The dialect's functions as Spark SQL text, by name.

A rule takes the arguments as ``E`` (text and kind) and gives an ``E``. Kinds: int, uint
(decimal(20,0)), decN (N digits after the point), dbl, text, date, ts, time, bool, null,
any. Where the dialect gives NULL and Spark would raise, guarded forms are used.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from larkspur.functions.datetimes import pattern_of
from larkspur.plans.lexer import Unsupported, quoted


class E(NamedTuple):
    sql: str
    kind: str = "any"
    #: Text of a literal, where it is one.
    literal: str | None = None
    #: True for a bare column.
    column: bool = False


TWO63, TWO64 = "9223372036854775808BD", "18446744073709551616BD"
NUMBER = r"^[ \\t\\r\\n]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
INTEGER = r"^[ \\t\\r\\n]*([+-]?[0-9]+)"
EXACT = ("int", "uint")


def scale(kind: str) -> int | None:
    """Digits after the point of an exact number, None for other kinds."""
    if kind in ("int", "uint", "bool"):
        return 0
    return int(kind[3:]) if kind.startswith("dec") else None


def prefix(x: str) -> str:
    """Number at the start of a text, 0 if there is none."""
    return f"if(({x}) IS NULL, NULL, coalesce(try_cast(regexp_extract(CAST({x} AS STRING), '{NUMBER}', 1) AS DOUBLE), 0D))"


def number(e: E) -> E:
    """An operand of arithmetic."""
    if e.kind == "bool":
        return E(f"CAST({e.sql} AS INT)", "int")
    if e.kind == "text":
        return E(prefix(e.sql), "dbl")
    return e


def whole(e: E) -> str:
    """The 64 bits of an integer."""
    if e.kind == "uint":
        return f"CAST(if({e.sql} >= {TWO63}, {e.sql} - {TWO64}, {e.sql}) AS BIGINT)"
    if e.kind in ("int", "bool"):
        return f"CAST({e.sql} AS BIGINT)"
    return f"CAST(round({number(e).sql}) AS BIGINT)"


def unsigned(x: str) -> E:
    return E(f"CAST(if({x} < 0, CAST({x} AS DECIMAL(20,0)) + {TWO64}, CAST({x} AS DECIMAL(20,0))) AS DECIMAL(20,0))", "uint")


def finite(x: str) -> str:
    return f"nullif(nullif(nullif({x}, double('NaN')), double('Infinity')), double('-Infinity'))"


def truth(e: E) -> str:
    """A condition."""
    if e.kind in ("bool", "any", "null"):
        return f"CAST({e.sql} AS BOOLEAN)" if e.kind == "null" else e.sql
    return f"({number(e).sql} <> 0)"


def divide(a: E, b: E) -> E:
    a, b = number(a), number(b)
    s, t = scale(a.kind), scale(b.kind)
    if s is None or t is None:
        return E(finite(f"try_divide(CAST({a.sql} AS DOUBLE), CAST({b.sql} AS DOUBLE))"), "dbl")
    top = f"CAST({a.sql} AS DECIMAL({min(38, 24 + s + 6)},{s + 6}))"
    return E(f"CAST(round(try_divide({top}, CAST({b.sql} AS DECIMAL({20 + t},{t}))), {s + 4}) AS DECIMAL(38,{s + 4}))", f"dec{s + 4}")


def modulo(a: E, b: E) -> E:
    a, b = number(a), number(b)
    s, t = scale(a.kind), scale(b.kind)
    kind = "dbl" if s is None or t is None else "int" if s == t == 0 else f"dec{max(s, t)}"
    return E(f"try_mod({a.sql}, {b.sql})", kind)


def quotient(a: E, b: E) -> E:
    a, b = number(a), number(b)
    if "dbl" in (a.kind, b.kind):
        return E(f"try_cast(try_divide(CAST({a.sql} AS DOUBLE), CAST({b.sql} AS DOUBLE)) AS BIGINT)", "int")
    return E(f"(({a.sql}) div nullif(({b.sql}), 0))", "int")


def plus(op: str, a: E, b: E) -> E:
    times = ("date", "ts", "time")
    if a.kind in times or b.kind in times:
        return E(f"({a.sql} {op} {b.sql})", "any")
    a, b = number(a), number(b)
    if "uint" in (a.kind, b.kind) and a.kind in EXACT and b.kind in EXACT:
        return E(f"CAST(pmod(CAST({a.sql} AS DECIMAL(38,0)) {op} CAST({b.sql} AS DECIMAL(38,0)), {TWO64}) AS DECIMAL(20,0))", "uint")
    s, t = scale(a.kind), scale(b.kind)
    if s is None or t is None:
        kind = "dbl" if "dbl" in (a.kind, b.kind) else "any"
    elif s == t == 0:
        # Narrow columns may be of any width; the dialect computes in 64 bits.
        return E(f"(CAST({a.sql} AS BIGINT) {op} CAST({b.sql} AS BIGINT))", "int")
    else:
        kind = f"dec{min(30, s + t if op == '*' else max(s, t))}"
    out = f"({a.sql} {op} {b.sql})"
    return E(finite(out) if kind == "dbl" else out, kind)


def cast(e: E, name: str, size: tuple[int, ...] = ()) -> E:
    """CAST with the dialect's rules for what doesn't fit."""
    x = e.sql
    if name in ("SIGNED", "INT", "INTEGER", "BIGINT"):
        if e.kind == "text":
            return E(f"if(({x}) IS NULL, NULL, coalesce(try_cast(regexp_extract(CAST({x} AS STRING), '{INTEGER}', 1) AS BIGINT), 0L))", "int")
        if e.kind == "uint":
            return E(whole(e), "int")
        if e.kind in ("dbl", "any") or e.kind.startswith("dec"):
            return E(f"try_cast(round({x}) AS BIGINT)", "int")
        return E(f"try_cast({x} AS BIGINT)", "int")
    if name == "UNSIGNED":
        if e.kind == "text":
            x = f"coalesce(try_cast(regexp_extract(CAST({x} AS STRING), '{INTEGER}', 1) AS DECIMAL(38,0)), 0)"
        return E(f"CAST(pmod(try_cast(round({x}) AS DECIMAL(38,0)), {TWO64}) AS DECIMAL(20,0))", "uint")
    if name in ("CHAR", "VARCHAR", "NCHAR"):
        text = f"CAST({x} AS STRING)"
        return E(f"left({text}, {size[0]})" if size else text, "text")
    if name == "BINARY":
        return E(f"CAST(CAST({x} AS STRING) AS BINARY)", "any")
    if name in ("DATETIME", "TIMESTAMP"):
        return E(f"try_cast({x} AS TIMESTAMP_NTZ)", "ts")
    if name == "DATE":
        return E(f"try_cast({x} AS DATE)", "date")
    if name == "TIME":
        return E(f"try_cast(regexp_extract(CAST({x} AS STRING), '([0-9]{{1,2}}:[0-9]{{2}}(:[0-9.]+)?)$', 1) AS TIME)", "time")
    if name in ("DECIMAL", "NUMERIC", "DEC"):
        p, s = (*size, 0)[:2] if size else (10, 0)
        source = number(e).sql if e.kind == "text" else x
        return E(f"try_cast(round(try_cast({source} AS DECIMAL(38,{min(s + 8, 18)})), {s}) AS DECIMAL({min(p, 38)},{s}))", f"dec{s}")
    if name in ("DOUBLE", "FLOAT", "REAL"):
        return E(f"CAST({number(e).sql} AS DOUBLE)", "dbl")
    raise Unsupported(f"CAST to {name}")


# --- dates ----------------------------------------------------------------------------


def moment(e: E) -> str:
    """A date or moment from any operand; NULL for what is none."""
    return e.sql if e.kind in ("date", "ts") else f"try_cast({e.sql} AS TIMESTAMP_NTZ)"


def day(e: E) -> str:
    return e.sql if e.kind == "date" else f"CAST({moment(e)} AS DATE)"


PLACES = ("year", "month", "week", "day", "hour", "minute", "second")


def interval(amount: str, unit: str) -> str:
    unit = unit.lower()
    if unit == "quarter":
        unit, amount = "month", f"({amount}) * 3"
    if unit == "microsecond":
        unit, amount = "second", f"({amount}) / 1000000"
    if unit not in PLACES:
        raise Unsupported(f"interval unit {unit}")
    kind = "DECIMAL(18,6)" if unit == "second" else "INT"
    return f"make_interval({', '.join(['0'] * PLACES.index(unit) + [f'CAST({amount} AS {kind})'])})"


def shift(e: E, sign: str, amount: str, unit: str) -> E:
    """A date or moment and an interval; a date stays one for units of a day and more."""
    out = f"(CAST({moment(e)} AS TIMESTAMP_NTZ) {sign} {interval(amount, unit)})"
    short = e.kind == "date" or e.literal is not None and re.fullmatch(r"\s*\d{4}-\d{1,2}-\d{1,2}\s*", e.literal)
    if short and unit.lower() in ("day", "week", "month", "quarter", "year"):
        return E(f"CAST({out} AS DATE)", "date")
    return E(out, "ts")


def week(d: str, mode: int) -> str:
    """WEEK, whose modes number the weeks by three bits: begin on Monday, count from 1, and
    the rule for week 1."""
    monday, four = bool(mode & 1), bool(mode & 1) != bool(mode & 4)

    def one(year: str) -> str:
        first = f"make_date({year}, 1, 1)"
        into = f"weekday({first})" if monday else f"(dayofweek({first}) - 1)"
        back = f"if({into} <= 3, -{into}, 7 - {into})" if four else f"if({into} = 0, 0, 7 - {into})"
        return f"date_add({first}, CAST({back} AS INT))"

    y = f"year({d})"
    if mode & 2:
        start = f"CASE WHEN {d} >= {one(y + ' + 1')} THEN {one(y + ' + 1')} WHEN {d} >= {one(y)} THEN {one(y)} ELSE {one(y + ' - 1')} END"
        return f"CAST(floor(datediff({d}, {start}) / 7) + 1 AS INT)"
    return f"CAST(if({d} < {one(y)}, 0, floor(datediff({d}, {one(y)}) / 7) + 1) AS INT)"


def year_of_week(d: str, mode: int) -> str:
    monday, four = bool(mode & 1), bool(mode & 1) != bool(mode & 4)
    into = f"weekday({d})" if monday else f"(dayofweek({d}) - 1)"
    # The week belongs to the year of its fourth day, or of its last.
    return f"year(date_add({d}, CAST({3 if four else 6} - {into} AS INT)))" if four else (
        f"year(date_sub({d}, CAST({into} AS INT)))"
    )


def _formatted(fmt: E) -> str:
    if fmt.literal is None:
        raise Unsupported("the format has to be a constant")
    return quoted(pattern_of(fmt.literal))


def _clock(x: str) -> str:
    """Seconds of day of a TIME text, a moment or a TIME."""
    pattern = "'([0-9]+):([0-9]{2}):?([0-9]{2})?'"
    h, m, s = (f"coalesce(try_cast(regexp_extract(CAST({x} AS STRING), {pattern}, {i}) AS INT), 0)" for i in (1, 2, 3))
    return f"if(({x}) IS NULL, NULL, {h} * 3600 + {m} * 60 + {s})"


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


def _sec_to_time(n: str) -> str:
    s = f"CAST(abs({n}) AS BIGINT)"
    hours = f"({s} div 3600)"
    return f"concat(if({n} < 0, '-', ''), if({hours} < 10, {_two(hours)}, CAST({hours} AS STRING)), ':', {_two(f'({s} % 3600) div 60')}, ':', {_two(f'{s} % 60')})"


# --- texts ----------------------------------------------------------------------------


def substring(a: list[E]) -> E:
    s, p = a[0].sql, whole(a[1])
    n = f"CAST({whole(a[2])} AS INT)" if len(a) > 2 else "2147483647"
    cut = f"substring({s}, CAST(if({p} < 0 AND -{p} > char_length({s}), 0, {p}) AS INT), {n})"
    return E(f"(CASE WHEN ({s}) IS NULL OR ({p}) IS NULL OR ({n}) IS NULL THEN NULL WHEN {p} = 0 OR {n} < 1 OR -{p} > char_length({s}) THEN '' ELSE {cut} END)", "text")


def _bytes(s: str) -> str:
    return f"hex(encode({s}, 'utf-8'))"


def _insert(a: list[E]) -> str:
    s, p, n, new = a[0].sql, whole(a[1]), whole(a[2]), a[3].sql
    rest = f"if({n} < 0 OR {p} + {n} > char_length({s}), '', substring({s}, CAST({p} + {n} AS INT)))"
    return f"if({p} < 1 OR {p} > char_length({s}), {s}, concat(substring({s}, 1, CAST({p} - 1 AS INT)), {new}, {rest}))"


def _soundex(s: str) -> str:
    letters = f"regexp_replace(upper({s}), '[^A-Z]', '')"
    first = f"left({letters}, 1)"
    pairs = "'BFPVCGJKQSXZDTLMNR', '111122222222334556'"
    body = f"if({first} RLIKE '[HW]', translate(regexp_replace({letters}, '[HW]', ''), {pairs}), substring(translate(regexp_replace({letters}, '[HW]', ''), {pairs}), 2))"
    joined = f"regexp_replace(concat(translate({first}, {pairs}), {body}), '([0-9])\\\\1+', '$1')"
    code = f"concat({first}, regexp_replace(substring({joined}, 2), '[^0-9]', ''))"
    return f"if({letters} = '', '', if(char_length({code}) < 4, rpad({code}, 4, '0'), {code}))"


def _guard(name: str, args: list[E]) -> E:
    """NULL if any argument is."""
    if any(e.kind == "null" for e in args):
        return E("NULL", "null")
    known = " AND ".join(f"({e.sql}) IS NOT NULL" for e in args)
    scales = [scale(e.kind) for e in args]
    kind = args[0].kind if len({e.kind for e in args}) == 1 else "dbl" if None in scales else f"dec{max(scales)}"
    return E(f"(CASE WHEN {known} THEN {name}({', '.join(e.sql for e in args)}) END)", kind)


def _round(a: list[E]) -> E:
    x = number(a[0])
    digits = int(a[1].sql.strip("() ")) if len(a) > 1 and re.fullmatch(r"\(?-?\s*\d+\)?", a[1].sql.replace(" ", "")) else 0 if len(a) < 2 else None
    if digits is None:
        return E(f"round({x.sql}, {a[1].sql})", x.kind)
    s = scale(x.kind)
    if s is None:
        return E(f"round({x.sql}, {digits})", x.kind)
    return E(f"round({x.sql}, {digits})", "int" if s == 0 else f"dec{max(0, min(s, digits))}")


def _truncate(a: list[E]) -> E:
    x, d = number(a[0]), a[1].sql.replace(" ", "").strip("()")
    if not re.fullmatch(r"-?\d+", d):
        raise Unsupported("TRUNCATE to a number of digits that isn't constant")
    digits, s = int(d), scale(x.kind)
    if s is None:
        step = f"{10.0 ** abs(digits)!r}D"
        scaled = f"{x.sql} * {step}" if digits >= 0 else f"{x.sql} / {step}"
        back = f"/ {step}" if digits >= 0 else f"* {step}"
        # Beyond 2^53 a double has no digits to cut.
        return E(f"if(abs({x.sql}) >= 9007199254740992D AND {digits} >= 0, CAST({x.sql} AS DOUBLE), (signum({x.sql}) * floor(abs({scaled})) {back}))", "dbl")
    if digits >= s:
        return x
    keep = max(digits, 0)
    if digits >= 0:
        cut = f"floor(abs({x.sql}), {digits})" if digits else f"floor(abs({x.sql}))"
    else:
        cut = f"floor(abs({x.sql}) / {10 ** -digits}) * {10 ** -digits}"
    return E(f"CAST(if({x.sql} < 0, -1, 1) * {cut} AS DECIMAL(38,{keep}))" if s else f"CAST(if({x.sql} < 0, -1, 1) * {cut} AS BIGINT)", f"dec{keep}" if s else "int")


def _ceil(name: str) -> Callable[[list[E]], E]:
    return lambda a: E(f"CAST({name}({number(a[0]).sql}) AS BIGINT)", "int")


def _real(form: str) -> Callable[[list[E]], E]:
    """A function of doubles, with NULL for what isn't finite."""
    return lambda a: E(finite(form.format(*(f"CAST({number(x).sql} AS DOUBLE)" for x in a))), "dbl")


def _text(form: str, kind: str = "text") -> Callable[[list[E]], E]:
    def run(a: list[E]) -> E:
        if len(a) < 1 + max((int(n) for n in re.findall(r"\{(\d)\}", form)), default=-1):
            raise Unsupported("too few arguments")
        return E(form.format(*(f"CAST({x.sql} AS STRING)" if x.kind not in ("text", "null") else x.sql for x in a)), kind)

    return run


def _date(form: str, kind: str = "int") -> Callable[[list[E]], E]:
    return lambda a: E(form.format(*(moment(x) for x in a)), kind)


def _days(form: str, kind: str = "int") -> Callable[[list[E]], E]:
    return lambda a: E(form.format(*(day(x) for x in a)), kind)


def _concat(a: list[E]) -> E:
    return E(f"concat({', '.join(f'CAST({e.sql} AS STRING)' for e in a)})", "text")


def _common(a: list[E]) -> str:
    """Kind of a value that is one of several."""
    kinds = {e.kind for e in a} - {"null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    scales = [scale(k) for k in kinds]
    return "any" if "text" in kinds else "dbl" if None in scales else f"dec{max(scales)}"


def _field(a: list[E]) -> E:
    x, rest = a[0], a[1:]
    if all(e.kind == "text" for e in a):
        cases = " ".join(f"WHEN lower({x.sql}) = lower({e.sql}) THEN {i + 1}" for i, e in enumerate(rest))
    else:
        cases = " ".join(f"WHEN {number(x).sql} = {number(e).sql} THEN {i + 1}" for i, e in enumerate(rest))
    return E(f"(CASE {cases} ELSE 0 END)", "int")


def _week_call(a: list[E]) -> E:
    return E(week(day(a[0]), int(a[1].sql) if len(a) > 1 else 0), "int")


def _yearweek(a: list[E]) -> E:
    mode, d = (int(a[1].sql) if len(a) > 1 else 0), day(a[0])
    return E(f"({year_of_week(d, mode)} * 100 + {week(d, mode | 2)})", "int")


def _vector(a: list[E], metric: str) -> E:
    def side(e: E) -> str:
        if e.literal is not None:
            return "array(" + ", ".join(f"{float(x)!r}D" for x in e.literal.strip("[] ").split(",")) + ")"
        return e.sql

    x, y = side(a[0]), side(a[1])

    def dot(p: str, q: str) -> str:
        return f"aggregate(zip_with({p}, {q}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"

    if metric == "inner":
        return E(f"(-{dot(x, y)})", "dbl")
    if metric == "cosine":
        norm = f"(sqrt({dot(x, x)}) * sqrt({dot(y, y)}))"
        return E(f"(CASE WHEN {norm} = 0 THEN 1D ELSE 1 - {dot(x, y)} / {norm} END)", "dbl")
    return E(f"aggregate(zip_with({x}, {y}, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, v) -> s + v)", "dbl")


def _json_value(e: E) -> str:
    """An argument as JSON text."""
    if e.kind == "null":
        return "'null'"
    if e.kind in ("text", "date", "ts"):
        return f"coalesce(regexp_extract(to_json(array(CAST({e.sql} AS STRING))), '(?s)^\\\\[(.*)\\\\]$', 1), 'null')"
    if e.kind == "json":
        return e.sql
    return f"coalesce(CAST({e.sql} AS STRING), 'null')"


def _json_edit(how: str) -> Callable[[list[E]], E]:
    def run(a: list[E]) -> E:
        out = a[0].sql
        step = 1 if how == "remove" else 2
        for i in range(1, len(a), step):
            value = "NULL" if how == "remove" else _json_value(a[i + 1])
            out = f"larkspur_json_{how}({out}, {a[i].sql}, {value})"
        return E(out, "json")

    return run


def _json_object(a: list[E]) -> E:
    parts = [f"concat({_json_value(k if k.kind == 'text' else E(f'CAST({k.sql} AS STRING)', 'text'))}, ': ', {_json_value(v)})" for k, v in zip(a[::2], a[1::2])]
    return E(f"concat('{{', array_join(array({', '.join(parts)}), ', '), '}}')" if parts else "'{}'", "json")


def _json_array(a: list[E]) -> E:
    return E(f"concat('[', array_join(array({', '.join(map(_json_value, a))}), ', '), ']')" if a else "'[]'", "json")


def _conv(a: list[E]) -> E:
    return E(f"conv(CAST({a[0].sql} AS STRING), {a[1].sql}, {a[2].sql})", "text")


def _hex(a: list[E]) -> E:
    return E(f"hex({whole(a[0])})" if scale(a[0].kind) is not None else f"hex({a[0].sql})", "text")


def _sha2(a: list[E]) -> E:
    bits = a[1].sql
    return E(f"if({bits} IN (0, 224, 256, 384, 512), sha2({a[0].sql}, {bits}), NULL)" if bits.isdigit() and int(bits) in (0, 224, 256, 384, 512) else "CAST(NULL AS STRING)", "text")


def _point(a: list[E], n: int) -> E:
    return E(f"try_cast(regexp_extract({a[0].sql}, '^\\\\s*POINT\\\\s*\\\\(\\\\s*(-?[0-9.eE+-]+)\\\\s+(-?[0-9.eE+-]+)\\\\s*\\\\)\\\\s*$', {n}) AS DOUBLE)", "dbl")


def _distance(a: list[E]) -> E:
    x = f"({_point(a[:1], 1).sql} - {_point(a[1:], 1).sql})"
    y = f"({_point(a[:1], 2).sql} - {_point(a[1:], 2).sql})"
    return E(f"sqrt({x} * {x} + {y} * {y})", "dbl")


def _wkt(a: list[E]) -> E:
    return E(f"if({_point(a, 1).sql} IS NULL, NULL, {a[0].sql})", "text")


def _if(a: list[E]) -> E:
    return E(f"if({truth(a[0])}, {a[1].sql}, {a[2].sql})", _common(a[1:]))


def _coalesce(a: list[E]) -> E:
    return E(f"coalesce({', '.join(e.sql for e in a)})", _common(a))


def _char(a: list[E]) -> E:
    return E("concat(" + ", ".join(f"decode(unhex(lpad(hex({whole(e)}), 8, '0')), 'utf-32')" for e in a) + ")", "text")


def _find_in_set(a: list[E]) -> E:
    return E(f"find_in_set({a[0].sql}, {a[1].sql})", "int")


def _position(a: list[E]) -> E:
    start = f", {a[2].sql}" if len(a) > 2 else ""
    return E(f"locate(lower({a[0].sql}), lower({a[1].sql}){start})", "int")


def _from_unixtime(a: list[E]) -> E:
    at = f"CAST(timestamp_seconds({number(a[0]).sql}) AS TIMESTAMP_NTZ)"
    return E(f"date_format({at}, {_formatted(a[1])})", "text") if len(a) > 1 else E(at, "ts")


def _unix_timestamp(a: list[E]) -> E:
    if not a:
        return E("unix_timestamp()", "int")
    return E(f"coalesce(unix_seconds(CAST({moment(a[0])} AS TIMESTAMP)), 0L)", "int")


POWER = _real("power({0}, {1})")
LOG = {1: _real("ln(nullif(greatest({0}, 0D), 0D))"), 2: _real("(ln(nullif(greatest({1}, 0D), 0D)) / ln(nullif(greatest({0}, 0D), 0D)))")}

FUNCTIONS: dict[str, Callable[[list[E]], E]] = {
    # texts
    "CONCAT": _concat, "CONCAT_WS": lambda a: E(f"concat_ws({', '.join(f'CAST({e.sql} AS STRING)' for e in a)})", "text"),
    "UPPER": _text("upper({0})"), "UCASE": _text("upper({0})"), "LOWER": _text("lower({0})"), "LCASE": _text("lower({0})"),
    "LENGTH": _text("octet_length({0})", "int"), "OCTET_LENGTH": _text("octet_length({0})", "int"),
    "CHAR_LENGTH": _text("char_length({0})", "int"), "CHARACTER_LENGTH": _text("char_length({0})", "int"),
    "REVERSE": _text("reverse({0})"), "LTRIM": _text("ltrim({0})"), "RTRIM": _text("rtrim({0})"), "TRIM": _text("trim({0})"),
    "SUBSTRING": substring, "SUBSTR": substring, "MID": substring,
    "LEFT": lambda a: E(f"left({a[0].sql}, CAST({whole(a[1])} AS INT))", "text"),
    "RIGHT": lambda a: E(f"right({a[0].sql}, CAST({whole(a[1])} AS INT))", "text"),
    "SUBSTRING_INDEX": lambda a: E(f"substring_index({a[0].sql}, {a[1].sql}, {a[2].sql})", "text"),
    "REPLACE": lambda a: E(f"if({a[1].sql} = '', {a[0].sql}, replace({a[0].sql}, {a[1].sql}, {a[2].sql}))", "text"),
    "REPEAT": lambda a: E(f"if(octet_length({a[0].sql}) * greatest({whole(a[1])}, 0) > 67108864, NULL, repeat({a[0].sql}, CAST({whole(a[1])} AS INT)))", "text"),
    "SPACE": lambda a: E(f"if({whole(a[0])} > 67108864, NULL, space(CAST({whole(a[0])} AS INT)))", "text"),
    "LPAD": lambda a: E(f"lpad({a[0].sql}, {a[1].sql}, {a[2].sql})", "text"),
    "RPAD": lambda a: E(f"rpad({a[0].sql}, {a[1].sql}, {a[2].sql})", "text"),
    "INSTR": lambda a: _position([a[1], a[0]]), "LOCATE": _position, "POSITION": _position,
    "ASCII": _text(f"if({{0}} = '', 0, CAST(conv(left({_bytes('{0}')}, 2), 16, 10) AS BIGINT))", "int"),
    "ORD": _text(f"if({{0}} = '', 0, CAST(conv({_bytes('left({0}, 1)')}, 16, 10) AS BIGINT))", "int"),
    "BIN": lambda a: E(f"bin({whole(a[0])})", "text"), "OCT": lambda a: E(f"conv(CAST({whole(a[0])} AS STRING), 10, 8)", "text"),
    "HEX": _hex, "UNHEX": _text("unhex({0})", "any"), "CONV": _conv, "CRC32": _text("crc32({0})", "int"),
    "FIELD": _field, "ELT": lambda a: E(f"try_element_at(array({', '.join(e.sql for e in a[1:])}), CAST(if({whole(a[0])} < 1, NULL, {whole(a[0])}) AS INT))", "text"),
    "FIND_IN_SET": _find_in_set, "CHAR": _char, "INSERT": lambda a: E(_insert(a), "text"),
    "STRCMP": lambda a: E("(CASE WHEN {0} < {1} THEN -1 WHEN {0} = {1} THEN 0 WHEN {0} > {1} THEN 1 END)".format(*(f"collate({e.sql}, 'UNICODE_CI_AI')" for e in a)), "int"),
    "SOUNDEX": lambda a: E(_soundex(a[0].sql), "text"), "FORMAT": lambda a: E(f"format_number({number(a[0]).sql}, {a[1].sql})", "text"),
    "REGEXP_REPLACE": lambda a: E(f"regexp_replace({a[0].sql}, concat('(?i)', {a[1].sql}), {a[2].sql})", "text"),
    "REGEXP_SUBSTR": lambda a: E(f"regexp_substr({a[0].sql}, concat('(?i)', {a[1].sql}))", "text"),
    "REGEXP_LIKE": lambda a: E(f"({a[0].sql} RLIKE concat('(?i)', {a[1].sql}))", "bool"),
    "MD5": _text("md5({0})"), "SHA1": _text("sha1({0})"), "SHA": _text("sha1({0})"), "SHA2": _sha2,
    # numbers
    "ABS": lambda a: E(f"abs({number(a[0]).sql if number(a[0]).kind != 'int' else whole(a[0])})", number(a[0]).kind), "CEIL": _ceil("ceil"), "CEILING": _ceil("ceil"), "FLOOR": _ceil("floor"),
    "ROUND": _round, "TRUNCATE": _truncate, "SIGN": lambda a: E(f"CAST(signum({number(a[0]).sql}) AS INT)", "int"),
    "SQRT": _real("sqrt({0})"), "EXP": _real("exp({0})"), "LN": LOG[1], "LOG": lambda a: LOG[len(a)](a), "LOG10": _real("log10(nullif(greatest({0}, 0D), 0D))"),
    "LOG2": _real("log2(nullif(greatest({0}, 0D), 0D))"), "POWER": POWER, "POW": POWER, "MOD": lambda a: modulo(*a),
    "PI": lambda a: E("pi()", "dbl"), "RAND": lambda a: E(f"rand({', '.join(e.sql for e in a)})", "dbl"), "RADIANS": _real("radians({0})"), "DEGREES": _real("degrees({0})"),
    "SIN": _real("sin({0})"), "COS": _real("cos({0})"), "TAN": _real("tan({0})"), "ATAN": _real("atan({0})"), "ASIN": _real("asin({0})"), "ACOS": _real("acos({0})"),
    "GREATEST": lambda a: _guard("greatest", a), "LEAST": lambda a: _guard("least", a), "BIT_COUNT": lambda a: E(f"bit_count({whole(a[0])})", "int"),
    # conditions
    "IF": _if, "IFNULL": _coalesce, "COALESCE": _coalesce, "NULLIF": lambda a: E(f"nullif({a[0].sql}, {a[1].sql})", a[0].kind),
    "ISNULL": lambda a: E(f"CAST(({a[0].sql}) IS NULL AS INT)", "int"),
    # dates
    "NOW": lambda a: E("localtimestamp()", "ts"), "SYSDATE": lambda a: E("localtimestamp()", "ts"), "CURRENT_TIMESTAMP": lambda a: E("localtimestamp()", "ts"),
    "LOCALTIME": lambda a: E("localtimestamp()", "ts"), "LOCALTIMESTAMP": lambda a: E("localtimestamp()", "ts"), "UTC_TIMESTAMP": lambda a: E("CAST(to_utc_timestamp(localtimestamp(), current_timezone()) AS TIMESTAMP_NTZ)", "ts"),
    "CURDATE": lambda a: E("current_date()", "date"), "CURRENT_DATE": lambda a: E("current_date()", "date"),
    "CURTIME": lambda a: E("date_format(localtimestamp(), 'HH:mm:ss')", "text"), "CURRENT_TIME": lambda a: E("date_format(localtimestamp(), 'HH:mm:ss')", "text"),
    "UNIX_TIMESTAMP": _unix_timestamp, "FROM_UNIXTIME": _from_unixtime,
    "YEAR": _date("year({0})"), "MONTH": _date("month({0})"), "DAY": _date("day({0})"), "DAYOFMONTH": _date("day({0})"), "QUARTER": _date("quarter({0})"),
    "HOUR": lambda a: E(f"CAST({_clock(a[0].sql)} / 3600 AS INT)" if a[0].kind == "text" else f"hour({moment(a[0])})", "int"),
    "MINUTE": lambda a: E(f"CAST({_clock(a[0].sql)} / 60 % 60 AS INT)" if a[0].kind == "text" else f"minute({moment(a[0])})", "int"),
    "SECOND": lambda a: E(f"CAST({_clock(a[0].sql)} % 60 AS INT)" if a[0].kind == "text" else f"second({moment(a[0])})", "int"),
    "MICROSECOND": _date("CAST(extract(SECOND FROM {0}) * 1000000 % 1000000 AS INT)"),
    "DAYOFWEEK": _date("dayofweek({0})"), "WEEKDAY": _date("weekday({0})"), "DAYOFYEAR": _date("dayofyear({0})"), "WEEKOFYEAR": _date("weekofyear({0})"),
    "DATE": lambda a: E(day(a[0]), "date"),
    "TIME": lambda a: E(f"if(({a[0].sql}) IS NULL, NULL, regexp_extract(CAST({a[0].sql} AS STRING), '([0-9]{{1,3}}:[0-9]{{2}}:[0-9]{{2}})', 1))", "text"),
    "DATEDIFF": lambda a: E(f"datediff({day(a[0])}, {day(a[1])})", "int"), "TO_DAYS": _days("(datediff({0}, DATE'1970-01-01') + 719528)"),
    "FROM_DAYS": lambda a: E(f"date_add(DATE'1970-01-01', CAST({whole(a[0])} - 719528 AS INT))", "date"),
    "LAST_DAY": _days("last_day({0})", "date"), "WEEK": _week_call, "YEARWEEK": _yearweek,
    "DATE_FORMAT": lambda a: E(f"date_format({moment(a[0])}, {_formatted(a[1])})", "text"),
    "STR_TO_DATE": lambda a: E(f"CAST(try_to_timestamp({a[0].sql}, {_formatted(a[1])}) AS TIMESTAMP_NTZ)", "ts"),
    "DAYNAME": _date("date_format({0}, 'EEEE')", "text"), "MONTHNAME": _date("date_format({0}, 'MMMM')", "text"),
    "TIME_TO_SEC": lambda a: E(_clock(a[0].sql), "int"), "SEC_TO_TIME": lambda a: E(_sec_to_time(whole(a[0])), "text"),
    "MAKEDATE": lambda a: E(f"date_add(make_date({a[0].sql}, 1, 1), CAST({a[1].sql} - 1 AS INT))", "date"),
    # JSON
    "JSON_EXTRACT": lambda a: E(f"larkspur_json_get({a[0].sql}, {a[1].sql})", "json"),
    "JSON_UNQUOTE": lambda a: E(f"coalesce(if({a[0].sql} LIKE '\"%', get_json_object(concat('[', {a[0].sql}, ']'), '$[0]'), NULL), {a[0].sql})", "text"),
    "JSON_VALUE": lambda a: E(f"get_json_object({a[0].sql}, {a[1].sql})", "text"),
    "JSON_ARRAY": _json_array, "JSON_OBJECT": _json_object, "JSON_SET": _json_edit("set"), "JSON_INSERT": _json_edit("insert"),
    "JSON_REPLACE": _json_edit("replace"), "JSON_REMOVE": _json_edit("remove"),
    "JSON_CONTAINS": lambda a: E(f"larkspur_json_contains({a[0].sql}, {a[1].sql}, {a[2].sql if len(a) > 2 else chr(39) + '$' + chr(39)})", "int"),
    "JSON_LENGTH": lambda a: E(f"larkspur_json_length({a[0].sql}, {a[1].sql if len(a) > 1 else chr(39) + '$' + chr(39)})", "int"),
    "JSON_KEYS": lambda a: E(f"larkspur_json_keys({a[0].sql}, {a[1].sql if len(a) > 1 else chr(39) + '$' + chr(39)})", "json"),
    "JSON_TYPE": lambda a: E(f"larkspur_json_type({a[0].sql})", "text"),
    "JSON_VALID": lambda a: E(f"CAST(try_parse_json({a[0].sql}) IS NOT NULL AS INT)" if a[0].kind == "text" else "0", "int"),
    "JSON_QUOTE": lambda a: E(f"if(({a[0].sql}) IS NULL, NULL, {_json_value(E(a[0].sql, 'text'))})", "text"),
    # vectors and points
    "VEC_DISTANCE": lambda a: _vector(a, "l2"), "VEC_L2_DISTANCE": lambda a: _vector(a, "l2"), "VEC_DISTANCE_L2": lambda a: _vector(a, "l2"),
    "VEC_COSINE_DISTANCE": lambda a: _vector(a, "cosine"), "VEC_DISTANCE_COSINE": lambda a: _vector(a, "cosine"),
    "VEC_INNER_PRODUCT": lambda a: _vector(a, "inner"), "VEC_DISTANCE_IP": lambda a: _vector(a, "inner"),
    "POINT": lambda a: E(f"concat('POINT(', CAST({a[0].sql} AS STRING), ' ', CAST({a[1].sql} AS STRING), ')')", "text"),
    "ST_X": lambda a: _point(a, 1), "ST_Y": lambda a: _point(a, 2), "ST_DISTANCE": _distance, "ST_ASTEXT": _wkt, "ST_ASWKT": _wkt,
    "ST_GEOMFROMTEXT": _wkt, "ST_GEOMETRYFROMTEXT": _wkt, "ST_POINTFROMTEXT": _wkt,
    # session
    "DATABASE": lambda a: E("current_database()", "text"), "SCHEMA": lambda a: E("current_database()", "text"),
    "USER": lambda a: E("current_user()", "text"), "CURRENT_USER": lambda a: E("current_user()", "text"), "SESSION_USER": lambda a: E("current_user()", "text"), "SYSTEM_USER": lambda a: E("current_user()", "text"),
    "VERSION": lambda a: E("version()", "text"), "CONNECTION_ID": lambda a: E("1", "int"), "LAST_INSERT_ID": lambda a: E("0", "int"),
    "ROW_COUNT": lambda a: E("0", "int"), "FOUND_ROWS": lambda a: E("0", "int"), "CURRENT_ROLE": lambda a: E("'NONE'", "text"),
    "UUID": lambda a: E("uuid()", "text"),
}
#: Names that may stand without brackets.
BARE = {"CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "LOCALTIME", "LOCALTIMESTAMP", "CURRENT_USER"}
WINDOWED = {"ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE", "CUME_DIST", "PERCENT_RANK"}
#: Aggregates whose name or rule is Spark's.
AGGREGATES = {
    "COUNT", "SUM", "AVG", "MIN", "MAX", "STD", "STDDEV", "STDDEV_POP", "STDDEV_SAMP", "VARIANCE", "VAR_POP", "VAR_SAMP", "BIT_AND", "BIT_OR",
    "BIT_XOR", "GROUP_CONCAT", "PERCENTILE", "QUANTILE", "MEDIAN", "ANY_VALUE", "JSON_ARRAYAGG", "FACET", "PERCENTILE_CONT",
}
SAME = {"STD": "stddev_pop", "STDDEV": "stddev_pop", "STDDEV_POP": "stddev_pop", "STDDEV_SAMP": "stddev_samp", "VARIANCE": "var_pop", "VAR_POP": "var_pop", "VAR_SAMP": "var_samp"}


def aggregate(name: str, args: list[E], distinct: bool) -> E:
    """An aggregate over its arguments, without a window."""
    d = "DISTINCT " if distinct else ""
    x = args[0] if args else E("*")
    if name == "COUNT":
        return E(f"count({d}{', '.join(e.sql for e in args)})", "int")
    if name in ("MIN", "MAX", "ANY_VALUE"):
        return E(f"{name.lower()}({x.sql})", x.kind)
    if name == "SUM":
        v = number(x)
        s = scale(v.kind)
        return E(f"sum({d}{v.sql})", v.kind if s is not None else "dbl" if v.kind == "dbl" else "any")
    if name == "AVG":
        v = number(x)
        s = scale(v.kind)
        if s is None:
            return E(f"avg({d}{v.sql})", "dbl")
        total = f"sum({d}CAST({v.sql} AS DECIMAL({min(38, 24 + s)},{s + 4})))"
        return E(f"CAST(round({total} / nullif(count({d}{v.sql}), 0), {s + 4}) AS DECIMAL(38,{s + 4}))", f"dec{s + 4}")
    if name in SAME:
        return E(f"{SAME[name]}({number(x).sql})", "dbl")
    if name in ("BIT_AND", "BIT_OR", "BIT_XOR"):
        return unsigned(f"coalesce({name.lower()}({whole(x)}), {'-1L' if name == 'BIT_AND' else '0L'})")
    if name == "MEDIAN":
        return E(f"percentile({number(x).sql}, 0.5)", "dbl")
    if name in ("PERCENTILE", "QUANTILE", "PERCENTILE_CONT"):
        p = min(max(float(args[1].sql.strip("BD()")), 0.0), 1.0)
        return E(f"percentile({number(x).sql}, {p})", "dbl")
    raise Unsupported(name)
