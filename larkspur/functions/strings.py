"""String functions whose rules differ from Spark's built-ins of the same name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(s: Column, pos: int, length: int | None = None) -> Column:
    """From position ``pos`` (from the end if negative); position 0 gives ''."""
    if pos == 0:
        return F.when(s.isNotNull(), F.lit(""))
    n = F.lit(length if length is not None else 2**31 - 1)
    if length is not None and length < 1:
        return F.when(s.isNotNull(), F.lit(""))
    if pos < 0:
        return F.when(F.char_length(s) >= -pos, F.substring(s, F.lit(pos), n)).otherwise(
            F.when(s.isNotNull(), F.substring(s, F.lit(1), n))
        )
    return F.substring(s, F.lit(pos), n)


def ascii_code(s: Column) -> Column:
    """First UTF-8 byte, 0 for ''."""
    first = F.substring(F.hex(F.encode(s, "utf-8")), F.lit(1), F.lit(2))
    return F.when(s == "", F.lit(0)).otherwise(F.conv(first, 16, 10).cast("bigint"))


def ord_code(s: Column) -> Column:
    """UTF-8 bytes of the first character as one big-endian number."""
    return F.when(s == "", F.lit(0)).otherwise(
        F.conv(F.hex(F.encode(F.substring(s, F.lit(1), F.lit(1)), "utf-8")), 16, 10).cast("bigint")
    )


def octal(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 8)


def field(x: Column, *options: str) -> Column:
    """1-based place of ``x`` among the options, 0 if it isn't there or NULL."""
    return F.coalesce(F.array_position(F.array(*[F.lit(o) for o in options]), x), F.lit(0))


def elt(n: Column, *options: Column) -> Column:
    """n-th option, NULL outside."""
    return F.try_element_at(F.array(*options), F.when(n >= 1, n.cast("int")))


def char_of(*points: Column) -> Column:
    """Text of the code points, not reduced to one byte each."""
    return F.concat(
        *[F.decode(F.unhex(F.lpad(F.hex(p.cast("bigint")), 8, "0")), "utf-32") for p in points]
    )


def insert(s: Column, pos: int, length: int, new: Column) -> Column:
    """Replace ``length`` characters at ``pos``; the text itself if ``pos`` is outside."""
    if pos < 1:
        return s
    rest = F.lit("") if length < 0 else F.substring(s, F.lit(pos + length), F.lit(2**31 - 1))
    return F.when(F.char_length(s) >= pos, F.concat(F.substring(s, F.lit(1), F.lit(pos - 1)), new, rest)).otherwise(s)


def strcmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 without case and accents."""
    x, y = F.collate(a, "UNICODE_CI_AI"), F.collate(b, "UNICODE_CI_AI")
    return F.when(x < y, F.lit(-1)).when(x == y, F.lit(0)).when(x > y, F.lit(1))


def format_number(x: Column, digits: int) -> Column:
    return F.format_number(x, digits)


def regexp_replace(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, f"(?i){pattern}", new)


def regexp_substr(s: Column, pattern: str) -> Column:
    return F.regexp_substr(s, F.lit(f"(?i){pattern}"))


def regexp(s: Column, pattern: str) -> Column:
    """REGEXP under the default collation."""
    return s.rlike(f"(?i){pattern}")


def like(s: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE, always without case; no escape character unless one is given."""
    if escape is None:
        pattern, escape = pattern.replace("\\", "\\\\"), "\\"
    return F.call_function("ilike", s, F.lit(pattern)) if escape == "\\" else _like_regex(s, pattern, escape)


def _like_regex(s: Column, pattern: str, escape: str) -> Column:
    """LIKE with an escape character of its own, as an anchored expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c, re.escape(c)))
        i += 1
    return s.rlike("(?is)^" + "".join(out) + "$")


def sha2(s: Column, bits: int) -> Column:
    """SHA-2 of 224, 256, 384 or 512 bits (0: 256); NULL for any other size."""
    if bits not in (0, 224, 256, 384, 512):
        return F.lit(None).cast("string")
    return F.sha2(s, bits or 256)


#: Letters of each digit of the sound code.
SOUNDS = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


def soundex(s: Column) -> Column:
    """First letter and the digits of the consonants that follow, not cut at four; equal
    neighbours once, also across H and W; vowels part them."""
    letters = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    first = F.substring(letters, F.lit(1), F.lit(1))
    source = "".join(SOUNDS.values())
    target = "".join(d * len(letters_of) for d, letters_of in SOUNDS.items())
    coded = F.translate(F.regexp_replace(letters, "[HW]", ""), source, target)
    lead = F.translate(first, source, target)
    # The first letter's own digit merges with equal digits after it.
    body = F.when(first.rlike("[HW]"), coded).otherwise(F.substring(coded, F.lit(2), F.lit(2**31 - 1)))
    joined = F.regexp_replace(F.concat(lead, body), "([0-9])\\1+", "$1")
    digits = F.regexp_replace(F.substring(joined, F.lit(2), F.lit(2**31 - 1)), "[^0-9]", "")
    code = F.concat(first, digits)
    return F.when(letters == "", F.lit("")).otherwise(F.when(F.char_length(code) < 4, F.rpad(code, 4, "0")).otherwise(code))
