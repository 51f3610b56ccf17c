"""Scalar string functions as column expressions; lengths and prefixes are counted in bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() has it: Unicode White_Space and U+001C to U+001F.
STRIP = r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$"


def byte_length(v: Column) -> Column:
    return F.octet_length(v).cast("long")


def strip(v: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(v, STRIP, "")


def field_after(v: Column, sep: str, n: int, limit: int) -> Column:
    """The n-th (0-based) part after at most `limit` splits at `sep`; null when there are fewer."""
    parts = F.split(v, sep, limit + 1)
    return F.when(F.size(parts) > n, parts[n])


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two strings' UTF-8 begin with in common. Hex keeps byte order, so half the common hex digits are common bytes."""
    a, b = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    digits = F.when(a == b, F.length(a)).otherwise(F.array_position(same, False) - 1)
    return F.floor(digits / 2).cast("long")


def quoted_literal(v: Column, suffix: str = '"@en') -> Column:
    """What stands between the first quote and the last `"@en`; null unless the latter comes after the former. Escapes stay."""
    first = F.instr(v, '"')
    last = F.length(v) - F.instr(F.reverse(v), suffix[::-1]) - len(suffix) + 2  # 1-based place of the last suffix
    found = (first > 0) & F.contains(v, F.lit(suffix)) & (last > first)
    return F.when(found, F.substring(v, first + 1, last - first - 1))


def json_field(v: Column, field: str, default: str = "") -> Column:
    """A field of a JSON object as text; `default` when it is missing or null; null for malformed JSON."""
    return F.when(F.try_parse_json(v).isNotNull(), F.coalesce(F.get_json_object(v, f"$.{field}"), F.lit(default)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mib(n_bytes: Column) -> Column:
    return n_bytes / F.lit(1024.0 * 1024.0)


def ratio(raw: Column, used: Column) -> Column:
    """Raw bytes per byte used; null where nothing is used."""
    return F.when(used > 0, raw.cast("double") / used)


def fixed(v: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", v)
