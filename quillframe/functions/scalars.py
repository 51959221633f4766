"""Column expressions that turn text cells into typed values; each gives null where the text does not parse."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_BOUNDS = {
    "byte": (0, 255, "smallint"), "sbyte": (-128, 127, "tinyint"), "short": (-(1 << 15), (1 << 15) - 1, "smallint"), "ushort": (0, (1 << 16) - 1, "int"),
    "int": (-(1 << 31), (1 << 31) - 1, "int"), "uint": (0, (1 << 32) - 1, "bigint"), "long": (-(1 << 63), (1 << 63) - 1, "bigint"), "ulong": (0, (1 << 64) - 1, "decimal(20,0)"),
}

#: Free-form dates and times: tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "dd MMM yyyy", "MMM d, yyyy")
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd")


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units: one for each code point, two beyond the basic plane."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def unquote(c: Column, quote: str = '"') -> Column:
    """A cell wrapped in quotes without them, doubled quotes as one; any other cell as it is."""
    q = F.lit(quote)
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(quote * 2), q)
    return F.when((F.length(c) >= 2) & c.startswith(quote) & c.endswith(quote), inner).otherwise(c)


def trim_cell(c: Column, quote: str = '"') -> Column:
    """Without blanks and tabs at the ends, unless the cell is quoted."""
    return F.when(c.startswith(quote) & c.endswith(quote), c).otherwise(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))


def null_tokens(c: Column, tokens: Sequence[str]) -> Column:
    return F.when(~c.isin(*tokens), c) if tokens else c


def parse_int(c: Column, kind: str = "int", blanks: bool = False) -> Column:
    low, high, out = INT_BOUNDS[kind]
    text = F.trim(c) if blanks else c
    wide = "decimal(38,0)" if kind == "ulong" else "bigint"  # whole numbers of 64 bits need no decimal
    value = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(wide))
    return value if kind == "long" else F.when(value.between(F.lit(low).cast(wide), F.lit(high).cast(wide)), value.cast(out))


def _plain_number(c: Column, group: str, point: str) -> Column:
    text = F.replace(F.trim(c), F.lit(group), F.lit("")) if group else F.trim(c)
    return F.replace(text, F.lit(point), F.lit(".")) if point != "." else text


def parse_decimal(c: Column, precision: int = 38, scale: int = 18, group: str = ",", point: str = ".") -> Column:
    """Blanks, thousands and a sign before or after are allowed; an exponent is not."""
    text = _plain_number(c, group, point)
    text = F.regexp_replace(text, r"^(.*[0-9.])([+-])$", "$2$1")
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast(f"decimal({precision},{scale})"))


def parse_double(c: Column, group: str = ",", point: str = ".", kind: str = "double") -> Column:
    text = _plain_number(c, group, point)
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") | text.isin("NaN", "Infinity", "-Infinity"), text.try_cast(kind))


def parse_bool(c: Column, digits: bool = False) -> Column:
    low = F.lower(c)
    yes, no = (["true", "1"], ["false", "0"]) if digits else (["true"], ["false"])
    return F.when(low.isin(*yes), F.lit(True)).when(low.isin(*no), F.lit(False))


def java_format(fmt: str) -> str:
    """A .NET date pattern as a Java one."""
    for a, b in (("tt", "a"), ("fff", "SSS"), ("zzz", "XXX"), ("K", "XXX")):
        fmt = fmt.replace(a, b)
    return fmt


_SHAPES = (("yyyy", "[0-9]{4}"), ("MMM", "[A-Za-z]{3}"), ("SSS", "[0-9]{3}"), ("MM", "[0-9]{2}"), ("dd", "[0-9]{2}"), ("HH", "[0-9]{2}"), ("mm", "[0-9]{2}"), ("ss", "[0-9]{2}"), ("M", "[0-9]{1,2}"), ("d", "[0-9]{1,2}"))


def _shape(fmt: str) -> str:
    """A pattern of what a date pattern of these parts can match, so that no text is tried in vain: a failed try is dear."""
    out, at = "^", 0
    while at < len(fmt):
        part, shape = next(((p, r) for p, r in _SHAPES if fmt.startswith(p, at)), (fmt[at], "" if fmt[at] == "'" else re.escape(fmt[at])))
        out, at = out + shape, at + len(part)
    return out + "$"


def _try_formats(c: Column, formats: Sequence[str], kind: str) -> Column:
    return F.coalesce(*[F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))).cast(kind) for f in formats])


def parse_date(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(java_format(fmt))).cast("date") if fmt else _try_formats(c, DATE_FORMATS, "date")


def parse_timestamp(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(java_format(fmt))).cast("timestamp_ntz") if fmt else _try_formats(c, TIMESTAMP_FORMATS, "timestamp_ntz")


def parse_time(c: Column) -> Column:
    """Canonical ``HH:mm:ss`` text."""
    return F.when(c.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.concat(c, F.lit(":00"))).when(c.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,7})?$"), c)


def parse_guid(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lower(c))


def parse_enum(c: Column, names: Sequence[str], ignore_case: bool = True) -> Column:
    found = F.lit(None).cast("string")
    for name in names:
        found = F.when((F.lower(c) == name.lower()) if ignore_case else (c == name), F.lit(name)).otherwise(found)
    return found


def parse_vector(c: Column, kind: str = "float", comma_is_decimal: bool = False) -> Column:
    """``[a, b]`` or bare, parted by comma, semicolon or blanks; empty gives an empty array, a bad token null."""
    body = F.trim(c)
    body = F.when(body.startswith("[") & body.endswith("]"), F.substring(body, F.lit(2), F.length(body) - 2)).otherwise(body)
    parts = F.filter(F.split(body, r"[;\s]+" if comma_is_decimal else r"[,;\s]+"), lambda x: x != "")
    values = F.transform(parts, lambda x: parse_double(x, "", "," if comma_is_decimal else ".", kind))
    return F.when(F.forall(values, lambda x: x.isNotNull()), values)


def parse(c: Column, kind: str, **options) -> Column:
    """By the name of a scalar type, as record specifications use it."""
    if kind == "string":
        return c
    if kind in INT_BOUNDS:
        return parse_int(c, kind, options.get("blanks", False))
    if kind == "decimal":
        return parse_decimal(c, options.get("precision", 38), options.get("scale", 18), options.get("group", ","), options.get("point", "."))
    if kind in ("double", "float"):
        return parse_double(c, options.get("group", ","), options.get("point", "."), kind)
    simple = {"bool": parse_bool, "time": parse_time, "guid": parse_guid}
    if kind in simple:
        return simple[kind](c)
    if kind in ("date", "timestamp"):
        return (parse_date if kind == "date" else parse_timestamp)(c, options.get("format"))
    if kind == "enum":
        return parse_enum(c, options["names"], options.get("ignore_case", True))
    if kind == "vector":
        return parse_vector(c, options.get("element", "float"), options.get("comma_is_decimal", False))
    raise ValueError(f"unknown type {kind}")


def dangerous(c: Column, extra: str = "") -> Column:
    """A cell that a spreadsheet may run: led by ``=``, ``@``, tab or CR, or by a sign that no number follows."""
    more = reduce(lambda a, b: a | b, [c.startswith(x) for x in extra], F.lit(False))
    return F.coalesce(c.rlike(r"^(?:[=@\t\r]|[+-][^0-9.])") | more, F.lit(False))
