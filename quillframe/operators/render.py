"""Text forms of rows: delimited, fixed-width, JSON lines; with the protections that spreadsheets need."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..sources.delimited import within_rows

PLAIN = ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double", "boolean")
PROTECTIONS = ("none", "escape_quote", "escape_tab", "sanitize", "reject")


def protect(c: Column, how: str, extra: str = "") -> Column:
    """The text that is safe to write; a rejected one fails the query."""
    if how not in PROTECTIONS:
        raise ValueError(f"unknown protection {how}")
    bad = s.dangerous(c, extra)
    if how == "none":
        return c
    if how == "sanitize":
        return F.when(bad, F.regexp_replace(c, "^[=@\t\r+\\-" + re.escape(extra) + "]+", "")).otherwise(c)
    if how == "reject":
        return F.when(bad, F.raise_error(F.concat(F.lit("a cell may be run as a formula: "), c))).otherwise(c)
    return F.when(bad, F.concat(F.lit("'" if how == "escape_quote" else "\t"), c)).otherwise(c)


def csv_cell(c: Column, delimiter: str = ",", quote: str = '"', style: str = "when_needed", protection: str = "escape_quote", null: str = "", extra: str = "") -> Column:
    """One cell as text: quoted where needed, always or never; a cell escaped against formulas is always quoted."""
    text = F.coalesce(c, F.lit(null))
    bad = s.dangerous(text, extra) if protection.startswith("escape") else F.lit(False)
    safe = protect(text, protection, extra)
    quoted = F.concat(F.lit(quote), F.replace(safe, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    needs = text.rlike("[" + re.escape(delimiter + quote) + "\r\n]")
    if style == "always":
        return quoted
    if style == "never":
        return F.when(bad, quoted).otherwise(safe)
    return F.when(bad | needs, quoted).otherwise(safe)


@dataclass(frozen=True)
class Formats:
    """How values become text: one pattern for each kind, and one for a column where it needs its own."""

    date: str = "yyyy-MM-dd"
    timestamp: str = "yyyy-MM-dd HH:mm:ss"
    columns: tuple[tuple[str, str], ...] = ()


def text_of(df: DataFrame, name: str, formats: Formats = Formats()) -> Column:
    kind, own, c = dict(df.dtypes)[name], dict(formats.columns).get(name), F.col(name)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.date_format(c, own or (formats.date if kind == "date" else formats.timestamp))
    if own:
        return F.format_string(own, c)
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ",", ""), F.lit("]"))
    return c.cast("string")


def csv_line(df: DataFrame, columns: Sequence[str] | None = None, delimiter: str = ",", formats: Formats = Formats(), **options) -> Column:
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        # digits, signs and points need neither quotes nor protection
        if kinds[c].split("(")[0] in PLAIN and c not in dict(formats.columns) and options.get("style") != "always" and delimiter in ",;|\t" and not options.get("extra"):
            plain = F.coalesce(F.col(c).cast("string"), F.lit(options.get("null", "")))
            return F.when(plain.startswith("-I"), csv_cell(plain, delimiter, **options)).otherwise(plain) if kinds[c] in ("float", "double") else plain
        return csv_cell(text_of(df, c, formats), delimiter, **options)

    return F.concat_ws(delimiter, *[cell(c) for c in columns or df.columns])


def header_line(columns: Sequence[str], delimiter: str = ",", quote: str = '"') -> str:
    return delimiter.join(quote + c.replace(quote, quote * 2) + quote if any(x in c for x in (delimiter, quote, "\r", "\n")) else c for c in columns)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, **options) -> None:
    """A folder of text files, each with the header."""
    columns = list(columns or df.columns)
    head = header_line(columns, options.get("delimiter", ","))
    lines = df.select(csv_line(df, columns, **options).alias("value"))

    def run(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first and b.num_rows:  # an empty task leaves an empty file, without a header of its own
                yield pa.RecordBatch.from_arrays([pa.array([head], b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    lines.mapInArrow(run, "value string").write.text(path)


def write_rows(df: DataFrame, columns: Sequence[str], on_error: str = "throw", max_field: int | None = None, extra: str = "", **options) -> DataFrame:
    """(value): delimited lines under a policy for cells that must not be written (formulas, fields beyond ``max_field``):
    ``throw`` fails the query, ``skip_row`` leaves the row out, ``write_null`` writes the null text in the cell's place."""
    if on_error not in ("throw", "skip_row", "write_null"):
        raise ValueError(f"unknown policy {on_error}")
    formats, null = options.pop("formats", Formats()), options.get("null", "")
    bad = {}
    for c in columns:
        text = text_of(df, c, formats)
        wrong = s.dangerous(text, extra)
        bad[c] = F.coalesce(wrong | (F.length(text) > max_field) if max_field is not None else wrong, F.lit(False))
    if on_error == "skip_row":
        df = df.where(~reduce(lambda a, b: a | b, bad.values()))
    elif on_error == "throw":
        df = df.where(reduce(lambda a, b: a & b, [F.when(x, F.raise_error(F.lit(f"a cell of {c} must not be written")).cast("boolean")).otherwise(True) for c, x in bad.items()]))
    cells = [csv_cell(F.when(bad[c], F.lit(null)).otherwise(text_of(df, c, formats)) if on_error == "write_null" else text_of(df, c, formats), protection="none", **options) for c in columns]
    return df.select(F.concat_ws(options.get("delimiter", ","), *cells).alias("value"))


def check_limits(df: DataFrame, line: Column, max_rows: int | None = None, max_bytes: int | None = None, max_columns: int | None = None) -> None:
    """Fails before anything is written."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    n, size = df.select(line.alias("l")).agg(F.count("*"), F.sum(F.octet_length("l") + 1)).first()
    if max_rows is not None and n > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    if max_bytes is not None and (size or 0) > max_bytes:
        raise ValueError(f"more than {max_bytes} bytes")


@dataclass(frozen=True)
class Slot:
    """A column of a fixed-width line."""

    name: str
    width: int
    align: str = "left"
    pad: str = " "


def check_layout(slots: Sequence[tuple[str, int, int]]) -> None:
    """(name, start, length): no two may overlap."""
    for (a, i, n), (b, j, _) in zip(ordered := sorted(slots, key=lambda x: x[1]), ordered[1:], strict=False):
        if i + n > j:
            raise ValueError(f"columns {a} and {b} overlap")


def fit(c: Column, slot: Slot, keep_right: bool = False, overflow: str = "truncate") -> Column:
    """Text padded or cut to the slot. A right-aligned writer keeps the last characters (``keep_right``), a converter the first."""
    text = F.coalesce(c, F.lit(""))
    if overflow == "throw":
        text = F.when(F.length(text) > slot.width, F.raise_error(F.concat(F.lit(f"too long for {slot.name}: "), text))).otherwise(text)
    cut = F.when(F.length(text) > slot.width, F.right(text, F.lit(slot.width)) if keep_right and slot.align == "right" else F.substring(text, 1, slot.width)).otherwise(text)
    if slot.align == "right":
        return F.lpad(cut, slot.width, slot.pad)
    if slot.align == "center":
        left = F.floor((F.lit(slot.width) - F.length(cut)) / 2).cast("int")
        return F.rpad(F.concat(F.repeat(F.lit(slot.pad), left), cut), slot.width, slot.pad)
    return F.rpad(cut, slot.width, slot.pad)


def fixed_line(df: DataFrame, slots: Sequence[Slot], formats: Formats = Formats(), **options) -> Column:
    return F.concat(*[fit(text_of(df, x.name, formats) if x.name in df.columns else F.lit(""), x, **options) for x in slots])


def fixed_cells(line: Column, slots: Sequence[Slot], trim_center: bool = True) -> Column:
    """The cells of a fixed-width line, short lines padded, each trimmed on the side that its alignment pads."""
    width = sum(x.width for x in slots)
    full, at, out = F.rpad(line, width, " "), 1, []
    full = F.when(F.length(line) < width, full).otherwise(line)
    for x in slots:
        cell, p = F.substring(full, at, x.width), re.escape(x.pad)
        left, right = f"^(?:{p})+", f"(?:{p})+$"
        ends = {"left": [right], "right": [left], "center": [left, right] if trim_center else [], "none": []}[x.align]
        out.append(reduce(lambda c, e: F.regexp_replace(c, e, ""), ends, cell))
        at += x.width
    return F.array(*out)


def read_fixed(lines: DataFrame, slots: Sequence[Slot], value: str = "value", order: str = "row_number", skip_empty: bool = True, comment: str | None = None, short_rows: bool = True) -> DataFrame:
    """Rows of cells. A comment is known by the first column; a short line is padded, or an error."""
    width = sum(x.width for x in slots)
    keep = F.lit(True)
    if skip_empty:
        keep &= F.length(value) > 0
    if comment:
        keep &= ~F.col(value).startswith(comment)
    cells = fixed_cells(F.col(value), slots)
    if not short_rows:
        cells = F.when(F.length(value) < width, F.raise_error(F.lit(f"a line is shorter than {width}")).cast("array<string>")).otherwise(cells)
    return lines.where(keep).select(F.col(order).cast("bigint").alias("row_number"), cells.alias("cells"))


def read_fixed_blocks(text: DataFrame, record_length: int, slots: Sequence[Slot], value: str = "value") -> DataFrame:
    """Records of one length without line ends."""
    n = F.ceil(F.length(value) / record_length).cast("int")
    parts = text.where(F.length(value) > 0).select(F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), F.col(value).alias("v"))
    return parts.select((F.col("k") + 1).cast("bigint").alias("row_number"), fixed_cells(F.substring("v", F.col("k") * record_length + 1, F.lit(record_length)), slots).alias("cells"))


def csv_to_fixed(cells: DataFrame, header: Sequence[str], slots: Sequence[Slot]) -> DataFrame:
    """value: fixed-width lines of delimited rows; a column that the header lacks is empty."""
    names = [h.strip().lower() for h in header]
    parts = [fit(F.try_element_at("cells", F.lit(names.index(x.name.strip().lower()) + 1)) if x.name.strip().lower() in names else F.lit(""), x) for x in slots]
    return cells.select("row_number", F.concat(*parts).alias("value"))


def fixed_to_csv(lines: DataFrame, slots: Sequence[Slot], value: str = "value", order: str = "row_number", delimiter: str = ",", protection: str = "escape_quote") -> DataFrame:
    rows = read_fixed(lines, slots, value, order)
    return rows.select("row_number", F.concat_ws(delimiter, *[csv_cell(F.element_at("cells", k + 1), delimiter, protection=protection) for k in range(len(slots))]).alias("value"))


def auto_slots(df: DataFrame) -> list[Slot]:
    """Left-aligned slots as wide as the longest value and two, five at least."""
    widths = df.agg(*[F.max(s.utf16_len(F.col(c).cast("string"))).cast("int").alias(c) for c in df.columns]).first()
    return [Slot(c, max(5, (widths[c] or 0) + 2)) for c in df.columns]


# JSON lines


def flat_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """An object of strings, as delimited rows become one."""
    return F.to_json(F.struct(*[F.coalesce(text_of(df, c), F.lit("")).alias(c) for c in columns or df.columns]))


def chat_json(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """``{"messages": [...]}``; a system message only where there is text for one."""

    def message(role: str, c: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))

    both = F.array(message("user", user), message("assistant", assistant))
    full = both if system is None else F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(message("system", system)), both)).otherwise(both)
    return F.to_json(F.struct(full.alias("messages")))


def json_columns(lines: DataFrame, value: str = "value", order: str = "row_number", sample: int = 100) -> list[str]:
    """The top-level keys of the first lines, in the order in which they come up."""
    first = lines.where(F.col(value).startswith("{")).orderBy(order).limit(sample)
    keys = first.select(order, F.posexplode(F.json_object_keys(value)).alias("pos", "key"))
    return [r.key for r in keys.groupBy("key").agg(F.min(F.struct(order, "pos")).alias("first")).orderBy("first").collect()]


def json_cells(lines: DataFrame, paths: dict[str, str], value: str = "value", order: str = "row_number") -> DataFrame:
    """Columns by path (``a.b[0].c``); what is missing is null, what is nested its JSON text."""
    return lines.where(F.col(value).startswith("{")).select(order, *[F.get_json_object(value, "$." + p).alias(n) for n, p in paths.items()])


def read_json(lines: DataFrame, schema: str, value: str = "value", order: str = "row_number", max_line: int = 1 << 20, strict: bool = True, max_rows: int | None = None, skip_rows: int = 0) -> DataFrame:
    """Records of a schema; empty lines are skipped, a line beyond the cap fails, a malformed one fails or goes (``strict=False``).

    ``skip_rows`` leaves out lines by their number; more than ``max_rows`` lines fail the query."""
    lines = within_rows(lines.where((F.trim(value) != "") & (F.col(order) > skip_rows)) if skip_rows else lines.where(F.trim(value) != ""), max_rows, "lines")
    long = F.raise_error(F.lit(f"a line is longer than {max_line} bytes"))
    text = F.when(F.octet_length(value) > max_line, long).otherwise(F.col(value))
    mode = "FAILFAST" if strict else "PERMISSIVE"
    out = lines.where(F.trim(value) != "").select(order, F.from_json(text, schema, {"mode": mode}).alias("record"), F.try_parse_json(value).alias("ok"))
    return out.where(F.lit(strict) | F.col("ok").isNotNull()).select(order, "record.*")


def json_to_csv(lines: DataFrame, value: str = "value", order: str = "row_number", delimiter: str = ",") -> tuple[list[str], DataFrame]:
    columns = json_columns(lines, value, order)
    rows = json_cells(lines, {c: c for c in columns}, value, order)
    return columns, rows.select(order, F.concat_ws(delimiter, *[csv_cell(F.col(c), delimiter) for c in columns]).alias("value"))


# Reports


def merge_duplicates(df: DataFrame, column: str, order: str, parts: int = 64) -> DataFrame:
    """Runs of equal neighbours by ``order`` (unique): (value, first_row, last_row) of those of two rows or more.

    Ranges are cut into runs apart; a range's first and last run, which may go on in the next range, are then joined (at most two a range).
    """
    w = Window.partitionBy("part").orderBy("at")
    ranged = df.select(F.col(order).alias("at"), F.col(column).alias("value")).repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    change = (F.row_number().over(w) == 1) | ~F.lag("value").over(w).eqNullSafe(F.col("value"))
    run = F.sum(F.when(change, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = ranged.withColumn("run", run).groupBy("part", "run").agg(F.first("value").alias("value"), F.min("at").alias("first_row"), F.max("at").alias("last_row"), F.count("*").alias("n"))
    border = (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("part")))
    runs = runs.withColumn("lane", F.when(border, -1).otherwise(F.col("part"))).where("lane = -1 or n > 1")
    w = Window.partitionBy("lane").orderBy("part", "run")
    goes_on = (F.lag("part").over(w) < F.col("part")) & F.lag("value").over(w).eqNullSafe(F.col("value"))
    whole = F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = runs.withColumn("whole", whole).groupBy("lane", "whole").agg(F.first("value").alias("value"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.sum("n").alias("n"))
    return joined.where("n > 1").select("value", "first_row", "last_row")
