"""From one format to another, as tables of lines (row_number, value) or of files' bytes (content)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import packed
from . import render
from .records import Field, bind


class ConversionError(ValueError):
    pass


def named(cells: DataFrame, header: Sequence[str] | None, width: int | None = None) -> DataFrame:
    """Rows of cells as text columns; without a header they are column1..n; missing cells are empty."""
    names = list(header) if header else [f"column{k + 1}" for k in range(width or 0)]
    return cells.select("row_number", *[F.coalesce(F.try_element_at("cells", F.lit(k + 1)), F.lit("")).alias(n) for k, n in enumerate(names)])


def csv_to_jsonl(cells: DataFrame, header: Sequence[str] | None, width: int | None = None) -> DataFrame:
    rows = named(cells, header, width)
    return rows.select("row_number", render.flat_json(rows, [c for c in rows.columns if c != "row_number"]).alias("value"))


def csv_to_chat(cells: DataFrame, header: Sequence[str], user: str, assistant: str, system: str | None = None) -> DataFrame:
    """Chat lines; a column that is asked for must be there, a system column may be missing."""
    known = {h.lower(): k for k, h in enumerate(header)}
    for name in (user, assistant):
        if name.lower() not in known:
            raise ConversionError(f"no column {name}")
    cell = lambda name: F.try_element_at("cells", F.lit(known[name.lower()] + 1))
    extra = cell(system) if system and system.lower() in known else None
    return cells.select("row_number", render.chat_json(cell(user), cell(assistant), extra).alias("value"))


def csv_to_packed(cells: DataFrame, spec: Sequence[Field], header: Sequence[str] | None = None) -> DataFrame:
    """Files' bytes; empty cells are null, a cell that does not parse fails."""
    empty = cells.withColumn("cells", F.transform("cells", lambda x: F.when(x != "", x)))
    bound = bind(empty, spec, header)
    return packed.packed(bound.strict(), [f.name for f in spec if f.kind == "guid"])


def packed_to_csv(files: DataFrame, schema: str, delimiter: str = ",") -> tuple[str, DataFrame]:
    """The header and the lines; vectors are ``[a,b]``."""
    rows = packed.unpacked(files, schema)
    return render.header_line(rows.columns, delimiter), rows.select(render.csv_line(rows, delimiter=delimiter).alias("value"))


def workbook_to_csv(files: DataFrame, sheet: str | int | None = None, delimiter: str = ",") -> DataFrame:
    rows = packed.read_workbooks(files, sheet)
    return rows.select("row_number", F.array_join(F.transform("cells", lambda c: render.csv_cell(c, delimiter)), delimiter).alias("value"))


def workbook_to_jsonl(files: DataFrame, header: Sequence[str], sheet: str | int | None = None) -> DataFrame:
    return csv_to_jsonl(packed.read_workbooks(files, sheet).where("row_number > 1"), header)


def csv_to_fixed(cells: DataFrame, header: Sequence[str], slots: Sequence[render.Slot] | None = None) -> DataFrame:
    """Without slots, columns are as wide as their longest value and two, five at least."""
    return render.csv_to_fixed(cells, header, slots or render.auto_slots(named(cells, header).drop("row_number")))


def convert(source: str, target: str, data: DataFrame, **options) -> DataFrame:
    """By the names of the formats: csv, jsonl, txt, xlsx, packed. Fixed-width text has no layout of its own, so it is refused."""
    ways = {("csv", "jsonl"): csv_to_jsonl, ("csv", "txt"): csv_to_fixed, ("csv", "packed"): csv_to_packed, ("xlsx", "csv"): workbook_to_csv, ("xlsx", "jsonl"): workbook_to_jsonl, ("jsonl", "csv"): lambda d, **o: render.json_to_csv(d, **o)[1], ("packed", "csv"): lambda d, **o: packed_to_csv(d, **o)[1]}
    if (source, target) not in ways:
        raise ConversionError(f"{source} to {target} is not supported")
    return ways[source, target](data, **options)


def write_jsonl(df: DataFrame, path: str, columns: Sequence[str] | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> None:
    """A folder of JSON lines, typed values kept; fails beyond a limit before anything is written."""
    line = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    if max_rows is not None or max_bytes is not None:
        render.check_limits(df, line, max_rows, max_bytes)
    df.select(line.alias("value")).write.text(path)
