"""Delimited text. Lines split by expression where a record is a line; a quote-aware reader for files where it is not."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as s

ROW_SCHEMA = "row_number bigint, line_number bigint, raw array<string>, cells array<string>"


class ScanError(ValueError):
    pass


@dataclass(frozen=True)
class Dialect:
    """Options of the text and its limits; a limit that is passed is an error, never a cut.

    ``max_rows`` is off here (a file's reader of its own would set 100,000): counting costs a scan of its own before the rows."""

    delimiter: str = ","
    quote: str | None = '"'
    escape: str | None = None
    comment: str | None = None
    newlines_in_quotes: bool = False
    max_columns: int = 100
    max_rows: int | None = None
    max_row_size: int | None = 512 * 1024
    max_field_size: int | None = None
    max_input_size: int | None = None

    def __post_init__(self) -> None:
        marks = [x for x in (self.delimiter, self.quote, self.escape, self.comment) if x is not None]
        if any(len(x) != 1 or ord(x) > 127 or x in "\r\n" for x in marks) or len(set(marks)) != len(marks):
            raise ScanError("delimiter, quote, escape and comment must be different ASCII characters")
        if not 1 <= self.max_columns <= 10_000:
            raise ScanError("max_columns must be from 1 to 10000")


def cells_of(line: Column, d: Dialect = Dialect()) -> Column:
    """The raw cells of a record that is one line: quotes may open and close anywhere in a cell."""
    de = re.escape(d.delimiter)
    if d.quote is None:
        return F.split(line, de, -1)
    q, e = re.escape(d.quote), re.escape(d.escape or "")
    body = rf"(?:{e}.|{q}(?:{e}.|[^{q}{e}]++)*+{q}|[^{de}{q}{e}]++)*+" if d.escape else rf"(?:{q}[^{q}]*+{q}|[^{de}{q}]++)*+"
    marked = F.contains(line, F.lit(d.quote))
    if d.escape:
        marked |= F.contains(line, F.lit(d.escape))
    full = F.regexp_extract_all(F.concat(F.lit(d.delimiter), line), F.lit(f"{de}({body})"), F.lit(1))
    return F.when(marked, full).otherwise(F.split(line, de, -1))  # most lines have no quote


def is_data(line: Column, d: Dialect = Dialect()) -> Column:
    """Neither empty nor a comment; a line of blanks is data."""
    out = F.length(line) > 0
    return out & ~line.rlike(rf"^[ \t]*{re.escape(d.comment)}") if d.comment else out


def split_lines(lines: DataFrame, d: Dialect = Dialect(), value: str = "value", order: str = "row_number", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of cells from a table of lines, all in expressions; ``order`` numbers the lines. A line in breach of a limit fails the query."""
    raw = cells_of(F.col(value), d)
    checks = F.when(F.size("raw") > d.max_columns, F.raise_error(F.lit(f"more than {d.max_columns} columns")))
    if d.quote is not None:
        bare = F.regexp_replace(F.col(value), f"{re.escape(d.escape)}.", "") if d.escape else F.col(value)  # what an escape stands before is no quote
        odd = F.length(F.regexp_replace(bare, f"[^{re.escape(d.quote)}]++", "")) % 2 == 1
        checks = checks.when(F.contains(F.col(value), F.lit(d.quote)) & odd, F.raise_error(F.lit("a quote is not closed")))
    if d.max_row_size is not None:
        checks = checks.when(F.length(value) > d.max_row_size, F.raise_error(F.lit(f"a row is longer than {d.max_row_size}")))
    if d.max_field_size is not None:
        checks = checks.when(F.exists("raw", lambda x: F.length(x) > d.max_field_size), F.raise_error(F.lit(f"a field is longer than {d.max_field_size}")))
    out = within_rows(lines.where(is_data(F.col(value), d)), d.max_rows).withColumn("raw", raw)
    # an id makes the column opaque: else filters on what is made of the cells go below it and split each line again for every mention
    checked = F.when(checks.otherwise(F.lit(None).cast("string")).isNull() & (F.monotonically_increasing_id() >= 0), F.col("raw"))
    out = out.select(F.col(order).cast("bigint").alias("row_number"), *[c for c in keep], checked.alias("raw"))
    cells = F.when(F.exists("raw", lambda x: x.startswith(d.quote)), F.transform("raw", lambda x: s.unquote(x, d.quote))).otherwise(F.col("raw")) if d.quote else F.col("raw")
    return out.withColumn("cells", F.when(F.monotonically_increasing_id() >= 0, cells))


def within_rows(rows: DataFrame, most: int | None, what: str = "rows") -> DataFrame:
    """The rows, or a query that fails where there are more: one count, before any row goes on."""
    if most is None:
        return rows
    n = rows.agg(F.count("*")).scalar()
    return rows.where(F.when(n > most, F.raise_error(F.lit(f"more than {most} {what}")).cast("boolean")).otherwise(True))


def check_width(rows: DataFrame, width: int) -> DataFrame:
    """Fails where a row has another number of cells than the header."""
    bad = F.raise_error(F.concat(F.lit("row "), F.col("row_number").cast("string"), F.lit(f" has another number of cells than {width}")))
    return rows.withColumn("cells", F.when(F.size("cells") == width, F.col("cells")).otherwise(bad.cast("array<string>")))


def data_reader(rows: DataFrame, header: Sequence[str] | None, width: int) -> DataFrame:
    """All cells as text columns, named by the header or Column1..n."""
    names = list(header) if header else [f"Column{k + 1}" for k in range(width)]
    checked = check_width(rows, width)
    return checked.select("row_number", *[F.element_at("cells", k + 1).alias(n) for k, n in enumerate(names)])


def parse_text(text: str, d: Dialect = Dialect()) -> Iterator[tuple[int, int, list[str]]]:
    """(row number, line number, raw cells) of a whole text, character by character; lines end in LF, CRLF or CR."""
    if d.max_input_size is not None and len(text.encode()) > d.max_input_size:
        raise ScanError(f"more than {d.max_input_size} bytes")
    text = text.removeprefix("﻿")
    pos, n, line, row = 0, len(text), 1, 0
    special = re.compile("[" + re.escape("".join(x for x in (d.delimiter, d.quote, d.escape) if x)) + "\r\n]")
    while pos < n:
        if d.comment and (m := re.compile(rf"[ \t]*{re.escape(d.comment)}[^\r\n]*(\r\n|\r|\n|$)").match(text, pos)):
            pos, line = m.end(), line + 1
            continue
        cells, begin, start, quoted, opened, first_line = [], pos, pos, False, 0, line
        while True:
            m = special.search(text, pos)
            if m is None:
                if quoted:
                    raise ScanError(f"line {first_line}: the quote at {opened} is not closed")
                pos = n
                break
            c, at = m.group(), m.start()
            if c == d.escape:
                pos = min(at + 2, n)
            elif c == d.quote:
                if quoted and text[at + 1 : at + 2] == d.quote:
                    pos = at + 2
                else:
                    quoted, opened, pos = not quoted, at, at + 1
            elif quoted:
                if c in "\r\n":
                    if not d.newlines_in_quotes:
                        raise ScanError(f"line {first_line}: line break within quotes")
                    line += not (c == "\r" and text[at + 1 : at + 2] == "\n")
                pos = at + 1
            elif c == d.delimiter:
                cells.append(text[start:at])
                start = pos = at + 1
            else:
                pos = at
                break
        cells.append(text[start:pos])
        size = pos - begin
        if pos < n:
            pos += 2 if text.startswith("\r\n", pos) else 1
        if size:
            row += 1
            if d.max_rows is not None and row > d.max_rows:
                raise ScanError(f"more than {d.max_rows} rows")
            if len(cells) > d.max_columns:
                raise ScanError(f"row {row} has more than {d.max_columns} columns")
            if d.max_row_size is not None and size > d.max_row_size:
                raise ScanError(f"row {row} is longer than {d.max_row_size}")
            if d.max_field_size is not None and max(map(len, cells)) > d.max_field_size:
                raise ScanError(f"row {row} has a field longer than {d.max_field_size}")
            yield row, first_line, cells
        line += 1


def unquoted(cell: str, quote: str | None) -> str:
    if quote and len(cell) >= 2 and cell[0] == cell[-1] == quote:
        return cell[1:-1].replace(quote * 2, quote)
    return cell


def decoded(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ScanError("UTF-16 text; UTF-8 is expected")
    return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8")


def read_files(spark: SparkSession, path: str, d: Dialect = Dialect()) -> DataFrame:
    """Rows of cells of files whose records may span lines; Spark lists and reads the files, a task parses one at a time."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("row_number", pa.int64()), ("line_number", pa.int64()), ("raw", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = []
                for n, line, raw in parse_text(decoded(data), d):
                    rows.append({"path": name, "row_number": n, "line_number": line, "raw": raw, "cells": [unquoted(x, d.quote) for x in raw]})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {ROW_SCHEMA}")


def read_csv(spark: SparkSession, path: str, d: Dialect = Dialect(), header: bool = True) -> tuple[list[str], DataFrame]:
    """(header, rows: path, row_number, raw, cells) of delimited files whose records are lines, each file with its header.

    Spark splits large files among tasks and streams their lines. Row numbers grow with the place in a file but are not without gaps; a
    line of a file's first split that equals the header is one. For records that span lines use ``read_files``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "^\ufeff", "").alias("value")).where(is_data(F.col("value"), d))
    head = lines.where("start = 0").limit(1).collect() if header else []
    if head:
        lines = lines.where((F.col("start") > 0) | (F.col("value") != head[0].value))
    names = [unquoted(x, d.quote) for r in head for _, _, c in parse_text(r.value, d) for x in c]
    return names, split_lines(lines.withColumn("row_number", F.monotonically_increasing_id() + 1), d, keep=("path",))


class TextSource(DataSource):
    """``spark.read.format("strictcsv").option("text", ...)``: rows of cells of a text given as an option."""

    @classmethod
    def name(cls) -> str:
        return "strictcsv"

    def schema(self) -> str:
        return ROW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _TextReader(o["text"], Dialect(o.get("delimiter", ","), o.get("quote", '"') or None, o.get("escape"), o.get("comment"), o.get("newlinesInQuotes", "false").lower() == "true"))


class _TextReader(DataSourceReader):
    def __init__(self, text: str, d: Dialect) -> None:
        self.text, self.d = text, d

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        for n, line, raw in parse_text(self.text, self.d):
            yield n, line, raw, [unquoted(x, self.d.quote) for x in raw]
