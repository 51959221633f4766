"""A compact binary row format, and Excel workbooks.

The row format: magic ``48 54 42 01``, column count, then a type byte, name length and UTF-8 name for each column; rows are a
null mask and the values that are not null; integers are little-endian. A file is read whole by one task, as it has no index.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal
from itertools import chain, islice
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# fixed values of the format
MAGIC = b"\x48\x54\x42\x01"
CODES = {1: "int", 2: "bigint", 3: "float", 4: "double", 5: "decimal(38,18)", 6: "boolean", 7: "timestamp_ntz", 8: "string", 9: "guid", 10: "array<float>"}
TICKS_EPOCH = dt.datetime(1, 1, 1)
MAX_COLUMNS = 2048


class FormatError(ValueError):
    pass


def code_of(kind: T.DataType, name: str, guids: Sequence[str] = ()) -> int:
    text = kind.simpleString()
    if name in guids:
        return 9
    if text.startswith("decimal"):
        return 5
    for code, k in CODES.items():
        if k == text:
            return code
    raise FormatError(f"no code for {text}")


def _pack(code: int, v) -> bytes:
    if code in (1, 2, 3, 4):
        return struct.pack("<" + "iqfd"[code - 1], v)
    if code == 5:
        sign, digits, exponent = Decimal(v).as_tuple()
        n = int("".join(map(str, digits)) or "0") * 10 ** max(0, exponent)
        scale = max(0, -exponent)
        while n >= 1 << 96 or scale > 28:
            if n % 10 or not scale:
                raise FormatError(f"{v} does not fit")
            n, scale = n // 10, scale - 1
        return struct.pack("<IIII", n & 0xFFFFFFFF, n >> 32 & 0xFFFFFFFF, n >> 64, scale << 16 | (sign << 31))
    if code == 6:
        return b"\x01" if v else b"\x00"
    if code == 7:
        d = v - TICKS_EPOCH
        return struct.pack("<q", (d.days * 86400 + d.seconds) * 10_000_000 + d.microseconds * 10)
    if code == 8:
        raw = v.encode()
        return struct.pack("<i", len(raw)) + raw
    if code == 9:
        return uuid.UUID(v).bytes_le
    return struct.pack("<i", len(v)) + struct.pack(f"<{len(v)}f", *v)


def encode(columns: Sequence[tuple[str, int]], rows: Iterator[Sequence]) -> Iterator[bytes]:
    if not 1 <= len(columns) <= MAX_COLUMNS:
        raise FormatError("1 to 2048 columns")
    head = [MAGIC, struct.pack("<i", len(columns))]
    for name, code in columns:
        raw = name.encode()
        if not name.strip():
            raise FormatError("a column has no name")
        head.append(bytes([code]) + struct.pack("<i", len(raw)) + raw)
    yield b"".join(head)
    for row in rows:
        mask = bytearray((len(columns) + 7) // 8)
        parts = []
        for k, ((_, code), v) in enumerate(zip(columns, row, strict=True)):
            if v is None:
                mask[k // 8] |= 1 << k % 8
            else:
                parts.append(_pack(code, v))
        yield bytes(mask) + b"".join(parts)


def decode(data: bytes) -> tuple[list[tuple[str, int]], Iterator[list]]:
    """(columns, rows)."""
    if data[:4] != MAGIC:
        raise FormatError("not this format")
    at = 4

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(data):
            raise FormatError("the file is cut off")
        at += n
        return data[at - n : at]

    number = lambda: struct.unpack("<i", take(4))[0]
    n = number()
    if not 1 <= n <= MAX_COLUMNS:
        raise FormatError("1 to 2048 columns")
    columns = []
    for _ in range(n):
        code = take(1)[0]
        if code not in CODES:
            raise FormatError(f"unknown type {code}")
        columns.append((take(number()).decode(), code))

    def value(code: int):
        if code in (1, 2, 3, 4):
            return struct.unpack("<" + "iqfd"[code - 1], take((4, 8, 4, 8)[code - 1]))[0]
        if code == 5:
            a, b, c, flags = struct.unpack("<IIII", take(16))
            v = Decimal(a | b << 32 | c << 64).scaleb(-(flags >> 16 & 0xFF))
            return -v if flags >> 31 else v
        if code == 6:
            return take(1) != b"\x00"
        if code == 7:
            return TICKS_EPOCH + dt.timedelta(microseconds=(struct.unpack("<q", take(8))[0] & ((1 << 62) - 1)) // 10)
        if code == 8:
            return take(number()).decode()
        if code == 9:
            return str(uuid.UUID(bytes_le=take(16)))
        k = number()
        return list(struct.unpack(f"<{k}f", take(4 * k)))

    def rows() -> Iterator[list]:
        while at < len(data):
            mask = take((n + 7) // 8)
            yield [None if mask[k // 8] >> k % 8 & 1 else value(code) for k, (_, code) in enumerate(columns)]

    return columns, rows()


def write_packed(df: DataFrame, path: str, guids: Sequence[str] = (), max_rows: int = 1_000_000) -> None:
    """Packed files ``part-N.packed`` in a folder that driver and executors share, one for each ``max_rows`` rows of a task.

    A task writes under a name of its own attempt and renames the file, so that a repeated or lost task leaves no half of one."""
    import os

    local = path.removeprefix("file://")
    if "://" in local:
        raise FormatError("a path that executors can open is needed")
    os.makedirs(local, exist_ok=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, k = TaskContext.get(), 0
        for b in batches:
            for data in b.column(0).to_pylist():
                name = f"{local}/part-{task.partitionId():05d}-{k:05d}.packed"
                with open(f"{name}.{task.taskAttemptId()}", "wb") as f:
                    f.write(data)
                os.replace(f"{name}.{task.taskAttemptId()}", name)
                k += 1
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], names=["files"])

    packed(df, guids, max_rows).mapInArrow(run, "files bigint").agg({"files": "sum"}).collect()


def packed(df: DataFrame, guids: Sequence[str] = (), max_rows: int = 1_000_000, max_bytes: int = 256 << 20) -> DataFrame:
    """(content binary): files' bytes, one for each ``max_rows`` rows or about ``max_bytes`` of a task; a task without rows gives one of the header alone."""
    columns = [(f.name, code_of(f.dataType, f.name, guids)) for f in df.schema.fields]

    def run(batches):
        import pyarrow as pa

        def out(parts):
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.large_binary()).cast(pa.binary())], names=["content"])

        head = next(iter(encode(columns, iter(()))))
        parts, n, size, any_ = [head], 0, 0, False
        for b in batches:
            for k, row in enumerate(encode(columns, zip(*[c.to_pylist() for c in b.columns], strict=True))):
                if not k:
                    continue
                parts.append(row)
                n, size, any_ = n + 1, size + len(row), True
                if n >= max_rows or size >= max_bytes:
                    yield out(parts)
                    parts, n, size = [head], 0, 0
        if n or not any_:
            yield out(parts)

    return df.mapInArrow(run, "content binary")


def unpacked(files: DataFrame, schema: str, content: str = "content", max_rows: int = 1_000_000, skip_rows: int = 0, on_error: str = "throw") -> DataFrame:
    """The rows of files' bytes, columns matched by name; columns that the schema lacks are passed over.

    ``skip_rows`` leaves out a file's first rows; a file that is cut off fails, or ends where it is (``on_error="skip"``)."""
    if on_error not in ("throw", "skip"):
        raise ValueError("on_error is throw or skip")
    fields = T._parse_datatype_string(schema).fields if hasattr(T, "_parse_datatype_string") else files.sparkSession.createDataFrame([], schema).schema.fields

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for b in batches:
            for data in b.column(0).to_pylist():
                columns, rows = decode(data)
                names = [c for c, _ in columns]
                at = [names.index(f.name) if f.name in names else None for f in fields]
                held = []
                for k, row in enumerate(_whole_rows(rows, on_error), 1):
                    if k > max_rows:
                        raise FormatError(f"more than {max_rows} rows")
                    if k <= skip_rows:
                        continue
                    held.append([None if i is None else row[i] for i in at])
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=[f.name for f in fields])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=[f.name for f in fields])

    return files.select(content).mapInArrow(run, schema)


def _whole_rows(rows: Iterator[list], on_error: str) -> Iterator[list]:
    try:
        yield from rows
    except FormatError:
        if on_error == "throw":
            raise


def read_packed(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return unpacked(spark.read.format("binaryFile").option("pathGlobFilter", "*.packed").load(path), schema, **options)


# Excel

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times, and limits against hostile files: fixed values of the file format and of its reader.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)
MAX_BYTES, MAX_RATIO, MAX_COLUMN = 512 << 20, 200, 16384


def _part(z: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MAX_BYTES or info.file_size > MAX_RATIO * max(info.compress_size, 1) and info.file_size > 1 << 20:
        raise FormatError(f"{name} is too large unpacked")
    if sum(i.file_size for i in z.infolist()) > MAX_BYTES:
        raise FormatError("the workbook is too large unpacked")
    data = z.read(name)
    _no_dtd(data, name)
    return data


def _no_dtd(data: bytes, name: str) -> None:
    """A document type is refused wherever it stands and however it is encoded: the parser itself meets it before any entity."""

    def refuse(*_):
        raise FormatError(f"{name} has a document type")

    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler = lambda *_: stop()

    def stop():  # a document type stands before the first element
        raise _Started

    try:
        parser.Parse(data, True)
    except _Started:
        return
    except expat.ExpatError as e:
        raise FormatError(f"{name} is no XML: {e}") from None


class _Started(Exception):
    pass


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    if n > MAX_COLUMN:
        raise FormatError(f"column {ref} is out of range")
    return n - 1


def is_date_code(code: str) -> bool:
    """A custom format that shows a date or time: y, m, d, h or s outside quotes, brackets and escapes."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def _serial(text: str) -> str:
    """A day number as text: time alone below one, else ISO date and time."""
    v = float(text)
    if v < 1:
        return str(dt.timedelta(seconds=round(v * 86400))).zfill(8)
    when = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(v * 86400))
    return when.isoformat()


def sheets(data: bytes) -> dict[str, str]:
    """Sheet names and their parts, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(_part(z, "xl/_rels/workbook.xml.rels"))}
        return {s.get("name"): "xl/" + links[s.get(_REL)].removeprefix("/xl/") for s in ElementTree.fromstring(_part(z, "xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)}


def sheet_rows(data: bytes, sheet: str | int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(row number, cells as text) of a sheet, by default the first; gaps are empty."""
    names = sheets(data)
    if isinstance(sheet, int):
        sheet = list(names)[sheet]
    part = names[sheet] if sheet is not None else next(iter(names.values()))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t"))) for si in ElementTree.fromstring(raw).iterfind("m:si", _NS)] if (raw := _part(z, "xl/sharedStrings.xml")) else []
        dates: list[bool] = []
        if raw := _part(z, "xl/styles.xml"):
            root = ElementTree.fromstring(raw)
            custom = {int(f.get("numFmtId")): is_date_code(f.get("formatCode")) for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
            dates = [(k := int(x.get("numFmtId", "0"))) in DATE_FORMATS or custom.get(k, False) for x in root.iterfind("m:cellXfs/m:xf", _NS)]
        tag = lambda x: f"{{{_NS['m']}}}{x}"
        for number, (_, row) in enumerate((e for e in ElementTree.iterparse(io.BytesIO(_part(z, part))) if e[1].tag == tag("row")), 1):
            cells: list[str] = []
            for c in row.iterfind("m:c", _NS):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                kind, v = c.get("t", "n"), c.findtext("m:v", None, _NS)
                if kind == "s":
                    text = shared[int(v)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(tag("t")))
                elif kind == "b":
                    text = "TRUE" if v == "1" else "FALSE"
                elif kind == "e":
                    text = ""
                else:
                    text = v or ""
                    style = int(c.get("s", "0"))
                    if text and kind == "n" and style < len(dates) and dates[style]:
                        text = _serial(text)
                cells.append(text)
            yield int(row.get("r", number)), cells
            row.clear()


def sheet_records(rows: DataFrame, sheet: str, header: Sequence[str] | None = None, skip_rows: int = 1, max_rows: int | None = None, nulls: Sequence[str] = ()) -> DataFrame:
    """The rows of one of several sheets, without the first ones (the header); ``max_rows`` ends the reading and is no error here."""
    from pyspark.sql import functions as F

    own = rows.where((F.col("sheet") == sheet) & (F.col("row_number") > skip_rows))
    if max_rows is not None:
        own = own.where(F.col("row_number") <= skip_rows + max_rows)
    cells = F.transform("cells", lambda c: F.when(~c.isin(*nulls), c)) if nulls else F.col("cells")
    if header is None:
        return own.select("row_number", cells.alias("cells"))
    return own.select("row_number", *[F.try_element_at(cells, F.lit(k + 1)).alias(n) for k, n in enumerate(header)])


def read_workbooks(files: DataFrame, sheet: str | int | None = None, every: bool = False, content: str = "content") -> DataFrame:
    """(sheet, row_number, cells) of workbooks' bytes: one sheet, or all."""
    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("sheet", pa.string()), ("row_number", pa.int64()), ("cells", pa.list_(pa.string()))])
        for b in batches:
            for data in b.column(0).to_pylist():
                names = sheets(data)
                chosen = list(names) if every else [list(names)[sheet or 0] if sheet is None or isinstance(sheet, int) else sheet]
                for name in chosen:
                    rows = sheet_rows(data, name)
                    while held := list(islice(rows, 10_000)):
                        yield pa.RecordBatch.from_pylist([{"sheet": name, "row_number": n, "cells": c} for n, c in held], kind)

    return files.select(content).mapInArrow(run, "sheet string, row_number bigint, cells array<string>")


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(tables: dict[str, tuple[Sequence[str], Iterable[Sequence]]], merges: dict[str, Sequence[str]] | None = None, max_rows: int = 1_048_576, protection: str = "escape") -> bytes:
    """A workbook of sheets (header, rows); numbers, booleans, dates and text keep their kind. Text that may be run as a formula is
    escaped by an apostrophe, stripped of its lead (sanitize), an error (reject) or left (none). Rows are written as they come."""
    if protection not in ("escape", "sanitize", "reject", "none"):
        raise ValueError(f"unknown protection {protection}")

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float, Decimal)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if isinstance(v, (dt.datetime, dt.date)):
            full = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            days = (full.replace(tzinfo=None) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
            return f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
        text = str(v)
        if protection != "none" and text and (text[0] in "=@\t\r" or re.match(r"[+-][^0-9.]", text)):
            if protection == "reject":
                raise FormatError(f"cell {ref} may be run as a formula")
            text = "'" + text if protection == "escape" else re.sub(r"^[=@\t\r+\-]+", "", text)
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    out, m = io.BytesIO(), _NS["m"]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(tables)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in range(1, len(names) + 1))}<Relationship Id="rId0" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{m}" xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name="{escape(x)}" sheetId="{k}" r:id="rId{k}"/>""" for k, x in enumerate(names, 1))}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{m}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for k, name in enumerate(names, 1):
            header, rows = tables[name]
            own = (merges or {}).get(name, ())
            merged = f'<mergeCells count="{len(own)}">{"".join(f"""<mergeCell ref="{r}"/>""" for r in own)}</mergeCells>' if own else ""
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as part, io.TextIOWrapper(part, "utf-8", newline="") as f:
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{m}"><sheetData>')
                for i, row in enumerate(chain([header], rows), 1):
                    if i > max_rows:
                        raise FormatError(f"more than {max_rows} rows")
                    f.write(f'<row r="{i}">{"".join(cell(f"{_letters(j)}{i}", v) for j, v in enumerate(row))}</row>')
                f.write(f"</sheetData>{merged}</worksheet>")
    return out.getvalue()


def write_workbook(frames: dict[str, DataFrame], max_rows: int = 1_048_576, merges: dict[str, Sequence[str]] | None = None) -> bytes:
    """A workbook is one file with a row limit: rows come to the driver, no more of them than a sheet may hold."""
    return workbook({n: (d.columns, [tuple(r) for r in d.limit(max_rows).collect()]) for n, d in frames.items()}, merges, max_rows)


def workbooks(df: DataFrame, sheet: str = "Sheet1", max_rows: int = 1_048_576, protection: str = "escape", max_bytes: int = MAX_BYTES // 2) -> DataFrame:
    """(content binary): workbooks' bytes, one for each sheet of ``max_rows`` rows, its header among them, of a task, or of rows that
    reach ``max_bytes`` of XML at most, as the reader refuses sheets over ``MAX_BYTES``; a task without rows gives one of the header alone."""
    if max_rows < 2:
        raise ValueError("a sheet has a header and a row")
    header = df.columns

    def run(batches):
        import pyarrow as pa

        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        ahead = list(islice(rows, 1))

        def full():
            size = 0
            for row in chain(ahead, islice(rows, max_rows - 1 - len(ahead))):
                yield row
                size += sum(80 + 5 * len(str(v)) for v in row)  # a cell's tags, and the longest escape of a character
                if size >= max_bytes:
                    return

        while True:
            data = workbook({sheet: (header, full())}, protection=protection)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])
            if not (ahead := list(islice(rows, 1))):
                return

    return df.mapInArrow(run, "content binary")
