"""Record specifications: how the cells of a row become typed columns, and what is an error."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s


@dataclass(frozen=True)
class Rules:
    not_null: bool = False
    not_empty: bool = False
    min_length: int | None = None
    max_length: int | None = None
    low: float | None = None
    high: float | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class Field:
    """One member. Bound by header name, by index, or by start and length in a line."""

    name: str
    kind: str = "string"
    source: str | None = None
    index: int | None = None
    start: int | None = None
    length: int | None = None
    align: str = "left"
    pad: str = " "
    nullable: bool = True
    rules: Rules = Rules()
    options: dict = field(default_factory=dict)
    converter: Callable[[Column], Column] | None = None

    def value(self, text: Column) -> Column:
        return self.converter(text) if self.converter else s.parse(text, self.kind, **self.options)


ERROR = "struct<row_number:bigint,column_index:int,column_name:string,property_name:string,rule:string,message:string,raw_value:string>"


class HeaderError(ValueError):
    pass


class RowErrors(ValueError):
    """Strict reading found rows in error; says how many and the first three."""


#: Kinds whose value a range rule can look at, so that the text is not parsed once more.
_NUMBERS = (*s.INT_BOUNDS, "decimal", "double", "float")
#: Messages of the rules, in full and short.
MESSAGES = {
    "full": {"NotNull": "Value is required", "NotEmpty": "Value must not be empty", "MinLength": "Length must be at least {}", "MaxLength": "Length must be at most {}", "RangeMin": "Value must be at least {:g}", "RangeMax": "Value must be at most {:g}", "Pattern": "Value does not match the pattern", "Parse": "Value is not a {}"},
    "short": {"NotNull": "required", "NotEmpty": "empty", "MinLength": "shorter than {}", "MaxLength": "longer than {}", "RangeMin": "below {:g}", "RangeMax": "above {:g}", "Pattern": "pattern", "Parse": "not a {}"},
}


def rule_errors(f: Field, text: Column, row_number: Column, index: int, value: Column | None = None, messages: str = "full") -> Column:
    """The failed rules of a cell, in order; a missing value settles the field. ``value`` is the parsed cell, where there is one already."""
    r, none, says = f.rules, F.lit(None).cast(ERROR), MESSAGES[messages]
    value = f.value(text) if value is None else value
    number = value if f.kind in _NUMBERS and not f.converter else s.parse_double(text)

    def error(rule: str, *of) -> Column:
        message = says[rule].format(*of)
        return F.struct(row_number.cast("bigint").alias("row_number"), F.lit(index).alias("column_index"), F.lit(f.source or f.name).alias("column_name"), F.lit(f.name).alias("property_name"), F.lit(rule).alias("rule"), F.lit(message).alias("message"), text.alias("raw_value")).cast(ERROR)

    blank = F.trim(text) == ""
    missing = F.when(text.isNull() & F.lit(r.not_null or r.not_empty), error("NotNull"))
    if r.not_empty:
        missing = missing.when(blank, error("NotEmpty"))
    checks = []
    if r.min_length is not None:
        checks.append(F.when(s.utf16_len(text) < r.min_length, error("MinLength", r.min_length)))
    if r.max_length is not None:
        checks.append(F.when(s.utf16_len(text) > r.max_length, error("MaxLength", r.max_length)))
    if r.low is not None:
        checks.append(F.when(number < r.low, error("RangeMin", r.low)))
    if r.high is not None:
        checks.append(F.when(number > r.high, error("RangeMax", r.high)))
    if r.pattern is not None:
        checks.append(F.when(~text.rlike(r.pattern), error("Pattern")))
    if f.kind != "string" or f.converter:
        bad = value.isNull()
        wrong = (text != "") & bad if f.nullable else bad & ~(text.isNull() & F.lit(r.not_null or r.not_empty))
        checks.append(F.when(wrong, error("Parse", f.kind)))
    listed = F.filter(F.array(*checks) if checks else F.array(none), lambda x: x.isNotNull())
    if r.not_null or r.not_empty:
        first = missing.otherwise(none)
        return F.when(first.isNotNull(), F.array(first)).otherwise(listed)
    return listed


@dataclass
class Bound:
    """Rows that passed, and the table of errors of those that did not. Nothing runs until either is used."""

    rows: DataFrame
    errors: DataFrame
    checked: DataFrame | None = None

    def strict(self) -> DataFrame:
        """The rows, if there is no error at all; without one, a single scan has been made."""
        n = self.errors.count()
        if n:
            some = self.errors.orderBy("row_number", "column_index").limit(3).collect()
            raise RowErrors(f"{n} errors; first: " + "; ".join(f"row {e.row_number}, {e.property_name}: {e.message}" for e in some))
        return self.rows

    def policy(self, on_error: str = "skip") -> DataFrame:
        """``skip``: the rows without those in error (these are in ``errors``); ``throw``: the query fails at the first row in error."""
        if on_error == "skip":
            return self.rows
        if on_error != "throw":
            raise ValueError("on_error is skip or throw")
        first = F.element_at("_errors", 1)
        failed = F.raise_error(F.concat(F.lit("row "), first["row_number"].cast("string"), F.lit(", "), first["property_name"], F.lit(": "), first["message"])).cast("boolean")
        out = self.checked.where(F.when(F.size("_errors") > 0, failed).otherwise(True))
        return out.select(*self.rows.columns)


def _find(header: Sequence[str], name: str, ignore_case: bool) -> int | None:
    for i, h in enumerate(header):  # the first of duplicates wins
        if h == name or (ignore_case and h.lower() == name.lower()):
            return i
    return None


def parsed(source: str, spec: Sequence[Field], header: Sequence[str] | None, ignore_case: bool = True, allow_missing: bool = False, nulls: Sequence[str] = (), trim: bool = False) -> tuple[list[int], Column, Column]:
    """The index of each field (-1: missing), and structs of the fields' texts and values from the cells in column ``source``."""
    places, texts, values = [], [], []
    for k, f in enumerate(spec):
        if f.index is not None or header is None:
            at = f.index if f.index is not None else k
        else:
            at = _find(header, f.source or f.name, ignore_case)
            if at is None and (f.rules.not_null or (not f.nullable and f.kind != "string")) and not allow_missing:
                raise HeaderError(f"no column {f.source or f.name} in the header")
        text = F.lit(None).cast("string") if at is None else F.try_element_at(source, F.lit(at + 1))
        text = s.trim_cell(text) if trim else text
        text = s.null_tokens(text, nulls)
        places.append(-1 if at is None else at)
        texts.append(text.alias(f"c{k}"))
        values.append(f.value(text).alias(f"c{k}"))
    return places, F.struct(*texts), F.struct(*values)


def field_errors(spec: Sequence[Field], places: Sequence[int], texts: str, values: str, messages: str = "full") -> Column:
    """All errors of a row whose texts and values are in struct columns of these names."""
    each = [rule_errors(f, F.col(f"{texts}.c{k}"), F.col("row_number"), at, F.col(f"{values}.c{k}"), messages) for k, (f, at) in enumerate(zip(spec, places, strict=True))]
    return F.flatten(F.array(*each))


def bind(cells: DataFrame, spec: Sequence[Field], header: Sequence[str] | None = None, *, ignore_case: bool = True, allow_missing: bool = False, nulls: Sequence[str] = (), trim: bool = False, raw_quotes: bool = False, keep: Sequence[str] = (), messages: str = "full") -> Bound:
    """Types the rows of ``cells`` (row_number, cells array<string>, and raw cells as ``raw`` where a scan gives them).

    A cell is parsed once: rules look at the parsed values. Fields without rules that cannot fail cost no more than their parse."""
    source = "raw" if raw_quotes and "raw" in cells.columns else "cells"
    places, texts, values = parsed(source, spec, header, ignore_case, allow_missing, nulls, trim)
    kept = [c for c in keep if c != "row_number"]
    # an id makes the parsed values opaque: else each rule's filter works them out anew
    opaque = F.when(F.monotonically_increasing_id() >= 0, F.struct(texts.alias("t"), values.alias("v")))
    full = cells.select("row_number", *kept, opaque.alias("_p")).withColumn("_errors", field_errors(spec, places, "_p.t", "_p.v", messages))
    columns = [*(["row_number"] if "row_number" in keep else []), *kept, *[F.col(f"_p.v.c{k}").alias(f.name) for k, f in enumerate(spec)]]
    checked = full.select(*columns, "_errors")
    good = full.where(F.size("_errors") == 0).select(*columns)
    return Bound(good, full.where(F.size("_errors") > 0).select(F.explode("_errors").alias("e")).select("e.*"), checked)


def first_error_only(errors: DataFrame) -> DataFrame:
    """One error a row, the first by column: as formats report that check row by row."""
    return errors.groupBy("row_number").agg(F.min(F.struct("column_index", "rule", "property_name", "message", "raw_value", "column_name")).alias("e")).select("row_number", "e.*")


def schema_table(df: DataFrame) -> DataFrame:
    """(ordinal, name, type, nullable): the columns of a table as rows."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean")


def validate_values(df: DataFrame, spec: Sequence[Field], row_number: str) -> DataFrame:
    """The same rules on typed columns before they are written; the error table."""
    errors = [rule_errors(Field(f.name, "string", f.source, rules=f.rules), F.col(f.name).cast("string"), F.col(row_number), k) for k, f in enumerate(spec)]
    return df.select(F.explode(F.flatten(F.array(*errors))).alias("e")).select("e.*")


def json_schema(spec: Sequence[Field]) -> dict:
    """The JSON schema of a record, for tool definitions."""
    kinds = {"bool": "boolean", "decimal": "number", "double": "number", "float": "number"} | dict.fromkeys(s.INT_BOUNDS, "integer")
    out: dict = {"type": "object", "properties": {}, "required": []}
    for f in spec:
        p = {"type": kinds.get(f.kind, "string")}
        p |= {k: v for k, v in (("minimum", f.rules.low), ("maximum", f.rules.high), ("pattern", f.rules.pattern), ("minLength", f.rules.min_length), ("maxLength", f.rules.max_length), ("enum", list(f.options["names"]) if f.kind == "enum" else None)) if v is not None}
        out["properties"][f.source or f.name] = p
        if f.rules.not_null or f.rules.not_empty:
            out["required"].append(f.source or f.name)
    return out


def tool_arguments(calls: DataFrame, spec: Sequence[Field], arguments: str = "arguments", row_number: str = "row_number") -> Bound:
    """Binds JSON arguments: keys match in any case, values are coerced, then rules apply; one error a call."""
    keyed = F.from_json(F.col(arguments), "map<string,string>")
    lowered = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(keyed), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    cells = calls.select(F.col(row_number).alias("row_number"), F.array(*[F.try_element_at(lowered, F.lit((f.source or f.name).lower())) for f in spec]).alias("cells"))
    bound = bind(cells, [Field(f.name, f.kind, f.source, k, nullable=f.nullable, rules=f.rules, options=f.options, converter=f.converter) for k, f in enumerate(spec)], keep=["row_number"])
    return Bound(bound.rows, first_error_only(bound.errors))
