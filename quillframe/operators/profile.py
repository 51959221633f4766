"""What a table of text holds: delimiter, types, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s

CANDIDATES = (",", ";", "|", "\t")


class DetectionError(ValueError):
    pass


def delimiter_scores(lines: DataFrame, value: str = "value", order: str = "row_number", sample: int = 10, quote: str = '"') -> DataFrame:
    """(delimiter, average, score, confidence) of the candidates that at least four fifths of the first lines hold."""
    first = lines.where(F.trim(value) != "").orderBy(order).limit(sample)
    bare = F.regexp_replace(value, f"{quote}[^{quote}]*{quote}", "")
    each = first.select(F.posexplode(F.array(*map(F.lit, CANDIDATES))).alias("rank", "delimiter"), bare.alias("bare"))
    n = (F.length("bare") - F.length(F.replace(F.col("bare"), F.col("delimiter"), F.lit("")))).cast("double")
    stats = each.withColumn("n", n).groupBy("rank", "delimiter").agg(F.avg("n").alias("average"), F.stddev_pop("n").alias("spread"), F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("hits"))
    good = stats.where("hits > 0 and hits >= 0.8 * rows")
    score = 0.3 * F.col("average") + 0.7 * F.col("average") / (F.col("spread") + 1)
    confidence = F.when(F.col("rows") == 1, F.lit(100)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - (100 * F.col("spread") / F.col("average")).cast("int"))))
    return good.select("rank", "delimiter", "average", score.alias("score"), confidence.alias("confidence"))


def detect_delimiter(lines: DataFrame, value: str = "value", order: str = "row_number") -> tuple[str, int]:
    best = delimiter_scores(lines, value, order).orderBy(F.desc("score"), "rank").first()
    if best is None:
        raise DetectionError("no delimiter fits")
    return best.delimiter, best.confidence


def _is(c: Column) -> dict[str, Column]:
    return {"bool": s.parse_bool(c).isNotNull(), "int": s.parse_int(c, "int", True).isNotNull(), "long": s.parse_int(c, "long", True).isNotNull(), "decimal": s.parse_decimal(c).isNotNull(), "guid": s.parse_guid(c).isNotNull(), "datetime": s.parse_timestamp(c).isNotNull() | s.parse_date(c).isNotNull()}


def infer_schema(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, type, nullable, max_length) of text columns; the caller limits the sample."""
    def cell(c: str) -> Column:
        text, kind = F.col(c), F.lit("string")
        for name, ok in reversed(_is(text).items()):
            kind = F.when(ok, F.lit(name)).otherwise(kind)
        return F.struct(F.lit(c).alias("name"), F.when(F.coalesce(text, F.lit("")) != "", kind).alias("kind"), s.utf16_len(text).cast("int").alias("size"))

    cells = rows.select(F.explode(F.array(*[cell(c) for c in columns])).alias("x")).select("x.*")
    seen = cells.groupBy("name").agg(*[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in ("string", "bool", "int", "long", "decimal", "guid", "datetime")], F.bool_or(F.col("kind").isNull()).alias("nullable"), F.coalesce(F.max("size"), F.lit(0)).alias("max_length"))
    number = F.col("int") | F.col("long") | F.col("decimal")
    families = F.col("bool").cast("int") + number.cast("int") + F.col("guid").cast("int") + F.col("datetime").cast("int")
    kind = F.when(F.col("string") | (families != 1), "String").when(F.col("bool"), "Boolean").when(F.col("decimal"), "Decimal").when(F.col("long"), "Long").when(F.col("int"), "Integer").when(F.col("guid"), "Guid").otherwise("DateTime")
    return seen.select("name", kind.alias("type"), "nullable", "max_length")


def profile_text(rows: DataFrame, columns: Sequence[str], order: str, categories: int = 100) -> DataFrame:
    """One row a column of text: counts, kind, numeric range and the commonest of the first ``categories`` distinct values."""
    cells = rows.select(F.col(order).alias("at"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.trim(c) != "", F.trim(c)).alias("text")) for c in columns])).alias("x")).select("at", "x.*")
    number = s.parse_double(F.col("text"))
    base = cells.groupBy("name").agg(
        F.count("*").alias("rows"), F.count("text").alias("filled"), F.count(s.parse_int(F.col("text"), "long")).alias("ints"), F.count(number).alias("numbers"), F.count(s.parse_bool(F.col("text"))).alias("bools"),
        F.min(number).alias("low"), F.max(number).alias("high"), F.sum(number).alias("total"), F.count_if(s.parse_bool(F.col("text"))).alias("trues"),
    )
    values = cells.where("text is not null").groupBy("name", F.lower("text").alias("key")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    first = values.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "key", "n"))), 1, categories).alias("kept"))
    best = F.array_sort(F.transform("kept", lambda x: F.struct((-x["n"]).alias("fewer"), x["first"].alias("first"), x["key"].alias("key"), x["n"].alias("n"))))
    top = first.select("name", F.size("kept").alias("categories"), best[0]["key"].alias("commonest"), best[0]["n"].alias("commonest_n"))
    f = F.col("filled")
    kind = F.when(f == 0, "empty").when(F.col("bools") == f, "bool").when(F.col("ints") == f, "int").when(F.col("numbers") == f, "double").otherwise("string")
    return base.join(top, "name", "left").select("name", "rows", "filled", kind.alias("kind"), "low", "high", "total", "trues", F.coalesce("categories", F.lit(0)).alias("categories"), "commonest", "commonest_n")


def profile_records(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a typed column: range and mean of numbers, counts of booleans, distinct (any case) and commonest of text."""
    kinds, out = dict(df.dtypes), []
    for c in columns or df.columns:
        k = kinds[c]
        numeric = k.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        row = [F.lit(c).alias("name"), F.lit("number" if numeric else "bool" if k == "boolean" else "text" if k == "string" else "other").alias("kind"), F.count("*").alias("rows"), F.count(c).alias("filled")]
        x = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        row += [F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), (F.count_if(F.col(c)) if k == "boolean" else F.lit(None).cast("bigint")).alias("trues"), (F.count_distinct(F.lower(c)) if k == "string" else F.lit(None).cast("bigint")).alias("distinct")]
        out.append(df.agg(*row))
    return out[0] if len(out) == 1 else _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(value, n, percent of all rows) of the commonest; ties by value."""
    n = df.count()
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k).withColumn("percent", F.round(100 * F.col("n") / F.lit(max(n, 1)), 1))


def card(profile: DataFrame, title: str) -> DataFrame:
    """(line_no, line): a markdown card of ``profile_records``."""
    percent = F.format_string("%.1f", 100 * F.col("filled") / F.greatest(F.col("rows"), F.lit(1)))
    body = (
        F.when(F.col("kind") == "number", F.concat(F.lit("range "), F.format_number("low", 2), F.lit(" to "), F.format_number("high", 2), F.lit(", mean "), F.format_number("mean", 2)))
        .when(F.col("kind") == "bool", F.concat(F.lit("true "), F.format_number("trues", 0)))
        .when(F.col("kind") == "text", F.concat(F.format_number("distinct", 0), F.lit(" distinct")))
        .otherwise(F.lit("Complex or other type."))
    )
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("**: "), body, F.lit(" ("), percent, F.lit("% filled)"))
    return profile.select(F.row_number().over(Window.orderBy("name")).alias("line_no"), line.alias("line")).unionByName(profile.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.lit(f"### Dataset Profile: {title}").alias("line")))


def filled_columns(df: DataFrame) -> list[str]:
    """Columns with any value that is neither null nor empty; all of them where there is none, or no row."""
    flags = df.agg(*[F.coalesce(F.max(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0), F.lit(False)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if flags[c]] or df.columns


def structure_errors(rows: DataFrame, header: Sequence[str] | None, required: Sequence[str] = (), expected: int | None = None, max_rows: int = 1_000_000) -> DataFrame:
    """The structural check of a scan: (error_type, row_number, expected, actual, message)."""
    schema = "error_type string, row_number bigint, expected string, actual string, message string"
    spark, out = rows.sparkSession, []
    if header is None and rows.isEmpty():
        return spark.createDataFrame([("EmptyFile", 0, None, None, "the file has no rows")], schema)
    names = {h.lower() for h in header or []}
    out += [("MissingHeader", 1, r, None, f"no column {r}") for r in required if r.lower() not in names]
    width = expected or (len(header) if header else rows.orderBy("row_number").select(F.size("cells")).first()[0])
    if expected and header and len(header) != expected:
        out.append(("ColumnCountMismatch", 1, str(expected), str(len(header)), "the header has another number of columns"))
    n = F.size("cells")
    ragged = rows.where(n != width).select(F.lit("ColumnCountMismatch" if expected else "InconsistentColumnCount").alias("error_type"), "row_number", F.lit(str(width)).alias("expected"), n.cast("string").alias("actual"), F.lit("the row has another number of columns").alias("message"))
    many = rows.agg(F.count("*").alias("n")).where(F.col("n") > max_rows).select(F.lit("TooManyRows").alias("error_type"), F.lit(max_rows + 1).cast("bigint").alias("row_number"), F.lit(str(max_rows)).alias("expected"), F.col("n").cast("string").alias("actual"), F.lit("too many rows").alias("message"))
    return spark.createDataFrame(out, schema).unionByName(ragged).unionByName(many)


def counted(df: DataFrame, name: str, text: str):
    """The same rows, with an observation of their number and bytes that a caller may read after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), F.sum(F.octet_length(text)).alias("bytes")), seen


