"""Named queries over the test tables, with the SQL that gives the same rows.

The tables are typed, so a text operator's query writes rows as text by an expression, runs the operator on the text, and the
SQL states the outcome from the typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import chunk, combine, convert, profile, render
from ..operators.records import Field, Rules, bind, first_error_only, schema_table, tool_arguments, validate_values
from ..operators.route import Routed, tag_counts
from ..sources import packed
from ..sources.delimited import Dialect, data_reader, parse_text, read_csv, read_files, split_lines
from ..sources.shared import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(df: DataFrame, number: Column, columns: list[str], **options) -> DataFrame:
    return df.select(number.cast("bigint").alias("row_number"), render.csv_line(df, columns, **options).alias("value"))


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_SPEC = [Field("o_orderkey", "long"), Field("o_custkey", "long"), Field("o_orderstatus"), Field("o_totalprice", "double"), Field("o_orderdate", "timestamp"), Field("o_orderpriority")]


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(lines_of(table(spark, sf_dir, "orders"), F.col("o_orderkey"), ORDERS))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def csv_roundtrip_orders(spark, sf_dir):
    rows = bind(order_cells(spark, sf_dir), ORDER_SPEC, ORDERS).rows
    return rows.withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.col("o_orderdate").cast("date")})


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS label FROM part")
def csv_quoted_fields(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"))
    return bind(split_lines(lines_of(part, F.col("p_partkey"), ["p_partkey", "label"])), [Field("p_partkey", "long"), Field("label")]).rows


@query("SELECT n_nationkey AS row_number, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_datareader_strings(spark, sf_dir):
    columns = ["n_nationkey", "n_name", "n_regionkey"]
    return data_reader(split_lines(lines_of(table(spark, sf_dir, "nation"), F.col("n_nationkey"), columns)), columns, 3).withColumn("row_number", F.col("row_number").cast("int"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS c_acctbal FROM customer")
def csv_null_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "NULL").otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    rows = bind(split_lines(lines_of(c, F.col("c_custkey"), c.columns)), [Field("c_custkey", "long"), Field("c_name"), Field("c_acctbal", "double")], nulls=["NULL", "N/A"]).rows
    return rows.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_missing_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lines = c.select(F.col("c_custkey").alias("row_number"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat_ws(",", "c_custkey", "c_mktsegment")).alias("value"))
    return bind(split_lines(lines), [Field("c_custkey", "long"), Field("c_mktsegment")], allow_missing=True).rows


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 NOT IN (0, 1)")
def csv_comments_blank_lines(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    value = F.when(k == 0, F.concat(F.lit(" \t# "), "c_name")).when(k == 1, "").otherwise(F.concat_ws(",", "c_custkey", "c_name"))
    rows = split_lines(c.select(F.col("c_custkey").alias("row_number"), value.alias("value")), Dialect(comment="#"))
    return bind(rows, [Field("c_custkey", "long"), Field("c_name")]).rows


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3")
def csv_skip_rows(spark, sf_dir):
    n = combine.numbered(table(spark, sf_dir, "nation"), "n_nationkey")
    rows = split_lines(lines_of(n, F.col("row_number"), ["n_nationkey", "n_name"])).where("row_number > 3")
    return bind(rows, [Field("n_nationkey", "int"), Field("n_name")]).rows


@query("SELECT n_nationkey, n_name FROM nation")
def csv_strict_source(spark, sf_dir):
    """The character-by-character reader on whole texts: one for each region, with breaks within quotes."""
    n = table(spark, sf_dir, "nation")
    texts = n.groupBy("n_regionkey").agg(F.concat_ws("\r\n", F.array_sort(F.collect_list(F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('\n"'))))).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for x in b.column("text").to_pylist() for _, _, r in parse_text(x, Dialect(newlines_in_quotes=True))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["row_number", "cells"])

    cells = texts.select("text").mapInArrow(run, "row_number bigint, cells array<string>")
    return bind(cells, [Field("n_nationkey", "int"), Field("n_name", converter=lambda c: F.rtrim(F.replace(s.unquote(c), F.lit("\n"), F.lit(" "))))]).rows


@query("""SELECT l_orderkey AS k_long, l_linenumber AS k_int, l_quantity AS k_double, CAST(l_extendedprice AS DECIMAL(18,2)) AS k_decimal, l_returnflag = 'R' AS k_bool,
CAST(l_shipdate AS DATE) AS k_date, CASE l_linestatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Final' END AS k_enum, CASE WHEN l_linenumber <= 5 THEN l_linenumber * 50 END AS k_byte FROM lineitem""")
def bind_scalar_types(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("false").alias("flag"), F.date_format("l_shipdate", "MM/dd/yyyy").alias("d"), F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("final").alias("e"), F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber") * 50).alias("b"))
    spec = [Field("k_long", "long"), Field("k_int", "int"), Field("k_double", "double"), Field("k_decimal", "decimal", options={"precision": 18, "scale": 2}), Field("k_bool", "bool"), Field("k_date", "date", options={"format": "MM/dd/yyyy"}), Field("k_enum", "enum", options={"names": ["Open", "Final"]}), Field("k_byte", converter=lambda c: s.parse_int(c, "byte").cast("int"))]
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return bind(split_lines(lines_of(t, number, t.columns)), spec).rows


@query("SELECT k, CASE k WHEN 0 THEN 1234.5 WHEN 1 THEN -12.5 WHEN 3 THEN 7.0 END::DECIMAL(18,2) AS v, k IN (4, 5) AS truth FROM (SELECT n_nationkey AS k FROM nation)")
def parse_edge_cases(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ["1,234.5", "12.5-", "1e3", " 7 ", "TRUE", "true", "yes", ""])), F.least(F.col("n_nationkey"), F.lit(7)) + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), s.parse_decimal(text, 18, 2).alias("v"), F.coalesce(s.parse_bool(text), F.lit(False)).alias("truth"))


RULE_SPEC = [Field("o_orderkey", "long", rules=Rules(not_null=True)), Field("o_orderpriority", rules=Rules(not_empty=True, max_length=8)), Field("o_totalprice", "double", rules=Rules(low=50000, high=300000)), Field("o_orderstatus", rules=Rules(pattern="^[FO]$"))]
RULE_COLUMNS = [f.name for f in RULE_SPEC]


def _checked(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderpriority")))
    return bind(split_lines(lines_of(o, F.col("o_orderkey"), RULE_COLUMNS)), RULE_SPEC, RULE_COLUMNS, keep=["row_number"])


_ERRORS = """SELECT o_orderkey AS row_number, 1 AS column_index, 'o_orderpriority' AS property_name, 'NotEmpty' AS rule, 'Value must not be empty' AS message, '' AS raw_value FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 1, 'o_orderpriority', 'MaxLength', 'Length must be at most 8', o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0 AND length(o_orderpriority) > 8
UNION ALL SELECT o_orderkey, 2, 'o_totalprice', 'RangeMin', 'Value must be at least 50000', o_totalprice::VARCHAR FROM orders WHERE o_totalprice < 50000
UNION ALL SELECT o_orderkey, 2, 'o_totalprice', 'RangeMax', 'Value must be at most 300000', o_totalprice::VARCHAR FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT o_orderkey, 3, 'o_orderstatus', 'Pattern', 'Value does not match the pattern', o_orderstatus FROM orders WHERE NOT regexp_matches(o_orderstatus, '^[FO]$')"""


@query(_ERRORS)
def validate_field_rules(spark, sf_dir):
    return _checked(spark, sf_dir).errors.drop("column_name")


@query(f"SELECT rule, count(*) AS n FROM ({_ERRORS}) GROUP BY rule")
def validate_errors_by_rule(spark, sf_dir):
    return _checked(spark, sf_dir).errors.groupBy("rule").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT row_number FROM ({_ERRORS}))")
def validate_lenient_rows(spark, sf_dir):
    return _checked(spark, sf_dir).policy("skip").select("o_orderkey")


@query(f"SELECT row_number, (list(rule ORDER BY column_index, rule))[1] AS rule, min(column_index) AS column_index FROM ({_ERRORS}) GROUP BY row_number")
def validate_first_error(spark, sf_dir):
    return first_error_only(_checked(spark, sf_dir).errors).select("row_number", "rule", "column_index")


@query("SELECT o_orderkey AS row_number, 'above 300000' AS message FROM orders WHERE o_totalprice > 300000")
def validate_short_messages(spark, sf_dir):
    spec = [Field("o_orderkey", "long"), Field("o_totalprice", "double", rules=Rules(high=300000))]
    rows = split_lines(lines_of(table(spark, sf_dir, "orders"), F.col("o_orderkey"), ["o_orderkey", "o_totalprice"]))
    return bind(rows, spec, messages="short").errors.select("row_number", "message")


@query("SELECT o_orderkey AS row_number, 'RangeMax' AS rule FROM orders WHERE o_totalprice > 300000")
def validate_on_write(spark, sf_dir):
    return validate_values(table(spark, sf_dir, "orders"), [Field("o_totalprice", rules=Rules(high=300000))], "o_orderkey").select("row_number", "rule")


@query("""SELECT 'MissingHeader' AS error_type, 1::BIGINT AS row_number, 'population' AS expected, NULL::VARCHAR AS actual
UNION ALL SELECT 'InconsistentColumnCount', n_nationkey::BIGINT + 1, '3', CASE WHEN n_nationkey % 5 = 0 THEN '2' ELSE '4' END FROM nation WHERE n_nationkey % 5 IN (0, 1)""")
def validate_structure(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 5
    value = F.when(k == 0, F.concat_ws(",", "n_nationkey", "n_name")).when(k == 1, F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey", F.lit("x"))).otherwise(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey"))
    rows = split_lines(n.select((F.col("n_nationkey") + 1).alias("row_number"), value.alias("value")))
    return profile.structure_errors(rows, ["n_nationkey", "n_name", "n_regionkey"], ["N_NAME", "population"]).drop("message")


_RISKY = "CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' WHEN 3 THEN '+1' ELSE '' END || p_name"
_BAD = "p_partkey % 6 IN (0, 1, 2)"


def _risky(spark, sf_dir):
    k = F.col("p_partkey") % 6
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(k == 0, "=").when(k == 1, "-").when(k == 2, "@").when(k == 3, "+1").otherwise(""), "p_name").alias("name"))


@query(f"SELECT p_partkey, {_BAD} AS dangerous FROM part")
def injection_scan(spark, sf_dir):
    return _risky(spark, sf_dir).select("p_partkey", s.dangerous(F.col("name")).alias("dangerous"))


@query(f"SELECT p_partkey, CASE WHEN {_BAD} THEN '\"''' || {_RISKY} || '\"' ELSE {_RISKY} END AS cell FROM part")
def injection_escape(spark, sf_dir):
    return _risky(spark, sf_dir).select("p_partkey", render.csv_cell(F.col("name")).alias("cell"))


@query(f"SELECT p_partkey, CASE WHEN {_BAD} THEN p_name ELSE {_RISKY} END AS cell FROM part")
def injection_sanitize(spark, sf_dir):
    return _risky(spark, sf_dir).select("p_partkey", render.csv_cell(F.col("name"), protection="sanitize").alias("cell"))


@query(f"SELECT p_partkey, '\"' || CASE WHEN {_BAD} THEN chr(9) ELSE '' END || {_RISKY} || '\"' AS cell FROM part")
def injection_escape_tab_always(spark, sf_dir):
    return _risky(spark, sf_dir).select("p_partkey", render.csv_cell(F.col("name"), style="always", protection="escape_tab").alias("cell"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def first_by_order(spark, sf_dir):
    return combine.first(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query('SELECT count(*) FILTER (o_totalprice > 200000) AS n, bool_or(o_totalprice > 200000) AS "any", bool_and(o_totalprice > 200000) AS "all" FROM orders')
def count_any_all(spark, sf_dir):
    return combine.quantifiers(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 200000)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")
def skip_take(spark, sf_dir):
    return combine.take(combine.skip(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5), "o_orderkey", 7)


@query("SELECT event_id AS k, event_type AS v FROM events")
def to_dictionary(spark, sf_dir):
    return combine.dictionary(table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def to_dictionary_dups(spark, sf_dir):
    return combine.duplicate_keys(table(spark, sf_dir, "orders"), F.col("o_custkey")).withColumnRenamed("key", "k")


@query("SELECT o_custkey AS k, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def group_by_lists(spark, sf_dir):
    return combine.group_lists(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey").cast("string"), "o_orderkey").select(F.col("key").alias("k"), F.array_join("values", " ").alias("keys"))


@query("SELECT (rn - 1) // 64 AS batch, count(*) AS n, min(event_id) AS first_id, max_by(event_type, event_id) AS last_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def batch_fixed_size(spark, sf_dir):
    e = combine.numbered(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return combine.batches(e, "row_number", 64, F.struct("event_id", "event_type")).select("batch", F.col("n").cast("bigint").alias("n"), F.element_at("values", 1)["event_id"].alias("first_id"), F.element_at("values", -1)["event_type"].alias("last_type"))


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS row_number FROM events")
def row_numbers(spark, sf_dir):
    return combine.numbered(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select("event_id", "event_type", F.col("row_number").cast("bigint").alias("row_number"))


@query("""WITH c AS (SELECT unnest([',', ';', '|', chr(9)]) AS delimiter), r AS (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10),
x AS (SELECT delimiter, concat_ws(delimiter, n_nationkey, n_name, n_regionkey) AS line FROM c, r), y AS (SELECT delimiter, (length(line) - length(replace(line, delimiter, '')))::DOUBLE AS n FROM x)
SELECT delimiter, greatest(0, least(100, 100 - trunc(100 * stddev_pop(n) / avg(n))::INT)) AS confidence FROM y GROUP BY delimiter""")
def detect_delimiter(spark, sf_dir):
    n, out = table(spark, sf_dir, "nation"), []
    for d in profile.CANDIDATES:
        lines = lines_of(n, F.col("n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"], delimiter=d)
        out.append(profile.delimiter_scores(lines).orderBy(F.desc("score"), "rank").limit(1).select("delimiter", "confidence"))
    return profile._union(out)


def _inferred(columns: list[str]) -> str:
    """The types that the first hundred texts of typed columns have, by patterns."""
    kind = "CASE WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+$')) THEN CASE WHEN max(abs(TRY_CAST(v AS HUGEINT))) < 2147483648 THEN 'Integer' ELSE 'Long' END WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+([.][0-9]+)?$')) THEN 'Decimal' WHEN bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9:]+)?$')) THEN 'DateTime' ELSE 'String' END"
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {kind} AS type, bool_or(coalesce(v, '') = '') AS nullable, max(length(v))::INT AS max_length FROM (SELECT {c}::VARCHAR AS v FROM orders ORDER BY o_orderkey LIMIT 100)" for c in columns)


@query(_inferred(ORDERS))
def infer_schema(spark, sf_dir):
    rows = data_reader(order_cells(spark, sf_dir), ORDERS, len(ORDERS)).orderBy("row_number").limit(100)
    return profile.infer_schema(rows, ORDERS)


@query("""SELECT * FROM (VALUES ('ints', 'Integer', true), ('mixed', 'String', false), ('numbers', 'Decimal', false), ('big', 'Long', false), ('flags', 'Boolean', false), ('none', 'String', true)) t(name, type, nullable)""")
def infer_schema_mixed(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.when(k != 2, k.cast("string")).otherwise("").alias("ints"), F.when(k < 5, k.cast("string")).otherwise("true").alias("mixed"), F.when(k < 5, k.cast("string")).otherwise("1.5").alias("numbers"), F.when(k < 5, k.cast("string")).otherwise("9999999999").alias("big"), F.when(k < 5, "true").otherwise("FALSE").alias("flags"), F.lit("").alias("none"))
    return profile.infer_schema(rows, rows.columns).drop("max_length")


@query("""SELECT 'c_acctbal' AS name, 'number' AS kind, count(*) AS rows, count(c_acctbal) AS filled, min(c_acctbal)::DECIMAL(18,2) AS low, max(c_acctbal)::DECIMAL(18,2) AS high, NULL::BIGINT AS "distinct" FROM customer
UNION ALL SELECT 'c_mktsegment', 'text', count(*), count(c_mktsegment), NULL, NULL, count(DISTINCT lower(c_mktsegment)) FROM customer""")
def profile_typed(spark, sf_dir):
    p = profile.profile_records(table(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"])
    return p.select("name", "kind", "rows", "filled", F.col("low").cast("decimal(18,2)").alias("low"), F.col("high").cast("decimal(18,2)").alias("high"), "distinct")


@query("""SELECT 'l_linenumber' AS name, count(*) AS rows, 'int' AS kind, min(l_linenumber)::DOUBLE AS low, max(l_linenumber)::DOUBLE AS high FROM lineitem
UNION ALL SELECT 'l_quantity', count(*), 'double', min(l_quantity), max(l_quantity) FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), 'string', NULL, NULL FROM lineitem""")
def profile_untyped(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_number"), F.col("l_linenumber").cast("string").alias("l_linenumber"), F.col("l_quantity").cast("string").alias("l_quantity"), "l_returnflag")
    return profile.profile_text(text, ["l_linenumber", "l_quantity", "l_returnflag"], "row_number").select("name", "rows", "kind", "low", "high")


@query("""SELECT 0 AS line_no, '### Dataset Profile: nation' AS line UNION ALL SELECT 1, '- **n_name**: 25 distinct (100.0% filled)' FROM (SELECT count(DISTINCT lower(n_name)) AS c FROM nation) WHERE c = 25
UNION ALL SELECT 2, '- **n_nationkey**: range 0.00 to 24.00, mean 12.00 (100.0% filled)'""")
def profile_card(spark, sf_dir):
    return profile.card(profile.profile_records(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"]), "nation")


@query("SELECT c_mktsegment AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 1)::DOUBLE AS percent FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT name FROM (SELECT 'c_custkey' AS name, count(c_custkey) AS n FROM customer UNION ALL SELECT 'c_name', count(nullif(c_name, '')) FROM customer) WHERE n > 0")
def drop_empty_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("").alias("fax"), F.lit(None).cast("string").alias("phone"))
    return spark.createDataFrame([(x,) for x in profile.filled_columns(c)], "name string")


SUPPLIER = [render.Slot("s_suppkey", 8, "right"), render.Slot("s_name", 24), render.Slot("s_acctbal", 12, "right")]
_FIXED = "lpad(CAST(s_suppkey AS VARCHAR), 8, ' ') || rpad(s_name, 24, ' ') || lpad(CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR), 12, ' ')"


def _fixed(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("decimal(12,2)"))
    return sup.select(F.col("s_suppkey").alias("row_number"), render.fixed_line(sup, SUPPLIER).alias("value"))


@query(f"SELECT s_suppkey AS row_number, {_FIXED} AS value FROM supplier")
def fixed_width_write(spark, sf_dir):
    return _fixed(spark, sf_dir)


@query("SELECT s_suppkey, s_name, CAST(s_acctbal AS DECIMAL(12,2)) AS s_acctbal FROM supplier")
def fixed_width_read(spark, sf_dir):
    spec = [Field("s_suppkey", "long"), Field("s_name"), Field("s_acctbal", "decimal", options={"precision": 12, "scale": 2})]
    return bind(render.read_fixed(_fixed(spark, sf_dir), SUPPLIER), spec).rows


@query("SELECT s_suppkey, right(s_name, 6) AS tail, left(s_name, 6) AS head FROM supplier")
def fixed_width_overflow(spark, sf_dir):
    slot = render.Slot("s_name", 6, "right")
    return table(spark, sf_dir, "supplier").select("s_suppkey", render.fit(F.col("s_name"), slot, keep_right=True).alias("tail"), render.fit(F.col("s_name"), slot).alias("head"))


@query("SELECT s_suppkey AS row_number, s_suppkey || ',' || s_name || ',' || CAST(s_acctbal AS DECIMAL(12,2)) AS value FROM supplier")
def fixed_width_to_csv(spark, sf_dir):
    return render.fixed_to_csv(_fixed(spark, sf_dir), SUPPLIER)


@query("SELECT c_custkey AS row_number, rpad(c_name, 20, ' ') || lpad(c_mktsegment, 12, ' ') || '     ' AS value FROM customer")
def csv_to_fixed_width(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cells = split_lines(lines_of(c, F.col("c_custkey"), ["c_name", "c_mktsegment"]))
    return render.csv_to_fixed(cells, ["C_NAME ", "c_mktsegment"], [render.Slot("c_name", 20), render.Slot("c_mktsegment", 12, "right"), render.Slot("phone", 5)])


@query("SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def jsonl_flat(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.col("n_nationkey").alias("k"), render.flat_json(n.select("n_nationkey", "n_name")).alias("value"))
    return render.json_cells(lines, {"id": "n_nationkey", "name": "n_name"}, order="k")


@query("""SELECT u.conv_id, CASE WHEN u.conv_id % 2 = 0 THEN 3 ELSE 2 END AS n, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def jsonl_chat_shape(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u, a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    line = render.chat_json(F.col("q"), F.col("a"), F.when(F.col("conv_id") % 2 == 0, "Be brief."))
    parsed = u.join(a, ["conv_id", "turn"]).select("conv_id", F.from_json(line, "messages array<struct<role string, content string>>").alias("x"))
    n = F.size("x.messages")
    return parsed.select("conv_id", n.alias("n"), F.element_at("x.messages", n - 1)["content"].alias("question"), F.element_at("x.messages", -1)["content"].alias("answer"))


def _events_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_id", F.struct(F.col("event_type").alias("kind"), F.array(F.col("user_id"), F.col("event_id")).alias("ids")).alias("what"), F.when(F.col("event_id") % 3 == 0, F.lit("x")).alias("extra")))
    return e.select(F.col("event_id").alias("row_number"), body.alias("value"))


@query("SELECT event_id AS row_number, event_type AS kind, CAST(user_id AS VARCHAR) AS first_id, CASE WHEN event_id % 3 = 0 THEN 'x' END AS extra FROM events")
def jsonl_paths(spark, sf_dir):
    return render.json_cells(_events_json(spark, sf_dir), {"kind": "what.kind", "first_id": "what.ids[0]", "extra": "extra"})


@query("SELECT event_id, event_type AS kind FROM events")
def jsonl_typed(spark, sf_dir):
    rows = render.read_json(_events_json(spark, sf_dir), "event_id bigint, what struct<kind:string>")
    return rows.select("event_id", F.col("what.kind").alias("kind"))


@query("SELECT * FROM (VALUES (0, 'event_id'), (1, 'what'), (2, 'extra')) t(place, name)")
def jsonl_column_union(spark, sf_dir):
    names = render.json_columns(_events_json(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


@query("SELECT n_nationkey AS row_number, n_nationkey || ',' || n_name AS value FROM nation")
def jsonl_to_csv(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.col("n_nationkey").alias("row_number"), F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    return render.json_to_csv(lines)[1]


ROUTES = {"H": [Field("file_id", index=1), Field("day", "date", index=2)], "D": [Field("item", index=1), Field("amount", "decimal", index=2, options={"precision": 18, "scale": 2}), Field("flag", index=3)], "T": [Field("n", "int", index=1), Field("total", "decimal", index=2, options={"precision": 18, "scale": 2})]}


def _mixed(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    head = o.select((F.col("o_orderkey") * 10).alias("row_number"), F.concat_ws(",", F.lit("H"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("value"))
    body = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"), F.concat_ws(",", F.lit("D"), "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)"), "l_returnflag").alias("value"))
    tail = o.select((F.col("o_orderkey") * 10 + 9).alias("row_number"), F.concat_ws(",", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise("T"), F.lit(1), F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))
    return split_lines(head.unionByName(body).unionByName(tail))


@query("""SELECT o_orderkey * 10 AS row_number, 'H' AS tag, CAST(o_orderkey AS VARCHAR) AS id, NULL::DECIMAL(18,2) AS amount FROM orders
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'D', CAST(l_partkey AS VARCHAR), CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem
UNION ALL SELECT o_orderkey * 10 + 9, 'T', '1', CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 9 <> 0""")
def multi_schema_route(spark, sf_dir):
    rows = Routed(_mixed(spark, sf_dir), 0, ROUTES).together()
    return rows.select("row_number", "tag", F.coalesce("H.file_id", "D.item", F.col("T.n").cast("string")).alias("id"), F.coalesce("D.amount", "T.total").alias("amount"))


@query("SELECT 'X' AS tag, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 HAVING count(*) > 0")
def multi_schema_unmatched(spark, sf_dir):
    return tag_counts(Routed(_mixed(spark, sf_dir), 0, ROUTES).unmatched(), F.element_at("cells", 1))


@query("""WITH r AS (SELECT o_orderkey AS pos, o_orderstatus AS value FROM orders), g AS (SELECT pos, value, CASE WHEN lag(value) OVER (ORDER BY pos) IS DISTINCT FROM value THEN 1 ELSE 0 END AS c FROM r), x AS (SELECT pos, value, sum(c) OVER (ORDER BY pos) AS run FROM g)
SELECT value, min(pos) AS first_row, max(pos) AS last_row FROM x GROUP BY run, value HAVING count(*) > 1""")
def merge_duplicates(spark, sf_dir):
    return render.merge_duplicates(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) + 0.0 AS total FROM embeddings")
def vector_parse(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    text = F.concat(F.lit("[ "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), "; "), F.lit(" ]"))
    v = s.parse_vector(text)
    return e.select("vec_id", F.size(v).alias("n"), (F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0).alias("total"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN 'say ' || chr(34) || n_name || chr(34) || chr(10) WHEN 3 THEN n_name ELSE '' END AS fixed FROM nation")
def repair_text(spark, sf_dir):
    k, name = F.col("n_nationkey") % 5, F.col("n_name")
    text = F.when(k == 0, F.concat(F.lit("here:\n```json\n"), name, F.lit("\n```\nmore"))).when(k == 1, F.concat(F.lit("  "), name, F.lit("\\"))).when(k == 2, F.concat(F.lit('say "'), name)).when(k == 3, F.concat(F.lit("```\n"), name)).otherwise("   ")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), chunk.repair_text(text).alias("fixed"))


def _fold(text: str, head: str = "", name: str = "n_regionkey", order: str = "n_nationkey", source: str = "nation", budget: int = 24) -> str:
    size, first = f"ceil((length({text}) + 1) / 4.0)::BIGINT", -(-len(head) // 4)
    return f"""WITH RECURSIVE t AS (SELECT {name} AS g, row_number() OVER (PARTITION BY {name} ORDER BY {order}) AS rn, {size} AS sz, {text} AS txt FROM {source}),
f AS (SELECT g, rn, sz, 1 AS chunk_no, {first} + sz AS cur, rn AS start, txt FROM t WHERE rn = 1
UNION ALL SELECT t.g, t.rn, t.sz, CASE WHEN f.cur + t.sz > {budget} THEN f.chunk_no + 1 ELSE f.chunk_no END, CASE WHEN f.cur + t.sz > {budget} THEN {first} + t.sz ELSE f.cur + t.sz END, CASE WHEN f.cur + t.sz > {budget} THEN t.rn ELSE f.start END, t.txt FROM f JOIN t ON t.g = f.g AND t.rn = f.rn + 1)
SELECT g AS {name}, chunk_no, min(start)::BIGINT AS start_row, max(rn)::BIGINT AS end_row, max(cur)::BIGINT AS token_count, md5({head!r} || string_agg(txt, chr(10) ORDER BY rn)) AS digest FROM f GROUP BY g, chunk_no"""


def _digested(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("digest", F.md5(F.col("content").cast("binary"))).drop("content")


@query(_fold("'| ' || n_nationkey || ' | ' || n_name || ' |'", "| n_nationkey | n_name |\n| --- | --- |\n").replace("'| n_nationkey | n_name |\\n| --- | --- |\\n'", "'| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10)"))
def chunk_markdown(spark, sf_dir):
    return _digested(chunk.markdown_chunks(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], "n_nationkey", ["n_regionkey"], 24))


@query(_fold("'Document ' || doc_id || ' {unknown} ' || text", name="source", order="doc_id", source="documents", budget=4000))
def chunk_template(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = chunk.template_row("Document {DOC_ID} {unknown} {text}", {c: F.col(c) for c in ("doc_id", "text")})
    return _digested(chunk.chunks(d, text, "doc_id", ["source"], 4000))


@query("SELECT n_regionkey, sum(length(n_name))::BIGINT AS chars, count(*) AS rows FROM nation GROUP BY n_regionkey")
def chunk_json(spark, sf_dir):
    c = chunk.json_chunks(table(spark, sf_dir, "nation"), ["n_name"], "n_nationkey", ["n_regionkey"], 30)
    rows = c.select("n_regionkey", F.explode(F.from_json("content", "array<struct<n_name:string>>")).alias("r"))
    return rows.groupBy("n_regionkey").agg(F.sum(F.length("r.n_name")).alias("chars"), F.count("*").alias("rows"))


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def embedding_batches(spark, sf_dir):
    d = chunk.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda texts: [[float(len(x)), 1.0] for x in texts])
    return d.select("doc_id", F.element_at("embedding", 1).cast("bigint").alias("n"))


@query("SELECT event_id AS row_number, event_type AS kind, user_id AS owner FROM events WHERE user_id >= 10 AND event_id % 4 <> 0")
def tool_arguments_rows(spark, sf_dir):
    return _tools(spark, sf_dir).rows


@query("SELECT event_id AS row_number, CASE WHEN event_id % 4 = 0 THEN 'NotNull' ELSE 'RangeMin' END AS rule FROM events WHERE event_id % 4 = 0 OR user_id < 10")
def tool_arguments_errors(spark, sf_dir):
    return _tools(spark, sf_dir).errors.select("row_number", "rule")


def _tools(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_id").alias("row_number"), F.to_json(F.struct(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("KIND"), F.col("user_id").alias("Owner"))).alias("arguments"))
    return tool_arguments(calls, [Field("kind", rules=Rules(not_null=True)), Field("owner", "long", rules=Rules(low=10))])


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) + 0.0 AS total FROM embeddings")
def packed_roundtrip(spark, sf_dir):
    back = packed.unpacked(packed.packed(table(spark, sf_dir, "embeddings")), "vec_id bigint, label int, embedding array<float>")
    return back.select("vec_id", "label", (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0).alias("total"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate::DATE AS day FROM orders")
def packed_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(38,18)").alias("price"), F.col("o_orderdate").cast("timestamp_ntz").alias("day"))
    back = packed.unpacked(packed.packed(o), "o_orderkey bigint, price decimal(38,18), day timestamp_ntz")
    return back.select("o_orderkey", F.col("price").cast("decimal(18,2)").alias("price"), F.col("day").cast("date").alias("day"))


def _book(spark, sf_dir) -> DataFrame:
    """A workbook of the two smallest tables; sheets are bounded by the format."""
    data = packed.write_workbook({"nation": table(spark, sf_dir, "nation").orderBy("n_nationkey"), "region": table(spark, sf_dir, "region").orderBy("r_regionkey")})
    return spark.createDataFrame([(data,)], "content binary")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def xlsx_roundtrip(spark, sf_dir):
    rows = packed.read_workbooks(_book(spark, sf_dir)).where("row_number > 1")
    return bind(rows, [Field("n_nationkey", "int"), Field("n_name"), Field("n_regionkey", "int")]).rows


@query("SELECT 'nation' AS sheet, count(*) + 1 AS n FROM nation UNION ALL SELECT 'region', count(*) + 1 FROM region")
def xlsx_sheets(spark, sf_dir):
    return packed.read_workbooks(_book(spark, sf_dir), every=True).groupBy("sheet").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS k, strftime(DATE '2024-02-25' + n_nationkey, '%Y-%m-%dT00:00:00') AS day, CASE WHEN n_regionkey = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, (n_nationkey + 0.5)::DECIMAL(6,1)::VARCHAR AS number FROM nation")
def xlsx_dates(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.date_add(F.lit("2024-02-25").cast("date"), F.col("n_nationkey").cast("int")).alias("d"), (F.col("n_regionkey") == 0).alias("b"), (F.col("n_nationkey") + F.lit(0.5)).alias("x"))
    rows = packed.read_workbooks(spark.createDataFrame([(packed.write_workbook({"s": n}),)], "content binary"), "s").where("row_number > 1")
    return rows.select(*[F.element_at("cells", k + 1).alias(c) for k, c in enumerate(("k", "day", "flag", "number"))])


@query("SELECT 'n' AS kind, n_nationkey::INT AS k, n_name AS name FROM nation UNION ALL SELECT 'r', r_regionkey::INT, r_name FROM region")
def xlsx_sheets_of_types(spark, sf_dir):
    """Two sheets with a type of their own each; and the all-string form with a header."""
    book = packed.read_workbooks(_book(spark, sf_dir), every=True)
    nation = bind(packed.sheet_records(book, "nation"), [Field("k", "int"), Field("name")]).policy("throw").select(F.lit("n").alias("kind"), "k", "name")
    region = packed.sheet_records(book, "region", ["k", "name"]).select(F.lit("r").alias("kind"), F.col("k").cast("int").alias("k"), "name")
    return nation.unionByName(region)


@query("SELECT p_partkey, CASE WHEN " + _BAD + " THEN p_name ELSE " + _RISKY + " END AS name FROM part WHERE p_partkey <= 1048575")
def xlsx_sanitize(spark, sf_dir):
    """The keys run from 0, so these rows and a header are more than a sheet holds: a further workbook takes the rest."""
    files = packed.workbooks(_risky(spark, sf_dir).where("p_partkey <= 1048575"), "s", protection="sanitize")
    rows = packed.sheet_records(packed.read_workbooks(files), "s", ["p_partkey", "name"])
    return rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "name")


@query("SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal FROM customer")
def csv_to_packed_and_back(spark, sf_dir):
    cells = split_lines(lines_of(table(spark, sf_dir, "customer"), F.col("c_custkey"), ["c_custkey", "c_name", "c_acctbal"]))
    files = convert.convert("csv", "packed", cells, spec=[Field("c_custkey", "long"), Field("c_name"), Field("c_acctbal", "double")])
    lines = convert.convert("packed", "csv", files, schema="c_custkey bigint, c_name string, c_acctbal double")
    rows = split_lines(lines.withColumn("row_number", F.lit(1)))
    return bind(rows, [Field("c_custkey", "long"), Field("c_name"), Field("c_acctbal", "double")]).rows.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))


@query("SELECT n_nationkey + 2 AS row_number, n_nationkey || ',' || n_name || ',' || n_regionkey AS value FROM nation")
def xlsx_to_csv(spark, sf_dir):
    return convert.convert("xlsx", "csv", _book(spark, sf_dir)).where("row_number > 1").withColumn("row_number", F.col("row_number").cast("int"))


@query("SELECT c_custkey AS row_number, rpad(c_mktsegment, (SELECT greatest(5, max(length(c_mktsegment)) + 2) FROM customer)::INT, ' ') AS value FROM customer")
def csv_to_fixed_auto(spark, sf_dir):
    return convert.convert("csv", "txt", split_lines(lines_of(table(spark, sf_dir, "customer"), F.col("c_custkey"), ["c_mktsegment"])), header=["c_mktsegment"])


# Files in the shared folder


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def csv_file_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    render.write_csv(table(spark, sf_dir, "orders"), path, ORDERS)
    header, rows = read_csv(spark, path)
    rows = bind(rows, ORDER_SPEC, header).policy("throw")
    return rows.withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.col("o_orderdate").cast("date")})


@query("SELECT n_nationkey::INT AS n_nationkey, n_name || chr(10) || n_regionkey AS name FROM nation")
def csv_file_of_spanning_records(spark, sf_dir):
    """Files whose records span lines, each read whole by the quote-aware reader."""
    path = shared_folder(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n"), F.col("n_regionkey").cast("string")).alias("name"))
    render.write_csv(n, path)
    rows = read_files(spark, path, Dialect(newlines_in_quotes=True)).where("row_number > 1")
    return bind(rows, [Field("n_nationkey", "int"), Field("name")]).policy("throw")


@query("SELECT event_id, user_id, event_type FROM events")
def jsonl_file_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    convert.write_jsonl(table(spark, sf_dir, "events"), path, ["event_id", "user_id", "event_type"], max_rows=1 << 40)
    lines = spark.read.text(path).withColumn("row_number", F.monotonically_increasing_id())
    return render.read_json(lines, "event_id bigint, user_id bigint, event_type string").drop("row_number")


@query("SELECT s_suppkey, s_name, CAST(s_acctbal AS DECIMAL(12,2)) AS s_acctbal FROM supplier")
def fixed_width_file_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    _fixed(spark, sf_dir).select("value").write.text(path)
    lines = spark.read.text(path).withColumn("row_number", F.monotonically_increasing_id())
    spec = [Field("s_suppkey", "long"), Field("s_name"), Field("s_acctbal", "decimal", options={"precision": 12, "scale": 2})]
    return bind(render.read_fixed(lines, SUPPLIER), spec).policy("throw")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate::DATE AS day FROM orders")
def packed_file_roundtrip(spark, sf_dir):
    """Files of 5000 rows at most each."""
    path = shared_folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(38,18)").alias("price"), F.col("o_orderdate").cast("timestamp_ntz").alias("day"))
    packed.write_packed(o, path, max_rows=5000)
    back = packed.read_packed(spark, path, "o_orderkey bigint, price decimal(38,18), day timestamp_ntz", max_rows=5000)
    return back.select("o_orderkey", F.col("price").cast("decimal(18,2)").alias("price"), F.col("day").cast("date").alias("day"))


# Policies


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def jsonl_on_error_skip(spark, sf_dir):
    lines = _events_json(spark, sf_dir).withColumn("value", F.when(F.col("row_number") % 5 == 0, F.concat(F.lit("{"), "value")).otherwise(F.col("value")))
    return render.read_json(lines, "event_id bigint", strict=False).select("event_id")


@query(f"SELECT {_RISKY} AS value FROM part WHERE NOT ({_BAD})")
def csv_write_skip_row(spark, sf_dir):
    return render.write_rows(_risky(spark, sf_dir), ["name"], "skip_row")


@query(f"SELECT p_partkey || ',' || CASE WHEN {_BAD} THEN 'NULL' ELSE {_RISKY} END AS value FROM part")
def csv_write_null(spark, sf_dir):
    return render.write_rows(_risky(spark, sf_dir), ["p_partkey", "name"], "write_null", null="NULL")


@query("SELECT column_name AS name, data_type AS type FROM (VALUES ('n_nationkey', 'bigint'), ('n_name', 'string')) t(column_name, data_type)")
def schema_as_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    return schema_table(n).select("name", "type")
