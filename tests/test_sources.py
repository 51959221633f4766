import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from quillframe.functions import scalars as s
from quillframe.operators import chunk, combine, render
from quillframe.operators.records import Field, HeaderError, RowErrors, Rules, bind, json_schema
from quillframe.operators.route import Routed
from quillframe.sources import packed
from quillframe.sources.delimited import Dialect, ScanError, TextSource, check_width, decoded, parse_text, read_files, split_lines
from quillframe.streaming.tail import tail_records


def cells(text, **options):
    return [c for _, _, c in parse_text(text, Dialect(**options))]


def test_dialect():
    assert cells('a,"b,c",d\n\n"x""y",,\r\nlast\rend') == [["a", '"b,c"', "d"], ['"x""y"', "", ""], ["last"], ["end"]]
    assert cells("  # no\na#b", comment="#") == [["a#b"]]
    assert cells('ab"c,d"e,f') == [['ab"c,d"e', "f"]]
    assert cells("a\\,b,c", escape="\\") == [["a\\,b", "c"]]
    assert cells('a,"b', quote=None) == [["a", '"b']]
    assert cells(" ") == [[" "]] and cells("") == []
    assert cells('"a\nb",c', newlines_in_quotes=True) == [['"a\nb"', "c"]]
    for bad, options in (('a,"b', {}), ('"a\nb"', {}), ("a,b,c", {"max_columns": 2}), ("a\nb", {"max_rows": 1}), ("abcdef", {"max_row_size": 3}), ("abc", {"max_field_size": 2})):
        with pytest.raises(ScanError):
            cells(bad, **options)
    for options in ({"delimiter": "é"}, {"delimiter": '"'}, {"comment": ","}, {"max_columns": 0}):
        with pytest.raises(ScanError):
            Dialect(**options)
    assert decoded(b"\xef\xbb\xbfa") == "a"
    with pytest.raises(ScanError):
        decoded(b"\xff\xfea\0")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n\r;', max_size=6), min_size=2, max_size=4), min_size=1, max_size=4))
def test_written_cells_come_back(rows):
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows)
    back = [[x[1:-1].replace('""', '"') for x in c] for c in cells(text, newlines_in_quotes=True)]
    assert back == rows


def test_lines_and_reader_agree(spark):
    texts = ['a,"b,c",d', '"x""y",,', 'ab"c,d"e,f', "one", ",", ' "q" ,"r"']
    df = spark.createDataFrame(list(enumerate(texts, 1)), "row_number bigint, value string")
    for parts in (1, 8):
        got = {r.row_number: list(r.raw) for r in split_lines(df.repartition(parts)).collect()}
        assert got == {k: cells(t)[0] for k, t in enumerate(texts, 1)}
    with pytest.raises(PySparkException):
        split_lines(spark.createDataFrame([(1, 'a,"b')], "row_number bigint, value string")).collect()
    with pytest.raises(PySparkException):
        check_width(split_lines(df), 3).collect()


def test_files_and_data_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h,"x\ny"\n1,2\n')
    rows = read_files(spark, str(tmp_path / "a.csv"), Dialect(newlines_in_quotes=True)).orderBy("row_number").collect()
    assert [list(r.cells) for r in rows] == [["h", "x\ny"], ["1", "2"]] and rows[1].line_number == 3
    spark.dataSource.register(TextSource)
    got = spark.read.format("strictcsv").option("text", "a;b\n1;2").option("delimiter", ";").load().orderBy("row_number").collect()
    assert [list(r.cells) for r in got] == [["a", "b"], ["1", "2"]]


def test_scalars(spark):
    from pyspark.sql import functions as F

    def one(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v

    assert one(" 12", s.parse_int) is None and one("+12", s.parse_int) == 12 and one("3000000000", s.parse_int) is None
    assert one("1e3", s.parse_decimal) is None and float(one("1,234.5-", s.parse_decimal)) == -1234.5
    assert one("1d", s.parse_double) is None and one(" 1e3 ", s.parse_double) == 1000
    assert one("yes", s.parse_bool) is None and one("TRUE", s.parse_bool) is True
    assert one("[1; 2.5]", s.parse_vector) == [1.0, 2.5] and one("[]", s.parse_vector) == [] and one("[1,x]", s.parse_vector) is None
    assert one("1,5;2", lambda c: s.parse_vector(c, "double", True)) == [1.5, 2.0]
    assert one("😀", s.utf16_len) == 2 and one("-", s.dangerous) is False and one("-a", s.dangerous) and not one("-1", s.dangerous)
    assert one(None, s.dangerous) is False
    with pytest.raises(PySparkException):
        one("=1", lambda c: render.csv_cell(c, protection="reject"))


def test_binding(spark):
    rows = spark.createDataFrame([(1, ["7", "x"]), (2, ["q", "y"]), (3, ["8"]), (4, [None, "z"])], "row_number bigint, cells array<string>")
    spec = [Field("n", "int", rules=Rules(not_null=True)), Field("t")]
    b = bind(rows, spec, ["N", "T"])
    assert sorted(map(tuple, b.rows.collect())) == [(7, "x"), (8, None)]
    assert sorted((e.row_number, e.rule) for e in b.errors.collect()) == [(2, "Parse"), (4, "NotNull")]
    with pytest.raises(RowErrors):
        b.strict()
    with pytest.raises(HeaderError):
        bind(rows, spec, ["other"])
    assert json_schema(spec) == {"type": "object", "properties": {"n": {"type": "integer"}, "t": {"type": "string"}}, "required": ["n"]}
    with pytest.raises(PySparkException):
        Routed(rows, 1, {"x": [Field("n", "int", index=0)]}, unmatched="throw").of("x").rows.collect()


def test_verbs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    assert combine.single(df.where("k = 1")).v == "a" and combine.single(df.where("k = 9"), default=True) is None
    for call in (lambda: combine.single(df), lambda: combine.first_or_fail(df, "k", df.k == 9), lambda: combine.batches(df, "k", 0, df.v)):
        with pytest.raises((LookupError, ValueError)):
            call()
    assert combine.quantifiers(df.limit(0), df.k > 0).first().asDict() == {"n": 0, "any": False, "all": True}
    with pytest.raises(PySparkException):
        combine.dictionary(df, df.k * 0, df.v).collect()


def test_packed_and_workbook(spark):
    with pytest.raises(packed.FormatError):
        packed.decode(b"nope")
    data = b"".join(packed.encode([("a", 1), ("g", 9), ("s", 8)], iter([(1, "00112233-4455-6677-8899-aabbccddeeff", "é"), (None, None, None)])))
    columns, rows = packed.decode(data)
    assert columns == [("a", 1), ("g", 9), ("s", 8)] and list(rows) == [[1, "00112233-4455-6677-8899-aabbccddeeff", "é"], [None, None, None]]
    with pytest.raises(packed.FormatError):
        list(packed.decode(data[:-2])[1])
    book = packed.workbook({"a": (["x", "y"], [["=1", None], [2, "z"]]), "b": (["q"], [])}, {"a": ["A1:B1"]})
    assert list(packed.sheet_rows(book)) == [(1, ["x", "y"]), (2, ["'=1"]), (3, ["2", "z"])] and list(packed.sheets(book)) == ["a", "b"]
    assert packed.is_date_code("yyyy-mm") and not packed.is_date_code('0.0"d"')


def test_render_and_chunks(spark):
    render.check_layout([("a", 0, 3), ("b", 3, 2)])
    with pytest.raises(ValueError):
        render.check_layout([("a", 0, 3), ("b", 2, 2)])
    df = spark.createDataFrame([(1, "ab"), (2, None)], "k bigint, v string")
    from pyspark.sql import functions as F

    slot = render.Slot("v", 5, "center", "*")
    assert [r[0] for r in df.orderBy("k").select(render.fit(F.col("v"), slot)).collect()] == ["*ab**", "*****"]
    with pytest.raises(ValueError):
        render.check_limits(df, F.col("v"), max_rows=1)
    one = chunk.markdown_chunks(df, ["k", "v"], "k", budget=1).orderBy("chunk_no").collect()
    assert [(c.start_row, c.end_row) for c in one] == [(1, 1), (2, 2)] and one[0].content.endswith("| 1 | ab |")


def test_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('1,"x,y"\n2,z\n')
    q = tail_records(spark, str(tmp_path / "in"), [Field("n", "int"), Field("t")]).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tailed").collect())) == [(1, "x,y"), (2, "z")]


def test_row_numbers_at_size(spark):
    from pyspark.sql import functions as F

    df = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_003).alias("k"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("more"))
    got = combine.numbered(df, "k", parts=16)
    one = got.agg(F.count("*"), F.count_distinct("row_number"), F.min("row_number"), F.max("row_number")).first()
    assert tuple(one) == (2_000_000, 2_000_000, 1, 2_000_000)
    from pyspark.sql import Window

    low = got.where("row_number <= 1000").withColumn("want", F.row_number().over(Window.orderBy("k")))
    assert low.where("want <> row_number").count() == 0 and low.count() == 1000
    assert combine.numbered(df.limit(0), "k").collect() == []


def test_limits_and_open_quotes(spark):
    def lines(*texts):
        return spark.createDataFrame(list(enumerate(texts, 1)), "row_number bigint, value string")

    for d, texts in ((Dialect(escape="\\"), ['a,"b,c']), (Dialect(max_rows=1), ["a", "b"])):
        with pytest.raises(PySparkException):
            split_lines(lines(*texts), d).collect()
    assert [r.cells for r in split_lines(lines('a\\",b'), Dialect(escape="\\")).collect()] == [['a\\"', "b"]]
    assert split_lines(lines("a", "b"), Dialect(max_rows=2)).count() == 2
    with pytest.raises(ScanError):
        list(parse_text("abc", Dialect(max_input_size=2)))
    json = lines('{"a": 1}', '{"a": 2}', "", '{"a"')
    assert [r.a for r in render.read_json(json, "a int", strict=False, skip_rows=1).collect()] == [2]
    with pytest.raises(PySparkException):
        render.read_json(json, "a int", strict=False, max_rows=2).collect()


def test_policies(spark):
    rows = spark.createDataFrame([(1, ["7"]), (2, ["q"])], "row_number bigint, cells array<string>")
    b = bind(rows, [Field("n", "int")])
    assert [r.n for r in b.policy("skip").collect()] == [7]
    with pytest.raises(PySparkException, match="row 2"):
        b.policy("throw").collect()
    df = spark.createDataFrame([("=1", "a"), ("b", None), ("c", "long text")], "x string, y string")
    got = {k: [r.value for r in render.write_rows(df, ["x", "y"], k, max_field=4, null="NULL").collect()] for k in ("skip_row", "write_null")}
    assert got == {"skip_row": ["b,NULL"], "write_null": ["NULL,a", "b,NULL", "c,NULL"]}
    with pytest.raises(PySparkException):
        render.write_rows(df, ["x", "y"]).collect()


def test_hostile_workbooks(spark):
    import io
    import zipfile

    book = packed.workbook({"a": (["x"], [["1"]])})

    def changed(name, change):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(book)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            for i in z.namelist():
                w.writestr(i, change(z.read(i)) if i == name else z.read(i))
        return out.getvalue()

    late = b"<!--" + b"x" * 10_000 + b"-->" + b'<!DOCTYPE w [<!ENTITY e "v">]>'
    for name in ("xl/workbook.xml", "xl/worksheets/sheet1.xml"):
        with pytest.raises(packed.FormatError, match="document type"):
            list(packed.sheet_rows(changed(name, lambda x: x.replace(b'<?xml version="1.0"?>', b'<?xml version="1.0"?>' + late))))
        with pytest.raises(packed.FormatError, match="document type"):
            list(packed.sheet_rows(changed(name, lambda x: x.decode().replace('<?xml version="1.0"?>', '<?xml version="1.0" encoding="UTF-16"?>' + late.decode()).encode("utf-16"))))
    with pytest.raises(packed.FormatError, match="too large"):
        list(packed.sheet_rows(changed("xl/worksheets/sheet1.xml", lambda x: b" " * (3 << 20) + x)))
    for how, want in (("escape", "'=1"), ("sanitize", "1"), ("none", "=1")):
        assert list(packed.sheet_rows(packed.workbook({"a": (["=1"], [])}, protection=how))) == [(1, [want])]
    with pytest.raises(packed.FormatError):
        packed.workbook({"a": (["=1"], [])}, protection="reject")


def test_packed_files_cut_off(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "k bigint, v string").repartition(2)
    packed.write_packed(df, str(tmp_path / "p"), max_rows=10)
    names = sorted(x.name for x in (tmp_path / "p").iterdir())
    assert len(names) >= 3 and packed.read_packed(spark, str(tmp_path / "p"), "k bigint, v string").count() == 25
    first = tmp_path / "p" / names[0]
    first.write_bytes(first.read_bytes()[:-2])
    with pytest.raises(PySparkException):
        packed.read_packed(spark, str(tmp_path / "p"), "k bigint, v string").collect()
    assert packed.read_packed(spark, str(tmp_path / "p"), "k bigint, v string", on_error="skip").count() == 24
    assert packed.read_packed(spark, str(tmp_path / "p"), "v string", on_error="skip", skip_rows=1).count() == 24 - len(names)


def test_workbooks_hold_all_rows(spark):
    import datetime as dt

    df = spark.range(10).selectExpr("id", "concat('=', id) AS v", "timestamp'2024-03-01 06:00:00' AS t").coalesce(1)
    for limits, files in (({"max_rows": 4}, 4), ({"max_rows": 6}, 2), ({"max_rows": 11}, 1), ({}, 1), ({"max_bytes": 1}, 10)):
        books = [bytes(r.content) for r in packed.workbooks(df, "s", protection="sanitize", **limits).collect()]
        assert len(books) == files and all(next(packed.sheet_rows(b)) == (1, ["id", "v", "t"]) for b in books)
        back = packed.sheet_records(packed.read_workbooks(packed.workbooks(df, "s", protection="sanitize", **limits)), "s", ["id", "v", "t"]).select("id", "v", "t")
        assert sorted(map(tuple, back.collect())) == [(str(k), str(k), dt.datetime(2024, 3, 1, 6).isoformat()) for k in range(10)]
    assert [list(packed.sheet_rows(bytes(r.content))) for r in packed.workbooks(df.where("id < 0"), "s").collect()] == [[(1, ["id", "v", "t"])]]
    with pytest.raises(packed.FormatError, match="more than 3 rows"):
        packed.workbook({"s": (["k"], ([k] for k in range(3)))}, max_rows=3)
    with pytest.raises(ValueError):
        packed.workbooks(df, max_rows=1)
