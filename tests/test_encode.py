from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.encode import binary, csv, fields, native, rowbinary, writer


def hexed(spark, value, kind, column):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", kind)]))
    r = df.select(F.hex(column(F.col("x")))).first()[0]
    return r


def test_golden_numbers(spark):
    assert hexed(spark, 6666, T.ShortType(), lambda x: binary.le_int(x, 2)) == "0A1A"
    assert hexed(spark, 66667777, T.IntegerType(), lambda x: binary.le_int(x, 4)) == "0145F903"
    assert hexed(spark, 66668888888, T.LongType(), lambda x: binary.le_int(x, 8)) == "3883C6850F000000"
    assert hexed(spark, 12.3456, T.FloatType(), binary.le_float32) == "94874541"
    assert hexed(spark, 12.3456, T.DoubleType(), binary.le_float64) == "C5FEB27BF2B02840"
    assert hexed(spark, Decimal("1234.56789"), T.DecimalType(18, 8), lambda x: binary.decimal(x, 10, 8)) == "081A99BE1C000000"
    assert writer.decimal("12345.67890123", 18, 10) == writer.integer(123456789012300, 8)
    assert writer.decimal("123456789.123456789", 20, 5) == writer.integer(0, 8) + writer.integer(12345678912345, 8)
    with pytest.raises(ValueError):
        writer.decimal("990000000", 18, 11)


def test_negative_numbers_and_truncation_toward_zero(spark):
    for d in ("-1.559", "1.559", "-0.001", "0"):
        want = writer.decimal(d, 10, 1).hex().upper()
        assert hexed(spark, Decimal(d), T.DecimalType(18, 3), lambda x: binary.decimal(x, 10, 1)) == want
    for d in ("-1.559", "-12345678901234567890.5"):
        want = writer.decimal(d, 25, 1).hex().upper()
        assert hexed(spark, Decimal(d), T.DecimalType(30, 3), lambda x: binary.decimal(x, 25, 1)) == want
    assert hexed(spark, -2, T.LongType(), lambda x: binary.le_int(x, 8)) == writer.integer(-2, 8).hex().upper()


def test_strings_are_cut_between_characters_and_padded():
    assert writer.fixed_utf8("123456789", 5) == b"12345" and writer.fixed_utf8("1", 3) == b"1  "
    assert writer.fixed_utf8("\x80" * 4, 5) == "\x80\x80".encode() + b" "
    assert writer.fixed_utf8("\U00010000" * 2, 5) == "\U00010000".encode() + b" "
    assert writer.fixed(b"1234", 6) == b"1234\0\0"
    with pytest.raises(ValueError):
        writer.cut_utf8("abc", 2, truncate=False)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\0"), max_size=20), st.integers(1, 20)), min_size=1, max_size=8))
def test_columns_equal_the_single_value_writer(spark, data):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(data)], "i int, s string")
    for n in sorted({n for _, n in data}):
        got = [bytes(r[0]) for r in df.orderBy("i").select(binary.cut_utf8(F.col("s"), n)).collect()]
        assert got == [writer.cut_utf8(s, n) for s, _ in data]
        got = [bytes(r[0]) for r in df.orderBy("i").select(binary.fixed_utf8(F.col("s"), n)).collect()]
        assert got == [writer.fixed_utf8(s, n) for s, _ in data]


def test_varints(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2097151, 2097152, 2**35]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    assert [bytes(r[0]) for r in df.select(binary.leb128(F.col("n"))).collect()] == [writer.leb128(n) for n in numbers]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "n bigint").select(binary.leb128(F.col("n"))).collect()
    with pytest.raises(ValueError):
        writer.leb128(-1)


def test_too_long_raises_when_not_truncating(spark):
    with pytest.raises(Exception, match="longer than"):
        spark.createDataFrame([("abc",)], "s string").select(binary.cut_utf8(F.col("s"), 2, False)).collect()


def test_rowbinary_composites(spark):
    schema = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType(), True), False), T.StructField("b", T.ArrayType(T.ArrayType(T.IntegerType(), False), False), False)])
    df = spark.createDataFrame([([1, None], [[1], [2, 3]])], schema)
    assert df.select(F.hex(rowbinary.row(schema))).first()[0] == "0200010000000102010100000002" + "0200000003000000"


def test_rowbinary_times_lengths_and_options(spark):
    schema = T.StructType([
        T.StructField("d", T.DateType(), False), T.StructField("t", T.TimestampNTZType(), False), fields.fixed_length("f", 3, nullable=False), fields.max_length("m", 2, nullable=False),
        T.StructField("o", T.ShortType(), True), T.StructField("u", T.StringType(), False, {"uuid": True}), T.StructField("y", T.BinaryType(), False),
    ])
    df = spark.createDataFrame([(date(1970, 1, 2), datetime(1970, 1, 1, 0, 1), "a", "xyz", None, "00112233-4455-6677-8899-aabbccddeeff", bytearray(b"\x01"))], schema)
    want = "0100" + "3C000000" + "610000" + "027879" + "01" + "7766554433221100" + "FFEEDDCCBBAA9988" + "0101"
    assert df.select(F.hex(rowbinary.row(schema))).first()[0] == want


def test_native_header_sizes_and_rows(spark):
    schema = T.StructType([T.StructField("a", T.ByteType()), T.StructField("b", T.ShortType()), T.StructField("c", T.IntegerType()), T.StructField("d", T.LongType()), T.StructField("e", T.StringType(), True, {"fixed_length": 1}), T.StructField("f", T.StringType()), T.StructField("g", T.BooleanType()), fields.decimal("h", 20, 5), T.StructField("i", T.FloatType())])
    assert [native.size_of(f) for f in schema.fields] == [1, 2, 4, 8, 1, -1, 1, 16, 8]
    head = native.header(schema)
    assert head[:11] == native.MAGIC and int.from_bytes(head[11:15], "little") == len(head) - 15 and head[15:18] == b"\x01\0\0" and int.from_bytes(head[18:20], "little") == 9
    df = spark.createDataFrame([(1, 2, None, 4, "x", "ab", True, None, 1.5)], schema)
    values = b"\x01" + writer.integer(2, 2) + writer.integer(4, 8) + b"x" + writer.integer(2, 4) + b"ab" + b"\x01" + writer.float64(1.5)
    want = writer.integer(len(values), 4) + bytes([0b00100001, 0]) + values
    assert bytes(df.select(native.row(schema)).first()[0]) == want


def test_schemas_are_checked_when_encoders_are_built():
    for f in (fields.max_length("x", 0), fields.fixed_length("x", 3, kind=T.IntegerType()), T.StructField("x", T.DecimalType(5, 2), True, {"decimal": [3, 4]})):
        with pytest.raises(ValueError):
            fields.check(f)
    with pytest.raises(ValueError):
        native.size_of(fields.max_length("x", 65_001))
    with pytest.raises(ValueError):
        native.size_of(T.StructField("x", T.ArrayType(T.IntegerType())))


def test_csv(spark, tmp_path):
    schema = T.StructType.fromDDL("a int, b double, s string, t timestamp_ntz, n string")
    df = spark.createDataFrame([(1, 3.3, "x", datetime(2019, 4, 3, 12, 58, 36, 129000), None)], schema)
    assert df.select(csv.line(schema, csv.CsvFormat(separator=","))).first()[0] == "1,3.3,x,2019-04-03 12:58:36.129,"
    tricky = spark.createDataFrame([("a\tb", 'q"q', "l\nl", None)], "a string, b string, c string, d string")
    csv.as_text(tricky).write.options(**csv.CsvFormat().options()).csv(str(tmp_path / "c"))
    back = spark.read.options(**csv.CsvFormat().options()).option("multiLine", True).csv(str(tmp_path / "c"))
    assert rows(back) == [("a\tb", 'q"q', "l\nl", None)]


def test_avro_payloads(spark):
    from tidewell.encode import avro

    # fixed values of the format: zigzag numbers, sized strings, blocks
    read = lambda schema, raw: avro.reader(schema)(raw, 0)[0]
    assert [read("long", bytes([b])) for b in (0, 1, 2, 3, 127)] == [0, -1, 1, -2, -64] and read("long", b"\x80\x01") == 64
    assert read("string", b"\x06foo") == "foo" and read({"type": "array", "items": "long"}, b"\x04\x06\x36\x00") == [3, 27]
    assert read({"type": "array", "items": "long"}, b"\x03\x04\x06\x36\x00") == [3, 27]
    assert [read(["null", "string"], b) for b in (b"\x00", b"\x02\x02a")] == [None, "a"]
    assert read({"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}, b"\x04\xff\x85") == Decimal("-1.23")
    assert read({"type": "long", "logicalType": "timestamp-micros"}, b"\x02") == datetime(1970, 1, 1, 0, 0, 0, 1) and read({"type": "int", "logicalType": "date"}, b"\x02") == date(1970, 1, 2)
    schema = '{"type": "record", "name": "r", "fields": [{"name": "a", "type": "int"}, {"name": "b", "type": ["null", "double"]}, {"name": "m", "type": {"type": "map", "values": "boolean"}}]}'
    assert avro.struct_of(schema).simpleString() == "struct<a:int,b:double,m:map<string,boolean>>"
    good = b"\x0e\x02" + b"\x00\x00\x00\x00\x00\x00\xf8\x3f" + b"\x02\x02k\x01\x00"
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(good[:-3])), (4, bytearray(good + b"x")), (5, bytearray(b""))], "n int, value binary")
    assert rows(avro.payload(schema)(df)) == [(1, 7, 1.5, {"k": True})] and rows(avro.payload(schema)(df.limit(0))) == []
    with pytest.raises(ValueError):
        avro.struct_of('["int", "string", "null"]')


def test_protobuf_payloads(spark):
    from tidewell.encode import protobuf

    message = [(1, "a", "int32"), (2, "s", "string"), (3, "sub", [(1, "x", "sint64")]), (4, "many", "repeated uint32"), (5, "d", "double"), (6, "on", "bool")]
    # fixed values of the format: field 1 varint 150, field 2 "testing"
    assert protobuf.reader(message)(b"\x08\x96\x01")["a"] == 150 and protobuf.reader(message)(b"\x12\x07testing")["s"] == "testing"
    raw = b"\x08\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01" + b"\x1a\x02\x08\x03" + b"\x22\x06\x03\x8e\x02\x9e\xa7\x05" + b"\x20\x01" + b"\x7a\x01z" + b"\x30\x01"
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"")), (3, None), (4, bytearray(b"\x12\x09abc"))], "n int, value binary")
    got = rows(protobuf.payload(message)(df))
    assert [tuple(x.asDict() if hasattr(x, "asDict") else x for x in r) for r in got] == [(1, -1, "", {"x": -2}, [3, 270, 86942, 1], 0.0, True), (2, 0, "", None, [], 0.0, False)]


def test_arrays_of_floats_and_wide_decimals(spark):
    df = spark.createDataFrame([([1.5, None, -2.0],), ([],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(F.hex(rowbinary.value(T.StructField("x", T.ArrayType(T.DoubleType(), True), False), F.col("x")))).collect()]
    f = lambda v: "00" + writer.float64(v).hex().upper()
    assert got == ["03" + f(1.5) + "01" + f(-2.0), "00", None]
    for d in ("0", "-1", "18446744073709551615.999", "-18446744073709551616.5", "9223372036854775807.125", "-0.001", "99999999999999999999999999.999"):
        for scale in (0, 2, 6):
            assert hexed(spark, Decimal(d), T.DecimalType(30, 3), lambda x, s=scale: binary.decimal(x, 37, s)) == writer.decimal(d, 37, scale).hex().upper()
            want = writer.decimal(d, 38, scale).hex().upper()
            assert hexed(spark, Decimal(d), T.DecimalType(30, 3), lambda x, s=scale: binary.decimal(x, 38, s)) == want, (d, scale)


def test_every_codec_of_own_files_round_trips():
    from tidewell.sources import files

    assert all(files.Compression.parse(c.value[0]) is c for c in files.Compression)
    for c in files.Compression:
        packed = files.compressor(c)(b"abc" * 1000)
        assert c is files.Compression.NONE or len(packed) < 1000
