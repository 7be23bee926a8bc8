import dataclasses
import datetime
import decimal
import json
import pickle
import uuid

import pytest
from pyspark.sql import types as T

from rowweave.errors import SchemaError
from rowweave.plans.mapping import schema_for, schema_from_struct, spark_type
from rowweave.plans.schema import PRIMITIVES, RABIN_EMPTY, Registry, build, parse, rabin


def rec(*fields, **more):
    return json.dumps({"type": "record", "name": "R", "fields": [{"name": n, "type": t} | (x[0] if x else {}) for n, t, *x in fields]} | more)


#: Fixed values.
RABIN = {"null": "63dd24e7cc258f8a", "boolean": "9f42fc78a4d4f764", "int": "7275d51a3f395c8f", "long": "d054e14493f41db7", "float": "4d7c02cb3ea8d790", "double": "8e7535c032ab957e", "string": "8f014872634503c7", "bytes": "4fc016dac3201965"}


def test_fingerprints():
    assert {p: parse(p).fingerprint().hex() for p in PRIMITIVES} == RABIN
    assert rabin(b"") == RABIN_EMPTY
    assert parse("int").fingerprint("sha256").hex() == "3f2b87a9fe7cc9b13835598c3981cd45e3e355309e5090aa0933d7becb6fba45"


def test_fingerprints_as_the_jvm_library_has_them(spark):
    jvm = spark._jvm.org.apache.avro
    for text in ['"int"', rec(("a", ["null", "string"]), ("b", {"type": "array", "items": "long"})), '{"type":"enum","name":"x.E","symbols":["A","B"]}', '{"type":"fixed","name":"F","size":3,"aliases":["G"]}', '{"type":"map","values":{"type":"record","name":"a.Q","fields":[{"name":"next","type":["null","Q"]}]}}']:
        own = jvm.Schema.Parser().parse(text)
        schema = parse(text)
        assert schema.canonical() == jvm.SchemaNormalization.toParsingForm(own)
        assert int.from_bytes(schema.fingerprint(), "big", signed=True) == jvm.SchemaNormalization.parsingFingerprint64(own)


def test_canonical():
    assert parse('{"type":"string"}').canonical() == '"string"'
    text = '{"type":"record","namespace":"a.b","doc":"x","name":"R","fields":[{"default":1,"type":{"type":"fixed","size":"3","name":"F"},"name":"f"},{"name":"g","type":"F"}]}'
    assert parse(text.replace('"default":1,', "")).canonical() == '{"name":"a.b.R","type":"record","fields":[{"name":"f","type":{"name":"a.b.F","type":"fixed","size":3}},{"name":"g","type":"a.b.F"}]}'


@pytest.mark.parametrize(
    "bad",
    [
        "", "[]", "{}", '{"type":"what"}', '"unknown"', '["int","int"]', '["int",["string"]]', '["null",{"type":"array","items":"int"},{"type":"array","items":"long"}]',
        '{"type":"enum","name":"E","symbols":[]}', '{"type":"enum","name":"E","symbols":["A","A"]}', '{"type":"enum","name":"E","symbols":["1"]}', '{"type":"enum","name":"E","symbols":["A"],"default":"B"}',
        '{"type":"fixed","name":"F","size":0}', '{"type":"fixed","name":"F"}', '{"type":"fixed","name":"1F","size":2}', '{"type":"array"}', '{"type":"map","items":"int"}', '{"type":"int","items":"int"}',
        '{"type":"record","name":"R"}', rec(("a", "int"), ("a", "int")), rec(("a", "int", {"default": "x"})), rec(("a", "int", {"default": 2**31})), rec(("a", "string", {"order": "up"})), rec(("a", {"type": "array", "items": "Later"})),
        rec(("a", "bytes", {"default": "Ā"})), rec(("a", {"type": "record", "name": "R", "fields": []})), '{"type":"long","logicalType":"date"}', '{"type":"int","logicalType":"uuid"}', '{"type":"fixed","name":"D","size":11,"logicalType":"duration"}', '{"type":"int","logicalType":"date","precision":3}',
    ],
)
def test_rejected(bad):
    with pytest.raises(SchemaError):
        parse(bad)


def test_lenient():
    assert parse('{"tYpe":"int","LOGICALTYPE":"date"}').root.logical == "date"
    assert parse('{"type":"int","logicalType":"unheard"}').root.logical == ""
    assert parse('{"type":"string","logicalType":"decimal","precision":3}').root.logical == ""  # a bad decimal is what is below it
    assert parse('{"type":"fixed","name":"F","size":2,"logicalType":"decimal","precision":9}').root.logical == ""
    assert parse('{"type":"fixed","name":"F","size":4,"logicalType":"decimal","precision":9}').root.logical == "decimal"
    flat = parse('{"type":"record","name":"R","fields":[{"name":"e","type":"enum","symbols":["A"]},{"name":"a","type":"array","items":"int"}]}')
    assert [f.type.kind for f in flat.root.fields] == ["enum", "array"]
    assert parse('{"type":"record","name":"R","fields":[{"name":"a","type":["null","B"]},{"name":"b","type":{"type":"record","name":"B","fields":[]}}]}').root.fields[0].type.branches[1].name == "B"
    assert parse('{"type":"record","name":"a-b","fields":[]}', lax_names=True).root.name == "a-b"
    assert parse('{"type":"record","name":"a.b-c","fields":[]}', lax_names=lambda part: part != "x").root.name == "a.b-c"


def test_namespaces():
    s = parse('{"type":"record","name":"R","namespace":"n","aliases":["Old","m.Old"],"fields":[{"name":"a","type":{"type":"enum","name":"E","symbols":["A"]}},{"name":"b","type":{"type":"fixed","namespace":"","name":"F","size":1}},{"name":"c","type":"n.E"},{"name":"d","type":"E"}]}')
    assert sorted(s.named) == ["F", "n.E", "n.R"]
    assert s.root.aliases == ("n.Old", "m.Old")


def test_round_trip_of_the_whole_schema():
    text = rec(("a", ["null", "int"], {"doc": "d", "aliases": ["z"], "order": "ignore", "extra": 1}), ("n", ["null", "R"]), ("d", {"type": "bytes", "logicalType": "decimal", "precision": 4, "scale": 2}), doc="top", custom=[1])
    once = parse(text).to_json()
    assert parse(once).to_json() == once
    node = parse(text).root
    assert build(node).canonical() == parse(text).canonical()
    assert node.props == {"custom": [1]} and node.fields[0].props == {"extra": 1, "__implied_default": True}


def test_registry():
    r = Registry()
    money = {"type": "record", "name": "shop.Money", "fields": [{"name": "cents", "type": "long"}]}
    first = r.parse(json.dumps(money))
    assert r.parse(json.dumps(money, indent=4)) is first and r.by_fingerprint[first.fingerprint()] is first
    r.parse('{"type":"map","values":"shop.Money"}')  # a schema without a name of its own
    basket = r.parse('{"type":"record","name":"Basket","namespace":"shop","fields":[{"name":"total","type":"Money"},{"name":"parts","type":{"type":"array","items":"Money"}}]}')
    assert sorted(basket.named) == ["shop.Basket", "shop.Money"] and basket.root.fields[0].type.name == "shop.Money"
    known = set(r.named)
    for bad in ('{"type":"enum","name":"shop.Basket","symbols":["A"]}', '["null",{"type":"enum","name":"Fresh","symbols":["A"]},"Nowhere"]'):
        with pytest.raises(SchemaError):
            r.parse(bad)
        assert set(r.named) == known


def test_no_default_stays_no_default_in_another_process():
    field = pickle.loads(pickle.dumps(parse(rec(("a", "int"), ("b", "int", {"default": 1}))))).root.fields
    assert [f.has_default for f in field] == [False, True]


def test_spark_types():
    s = parse(rec(("u", ["null", "int", "string"]), ("e", {"type": "enum", "name": "E", "symbols": ["A"]}), ("t", {"type": "long", "logicalType": "timestamp-nanos"}), ("p", {"type": "bytes", "logicalType": "decimal", "precision": 50, "scale": 1})))
    assert spark_type(s).simpleString() == "struct<u:struct<member0:int,member1:string>,e:string,t:bigint,p:binary>"
    described = spark_type(s, described=True)
    assert described["e"].metadata == {"avro.symbols": ["A"]} and not described["e"].nullable and described["u"].metadata == {"avro.null": 0}
    with pytest.raises(SchemaError):
        spark_type(parse(rec(("n", ["null", "R"]))))
    assert "__too_deep" in spark_type(parse(rec(("n", ["null", "R"]))), max_depth=1).simpleString()


def test_schema_from_struct_and_back(spark, sf):
    for name in ("orders", "events", "embeddings", "labels"):
        kind = spark.read.parquet(f"{sf}/{name}.parquet").schema
        assert spark_type(schema_from_struct(kind)) == kind
    odd = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("d", T.DecimalType(5, 2), False)]), False), False), False)])
    assert spark_type(schema_from_struct(odd)).simpleString() == odd.simpleString()


@dataclasses.dataclass
class Inner:
    x: int


@dataclasses.dataclass
class Outer:
    a: int
    b: float | None
    c: list[Inner]
    d: dict[str, bytes]
    e: decimal.Decimal = dataclasses.field(metadata={"avro": "decimal(9,2)"})
    f: datetime.datetime = dataclasses.field(metadata={"avro": "timestamp-micros"})
    g: uuid.UUID
    h: Inner = dataclasses.field(metadata={"avro": "inline"})
    i: str = dataclasses.field(metadata={"avro": "name=j,alias=old,default=no, really"})
    k: bytes = dataclasses.field(metadata={"avro": "fixed(4)"})
    n: int = dataclasses.field(metadata={"avro": "int,default=3"})
    o: int = dataclasses.field(metadata={"avro": "-"})


def test_schema_for():
    s = schema_for(Outer, namespace="x")
    fields = {f.name: f for f in s.root.fields}
    assert list(fields) == ["a", "b", "c", "d", "e", "f", "g", "x", "j", "k", "n"]
    assert fields["j"].default == "no, really" and fields["j"].aliases == ("old",) and fields["n"].type.kind == "int" and fields["b"].type.branches[0].kind == "null"
    assert s.root.name == "x.Outer" and fields["k"].type.size == 4

    @dataclasses.dataclass
    class Bad:
        x: int = dataclasses.field(metadata={"avro": "unheard"})

    with pytest.raises(SchemaError):
        schema_for(Bad)
