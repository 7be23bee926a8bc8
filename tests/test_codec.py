import datetime as dt
import decimal
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowweave.errors import CompatibilityError, DataError, ShortBufferError
from rowweave.operators import rows
from rowweave.operators.decode import decode_column, decode_many, valid_rows
from rowweave.operators.encode import encode_column
from rowweave.plans.mapping import arrow_type, spark_type
from rowweave.plans.resolve import check_compatibility, is_compatible, plan, pruned
from rowweave.plans.schema import parse

from test_schema import rec


def enc(schema, values):
    s = parse(schema)
    return encode_column(s, pa.array(values, arrow_type(spark_type(s)))).to_pylist()


def dec(data, writer, reader=None, **k):
    return decode_column(plan(parse(writer), reader and parse(reader), **k), pa.array(data, pa.binary())).to_pylist()


#: Fixed values.
@pytest.mark.parametrize("n, raw", [(0, "00"), (-1, "01"), (1, "02"), (-2, "03"), (2, "04"), (63, "7e"), (64, "8001"), (2**31 - 1, "feffffff0f"), (-(2**31), "ffffffff0f")])
def test_int(n, raw):
    assert enc("int", [n]) == [bytes.fromhex(raw)] and dec([bytes.fromhex(raw)], "int") == [n]


def test_long_ends():
    assert enc("long", [2**63 - 1, -(2**63)]) == [b"\xfe" + b"\xff" * 8 + b"\x01", b"\xff" * 9 + b"\x01"]
    assert dec(enc("long", [2**63 - 1, -(2**63)]), "long") == [2**63 - 1, -(2**63)]


@pytest.mark.parametrize("schema, raw", [("int", "ffffffff10"), ("int", "8080808080"), ("long", "ff" * 9 + "02"), ("boolean", ""), ("float", "000000"), ("double", "00"), ("string", "0661"), ("string", "01"), ("bytes", ""), ('{"type":"fixed","name":"F","size":2}', "00"), ('{"type":"enum","name":"E","symbols":["A"]}', "02"), ('["null","int"]', "04"), ('{"type":"array","items":"int"}', "040204"), ('{"type":"array","items":"int"}', "feffffffffffffffff0100"), ('{"type":"map","values":"int"}', "02"), ("int", "0200")])
def test_bad_bytes(schema, raw):
    with pytest.raises(DataError):
        dec([bytes.fromhex(raw)], schema)


def test_null_unions():
    assert enc('["null","int"]', [None, 1]) == [b"\0", b"\2\2"] and enc('["int","null"]', [None, 1]) == [b"\2", b"\0\2"]


def test_blocks_of_arrays_and_maps():
    a = '{"type":"array","items":"int"}'
    assert dec([b"\0"], a) == [[]]
    assert dec([bytes.fromhex("020204040600")], a) == [[1, 2, 3]]  # two blocks
    assert dec([bytes.fromhex("0304020400")], a) == [[1, 2]]  # with its size
    m = '{"type":"map","values":"int"}'
    assert dec([bytes.fromhex("04026102026104") + b"\0"], m) == [[("a", 2)]]  # the last of equal keys
    assert dec([bytes.fromhex("02026102" + "02026204" + "00")], m) == [[("a", 1), ("b", 2)]]


def test_null_in_a_plain_field_and_paths():
    s = rec(("a", {"type": "record", "name": "In", "fields": [{"name": "x", "type": "int"}]}))
    with pytest.raises(DataError, match="a.x"):
        enc(s, [{"a": {"x": None}}])
    with pytest.raises(ShortBufferError, match="a.x"):
        dec([b""], s)
    assert enc("int", [None, 1]) == [None, b"\2"]


def test_missing_fields_take_defaults_when_written():
    s = parse(rec(("a", "int"), ("b", "string", {"default": "x"}), ("c", ["null", "int"])))
    assert encode_column(s, pa.array([{"a": 1, "other": 5}])).to_pylist() == [b"\2\2x\0"]
    with pytest.raises(DataError):
        encode_column(s, pa.array([{"b": "y"}]))


@pytest.mark.parametrize("schema, column, good", [("int", pa.array([1.0, 2.0]), True), ("int", pa.array([1.5]), False), ("int", pa.array([2**31]), False), ("float", pa.array([1e300]), False), ("float", pa.array([2**24]), True), ("float", pa.array([2**24 + 1]), False), ("double", pa.array([2**53 + 1]), False), ("double", pa.array([math.inf]), True), ("float", pa.array([math.inf]), True), ("string", pa.array([1]), False), ("string", pa.array([b"x"]), True), ("bytes", pa.array(["x"]), True), ("long", pa.array([decimal.Decimal("7.0")]), True)])
def test_what_is_accepted(schema, column, good):
    if good:
        encode_column(parse(schema), column)
    else:
        with pytest.raises(DataError):
            encode_column(parse(schema), column)


def test_decimals():
    s = '{"type":"bytes","logicalType":"decimal","precision":20,"scale":2}'
    d = decimal.Decimal
    values = [d("0.00"), d("1.27"), d("1.28"), d("-1.28"), d("-1.29"), d("-0.01"), d("123456789012345678.90")]
    assert enc(s, values)[:5] == [b"\2\0", b"\2\x7f", b"\4\0\x80", b"\2\x80", b"\4\xff\x7f"] and dec(enc(s, values), s) == values
    assert encode_column(parse(s), pa.array([d("1.009"), d("-1.001")], pa.decimal128(9, 3))).to_pylist() == [b"\2\x64", b"\2\x9b"]  # rounded down
    f = '{"type":"fixed","name":"F","size":3,"logicalType":"decimal","precision":6,"scale":0}'
    assert enc(f, [d(-2), d(300)]) == [b"\xff\xff\xfe", b"\0\1\x2c"] and dec([b"\xff\xff\xfe"], f) == [d(-2)]
    assert dec([b"\0"], s) == [d("0.00")]
    with pytest.raises(DataError):
        encode_column(parse('{"type":"fixed","name":"F","size":1,"logicalType":"decimal","precision":2,"scale":0}'), pa.array([d(99), d(400)], pa.decimal128(4, 0)))


def test_times():
    ms = '{"type":"long","logicalType":"timestamp-millis"}'
    t = dt.datetime(1969, 12, 31, 23, 59, 59, 999500, tzinfo=dt.timezone.utc)
    assert enc(ms, [t]) == [b"\1"] and dec([b"\1"], ms) == [t.replace(microsecond=999000)]  # before 1970 as well, down
    assert enc('{"type":"int","logicalType":"date"}', [dt.date(1969, 12, 31)]) == [b"\1"]
    assert encode_column(parse('{"type":"int","logicalType":"date"}'), pa.array([t])).to_pylist() == [b"\1"]
    us = '{"type":"long","logicalType":"time-micros"}'
    assert dec(enc(us, [dt.timedelta(days=2), dt.timedelta(microseconds=-1)]), us) == [dt.timedelta(days=2), dt.timedelta(microseconds=-1)]
    with pytest.raises(DataError):
        enc('{"type":"int","logicalType":"time-millis"}', [dt.timedelta(days=40)])
    with pytest.raises(DataError):
        encode_column(parse('{"type":"long","logicalType":"timestamp-nanos"}'), pa.array([dt.datetime(2300, 1, 1)]))


def test_uuid_and_duration():
    u = '{"type":"fixed","name":"U","size":16,"logicalType":"uuid"}'
    x = "01234567-89ab-cdef-0123-456789abcdef"
    assert enc(u, [x, x.upper()]) == [bytes.fromhex(x.replace("-", ""))] * 2 and dec(enc(u, [x]), u) == [x]
    for bad in (x[:-1], x.replace("-", "_"), "g" + x[1:]):
        with pytest.raises(DataError):
            enc(u, [bad])
    d = '{"type":"fixed","name":"D","size":12,"logicalType":"duration"}'
    v = {"months": 1, "days": 2, "millis": 2**32 - 1}
    assert enc(d, [v]) == [b"\1\0\0\0\2\0\0\0\xff\xff\xff\xff"] and dec(enc(d, [v]), d) == [v]


# evolution: the pairs of the fixture list


@pytest.mark.parametrize(
    "writer, reader, value, expected",
    [
        (rec(("a", "string")), rec(("a", "string"), ("b", "string", {"default": ""})), {"a": "x"}, {"a": "x", "b": ""}),
        (rec(("a", "int"), ("b", "string")), rec(("a", "int")), {"a": 1, "b": "x"}, {"a": 1}),
        (rec(("old", "int")), rec(("new", "int", {"aliases": ["old"]})), {"old": 1}, {"new": 1}),
        (rec(("x", {"type": "map", "values": "int"})), rec(("x", {"type": "map", "values": "double"})), {"x": [("k", 1)]}, {"x": [("k", 1.0)]}),
        (rec(("x", ["null", "int"])), rec(("x", ["null", "long"])), {"x": 5}, {"x": 5}),
        (rec(("x", "int")), rec(("x", ["long", "double"])), {"x": 5}, {"x": {"member0": 5, "member1": None}}),
        (rec(("x", "int")), rec(("x", ["long", "int"])), {"x": 5}, {"x": {"member0": 5, "member1": None}}),  # the first that takes it
        (rec(("x", ["int", "long"])), rec(("x", "double")), {"x": {"member0": None, "member1": 7}}, {"x": 7.0}),
        (rec(("x", "int")), rec(("x", "int"), ("y", ["null", "string"])), {"x": 1}, {"x": 1, "y": None}),
        (rec(("x", "string")), rec(("x", "bytes")), {"x": "é"}, {"x": "é".encode()}),
        (rec(("x", {"type": "enum", "name": "E", "symbols": ["A", "B", "C"]})), rec(("x", {"type": "enum", "name": "E", "symbols": ["B", "A"], "default": "A"})), {"x": "C"}, {"x": "A"}),
        (rec(("x", {"type": "fixed", "name": "a.Id", "size": 1})), rec(("x", {"type": "fixed", "name": "b.Id", "size": 1})), {"x": b"q"}, {"x": b"q"}),
        (rec(("x", "int")), rec(("x", "int"), ("d", {"type": "array", "items": "int"}, {"default": []}), ("e", ["int", "null"], {"default": None})), {"x": 1}, {"x": 1, "d": [], "e": None}),
    ],
)
def test_resolve(writer, reader, value, expected):
    assert dec(enc(writer, [value] * 3), writer, reader) == [expected] * 3


@pytest.mark.parametrize("writer, reader", [(rec(("a", "int")), rec(("a", "string"))), (rec(("x", ["null", "int"])), rec(("x", "int"))), (rec(), rec(("x", "int"))), ('{"type":"enum","name":"E","symbols":["A","B"]}', '{"type":"enum","name":"E","symbols":["A"]}'), ('{"type":"fixed","name":"F","size":1}', '{"type":"fixed","name":"F","size":2}'), (rec(name="X"), rec(name="Y")), ("long", "int"), ("int", '["string","null"]')])
def test_incompatible(writer, reader):
    with pytest.raises(CompatibilityError):
        check_compatibility(parse(writer), parse(reader))
    with pytest.raises(CompatibilityError):
        plan(parse(writer), parse(reader))


def test_decimals_that_differ():
    a, b = ('{"type":"bytes","logicalType":"decimal","precision":%d,"scale":2}' % p for p in (10, 12))
    assert not is_compatible(parse(a), parse(b))
    assert dec(enc(a, [decimal.Decimal("1.50")]), a, b) == [decimal.Decimal("1.50")]  # but the canonical forms are equal


NODE = rec(("v", "int"), ("next", ["null", "R"]))


def test_recursive():
    s = parse(NODE)
    raw = [rows.encode(s, s.root, v) for v in ({"v": 1, "next": (0, None)}, {"v": 1, "next": (1, {"v": 2, "next": (0, None)})})]
    assert dec(raw, NODE, max_depth=1) == [{"v": 1, "next": None}, {"v": 1, "next": {"v": 2, "next": None}}]
    deep = rows.encode(s, s.root, {"v": 1, "next": (1, {"v": 2, "next": (1, {"v": 3, "next": (0, None)})})})
    with pytest.raises(DataError, match="nested"):
        dec([deep], NODE, max_depth=1)
    outer = '{"type":"record","name":"W","fields":[{"name":"n","type":%s},{"name":"k","type":"int"}]}' % NODE
    assert dec([deep + b"\x0e"], outer, '{"type":"record","name":"W","fields":[{"name":"k","type":"int"}]}') == [{"k": 7}]


def test_decode_many_and_valid_rows():
    assert decode_many(plan(parse("int")), pa.array([b"\2\4", b"", None, b"\6"])).to_pylist() == [[1, 2], [], None, [3]]
    values, why = valid_rows(plan(parse("int")), pa.array([b"\2", b"\x80", None, b"\4\4", b"\6"]))
    assert values.to_pylist() == [1, None, None, None, 3] and [bool(w) for w in why] == [False, True, False, True, False]


def test_long_texts_take_little_memory():
    """Long texts are laid out without the place of each byte: numpy holds a few times the bytes of a run at most."""
    import tracemalloc

    s = parse(rec(("a", "long"), ("b", "string"), ("c", "bytes")))
    texts = [chr(97 + i % 26) * (i % 3000) for i in range(3000)] + ["", "é" * 70]
    column = pa.array([{"a": i, "b": t, "c": t[:5].encode()} for i, t in enumerate(texts)], arrow_type(spark_type(s)))
    tracemalloc.start()
    raw = encode_column(s, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * column.nbytes
    assert raw.to_pylist() == [rows.encode(s, s.root, v) for v in column.to_pylist()]
    assert decode_column(plan(s), raw).equals(column)


def test_pruned():
    s = parse(rec(("a", {"type": "enum", "name": "E", "symbols": ["A"]}), ("b", "E"), ("c", ["null", "int"])))
    raw = encode_column(s, pa.array([{"a": "A", "b": "A", "c": 3}]))
    assert decode_column(plan(s, pruned(s, ["b", "c"])), raw).to_pylist() == [{"b": "A", "c": 3}]


# random schemas and rows: the kernels against the plain codec

LEAVES = st.sampled_from(["boolean", "int", "long", "float", "double", "string", "bytes"])


def nested(leaf):
    return st.recursive(
        leaf,
        lambda x: st.one_of(
            x.map(lambda t: {"type": "array", "items": t}),
            x.map(lambda t: {"type": "map", "values": t}),
            x.filter(lambda t: not isinstance(t, list)).map(lambda t: ["null", t]),
            st.lists(x, min_size=0, max_size=3).map(lambda ts: {"fields": ts}),
        ),
        max_leaves=6,
    )


def named(t, n):
    if isinstance(t, list):
        return [named(x, n) for x in t]
    if isinstance(t, dict) and "fields" in t:
        n.append(0)
        name = f"N{len(n)}"
        return {"type": "record", "name": name, "fields": [{"name": f"f{i}", "type": named(x, n)} for i, x in enumerate(t["fields"])]}
    if isinstance(t, dict):
        return {k: named(v, n) if k in ("items", "values") else v for k, v in t.items()}
    return t


def raw_values(s, node):
    node = s.of(node)
    return {
        "null": lambda: st.none(),
        "boolean": lambda: st.booleans(),
        "int": lambda: st.integers(-(2**31), 2**31 - 1),
        "long": lambda: st.integers(-(2**63), 2**63 - 1),
        "float": lambda: st.floats(width=32, allow_nan=False),
        "double": lambda: st.floats(allow_nan=False),
        "string": lambda: st.text(max_size=9),
        "bytes": lambda: st.binary(max_size=9),
        "array": lambda: st.lists(raw_values(s, node.items), max_size=4),
        "map": lambda: st.dictionaries(st.text(max_size=3), raw_values(s, node.items), max_size=3),
        "union": lambda: st.one_of(*(raw_values(s, b).map(lambda v, i=i: (i, v)) for i, b in enumerate(node.branches))),
        "record": lambda: st.fixed_dictionaries({f.name: raw_values(s, f.type) for f in node.fields}),
    }[node.kind]()


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_kernels_equal_the_plain_codec(data):
    schema = parse(named(data.draw(nested(LEAVES)), []))
    values = data.draw(st.lists(raw_values(schema, schema.root), min_size=1, max_size=6))
    raw = [rows.encode(schema, schema.root, v) for v in values]
    column = decode_column(plan(schema), pa.array(raw, pa.binary()))
    assert encode_column(schema, column).to_pylist() == raw
    assert [rows.decode(schema, schema.root, r)[1] for r in raw] == [len(r) for r in raw]
    skipped = parse({"type": "record", "name": "Outer", "fields": [{"name": "gone", "type": schema_json(schema)}, {"name": "kept", "type": "int"}]})
    both = pa.array([r + b"\x0a" for r in raw], pa.binary())
    assert decode_column(plan(skipped, parse({"type": "record", "name": "Outer", "fields": [{"name": "kept", "type": "int"}]})), both).to_pylist() == [{"kept": 5}] * len(raw)


def schema_json(schema):
    import json

    return json.loads(schema.to_json())


def alone(steps, b):
    try:
        return decode_column(steps, pa.array([b], pa.binary())).to_pylist()[0], None
    except DataError as e:
        return None, str(e)


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_damaged_rows_are_told_as_if_alone(data):
    schema = parse(named(data.draw(nested(LEAVES)), []))
    values = data.draw(st.lists(raw_values(schema, schema.root), min_size=1, max_size=12))
    raw = [rows.encode(schema, schema.root, v) for v in values]
    change = st.sampled_from([lambda b: b, lambda b: b[: len(b) // 2], lambda b: b[:-1], lambda b: b + b"\0", lambda b: b"\xff" * 9 + b, lambda b: b[: len(b) // 2] + b"\x8f" + b[len(b) // 2 :], lambda b: None])
    raw = [data.draw(change)(b) for b in raw]
    outer = {"type": "record", "name": "Outer", "fields": [{"name": "v", "type": schema_json(schema)}]}
    for steps in (plan(schema), plan(parse(outer)), plan(parse(outer), parse({"type": "record", "name": "Outer", "fields": []}))):
        column, why = valid_rows(steps, pa.array(raw, pa.binary()))
        want = [(None, None) if b is None else alone(steps, b) for b in raw]
        assert repr(column.to_pylist()) == repr([v for v, _ in want]) and why == [w for _, w in want]
        assert valid_rows(steps, pa.array([None, *raw], pa.binary())[1:], reasons=False)[0].equals(column)


LOGICAL = [
    ({"type": "enum", "name": "E", "symbols": ["A", "B"]}, None, [b"\0", b"\2", b"\4", b"\1"]),
    ({"type": "long", "logicalType": "timestamp-millis"}, None, [b"\2", b"\xfe" + b"\xff" * 8 + b"\1", b"\xff" * 9 + b"\1"]),
    ({"type": "bytes", "logicalType": "decimal", "precision": 3, "scale": 1}, None, [b"\4\3\xe7", b"\4\3\xe8", b"\4\xfc\x19", b"\4\xfc\x18", b"\x24" + b"\1" * 18, b"\x24" + b"\0" * 18]),
    (["int", "string"], None, [b"\0\2", b"\2\2A", b"\4", b"\1"]),
]


@pytest.mark.parametrize("writer, reader, raw", LOGICAL)
def test_refused_values_are_told_as_if_alone(writer, reader, raw):
    steps = plan(parse(writer), None if reader is None else parse(reader))
    column, why = valid_rows(steps, pa.array(raw, pa.binary()))
    want = [alone(steps, b) for b in raw]
    assert column.to_pylist() == [v for v, _ in want] and why == [w for _, w in want]
    assert any(why) and not all(why)


def test_bad_rows_take_no_pass_each(monkeypatch):
    """A batch is read again for each step that fails, not for each row."""
    from rowweave.operators import decode

    passes = []
    monkeypatch.setattr(decode, "Decoder", lambda b, real=decode.Decoder: passes.append(1) or real(b))
    longs = encode_column(parse("long"), pa.array([i + (i % 2 << 40) for i in range(2000)]))
    column, why = valid_rows(plan(parse("int")), longs)
    assert column.to_pylist() == [None if i % 2 else i for i in range(2000)]
    assert why == ["a varint is too long" if i % 2 else None for i in range(2000)]
    assert len(passes) < 10


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_any_bytes_are_read_or_refused(raw):
    schema = parse(rec(("a", ["null", "long"]), ("b", {"type": "array", "items": ["string", "int"]}), ("c", {"type": "map", "values": "double"})))
    try:
        decode_column(plan(schema), pa.array([raw]))
    except DataError:
        with pytest.raises(DataError):
            value, at = rows.decode(schema, schema.root, raw)
            if at != len(raw):
                raise DataError("", "left over") from None


def test_slices_of_columns():
    s = parse(rec(("a", "int"), ("b", "string"), ("c", {"type": "array", "items": "float"})))
    column = pa.array([{"a": i, "b": "x" * i, "c": [float(i)] * (i % 3)} for i in range(20)], arrow_type(spark_type(s)))
    whole = encode_column(s, column)
    assert encode_column(s, column.slice(5, 7)).equals(whole.slice(5, 7))
    assert decode_column(plan(s), whole.slice(5, 7)).equals(column.slice(5, 7))
    assert np.all(np.asarray(decode_column(plan(s), whole).field("a")) == np.arange(20))
