"""encode_avro, decode_avro and evolve: one Arrow hop for a whole record; evolution of typed columns is a projection."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..custom import CustomType, decoded, encoded, raw_logical
from ..errors import SchemaError
from ..operators.decode import Buffer, Decoder, decode_column, valid_rows
from ..operators.decode import decode_many as _decode_many
from ..operators.encode import encode_column
from ..plans.mapping import spark_type, union_of
from ..plans.resolve import branch_for, check_compatibility, plan, pruned, reader_field
from ..plans.schema import Node, Schema, parse, rabin_table


def as_schema(schema: Schema | str) -> Schema:
    return schema if isinstance(schema, Schema) else parse(schema)


def encode_avro(column: Column | str, schema: Schema | str, custom: tuple[CustomType, ...] = ()) -> Column:
    """Rows of a struct (or values of another type) as bytes of the schema; fields are found by name. A null row is null
    unless the schema has null. What doesn't fit is an error, never garbage."""
    schema = as_schema(schema)
    column = F.col(column) if isinstance(column, str) else column
    column = _zeros_omitted(schema, encoded(schema, column, custom))

    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array) -> pa.Array:
        return encode_column(schema, values)

    return run(column)


def _zeros_omitted(schema: Schema, column: Column) -> Column:
    """Zeros, empty strings and false as null in nullable fields that say omitzero, in the root and in records within it (also
    nullable ones and those of arrays)."""
    out = _without_zeros(schema, schema.root, column, frozenset())
    return column if out is None else out


def _without_zeros(schema: Schema, node: Any, column: Column, above: frozenset[str]) -> Column | None:
    """The column without zeros, or None where nothing says omitzero."""
    node = schema.of(node)
    if node.kind == "union":
        members, _ = union_of(node)
        return _without_zeros(schema, members[0][1], column, above) if len(members) == 1 else None
    if node.kind == "array":
        probe = _without_zeros(schema, node.items, F.lit(None), above)
        return None if probe is None else F.transform(column, lambda x: _without_zeros(schema, node.items, x, above))
    if node.kind != "record" or node.name in above:  # a record within itself is left as it is
        return None
    out = None
    for f in node.fields:
        of, own = schema.of(f.type), column.getField(f.name)
        new = _without_zeros(schema, f.type, own, above | {node.name})
        members = union_of(of)[0] if of.kind == "union" else []
        if f.props.get("omitzero") and len(members) == 1:
            kind = schema.of(members[0][1]).kind
            zero = {"boolean": False, "string": "", "bytes": bytearray()}.get(kind, 0)
            if kind in ("boolean", "int", "long", "float", "double", "string", "bytes"):
                new = F.nullif(own, F.lit(zero))
        if new is not None:
            out = (column if out is None else out).withField(f.name, new)
    return out


def _reader(writer: Schema, reader: Schema | str | None, columns: list[str] | None) -> Schema | None:
    reader = None if reader is None else as_schema(reader)
    return pruned(reader or writer, columns) if columns else reader


def decode_avro(column: Column | str, writer: Schema | str, reader: Schema | str | None = None, columns: list[str] | None = None, mode: str = "failfast", max_depth: int = 0, custom: tuple[CustomType, ...] = (), raw: frozenset[str] = frozenset()) -> Column:
    """Bytes of writer as values of reader (or of these columns of it). What isn't wanted is skipped in the bytes.

    mode: failfast raises on bytes that can't be read; permissive gives null for them. raw: logical types to leave as they are.
    """
    writer = as_schema(writer)
    reader = _reader(writer, reader, columns)
    raw = frozenset(raw) | raw_logical(custom)
    steps = plan(writer, reader, max_depth, raw)
    kind = steps.type

    if mode == "permissive":

        @F.arrow_udf(kind)
        def run(values: pa.Array) -> pa.Array:
            return valid_rows(steps, values, reasons=False)[0]

    else:

        @F.arrow_udf(kind)
        def run(values: pa.Array) -> pa.Array:
            return decode_column(steps, values)

    return decoded(reader or writer, run(column), custom)


def try_decode_avro(column: Column | str, writer: Schema | str, reader: Schema | str | None = None, columns: list[str] | None = None, max_depth: int = 0) -> Column:
    return decode_avro(column, writer, reader, columns, "permissive", max_depth)


def decode_errors(column: Column | str, writer: Schema | str, reader: Schema | str | None = None) -> Column:
    """What is wrong with each row's bytes, with the path to the field; null where nothing is."""
    steps = plan(as_schema(writer), None if reader is None else as_schema(reader))

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array(valid_rows(steps, values)[1], pa.string())

    return run(column)


def decode_many(column: Column | str, writer: Schema | str, reader: Schema | str | None = None) -> Column:
    """The values that stand one after another in each row's bytes, as an array."""
    steps = plan(as_schema(writer), None if reader is None else as_schema(reader))

    @F.arrow_udf(T.ArrayType(steps.type))
    def run(values: pa.Array) -> pa.Array:
        return _decode_many(steps, values)

    return run(column)


def rabin64(column: Column | str) -> Column:
    """The 64-bit Rabin fingerprint of bytes or text, as 8 bytes, most significant first."""
    table = np.array(rabin_table(), np.uint64)

    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array) -> pa.Array:
        values = values.cast(pa.binary())
        n = len(values)
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(values.buffers()[2], np.uint8) if n and values.buffers()[2] is not None else np.empty(0, np.uint8)
        sizes, state = np.diff(offsets), np.full(n, 0xC15D213AA4D7A795, np.uint64)
        live, i = np.flatnonzero(sizes > 0), 0
        while len(live):
            b = data[offsets[live] + i].astype(np.uint64)
            state[live] = (state[live] >> np.uint64(8)) ^ table[((state[live] ^ b) & np.uint64(0xFF)).astype(np.int64)]
            i += 1
            live = live[sizes[live] > i]
        out = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 8 * n + 1, 8, dtype=np.int32)), pa.py_buffer(state.astype(">u8").tobytes())])
        return out if not values.null_count else pa.array([x if v else None for x, v in zip(out.to_pylist(), values.is_valid().to_pylist(), strict=True)], pa.binary())

    return run(column)


# evolution of typed columns


def evolve(column: Column | str, writer: Schema | str, reader: Schema | str) -> Column:
    """A column of writer's type as one of reader's: casts, literals, renames and CASE, which the optimizer sees through."""
    writer, reader = as_schema(writer), as_schema(reader)
    if writer.canonical() != reader.canonical():
        check_compatibility(writer, reader)
    column = F.col(column) if isinstance(column, str) else column
    return _project(writer, writer.root, reader, reader.root, column)


def _project(ws: Schema, w: Node, rs: Schema, r: Node, c: Column) -> Column:
    w, r = ws.of(w), rs.of(r)
    kind = spark_type(rs, r)
    if w.kind == "union":
        members, null = union_of(w)
        if len(members) == 1:
            return _project(ws, members[0][1], rs, r, c)  # null stays null
        parts = [(c.getField(f"member{k}"), b) for k, (_, b) in enumerate(members)]
        return F.coalesce(*(F.when(p.isNotNull(), _project(ws, b, rs, r, p)) for p, b in parts)).cast(kind)
    if r.kind == "union":
        i = branch_for(ws, w, rs, r)
        inner = _project(ws, w, rs, r.branches[i], c)
        members, _ = union_of(r)
        if len(members) == 1:
            return inner
        fields = [inner if at == i else F.lit(None).cast(spark_type(rs, b)) for at, b in members]
        return F.when(c.isNotNull(), F.struct(*(f.alias(f"member{k}") for k, f in enumerate(fields))))
    if w.kind == "record":
        out = []
        for i, f in enumerate(r.fields):
            source = [x for x in w.fields if reader_field(x, r.fields) == i]
            value = _project(ws, source[-1].type, rs, f.type, c.getField(source[-1].name)) if source else literal(rs, f.type, f.default)
            out.append(value.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*out)) if out else F.when(c.isNotNull(), F.struct())
    if w.kind == "array":
        return F.transform(c, lambda x: _project(ws, w.items, rs, r.items, x))
    if w.kind == "map":
        return F.transform_values(c, lambda _, x: _project(ws, w.items, rs, r.items, x))
    if w.kind == "enum":
        if all(s in r.symbols for s in w.symbols):
            return c
        return F.when(c.isin(*r.symbols) | c.isNull(), c).otherwise(F.lit(r.enum_default))
    if w.kind == "string" and r.kind == "bytes":
        return F.encode(c, "UTF-8")
    if w.kind == "bytes" and r.kind == "string":
        return F.decode(c, "UTF-8")
    return c if w.kind == r.kind else c.cast(kind)


def literal(schema: Schema, node: Node, default: Any) -> Column:
    """A default as a column: it is encoded and decoded as the codec would."""
    from ..operators.rows import default_bytes

    steps = plan(Schema(node, schema.named, ""), None)
    raw = default_bytes(schema, node, default)
    data = np.frombuffer(raw or b"\0", np.uint8)
    value, _ = Decoder(Buffer(data, np.array([len(raw)]))).value(steps, np.array([0]), None)
    return _lit(value[0].as_py(), steps.type)


def _lit(value: Any, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(_lit(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.array(*(_lit(x, kind.elementType) for x in value)).cast(kind)
    if isinstance(kind, T.MapType):
        pairs = value.items() if isinstance(value, dict) else value
        return F.create_map(*(x for k, v in pairs for x in (F.lit(k), _lit(v, kind.valueType)))).cast(kind)
    return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(kind)


def require_struct(schema: Schema) -> T.StructType:
    kind = spark_type(schema)
    if not isinstance(kind, T.StructType):
        raise SchemaError("the schema isn't of a record")
    return kind
