"""Between schemas and Spark types, and schemas inferred from StructTypes and dataclasses.

A union of null and one type is that type, nullable; any other union is a struct member0, member1, ... with one member for
each branch but null, of which one at most is set. A recursive type is expanded max_depth times; deeper values are errors.
"""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import json
import types as pytypes
import typing
import uuid
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from ..errors import SchemaError
from .schema import Node, Schema, parse

_PLAIN = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "enum": T.StringType(), "fixed": T.BinaryType()}
_LOGICAL = {
    "date": T.DateType(),
    "time-millis": T.DayTimeIntervalType(0, 3),
    "time-micros": T.DayTimeIntervalType(0, 3),
    "timestamp-millis": T.TimestampType(),
    "timestamp-micros": T.TimestampType(),
    "local-timestamp-millis": T.TimestampNTZType(),
    "local-timestamp-micros": T.TimestampNTZType(),
    "uuid": T.StringType(),
    "duration": T.StructType([T.StructField(c, T.LongType()) for c in ("months", "days", "millis")]),
}
TOO_DEEP = "__too_deep"


def union_of(node: Node) -> tuple[list[tuple[int, Node]], int | None]:
    """The branches besides null with their places, and the place of null."""
    null = next((i for i, b in enumerate(node.branches) if b.kind == "null"), None)
    return [(i, b) for i, b in enumerate(node.branches) if i != null], null


def spark_type(schema: Schema, node: Node | None = None, max_depth: int = 0, raw: frozenset[str] = frozenset(), above: tuple[str, ...] = (), described: bool = False) -> T.DataType:
    """The type of the column that holds node's values. raw: logical types whose plain values are wanted. described: fields
    are nullable only where the schema has null, and have metadata; else all are nullable, as they come from Arrow."""
    node = schema.root if node is None else node
    if node.kind == "ref" or node.kind == "record":
        target = schema.of(node)
        if target.kind == "record":
            if target.name in above and not max_depth:
                raise SchemaError(f"{target.name} is recursive: say how deep values may be by max_depth")
            if above.count(target.name) > max_depth:
                return T.StructType([T.StructField(TOO_DEEP, T.BooleanType())])
            above = (*above, target.name)
        node = target
    deeper = lambda n: spark_type(schema, n, max_depth, raw, above, described)
    if node.kind == "record":
        return T.StructType([T.StructField(f.name, deeper(f.type), not described or is_nullable(schema, f.type), metadata(schema, f.type) if described else None) for f in node.fields])
    if node.kind == "union":
        members, null = union_of(node)
        if not members:
            return T.NullType()
        if len(members) == 1:
            return deeper(members[0][1])
        return T.StructType([T.StructField(f"member{k}", deeper(b), True) for k, (_, b) in enumerate(members)])
    if node.kind == "array":
        return T.ArrayType(deeper(node.items), not described or is_nullable(schema, node.items))
    if node.kind == "map":
        return T.MapType(T.StringType(), deeper(node.items), not described or is_nullable(schema, node.items))
    if node.logical and node.logical not in raw:
        if node.logical == "decimal" and node.precision <= 38:
            return T.DecimalType(node.precision, node.scale)
        if node.logical in _LOGICAL:
            return _LOGICAL[node.logical]
    return _PLAIN[node.kind]


def is_nullable(schema: Schema, node: Node) -> bool:
    node = schema.of(node)
    return node.kind == "null" or node.kind == "union" and any(b.kind == "null" for b in node.branches)


def metadata(schema: Schema, node: Node) -> dict:
    """What a Spark type doesn't say: symbols, sizes, precision, where null is in a union."""
    node, out = schema.of(node), {}
    if node.kind == "union":
        members, null = union_of(node)
        out = metadata(schema, members[0][1]) if len(members) == 1 else {}
        return out | ({"avro.null": null} if null is not None else {})
    if node.kind == "enum":
        out["avro.symbols"] = list(node.symbols)
    if node.kind == "fixed":
        out["avro.size"] = node.size
    if node.logical:
        out["avro.logical"] = node.logical
    return out


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type in which Spark exchanges a column of a type."""
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", arrow_type(kind.elementType)))
    if isinstance(kind, T.MapType):
        return pa.map_(pa.string(), arrow_type(kind.valueType))
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    return {
        T.NullType: pa.null(),
        T.BooleanType: pa.bool_(),
        T.IntegerType: pa.int32(),
        T.LongType: pa.int64(),
        T.FloatType: pa.float32(),
        T.DoubleType: pa.float64(),
        T.BinaryType: pa.binary(),
        T.StringType: pa.string(),
        T.DateType: pa.date32(),
        T.TimestampType: pa.timestamp("us", "UTC"),
        T.TimestampNTZType: pa.timestamp("us"),
        T.DayTimeIntervalType: pa.duration("us"),
    }[type(kind)]


# inference


def schema_from_struct(struct: T.StructType, name: str = "Row", namespace: str = "") -> Schema:
    """The schema of rows of a type. A field's metadata may hold avro.logical, avro.size, avro.symbols, avro.default,
    avro.aliases, avro.doc."""
    names: set[str] = set()

    def fresh(wanted: str) -> str:
        out, n = wanted, 2
        while out in names:
            out, n = f"{wanted}_{n}", n + 1
        names.add(out)
        return out

    def form(kind: T.DataType, wanted: str, meta: dict) -> Any:
        if isinstance(kind, T.StructType):
            own = fresh(wanted)
            return {"type": "record", "name": own, "fields": [one(f, own) for f in kind.fields]}
        if isinstance(kind, T.ArrayType):
            item = form(kind.elementType, f"{wanted}_item", {})
            return {"type": "array", "items": ["null", item] if kind.containsNull else item}
        if isinstance(kind, T.MapType):
            if not isinstance(kind.keyType, T.StringType):
                raise SchemaError("map keys must be strings")
            value = form(kind.valueType, f"{wanted}_value", {})
            return {"type": "map", "values": ["null", value] if kind.valueContainsNull else value}
        logical = meta.get("avro.logical")
        if isinstance(kind, T.DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
        if isinstance(kind, T.StringType):
            if "avro.symbols" in meta:
                return {"type": "enum", "name": fresh(wanted), "symbols": meta["avro.symbols"]}
            return {"type": "string", "logicalType": "uuid"} if logical == "uuid" else "string"
        if isinstance(kind, T.BinaryType):
            return {"type": "fixed", "name": fresh(wanted), "size": meta["avro.size"]} if "avro.size" in meta else "bytes"
        for spark, base, default in (
            (T.DateType, "int", "date"),
            (T.TimestampType, "long", "timestamp-micros"),
            (T.TimestampNTZType, "long", "local-timestamp-micros"),
            (T.DayTimeIntervalType, "long", "time-micros"),
        ):
            if isinstance(kind, spark):
                logical = logical or default
                return {"type": "int" if logical in ("date", "time-millis") else base, "logicalType": logical}
        for spark, base in ((T.BooleanType, "boolean"), (T.ByteType, "int"), (T.ShortType, "int"), (T.IntegerType, "int"), (T.LongType, "long"), (T.FloatType, "float"), (T.DoubleType, "double"), (T.NullType, "null")):
            if isinstance(kind, spark):
                return {"type": base, "logicalType": logical} if logical else base
        raise SchemaError(f"no schema for {kind.simpleString()}")

    def one(f: T.StructField, owner: str) -> dict:
        meta = f.metadata or {}
        kind = form(f.dataType, f"{owner}_{f.name}" if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else f.name, meta)
        out: dict[str, Any] = {"name": f.name, "type": kind}
        if f.nullable and kind != "null":
            out = {"name": f.name, "type": ["null", kind], "default": None}
            if "avro.default" in meta and meta["avro.default"] is not None:
                out = {"name": f.name, "type": [kind, "null"], "default": meta["avro.default"]}
        elif "avro.default" in meta:
            out["default"] = meta["avro.default"]
        out |= {"aliases": meta["avro.aliases"]} if "avro.aliases" in meta else {}
        return out | ({"doc": meta["avro.doc"]} if "avro.doc" in meta else {})

    root = form(struct, name, {})
    if namespace:
        root["namespace"] = namespace
    return parse(json.dumps(root))


_PYTHON = {bool: "boolean", int: "long", float: "double", str: "string", bytes: "bytes"}


def schema_for(cls: type, name: str | None = None, namespace: str = "") -> Schema:
    """The schema of a dataclass. Tags are the metadata "avro" of a field: a string of options between commas.

    name=..., default=... (last; JSON, else a string), alias=..., type-alias=..., a logical type, decimal(p,s), uuid, fixed(n),
    int, float, inline, omitzero (a zero is written as null), -. An option that isn't known is an error. T | None is a union with null, the default.
    """
    done: dict[type, str] = {}

    def record(c: type, own: str | None = None) -> Any:
        if c in done:
            return done[c]
        if not dataclasses.is_dataclass(c):
            raise SchemaError(f"no schema for {c!r}")
        done[c] = own or c.__name__
        return {"type": "record", "name": done[c], "fields": fields(c)}

    def fields(c: type) -> list[dict]:
        hints, out = typing.get_type_hints(c), []
        for f in dataclasses.fields(c):
            tags = _tags(f.metadata.get("avro", ""))
            if "-" in tags:
                continue
            if "inline" in tags:
                out += fields(hints[f.name])
                continue
            kind = infer(hints[f.name], tags)
            one: dict[str, Any] = {"name": tags.get("name", f.name), "type": kind}
            if isinstance(kind, list):
                one["default"] = None
            if "alias" in tags:
                one["aliases"] = tags["alias"]
            if "omitzero" in tags:
                one["omitzero"] = True
            if "default" in tags:
                one["default"] = tags["default"]
                if isinstance(kind, list) and tags["default"] is not None:
                    one["type"] = kind[::-1]
            out.append(one)
        names = [x["name"] for x in out]
        return [x for i, x in enumerate(out) if x["name"] not in names[i + 1 :] or x["name"] not in names[:i]]

    def infer(kind: Any, tags: dict) -> Any:
        origin, args = typing.get_origin(kind), typing.get_args(kind)
        if origin in (typing.Union, pytypes.UnionType) and type(None) in args:
            rest = [a for a in args if a is not type(None)]
            if len(rest) != 1:
                raise SchemaError(f"no schema for {kind!r}")
            return ["null", infer(rest[0], tags)]
        if origin is list:
            return {"type": "array", "items": infer(args[0], tags)}
        if origin is dict:
            if args[0] is not str:
                raise SchemaError("map keys must be strings")
            return {"type": "map", "values": infer(args[1], tags)}
        if kind is uuid.UUID or "uuid" in tags and kind is str:
            return {"type": "string", "logicalType": "uuid"}
        if kind is decimal.Decimal:
            if "decimal" not in tags:
                raise SchemaError("a decimal needs a tag decimal(precision,scale)")
            return {"type": "bytes", "logicalType": "decimal", "precision": tags["decimal"][0], "scale": tags["decimal"][1]}
        logical = tags.get("logical")
        if kind is datetime.datetime:
            return {"type": "int" if logical == "date" else "long", "logicalType": logical or "timestamp-millis"}
        if kind is datetime.date:
            return {"type": "int", "logicalType": "date"}
        if kind is datetime.timedelta:
            return {"type": "int" if logical == "time-millis" else "long", "logicalType": logical or "time-micros"}
        if kind is bytes and "fixed" in tags:
            return {"type": "fixed", "name": f"fixed_{tags['fixed']}", "size": tags["fixed"]}
        if kind in _PYTHON:
            base = "int" if kind is int and "int" in tags else "float" if kind is float and "float" in tags else _PYTHON[kind]
            return {"type": base, "logicalType": logical} if logical else base
        out = record(kind)
        if "type-alias" in tags and isinstance(out, dict):
            out["aliases"] = tags["type-alias"]
        return out

    root = record(cls, name)
    if namespace:
        root["namespace"] = namespace
    return parse(json.dumps(root))


def _tags(text: str) -> dict:
    out: dict[str, Any] = {}
    while text:
        if text.startswith("default="):
            try:
                out["default"] = json.loads(text[8:])
            except ValueError:
                out["default"] = text[8:]
            break
        cut = text.find(",", text.find(")") if text.startswith("decimal(") else 0)
        option, text = (text, "") if cut < 0 else (text[:cut], text[cut + 1 :])
        key, _, value = option.strip().partition("=")
        if key == "name":
            out[key] = value
        elif key in ("alias", "type-alias"):
            out.setdefault(key, []).append(value)
        elif key.startswith("decimal("):
            p, _, s = key[8:-1].partition(",")
            out["decimal"] = (int(p), int(s or 0))
        elif key.startswith("fixed("):
            out["fixed"] = int(key[6:-1])
        elif key in ("uuid", "inline", "-", "int", "float", "omitzero"):
            out[key] = True
        elif key in _LOGICAL or key == "timestamp-nanos" or key.startswith("local-timestamp-"):
            out["logical"] = key
        else:
            raise SchemaError(f"unknown tag {key!r}")
    return out
