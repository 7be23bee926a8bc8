"""JSON text of values, guided by the schema: bytes as ISO-8859-1, special floats, bare or tagged unions, logical types."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, localcontext
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..operators.decode import decode_column
from ..operators.encode import encode_column
from ..operators.rows import decode, default_value, encode
from ..plans.mapping import is_nullable, spark_type, union_of
from ..plans.resolve import plan
from ..plans.schema import Node, Schema
from .codec import as_schema

_SPECIAL = {"nan": math.nan, "inf": math.inf, "infinity": math.inf, "-inf": -math.inf, "-infinity": -math.inf, "+inf": math.inf, "+infinity": math.inf}


@dataclass(frozen=True)
class Style:
    """tagged: a union's value is {"branch": value}; tag_logical: branches are named with their logical type (type.logical);
    linkedin_floats: NaN is null and infinities are 1e999 and -1e999."""

    tagged: bool = False
    tag_logical: bool = False
    linkedin_floats: bool = False


def encode_json(column: Column | str, schema: Schema | str, tagged: bool = False, tag_logical: bool = False, linkedin_floats: bool = False) -> Column:
    """Each value as JSON text; null for a null row of a schema without null. Schemas of booleans, whole numbers, strings, enums,
    records, arrays, maps and nullable types stay in the JVM; bytes, decimals, floats and other unions take one Arrow hop."""
    schema, style = as_schema(schema), Style(tagged, tag_logical, linkedin_floats)
    c = F.col(column) if isinstance(column, str) else column
    if (text := _native(schema, schema.root, c, style, ())) is not None:
        return text if is_nullable(schema, schema.root) else F.when(c.isNotNull(), text)

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        raw = encode_column(schema, values)
        out = [None if b is None else dumps(schema, schema.root, decode(schema, schema.root, b)[0], style) for b in raw.to_pylist()]
        return pa.array(out, pa.string())

    return run(c)


def _native(schema: Schema, node: Node, c: Column, style: Style, above: tuple[str, ...]) -> Column | None:
    """JSON text as an expression; None if the schema has what needs the codec. Nulls where there can be none are errors."""
    node = schema.of(node)
    if node.kind == "union":
        members, null = union_of(node)
        if null is None or len(members) != 1:
            return None
        branch = schema.of(members[0][1])
        text = _native(schema, branch, c, style, above)
        if text is not None and style.tagged:
            text = F.concat(F.lit("{" + quoted(branch_name(branch, style.tag_logical)) + ":"), text, F.lit("}"))
        return None if text is None else F.when(c.isNull(), F.lit("null")).otherwise(text)
    if node.logical or node.name in above:
        return None
    need = lambda text: F.when(c.isNotNull(), text).otherwise(F.raise_error(F.lit(f"null isn't a {node.label()}")).cast("string"))
    if node.kind in ("boolean", "int", "long"):
        return need(c.cast(node.kind if node.kind == "boolean" else "bigint").cast("string"))
    if node.kind == "string":
        return need(_quoted(c))
    if node.kind == "enum":
        return need(F.when(c.isin(*node.symbols), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.raise_error(F.lit(f"not a symbol of {node.name}")).cast("string")))
    if node.kind == "array":
        probe = _native(schema, node.items, F.lit(None).cast(spark_type(schema, node.items)), style, above)
        return None if probe is None else need(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _native(schema, node.items, x, style, above)), ","), F.lit("]")))
    if node.kind == "map":
        probe = _native(schema, node.items, F.lit(None).cast(spark_type(schema, node.items)), style, above)
        pair = lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _native(schema, node.items, e["value"], style, above))
        return None if probe is None else need(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("}")))
    if node.kind == "record":
        parts = [_native(schema, f.type, c.getField(f.name), style, (*above, node.name)) for f in node.fields]
        if any(p is None for p in parts):
            return None
        text = [x for i, (f, p) in enumerate(zip(node.fields, parts, strict=True)) for x in (F.lit(("," if i else "{") + quoted(f.name) + ":"), p)]
        return need(F.concat(*(text or [F.lit("{")]), F.lit("}")))
    return None


def _quoted(c: Column) -> Column:
    """A string with what must be escaped escaped, as quoted() does."""
    text = F.to_json(F.struct(c.alias("s")))
    text = F.substr(text, F.lit(6), F.length(text) - 6)
    odd = text
    for x in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # the JVM writes these in upper case
        odd = F.replace(odd, F.lit(f"\\u{x:04X}"), F.lit(f"\\u{x:04x}"))
    for x in (0x2028, 0x2029, 0xFFFD):
        odd = F.replace(odd, F.lit(chr(x)), F.lit(f"\\u{x:04x}"))
    return F.when(c.rlike("[\\x0B\\x0E\\x0F\\x1A-\\x1F\\u2028\\u2029\\uFFFD]"), odd).otherwise(text)


def avro_to_json(column: Column | str, schema: Schema | str, tagged: bool = False, tag_logical: bool = False, linkedin_floats: bool = False) -> Column:
    """Encoded bytes as JSON text, without a Spark type between: recursive values of any depth, too."""
    schema, style = as_schema(schema), Style(tagged, tag_logical, linkedin_floats)

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        out = []
        for b in values.to_pylist():
            if b is not None:
                value, at = decode(schema, schema.root, b)
                if at != len(b):
                    raise DataError("", f"{len(b) - at} bytes are left over")
            out.append(None if b is None else dumps(schema, schema.root, value, style))
        return pa.array(out, pa.string())

    return run(F.col(column) if isinstance(column, str) else column)


def json_to_avro(column: Column | str, schema: Schema | str) -> Column:
    """JSON text as encoded bytes; a union takes the branch that is named, else the first that the value fits."""
    schema = as_schema(schema)

    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if t is None else encode(schema, schema.root, loads(schema, schema.root, _read(t))) for t in values.to_pylist()], pa.binary())

    return run(F.col(column) if isinstance(column, str) else column)


def decode_json(column: Column | str, schema: Schema | str, mode: str = "failfast") -> Column:
    """Values of JSON text. Unknown keys are passed over; a field that is missing takes its default, without one it is an
    error. permissive: null for texts that can't be read."""
    schema = as_schema(schema)
    steps, kind = plan(schema), spark_type(schema)

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        raw = []
        for text in values.to_pylist():
            try:
                raw.append(None if text is None else encode(schema, schema.root, loads(schema, schema.root, _read(text))))
            except (DataError, ValueError) as e:
                if mode != "permissive":
                    raise e if isinstance(e, DataError) else DataError("", str(e)) from e
                raw.append(None)
        return decode_column(steps, pa.array(raw, pa.binary()))

    return run(F.col(column) if isinstance(column, str) else column)


def _read(text: str) -> Any:
    def constant(x: str):
        raise ValueError(f"{x} isn't JSON")

    return json.loads(text, parse_constant=constant, parse_float=_Number, parse_int=_Number)


class _Number(str):
    """A number as it is spelled."""


def dumps(schema: Schema, node: Node, value: Any, style: Style = Style()) -> str:
    node, kind = schema.of(node), schema.of(node).kind
    if kind == "union":
        i, inner = value
        branch = schema.of(node.branches[i])
        text = dumps(schema, branch, inner, style)
        return f"{{{quoted(branch_name(branch, style.tag_logical))}:{text}}}" if style.tagged and branch.kind != "null" else text
    if kind == "null":
        return "null"
    if kind == "boolean":
        return "true" if value else "false"
    if node.logical == "decimal":
        with localcontext() as c:
            c.prec = 1000
            whole = Decimal(int.from_bytes(value, "big", signed=True) if value else 0)
            return format(whole.scaleb(-node.scale).quantize(Decimal(1).scaleb(-node.scale), ROUND_HALF_UP), "f")
    if kind in ("float", "double"):
        return _float(value, kind, style)
    if kind in ("int", "long"):
        return str(value)
    if kind in ("string", "enum"):
        return quoted(value)
    if kind in ("bytes", "fixed"):
        return _bytes(value)
    if kind == "array":
        return "[" + ",".join(dumps(schema, node.items, x, style) for x in value) + "]"
    if kind == "map":
        return "{" + ",".join(f"{quoted(k)}:{dumps(schema, node.items, x, style)}" for k, x in value.items()) + "}"
    return "{" + ",".join(f"{quoted(f.name)}:{dumps(schema, f.type, value[f.name], style)}" for f in node.fields) + "}"


def branch_name(node: Node, logical: bool) -> str:
    return f"{node.kind}.{node.logical}" if logical and node.logical and not node.name else node.label()


def _float(value: float, kind: str, style: Style) -> str:
    if math.isnan(value):
        return "null" if style.linkedin_floats else '"NaN"'
    if math.isinf(value):
        sign = "-" if value < 0 else ""
        return f"{sign}1e999" if style.linkedin_floats else f'"{sign}Infinity"'
    text = str(np.float32(value)) if kind == "float" else repr(value)
    return text[:-2] if text.endswith(".0") else text


_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: str) -> str:
    out = []
    for c in text:
        if c in _SHORT:
            out.append(_SHORT[c])
        elif c < " " or c in "  ":
            out.append(f"\\u{ord(c):04x}")
        elif c == "�" or "\ud800" <= c <= "\udfff":
            out.append("\\ufffd")
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def _bytes(value: bytes) -> str:
    return '"' + "".join(_SHORT.get(chr(b)) or (chr(b) if 0x20 <= b < 0x7F else f"\\u00{b:02X}") for b in value) + '"'


def loads(schema: Schema, node: Node, value: Any) -> Any:
    """What json gave as a raw value of the schema."""
    node, kind = schema.of(node), schema.of(node).kind

    def bad():
        return DataError("", f"{value!r} isn't a {node.label()}")

    if kind == "union":
        return _union(schema, node, value)
    if kind == "null":
        if value is not None:
            raise bad()
        return None
    if kind == "boolean":
        if not isinstance(value, bool):
            raise bad()
        return value
    if kind in ("int", "long"):
        if not isinstance(value, _Number):
            raise bad()
        exact = Decimal(value)
        if exact.adjusted() > 40 or exact != exact.to_integral_value():
            raise bad()
        return int(exact)
    if kind in ("float", "double"):
        if value is None:
            return math.nan
        if isinstance(value, _Number):
            out = float(value)
            return math.copysign(math.inf, out) if kind == "float" and abs(out) > 3.4028235677973366e38 else out
        if isinstance(value, str) and value.lower() in _SPECIAL:
            return _SPECIAL[value.lower()]
        raise bad()
    if node.logical == "decimal" and isinstance(value, _Number):
        whole = int((Decimal(value) * Decimal(10) ** node.scale).to_integral_value("ROUND_FLOOR"))
        return whole.to_bytes(node.size or max(1, ((whole if whole >= 0 else ~whole).bit_length() + 8) // 8), "big", signed=True)
    if kind in ("string", "enum", "bytes", "fixed"):
        if not isinstance(value, str) or isinstance(value, _Number):
            raise bad()
        if kind in ("string", "enum"):
            return value
        try:
            return value.encode("latin-1")
        except UnicodeEncodeError as e:
            raise bad() from e
    if kind == "array":
        if not isinstance(value, list):
            raise bad()
        return [loads(schema, node.items, x) for x in value]
    if not isinstance(value, dict):
        raise bad()
    if kind == "map":
        return {k: loads(schema, node.items, x) for k, x in value.items()}
    out = {}
    for f in node.fields:
        try:
            if f.name in value:
                out[f.name] = loads(schema, f.type, value[f.name])
            elif f.has_default:
                out[f.name] = default_value(schema, f.type, f.default)
            else:
                raise DataError("", "the field is missing")
        except DataError as e:
            raise e.under(f.name) from None
    return out


def _union(schema: Schema, node: Node, value: Any) -> tuple[int, Any]:
    branches = [schema.of(b) for b in node.branches]
    if value is None:
        for i, b in enumerate(branches):
            if b.kind == "null":
                return i, None
    if isinstance(value, dict) and len(value) == 1:
        (name, inner), *_ = value.items()
        for i, b in enumerate(branches):
            if name in (b.label(), branch_name(b, True)):
                try:
                    return i, loads(schema, b, inner)
                except DataError:
                    break
    for i, b in enumerate(branches):
        if b.kind == "null" or not _fits(b, value):
            continue
        try:
            raw = loads(schema, b, value)
            encode(schema, b, raw)
            return i, raw
        except (DataError, OverflowError):
            continue
    raise DataError("", f"{value!r} fits no branch of the union")


def _fits(b: Node, value: Any) -> bool:
    if value is None:
        return b.kind in ("float", "double")
    if isinstance(value, bool):
        return b.kind == "boolean"
    if isinstance(value, _Number):
        return b.kind in ("int", "long", "float", "double") or b.logical == "decimal"
    if isinstance(value, str):
        return b.kind in ("string", "bytes", "fixed", "enum") or b.kind in ("float", "double") and value.lower() in _SPECIAL
    return b.kind == "array" if isinstance(value, list) else b.kind in ("map", "record")
