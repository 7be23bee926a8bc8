"""Encoding an Arrow array to a column of bytes: each part of a value becomes ragged bytes (sizes and data of all rows), and
parts are interleaved row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import DataError
from ..plans.mapping import union_of
from ..plans.schema import Node, Schema
from .decode import offsets_of, ranges
from .rows import default_bytes, write_long

U64 = np.uint64
#: Rows are taken in runs of about so many bytes.
RUN_BYTES = 4 << 20
#: Rows of more bytes on average are copied one by one: places of single bytes take 8 bytes each, several times.
LONG = 64


class Ragged:
    """sizes: bytes of each row; data: all of them."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray):
        self.sizes, self.data = sizes, data

    @staticmethod
    def same(raw: bytes, n: int) -> Ragged:
        return Ragged(np.full(n, len(raw), np.int64), np.tile(np.frombuffer(raw, np.uint8), n))

    @staticmethod
    def rows(values: np.ndarray) -> Ragged:
        """Of equally long rows."""
        return Ragged(np.full(len(values), values.shape[1] if values.ndim > 1 else 1, np.int64), np.ascontiguousarray(values).reshape(-1))

    def among(self, rows: np.ndarray, n: int) -> Ragged:
        sizes = np.zeros(n, np.int64)
        sizes[rows] = self.sizes
        return Ragged(sizes, self.data)

    def grouped(self, counts: np.ndarray) -> Ragged:
        """Rows of counts[i] of these rows each."""
        ends = np.concatenate(([0], np.cumsum(self.sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        return Ragged(np.diff(ends), self.data)

    @staticmethod
    def joined(parts: list[Ragged], n: int) -> Ragged:
        parts = [p for p in parts if len(p.data)]
        if len(parts) == 1:
            return parts[0]
        total = sum((p.sizes for p in parts), np.zeros(n, np.int64))
        at = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint8)
        for p in parts:
            width = p.sizes[0] if n and (p.sizes == p.sizes[0]).all() else -1
            if width == 1:
                out[at] = p.data
            elif len(p.data) > LONG * n:
                into, data, ends = memoryview(out), memoryview(p.data), np.cumsum(p.sizes)
                for a, b, c, d in zip(at.tolist(), (at + p.sizes).tolist(), (ends - p.sizes).tolist(), ends.tolist(), strict=True):
                    into[a:b] = data[c:d]
            else:
                out[ranges(at, p.sizes)] = p.data
            at = at + p.sizes
        return Ragged(total, out)

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(offsets_of(self.sizes)), pa.py_buffer(self.data)])


def varint(values: np.ndarray) -> Ragged:
    """Zigzag numbers of 1 to 10 bytes."""
    values = values.astype(np.int64)
    z = (values.view(U64) << U64(1)) ^ (values >> 63).view(U64)
    if not len(z) or z.max() < 128:
        return Ragged.rows(z.astype(np.uint8))
    sizes = np.ones(len(z), np.int64)
    for i in range(1, 10):
        more = z >= U64(1 << 7 * i)
        if not more.any():
            break
        sizes += more
    data = np.empty(int(sizes.sum()), np.uint8)
    at = np.cumsum(sizes) - sizes
    left = np.arange(len(z))
    for i in range(int(sizes.max())):
        b = (z[left] & U64(0x7F)).astype(np.uint8)
        b[sizes[left] > i + 1] |= 0x80
        data[at[left] + i] = b
        left = left[sizes[left] > i + 1]
        z[left] >>= U64(7)
    return Ragged(sizes, data)


def encode_column(schema: Schema, column: pa.Array, node: Node | None = None) -> pa.Array:
    """A binary array of the encoded rows; null rows are null unless the schema has null for them."""
    node = schema.of(schema.root if node is None else node)
    nullable = node.kind == "null" or node.kind == "union" and any(b.kind == "null" for b in node.branches)
    if column.null_count and not nullable:
        rows = np.flatnonzero(np.asarray(column.is_valid()))
        there = encode_column(schema, column.take(pa.array(rows)), node)
        at = np.full(len(column), -1, np.int64)
        at[rows] = np.arange(len(rows))
        return there.take(pa.array(at, mask=at < 0))
    step = max(1, int(len(column) * RUN_BYTES / max(column.nbytes, 1)))
    parts = [encode(schema, node, column.slice(i, step)).array() for i in range(0, len(column), step)]
    return pa.concat_arrays(parts) if parts else pa.nulls(0, pa.binary())


def encode(schema: Schema, node: Node, column: pa.Array) -> Ragged:
    node = schema.of(node)
    n = len(column)
    if node.kind == "null":
        return Ragged(np.zeros(n, np.int64), np.empty(0, np.uint8))
    if node.kind == "union":
        return _union(schema, node, column)
    if column.null_count:
        raise DataError("", f"null isn't a {node.label()}")
    if node.kind == "record":
        return _record(schema, node, column)
    if node.kind in ("array", "map"):
        offsets = np.asarray(column.offsets).astype(np.int64)
        counts, first, last = np.diff(offsets), int(offsets[0]), int(offsets[-1])
        if node.kind == "array":
            items = encode(schema, node.items, column.values.slice(first, last - first))
        else:
            keys, values = column.keys.slice(first, last - first), column.items.slice(first, last - first)
            items = Ragged.joined([_sized(keys), encode(schema, node.items, values)], last - first)
        own = np.flatnonzero(counts)
        return Ragged.joined([varint(counts[own]).among(own, n), items.grouped(counts), Ragged.same(b"\0", n)], n)
    return _leaf(node, column)


def _record(schema: Schema, node: Node, column: pa.Array) -> Ragged:
    n, parts = len(column), []
    if not pa.types.is_struct(column.type):
        raise DataError("", f"{column.type} isn't a record")
    names = [f.name for f in column.type]
    for f in node.fields:
        try:
            if f.name in names:
                values = column.field(names.index(f.name))
                parts.append(encode(schema, f.type, values))
            elif f.has_default:
                parts.append(Ragged.same(default_bytes(schema, f.type, f.default), n))
            else:
                raise DataError("", "the value is missing and has no default")
        except DataError as e:
            raise e.under(f.name) from None
    return Ragged.joined(parts, n) if parts else Ragged(np.zeros(n, np.int64), np.empty(0, np.uint8))


def _union(schema: Schema, node: Node, column: pa.Array) -> Ragged:
    n, (members, null) = len(column), union_of(node)
    valid, parts, done = np.asarray(column.is_valid()), [], np.zeros(n, bool)
    if len(members) == 1:
        cases = [(members[0], np.flatnonzero(valid), column)]
    elif pa.types.is_struct(column.type) and [f.name for f in column.type] == [f"member{k}" for k in range(len(members))]:
        cases = []
        for k, member in enumerate(members):
            values = column.field(k)
            rows = np.flatnonzero(valid & ~done & np.asarray(values.is_valid()))
            done[rows] = True
            cases.append((member, rows, values))
    else:  # by value: the first branch that takes it
        cases, left = [], np.flatnonzero(valid)
        for member in members:
            fits = _fitting(schema, member[1], column.take(pa.array(left)))
            cases.append((member, left[fits], column))
            left = left[~fits]
        if len(left):
            raise DataError("", f"{column[int(left[0])].as_py()!r} fits no branch of the union")
    done[:] = False
    for (i, b), rows, values in cases:
        done[rows] = True
        if len(rows):
            own = values if len(rows) == n and not values.null_count else values.take(pa.array(rows))
            parts.append(Ragged.same(write_long(i), len(rows)).among(rows, n))
            parts.append(encode(schema, b, own).among(rows, n))
    rest = np.flatnonzero(~done)
    if len(rest):
        if null is None:
            raise DataError("", "null isn't in the union")
        parts.append(Ragged.same(write_long(null), len(rest)).among(rest, n))
    return Ragged.joined(parts, n) if parts else Ragged(np.zeros(n, np.int64), np.empty(0, np.uint8))


def _fitting(schema: Schema, node: Node, column: pa.Array) -> np.ndarray:
    """Which values a branch takes."""
    n = len(column)
    try:
        if n:
            encode(schema, node, column)
        return np.ones(n, bool)
    except (DataError, pa.ArrowException, AttributeError):
        if n == 1:
            return np.zeros(1, bool)
    return np.concatenate((_fitting(schema, node, column.slice(0, n // 2)), _fitting(schema, node, column.slice(n // 2))))


def _sized(column: pa.Array) -> Ragged:
    """Byte lengths and bytes of a binary or string column."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    if not len(column):
        return Ragged(np.zeros(0, np.int64), np.empty(0, np.uint8))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    sizes = np.diff(offsets)
    return Ragged.joined([varint(sizes), Ragged(sizes, data)], len(column))


def _leaf(node: Node, column: pa.Array) -> Ragged:
    kind, t = node.kind, column.type
    if kind == "boolean":
        return Ragged.rows(np.asarray(column.cast(pa.uint8())))
    if kind in ("int", "long"):
        return varint(_whole_numbers(node, column))
    if kind in ("float", "double"):
        return Ragged.rows(_floats(kind, column))
    if kind == "enum":
        if pa.types.is_integer(t):
            at = np.asarray(column).astype(np.int64)
        else:
            at = np.asarray(pc.fill_null(pc.index_in(column, pa.array(node.symbols)), -1)).astype(np.int64)
        if ((at < 0) | (at >= len(node.symbols))).any():
            raise DataError("", f"{column[int(np.argmax((at < 0) | (at >= len(node.symbols))))].as_py()!r} isn't a symbol of {node.name}")
        return varint(at)
    if node.logical == "decimal" and (pa.types.is_decimal(t) or pa.types.is_floating(t) or pa.types.is_string(t) or pa.types.is_integer(t)):
        return _decimals(node, column)
    if kind == "fixed":
        if node.logical == "uuid" and pa.types.is_string(t):
            return Ragged.rows(_uuids(column))
        if node.logical == "duration" and pa.types.is_struct(t):
            parts = [np.asarray(column.field(i).cast(pa.int64())) for i in range(3)]
            if any(((p < 0) | (p >= 1 << 32)).any() for p in parts):
                raise DataError("", "a duration's parts must be from 0 to 2**32 - 1")
            return Ragged.rows(np.stack([p.astype("<u4") for p in parts], axis=1).view(np.uint8))
        column = column.cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        if (np.diff(offsets) != node.size).any():
            raise DataError("", f"{int(np.diff(offsets)[np.diff(offsets) != node.size][0])} bytes for a fixed of {node.size}")
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
        return Ragged(np.diff(offsets), data)
    if kind == "string" and not (pa.types.is_string(t) or pa.types.is_binary(t)):
        raise DataError("", f"{t} isn't a string")
    return _sized(column)


def _whole_numbers(node: Node, column: pa.Array) -> np.ndarray:
    """Numbers, dates, times and timestamps as the int or long that stands for them, rounded down."""
    t, logical = column.type, node.logical
    if pa.types.is_date(t):
        return np.asarray(column.cast(pa.date32()).view(pa.int32())).astype(np.int64)
    if pa.types.is_timestamp(t) or pa.types.is_duration(t) or pa.types.is_time(t):
        unit = column.type.unit
        raw = np.asarray((column.cast(pa.time64("us")) if pa.types.is_time(t) else column).view(pa.int64()))
        micros = {"s": 1_000_000, "ms": 1000, "us": 1, "ns": 1}[unit if not pa.types.is_time(t) else "us"]
        raw = raw // 1000 if unit == "ns" and not pa.types.is_time(t) else raw * micros
        if logical == "date":
            out = raw // 86_400_000_000
        elif logical.endswith("-nanos"):
            if len(raw) and max(abs(int(raw.max())), abs(int(raw.min()))) > (2**63 - 1) // 1000:
                raise DataError("", f"{logical} out of range")
            out = raw * 1000
        else:
            out = raw // 1000 if logical.endswith("-millis") else raw
    else:
        if pa.types.is_decimal(t) or pa.types.is_floating(t):
            whole = pc.floor(column)
            if not pc.all(pc.equal(whole, column)).as_py() and len(column):
                raise DataError("", f"a number that isn't whole in a {node.kind}")
            try:
                column = column.cast(pa.int64())
            except pa.ArrowInvalid as e:
                raise DataError("", f"a number beyond {node.kind}") from e
        elif not pa.types.is_integer(t):
            raise DataError("", f"{t} isn't a {node.kind}")
        out = np.asarray(column).astype(np.int64)
    if node.kind == "int" and len(out) and (out.max() >= 1 << 31 or out.min() < -(1 << 31)):
        raise DataError("", f"{int(out.max())} or {int(out.min())} is beyond int")
    return out


def _floats(kind: str, column: pa.Array) -> np.ndarray:
    t = column.type
    if pa.types.is_integer(t):
        out, most = np.asarray(column).astype(np.int64), 1 << (24 if kind == "float" else 53)
        if len(out) and (out.max() > most or out.min() < -most):
            raise DataError("", f"a whole number that a {kind} can't hold")
    elif pa.types.is_floating(t):
        out = np.asarray(column)
    elif pa.types.is_decimal(t):
        out = np.asarray(column.cast(pa.float64()))
    else:
        raise DataError("", f"{t} isn't a {kind}")
    if kind == "float":
        with np.errstate(over="ignore"):
            short = out.astype("<f4")
        if (np.isinf(short) & np.isfinite(out.astype(np.float64))).any():
            raise DataError("", "a number beyond float")
        return short.view(np.uint8).reshape(len(out), 4)
    return out.astype("<f8").view(np.uint8).reshape(len(out), 8)


def _decimals(node: Node, column: pa.Array) -> Ragged:
    """The numbers times ten to the scale, rounded down, as big-endian two's complement."""
    t = column.type
    if not (pa.types.is_decimal(t) and t.scale == node.scale and t.bit_width == 128):
        from fractions import Fraction

        whole = [int((Fraction(str(v) if not isinstance(v, float) else v) * 10**node.scale) // 1) for v in column.to_pylist()]
        raw = []
        for v in whole:
            size = node.size or max(1, ((v if v >= 0 else ~v).bit_length() + 8) // 8)
            try:
                raw.append(v.to_bytes(size, "big", signed=True))
            except OverflowError as e:
                raise DataError("", f"{v} doesn't fit {size} bytes") from e
        out = pa.array(raw, pa.binary())
        return _sized(out) if node.kind == "bytes" else Ragged(np.full(len(raw), node.size, np.int64), np.frombuffer(b"".join(raw), np.uint8))
    n = len(column)
    big = np.frombuffer(column.buffers()[1], np.uint8)[16 * column.offset : 16 * (column.offset + n)].reshape(n, 16)[:, ::-1]
    sign = np.where(big[:, 0] & 0x80, 0xFF, 0).astype(np.uint8)
    # bytes that only repeat the sign, as long as the next byte has it as well
    spare = (big[:, :-1] == sign[:, None]) & ((big[:, 1:] & 0x80) == (sign[:, None] & 0x80))
    drop = np.where(spare.all(1), 15, np.argmin(spare, axis=1))
    sizes = 16 - drop
    if node.kind == "fixed":
        if len(sizes) and sizes.max() > node.size:
            raise DataError("", f"a number that doesn't fit {node.size} bytes")
        if node.size <= 16:
            return Ragged.rows(big[:, 16 - node.size :])
        return Ragged.rows(np.hstack([np.repeat(sign[:, None], node.size - 16, axis=1), big]))
    data = big.reshape(-1)[ranges(np.arange(n) * 16 + drop, sizes)]
    return Ragged.joined([varint(sizes), Ragged(sizes, data)], n)


def _uuids(column: pa.Array) -> np.ndarray:
    """16 bytes of each text of 36 characters with its dashes in place."""
    chars = pc.utf8_lower(column).cast(pa.binary())
    if not len(chars):
        return np.empty((0, 16), np.uint8)
    if (np.asarray(pc.binary_length(chars)) != 36).any():
        raise DataError("", "a uuid needs 36 characters")
    offsets = np.frombuffer(chars.buffers()[1], np.int32)[chars.offset : chars.offset + 1]
    text = np.frombuffer(chars.buffers()[2], np.uint8)[offsets[0] : offsets[0] + 36 * len(chars)].reshape(-1, 36)
    value = np.full(256, 255, np.uint8)
    value[ord("0") : ord("9") + 1], value[ord("a") : ord("f") + 1] = np.arange(10), np.arange(10, 16)
    at = [i for i in range(36) if i not in (8, 13, 18, 23)]
    digits = value[text[:, at]]
    if (digits == 255).any() or (text[:, [8, 13, 18, 23]] != ord("-")).any():
        raise DataError("", "not a uuid")
    return digits[:, 0::2] << 4 | digits[:, 1::2]
