"""Decoding a column of bytes to an Arrow array, column by column: every row has a cursor into one buffer, and a step of
the plan moves all cursors at once."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Context, Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from ..errors import DataError, ShortBufferError
from ..plans.mapping import arrow_type
from ..plans.resolve import Arr, Bad, Leaf, Map, Rec, SkipRec, SkipRef, Uni, Wrap

U64 = np.uint64


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Buffer:
    """The bytes of all rows and where each row ends. rows: which ones of the batch they are (None: all)."""

    def __init__(self, data: np.ndarray, end: np.ndarray, rows: np.ndarray | None = None):
        self.data, self.end, self.rows = data, end, rows

    def at(self, rows: np.ndarray | None) -> Buffer:
        return self if rows is None else Buffer(self.data, self.end[rows], rows if self.rows is None else self.rows[rows])

    def refuse(self, bad: np.ndarray, say: Callable[[int], str], error: type[DataError] = DataError) -> None:
        """An error that names the rows which are bad; say(i): what is wrong with row i."""
        own = np.flatnonzero(bad)
        if len(own):
            raise error("", say(own[0]), own if self.rows is None else self.rows[own], lambda k: say(own[k]))

    def need(self, cur: np.ndarray, n: np.ndarray | int) -> None:
        if (np.asarray(n) < 0).any():
            self.refuse(np.broadcast_to(np.asarray(n) < 0, cur.shape), lambda i: "a negative length")
        short = cur + n > self.end
        if short.any():
            self.refuse(short, lambda i: f"needs {int(n[i]) if isinstance(n, np.ndarray) else n} bytes, has {int(self.end[i] - cur[i])}", ShortBufferError)

    def varint(self, cur: np.ndarray, limit: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """The zigzag numbers at the cursors, and the cursors after them."""
        self.need(cur, 1)
        b = self.data[cur] if len(cur) else np.empty(0, np.uint8)
        value, cur = (b & 0x7F).astype(U64), cur + 1
        left = np.flatnonzero(b >= 0x80)
        for i in range(1, limit):
            if not len(left):
                break
            self.at(left).need(cur[left], 1)
            b = self.data[cur[left]]
            if i == limit - 1:
                self.at(left).refuse(b > (0x0F if limit == 5 else 0x01), lambda i: "a varint is too long")
            value[left] |= (b & 0x7F).astype(U64) << U64(7 * i)
            cur[left] += 1
            left = left[b >= 0x80]
        return ((value >> U64(1)) ^ (U64(0) - (value & U64(1)))).view(np.int64), cur

    def fixed(self, cur: np.ndarray, size: int) -> np.ndarray:
        """The size bytes at each cursor."""
        self.need(cur, size)
        if not len(cur):
            return np.empty((0, size), np.uint8)
        return self.data[cur[:, None] + np.arange(size)]

    def slices(self, cur: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
        """A binary or string array of sizes bytes at each cursor."""
        self.need(cur, sizes)
        total = int(sizes.sum())
        if total > 64 * max(len(sizes), 1):
            view = memoryview(self.data)
            data = b"".join(view[a:b] for a, b in zip(cur.tolist(), (cur + sizes).tolist(), strict=True))
        else:
            data = self.data[ranges(cur, sizes)].tobytes()
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        out = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if kind == pa.string():
            try:
                return out.cast(pa.string())
            except pa.ArrowInvalid:
                return pa.array([x.as_py().decode("utf-8", "replace") for x in out], pa.string())
        return out


def cursors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The bytes of a binary column, where its rows begin and end, and which ones aren't null (None: all)."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return data, offsets[:-1].copy(), offsets[1:], np.flatnonzero(np.asarray(column.is_valid())) if column.null_count else None


def decode_rows(plan: Any, data: np.ndarray, cur: np.ndarray, end: np.ndarray, whole: bool = True) -> pa.Array:
    buffer = Buffer(data, end)
    out, after = Decoder(buffer).value(plan, cur, None)
    if whole:
        buffer.refuse(after != end, lambda i: f"{int(end[i] - after[i])} bytes are left over")
    return out


def decode_column(plan: Any, column: pa.Array, whole: bool = True) -> pa.Array:
    """Values of a binary column; null rows are null. whole: bytes left over are an error."""
    data, cur, end, there = cursors(column)
    if there is None:
        return decode_rows(plan, data, cur, end, whole)
    return spread(decode_rows(plan, data, cur[there], end[there], whole), there, len(column))


def spread(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """values at rows of n, null elsewhere."""
    at = np.full(n, -1, np.int64)
    at[rows] = np.arange(len(rows))
    return values.take(pa.array(at, mask=at < 0))


class Decoder:
    def __init__(self, buffer: Buffer):
        self.buffer = buffer
        self.open: dict[str, SkipRec] = {}

    def value(self, plan: Any, cur: np.ndarray, rows: np.ndarray | None) -> tuple[pa.Array | None, np.ndarray]:
        """Values at the cursors of rows (None: all), and the cursors after them. Of a plan that skips: None."""
        return getattr(self, type(plan).__name__.lower())(plan, cur, rows)

    def sub(self, rows: np.ndarray | None, own: np.ndarray) -> np.ndarray:
        return own if rows is None else rows[own]

    def leaf(self, p: Leaf, cur: np.ndarray, rows: np.ndarray | None):
        b, skip = self.buffer.at(rows), isinstance(p.type, T.NullType) and p.kind != "null"
        n = len(cur)
        if p.kind == "null":
            return pa.nulls(n), cur
        if p.kind == "boolean":
            b.need(cur, 1)
            return None if skip else pa.array(b.data[cur] != 0 if n else np.empty(0, bool)), cur + 1
        if p.kind in ("int", "long"):
            value, cur = b.varint(cur, 5 if p.kind == "int" else 10)
            return None if skip else number(value.astype(np.int32) if p.kind == "int" else value, p, b), cur
        if p.kind in ("float", "double"):
            size = 4 if p.kind == "float" else 8
            b.need(cur, size)
            return None if skip else number(b.fixed(cur, size).reshape(-1).view("<f4" if size == 4 else "<f8"), p, b), cur + size
        if p.kind == "enum":
            value, cur = b.varint(cur, 5)
            b.refuse((value < 0) | (value >= len(p.symbols)), lambda i: f"no symbol {int(value[i])} or {int(value[i])}")
            if skip:
                return None, cur
            out = pa.array(p.symbols, pa.string()).take(pa.array(value))
            if out.null_count:
                b.refuse(np.asarray(out.is_null()), lambda i: "a symbol that the reader doesn't have")
            return out, cur
        if p.kind == "fixed":
            b.need(cur, p.size)
            return None if skip else binary(b, cur, np.full(n, p.size), p), cur + p.size
        sizes, cur = b.varint(cur)
        b.need(cur, sizes)
        return None if skip else binary(b, cur, sizes, p), cur + sizes

    def rec(self, p: Rec, cur: np.ndarray, rows: np.ndarray | None):
        out: list[Any] = [None] * len(p.type.fields)
        for name, step, place in p.steps:
            try:
                value, cur = self.value(step, cur, rows)
            except DataError as e:
                raise e.under(name) from None
            if place is not None:
                out[place] = value
        for place, step, raw in p.defaults:
            data = np.frombuffer(raw or b"\0", np.uint8)
            one, _ = Decoder(Buffer(data, np.array([len(raw)]))).value(step, np.array([0]), None)
            out[place] = one.take(pa.array(np.zeros(len(cur), np.int64)))
        kind = arrow_type(p.type)
        if not out:
            return pa.array([{}] * len(cur), kind), cur
        return pa.StructArray.from_arrays([v.cast(f.type) if v.type != f.type else v for v, f in zip(out, kind, strict=True)], fields=list(kind)), cur

    def skiprec(self, p: SkipRec, cur: np.ndarray, rows: np.ndarray | None):
        self.open[p.name] = p
        for part in p.parts:
            _, cur = self.value(part, cur, rows)
        return None, cur

    def skipref(self, p: SkipRef, cur: np.ndarray, rows: np.ndarray | None):
        return self.value(self.open[p.name], cur, rows) if len(cur) else (None, cur)

    def bad(self, p: Bad, cur: np.ndarray, rows: np.ndarray | None):
        self.buffer.at(rows).refuse(np.ones(len(cur), bool), lambda i: p.detail)
        return pa.nulls(0, arrow_type(p.type)), cur

    def wrap(self, p: Wrap, cur: np.ndarray, rows: np.ndarray | None):
        if p.plan is None:
            return pa.nulls(len(cur), arrow_type(p.type)), cur
        value, cur = self.value(p.plan, cur, rows)
        return (value if p.member is None else member_struct(p.type, {p.member: value}, len(cur))), cur

    def uni(self, p: Uni, cur: np.ndarray, rows: np.ndarray | None):
        which, cur = self.buffer.at(rows).varint(cur)
        self.buffer.at(rows).refuse((which < 0) | (which >= len(p.branches)), lambda i: "a union branch that isn't there")
        n, found, skip = len(cur), [], isinstance(p.type, T.NullType)
        for i, (plan, member) in enumerate(p.branches):
            own = np.flatnonzero(which == i)
            if plan is None or not len(own):
                continue
            value, cur[own] = self.value(plan, cur[own], self.sub(rows, own))
            if value is not None:
                found.append((member, own, value))
        if skip:
            return pa.nulls(n) if any(b[0] is None for b in p.branches) or not found else None, cur
        kind = arrow_type(p.type)
        plain = [(own, v if v.type == kind else v.cast(kind)) for member, own, v in found if member is None]
        if plain:
            rows_of, values = np.concatenate([o for o, _ in plain]), pa.concat_arrays([v for _, v in plain])
            if len(rows_of) == n:
                return values.take(pa.array(np.argsort(rows_of, kind="stable"))) if len(plain) > 1 else values, cur
            if not any(member is not None for member, _, _ in found):
                return spread(values, rows_of, n), cur
        if not found or not isinstance(p.type, T.StructType) or all(m is None for m, _, _ in found):
            return pa.nulls(n, kind), cur
        return member_struct(p.type, {m: spread(v, o, n) for m, o, v in found if m is not None}, n), cur

    def blocks(self, cur: np.ndarray, rows: np.ndarray | None, fits: int, items: Any, skip: bool):
        """Walk the blocks of arrays or maps. items(rows of this value, cursors, counts) decodes what is in a block and
        returns the cursors after it."""
        live = np.arange(len(cur))
        while len(live):
            b = self.buffer.at(self.sub(rows, live))
            count, at = b.varint(cur[live])
            sized = np.flatnonzero(count < 0)
            if len(sized):
                b.refuse(count == -(2**63), lambda i: "a block count out of range")
                size, at[sized] = self.buffer.at(self.sub(rows, live[sized])).varint(at[sized])
                count[sized] = -count[sized]
                self.buffer.at(self.sub(rows, live[sized])).need(at[sized], size)
                if skip:
                    at[sized] += size
            cur[live] = at
            done = count == 0
            if fits:
                over = ~done & (count > b.end - at)
                if skip:
                    over[sized] = False
                b.refuse(over, lambda i: "a block of more items than there are bytes", ShortBufferError)
            else:
                b.refuse(count > MOST_WEIGHTLESS, lambda i: f"a block of more than {MOST_WEIGHTLESS} items of no bytes")
            todo = ~done
            if skip and len(sized):
                todo[sized] = False
            own = live[todo]
            if len(own):
                cur[own] = items(own, cur[own], count[todo])
            live = live[~done]
        return cur

    def arr(self, p: Arr, cur: np.ndarray, rows: np.ndarray | None):
        skip, n, cur = isinstance(p.type, T.NullType), len(cur), cur.copy()
        parts: list[pa.Array] = []
        of: list[np.ndarray] = []

        def items(own: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
            size = width(p.item)
            if size:
                b = self.buffer.at(self.sub(rows, own))
                b.need(at, count * size)
                if not skip:
                    each = np.repeat(at, count) + size * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
                    wide = self.sub(rows, np.repeat(own, count))
                    parts.append(self.value(p.item, each, wide)[0])
                    of.append(np.repeat(own, count))
                return at + count * size
            return self.in_turn(own, at, count, rows, [p.item], [parts], of)

        cur = self.blocks(cur, rows, not weightless(p.item), items, skip)
        if skip:
            return None, cur
        kind = arrow_type(p.type)
        counts, values = gathered(of, parts, n, kind.value_type)
        return pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), values, type=kind), cur

    def in_turn(self, own: np.ndarray, at: np.ndarray, count: np.ndarray, rows: np.ndarray | None, plans: list, parts: list[list], of: list) -> np.ndarray:
        """The first items of all rows, then the second, ..., for items whose size isn't known."""
        at, order = at.copy(), np.argsort(-count, kind="stable")
        counts = count[order]
        for i in range(int(counts[0]) if len(counts) else 0):
            active = order[: int(np.searchsorted(-counts, -i, "left"))]
            now, here = at[active], self.sub(rows, own[active])
            for plan, into in zip(plans, parts, strict=True):
                value, now = self.value(plan, now, here)
                if value is not None:
                    into.append(value)
            at[active] = now
            of.append(own[active])
        return at

    def map(self, p: Map, cur: np.ndarray, rows: np.ndarray | None):
        skip, n, cur = isinstance(p.type, T.NullType), len(cur), cur.copy()
        keys: list[pa.Array] = []
        values: list[pa.Array] = []
        of: list[np.ndarray] = []
        key = Leaf("string", T.NullType() if skip else T.StringType(), to="string")
        cur = self.blocks(cur, rows, True, lambda own, at, count: self.in_turn(own, at, count, rows, [key, p.value], [keys, values], of), skip)
        if skip:
            return None, cur
        kind = arrow_type(p.type)
        counts, k = gathered(of, keys, n, pa.string())
        _, v = gathered(of, values, n, kind.item_type)
        row = np.repeat(np.arange(n), counts)
        if len(row):  # of equal keys the last one holds
            _, place = np.unique(np.asarray(k.dictionary_encode().indices), return_inverse=True)
            code = row * (int(place.max()) + 1) + place
            last = len(code) - 1 - np.unique(code[::-1], return_index=True)[1]
            if len(last) < len(code):
                last.sort()
                k, v, counts = k.take(pa.array(last)), v.take(pa.array(last)), np.bincount(row[last], minlength=n)
        return pa.MapArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), k, v, type=kind), cur


#: Items of no bytes (nulls, empty records) that a block may have; of others it can't have more than it has bytes.
MOST_WEIGHTLESS = 1 << 20


def weightless(plan: Any) -> bool:
    """Whether values take no bytes."""
    if isinstance(plan, Rec):
        return all(weightless(step) for _, step, _ in plan.steps)
    if isinstance(plan, SkipRec):
        return all(map(weightless, plan.parts))
    if isinstance(plan, Wrap):
        return plan.plan is None or weightless(plan.plan)
    return isinstance(plan, Leaf) and plan.kind == "null"


def width(plan: Any) -> int:
    """The size of each value, 0 if values have sizes of their own."""
    if isinstance(plan, Leaf):
        return {"boolean": 1, "float": 4, "double": 8, "fixed": plan.size}.get(plan.kind, 0)
    return 0


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def gathered(of: list[np.ndarray], parts: list[pa.Array], n: int, kind: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    """How many items each row has, and the items in the order of rows."""
    if not parts:
        return np.zeros(n, np.int64), pa.nulls(0, kind)
    rows, values = np.concatenate(of), pa.concat_arrays([x if x.type == kind else x.cast(kind) for x in parts])
    if (rows[1:] < rows[:-1]).any():
        values = values.take(pa.array(np.argsort(rows, kind="stable")))
    return np.bincount(rows, minlength=n), values


def member_struct(kind: T.StructType, members: dict[int, pa.Array], n: int) -> pa.Array:
    fields = list(arrow_type(kind))
    arrays = [members.get(i, pa.nulls(n, f.type)) for i, f in enumerate(fields)]
    arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, fields, strict=True)]
    none = np.ones(n, bool)
    for m in members.values():
        none &= ~np.asarray(m.is_valid())
    return pa.StructArray.from_arrays(arrays, fields=fields, mask=pa.array(none))


def number(value: np.ndarray, p: Leaf, b: Buffer) -> pa.Array:
    """A number as the reader's type or logical type."""
    if p.to in ("long", "int") and p.logical:
        ints = value.astype(np.int64)
        if isinstance(p.type, T.DateType):
            return pa.array(value.astype(np.int32), pa.int32()).cast(pa.date32())
        if p.logical.endswith("-millis"):
            most = (2**63 - 1) // 1000
            b.refuse((ints > most) | (ints < -most), lambda i: f"{p.logical} out of range")
            ints = ints * 1000
        kind = arrow_type(p.type)
        if pa.types.is_timestamp(kind) or pa.types.is_duration(kind):
            return pa.array(ints, pa.int64()).view(kind)
    target = {"int": np.int32, "long": np.int64, "float": np.float32, "double": np.float64}[p.to or p.kind]
    return pa.array(value.astype(target))


def binary(b: Buffer, cur: np.ndarray, sizes: np.ndarray, p: Leaf) -> pa.Array:
    """Bytes as the reader's type or logical type."""
    if isinstance(p.type, T.DecimalType):
        return decimals(b, cur, sizes, p.type)
    if p.kind == "fixed" and p.logical == "uuid":
        raw = b.fixed(cur, 16)
        digits = np.frombuffer(b"0123456789abcdef", np.uint8)
        out = np.full((len(raw), 36), ord("-"), np.uint8)
        at = [i for i in range(36) if i not in (8, 13, 18, 23)]
        out[:, at[0::2]], out[:, at[1::2]] = digits[raw >> 4], digits[raw & 15]
        offsets = np.arange(0, 36 * len(raw) + 1, 36, dtype=np.int32)
        return pa.Array.from_buffers(pa.string(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
    if p.kind == "fixed" and p.logical == "duration":
        parts = b.fixed(cur, 12).reshape(-1).view("<u4").reshape(-1, 3).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(parts[:, i])) for i in range(3)], ["months", "days", "millis"])
    return b.slices(cur, sizes, pa.string() if isinstance(p.type, T.StringType) else pa.binary())


def decimals(b: Buffer, cur: np.ndarray, sizes: np.ndarray, kind: T.DecimalType) -> pa.Array:
    """Big-endian two's complement numbers of any size; no bytes are 0. Out of the precision is an error."""
    b.need(cur, sizes)
    n, out = len(cur), np.zeros((len(cur), 16), np.uint8)
    beyond = lambda i: f"a number beyond decimal({kind.precision},{kind.scale})"
    full = np.flatnonzero(sizes > 0)
    if len(full):
        out[full] = np.where(b.data[cur[full]] & 0x80, 0xFF, 0).astype(np.uint8)[:, None]
        for i in range(int(min(16, sizes.max()))):
            own = full[sizes[full] > i]
            out[own, 15 - i] = b.data[cur[own] + sizes[own] - 1 - i]
        wide = np.zeros(n, bool)
        for r in np.flatnonzero(sizes > 16):
            raw = b.data[cur[r] : cur[r] + sizes[r]].tobytes()
            wide[r] = not -(1 << 127) <= int.from_bytes(raw, "big", signed=True) < 1 << 127
        b.refuse(wide, beyond)
    little = np.ascontiguousarray(out[:, ::-1])
    wide = pa.Array.from_buffers(pa.decimal128(38, kind.scale), n, [None, pa.py_buffer(little.tobytes())])
    if kind.precision == 38:
        return wide
    try:
        return wide.cast(pa.decimal128(kind.precision, kind.scale))
    except pa.ArrowInvalid:
        most = Decimal(10**kind.precision).scaleb(-kind.scale, Context(prec=76))
        b.refuse(~np.asarray(pc.and_(pc.less(wide, most), pc.greater(wide, -most))), beyond)
        raise


def decode_many(plan: Any, column: pa.Array) -> pa.Array:
    """Each row's bytes as a list of values one after another."""
    column = column.cast(pa.binary())
    n, valid = len(column), np.flatnonzero(np.asarray(column.is_valid()))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(1, np.uint8)
    cur, end = offsets[:-1].copy(), offsets[1:]
    parts, of, live = [], [], valid[cur[valid] < end[valid]]
    while len(live):
        value, after = Decoder(Buffer(data, end[live])).value(plan, cur[live].copy(), None)
        if (after == cur[live]).any():
            raise DataError("", "values of no bytes can't be counted")
        parts.append(value)
        of.append(live)
        cur[live] = after
        live = live[after < end[live]]
    kind = arrow_type(plan.type)
    counts, values = gathered(of, parts, n, kind)
    return pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), values, type=pa.list_(pa.field("element", kind)), mask=pa.array(~np.isin(np.arange(n), valid)) if len(valid) < n else None)


def valid_rows(plan: Any, column: pa.Array, reasons: bool = True) -> tuple[pa.Array, list[str | None]]:
    """As decode_column, but rows that can't be read are null; and what is wrong with each row, if reasons are asked for.

    An error names all rows that are at fault at its step, and the others are read again without them: as often as there are
    steps that fail, not as there are rows."""
    data, cur, end, there = cursors(column)
    n = len(column)
    why: list[str | None] = [None] * n
    todo, done, parts = [np.arange(n) if there is None else there], [], []
    while todo:
        live = todo.pop()
        try:
            parts.append(decode_rows(plan, data, cur[live], end[live]))
            done.append(live)
        except DataError as e:
            if e.rows is None and len(live) > 1:
                todo += [live[len(live) // 2 :], live[: len(live) // 2]]
                continue
            rows, first = (np.zeros(1, np.int64), [0]) if e.rows is None else np.unique(e.rows, return_index=True)
            if reasons:
                for r, k in zip(live[rows].tolist(), first, strict=True):
                    why[r] = str(e) if e.say is None else str(DataError(e.path, e.say(k)))
            if len(rows) < len(live):
                todo.append(np.delete(live, rows))
    if len(done) == 1 and len(done[0]) == n:
        return parts[0], why
    return (spread(pa.concat_arrays(parts), np.concatenate(done), n) if parts else pa.nulls(n, arrow_type(plan.type))), why
