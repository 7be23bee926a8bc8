"""Whether a reader schema can read what a writer schema wrote, and how: compatibility, and plans for the decoder.

A plan is a picklable tree: Leaf, Rec, Arr, Map, Uni, with what schema resolution needs folded in, so that data of the
writer becomes rows of the reader in one pass, and what the reader lacks is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..errors import CompatibilityError, SchemaError
from .mapping import spark_type, union_of
from .schema import NAMED, Field, Node, Schema

#: Which types of a reader take values of a writer's type.
PROMOTIONS = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}


# compatibility


def check_compatibility(writer: Schema, reader: Schema) -> None:
    """Raise CompatibilityError where reader can't read writer's data, whatever the data are."""
    _compatible(writer, writer.root, reader, reader.root, "", set())


def is_compatible(writer: Schema, reader: Schema) -> bool:
    try:
        check_compatibility(writer, reader)
    except CompatibilityError:
        return False
    return True


def compatibility_table(spark, schemas: dict[str, Schema]):
    """writer, reader, compatible, detail for all pairs of some schemas (by name), as a DataFrame."""

    def detail(w: Schema, r: Schema) -> str | None:
        try:
            check_compatibility(w, r)
        except CompatibilityError as e:
            return str(e)
        return None

    rows = [(a, b, detail(w, r)) for a, w in schemas.items() for b, r in schemas.items()]
    return spark.createDataFrame([(a, b, d is None, d) for a, b, d in rows], "writer string, reader string, compatible boolean, detail string")


def kinds_match(w: Node, r: Node) -> bool:
    return w.kind == r.kind or r.kind in PROMOTIONS.get(w.kind, ())


def names_match(w: Node, r: Node) -> bool:
    """By the name without its namespace, or by an alias of the reader."""
    short = w.name.rpartition(".")[2]
    return short == r.name.rpartition(".")[2] or any(a == w.name or a.rpartition(".")[2] == short for a in r.aliases)


def reader_field(w: Field, fields: list[Field]) -> int | None:
    """The reader's field for a writer's: by name, else by alias."""
    for i, f in enumerate(fields):
        if f.name == w.name:
            return i
    return next((i for i, f in enumerate(fields) if w.name in f.aliases), None)


def _compatible(ws: Schema, w: Node, rs: Schema, r: Node, path: str, seen: set[tuple[str, str]]) -> None:
    w, r = ws.of(w), rs.of(r)

    def fail(detail: str):
        raise CompatibilityError(path, r.label(), w.label(), detail)

    if w.kind == "record" == r.kind:
        if (w.name, r.name) in seen:
            return
        seen = seen | {(w.name, r.name)}
    if w.kind == "union":
        for b in w.branches:
            _compatible(ws, b, rs, r, path, seen)
        return
    if r.kind == "union":
        if branch_for(ws, w, rs, r) is None:
            fail("no branch of the reader takes it")
        i = branch_for(ws, w, rs, r)
        return _compatible(ws, w, rs, r.branches[i], path, seen)
    if not kinds_match(w, r):
        fail("the types differ")
    if w.kind != r.kind:
        return
    if w.kind in NAMED and not names_match(w, r):
        fail(f"the names differ: {w.name} and {r.name}")
    if w.kind == "fixed" and w.size != r.size:
        fail(f"the sizes differ: {w.size} and {r.size}")
    if (w.logical == "decimal" or r.logical == "decimal") and w.logical == r.logical and (w.precision, w.scale) != (r.precision, r.scale):
        fail("precision or scale differ")
    if w.kind == "enum" and r.enum_default is None and (unknown := [s for s in w.symbols if s not in r.symbols]):
        fail(f"unknown symbols {unknown} and no default")
    if w.kind in ("array", "map"):
        _compatible(ws, w.items, rs, r.items, f"{path}[]" if w.kind == "array" else f"{path}{{}}", seen)
    if w.kind == "record":
        for f in r.fields:
            below = f"{path}.{f.name}" if path else f.name
            found = next((x for x in w.fields if x.name == f.name), None) or next((x for x in w.fields if x.name in f.aliases), None)
            if found:
                _compatible(ws, found.type, rs, f.type, below, seen)
            elif not f.has_default:
                raise CompatibilityError(below, rs.of(f.type).label(), "nothing", "the writer lacks it and there is no default")


def branch_for(ws: Schema, w: Node, rs: Schema, r: Node) -> int | None:
    """The first branch of a reader's union that takes a writer's type, by kind or by promotion."""
    for i, b in enumerate(r.branches):
        b = rs.of(b)
        if kinds_match(w, b) and (w.kind not in NAMED or names_match(w, b)):
            return i
    return None


# plans


@dataclass
class Leaf:
    """kind and size as written; type: of the column; logical: how the value becomes that; symbols: of an enum, by ordinal
    (None: an error); to: the kind that the reader has."""

    kind: str
    type: T.DataType
    logical: str = ""
    size: int = 0
    scale: int = 0
    symbols: tuple[str | None, ...] = ()
    to: str = ""


@dataclass
class Rec:
    """steps: (field, plan, place in the result or None to skip); defaults: (place, plan, bytes)."""

    type: T.StructType
    steps: list[tuple[str, Any, int | None]] = field(default_factory=list)
    defaults: list[tuple[int, Any, bytes]] = field(default_factory=list)


@dataclass
class Arr:
    type: T.DataType
    item: Any


@dataclass
class Map:
    type: T.DataType
    value: Any


@dataclass
class Uni:
    """branches: (plan, member or None where the value is not in a member); None as a plan: null; Bad: not readable."""

    type: T.DataType
    branches: list[tuple[Any, int | None]]


@dataclass
class Wrap:
    """A value of a plan as one member of a union's struct; member None: as it is."""

    type: T.DataType
    plan: Any
    member: int | None


@dataclass
class Bad:
    """Reading a value is an error: too deep, or a branch that the reader can't take."""

    type: T.DataType
    detail: str


def plan(writer: Schema, reader: Schema | None = None, max_depth: int = 0, raw: frozenset[str] = frozenset()) -> Any:
    """How bytes of writer become values of reader (of writer itself if there is none).

    Writers and readers of one canonical form are taken as they are: the reader's logical types hold, whatever the writer's.
    """
    if reader is None:
        reader = writer
    elif writer.canonical() != reader.canonical():
        check_compatibility(writer, reader)
    return _Planner(writer, reader, max_depth, raw).node(writer.root, reader.root, (), ())


class _Planner:
    def __init__(self, ws: Schema, rs: Schema, max_depth: int, raw: frozenset[str]):
        self.ws, self.rs, self.max_depth, self.raw = ws, rs, max_depth, raw

    def type_of(self, r: Node, above: tuple[str, ...]) -> T.DataType:
        return spark_type(self.rs, r, self.max_depth, self.raw, above)

    def node(self, w: Node, r: Node, above: tuple[str, ...], skipped: tuple[str, ...]) -> Any:
        w, r = self.ws.of(w), self.rs.of(r)
        kind = self.type_of(r, above)
        if w.kind == "union":
            if r.kind != "union":
                return Uni(kind, [(self.node(b, r, above, skipped), None) for b in w.branches])
            return Uni(kind, [self.into_union(b, r, above, skipped, kind) for b in w.branches])
        if r.kind == "union":
            inner, member = self.into_union(w, r, above, skipped, kind)
            return Wrap(kind, inner, member)
        if w.kind == "record":
            if above.count(r.name) > self.max_depth:
                return Bad(kind, f"{r.name} is nested more than {self.max_depth} times")
            return self.record(w, r, kind, (*above, r.name), skipped)
        if w.kind == "array":
            return Arr(kind, self.node(w.items, r.items, above, skipped))
        if w.kind == "map":
            return Map(kind, self.node(w.items, r.items, above, skipped))
        logical = "" if r.logical in self.raw else r.logical
        symbols = tuple(s if s in r.symbols else r.enum_default for s in w.symbols)
        return Leaf(w.kind, kind, logical if w.kind == r.kind or logical not in ("", "uuid") else "", w.size, r.scale, symbols, r.kind)

    def into_union(self, w: Node, r: Node, above: tuple[str, ...], skipped: tuple[str, ...], kind: T.DataType) -> tuple[Any, int | None]:
        """The plan for one of the writer's types in a reader's union, and the member that takes it."""
        w = self.ws.of(w)
        i = branch_for(self.ws, w, self.rs, r)
        if i is None:
            return Bad(kind, f"no branch takes {w.label()}"), None
        members, null = union_of(r)
        if i == null:
            return None, None
        member = None if len(members) == 1 else next(k for k, (at, _) in enumerate(members) if at == i)
        return self.node(w, r.branches[i], above, skipped), member

    def record(self, w: Node, r: Node, kind: T.StructType, above: tuple[str, ...], skipped: tuple[str, ...]) -> Rec:
        from ..operators.rows import default_bytes

        out, filled = Rec(kind), set()
        for f in w.fields:
            i = reader_field(f, r.fields)
            if i is None:
                out.steps.append((f.name, self.skip(f.type, ()), None))
            else:
                out.steps.append((f.name, self.node(f.type, r.fields[i].type, above, skipped), i))
                filled.add(i)
        own = _Planner(self.rs, self.rs, self.max_depth, self.raw)
        for i, f in enumerate(r.fields):
            if i not in filled:
                if not f.has_default:
                    raise SchemaError(f"{r.name}.{f.name} isn't written and has no default")
                out.defaults.append((i, own.node(f.type, f.type, above, skipped), default_bytes(self.rs, f.type, f.default)))
        return out

    def skip(self, w: Node, above: tuple[str, ...]) -> Any:
        """How to pass over a value; recursive types are unrolled as values need (Ref)."""
        w = self.ws.of(w)
        if w.kind == "record":
            if w.name in above:
                return SkipRef(w.name)
            return SkipRec(w.name, [self.skip(f.type, (*above, w.name)) for f in w.fields])
        if w.kind in ("array", "map"):
            return Arr(T.NullType(), self.skip(w.items, above)) if w.kind == "array" else Map(T.NullType(), self.skip(w.items, above))
        if w.kind == "union":
            return Uni(T.NullType(), [(None if b.kind == "null" else self.skip(b, above), None) for b in w.branches])
        return Leaf(w.kind, T.NullType(), "", w.size, 0, w.symbols, w.kind)


@dataclass
class SkipRec:
    name: str
    parts: list[Any]


@dataclass
class SkipRef:
    name: str


def resolve(writer: Schema, reader: Schema) -> Any:
    """The plan for reading writer's data as reader, writer first."""
    return plan(writer, reader)


def pruned(schema: Schema, columns: list[str]) -> Schema:
    """The schema of records with these fields only: as a reader schema it makes the decoder skip all others."""
    from .schema import build

    if schema.root.kind != "record":
        raise SchemaError("only records can be pruned")
    fields = {f.name: f for f in schema.root.fields}
    if missing := [c for c in columns if c not in fields]:
        raise SchemaError(f"no fields {missing}")
    own = Node(**{**schema.root.__dict__, "fields": [_spelled(schema, fields[c]) for c in columns]})
    return build(own)


def _spelled(schema: Schema, f: Field) -> Field:
    """A field whose type doesn't refer to what another field may have defined."""
    return Field(f.name, _inline(schema, f.type, ()), f.aliases, f.doc, f.order, f.default, dict(f.props))


def _inline(schema: Schema, node: Node, above: tuple[str, ...]) -> Node:
    if node.kind == "ref":
        if node.name in above:
            return node
        node = schema.of(node)
    inner = (*above, node.name) if node.name else above
    return Node(**{**node.__dict__, "fields": [Field(f.name, _inline(schema, f.type, inner), f.aliases, f.doc, f.order, f.default, dict(f.props)) for f in node.fields], "items": _inline(schema, node.items, inner) if node.items else None, "branches": [_inline(schema, b, inner) for b in node.branches]})
