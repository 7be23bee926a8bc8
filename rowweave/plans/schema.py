"""Schemas declared in JSON: parsing, names, defaults, logical types, canonical form, fingerprints, registry."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import SchemaError

PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
NAMED = ("record", "enum", "fixed")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class _Missing:
    """That a field has no default; the same object after it has travelled to another process."""

    def __reduce__(self) -> str:
        return "_MISSING"


_MISSING = _Missing()
#: Logical types by the type below them.
_LOGICAL_BASE = {
    "date": "int",
    "time-millis": "int",
    "time-micros": "long",
    "timestamp-millis": "long",
    "timestamp-micros": "long",
    "timestamp-nanos": "long",
    "local-timestamp-millis": "long",
    "local-timestamp-micros": "long",
    "local-timestamp-nanos": "long",
    "big-decimal": "bytes",
}
#: Keys of a schema object; any other is a property.
_KEYS = {"type", "name", "namespace", "aliases", "doc", "fields", "symbols", "items", "values", "size", "default", "logicaltype", "precision", "scale"}
_FIELD_KEYS = {"name", "type", "aliases", "doc", "default", "order"}


@dataclass
class Field:
    name: str
    type: Node
    aliases: tuple[str, ...] = ()
    doc: str = ""
    order: str = ""
    default: Any = _MISSING
    props: dict = field(default_factory=dict)

    @property
    def has_default(self) -> bool:
        return self.default is not _MISSING


@dataclass
class Node:
    """kind: a primitive, record, enum, fixed, array, map, union, or ref (a named type that is defined elsewhere)."""

    kind: str
    name: str = ""
    aliases: tuple[str, ...] = ()
    doc: str = ""
    logical: str = ""
    precision: int = 0
    scale: int = 0
    size: int = 0
    symbols: tuple[str, ...] = ()
    enum_default: str | None = None
    fields: list[Field] = field(default_factory=list)
    items: Node | None = None
    branches: list[Node] = field(default_factory=list)
    error: bool = False
    props: dict = field(default_factory=dict)

    def label(self) -> str:
        return self.name or self.kind


@dataclass
class Schema:
    root: Node
    named: dict[str, Node]
    text: str

    def of(self, node: Node) -> Node:
        """The node itself, or the type that it refers to."""
        return self.named[node.name] if node.kind == "ref" else node

    def canonical(self) -> str:
        return canonical(self)

    def fingerprint(self, algorithm: str = "rabin") -> bytes:
        """Of the canonical form: rabin (8 bytes, most significant first) or any algorithm of hashlib."""
        text = self.canonical().encode()
        return rabin(text).to_bytes(8, "big") if algorithm == "rabin" else hashlib.new(algorithm, text).digest()

    def to_json(self) -> str:
        """The whole schema, with all that the canonical form leaves out."""
        return json.dumps(_full(self.root, set()), ensure_ascii=False, separators=(",", ":"))

    def __str__(self) -> str:
        return self.text


def parse(text: str | dict | list, lax_names: bool | Callable[[str], bool] = False, known: dict[str, Node] | None = None, keep_logical: frozenset[str] | set[str] = frozenset()) -> Schema:
    """Parse a schema. lax_names: any name that isn't empty will do, or each part that a predicate accepts. known: types that
    other schemas have defined. keep_logical: logical types that aren't known here but are kept for custom types."""
    if isinstance(text, str):
        source = text.strip()
        if re.fullmatch(r"[A-Za-z_][\w.]*", source):
            value: Any = source
        else:
            try:
                value = json.loads(source)
            except ValueError as e:
                raise SchemaError(f"not JSON: {e}") from e
    else:
        value, text = text, json.dumps(text)
    builder = _Builder(lax_names, dict(known or {}), frozenset(keep_logical))
    root = builder.build(value, "")
    builder.finish()
    own = {}
    schema = Schema(root, builder.named, text)
    _collect(schema, root, own)
    return Schema(root, own, text)


def _collect(schema: Schema, node: Node, seen: dict[str, Node]) -> None:
    """The named types that are used below node."""
    if node.kind == "ref":
        node = schema.named[node.name]
    if node.kind in NAMED:
        if node.name in seen:
            return
        seen[node.name] = node
    for child in [*(f.type for f in node.fields), *([node.items] if node.items else []), *node.branches]:
        _collect(schema, child, seen)


class _Builder:
    def __init__(self, lax: bool | Callable[[str], bool], named: dict[str, Node], keep_logical: frozenset[str]):
        self.lax, self.named, self.keep_logical = lax, named, keep_logical
        self.later: list[tuple[str, str, Node]] = []  # references from fields and unions that may be defined further on
        self.defaults: list[tuple[Node, Any, str]] = []

    def check_name(self, name: Any, what: str) -> None:
        if not isinstance(name, str) or not name:
            raise SchemaError(f"{what} has no valid name: {name!r}")
        for part in name.split("."):
            ok = bool(part) if self.lax is True else self.lax(part) if callable(self.lax) else _NAME.match(part)
            if not ok:
                raise SchemaError(f"invalid {what} name {name!r}")

    def build(self, value: Any, space: str, forward: bool = False) -> Node:
        if isinstance(value, str):
            return self.reference(value, space, forward)
        if isinstance(value, list):
            return self.union(value, space)
        if not isinstance(value, dict):
            raise SchemaError(f"not a schema: {value!r}")
        return self.complex({k.lower() if k.lower() in _KEYS else k: v for k, v in value.items()}, space, forward)

    def reference(self, name: str, space: str, forward: bool) -> Node:
        if name in PRIMITIVES:
            return Node(name)
        found = self.lookup(name, space)
        if found:
            return Node("ref", name=found)
        if not forward:
            raise SchemaError(f"unknown type {name!r}")
        node = Node("ref", name=name)
        self.later.append((name, space, node))
        return node

    def lookup(self, name: str, space: str) -> str | None:
        if name in self.named:
            return name
        return f"{space}.{name}" if space and f"{space}.{name}" in self.named else None

    def union(self, branches: list, space: str) -> Node:
        node = Node("union", branches=[self.build(b, space, True) for b in branches])
        if not branches:
            raise SchemaError("a union needs a branch")
        seen = set()
        for b in node.branches:
            if b.kind == "union":
                raise SchemaError("a union can't hold a union")
            if b.label() in seen:
                raise SchemaError(f"a union has {b.label()!r} twice")
            seen.add(b.label())
        return node

    def complex(self, o: dict, space: str, forward: bool) -> Node:
        kind = o.get("type")
        if isinstance(kind, (dict, list)):  # a schema in a schema
            if set(o) - {"type"} & _KEYS:
                raise SchemaError(f"type must be a name beside {sorted(set(o) - {'type'})}")
            return self.build(kind, space, forward)
        if not isinstance(kind, str):
            raise SchemaError("a schema object needs a type")
        node = Node("record" if kind == "error" else kind, error=kind == "error", doc=o.get("doc") or "", props={k: v for k, v in o.items() if k not in _KEYS})
        logical = self.logical(o, kind, node)
        if kind in PRIMITIVES:
            self.only(o, kind, ("type", "logicaltype", "precision", "scale", "doc", "name", "namespace", "aliases", "default"))
            node.logical = logical
            return node
        if kind in ("record", "error"):
            return self.record(o, space, node, logical)
        if kind == "enum":
            self.only(o, kind, ("type", "name", "namespace", "aliases", "doc", "symbols", "default", "logicaltype"))
            self.name(o, space, node, "enum")
            symbols = o.get("symbols")
            if not isinstance(symbols, list) or not symbols or len(set(map(str, symbols))) != len(symbols):
                raise SchemaError(f"enum {node.name} needs symbols that differ")
            for s in symbols:
                self.check_name(s, "symbol")
                if "." in s:
                    raise SchemaError(f"invalid symbol {s!r}")
            node.symbols, node.enum_default, node.logical = tuple(symbols), o.get("default"), logical
            if node.enum_default is not None and node.enum_default not in symbols:
                raise SchemaError(f"enum default {node.enum_default!r} is not a symbol")
            return node
        if kind == "fixed":
            self.only(o, kind, ("type", "name", "namespace", "aliases", "doc", "size", "logicaltype", "precision", "scale"))
            self.name(o, space, node, "fixed")
            node.size, node.logical = _whole(o.get("size")), logical
            if node.size <= 0:
                raise SchemaError(f"fixed {node.name} needs a size over 0")
            return node
        if kind in ("array", "map"):
            inner = "items" if kind == "array" else "values"
            self.only(o, kind, ("type", inner, "logicaltype", "doc", "default"))
            if inner not in o:
                raise SchemaError(f"{kind} needs {inner}")
            node.items, node.logical = self.build(o[inner], space), logical
            return node
        if set(o) & {"fields", "symbols", "items", "values", "size"}:
            raise SchemaError(f"unknown complex type {kind!r}")
        return self.reference(kind, space, forward)

    def only(self, o: dict, kind: str, allowed: tuple[str, ...]) -> None:
        if foreign := sorted((set(o) & _KEYS) - set(allowed)):
            raise SchemaError(f"{kind} can't have {', '.join(foreign)}")

    def name(self, o: dict, space: str, node: Node, what: str) -> str:
        """Set the full name and aliases, define the type; returns its namespace."""
        name = o.get("name")
        self.check_name(name, what)
        own = o.get("namespace")
        if "." in name:
            space = name.rpartition(".")[0]
        else:
            if own is not None:
                if own:
                    self.check_name(own, "namespace")
                space = own
            name = f"{space}.{name}" if space else name
        if name in self.named:
            raise SchemaError(f"{name!r} is defined twice")
        node.name = name
        aliases = o.get("aliases") or []
        for a in aliases:
            self.check_name(a, f"{what} alias")
        node.aliases = tuple(a if "." in a or not space else f"{space}.{a}" for a in aliases)
        self.named[name] = node
        return space

    def record(self, o: dict, space: str, node: Node, logical: str) -> Node:
        self.only(o, "record", ("type", "name", "namespace", "aliases", "doc", "fields", "logicaltype"))
        space = self.name(o, space, node, "record")
        node.logical = logical
        fields = o.get("fields")
        if not isinstance(fields, list):
            raise SchemaError(f"record {node.name} needs fields")
        for f in fields:
            if not isinstance(f, dict):
                raise SchemaError(f"record {node.name} has a field that isn't an object")
            f = {k.lower() if k.lower() in _KEYS | _FIELD_KEYS else k: v for k, v in f.items()}
            self.check_name(f.get("name"), "field")
            if "." in f["name"] or any(f["name"] == x.name for x in node.fields):
                raise SchemaError(f"record {node.name}: field {f['name']!r} is invalid or there twice")
            if "type" not in f:
                raise SchemaError(f"record {node.name}: field {f['name']!r} has no type")
            order = f.get("order", "")
            if order not in ("", "ascending", "descending", "ignore"):
                raise SchemaError(f"invalid order {order!r}")
            for a in f.get("aliases") or []:
                self.check_name(a, "field alias")
            kind, inner = f["type"], {k: f[k] for k in f if k in _KEYS and k not in _FIELD_KEYS}
            if isinstance(kind, str) and inner:  # the type's attributes stand beside the field's
                lifted = {"type": kind, **inner}
                if kind in ("enum", "fixed", "record", "error"):
                    lifted["name"] = f["name"]
                kind = lifted
            out = Field(f["name"], self.build(kind, space, True), tuple(f.get("aliases") or ()), f.get("doc") or "", order, f.get("default", _MISSING))
            out.props = {k: v for k, v in f.items() if k not in _FIELD_KEYS | _KEYS}
            if out.has_default:
                self.defaults.append((out.type, out.default, f"{node.name}.{out.name}"))
            elif out.type.kind == "union" and out.type.branches[0].kind == "null":
                out.default = None  # implied
                out.props.setdefault("__implied_default", True)
            node.fields.append(out)
        return node

    def logical(self, o: dict, kind: str, node: Node) -> str:
        """The logical type that holds, "" for none; sets precision and scale of a decimal."""
        name, precision, scale = o.get("logicaltype") or "", o.get("precision"), o.get("scale")
        if name in self.keep_logical and name not in _LOGICAL_BASE and name not in ("decimal", "uuid", "duration"):
            return name
        if name == "decimal":
            size = _whole(o.get("size", 0)) if kind == "fixed" else 0
            good = kind in ("bytes", "fixed") and isinstance(precision, int) and precision > 0 and 0 <= (scale or 0) <= precision
            if not good or kind == "fixed" and precision > math.floor((8 * size - 1) * math.log10(2)):
                return ""
            node.precision, node.scale = precision, scale or 0
            return name
        if name == "uuid":
            if kind != "string" and not (kind == "fixed" and _whole(o.get("size", 0)) == 16):
                raise SchemaError(f"uuid can't be on {kind}")
        elif name == "duration":
            if kind != "fixed" or _whole(o.get("size", 0)) != 12:
                raise SchemaError("duration must be on a fixed of 12 bytes")
        elif name in _LOGICAL_BASE:
            if kind != _LOGICAL_BASE[name]:
                raise SchemaError(f"{name} must be on {_LOGICAL_BASE[name]}, not {kind}")
        elif name:
            return ""
        if precision is not None or scale is not None:
            raise SchemaError(f"{kind} {name}: precision or scale without decimal")
        return name

    def finish(self) -> None:
        for name, space, node in self.later:
            found = self.lookup(name, space)
            if not found:
                raise SchemaError(f"unknown type {name!r}")
            node.name = found
        schema = Schema(Node("null"), self.named, "")
        for node, value, path in self.defaults:
            check_default(schema, node, value, path)


def _whole(x: Any) -> int:
    """A whole number, also in quotes."""
    if isinstance(x, str) and re.fullmatch(r"-?\d+", x):
        return int(x)
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x):
        raise SchemaError(f"not a whole number: {x!r}")
    return int(x)


def check_default(schema: Schema, node: Node, value: Any, path: str) -> None:
    """Raise unless value (as in JSON) is one of the type. Any branch of a union may match."""
    node, bad = schema.of(node), SchemaError(f"{path}: default {value!r} is not a {node.label()}")
    kind = node.kind
    if kind == "union":
        for b in node.branches:
            try:
                return check_default(schema, b, value, path)
            except SchemaError:
                continue
        raise bad
    if kind == "null":
        ok = value is None
    elif kind == "boolean":
        ok = isinstance(value, bool)
    elif kind in ("int", "long"):
        n = 31 if kind == "int" else 63
        ok = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != math.inf and value == int(value) and -(1 << n) <= value < 1 << n
    elif kind in ("float", "double"):
        ok = isinstance(value, (int, float)) and not isinstance(value, bool) or isinstance(value, str) and _number(value) is not None
    elif kind == "string":
        ok = isinstance(value, str)
    elif kind in ("bytes", "fixed"):
        ok = isinstance(value, str) and all(ord(c) < 256 for c in value) and (kind == "bytes" or len(value) == node.size)
    elif kind == "enum":
        ok = value in node.symbols
    elif kind == "array":
        ok = isinstance(value, list)
        for i, x in enumerate(value if ok else ()):
            check_default(schema, node.items, x, f"{path}[{i}]")
    elif kind == "map":
        ok = isinstance(value, dict)
        for k, x in value.items() if ok else ():
            check_default(schema, node.items, x, f"{path}.{k}")
    else:
        ok = isinstance(value, dict)
        for f in node.fields if ok else ():
            if f.name in value:
                check_default(schema, f.type, value[f.name], f"{path}.{f.name}")
            elif not f.has_default:
                raise SchemaError(f"{path}: default lacks {f.name!r}")
    if not ok:
        raise bad


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


# canonical form and fingerprints

#: Fixed value: the start of the 64-bit fingerprint, which is also that of no bytes.
RABIN_EMPTY = 0xC15D213AA4D7A795


def rabin_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (RABIN_EMPTY if i & 1 else 0)
        table.append(i)
    return table


_TABLE = rabin_table()


def rabin(data: bytes) -> int:
    """The 64-bit Rabin fingerprint of bytes."""
    f = RABIN_EMPTY
    for b in data:
        f = f >> 8 ^ _TABLE[(f ^ b) & 0xFF]
    return f


def canonical(schema: Schema) -> str:
    """Full names, and only type, name, fields, symbols, items, values and size; a type is written out where it is first met."""
    seen: set[str] = set()

    def form(node: Node) -> Any:
        if node.kind == "ref" or node.kind in NAMED and node.name in seen:
            if node.name in seen:
                return node.name
            node = schema.of(node)
        if node.kind in PRIMITIVES:
            return node.kind
        if node.kind == "union":
            return [form(b) for b in node.branches]
        if node.kind in ("array", "map"):
            return {"type": node.kind, "items" if node.kind == "array" else "values": form(node.items)}
        seen.add(node.name)
        out: dict[str, Any] = {"name": node.name, "type": "error" if node.error else node.kind}
        if node.kind == "record":
            out["fields"] = [{"name": f.name, "type": form(f.type)} for f in node.fields]
        elif node.kind == "enum":
            out["symbols"] = list(node.symbols)
        else:
            out["size"] = node.size
        return out

    return json.dumps(form(schema.root), ensure_ascii=False, separators=(",", ":"))


def _full(node: Node, seen: set[str]) -> Any:
    if node.kind == "ref":
        return node.name
    if node.kind == "union":
        return [_full(b, seen) for b in node.branches]
    out: dict[str, Any] = {}
    if node.kind in NAMED:
        if node.name in seen:
            return node.name
        seen.add(node.name)
        out = {"type": "error" if node.error else node.kind, "name": node.name}
        out |= {"aliases": list(node.aliases)} if node.aliases else {}
    else:
        out = {"type": node.kind}
    out |= {"doc": node.doc} if node.doc else {}
    if node.logical:
        out["logicalType"] = node.logical
    if node.logical == "decimal":
        out |= {"precision": node.precision, "scale": node.scale}
    if node.kind == "record":
        out["fields"] = []
        for f in node.fields:
            one: dict[str, Any] = {"name": f.name, "type": _full(f.type, seen)}
            one |= {"aliases": list(f.aliases)} if f.aliases else {}
            one |= {"doc": f.doc} if f.doc else {}
            one |= {"order": f.order} if f.order else {}
            one |= {"default": f.default} if f.has_default and not f.props.get("__implied_default") else {}
            out["fields"].append(one | {k: v for k, v in f.props.items() if k != "__implied_default"})
    elif node.kind == "enum":
        out["symbols"] = list(node.symbols)
        out |= {"default": node.enum_default} if node.enum_default is not None else {}
    elif node.kind == "fixed":
        out["size"] = node.size
    elif node.kind in ("array", "map"):
        out["items" if node.kind == "array" else "values"] = _full(node.items, seen)
    out |= node.props
    return node.kind if out == {"type": node.kind} and node.kind in PRIMITIVES else out


def build(root: Node) -> Schema:
    """The schema of a tree of nodes that was put together or changed by hand; names that clash or are missing are errors."""
    defined: dict[str, str] = {}

    def check(node: Node, above: tuple[int, ...]) -> None:
        if id(node) in above:
            raise SchemaError(f"{node.label()} holds itself: refer to it by name")
        if node.kind in NAMED:
            own = json.dumps(_full(node, set()))
            if defined.setdefault(node.name, own) != own:
                raise SchemaError(f"{node.name!r} is defined in two ways")
        for child in [*(f.type for f in node.fields), *([node.items] if node.items else []), *node.branches]:
            check(child, (*above, id(node)))

    check(root, ())
    return parse(json.dumps(_full(root, set())))


class Registry:
    """Schemas that may refer to the types of those that were added before; a schema that fails leaves nothing behind."""

    def __init__(self, lax_names: bool | Callable[[str], bool] = False):
        self.lax_names = lax_names
        self.named: dict[str, Node] = {}
        self._parsed: dict[str, Schema] = {}
        self.by_fingerprint: dict[bytes, Schema] = {}

    def parse(self, text: str) -> Schema:
        key = hashlib.sha256(_normal(text).encode()).hexdigest()
        if key in self._parsed:
            return self._parsed[key]
        schema = parse(text, self.lax_names, self.named)
        self.named |= schema.named
        self._parsed[key] = schema
        self.by_fingerprint[schema.fingerprint()] = schema
        return schema


def _normal(text: str) -> str:
    try:
        return json.dumps(json.loads(text), sort_keys=True)
    except ValueError:
        return text


def renamed(node: Node, name: str) -> Node:
    return replace(node, name=name)
