"""Custom types: conversions that are attached to the parts of a schema that match, as functions on columns.

They are chosen when the plan is made, once for each part of the schema, and stay inside Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plans.mapping import union_of
from .plans.schema import Node, Schema

#: What a conversion returns to leave a part to the next one that matches.
SKIP = None
Conversion = Callable[[Column, Node], "Column | None"]


@dataclass(frozen=True)
class CustomType:
    """A conversion for nodes with this logical type and this kind (each: any, if empty), and for which `when` is true.

    decode gets the plain value (no logical type is applied if one is named); without it the value stays plain. encode gets
    what decode returned. Either may return SKIP; of several that match, the first that doesn't skip counts.
    """

    logical: str = ""
    kind: str = ""
    encode: Conversion | None = None
    decode: Conversion | None = None
    when: Callable[[Node], bool] | None = None

    def matches(self, node: Node) -> bool:
        return (not self.logical or node.logical == self.logical) and (not self.kind or node.kind == self.kind) and (self.when is None or self.when(node))


def as_text(logical: str, to_text: Callable[[Column], Column], from_text: Callable[[Column], Column]) -> CustomType:
    """Values that have a text form, kept as strings: to_text when they are written, from_text when they are read. The logical
    type is one that the schema keeps for them (keep_logical)."""
    return CustomType(logical, "string", lambda c, n: to_text(c), lambda c, n: from_text(c))


def raw_logical(custom: tuple[CustomType, ...]) -> frozenset[str]:
    """Logical types whose plain values the conversions want."""
    return frozenset(c.logical for c in custom if c.logical)


def decoded(schema: Schema, column: Column, custom: tuple[CustomType, ...]) -> Column:
    return _apply(schema, schema.root, column, custom, True) if custom and _any(schema, schema.root, custom, set()) else column


def encoded(schema: Schema, column: Column, custom: tuple[CustomType, ...]) -> Column:
    return _apply(schema, schema.root, column, custom, False) if custom and _any(schema, schema.root, custom, set()) else column


def _any(schema: Schema, node: Node, custom: tuple[CustomType, ...], seen: set[str]) -> bool:
    """Whether some conversion matches node or what is below it."""
    node = schema.of(node)
    if node.kind == "record":
        if node.name in seen:
            return False
        seen = seen | {node.name}
    below = [*(f.type for f in node.fields), *([node.items] if node.items else []), *node.branches]
    return any(c.matches(node) for c in custom) or any(_any(schema, x, custom, seen) for x in below)


def _apply(schema: Schema, node: Node, c: Column, custom: tuple[CustomType, ...], decode: bool) -> Column:
    node = schema.of(node)
    if not _any(schema, node, custom, set()):
        return c
    own = [x for x in custom if x.matches(node) and (x.decode if decode else x.encode)]

    def inner(c: Column) -> Column:
        if node.kind == "union":
            members, _ = union_of(node)
            if len(members) == 1:
                return _apply(schema, members[0][1], c, custom, decode)
            return F.when(c.isNotNull(), F.struct(*(_apply(schema, b, c.getField(f"member{k}"), custom, decode).alias(f"member{k}") for k, (_, b) in enumerate(members))))
        if node.kind == "record":
            return F.when(c.isNotNull(), F.struct(*(_apply(schema, f.type, c.getField(f.name), custom, decode).alias(f.name) for f in node.fields)))
        if node.kind == "array":
            return F.transform(c, lambda x: _apply(schema, node.items, x, custom, decode))
        if node.kind == "map":
            return F.transform_values(c, lambda _, x: _apply(schema, node.items, x, custom, decode))
        return c

    c = inner(c) if decode else c
    for x in own:
        out = (x.decode if decode else x.encode)(c, node)
        if out is not SKIP:
            c = out
            break
    return c if decode else inner(c) if not own else c
