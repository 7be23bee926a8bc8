"""Single messages: two marker bytes, the 8-byte fingerprint of the schema, and the encoded value."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..operators.decode import decode_column
from ..plans.mapping import arrow_type
from ..plans.resolve import plan
from ..plans.schema import Registry, Schema, rabin
from .codec import as_schema, decode_avro, encode_avro

#: Fixed value: the bytes that every message begins with.
MARKER = b"\xc3\x01"


def header(schema: Schema | str) -> bytes:
    return MARKER + rabin(as_schema(schema).canonical().encode()).to_bytes(8, "little")


def encode_soe(column: Column | str, schema: Schema | str) -> Column:
    return F.concat(F.lit(bytearray(header(schema))), encode_avro(column, schema))


def is_soe(column: Column | str, schema: Schema | str | None = None) -> Column:
    """Whether bytes are a message (of this schema)."""
    c = F.col(column) if isinstance(column, str) else column
    start = header(schema) if schema is not None else MARKER
    return (F.octet_length(c) >= 10) & (F.substring(c, 1, len(start)) == F.lit(bytearray(start)))


def soe_fingerprint(column: Column | str) -> Column:
    """The schema's fingerprint as 8 bytes, least significant first; an error if it isn't a message."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(is_soe(c) | c.isNull(), F.substring(c, 3, 8)).otherwise(F.raise_error(F.lit("not a single-object message")).cast("binary"))


def soe_payload(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(is_soe(c) | c.isNull(), F.substring(c, 11, 2147483647)).otherwise(F.raise_error(F.lit("not a single-object message")).cast("binary"))


def decode_soe(column: Column | str, writer: Schema | str, reader: Schema | str | None = None, mode: str = "failfast") -> Column:
    """The value of a message of this schema. failfast: another message and bytes that can't be read are errors;
    permissive_other: another message is null; permissive: both are."""
    c = F.col(column) if isinstance(column, str) else column
    other = F.lit(None).cast("binary") if mode.startswith("permissive") else F.raise_error(F.lit("not a message of this schema")).cast("binary")
    payload = F.when(is_soe(c, writer), F.substring(c, 11, 2147483647)).when(c.isNotNull(), other)
    return decode_avro(payload, writer, reader, mode="permissive" if mode == "permissive" else "failfast")


def read_versions(df: DataFrame, column: str, schemas: Registry | list[Schema | str], reader: Schema | str, into: str = "value", unknown: str = "error") -> DataFrame:
    """df with messages of several schemas in one column, decoded as reader; null stays null. unknown: what becomes of a message
    of none of the schemas, and of bytes that are no message: an error, null or drop.

    One Arrow function: each row goes to the plan of its own header.
    """
    if unknown not in ("error", "null", "drop"):
        raise ValueError(f"unknown must be error, null or drop, not {unknown!r}")
    known, reader = list(schemas.by_fingerprint.values()) if isinstance(schemas, Registry) else [as_schema(s) for s in schemas], as_schema(reader)
    plans = {header(s): plan(s, reader) for s in known}
    kind = next(iter(plans.values())).type

    @F.arrow_udf(kind)
    def run(heads: pa.Array, payloads: pa.Array) -> pa.Array:
        left = heads.is_valid().to_numpy(zero_copy_only=False).copy()
        parts, of = [], []
        for head, steps in plans.items():
            own = np.flatnonzero(pc.fill_null(pc.equal(heads, head), False).to_numpy(zero_copy_only=False))
            if len(own):
                parts.append(decode_column(steps, payloads.take(pa.array(own))))
                of.append(own)
                left[own] = False
        if unknown == "error" and left.any():
            raise DataError("", f"row {int(left.argmax())} of a batch is a message of none of the schemas")
        rest = np.setdiff1d(np.arange(len(heads)), np.concatenate(of) if of else np.empty(0, np.int64))
        parts.append(pa.nulls(len(rest), parts[0].type if parts else arrow_type(kind)))
        order = np.argsort(np.concatenate((*of, rest)).astype(np.int64), kind="stable")
        return pa.concat_arrays(parts).take(pa.array(order))

    if unknown == "drop":
        df = df.where(reduce(lambda a, b: a | b, (is_soe(column, s) for s in known)))
    return df.withColumn(into, run(F.substring(F.col(column), 1, 10), F.substring(F.col(column), 11, 2147483647)))
