"""SQL functions. Those with a body in SQL are inlined by the optimizer; a schema's codec is registered by a name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..operators.decode import decode_column, decode_many
from ..operators.encode import encode_column
from ..plans.mapping import spark_type
from ..plans.resolve import plan
from ..plans.schema import Schema
from .codec import as_schema
from .framing import header

_BODIES = {
    "soe_is_message(m BINARY) RETURNS BOOLEAN": "octet_length(m) >= 10 AND substring(m, 1, 2) = X'C301'",
    "soe_fingerprint(m BINARY) RETURNS BINARY": "CASE WHEN octet_length(m) >= 10 AND substring(m, 1, 2) = X'C301' THEN substring(m, 3, 8) END",
    "soe_payload(m BINARY) RETURNS BINARY": "CASE WHEN octet_length(m) >= 10 AND substring(m, 1, 2) = X'C301' THEN substring(m, 11) END",
    "avro_date_days(x DATE) RETURNS INT": "unix_date(x)",
    "avro_timestamp_millis(x TIMESTAMP) RETURNS BIGINT": "unix_millis(x)",
    "avro_timestamp_micros(x TIMESTAMP) RETURNS BIGINT": "unix_micros(x)",
    "avro_timestamp_nanos(x TIMESTAMP) RETURNS BIGINT": "unix_micros(x) * 1000L",
    "avro_uuid_bytes(x STRING) RETURNS BINARY": "unhex(replace(x, '-', ''))",
    "avro_uuid_text(x BINARY) RETURNS STRING": "regexp_replace(lower(hex(x)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')",
}


def register_functions(spark: SparkSession) -> None:
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_schema(spark: SparkSession, name: str, schema: Schema | str, reader: Schema | str | None = None) -> None:
    """encode_<name>(struct) -> binary, decode_<name>(binary) -> struct, decode_many_<name>(binary) -> array and
    soe_<name>(struct) -> binary for SQL, and the table function rows_<name>(binary) -> the values in a row's bytes."""
    schema = as_schema(schema)
    steps = plan(schema, None if reader is None else as_schema(reader))
    start = header(schema)

    @F.arrow_udf(T.BinaryType())
    def encode(values: pa.Array) -> pa.Array:
        return encode_column(schema, values)

    @F.arrow_udf(T.BinaryType())
    def message(values: pa.Array) -> pa.Array:
        return pa.array([None if b is None else start + b for b in encode_column(schema, values).to_pylist()], pa.binary())

    @F.arrow_udf(steps.type)
    def decode(values: pa.Array) -> pa.Array:
        return decode_column(steps, values)

    @F.arrow_udf(T.ArrayType(steps.type))
    def many(values: pa.Array) -> pa.Array:
        return decode_many(steps, values)

    for prefix, function in (("encode", encode), ("decode", decode), ("decode_many", many), ("soe", message)):
        spark.udf.register(f"{prefix}_{name}", function)
    kind = spark_type(as_schema(reader) if reader is not None else schema)
    row = kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])
    if len({f.name.lower() for f in row.fields}) == len(row.fields):  # inlined, so that whole batches are decoded
        rows = "inline" if row is kind else "explode"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `rows_{name}`(data BINARY) RETURNS TABLE ({row.toDDL()}) RETURN SELECT * FROM {rows}(`decode_many_{name}`(data))")
        return

    @udtf(returnType=row)  # SQL refuses names that differ in case only: each row's bytes in a call of their own
    class Rows:
        def eval(self, data):
            for value in decode_many(steps, pa.array([data], pa.binary())).to_pylist()[0] or ():
                yield tuple(value.values()) if isinstance(value, dict) else (value,)

    spark.udtf.register(f"rows_{name}", Rows)
