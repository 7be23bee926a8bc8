"""Streams of container files and of messages. Decoding keeps no state: every column function works on a stream as it is."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.framing import read_versions
from ..plans.schema import Registry, Schema
from ..sources import register


def read_stream(spark: SparkSession, path: str, reader_schema: Schema | str | None = None, columns: list[str] | None = None, **options: Any) -> DataFrame:
    """New container files of a folder as a stream of rows, evolved to a reader schema or pruned to some columns."""
    register(spark)
    reader = spark.readStream.format("ocf").options(**options)
    if reader_schema is not None:
        reader = reader.option("readerSchema", reader_schema.to_json() if isinstance(reader_schema, Schema) else reader_schema)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(path)


def write_stream(df: DataFrame, path: str, marks: str, available_now: bool = False, **options: Any) -> StreamingQuery:
    """A stream of rows into container files, each batch once; marks: the folder in which the query keeps its place."""
    register(df.sparkSession)
    writer = df.writeStream.format("ocf").options(**options).option("checkpointLocation", marks)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def read_messages(df: DataFrame, column: str, schemas: Registry | list[Schema | str], reader: Schema | str, into: str = "value") -> DataFrame:
    """A stream (or table) with messages of several schema versions in one column, as rows of the reader's."""
    return read_versions(df, column, schemas, reader, into)
