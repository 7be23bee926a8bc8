"""Container files as a source and a sink of Spark, batch and streaming."""

from .ocf import OcfDataSource, append_file, metadata, read_ocf, register, write_ocf

__all__ = ["OcfDataSource", "append_file", "metadata", "read_ocf", "register", "write_ocf"]
