"""The container format, without Spark: header, blocks, codecs."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa

from ..errors import ContainerError, DataError
from ..operators.rows import read_long, write_long
from ..plans.schema import Schema, parse

#: What a file begins with, keys of its metadata, default sizes of blocks when written and at most when read.
MAGIC = b"Obj\x01"
SCHEMA_KEY, CODEC_KEY, RESERVED = "avro.schema", "avro.codec", "avro."
BLOCK_BYTES, MAX_BLOCK_BYTES = 64 << 10, 64 << 20
MAX_META = 1 << 20


def _deflate(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def _inflate(data: bytes) -> bytes:
    d = zlib.decompressobj(-15)
    out = d.decompress(data) + d.flush()
    if not d.eof:
        raise ContainerError("deflate data end too early")
    return out


def _snappy(data: bytes) -> bytes:
    return pa.Codec("snappy").compress(data, asbytes=True) + zlib.crc32(data).to_bytes(4, "big")


def _unsnappy(data: bytes) -> bytes:
    if len(data) < 4:
        raise ContainerError("a snappy block without its checksum")
    n = shift = 0
    for b in data[:5]:  # the size comes first, 7 bits a byte
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    out = pa.Codec("snappy").decompress(data[:-4], n, asbytes=True)
    if zlib.crc32(out) != int.from_bytes(data[-4:], "big"):
        raise ContainerError("a snappy block's checksum is wrong")
    return out


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def _unzstd(data: bytes) -> bytes:
    import zstandard

    d = zstandard.ZstdDecompressor().decompressobj()
    out = d.decompress(data)
    if not d.eof:
        raise ContainerError("zstandard data end too early")
    return out


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "null": (bytes, bytes),
    "deflate": (_deflate, _inflate),
    "snappy": (_snappy, _unsnappy),
    "zstandard": (_zstd, _unzstd),
}

BUILT_IN = dict(CODECS)


def register_codec(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes], bytes]) -> None:
    """Add a codec, or put another in the place of one. Sources take those that are known when they are set up."""
    CODECS[name] = (compress, decompress)


@dataclass
class Header:
    schema: Schema
    codec: str
    sync: bytes
    meta: dict[str, bytes]
    size: int


class _Reader:
    """Numbers and bytes from a file."""

    def __init__(self, file: BinaryIO):
        self.file = file

    def take(self, n: int, what: str) -> bytes:
        out = self.file.read(n)
        if len(out) < n:
            raise ContainerError(f"the file ends in {what}")
        return out

    def long(self, what: str, end_ok: bool = False) -> int | None:
        raw = bytearray()
        while len(raw) < 10:
            b = self.file.read(1)
            if not b:
                if end_ok and not raw:
                    return None
                raise ContainerError(f"the file ends in {what}")
            raw += b
            if b[0] < 0x80:
                break
        try:
            return read_long(bytes(raw), 0)[0]
        except DataError as e:
            raise ContainerError(f"{what}: {e}") from e


def read_header(file: BinaryIO) -> Header:
    r = _Reader(file)
    if r.take(4, "its magic") != MAGIC:
        raise ContainerError("not a container file")
    meta: dict[str, bytes] = {}
    while n := r.long("its metadata"):
        if n < 0:
            n = -n
            r.long("its metadata")
        if n > MAX_META:
            raise ContainerError("too much metadata")
        for _ in range(n):
            parts = []
            for _ in range(2):
                size = r.long("its metadata")
                if not 0 <= size <= MAX_META:
                    raise ContainerError("a size out of range in the metadata")
                parts.append(r.take(size, "its metadata"))
            meta[parts[0].decode()] = parts[1]
    sync = r.take(16, "its sync marker")
    if SCHEMA_KEY not in meta:
        raise ContainerError("no schema in the metadata")
    return Header(parse(meta[SCHEMA_KEY].decode()), meta.get(CODEC_KEY, b"null").decode() or "null", sync, meta, file.tell())


def header_bytes(schema_text: str, codec: str, sync: bytes, meta: dict[str, bytes]) -> bytes:
    if bad := [k for k in meta if k.startswith(RESERVED)]:
        raise ContainerError(f"metadata keys {bad} are reserved")
    every = {SCHEMA_KEY: schema_text.encode()} | ({CODEC_KEY: codec.encode()} if codec != "null" else {}) | meta
    body = b"".join(write_long(len(x)) + x for k, v in every.items() for x in (k.encode(), v))
    return MAGIC + write_long(len(every)) + body + b"\0" + sync


def block_bytes(count: int, data: bytes, codec: str, sync: bytes, codecs: dict | None = None) -> bytes:
    packed = (codecs or CODECS)[codec][0](data)
    return write_long(count) + write_long(len(packed)) + packed + sync


def walk(file: BinaryIO, start: int, max_block: int = MAX_BLOCK_BYTES, sync: bytes | None = None) -> Iterator[tuple[int, int, int]]:
    """(offset, rows, packed size) of each block from start on; only sizes and markers are read."""
    file.seek(0, os.SEEK_END)
    end = file.tell()
    file.seek(start)
    r = _Reader(file)
    while file.tell() < end:
        at = file.tell()
        count, size = r.long("a block"), r.long("a block")
        if count < 0 or size < 0 or size > max_block:
            raise ContainerError(f"block at {at}: {count} rows and {size} bytes are out of range")
        data_at = file.tell()
        if data_at + size + 16 > end:
            raise ContainerError("the file ends in a block")
        file.seek(data_at + size)
        if sync is not None and file.read(16) != sync:
            raise ContainerError(f"block at {at}: the sync marker is wrong")
        file.seek(data_at + size + 16)
        yield at, count, size


def first_block(file: BinaryIO, start: int, end: int, header: Header, chunk: int = 1 << 16) -> int:
    """Where the first block begins from start on: after the header, or after the next sync marker; end if none begins before it."""
    if start <= header.size:
        return min(header.size, end)
    at = start - 16  # a block that begins at start has its marker before it
    file.seek(at)
    data = b""
    while at - len(data) < end:
        more = file.read(chunk)
        if not more:
            return end
        data, at = data[-15:] + more, at + len(more)
        if (found := data.find(header.sync)) >= 0:
            return min(at - len(data) + found + 16, end)
    return end


def blocks_from(file: BinaryIO, start: int, end: int, header: Header, max_block: int = MAX_BLOCK_BYTES, codecs: dict | None = None) -> Iterator[tuple[int, bytes]]:
    """Rows and unpacked data of the blocks that begin from start on, before end."""
    file.seek(0, os.SEEK_END)
    end = min(end, file.tell())
    at = first_block(file, start, end, header)
    while at < end:
        yield read_block(file, at, header, max_block, codecs)
        at = file.tell()


def read_block(file: BinaryIO, at: int, header: Header, max_block: int = MAX_BLOCK_BYTES, codecs: dict | None = None) -> tuple[int, bytes]:
    """Rows and unpacked data of the block at an offset."""
    file.seek(at)
    r = _Reader(file)
    count, size = r.long("a block"), r.long("a block")
    if count < 0 or size < 0 or size > max_block:
        raise ContainerError(f"block at {at}: {count} rows and {size} bytes are out of range")
    data = r.take(size, "a block")
    if r.take(16, "a block") != header.sync:
        raise ContainerError(f"block at {at}: the sync marker is wrong")
    known = codecs or CODECS
    if header.codec not in known:
        raise ContainerError(f"unknown codec {header.codec!r}")
    try:
        return count, known[header.codec][1](data)
    except ContainerError:
        raise
    except Exception as e:
        raise ContainerError(f"block at {at}: {header.codec} data can't be unpacked: {e}") from e


class Writer:
    """A file of blocks. limits: rows, or bytes before packing, whichever comes first; an error leaves the writer unusable."""

    def __init__(self, file: BinaryIO, schema_text: str, codec: str = "null", sync: bytes | None = None, meta: dict[str, bytes] | None = None, block_count: int = 0, block_size: int = BLOCK_BYTES, codecs: dict | None = None, header: bool = True):
        self.file, self.codec, self.sync = file, codec, sync or os.urandom(16)
        self.block_count, self.block_size, self.codecs = block_count, block_size, codecs or CODECS
        if codec not in self.codecs:
            raise ContainerError(f"unknown codec {codec!r}")
        if len(self.sync) != 16:
            raise ContainerError("a sync marker has 16 bytes")
        self.rows: list[bytes] = []
        self.size, self.count, self.broken = 0, 0, False
        if header:
            file.write(header_bytes(schema_text, codec, self.sync, meta or {}))

    def add(self, row: bytes) -> None:
        if self.broken:
            raise ContainerError("the writer has failed before")
        self.rows.append(row)
        self.size += len(row)
        self.count += 1
        if self.size >= self.block_size or self.block_count and self.count >= self.block_count:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            try:
                self.file.write(block_bytes(self.count, b"".join(self.rows), self.codec, self.sync, self.codecs))
            except Exception:
                self.broken = True
                raise
            self.rows, self.size, self.count = [], 0, 0


