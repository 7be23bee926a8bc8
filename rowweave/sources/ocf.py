"""Container files as a Python data source: spark.read.format("ocf"), spark.readStream, df.write.format("ocf").

Reading splits files by ranges of bytes, without opening them; a task looks for the first sync marker of its range, unpacks some hundred blocks and decodes the next row of all of them at once.
Options of the source: readerSchema (JSON), columns (comma-separated), rawLogical, maxDepth, maxBlockBytes, splitBytes, and of streams maxFileAge (seconds).
Options of the sink: avroSchema, schemaMode (full or canonical), codec, blockBytes, blockCount, syncMarker (hex), meta.<key>,
preEncoded (one binary column of encoded rows).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..custom import CustomType, decoded, encoded
from ..errors import ContainerError, DataError
from ..operators.decode import Buffer, Decoder, gathered
from ..operators.encode import encode_column
from ..operators.rows import read_long
from ..plans.mapping import arrow_type, schema_from_struct, spark_type
from ..plans.resolve import plan, pruned
from ..plans.schema import Node, Schema, parse
from . import container

SPLIT_BYTES = 32 << 20
#: Blocks that are decoded together; with fewer, rows are first found one after another.
TOGETHER, FEW = 256, 32


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_below(path: str) -> list[pafs.FileInfo]:
    """The files of a folder (hidden ones and those being written not), or the file itself, by name."""
    fs, at = filesystem(path)
    if "*" in at:
        import glob

        return sorted(fs.get_file_info(glob.glob(at)), key=lambda f: f.path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type != pafs.FileType.Directory:
        raise ContainerError(f"{path} isn't there")
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(at) :].split("/"))), key=lambda f: f.path)


def _files(options: dict) -> list[pafs.FileInfo]:
    """The files that a scan reads: those in option fileList (JSON), else those below path."""
    if options.get("filelist"):
        fs, _ = filesystem(options["path"])
        return fs.get_file_info(json.loads(options["filelist"]))
    return files_below(options["path"])


@dataclass
class Range(InputPartition):
    """The blocks of a file that begin at these bytes: from start, up to end (not included)."""

    path: str
    start: int
    end: int


def _schemas(options: dict) -> tuple[Schema, Schema | None]:
    """Of the first file that has a header, and the reader's."""
    fs, _ = filesystem(options["path"])
    files = _files(options)
    if not files:
        raise ContainerError(f"no files in {options['path']}")
    with fs.open_input_file(files[0].path) as f:
        writer = container.read_header(f).schema
    reader = parse(options["readerschema"]) if options.get("readerschema") else None
    if options.get("columns"):
        reader = pruned(reader or writer, [c.strip() for c in options["columns"].split(",")])
    return writer, reader


def _record(schema: Schema) -> Schema:
    """A schema of records: other values are in a field named value."""
    root = schema.of(schema.root)
    if root.kind == "record":
        return schema
    return parse(json.dumps({"type": "record", "name": "value_of_a_row", "fields": [{"name": "value", "type": json.loads(schema.to_json())}]}))


class OcfDataSource(DataSource):
    #: Codecs besides the built-in ones; they travel with the class to Spark's Python processes.
    codecs: dict = {}

    @classmethod
    def name(cls) -> str:
        return "ocf"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> T.StructType:
        o = self._options()
        writer, reader = _schemas(o)
        return spark_type(_record(reader or writer), None, int(o.get("maxdepth", 0)), _raw(o))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return OcfReader(schema, self._options(), self.codecs)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return OcfStreamReader(schema, self._options(), self.codecs)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return OcfWriter(schema, dict(self.options.items()), overwrite, self.codecs)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return OcfStreamWriter(schema, dict(self.options.items()), self.codecs)


def _raw(o: dict) -> frozenset[str]:
    return frozenset(x.strip() for x in o.get("rawlogical", "").split(",") if x.strip())


class _Scan:
    """What readers of batches and streams share."""

    def __init__(self, schema: T.StructType, o: dict, codecs: dict):
        self.names, self.o, self.codecs = schema.names, o, container.CODECS | codecs
        self.max_block = int(o.get("maxblockbytes", container.MAX_BLOCK_BYTES))
        self.split = int(o.get("splitbytes", SPLIT_BYTES))

    def splits(self, file: pafs.FileInfo) -> list[Range]:
        """Ranges of bytes; nothing is read to make them."""
        return [Range(file.path, at, min(at + self.split, file.size)) for at in range(0, file.size, self.split)]

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.o["path"])
        with fs.open_input_file(part.path) as f:
            header = container.read_header(f)
            reader = parse(self.o["readerschema"]) if self.o.get("readerschema") else None
            wanted = reader or header.schema
            if wanted.of(wanted.root).kind == "record":
                root = wanted.of(wanted.root)
                if [x.name for x in root.fields] != list(self.names):
                    reader = pruned(Schema(root, wanted.named, ""), list(self.names))
            steps = plan(header.schema, reader, int(self.o.get("maxdepth", 0)), _raw(self.o))
            found = container.blocks_from(f, part.start, part.end, header, self.max_block, self.codecs)
            while blocks := list(islice(found, TOGETHER)):
                values = decode_blocks(header.schema, steps, blocks)
                if isinstance(steps.type, T.StructType) and wanted.of(wanted.root).kind == "record":
                    yield pa.RecordBatch.from_arrays([values.field(k) for k in range(values.type.num_fields)], self.names)
                else:
                    yield pa.RecordBatch.from_arrays([values], self.names)


def decode_blocks(schema: Schema, steps: Any, blocks: list[tuple[int, bytes]]) -> pa.Array:
    """The rows of some blocks, in order. A block that has bytes left after its rows, or too few, is an error."""
    data = np.frombuffer(b"".join(d for _, d in blocks) or b"\0", np.uint8)
    sizes, counts = np.array([len(d) for _, d in blocks], np.int64), np.array([n for n, _ in blocks], np.int64)
    end = np.cumsum(sizes)
    cur = end - sizes
    if len(blocks) >= FEW or counts.max(initial=0) <= 4:
        parts: list[pa.Array] = []
        of: list[np.ndarray] = []
        decoder = Decoder(Buffer(data, end))
        after = decoder.in_turn(np.arange(len(blocks)), cur, counts, None, [steps], [parts], of)
        values = gathered(of, parts, len(blocks), arrow_type(steps.type))[1]
    else:
        raw, starts, after = data.tobytes(), [], end.copy()
        skip = skipper(schema, schema.root)
        for i in range(len(blocks)):
            at = int(cur[i])
            for _ in range(int(counts[i])):
                starts.append(at)
                at = skip(raw, at)
            after[i] = at
        starts = np.array(starts, np.int64)
        limit = np.repeat(end, counts)
        if (starts > limit).any():
            raise DataError("", "a row beyond its block")
        values = Decoder(Buffer(data, limit)).value(steps, starts, None)[0]
    if (after != end).any():
        raise ContainerError(f"{int(abs(end - after).max())} bytes are left in a block after its rows")
    return values


def skipper(schema: Schema, node: Node, known: dict | None = None) -> Callable[[bytes, int], int]:
    """A function that gives where a value ends."""
    node, known = schema.of(node), {} if known is None else known
    kind = node.kind

    def number(buf: bytes, at: int) -> int:
        while at < len(buf) and buf[at] > 0x7F:
            at += 1
        return at + 1

    if kind == "null":
        return lambda buf, at: at
    if kind in ("int", "long", "enum"):
        return number
    if kind in ("boolean", "float", "double", "fixed"):
        size = {"boolean": 1, "float": 4, "double": 8}.get(kind, node.size)
        return lambda buf, at: at + size
    if kind in ("bytes", "string"):

        def sized(buf: bytes, at: int) -> int:
            n, at = read_long(buf, at)
            if n < 0:
                raise DataError("", "a negative length")
            return at + n

        return sized
    if kind == "union":
        branches = [skipper(schema, b, known) for b in node.branches]

        def one(buf: bytes, at: int) -> int:
            i, at = read_long(buf, at)
            if not 0 <= i < len(branches):
                raise DataError("", f"the union has no branch {i}")
            return branches[i](buf, at)

        return one
    if kind in ("array", "map"):
        item = skipper(schema, node.items, known)
        key = skipper(schema, Node("string")) if kind == "map" else None

        def many(buf: bytes, at: int) -> int:
            while True:
                n, at = read_long(buf, at)
                if not n:
                    return at
                if n < 0:
                    size, at = read_long(buf, at)
                    at += size
                    continue
                for _ in range(n):
                    at = item(buf, key(buf, at) if key else at)

        return many
    if node.name not in known:
        parts: list = []
        known[node.name] = parts
        parts += [skipper(schema, f.type, known) for f in node.fields]
    parts = known[node.name]

    def record(buf: bytes, at: int) -> int:
        for p in parts:
            at = p(buf, at)
        return at

    return record


class OcfReader(DataSourceReader):
    def __init__(self, schema: T.StructType, o: dict, codecs: dict):
        self.scan = _Scan(schema, o, codecs)

    def partitions(self) -> list[InputPartition]:
        found = [s for f in _files(self.scan.o) for s in self.scan.splits(f)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from self.scan.rows(partition)


class OcfStreamReader(DataSourceStreamReader):
    """New files of a folder. A file must come whole (as by renaming), and may be MAX_AGE seconds (option maxFileAge) older than
    the newest one that has been read when it comes: so long offsets keep the names of files."""

    MAX_AGE = 24 * 3600

    def __init__(self, schema: T.StructType, o: dict, codecs: dict):
        self.scan = _Scan(schema, o, codecs)
        self.max_age = int(float(o.get("maxfileage", self.MAX_AGE)) * 1e9)

    def initialOffset(self) -> dict:
        return {"before": -1, "seen": []}

    @staticmethod
    def _mark(f: pafs.FileInfo) -> str:
        return hashlib.blake2b(f.path.encode(), digest_size=8).hexdigest()

    def latestOffset(self) -> dict:
        files = files_below(self.scan.o["path"])
        before = max((f.mtime_ns or 0 for f in files), default=-1) - self.max_age
        return {"before": before, "seen": sorted(self._mark(f) for f in files if (f.mtime_ns or 0) > before)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = set(start["seen"]), set(end["seen"])
        within = lambda f, offset, marks: (f.mtime_ns or 0) <= offset["before"] or self._mark(f) in marks
        return [s for f in files_below(self.scan.o["path"]) if within(f, end, last) and not within(f, start, first) for s in self.scan.splits(f)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.scan.rows(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    draft: str
    final: str
    rows: int


class OcfWriter(DataSourceArrowWriter):
    """A file for each task, written under a hidden name and renamed when all tasks are done."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool, codecs: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite, self.job = o["path"], overwrite, uuid.uuid4().hex
        self.pre_encoded = o.get("preencoded", "false").lower() == "true"
        if self.pre_encoded and "avroschema" not in o:
            raise ContainerError("preEncoded needs avroSchema")
        self.schema = parse(o["avroschema"]) if "avroschema" in o else schema_from_struct(schema)
        mode = o.get("schemamode", "full")
        if mode not in ("full", "canonical"):
            raise ContainerError(f"unknown schemaMode {mode!r}")
        self.text = self.schema.canonical() if mode == "canonical" else (o.get("avroschema") or self.schema.to_json())
        self.codec, self.codecs = o.get("codec", "null"), container.CODECS | codecs
        if self.codec not in self.codecs:
            raise ContainerError(f"unknown codec {self.codec!r}")
        self.block_bytes, self.block_count = int(o.get("blockbytes", container.BLOCK_BYTES)), int(o.get("blockcount", 0))
        self.sync = bytes.fromhex(o["syncmarker"]) if "syncmarker" in o else None
        self.meta = {k[5:]: v.encode() for k, v in options.items() if k.lower().startswith("meta.")}
        container.header_bytes(self.text, self.codec, self.sync or b"", self.meta)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.avro", 0
        draft = f"{at}/_{self.job}-{name}"
        root = self.schema.of(self.schema.root)
        with fs.open_output_stream(draft) as f:
            w = container.Writer(f, self.text, self.codec, self.sync, self.meta, self.block_count, self.block_bytes, self.codecs)
            for batch in iterator:
                if self.pre_encoded:
                    data = batch.column(0).cast(pa.binary())
                elif root.kind == "record":
                    data = encode_column(self.schema, pa.StructArray.from_arrays(batch.columns, names=batch.schema.names), root)
                else:
                    data = encode_column(self.schema, batch.column(0), root)
                rows += len(data)
                self._blocks(w, data)
            w.flush()
        return Written(draft, f"{at}/{name}", rows)

    def _blocks(self, w: container.Writer, data: pa.Array) -> None:
        """Cut rows into blocks as adding them one by one would."""
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) if len(data) else np.zeros(1, np.int64)
        raw = memoryview(data.buffers()[2]) if len(data) and data.buffers()[2] is not None else memoryview(b"")
        i, n = 0, len(data)
        while i < n:
            if len(w.rows):
                w.rows, before = [b"".join(w.rows)], w.count
            else:
                before = 0
            j = int(np.searchsorted(offsets, offsets[i] + w.block_size - w.size, "left"))
            j = max(i + 1, min(j, n))
            if w.block_count:
                j = min(j, i + w.block_count - before)
            w.rows.append(bytes(raw[offsets[i] : offsets[j]]))
            w.size += int(offsets[j] - offsets[i])
            w.count = before + j - i
            if w.size >= w.block_size or w.block_count and w.count >= w.block_count:
                w.flush()
            i = j

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = filesystem(self.path)
        old = files_below(self.path) if self.overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound else []
        for m in messages:
            if m is not None:
                fs.move(m.draft, m.final)
        for f in old:
            fs.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = filesystem(self.path)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.base_name.startswith(f"_{self.job}-"):
                    fs.delete_file(f.path)


class OcfStreamWriter(DataSourceStreamArrowWriter):
    """The files of a batch are named after it: a batch that is committed twice stays one."""

    def __init__(self, schema: T.StructType, options: dict, codecs: dict):
        self.inner = OcfWriter(schema, options, False, codecs)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.inner.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, at = filesystem(self.inner.path)
        for f in fs.get_file_info(pafs.FileSelector(at)) if fs.get_file_info(at).type == pafs.FileType.Directory else []:
            if f.base_name.startswith(f"batch-{batchId:08d}-"):
                fs.delete_file(f.path)
        for i, m in enumerate(messages):
            if m is not None and m.rows:
                fs.move(m.draft, f"{at}/batch-{batchId:08d}-{i:05d}.avro")
            elif m is not None:
                fs.delete_file(m.draft)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.inner.abort(messages)


# helpers


def register(spark: SparkSession) -> None:
    own = {k: v for k, v in container.CODECS.items() if v != container.BUILT_IN.get(k)}
    spark.dataSource.register(type("OcfDataSource", (OcfDataSource,), {"codecs": own}) if own else OcfDataSource)


def read_ocf(spark: SparkSession, path: str, reader_schema: Schema | str | None = None, columns: list[str] | None = None, reader_schema_fn: Callable[[container.Header], Schema | str | None] | None = None, custom: tuple[CustomType, ...] = (), **options: Any) -> DataFrame:
    """Rows of container files, evolved to a reader schema; the function chooses one from a file's header (None: as written),
    and files are read together by what it chose."""
    register(spark)
    if reader_schema is not None and reader_schema_fn is not None:
        raise ContainerError("either a reader schema or a function that chooses one")
    if custom:
        options["rawLogical"] = ",".join(sorted({c.logical for c in custom if c.logical}))
    if reader_schema_fn is None:
        return _loaded(spark, path, reader_schema, columns, options, custom)
    fs, _ = filesystem(path)
    groups: dict[tuple[str, bool], list[str]] = {}
    for info in files_below(path):
        with fs.open_input_file(info.path) as f:
            header = container.read_header(f)
        chosen = reader_schema_fn(header)
        text = chosen.to_json() if isinstance(chosen, Schema) else chosen
        groups.setdefault((text or header.schema.text, text is not None), []).append(info.path)
    parts = [_loaded(spark, path, text if chosen else None, columns, options | {"fileList": json.dumps(paths)}, custom) for (text, chosen), paths in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _loaded(spark: SparkSession, path: str, schema: Schema | str | None, columns: list[str] | None, options: dict, custom: tuple[CustomType, ...]) -> DataFrame:
    if schema is not None:
        options = options | {"readerSchema": schema.to_json() if isinstance(schema, Schema) else schema}
    if columns:
        options = options | {"columns": ",".join(columns)}
    df = spark.read.format("ocf").options(**options).load(path)
    if not custom:
        return df
    from pyspark.sql import functions as F

    writer, found = _schemas({k.lower(): v for k, v in options.items()} | {"path": path})
    return df.select(decoded(found or writer, F.struct("*"), custom).alias("_row")).select("_row.*")


def write_ocf(df: DataFrame, path: str, mode: str = "error", schema: Schema | str | None = None, custom: tuple[CustomType, ...] = (), **options: Any) -> None:
    """Write rows to a folder of container files. mode: error, ignore, append or overwrite."""
    register(df.sparkSession)
    fs, at = filesystem(path)
    there = fs.get_file_info(at).type != pafs.FileType.NotFound and bool(files_below(path))
    if there and mode == "error":
        raise ContainerError(f"{path} is there already")
    if there and mode == "ignore":
        return
    if schema is not None:
        options["avroSchema"] = schema.to_json() if isinstance(schema, Schema) else schema
    if custom:
        from pyspark.sql import functions as F

        of = parse(options["avroSchema"])
        df = df.select(encoded(of, F.struct("*"), custom).alias("_row")).select("_row.*")
    df.write.format("ocf").mode("overwrite" if mode == "overwrite" else "append").options(**options).save(path)


def append_file(path: str, rows: list[bytes], block_bytes: int = container.BLOCK_BYTES) -> None:
    """Add encoded rows to one existing local file: schema, codec and sync marker are the file's own."""
    with open(path, "r+b") as f:
        header = container.read_header(f)
        for _ in container.walk(f, header.size, sync=header.sync):
            pass  # the file must be whole
        f.seek(0, 2)
        w = container.Writer(f, "", header.codec, header.sync, block_size=block_bytes, header=False)
        for r in rows:
            w.add(r)
        w.flush()


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, codec, schema, sync (hex), meta (without the reserved keys), blocks, rows and packed bytes of each file."""
    uri = path if "://" in path else ""
    listed = spark.createDataFrame([(f.path,) for f in files_below(path)], "path string")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = filesystem(uri)[0] if uri else pafs.LocalFileSystem()
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                with own.open_input_file(p) as f:
                    h = container.read_header(f)
                    blocks = list(container.walk(f, h.size, sync=h.sync))
                meta = {k: v.decode("utf-8", "replace") for k, v in h.meta.items() if not k.startswith(container.RESERVED)}
                out.append({"path": p, "codec": h.codec, "schema": h.schema.text, "sync": h.sync.hex(), "meta": list(meta.items()), "blocks": len(blocks), "rows": sum(b[1] for b in blocks), "bytes": sum(b[2] for b in blocks)})
            kind = pa.schema([("path", pa.string()), ("codec", pa.string()), ("schema", pa.string()), ("sync", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("blocks", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, kind)

    return listed.mapInArrow(look, "path string, codec string, schema string, sync string, meta map<string,string>, blocks long, rows long, bytes long")
