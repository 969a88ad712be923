"""Data sources that Spark has no reader for: gene-set files, and numeric columns in blocks (sparse cells, rasters).

Register them once by `register(spark)`; then spark.read.format("gmt").load(path) and so on.  Paths go through pyarrow's
file systems (local, hdfs, s3, gs).  A schema given by the caller names the columns to read: others are not
decoded, and of column files not even fetched.  Reads have a partition for each range of a file.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a text range that one partition reads.
RANGE = 16 << 20
#: Rows of a block of a column file.
ROWS = 1 << 17
_MAGIC = b"HGCOLS01"
_KINDS = {"bigint": "<i8", "int": "<i4", "double": "<f8", "float": "<f4", "smallint": "<i2"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files that are not hidden."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


def lines(system: fs.FileSystem, part: Range) -> Iterator[bytes]:
    """Lines that begin in the range; the last one is read to its end."""
    if part.end is None:  # compressed: from the start, in one go
        with system.open_input_stream(part.path, compression="detect") as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                yield from whole
            if rest:
                yield rest
        return
    with system.open_input_file(part.path) as f:
        at = part.start
        f.seek(at and at - 1)
        rest, skip = b"", at > 0  # the piece up to the first \n is another range's, unless a line ends right before
        at = at and at - 1
        while chunk := f.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if skip:
                    skip = False
                elif at < part.end:
                    yield line
                else:
                    return
                at += len(line) + 1
            if at >= part.end and not skip:
                return
        if rest and not skip and at < part.end:
            yield rest


class GmtReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path, self.size = schema.fieldNames(), options["path"], int(options.get("rangeBytes", RANGE))
        self.arrow = to_arrow_schema(schema)
        self.sets: set[str] | None = None
        if unknown := set(self.names) - {"set", "description", "member"}:
            raise ValueError(f"a gene-set file has no {sorted(unknown)}")

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        """Conditions on the set's name are checked before a line is taken apart."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("set",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sets = wanted if self.sets is None else self.sets & wanted
            else:
                yield f

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        for path, size in _files(self.path):
            if path.endswith((".gz", ".bz2", ".zst")):
                out.append(Range(path, 0, None))
            else:
                out += [Range(path, a, min(a + self.size, size)) for a in range(0, size, self.size)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        held: dict[str, list] = {n: [] for n in self.names}

        def out() -> pa.RecordBatch:
            rb = pa.RecordBatch.from_arrays([pa.array(held[n], t) for n, t in zip(self.names, self.arrow.types)], schema=self.arrow)
            for v in held.values():
                v.clear()
            return rb

        for line in lines(_open(self.path)[0], partition):
            name, _, rest = line.rstrip(b"\r").partition(b"\t")
            if self.sets is not None and name.decode() not in self.sets:
                continue
            description, _, rest = rest.partition(b"\t")
            members = [m.decode() for m in rest.split(b"\t") if m]
            for column, values in (("set", [name.decode()] * len(members)), ("description", [description.decode()] * len(members)), ("member", members)):
                if column in held:
                    held[column] += values
            if len(held[self.names[0]]) >= 50_000:
                yield out()
        if held[self.names[0]]:
            yield out()


class GmtSource(DataSource):
    """Lines of set, description and members, split by tabs; a row a member, empty members left out.  Option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "gmt"

    def schema(self) -> str:
        return "set string, description string, member string"

    def reader(self, schema: StructType) -> GmtReader:
        return GmtReader(schema, self.options)


class Block(InputPartition):
    def __init__(self, path: str, rows: int, columns: dict[str, tuple[int, str]]) -> None:
        self.path, self.rows, self.columns = path, rows, columns


def _manifests(path: str) -> list[str]:
    """Files of all writes that were committed: what a lost or failed task left is in no manifest."""
    system, at = _open(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(at)):
        if info.base_name.startswith("_manifest-"):
            with system.open_input_stream(info.path) as f:
                out += [f"{at.rstrip('/')}/{name}" for name in json.loads(f.read())]
    return sorted(out)


def _footer(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 16)
        length, magic = struct.unpack("<q8s", f.read(16))
        if magic != _MAGIC:
            raise ValueError(f"not a column file: {path}")
        f.seek(size - 16 - length)
        return json.loads(f.read(length))


class ColumnReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.arrow, self.limits = options["path"], to_arrow_schema(schema), []

    def pushFilters(self, filters):  # noqa: N802
        """Comparisons leave out blocks by their least and largest values; Spark still checks each row."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                self.limits.append((type(f).__name__, f.attribute[0], f.value))
            yield f

    def _may_hold(self, block: dict) -> bool:
        for kind, column, value in self.limits:
            lo, hi = block["span"].get(column, (None, None))
            if lo is None:
                continue
            if kind == "EqualTo" and not lo <= value <= hi or kind.startswith("Greater") and hi < value or kind.startswith("Less") and lo > value:
                return False
        return True

    def partitions(self) -> list[Block]:
        system, _ = _open(self.path)
        out = []
        for path in _manifests(self.path):
            for b in _footer(system, path)["blocks"]:
                if self._may_hold(b):
                    out.append(Block(path, b["rows"], {n: tuple(b["columns"][n]) for n in self.arrow.names}))
        return out

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block may hold what is asked for
            return
        with _open(self.path)[0].open_input_file(partition.path) as f:
            arrays = []
            for field in self.arrow:
                at, kind = partition.columns[field.name]
                f.seek(at)
                arrays.append(pa.array(np.frombuffer(f.read(partition.rows * np.dtype(kind).itemsize), kind)).cast(field.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=self.arrow)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


class ColumnWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.rows = options["path"], overwrite, int(options.get("blockRows", ROWS))
        self.kinds = {}
        for f in schema:
            kind = _KINDS.get(f.dataType.simpleString())
            if kind is None:
                raise ValueError(f"{f.name}: a column file holds numbers only")
            self.kinds[f.name] = kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _open(self.path)
        name = f"part-{uuid.uuid4().hex}.cols"
        blocks: list[dict] = []
        held: list[pa.RecordBatch] = []
        count = 0
        out = None

        def flush() -> None:
            nonlocal count, out
            if out is None:
                system.create_dir(at, recursive=True)
                out = system.open_output_stream(f"{at.rstrip('/')}/{name}")
            table = pa.Table.from_batches(held)
            block = {"rows": table.num_rows, "columns": {}, "span": {}}
            for column, kind in self.kinds.items():
                if table[column].null_count:
                    raise ValueError(f"{column}: a column file holds no NULL")
                v = table[column].to_numpy().astype(kind)
                block["columns"][column] = (out.tell(), kind)
                if not np.isnan(v).any():  # without NaN only: a span must hold all
                    block["span"][column] = (v.min().item(), v.max().item())
                out.write(v.tobytes())
            blocks.append(block)
            held.clear()
            count = 0

        for rb in iterator:
            for start in range(0, rb.num_rows, self.rows):
                held.append(rb.slice(start, self.rows))
                count += held[-1].num_rows
                if count >= self.rows:
                    flush()
        if count:
            flush()
        if out is None:
            return Written(None)
        footer = json.dumps({"columns": self.kinds, "blocks": blocks}).encode()
        out.write(footer + struct.pack("<q8s", len(footer), _MAGIC))
        out.close()
        return Written(name)

    def commit(self, messages) -> None:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(at)) if i.base_name.startswith("_manifest-")] if self.overwrite else []
        for path in old:
            system.delete_file(path)
        with system.open_output_stream(f"{at.rstrip('/')}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())
        with system.open_output_stream(f"{at.rstrip('/')}/_kinds.json") as f:
            f.write(json.dumps(self.kinds).encode())

    def abort(self, messages) -> None:
        system, at = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{at.rstrip('/')}/{m.name}")


class ColumnSource(DataSource):
    """Numbers by column, in blocks with their spans: format("column_blocks"), options path and blockRows."""

    @classmethod
    def name(cls) -> str:
        return "column_blocks"

    def schema(self) -> str:
        system, at = _open(self.options["path"])
        with system.open_input_stream(f"{at.rstrip('/')}/_kinds.json") as f:
            kinds = json.loads(f.read())
        back = {v: k for k, v in _KINDS.items()}
        return ", ".join(f"`{c}` {back[k]}" for c, k in kinds.items())

    def reader(self, schema: StructType) -> ColumnReader:
        return ColumnReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ColumnWriter:
        return ColumnWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known; conditions are pushed to them where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GmtSource)
    spark.dataSource.register(ColumnSource)
