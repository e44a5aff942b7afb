"""Folders of Arrow files as a batch source, sink and stream: Spark itself has no reader for them.

A file's record batches are read in slices side by side, only the asked columns of them, and
filters that Arrow decides as Spark does are applied to a batch before Spark gets it.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_files"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_SLICE = 128 << 20  # bytes of a file for a task
# types on which Arrow's comparisons are Spark's: not doubles (NaN), nor strings under a collation
_SAME = {"tinyint", "smallint", "int", "bigint", "boolean", "date", "string"}
_COMPARE = {D.EqualTo: pc.equal, D.GreaterThan: pc.greater, D.GreaterThanOrEqual: pc.greater_equal, D.LessThan: pc.less, D.LessThanOrEqual: pc.less_equal}
_SEARCH = {D.StringStartsWith: pc.starts_with, D.StringEndsWith: pc.ends_with, D.StringContains: pc.match_substring}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and ":/" in path:  # Hadoop writes file:/x
        path = path.replace(":/", ":///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a folder's Arrow files by name; what a writer has not committed is hidden."""
    system, at = _open(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(".arrow") and f.base_name[0] not in "._")


@dataclass
class _Slice(D.InputPartition):
    """Slice `part` of `parts` of a file's record batches."""

    name: str
    part: int
    parts: int

    def __init__(self, name: str, part: int, parts: int):
        self.name, self.part, self.parts = name, part, parts


def _slices(files: Iterable[tuple[str, int]], most: int) -> list[_Slice]:
    return [_Slice(name, i, n) for name, size in files for n in [max(1, math.ceil(size / most))] for i in range(n)]


def _mask(f: D.Filter, batch: pa.RecordBatch) -> pa.Array:
    """True, false or null for each row, as SQL has it."""
    if isinstance(f, D.Not):
        return pc.invert(_mask(f.child, batch))
    column = batch.column(f.attribute[0])
    if isinstance(f, D.IsNull | D.IsNotNull):
        return column.is_null() if isinstance(f, D.IsNull) else column.is_valid()
    if isinstance(f, D.In):
        found = pc.is_in(column, value_set=pa.array(list(f.value), column.type))
        return pc.if_else(column.is_valid(), found, pa.scalar(None, pa.bool_()))
    if type(f) in _SEARCH:
        return _SEARCH[type(f)](column, f.value)
    return _COMPARE[type(f)](column, pa.scalar(f.value, column.type))


class _Rows:
    """Reading of slices, shared by batch and stream."""

    def __init__(self, path: str, schema: StructType, most: int):
        self.path, self.schema, self.most, self.filters = path, schema, most, []

    def read(self, s: _Slice) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        system, at = _open(self.path)
        with system.open_input_file(f"{at}/{s.name}") as raw:
            there = pa.ipc.open_file(raw).schema
            if lacking := [n for n in wanted.names if n not in there.names]:
                raise ValueError(f"{s.name} has no column {', '.join(lacking)}")
            # fields are named by their places in the file; without any, rows are still to be counted
            options = pa.ipc.IpcReadOptions(included_fields=[there.get_field_index(n) for n in wanted.names] or [0])
            file = pa.ipc.open_file(raw, options=options)
            n = file.num_record_batches
            for i in range(n * s.part // s.parts, n * (s.part + 1) // s.parts):
                batch = file.get_batch(i)
                for f in self.filters:
                    batch = batch.filter(_mask(f, batch))
                batch = batch.select(wanted.names)
                if batch.num_rows:
                    yield batch.cast(wanted) if batch.schema != wanted else batch


class _Reader(_Rows, D.DataSourceReader):
    def partitions(self) -> list[_Slice]:
        return _slices(_files(self.path), self.most) or [_Slice("", 0, 0)]

    def read(self, s: _Slice) -> Iterator[pa.RecordBatch]:
        return _Rows.read(self, s) if s.parts else iter(())


class _FilteringReader(_Reader):
    """Takes the filters that Arrow decides as Spark does; Spark has the rest."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if self._same(f.child if isinstance(f, D.Not) else f):
                self.filters.append(f)
            else:
                yield f

    def _same(self, f: D.Filter) -> bool:
        known = (D.IsNull, D.IsNotNull, D.In, *_COMPARE, *_SEARCH)
        if type(f) not in known or len(f.attribute) != 1 or f.attribute[0] not in self.schema.names:
            return False
        if isinstance(f, D.IsNull | D.IsNotNull):
            return True
        if self.schema[f.attribute[0]].dataType.simpleString() not in _SAME:
            return False
        values = list(f.value) if isinstance(f, D.In) else [f.value]
        if None in values:  # x IN (1, null) is never false
            return False
        try:
            pa.array(values, to_arrow_schema(self.schema).field(f.attribute[0]).type)
        except (pa.ArrowException, TypeError, OverflowError):
            return False
        return True


class _Stream(_Rows, D.DataSourceStreamReader):
    """The offset is the name of the last file taken: files must come in the order of their names, as the sink's do."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((name for name, _ in _files(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        return _slices(((n, size) for n, size in _files(self.path) if start["after"] < n <= end["after"]), self.most)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Wrote(D.WriterCommitMessage):
    name: str | None


class _Writer(D.DataSourceArrowWriter):
    """Tasks write hidden files; the commit gives them names that sort behind all earlier ones, in order. One writer at a time."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        system, at = _open(self.path)
        name, out, sink = f"_{uuid.uuid4().hex}.arrow", None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(at, recursive=True)
                sink = system.open_output_stream(f"{at}/{name}")
                out = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(batch)
        if out is None:
            return _Wrote(None)
        out.close()
        sink.close()
        return _Wrote(name)

    def commit(self, messages: list[_Wrote | None]) -> None:
        system, at = _open(self.path)
        done, now = [m.name for m in messages if m and m.name], time.time_ns()
        if not done and not _files(self.path):  # no rows: the schema stays
            system.create_dir(at, recursive=True)
            done = [f"_{uuid.uuid4().hex}.arrow"]
            with system.open_output_stream(f"{at}/{done[0]}") as sink, pa.ipc.new_file(sink, to_arrow_schema(self.schema)):
                pass
        for i, name in enumerate(done):
            system.move(f"{at}/{name}", f"{at}/part-{now:020}-{i:08}.arrow")

    def abort(self, messages: list[_Wrote | None]) -> None:
        system, at = _open(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{at}/{m.name}")


class ArrowFiles(D.DataSource):
    """format("arrow_files"): load(folder); options slice_bytes and filters ("true" where the session lets Python sources filter)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def _args(self, schema: StructType) -> tuple:
        return self._path(), schema, int(self.options.get("slice_bytes", _SLICE))

    def schema(self) -> StructType:
        """That of the first file."""
        files = _files(self._path())
        if not files:
            raise ValueError(f"{self._path()} holds no Arrow file and no schema is stated")
        system, at = _open(self._path())
        with system.open_input_file(f"{at}/{files[0][0]}") as raw:
            return from_arrow_schema(pa.ipc.open_file(raw).schema, prefer_timestamp_ntz=True)  # times without a zone stay so

    def reader(self, schema: StructType) -> D.DataSourceReader:
        kind = _FilteringReader if self.options.get("filters") == "true" else _Reader
        return kind(*self._args(schema))

    def streamReader(self, schema: StructType) -> D.DataSourceStreamReader:
        return _Stream(*self._args(schema))

    def writer(self, schema: StructType, overwrite: bool) -> D.DataSourceWriter:
        if overwrite:
            raise ValueError("Arrow files are appended, not overwritten")
        return _Writer(self._path(), schema)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ArrowFiles)
    return spark


def read_arrow(spark: SparkSession, path: str, schema: StructType | None = None, **options) -> DataFrame:
    """The rows of a folder of Arrow files. A schema with fewer columns reads only these; without one, the first file's holds.

    Filters reach the source where the session has spark.sql.python.filterPushdown.enabled.
    """
    r = _registered(spark).read.format(NAME).options(filters=spark.conf.get(_PUSHDOWN, "false"), **options)
    return (r.schema(schema) if schema else r).load(path)


def stream_arrow(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """The folder as a stream; a restart goes on behind the last file it took."""
    return _registered(spark).readStream.format(NAME).options(**options).schema(schema).load(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """Append df to the folder; its files appear when all of it is written."""
    _registered(df.sparkSession)
    df.write.format(NAME).mode("append").save(path)
