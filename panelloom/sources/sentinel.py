"""A data source for delimited text in which a lone point stands for a missing number: ``sentinel_csv``.

    spark.dataSource.register(SentinelSource)
    spark.read.format("sentinel_csv").schema("day date, rate double").option("locale", "de").load(folder)

Reading: files are cut into ranges of about ``rangeBytes``, each row belongs to the
range that its line starts in.  Dates, numbers and texts only; a number is a number, a
sentinel (null) or an error that names the file and the row.  Comparisons of a
column with a constant, and null tests, are applied while reading.  With
``option("report", "true")`` the rows are (file, column, rows, missing): what the
sentinels stood for.  Fields are not quoted; a text must not hold the separator.

Writing: every task writes a part under a name of its own and reports it; the commit
moves the reported parts into place, an abort removes them, so a task that runs twice
leaves one part.  Both sides reach files through pyarrow's file systems.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

SENTINEL = "."
SEPARATOR = {"us": ",", "de": ";"}
REPORT = T.StructType([T.StructField("file", T.StringType()), T.StructField("column", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("missing", T.LongType())])
_ARROW = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "bigint": pa.int64()}
_COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}
_AS_ARROW = {operator.eq: pc.equal, operator.gt: pc.greater, operator.ge: pc.greater_equal, operator.lt: pc.less, operator.le: pc.less_equal}


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Range(ds.InputPartition):
    file: str
    start: int
    end: int


class _Options:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.locale = options.get("locale", "us")
        if self.locale not in SEPARATOR:
            raise ValueError(f"locale is one of {sorted(SEPARATOR)}, not {self.locale}")
        self.report = options.get("report", "false").lower() == "true"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))
        self.digits = int(options.get("digits", 8))


class SentinelReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict, fields: T.StructType | None = None):
        self.schema, self.options, self.filters = schema, _Options(options), []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Simple comparisons are kept for reading; the others are given back."""
        names = {f.name for f in self.schema}
        for f in filters:
            column = getattr(f, "attribute", ())
            if not self.options.report and len(column) == 1 and column[0] in names and (type(f) in _COMPARE or isinstance(f, (ds.IsNull, ds.IsNotNull))):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, path = _open(self.options.path)
        found = fs.get_file_info(path)
        files = [found] if found.type == pyarrow.fs.FileType.File else [f for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            step = f.size if self.options.report else self.options.range_bytes
            out += [Range(f.path, lo, min(lo + max(step, 1), f.size)) for lo in range(0, max(f.size, 1), max(step, 1))]
        return out

    def _lines(self, part: Range) -> tuple[list[str], list[str]]:
        """Header, and the lines that start in the range."""
        fs, _ = _open(self.options.path)
        with fs.open_input_file(part.file) as f:
            head = b""
            while b"\n" not in head and (more := f.read(1 << 16)):
                head += more
            header, _, rest = head.partition(b"\n")
            first = len(header) + 1
            lo = max(part.start, first)
            if lo > part.start or part.start == 0:
                begin = lo
            else:
                f.seek(part.start - 1)
                begin = part.start + self._to_line_end(f)
            if begin >= part.end:
                return header.decode().rstrip("\r").split(SEPARATOR[self.options.locale]), []
            f.seek(part.end - 1)
            end = part.end + self._to_line_end(f)
            f.seek(begin)
            body = f.read(end - begin).decode()
        return header.decode().rstrip("\r").split(SEPARATOR[self.options.locale]), [x.rstrip("\r") for x in body.split("\n") if x.rstrip("\r")]

    @staticmethod
    def _to_line_end(f) -> int:
        """How many bytes after the next one the line goes on; 0 if that byte ends it."""
        seen = 0
        while chunk := f.read(1 << 12):
            if (at := chunk.find(b"\n")) >= 0:
                return seen + at
            seen += len(chunk)
        return max(seen - 1, 0)

    def _row_of(self, part: Range, line: str) -> int:
        """Number of a line in its file, counted only when it is at fault."""
        fs, _ = _open(self.options.path)
        with fs.open_input_file(part.file) as f:
            for i, x in enumerate(f.read().decode().split("\n"), 1):
                if x.rstrip("\r") == line:
                    return i
        return 0

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        header, lines = self._lines(part)
        mark = SEPARATOR[self.options.locale]
        cells = [x.split(mark) for x in lines]
        for x, line in zip(cells, lines):
            if len(x) != len(header):
                raise ValueError(f"{part.file}, row {self._row_of(part, line)}: {len(x)} fields, not {len(header)}")
        if self.options.report:
            columns = [[x[i].strip() for x in cells] for i in range(len(header))]
            yield pa.RecordBatch.from_pydict({"file": [part.file] * len(header), "column": header, "rows": [len(cells)] * len(header), "missing": [c.count(SENTINEL) for c in columns]})
            return
        arrays = []
        for f in self.schema:
            if f.name not in header:
                raise ValueError(f"{part.file}: no column {f.name}")
            i, kind = header.index(f.name), f.dataType.simpleString()
            arrays.append(pa.array([self._value(x[i], kind, part, line) for x, line in zip(cells, lines)], _ARROW[kind]))
        batch = pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema])
        for f in self.filters:
            column = batch.column(f.attribute[0])
            keep = pc.is_null(column) if isinstance(f, ds.IsNull) else pc.is_valid(column) if isinstance(f, ds.IsNotNull) else _AS_ARROW[_COMPARE[type(f)]](column, pa.scalar(f.value, column.type))
            batch = batch.filter(pc.fill_null(keep, False))
        for lo in range(0, batch.num_rows, 10_000):
            yield batch.slice(lo, 10_000)

    def _value(self, text: str, kind: str, part: Range, line: str):
        bare = text.strip()
        if kind == "string":
            return text
        if bare in ("", SENTINEL):
            return None
        try:
            if kind == "date":
                return date.fromisoformat(bare)
            return int(bare) if kind == "bigint" else float(bare.replace(",", ".") if self.options.locale == "de" else bare)
        except ValueError as e:
            raise ValueError(f"{part.file}, row {self._row_of(part, line)}: {bare!r} is no {kind}") from e


@dataclass
class Part(ds.WriterCommitMessage):
    temporary: str
    rows: int


class SentinelWriter(ds.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.options, self.job = schema, _Options(options), uuid.uuid4().hex
        fs, path = _open(self.options.path)
        if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound and not overwrite and [f for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if not f.base_name.startswith(("_", "."))]:
            raise ValueError(f"{path} is not empty")
        if overwrite and fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir_contents(path)
        fs.create_dir(f"{path}/_{self.job}", recursive=True)

    def _text(self, v) -> str:
        if v is None:
            return SENTINEL
        if isinstance(v, float):
            return f"{v:.{self.options.digits}f}".replace(".", "," if self.options.locale == "de" else ".")
        if isinstance(v, str) and (SEPARATOR[self.options.locale] in v or "\n" in v):
            raise ValueError(f"a text holds the separator: {v!r}")
        return str(v)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, path = _open(self.options.path)
        name, rows, mark = f"{path}/_{self.job}/{uuid.uuid4().hex}.csv", 0, SEPARATOR[self.options.locale]
        with fs.open_output_stream(name) as f:
            f.write((mark.join(x.name for x in self.schema) + "\n").encode())
            for batch in batches:
                rows += batch.num_rows
                columns = [[self._text(v) for v in c.to_pylist()] for c in batch.columns]
                f.write("".join(mark.join(r) + "\n" for r in zip(*columns)).encode())
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = _open(self.options.path)
        for i, m in enumerate(x for x in messages if x is not None):
            fs.move(m.temporary, f"{path}/part-{i:05d}-{self.job}.csv")
        fs.delete_dir(f"{path}/_{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, path = _open(self.options.path)
        if fs.get_file_info(f"{path}/_{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{path}/_{self.job}")


class SentinelSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sentinel_csv"

    def schema(self) -> T.StructType:
        if self.options.get("report", "false").lower() == "true":
            return REPORT
        raise ValueError("sentinel_csv needs a schema of string, date, double and bigint columns")

    def reader(self, schema: T.StructType) -> SentinelReader:
        return SentinelReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> SentinelWriter:
        return SentinelWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SentinelSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
