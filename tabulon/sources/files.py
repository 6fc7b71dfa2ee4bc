"""Sources: format detection, schemas and row counts from footers, and scans."""

from __future__ import annotations

import glob as _glob
import os
import struct
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..errors import OptionError, SchemaMismatch, Unsupported
from ..fsio import Files, local, opened, remote, size
from ..plans.types import leaves
from .arrow_ipc import ArrowIpc, ParquetGroups

_EXTENSIONS = {".arrow": "arrow", ".parquet": "parquet", ".vortex": "vortex"}
#: Metadata of a stream message may not be larger.
METADATA_LIMIT = 64 << 20
#: Footers that the driver reads at once.
FOOTER_THREADS = 16


def detect_format(path: str, given: str | None = None) -> str:
    """The given format, or that of the file's extension."""
    found = given or _EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if found is None:
        raise OptionError(f"cannot tell the format of '{path}': expected .arrow, .parquet or .vortex, or an explicit format")
    return found


def expand(patterns: list[str]) -> list[str]:
    """Files of all patterns, sorted, each once.  A pattern without files is passed over if another has some.

    Patterns with a scheme are matched by Hadoop's file systems, plain ones on the local disk.
    """
    found = sorted({p for pattern in patterns for p in _matches(pattern)})
    if not found:
        raise FileNotFoundError(f"no files match {', '.join(patterns)}")
    return found


def _matches(pattern: str) -> list[str]:
    if not remote(pattern):
        return _glob.glob(local(pattern), recursive=True)
    return Files(SparkSession.active()).glob(pattern)


def _messages(path: str):
    """(is a record batch, rows) of each message of an Arrow stream, bodies passed over."""
    with opened(path) as f:
        while True:
            head = f.read(4)
            if len(head) < 4:
                return
            length = struct.unpack("<i", head)[0]
            if length == -1:
                length = struct.unpack("<i", f.read(4))[0]
            if length == 0:
                return
            if not 0 < length <= METADATA_LIMIT:
                raise ValueError(f"{path}: message metadata of {length} bytes")
            kind, rows, body = _message(f.read(length))
            f.seek(body, os.SEEK_CUR)
            yield kind == 3, rows


def _message(buf: bytes) -> tuple[int, int, int]:
    """Header kind, row count and body length of a flatbuffer message."""

    def field(table: int, k: int) -> int:
        vtable = table - struct.unpack_from("<i", buf, table)[0]
        size = struct.unpack_from("<H", buf, vtable)[0]
        at = struct.unpack_from("<H", buf, vtable + 4 + 2 * k)[0] if 4 + 2 * k < size else 0
        return table + at if at else 0

    root = struct.unpack_from("<I", buf, 0)[0]
    kind_at, header_at, body_at = field(root, 1), field(root, 2), field(root, 3)
    kind = buf[kind_at] if kind_at else 0
    body = struct.unpack_from("<q", buf, body_at)[0] if body_at else 0
    rows = 0
    if kind == 3 and header_at:
        header = header_at + struct.unpack_from("<I", buf, header_at)[0]
        at = field(header, 0)
        rows = struct.unpack_from("<q", buf, at)[0] if at else 0
    return kind, rows, body


def stream_rows(path: str) -> int:
    """Rows of an Arrow stream file from message headers alone."""
    return sum(n for batch, n in _messages(path) if batch)


def file_rows(path: str) -> int:
    """Rows of an Arrow file from its footer and message headers; an unreadable block counts none."""
    with opened(path) as f:
        f.seek(-10, os.SEEK_END)
        length = struct.unpack("<i", f.read(4))[0]
        f.seek(-10 - length, os.SEEK_END)
        foot = f.read(length)
        total = 0
        for at in _blocks(foot):
            try:
                f.seek(at)
                head = struct.unpack("<i", f.read(4))[0]
                n = struct.unpack("<i", f.read(4))[0] if head == -1 else head
                total += _message(f.read(n))[1]
            except (struct.error, IndexError):
                continue
    return total


def _blocks(foot: bytes) -> list[int]:
    """Offsets of the record batches in a footer."""
    root = struct.unpack_from("<I", foot, 0)[0]
    vtable = root - struct.unpack_from("<i", foot, root)[0]
    size = struct.unpack_from("<H", foot, vtable)[0]
    slot = struct.unpack_from("<H", foot, vtable + 4 + 2 * 3)[0] if 10 < size else 0
    if not slot:
        return []
    vector = root + slot + struct.unpack_from("<I", foot, root + slot)[0]
    n = struct.unpack_from("<I", foot, vector)[0]
    return [struct.unpack_from("<q", foot, vector + 4 + 24 * k)[0] for k in range(n)]


def is_arrow_file(path: str) -> bool:
    with opened(path) as f:
        return f.read(6) == b"ARROW1"


class Source:
    """One input file."""

    format = ""

    def __init__(self, path: str):
        self.path = path if remote(path) else local(path)
        size(self.path)  # an error where there is no file

    def schema(self) -> pa.Schema:
        raise NotImplementedError

    def row_count(self) -> int:
        raise NotImplementedError

    def scan(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError


class ParquetSource(Source):
    format = "parquet"

    @cached_property
    def meta(self) -> pq.FileMetaData:
        with opened(self.path) as f:
            return pq.read_metadata(f)

    def schema(self) -> pa.Schema:
        return self.meta.schema.to_arrow_schema()

    def row_count(self) -> int:
        return self.meta.num_rows

    def spark_reads(self) -> bool:
        """Whether Spark's own reader takes the file: it knows neither half floats, nanoseconds, times nor byte-stream-split pages."""
        m = self.meta
        split = any("BYTE_STREAM_SPLIT" in m.row_group(g).column(c).encodings for g in range(min(1, m.num_row_groups)) for c in range(m.num_columns))
        odd = lambda x: pa.types.is_float16(x) or pa.types.is_time(x) or (pa.types.is_timestamp(x) and x.unit == "ns")
        return not split and not any(odd(leaf.type) for leaf in leaves(self.schema()))

    def scan(self, spark: SparkSession) -> DataFrame:
        if self.spark_reads():
            return spark.read.parquet(self.path)
        spark.dataSource.register(ParquetGroups)
        return spark.read.format("parquet_groups").option("path", self.path).load()


class ArrowSource(Source):
    """An Arrow IPC file, or else a stream."""

    format = "arrow"

    def schema(self) -> pa.Schema:
        with opened(self.path) as f:
            return (pa.ipc.open_file(f) if is_arrow_file(self.path) else pa.ipc.open_stream(f)).schema

    def row_count(self) -> int:
        return file_rows(self.path) if is_arrow_file(self.path) else stream_rows(self.path)

    def scan(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(ArrowIpc)
        return spark.read.format("arrow_ipc").option("path", self.path).load()


def open_source(path: str, given: str | None = None) -> Source:
    kind = detect_format(path, given)
    if kind == "vortex":
        raise Unsupported(f"{path}: Spark has no reader for the Vortex format")
    return (ParquetSource if kind == "parquet" else ArrowSource)(path)


def same_schema(sources: list[Source]) -> pa.Schema:
    """The schema that all inputs share: names, types, order, nullability and metadata must be equal."""
    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        found = list(pool.map(lambda s: s.schema(), sources))
    for s, schema in zip(sources, found, strict=True):
        if not schema.equals(found[0], check_metadata=True):
            raise SchemaMismatch(f"schema mismatch for input file {s.path}")
    return found[0]


def total_rows(sources: list[Source]) -> int:
    return sum(s.row_count() for s in sources)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def scan(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """UNION ALL of the inputs in path order; Parquet inputs alone are one scan."""
    same_schema(sources)
    if all(isinstance(s, ParquetSource) and s.spark_reads() for s in sources):
        return spark.read.parquet(*[s.path for s in sources])
    return union_all([s.scan(spark) for s in sources])


def mean_row_bytes(source: Source, rows: int = 100_000) -> float:
    """Bytes in memory of a row, on average over the first rows."""
    if isinstance(source, ParquetSource):
        read = lambda f: pq.ParquetFile(f).iter_batches(8192)
    elif is_arrow_file(source.path):
        read = lambda f: (lambda r: (r.get_batch(i) for i in range(r.num_record_batches)))(pa.ipc.open_file(f))
    else:
        read = pa.ipc.open_stream
    seen = total = 0
    with opened(source.path) as f:
        for b in read(f):
            seen, total = seen + b.num_rows, total + b.nbytes
            if seen >= rows:
                break
    return total / seen if seen else 0.0
