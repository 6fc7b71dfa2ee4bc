"""Arrow IPC as a Spark data source: a partition for each range of record batches of a file, one for a stream."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.types import spark_readable

#: Bytes of record batches that one partition reads, about.
PARTITION_BYTES = 64 << 20


def open_input(path: str):
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(at)


def reader(f):
    """A reader of the file format, or else of the stream format."""
    magic = f.read(6)
    f.seek(0)
    return pa.ipc.open_file(f) if magic == b"ARROW1" else pa.ipc.open_stream(f)


def target_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(x.name, spark_readable(x.type), x.nullable) for x in schema])


def _cast(column: pa.Array, to: pa.DataType) -> pa.Array:
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.type == to:
        return column
    if pa.types.is_time(column.type):
        column = column.cast(pa.int32() if pa.types.is_time32(column.type) else pa.int64())
    if pa.types.is_uint64(column.type) and pa.types.is_decimal(to):
        return pa.array([None if v is None else int(v) for v in column.to_pylist()], pa.decimal128(20, 0)) if column.null_count or len(column) else pa.array([], to)
    return column.cast(to, safe=False)


def convert(batch: pa.RecordBatch, to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_cast(c, f.type) for c, f in zip(batch.columns, to, strict=True)], schema=to)


@dataclass
class Batches(InputPartition):
    first: int
    last: int  # exclusive; -1: a stream


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with open_input(self.path) as f:
            r = reader(f)
            if not isinstance(r, pa.RecordBatchFileReader):
                return [Batches(0, -1)]
            n = r.num_record_batches
            per = max(1, int(n * PARTITION_BYTES / max(1, f.size())))
        return [Batches(i, min(n, i + per)) for i in range(0, n, per)] or [Batches(0, 0)]

    def read(self, partition):
        with open_input(self.path) as f:
            r = reader(f)
            to = target_schema(r.schema)
            batches = r if partition.last < 0 else (r.get_batch(i) for i in range(partition.first, partition.last))
            for b in batches:
                yield convert(b, to)


class ArrowIpc(DataSource):
    """spark.read.format("arrow_ipc").option("path", ...)"""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        with open_input(self.options["path"]) as f:
            return from_arrow_schema(target_schema(reader(f).schema), prefer_timestamp_ntz=True)

    def reader(self, schema):
        return ArrowIpcReader(self.options["path"])


class ParquetGroupsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with open_input(self.path) as f:
            n = pq.read_metadata(f).num_row_groups
        return [Batches(i, i + 1) for i in range(n)] or [Batches(0, 0)]

    def read(self, partition):
        with open_input(self.path) as f:
            file = pq.ParquetFile(f)
            to = target_schema(file.schema_arrow)
            for b in file.iter_batches(8192, row_groups=list(range(partition.first, partition.last))):
                yield convert(b, to)


class ParquetGroups(DataSource):
    """Parquet files with types or encodings that Spark's own reader refuses: a partition for each row group."""

    @classmethod
    def name(cls) -> str:
        return "parquet_groups"

    def schema(self):
        with open_input(self.options["path"]) as f:
            return from_arrow_schema(target_schema(pq.read_schema(f)), prefer_timestamp_ntz=True)

    def reader(self, schema):
        return ParquetGroupsReader(self.options["path"])
