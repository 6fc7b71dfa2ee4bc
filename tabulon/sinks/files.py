"""Sinks that write whole files: Spark's own Parquet writer, and Arrow or Parquet through pyarrow in the tasks.

Files are first written to a staging folder beside the target; the driver then checks all
target paths and renames.  On failure the staging folder stays.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import OutputExists, PathCollision
from ..fsio import Files
from ..operators.core import named, order
from ..plans import decisions
from ..plans.options import SortSpec
from ..plans.paths import OutputFile, Template
from . import joined
from .options import ArrowOptions, ParquetOptions

#: Rows of a batch in the files that hold the rows of a single file until its parts are written.
HELD_ROWS = 16_384
#: About so many rows, and at least a row group, are a part that one task writes of a single file.
PART_ROWS = 1 << 18


def _store(path: str):
    return fs.FileSystem.from_uri(path)


class _Writer:
    """One open file in a task; `sizes` cuts what comes into batches or row groups of a fixed size."""

    def __init__(self, path: str, schema: pa.Schema, options, decided):
        store, at = _store(path)
        self.path, self.rows, self.held, self.count = path, 0, [], 0
        self.out = store.open_output_stream(at)
        if isinstance(options, ArrowOptions):
            how = pa.ipc.IpcWriteOptions(compression=None if options.compression == "none" else options.compression)
            if options.layout == "stream":
                self.writer = pa.ipc.new_stream(self.out, schema, options=how)
            else:
                self.writer = pa.ipc.new_file(self.out, schema, options=how, metadata=options.metadata or None)
            self.size = options.batch_rows
        else:
            sorting = None
            if options.sorted_by:
                sorting = [pq.SortingColumn(schema.get_field_index(n), descending=down, nulls_first=down) for n, down in options.sorted_by.columns]
            self.writer = pq.ParquetWriter(self.out, schema, sorting_columns=sorting, **options.pyarrow(schema, decided))
            if options.metadata:
                self.writer.add_key_value_metadata(options.metadata)
            self.size = options.group_rows
        self.parquet = isinstance(options, ParquetOptions)

    def add(self, batch: pa.RecordBatch) -> None:
        while batch.num_rows:
            part = batch.slice(0, self.size - self.count)
            self.held.append(part)
            self.count += part.num_rows
            batch = batch.slice(part.num_rows)
            if self.count == self.size:
                self.flush()

    def flush(self) -> None:
        if self.held:
            whole = pa.Table.from_batches(self.held).combine_chunks()
            if self.parquet:
                self.writer.write_table(whole, row_group_size=self.size)
            else:
                for b in whole.to_batches():
                    self.writer.write_batch(b)
            self.rows += self.count
        self.held, self.count = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.out.close()


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, length) of the runs of equal values in an integer column."""
    import numpy as np

    k = np.asarray(batch.column(column))
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, int)
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(k[a]), a, z - a


_WRITTEN = "key long, number int, file string, rows long, at long"


def write_in_tasks(df: DataFrame, staging: str, schema: pa.Schema, options, decided, cap: int | None) -> list:
    """Write df (with the column __key first) from its tasks, one file for each key of a task.

    With `cap`, at most so many files are open; the one used least recently is closed, and its key gets
    another, numbered file if it comes again.
    """

    def run(batches):
        open_: dict[int, _Writer] = {}
        numbers: dict[int, int] = {}
        done, task, at = [], TaskContext.get(), 0

        def start(key: int) -> _Writer:
            n = numbers[key] = numbers.get(key, -1) + 1
            w = _Writer(f"{staging}/{task.partitionId()}-{task.taskAttemptId()}-{key & (2**64 - 1):x}-{n}", schema, options, decided)
            w.key, w.number, w.order = key, n, len(done) + len(open_)
            return w

        def finish(w: _Writer) -> None:
            w.close()
            done.append((w.key, w.number, w.path, w.rows, (task.partitionId() << 32) + w.order))

        for b in batches:
            body = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns[1:], schema, strict=True)], schema=schema)
            for key, a, n in _runs(b, 0):
                w = open_.pop(key, None)
                if w is None:
                    if cap and len(open_) >= cap:
                        finish(open_.pop(next(iter(open_))))
                    w = start(key)
                open_[key] = w
                w.add(body.slice(a, n))
        for w in open_.values():
            finish(w)
        cols = list(zip(*done, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "number", "file", "rows", "at"])

    return df.mapInArrow(run, _WRITTEN).collect()


def _check_targets(files: Files, targets: list[str], overwrite: bool, create_dirs: bool) -> None:
    """Each path once, free unless overwriting, in a folder that is there or may be made."""
    taken: set[str] = set()
    for target in targets:
        if target in taken:
            raise PathCollision(f"several partitions would be written to {target}")
        taken.add(target)
        if not overwrite and files.exists(target):
            raise OutputExists(f"{target} exists; overwriting was not asked for")
        folder = target.rpartition("/")[0]
        if folder and not create_dirs and not files.exists(folder):
            raise FileNotFoundError(f"the folder {folder} does not exist")


def _commit(files: Files, moves: list[tuple[str, str]], overwrite: bool, create_dirs: bool) -> None:
    _check_targets(files, [target for _, target in moves], overwrite, create_dirs)
    for source, target in moves:
        folder = target.rpartition("/")[0]
        if folder:
            files.make_dirs(folder)
        files.move(source, target)


def arrow_schema(df: DataFrame) -> pa.Schema:
    return to_arrow_schema(df.schema)


def plan_columns(df: DataFrame, options: ParquetOptions, exact: bool = False) -> list[decisions.Decision]:
    """Dictionary and filter of each physical column; measures only what must be measured."""
    schema = arrow_schema(df)
    names = decisions.to_measure(schema, options.columns)
    rows, found = decisions.measure(df, names, exact) if names else (0, {})
    return decisions.decide(schema, options.columns, rows, found, options.dictionary_page_bytes, options.group_rows)


def write_single(df: DataFrame, path: str, options, overwrite: bool = False, create_dirs: bool = True, ordered: bool = False) -> OutputFile:
    """All rows as one file of exactly this name; without rows a file with the schema alone."""
    files = Files(df.sparkSession)
    if not overwrite and files.exists(path):
        raise OutputExists(f"{path} exists; overwriting was not asked for")
    folder = path.rpartition("/")[0] or "."
    if not files.exists(folder):
        if not create_dirs:
            raise FileNotFoundError(f"the folder {folder} does not exist")
        files.make_dirs(folder)
    staging = files.full(f"{folder}/.tabulon-{uuid.uuid4().hex}")
    schema = arrow_schema(df)
    parquet = isinstance(options, ParquetOptions)
    decided = []
    if parquet:
        options.check(schema)
        decided = plan_columns(df, options)
    files.make_dirs(staging)
    if parquet:
        source, rows = _in_parts(df, files, staging, schema, options, decided)
    else:
        got = write_in_tasks(df.select(F.lit(0).cast("long").alias("__key"), "*").coalesce(1), staging, schema, options, decided, None)
        if got:
            source, rows = got[0]["file"], got[0]["rows"]
        else:
            source, rows = f"{staging}/empty", 0
            _Writer(source, schema, options, decided).close()
    _commit(files, [(source, path)], overwrite, create_dirs)
    files.delete(staging)
    return OutputFile(path, rows)


def _in_parts(df: DataFrame, files: Files, staging: str, schema: pa.Schema, options: ParquetOptions, decided) -> tuple[str, int]:
    """df as one Parquet file in the staging folder, and its rows.

    Tasks hold their rows as they come; other tasks write parts of whole row groups of them, which are joined.
    So no task reads, sorts or encodes everything, and the groups are those that one task would write.
    """
    spark = df.sparkSession
    files.make_dirs(f"{staging}/rows")
    got = write_in_tasks(df.select(F.lit(0).cast("long").alias("__key"), "*"), f"{staging}/rows", schema, ArrowOptions("zstd", batch_rows=HELD_ROWS), [], None)
    held, total = [], 0
    for r in sorted(got, key=lambda r: r["at"]):
        held.append((r["file"], total, r["rows"]))
        total += r["rows"]
    each = options.group_rows * max(1, PART_ROWS // options.group_rows)
    ranges = spark.range(0, max(1, -(-total // each)), 1, max(1, -(-total // each)))

    def batches_of(k: int) -> Iterator[pa.RecordBatch]:
        first, end = k * each, min(total, (k + 1) * each)
        for file, at, n in held:
            a, z = max(first, at) - at, min(end, at + n) - at
            if a < z:
                store, name = _store(file)
                with store.open_input_file(name) as f:
                    r = pa.ipc.open_file(f)
                    for i in range(a // HELD_ROWS, -(-z // HELD_ROWS)):
                        start = i * HELD_ROWS
                        yield r.get_batch(i)[max(a - start, 0) : z - start]

    if options.needs_pyarrow:

        def write(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    w = _Writer(f"{staging}/{k}-{TaskContext.get().taskAttemptId()}", schema, options, decided)
                    for x in batches_of(k):
                        w.add(x)
                    w.close()
                    yield pa.record_batch([pa.array([k]), pa.array([w.path])], ["k", "file"])

        parts = [r["file"] for r in sorted(ranges.mapInArrow(write, "k long, file string").collect(), key=lambda r: r["k"])]
    else:

        def read(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    yield from batches_of(k)

        writer = ranges.mapInArrow(read, df.schema).write
        for k, v in options.spark(decided).items():
            writer = writer.option(k, v)
        writer.parquet(f"{staging}/parts")
        parts = [files.full(f) for f in files.list(f"{staging}/parts") if f.rpartition("/")[2].startswith("part-")]
    if len(parts) == 1:
        return parts[0], total
    joined.join(spark, parts, f"{staging}/whole")
    return f"{staging}/whole", total


def _footer_rows(path: str) -> int:
    store, at = _store(path)
    with store.open_input_file(at) as f:
        return pq.read_metadata(f).num_rows


def _keyed(df: DataFrame, by: list[str], hashed=F.xxhash64) -> tuple[DataFrame, dict[int, tuple]]:
    """df with the number of each row's partition in __key, and the values behind the numbers.  Numbers that two partitions share are made anew."""
    keys = [named(c) for c in by]
    texts = [F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys]
    distinct = df.select(*keys).distinct()
    for salt in itertools.count():
        mark = hashed(*texts, *[F.lit(salt)] * bool(salt))
        found = distinct.withColumn("__key", mark).collect()
        values = {r["__key"]: tuple(r[c] for c in by) for r in found}
        if len(values) == len(found):
            return df.withColumn("__key", mark), values


def write_partitioned(df: DataFrame, template: str, by: list[str], options, strategy: str = "sort-single", sort: SortSpec | None = None, excluded: list[str] | None = None, overwrite: bool = False, create_dirs: bool = True, cap: int = 100) -> list[OutputFile]:
    """One file for each value of the partition columns (with nosort-evict, one or more).

    sort-single deals each value to one task, sorted by it and then as asked.  The others deal likewise
    but keep the order in which rows come; nosort-evict keeps at most `cap` files open in its one task.
    Partition columns stay in the files unless excluded.  Without rows there is no file.
    """
    files = Files(df.sparkSession)
    t = Template(template, by)
    gone = set(excluded or ())
    kept = df.select(*[named(c) for c in df.columns if c not in gone])
    schema = arrow_schema(kept)
    decided = []
    if isinstance(options, ParquetOptions):
        options.check(schema)
        decided = plan_columns(kept, options)
    keys = [named(c) for c in by]
    spec = sort or SortSpec()
    rows, values = _keyed(df, by)
    if not values:
        return []
    if strategy == "sort-single":
        dealt = rows.repartition(*keys).sortWithinPartitions("__key", *order(spec.without(by)))
    elif strategy == "nosort-multi":
        dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartition(*keys).sortWithinPartitions("__at")
    else:
        dealt = rows.coalesce(1)
    if strategy == "nosort-multi" and spec.columns:
        dealt = rows.repartition(*keys).sortWithinPartitions(*order(spec))
    if strategy == "nosort-evict" and spec.columns:
        dealt = dealt.sortWithinPartitions(*order(spec))
    probe = t.resolve(dict(zip(by, next(iter(values.values())), strict=True)))
    base = template.partition("{{")[0].rpartition("/")[0] or probe.rpartition("/")[0] or "."
    if not files.exists(base):
        if not create_dirs:
            raise FileNotFoundError(f"the folder {base} does not exist")
        files.make_dirs(base)
    _check_targets(files, [t.resolve(dict(zip(by, v, strict=True))) for v in values.values()], overwrite, create_dirs)
    staging = files.full(f"{base}/.tabulon-{uuid.uuid4().hex}")
    columns = [named(c) for c in kept.columns]
    found = []
    if isinstance(options, ParquetOptions) and not options.needs_pyarrow and strategy != "nosort-evict":
        writer = dealt.select("__key", *columns).write.partitionBy("__key")
        for k, v in options.spark(decided).items():
            writer = writer.option(k, v)
        if strategy == "nosort-multi":
            df.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", max(len(values) + 1, cap))
        writer.parquet(staging)
        for folder in files.folders(staging):
            key = int(folder.rpartition("=")[2])
            for n, part in enumerate(f for f in files.list(folder) if f.rpartition("/")[2].startswith("part-")):
                found.append((key, n, part, _footer_rows(files.full(part))))
    else:
        files.make_dirs(staging)
        got = write_in_tasks(dealt.select("__key", *columns), staging, schema, options, decided, cap if strategy == "nosort-evict" else None)
        found = [(r["key"], r["number"], r["file"], r["rows"]) for r in sorted(got, key=lambda r: r["at"])]
    if strategy == "sort-single":  # in the order of the partition columns, nulls last
        found.sort(key=lambda x: [(v is None, 0 if v is None else v) for v in values[x[0]]])
    out, moves = [], []
    for key, number, part, n in found:
        v = dict(zip(by, values[key], strict=True))
        path = t.numbered(v, number)
        moves.append((part, path))
        out.append(OutputFile(path, n, tuple(v.items())))
    _commit(files, moves, overwrite, create_dirs)
    files.delete(staging)
    return out
