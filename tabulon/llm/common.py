"""Session helpers of the corpus operators: shared scratch tables and batch limits."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, with its scheme: spark.checkpoint.dir, or where that is unset on a local master (tests) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(f"file://{tempfile.mkdtemp(prefix='tabulon-')}")
        found = _own_dir[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path))
    return ("file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _File:
    """A Parquet file that gets its name when it is whole, so that a task that fails or runs again leaves none in part."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str):
        self.store, self.path, self.own = store, f"{folder}/{name}.parquet", f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
        self.held, self.size, self.writer, self.rows = [], 0, None, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.size += batch.nbytes
        self.rows += batch.num_rows
        if self.size > 8 << 20:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            if self.writer is None:
                self.out = self.store.open_output_stream(self.own)
                self.writer = pq.ParquetWriter(self.out, self.held[0].schema, compression="zstd")
            self.writer.write_table(pa.Table.from_batches(self.held))
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        if self.writer is not None:
            self.writer.close()
            self.out.close()
            self.store.move(self.own, self.path)


def kept(df: DataFrame, name: str, f=None, schema: str | None = None) -> DataFrame:
    """Like table(), written by the tasks' Python workers: for many small tables, as Hadoop's local file system starts a process for each file and folder.  With f, what it makes of the batches is written, by the same worker."""
    spark = df.sparkSession
    path = scratch(spark, name)
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)

    def run(batches):
        own_store, folder = fs.FileSystem.from_uri(path)
        file = _File(own_store, folder, f"{TaskContext.get().partitionId():06d}")
        for b in f(batches) if f else batches:
            if b.num_rows:
                file.add(b)
        file.close()
        yield pa.record_batch([pa.array([file.rows])], ["n"])

    df.mapInArrow(run, "n long").collect()
    return spark.read.schema(schema or df.schema).parquet(path)


def kept_by(df: DataFrame, key: str, name: str) -> str:
    """Write df in one file for each value of a long column, named by it; returns the folder."""
    path = scratch(df.sparkSession, name)
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    at = df.columns.index(key)

    def run(batches):
        own_store, folder = fs.FileSystem.from_uri(path)
        file, last, n = None, None, 0
        for b in batches:
            k = b.column(at).to_numpy()
            edges = [0, *((k[1:] != k[:-1]).nonzero()[0] + 1).tolist(), len(k)] if len(k) else []
            for a, z in itertools.pairwise(edges):
                if file is None or k[a] != last:
                    if file is not None:
                        file.close()
                    last, n = int(k[a]), n + 1
                    file = _File(own_store, folder, str(last))
                file.add(b.slice(a, z - a))
        if file is not None:
            file.close()
        yield pa.record_batch([pa.array([n])], ["n"])

    df.repartition(key).sortWithinPartitions(key).mapInArrow(run, "n long").collect()
    return path


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def rest(spark: SparkSession) -> None:
    """Let the executors collect their garbage, so that the heap that a heavy step filled is given back before the next one."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).where("java_method('java.lang.System', 'gc') is not null").count()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """A partition count that grows with the data: at least the session's, and so many that each gets about `per` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


#: Bits of a row's number within its file, in a row's identity.
_ROW_BITS = 26


def _one_scan(docs: DataFrame) -> bool:
    """Whether docs are the rows of Parquet files, each read once, perhaps filtered and with other columns."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    return "Parquet" in plan.relation().fileFormat().toString() and roots.size() == roots.distinct().size()


def scanned(docs: DataFrame) -> DataFrame:
    """docs, written to the shared folder and read back unless it is a scan of Parquet files already."""
    return docs if _one_scan(docs) else table(docs, "rows")


def numbered(docs: DataFrame, *columns: Column | str, name: str = "uid") -> DataFrame:
    """The columns of docs (see scanned()) and an identity of every row, which no way of dealing the files to tasks
    changes: a hash of the file's path (such that no two files share one) and the row's number in it."""
    meta = docs.metadataColumn("_metadata")
    files = [re.sub(r"^(\w+):///", r"\1:/", f) for f in docs.inputFiles()]  # as the metadata column writes them
    for salt in map(str, itertools.count()):
        if len({xxhash.xxh64_intdigest((f + salt).encode(), 42) >> (_ROW_BITS + 1) for f in files}) == len(files):
            break
    file = F.shiftrightunsigned(F.xxhash64(F.concat(meta["file_path"], F.lit(salt))), _ROW_BITS + 1)
    row = meta["row_index"]
    checked = F.when(row < 1 << _ROW_BITS, row).otherwise(F.raise_error("a file has too many rows").cast("long"))
    return docs.select(*columns, F.shiftleft(file, _ROW_BITS).bitwiseOR(checked).alias(name))


def lacking(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
