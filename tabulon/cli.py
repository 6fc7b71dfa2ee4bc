"""Command line: transform and inspect."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import OptionError, Unsupported
from .inspection import inspect as I  # noqa: E741
from .plans import options as O  # noqa: E741
from .plans import transform as tr
from .plans.decisions import Columns
from .sinks.options import ArrowOptions, ParquetOptions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabulon", description="Convert, merge, filter, sort and partition columnar files, and inspect them.")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("transform", help="read, query, sort and write files")
    add = t.add_argument
    add("--from", dest="source")
    add("--from-many", dest="sources", action="append", default=[])
    add("--input-format", choices=O.FORMATS)
    add("--output-format", choices=O.FORMATS)
    add("--to")
    add("--to-many")
    add("--by", default="")
    add("--dialect", default="duckdb", choices=O.DIALECTS)
    add("--query", "-q")
    add("--sort-by", "-s", type=O.SortSpec.parse)
    add("--exclude-columns", "-e", default="")
    add("--memory-budget", default="total:80%", type=O.MemoryBudget.parse)
    add("--non-spillable-reserve", type=O.PoolReserve.parse)
    add("--memory-pool-top-consumers", type=int)
    add("--thread-budget", type=O.ThreadBudget.parse)
    add("--target-partitions", type=O.at_least_one)
    add("--spill-path")
    add("--spill-compression", choices=("none", "lz4", "zstd"), default="lz4")
    add("--preserve-input-order", action="store_true")
    add("--partition-strategy", default="sort-single", choices=O.STRATEGIES)
    add("--max-open-partitions", type=int)
    add("--list-outputs", choices=("none", "text", "json"), default="none")
    add("--list-outputs-file")
    add("--create-dirs", action="store_true", default=True)
    add("--overwrite", action="store_true")
    add("--arrow-compression", default="none", choices=("none", "zstd", "lz4"))
    add("--arrow-format", default="file", choices=("file", "stream"))
    add("--arrow-record-batch-size", type=O.at_least_one, default=122_880)
    add("--arrow-writing-queue-size", type=int)
    add("--parquet-bloom-all", nargs="?", const="")
    add("--parquet-bloom-all-off", action="store_true")
    add("--parquet-bloom-column", action="append", default=[])
    add("--parquet-bloom-column-off", action="append", default=[])
    add("--parquet-dictionary-all-off", action="store_true")
    add("--parquet-dictionary-column", action="append", default=[])
    add("--parquet-dictionary-column-off", action="append", default=[])
    add("--parquet-column-encoding", action="append", default=[])
    add("--parquet-compression", default="none", choices=O.COMPRESSIONS)
    add("--parquet-compression-level", type=int)
    add("--parquet-encoding", choices=O.ENCODINGS)
    add("--parquet-row-group-size", type=O.at_least_one, default=1_048_576)
    add("--parquet-sorted-metadata", action="store_true")
    add("--parquet-statistics", choices=("none", "chunk", "page"), default="chunk")
    add("--parquet-writer-version", choices=("v1", "v2"), default="v2")
    add("--parquet-data-page-size", type=O.byte_size, default=100 << 20)
    add("--parquet-data-page-row-limit", type=O.at_least_one)
    add("--parquet-dictionary-page-size", type=O.byte_size, default=1 << 30)
    add("--parquet-write-batch-size", type=O.at_least_one, default=8192)
    add("--parquet-offset-index", action="store_true")
    add("--parquet-arrow-metadata", action="store_true")
    add("--vortex-record-batch-size", type=int)
    for name in ("parquet-buffer-size", "parquet-column-encoding-threads", "parquet-ingestion-queue-size", "parquet-encoding-queue-size", "parquet-writing-queue-size", "parquet-io-threads", "parquet-row-group-concurrency"):
        add(f"--{name}")
    add("--parquet-page-header-statistics", action="store_true", default=None)

    i = sub.add_parser("inspect", help="show a file's metadata").add_subparsers(dest="kind", required=True)
    for kind in ("identify", "parquet", "arrow", "vortex"):
        k = i.add_parser(kind)
        k.add_argument("file")
        k.add_argument("--format", choices=("auto", "text", "json"), default="auto")
        if kind == "parquet":
            k.add_argument("--row-group", type=int)
            k.add_argument("--pages", nargs="?", const="")
        if kind == "arrow":
            k.add_argument("--batches", action="store_true")
            k.add_argument("--row-count", action="store_true")
        if kind == "vortex":
            for flag in ("schema", "stats", "layout"):
                k.add_argument(f"--{flag}", action="store_true")
    return p


def _list(text: str) -> tuple[str, ...]:
    return tuple(filter(None, (x.strip() for x in text.split(","))))


def to_transform(a: argparse.Namespace) -> tr.Transform:
    if a.vortex_record_batch_size is not None:
        raise Unsupported("the Vortex format can't be written here")
    tr.warn_unused(n for n in tr.NO_MEANING if getattr(a, n, None) is not None)
    everywhere = None if a.parquet_bloom_all_off else O.Bloom.parse(a.parquet_bloom_all or "")
    if a.parquet_bloom_all_off and a.parquet_bloom_all is not None:
        raise OptionError("bloom filters of all columns are both on and off")
    bloom = O.BloomConfig.build(everywhere, [O.Bloom.parse_column(x) for x in a.parquet_bloom_column], a.parquet_bloom_column_off)
    modes = [O.dictionary_column(x) for x in a.parquet_dictionary_column]
    for n, _ in modes:
        if n in a.parquet_dictionary_column_off:
            raise OptionError(f"dictionary of column '{n}' is both on and off")
    codec, level = O.compression(a.parquet_compression, a.parquet_compression_level)
    columns = Columns(not a.parquet_dictionary_all_off, tuple(n for n, m in modes if m == "always"), tuple(n for n, m in modes if m == "analyze"), tuple(a.parquet_dictionary_column_off), bloom)
    parquet = ParquetOptions(codec, level, a.parquet_row_group_size, a.parquet_writer_version, a.parquet_encoding, dict(O.column_encoding(x) for x in a.parquet_column_encoding), columns, a.parquet_statistics, a.parquet_data_page_size, a.parquet_data_page_row_limit, a.parquet_dictionary_page_size, a.parquet_write_batch_size, a.parquet_offset_index, a.parquet_arrow_metadata)
    return tr.Transform(a.source, tuple(a.sources), a.to, a.to_many, _list(a.by), a.query, a.dialect, a.sort_by, _list(a.exclude_columns), a.input_format, a.output_format, a.partition_strategy, a.max_open_partitions, a.preserve_input_order, a.overwrite, a.create_dirs, a.list_outputs, a.list_outputs_file, a.parquet_sorted_metadata, ArrowOptions(a.arrow_compression, a.arrow_format, a.arrow_record_batch_size), parquet)


def session(a: argparse.Namespace) -> SparkSession:
    """A session as the budgets ask; one that runs already is taken as it is."""
    threads = a.thread_budget.resolve() if a.thread_budget else O.cpus()
    b = SparkSession.builder.master(f"local[{threads}]").appName("tabulon")
    b = b.config("spark.driver.memory", f"{max(512, a.memory_budget.resolve() >> 20)}m").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", str(a.target_partitions or threads)).config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true")
    b = b.config("spark.shuffle.spill.compress", str(a.spill_compression != "none").lower())
    if a.spill_compression != "none":
        b = b.config("spark.io.compression.codec", a.spill_compression)
    if a.spill_path:
        b = b.config("spark.local.dir", a.spill_path)
    return b.getOrCreate()


def inspect(a: argparse.Namespace) -> str:
    as_json = I.wants_json(a.format)
    if a.kind == "identify":
        found = I.identify(a.file)
        return I.to_json(found) if as_json else " ".join(found.values())
    if a.kind == "vortex":
        return I.vortex(a.file)
    if a.kind == "parquet":
        names = list(_list(a.pages)) or None if a.pages is not None else None
        p = I.ParquetInspector(a.file)
        return I.to_json(p.document(a.pages is not None, names)) if as_json else p.text(a.row_group, a.pages is not None, names)
    r = I.ArrowInspector(a.file, a.row_count)
    return I.to_json(r.document()) if as_json else r.text(a.batches)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "inspect":
            print(inspect(a))
        else:
            t = to_transform(a)
            t.check()
            tr.run(session(a), t)
    except (ValueError, OSError, NotImplementedError, IndexError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
