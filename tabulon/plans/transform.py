"""The fixed dataflow: inputs, UNION ALL, query, sort, partition, exclude, write."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..errors import OptionError, Unsupported

from ..operators import core
from ..sinks import files as sinks
from ..sinks.options import ArrowOptions, ParquetOptions
from ..sources import files as sources
from . import types as T
from .options import STRATEGIES, SortSpec, choice
from .paths import OutputFile, listing_json, listing_text

#: Options of the reference's execution that mean nothing to Spark; they are accepted with a warning.
NO_MEANING = ("non_spillable_reserve", "memory_pool_top_consumers", "arrow_writing_queue_size", "parquet_buffer_size", "parquet_column_encoding_threads", "parquet_ingestion_queue_size", "parquet_encoding_queue_size", "parquet_writing_queue_size", "parquet_io_threads", "parquet_row_group_concurrency", "parquet_page_header_statistics")


@dataclass(frozen=True)
class Transform:
    """One run; either `source` or `sources`, either `to` or `to_many` (which needs `by`)."""

    source: str | None = None
    sources: tuple[str, ...] = ()
    to: str | None = None
    to_many: str | None = None
    by: tuple[str, ...] = ()
    query: str | None = None
    dialect: str = "duckdb"
    sort: SortSpec | None = None
    exclude: tuple[str, ...] = ()
    input_format: str | None = None
    output_format: str | None = None
    strategy: str = "sort-single"
    max_open_partitions: int | None = None
    preserve_order: bool = False
    overwrite: bool = False
    create_dirs: bool = True
    list_outputs: str | None = None
    list_outputs_file: str | None = None
    sorted_metadata: bool = False
    arrow: ArrowOptions = field(default_factory=ArrowOptions)
    parquet: ParquetOptions = field(default_factory=ParquetOptions)

    def check(self) -> None:
        if bool(self.source) == bool(self.sources):
            raise OptionError("give either one input or several")
        if bool(self.to) == bool(self.to_many):
            raise OptionError("give either one output or a template of many")
        if bool(self.to_many) != bool(self.by):
            raise OptionError("a template of outputs and partition columns go together")
        choice(self.strategy, STRATEGIES, "partition strategy")
        if self.max_open_partitions is not None:
            if self.strategy != "nosort-evict":
                raise OptionError("a limit of open partitions needs the strategy nosort-evict")
            if self.max_open_partitions < 1:
                raise OptionError("a limit of open partitions must be at least 1")
        if self.sorted_metadata and not self.sort:
            raise OptionError("sorted metadata needs a sort")
        if self.preserve_order and (not self.source or self.query or self.sort or self.to_many):
            raise OptionError("keeping the input order needs one input, and neither query, sort nor many outputs")


def load(spark: SparkSession, t: Transform) -> DataFrame:
    paths = [t.source] if t.source else sources.expand(list(t.sources))
    return sources.scan(spark, [sources.open_source(p, t.input_format) for p in paths])


def plan(df: DataFrame, t: Transform) -> DataFrame:
    """Query, then sort; a partitioned output sorts as it deals its rows out."""
    if t.query:
        df = core.query(df, t.query, t.dialect)
    if t.sort and not t.to_many:
        df = core.sort(df, t.sort)
    return df


def check_partition_columns(df: DataFrame, by: tuple[str, ...]) -> None:
    for c in by:
        if c not in df.columns:
            raise OptionError(f"partition column '{c}' is not among {', '.join(df.columns)}")
        kind = sinks.arrow_schema(df.select(core.named(c))).field(0).type
        if not T.can_partition(kind):
            raise OptionError(f"partition column '{c}' has type {kind}, which can't name partitions")


def run(spark: SparkSession, t: Transform) -> list[OutputFile]:
    """Execute and return the files written, in the order of their making."""
    t.check()
    df = plan(load(spark, t), t)
    target = t.to or t.to_many
    kind = sources.detect_format(target, t.output_format)
    if kind == "vortex":
        raise Unsupported(f"{target}: Spark has no writer for the Vortex format")
    options: ArrowOptions | ParquetOptions = t.arrow if kind == "arrow" else t.parquet
    if t.exclude:
        core.exclude(df, t.exclude)  # checks the names
    if t.sorted_metadata and kind == "parquet":
        options = replace(options, sorted_by=t.sort.without(t.by))
    if t.to:
        one = core.exclude(df, t.exclude) if t.exclude else df
        out = [sinks.write_single(one, t.to, options, t.overwrite, t.create_dirs)]
    else:
        check_partition_columns(df, t.by)
        out = sinks.write_partitioned(df, t.to_many, list(t.by), options, t.strategy, t.sort, list(t.exclude), t.overwrite, t.create_dirs, t.max_open_partitions or 100)
    if t.list_outputs and t.list_outputs != "none":
        text = listing_json(out) if t.list_outputs == "json" else listing_text(out)
        if t.list_outputs_file:
            with open(t.list_outputs_file, "w", encoding="utf-8") as f:
                f.write(text)
        elif text:
            print(text)
    return out


def warn_unused(names) -> None:
    for n in names:
        warnings.warn(f"option {n.replace('_', '-')} has no meaning for Spark and is passed over", stacklevel=2)
