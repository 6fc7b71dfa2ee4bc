"""Ranks within few, large groups, without a task that holds a group.

A window of Spark's gives each group to one task.  Here rows (or their distinct values) are range-sorted over all
tasks; a row's number in its group is its place in the sort, less the rows of the groups before.
Groups and keys sort ascending, nulls last, as the SQL of the reference has it; null equals null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fsio import scratch_dir
from .core import named, null_safe_equal


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their place in a sorted result: the number within each partition and the sizes of those before it.

    The sorted rows are written once: sorted again, they might be cut into other partitions.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, "placed")
    rows.withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    marked = spark.read.parquet(path)
    parts = marked.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, total = {}, 0
    for r in parts:
        before[r.p], total = total, total + r.n
    table = spark.createDataFrame([(p, b) for p, b in before.items()] or [(0, 0)], "p long, b long")
    low = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(table), F.shiftright("_m", 33) == F.col("p")).withColumn("place", low + F.col("b") + 1).drop("_m", "p", "b")


def _joined(left: DataFrame, right: DataFrame, on: list[str], add: list[str]) -> DataFrame:
    """left with columns of right, which has one row for each value of the keys."""
    other = right.select(*[named(c).alias(f"__r{i}") for i, c in enumerate(on)], *add)
    return left.join(other, null_safe_equal([named(c) for c in on], [F.col(f"__r{i}") for i in range(len(on))])).select(*[named(c) for c in left.columns], *add)


def numbered(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """df with each row's number in its group in the order of `by` (__number, from 1) and the group's rows (__rows)."""
    rows = placed(df.orderBy(named(group).asc_nulls_last(), *[named(c).asc_nulls_last() for c in by]))
    groups = rows.groupBy(named(group)).agg((F.min("place") - 1).alias("__before"), F.count(F.lit(1)).alias("__rows"))
    found = _joined(rows, F.broadcast(groups), [group], ["__before", "__rows"])
    return found.withColumn("__number", F.col("place") - F.col("__before")).drop("place", "__before")


def with_peers(df: DataFrame, group: str, key: str) -> DataFrame:
    """numbered() rows with the first and last number of those of their group that have the same key (__first, __last)."""
    peers = df.groupBy(named(group), named(key)).agg(F.min("__number").alias("__first"), F.max("__number").alias("__last"))
    return _joined(df, peers, [group, key], ["__first", "__last"])


def with_dense_rank(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """df with the dense rank of the key in its group."""
    ranks = numbered(df.select(named(group), named(key)).distinct(), group, [key]).withColumnRenamed("__number", name)
    return _joined(df, ranks, [group, key], [name])


def tile(n: int) -> Column:
    """The tile, of n, of a numbered row: the first __rows % n tiles have one row more."""
    size, more, at = F.floor(F.col("__rows") / n), F.col("__rows") % n, F.col("__number") - 1
    edge = more * (size + 1)
    return F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / F.greatest(size, F.lit(1)))) + 1
