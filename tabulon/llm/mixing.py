"""Mixing sources to target weights with a time-varying curriculum.

Targets: sources in code-point order (null last) take ``weights`` in turn and share all
words by weight; a target stops at ``most`` times its source's words, and the excess
is shared again by weight.  A source is read in the order of md5(doc_id) as often as
its target asks, the last time in part, so each document is taken whole, `most` times
at most, and each source's words come within half a document of its target.

Curriculum: ``schedules`` gives, in turn for the sources, a weight over training progress as
a line through knots.  Its integral, scaled to what the source gives, is the source's
cumulative demand; inverting it at a document's place in its source gives the
document's training position, by which the result is range-sorted.

Places within a source are prefix sums in two levels: buckets of md5 prefixes, whose number
grows with the rows, then rows in a bucket, so a source of any share is spread over
tasks.  Only one row for each source meets in one task.

Null and empty texts have size 0 and are taken 0 times; a source without words has
target 0; rows with null ids are placed by their text; columns whose names clash stay as they are; equal rows tie and give equal results up to which of them is
read first; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lacking, numbered, partitions, rest, scanned, small_batches, table
from .sides import Side, by_part

WORD = r"[^\x20\x09-\x0D]+"
#: Knots (progress, weight): early-heavy, even, late-heavy.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.6, 1.0), (1.0, 2.0)))


def source_key(source: str = "source") -> Column:
    """Never null, and in the order of code points with null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("z"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """_source, source_size, rank (from 0), target: one row for each source of sizes (_source, size)."""
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by_rank = Window.partitionBy().orderBy("_source")
    by_cap = Window.partitionBy().orderBy("_cap", "rank")
    rows = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("rank", F.row_number().over(by_rank) - 1).withColumn("_w", w)
    rows = rows.withColumn("_cap", most * F.col("source_size") / F.col("_w"))
    rows = rows.withColumn("_total", F.sum("source_size").over(every))
    below = F.coalesce(F.sum(most * F.col("source_size")).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_level", (F.col("_total") - below) / F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_cap"), F.struct("_cap", "rank", "_level"))).over(every)["_level"])
    target = F.least(F.col("_level") * F.col("_w"), (most * F.col("source_size")).cast("double"))
    return rows.select("_source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def inverse(u: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Progress at which the share u of the integral of the weight line is reached."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
        areas.append(areas[-1] + (w0 + w1) / 2 * (t1 - t0))
    whole, out = areas[-1], F.lit(knots[-1][0])
    for k in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope, rest = (w1 - w0) / (t1 - t0), u * whole - areas[k]
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        x = F.coalesce(F.try_divide(2 * rest, w0 + root), F.lit(0.0))
        out = F.when(u * whole <= areas[k + 1], t0 + F.greatest(x, F.lit(0.0))).otherwise(out)
    return out


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, schedules=SCHEDULES, rows_per_bucket: int = 20_000) -> DataFrame:
    """Every row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, copies, place (words of its source before it), rank and uid."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.col("doc_id").cast("long")
    sized = table(numbered(scanned(docs), ids.alias("doc_id"), source_key().alias("_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(F.coalesce(ids.cast("string"), F.concat(F.lit("null "), text))).alias("_h"), F.xxhash64(text).alias("_x")), "sizes")
    n = sized.count()
    digits = 0
    while 16**digits * rows_per_bucket < n:
        digits += 1
    sized = sized.withColumn("_bucket", F.substring("_h", 1, digits))
    sources = targets(sized, weights, most)
    buckets = sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n")
    buckets = buckets.select("_source", "_bucket", before.alias("_before")).join(sources, "_source")
    rows = sized.join(buckets, ["_source", "_bucket"])
    order = Window.partitionBy("_source", "_bucket").orderBy("_h", "_x")
    place = F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("place", place)
    times = F.try_divide(F.col("target"), F.col("source_size"))
    whole = F.floor(times)
    part = times - whole
    extra = F.when(F.col("place") + F.col("size") / 2 <= part * F.col("source_size"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(whole + extra, F.lit(most))).otherwise(0).cast("int")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "place", "rank", "uid")


def position(copy: Column | int = 0, schedules=SCHEDULES) -> Column:
    """Training position, 0 to 1, of a copy of a row of plan()."""
    copy = copy if isinstance(copy, Column) else F.lit(copy)
    u = F.least((copy * F.col("source_size") + F.col("place") + F.col("size") / 2) / F.col("target"), F.lit(1.0))
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        out = F.when(F.col("rank") % len(schedules) == k, inverse(u, knots)).otherwise(out)
    return F.when(F.col("copies") > copy, out)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the position of the first copy, range-sorted by position (rows not taken last)."""
    rows = plan(docs, **how).withColumn("position", position())
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy(F.asc_nulls_last("position"), "doc_id")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as training reads them: each as often as it is taken, range-sorted by position, columns as they are.

    Rows that the mix takes no word of are left out.  Rows are told apart by their file and place in it, and get
    their positions where they lie; as positions are shares of the training, the range sort needs no sample:
    a row's partition is the part of the training that it falls into.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = scanned(docs)
    uid, at = lacking(docs, "_mix_uid"), lacking(docs, "_mix_at")
    placed = plan(docs, **how).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    path = by_part(placed.select("uid", position(F.col("_copy")).alias("at")), "positions")
    rest(spark)

    def run(batches):
        side = Side(path)
        for b in batches:
            for part in side.parts(b):
                rows = part.rows("uid")
                if not rows:
                    continue
                places = part.tables[0].column("at").to_numpy()
                found = [(k, places[r]) for k, u in enumerate(part.uid) for r in rows.get(u, ())]
                if found:
                    k, x = zip(*found, strict=True)
                    taken = part.batch.take(pa.array(k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.float64)), *taken.columns], [at, *taken.schema.names])

    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = numbered(docs, *columns, name=uid).select(uid, *columns)
    schema = ", ".join([f"`{at}` double", *(f"`{k}` {t}" for k, t in rows.dtypes)])
    n = partitions(spark, docs.count(), 8_000)
    placed = rows.mapInArrow(run, schema).repartitionById(n, F.least(F.floor(F.col(at) * n), F.lit(n - 1)).cast("int"))
    return placed.sortWithinPartitions(at, uid).select(*columns)


def oracle_sql(weights: tuple[int, ...] = (5, 2, 1), most: int = 3, schedules=SCHEDULES) -> str:
    """DuckDB SQL of mix() over the table documents with unique ids."""
    cases = []
    for k, knots in enumerate(schedules):
        areas = [0.0]
        for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
            areas.append(areas[-1] + (w0 + w1) / 2 * (t1 - t0))
        arms = []
        for j in range(len(knots) - 1):
            (t0, w0), (t1, w1) = knots[j], knots[j + 1]
            rest = f"(u * {areas[-1]!r}::DOUBLE - {areas[j]!r}::DOUBLE)"
            arms.append(f"WHEN u * {areas[-1]!r}::DOUBLE <= {areas[j + 1]!r}::DOUBLE THEN {t0!r}::DOUBLE + greatest(2 * {rest} / nullif({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * (w1 - w0) / (t1 - t0)!r}::DOUBLE * {rest}, 0)), 0), 0)")
        cases.append(f"WHEN rank % {len(schedules)} = {k} THEN CASE {' '.join(arms)} ELSE {knots[-1][0]!r}::DOUBLE END")
    return rf"""
WITH sized AS (SELECT doc_id, coalesce('s' || source, 'z') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT s, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY s) - 1 AS rank FROM sized GROUP BY s),
w AS (SELECT *, [{", ".join(map(str, weights))}][rank % {len(weights)} + 1] AS w, sum(source_size) OVER () AS total FROM sources),
c AS (SELECT *, {most} * source_size / w::DOUBLE AS cap FROM w),
l AS (SELECT *, (total - coalesce(sum({most} * source_size) OVER (ORDER BY cap, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY cap, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT s, source_size, rank, coalesce(least((SELECT arg_min(level, struct_pack(cap := cap, rank := rank)) FROM l WHERE level <= cap) * w, ({most} * source_size)::DOUBLE), 0) AS target FROM l),
p AS (SELECT doc_id, size, source_size, rank, target, sum(size) OVER (PARTITION BY s ORDER BY md5(doc_id::VARCHAR)) - size AS place, floor(target / source_size) AS whole, target / source_size - floor(target / source_size) AS part FROM sized JOIN t USING (s)),
k AS (SELECT *, CASE WHEN size > 0 THEN least(whole + CASE WHEN place + size / 2.0::DOUBLE <= part * source_size THEN 1 ELSE 0 END, {most}) ELSE 0 END::INTEGER AS copies, least((place + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS u FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target, copies * size AS taken, copies, round(CASE WHEN copies > 0 THEN CASE {" ".join(cases)} END END, 9) AS position FROM k"""
