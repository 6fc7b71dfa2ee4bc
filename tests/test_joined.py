"""Single files made of parts: the same rows, row groups and pages as one writer makes, and metadata that readers can use."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulon.inspection import inspect as I  # noqa: E741
from tabulon.operators import core
from tabulon.plans.decisions import Columns
from tabulon.plans.options import Bloom, BloomConfig, SortSpec
from tabulon.sinks import files as sinks
from tabulon.sinks.options import ParquetOptions

ROWS = 5_050


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(sinks, "PART_ROWS", 1_000)
    monkeypatch.setattr(sinks, "HELD_ROWS", 300)
    made = []
    whole = sinks.joined.join
    monkeypatch.setattr(sinks.joined, "join", lambda spark, paths, target: made.append(len(paths)) or whole(spark, paths, target))
    return made


def frame(spark):
    df = spark.range(0, ROWS, 1, 7)
    return df.select("id", (F.col("id") % 13).alias("few"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("text é "), "id")).alias("s"), F.array("id", F.lit(None)).alias("l"), F.timestamp_micros(F.col("id") - 10**13).alias("t"), F.lit(dt.date(1500, 1, 2)).alias("d"))


WRITERS = {
    "spark": ParquetOptions(row_group_rows=400, page_rows=100),
    "spark, zstd": ParquetOptions("zstd", row_group_rows=400, columns=Columns(dictionary=False, bloom=BloomConfig(None, {"id": Bloom(0.01, 400)}))),
    "pyarrow": ParquetOptions(row_group_rows=400, page_rows=100, write_batch_rows=50, offset_index=True, metadata={"owner": "me"}),
    "pyarrow without indexes": ParquetOptions("gzip", row_group_rows=400, arrow_schema=True),
}


@pytest.mark.parametrize("writer", WRITERS)
def test_parts_make_the_file_of_one_writer(spark, tmp_path, small_parts, writer):
    df, options, path = frame(spark), WRITERS[writer], str(tmp_path / "x.parquet")
    assert sinks.write_single(df, path, options).row_count == ROWS and small_parts == [7]
    m = pq.read_metadata(path)
    assert [m.row_group(g).num_rows for g in range(m.num_row_groups)] == [400] * 12 + [250] and m.num_rows == ROWS
    t = pq.read_table(path)
    assert t["id"].to_pylist() == list(range(ROWS))
    assert [tuple(r) for r in spark.read.parquet(path).orderBy("id").collect()] == [tuple(r) for r in df.orderBy("id").collect()]
    d = I.ParquetInspector(path).document(pages=True)
    assert all(c["has_page_index"] for g in d["row_groups"] for c in g["columns"]) == (writer != "pyarrow without indexes")
    if "owner" in options.metadata:
        assert d["metadata"]["owner"] == "me"
    own = [g["columns"][0]["statistics"] for g in d["row_groups"]]
    assert [(s["min"], s["max"]) for s in own] == [(f"{400 * g:,}", f"{min(ROWS, 400 * g + 400) - 1:,}") for g in range(13)]
    assert [x.name for x in tmp_path.iterdir()] == ["x.parquet"]
    # parquet-mr's reader: footer, offset and column indexes, filters
    jvm = spark._jvm
    at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
    blocks = reader.getFooter().getBlocks()
    for g in range(13):
        for k in range(2):
            c, pages = blocks.get(g).getColumns().get(k), [p for p in d["row_groups"][g]["columns"][k]["pages"] if p["type"].startswith("data")]
            index = reader.readOffsetIndex(c)
            if index is not None:
                assert [index.getOffset(i) for i in range(index.getPageCount())] == [p["offset"] for p in pages]
                assert reader.readColumnIndex(c) is not None
            if writer == "spark, zstd" and k == 0:
                assert reader.readBloomFilter(c) is not None
    reader.close()
    assert [r.id for r in spark.read.parquet(path).where("id IN (3, 2222, 5049)").orderBy("id").collect()] == [3, 2222, 5049]


def test_sorted_file_of_parts(spark, tmp_path, small_parts):
    spec, path = SortSpec.parse("few:desc,id"), str(tmp_path / "x.parquet")
    sinks.write_single(core.sort(frame(spark).repartition(5), spec), path, ParquetOptions(row_group_rows=700, sorted_by=spec))
    t = pq.read_table(path)
    assert list(zip(t["few"].to_pylist(), t["id"].to_pylist(), strict=True)) == sorted(((k % 13, k) for k in range(ROWS)), key=lambda x: (-x[0], x[1]))
    found = I.ParquetInspector(path).document()["row_groups"]
    assert small_parts == [8] and all([(x["column"], x["descending"]) for x in g["sorting_columns"]] == [("few", True), ("id", False)] for g in found)


@pytest.mark.parametrize("elsewhere", [False, True])
def test_parts_are_copied_by_their_tasks(spark, tmp_path, small_parts, monkeypatch, elsewhere):
    """On local paths each task copies one part, and the last one none; elsewhere one copies all.  The bytes are the same."""
    jobs = []
    whole = sinks.joined._mapped
    monkeypatch.setattr(sinks.joined, "remote", lambda path: elsewhere)
    monkeypatch.setattr(sinks.joined, "_mapped", lambda spark, each, f, names: jobs.append((f.__name__, len(each))) or whole(spark, each, f, names))
    path = str(tmp_path / "x.parquet")
    sinks.write_single(frame(spark), path, ParquetOptions(row_group_rows=400, encoding="plain", columns=Columns(dictionary=False, bloom=None)))
    assert jobs[3:] == ([] if elsewhere else [("_place", 7)]) + [("_finish", 1)]
    assert pq.read_table(path)["id"].to_pylist() == list(range(ROWS))


def test_pages_are_whole_up_to_the_last(spark, tmp_path):
    """Row groups end with a page: of 3,333 rows in groups of at most 1,030 and pages of at most 100 there are 34 pages."""
    path = str(tmp_path / "x.parquet")
    options = ParquetOptions(row_group_rows=1_030, page_rows=100, write_batch_rows=50, columns=Columns(dictionary=False), offset_index=True)
    sinks.write_single(spark.range(3_333), path, options)
    found = I.ParquetInspector(path).document(pages=True)["row_groups"]
    pages = [p["num_values"] for g in found for p in g["columns"][0]["pages"]]
    assert pages == [100] * 33 + [33] and [g["num_rows"] for g in found] == [1_000] * 3 + [333]
