import datetime as dt
import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulon import cli
from tabulon.errors import OptionError, OutputExists, PathCollision, SchemaMismatch, Unsupported
from tabulon.fsio import Files
from tabulon.operators import core
from tabulon.plans import transform as tr
from tabulon.plans.decisions import Columns
from tabulon.plans.options import Bloom, BloomConfig, SortSpec
from tabulon.sinks import files as sinks
from tabulon.sinks.options import ArrowOptions, ParquetOptions
from tabulon.sources import files as sources


@pytest.fixture
def regions(tmp_path):
    t = pa.table({"region": ["us", "us", "eu", "eu"], "year": pa.array([2023, 2024, 2023, 2024], pa.int32()), "value": pa.array([100, 200, 150, 250], pa.int64())})
    pq.write_table(t, tmp_path / "in.parquet")
    return str(tmp_path / "in.parquet")


def arrow_file(path, table, stream=False, rows=2):
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(str(path), table.schema) as w:
        for b in table.to_batches(max_chunksize=rows):
            w.write_batch(b)
    return str(path)


def test_detect_and_expand(tmp_path):
    assert sources.detect_format("A.PARQUET") == "parquet" and sources.detect_format("x", "arrow") == "arrow"
    with pytest.raises(OptionError):
        sources.detect_format("x.csv")
    for n in "ba":
        (tmp_path / f"{n}.arrow").write_bytes(b"")
    assert [os.path.basename(p) for p in sources.expand([f"{tmp_path}/*.arrow", f"{tmp_path}/a*", f"{tmp_path}/none*"])] == ["a.arrow", "b.arrow"]
    with pytest.raises(FileNotFoundError):
        sources.expand([f"{tmp_path}/none*"])
    with pytest.raises(Unsupported):
        sources.open_source(str(tmp_path / "x.vortex"))


@pytest.mark.parametrize("stream", [False, True])
def test_arrow_source(spark, tmp_path, stream):
    t = pa.table({"u": pa.array([1, None, 2**32 - 1], pa.uint32()), "big": pa.array([0, 2**64 - 1, None], pa.uint64()), "ns": pa.array([1500, 2500, None], pa.timestamp("ns")), "h": pa.array([1.5, None, 2.0], pa.float16()), "d": pa.array(["x", "y", "x"]).dictionary_encode(), "l": [[1], None, [2, 3]], "t": pa.array([1, 2, None], pa.time64("us"))})
    s = sources.open_source(arrow_file(tmp_path / "a.arrow", t, stream))
    assert s.row_count() == 3 and s.schema() == t.schema
    rows = s.scan(spark).orderBy(F.asc_nulls_last("t"), "u").collect()
    assert sorted((r.u for r in rows), key=lambda x: (x is None, x)) == [1, 2**32 - 1, None]
    assert {int(r.big) for r in rows if r.big is not None} == {0, 2**64 - 1}
    assert {r.ns for r in rows} == {dt.datetime(1970, 1, 1, 0, 0, 0, 1), dt.datetime(1970, 1, 1, 0, 0, 0, 2), None}
    assert {r.d for r in rows} == {"x", "y"} and {r.h for r in rows} == {1.5, None, 2.0} and [2, 3] in [r.l for r in rows]
    assert sources.mean_row_bytes(s) > 0


def test_parquet_that_spark_refuses(spark, tmp_path):
    t = pa.table({"ns": pa.array([1500, None], pa.timestamp("ns")), "f": [1.5, 2.5]})
    pq.write_table(t, tmp_path / "a.parquet", use_dictionary=False, column_encoding={"f": "BYTE_STREAM_SPLIT"}, row_group_size=1)
    s = sources.open_source(str(tmp_path / "a.parquet"))
    assert not s.spark_reads() and {r.f for r in s.scan(spark).collect()} == {1.5, 2.5}


def test_merge_needs_one_schema(spark, tmp_path):
    a = arrow_file(tmp_path / "a.arrow", pa.table({"x": [1]}))
    pq.write_table(pa.table({"x": [2]}), tmp_path / "b.parquet")
    pq.write_table(pa.table({"x": ["2"]}), tmp_path / "c.parquet")
    both = [sources.open_source(p) for p in (a, str(tmp_path / "b.parquet"))]
    assert sorted(r.x for r in sources.scan(spark, both).collect()) == [1, 2] and sources.total_rows(both) == 2
    with pytest.raises(SchemaMismatch):
        sources.scan(spark, [both[0], sources.open_source(str(tmp_path / "c.parquet"))])


def test_project_and_exclude(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "B", "c"])
    assert core.exclude(df, ["a.b"]).columns == ["B", "c"] and core.project(df, [2, "a.b"]).columns == ["c", "a.b"] and core.project(df, []).columns == []
    for f, x in ((core.exclude, ["b"]), (core.project, [3]), (core.project, ["x"])):
        with pytest.raises(OptionError):
            f(df, x)


def test_sort_nulls(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (None,), (2,)], "id int")
    assert [r.id for r in core.sort(df, SortSpec.parse("id")).collect()] == [1, 2, 3, None, None]
    assert [r.id for r in core.sort(df, SortSpec.parse("id:desc")).collect()] == [None, None, 3, 2, 1]


def test_single_file(spark, regions, tmp_path):
    out = str(tmp_path / "deep" / "out.parquet")
    t = tr.Transform(source=regions, to=out, query="SELECT region, value * 2 AS v FROM data WHERE year = 2024", sort=SortSpec.parse("v:desc"), exclude=("region",))
    assert tr.run(spark, t)[0].row_count == 2
    assert pq.read_table(out).to_pydict() == {"v": [500, 400]} and os.listdir(tmp_path / "deep") == ["out.parquet"]
    with pytest.raises(OutputExists):
        tr.run(spark, t)


@pytest.mark.parametrize("how", [ArrowOptions("zstd", "file", 3), ArrowOptions("lz4", "stream"), ArrowOptions()])
def test_arrow_sink(spark, tmp_path, how):
    path = f"{tmp_path}/x.arrow"
    sinks.write_single(spark.range(10).coalesce(1), path, how)
    with open(path, "rb") as f:
        r = pa.ipc.open_stream(f) if how.layout == "stream" else pa.ipc.open_file(f)
        t = r.read_all()
    assert t.column("id").to_pylist() == list(range(10))
    if how.batch_rows == 3:
        with pa.ipc.open_file(path) as r:
            assert [r.get_batch(i).num_rows for i in range(r.num_record_batches)] == [3, 3, 3, 1]
    assert sources.ArrowSource(path).row_count() == 10


@pytest.mark.parametrize("options", [ParquetOptions(), ParquetOptions("zstd", arrow_schema=True), ArrowOptions()])
def test_empty_single(spark, tmp_path, options):
    path = f"{tmp_path}/e.{'arrow' if isinstance(options, ArrowOptions) else 'parquet'}"
    sinks.write_single(spark.range(10).where("id < 0"), path, options)
    s = sources.open_source(path)
    assert s.row_count() == 0 and s.schema().names == ["id"]


STRATEGIES = [("sort-single", ParquetOptions()), ("nosort-multi", ParquetOptions()), ("nosort-evict", ParquetOptions()), ("sort-single", ArrowOptions()), ("sort-single", ParquetOptions("brotli"))]


@pytest.mark.parametrize("strategy,options", STRATEGIES)
def test_strategies_give_equal_rows(spark, tmp_path, strategy, options):
    df = spark.createDataFrame([(i + 1, c, (i + 1) * 10) for i, c in enumerate("xyxyzx")], "id int, category string, value int")
    ext = "arrow" if isinstance(options, ArrowOptions) else "parquet"
    found = sinks.write_partitioned(df, f"{tmp_path}/{{{{category}}}}.{ext}", ["category"], options, strategy, SortSpec.parse("id:desc") if strategy == "sort-single" else None)
    assert sum(f.row_count for f in found) == 6
    rows = {}
    for f in found:
        t = pq.read_table(f.path) if ext == "parquet" else pa.ipc.open_file(f.path).read_all()
        assert t.num_rows == f.row_count and set(t.column("category").to_pylist()) == {f.partition_values[0][1]}
        rows.setdefault(f.partition_values[0][1], []).extend(t.column("id").to_pylist())
    assert {k: sorted(v) for k, v in rows.items()} == {"x": [1, 3, 6], "y": [2, 4], "z": [5]}
    if strategy == "sort-single":
        assert rows["x"] == [6, 3, 1]
    if strategy == "nosort-multi":
        assert rows["x"] == [1, 3, 6]


def test_evict_numbers_files(spark, tmp_path):
    df = spark.createDataFrame([(c,) for c in "abcab"], "c string").coalesce(1)
    found = sinks.write_partitioned(df, f"{tmp_path}/{{{{c}}}}.parquet", ["c"], ParquetOptions(), "nosort-evict", cap=2)
    assert sorted(os.path.basename(f.path) for f in found) == ["a.parquet", "a_1.parquet", "b.parquet", "b_1.parquet", "c.parquet"]


def test_null_and_empty_collide(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), ("", 2)], "k string, v int")
    with pytest.raises(PathCollision):
        sinks.write_partitioned(df, f"{tmp_path}/{{{{k}}}}.parquet", ["k"], ParquetOptions(), overwrite=True)
    assert sinks.write_partitioned(df.where("v > 9"), f"{tmp_path}/{{{{k}}}}.parquet", ["k"], ParquetOptions()) == []


def test_partition_columns(spark, regions, tmp_path):
    t = tr.Transform(source=regions, to_many=f"{tmp_path}/o/{{{{region}}}}/{{{{year}}}}.parquet", by=("region", "year"), exclude=("year",))
    found = tr.run(spark, t)
    assert [f.path.removeprefix(f"{tmp_path}/o/") for f in found] == ["eu/2023.parquet", "eu/2024.parquet", "us/2023.parquet", "us/2024.parquet"]
    assert pq.read_table(found[0].path).column_names == ["region", "value"]
    for by in (("nope",), ("l",)):
        df = spark.createDataFrame([([1],)], "l array<int>")
        with pytest.raises(OptionError):
            tr.check_partition_columns(df, by)


@pytest.mark.parametrize("bad", [{"source": None}, {"to": None}, {"by": ("a",)}, {"max_open_partitions": 3}, {"sorted_metadata": True}, {"preserve_order": True, "query": "SELECT 1"}, {"strategy": "x"}])
def test_conflicts(bad):
    with pytest.raises(OptionError):
        tr.Transform(**{"source": "a.parquet", "to": "b.parquet", **bad}).check()


def test_parquet_options_reach_the_file(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("few"), F.concat(F.lit("s"), F.col("id")).alias("s"), F.rand(1).alias("f"))
    path = f"{tmp_path}/a.parquet"
    sinks.write_single(df, path, ParquetOptions("zstd", row_group_rows=300, columns=Columns(bloom=BloomConfig(None, {"s": Bloom(0.01, 1000)}))))
    m = pq.read_metadata(path)
    assert [m.row_group(i).num_rows for i in range(m.num_row_groups)] == [300, 300, 300, 100]
    c = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for i in range(4)}
    assert c["few"].has_dictionary_page and not c["id"].has_dictionary_page and c["s"].compression == "ZSTD"
    assert "DELTA_BINARY_PACKED" in c["id"].encodings
    path = f"{tmp_path}/b.parquet"
    sinks.write_single(df, path, ParquetOptions("lz4", column_encodings={"s": "delta-byte-array"}, sorted_by=SortSpec.parse("id"), offset_index=True))
    g = pq.read_metadata(path).row_group(0)
    c = {g.column(i).path_in_schema: g.column(i) for i in range(4)}
    assert "DELTA_BYTE_ARRAY" in c["s"].encodings and "BYTE_STREAM_SPLIT" in c["f"].encodings and c["id"].has_offset_index
    assert g.sorting_columns[0].column_index == 0 and not g.sorting_columns[0].nulls_first
    for bad in (ParquetOptions(column_encodings={"s": "rle"}), ParquetOptions(column_encodings={"zz": "plain"}), ParquetOptions(columns=Columns(always=("s",), never=("s",)))):
        with pytest.raises(OptionError):
            sinks.write_single(df, f"{tmp_path}/c.parquet", bad)


def test_statistics_and_version(spark, tmp_path):
    for v, stats in (("v1", "none"), ("v2", "chunk")):
        path = f"{tmp_path}/{v}.parquet"
        sinks.write_single(spark.range(10), path, ParquetOptions("gzip", 5, version=v, statistics=stats))
        c = pq.read_metadata(path).row_group(0).column(0)
        assert c.compression == "GZIP" and c.is_stats_set == (stats != "none")


def test_split_merge_round_trip(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for options, ext in ((ParquetOptions(), "parquet"), (ArrowOptions("lz4"), "arrow")):
        sinks.write_partitioned(orders, f"{tmp_path}/{{{{o_orderstatus}}}}.{ext}", ["o_orderstatus"], options)
        merged = sources.scan(spark, [sources.open_source(p) for p in sources.expand([f"{tmp_path}/*.{ext}"])])
        assert core.symmetric_difference(orders, merged).isEmpty()


def test_type_fidelity(spark, tmp_path):
    df = spark.sql("SELECT CAST(1 AS TINYINT) i8, CAST(2 AS SMALLINT) i16, 3 i32, 4L i64, CAST(1.5 AS FLOAT) f, 2.5D d, true b, 'x' s, CAST(NULL AS INT) n, TIMESTAMP_NTZ '2020-01-01 00:00:01' t, DATE '2020-02-03' dd, CAST(1.23 AS DECIMAL(10,2)) dec, X'00ff' bin, map('k', 1) m, named_struct('a', 1) st, array(1, 2) l")
    for name, options in (("a.parquet", ParquetOptions()), ("b.parquet", ParquetOptions("zstd", arrow_schema=True)), ("c.arrow", ArrowOptions())):
        sinks.write_single(df, f"{tmp_path}/{name}", options)
        back = sources.open_source(f"{tmp_path}/{name}").scan(spark)
        assert back.dtypes == df.dtypes and back.first() == df.first(), name


def test_cli(spark, regions, tmp_path, capsys):
    out = f"{tmp_path}/c/{{{{region}}}}.parquet"
    assert cli.main(["transform", "--from", regions, "--to-many", out, "--by", "region", "--list-outputs", "json", "--parquet-compression", "snappy"]) == 0
    assert [x["row_count"] for x in json.loads(capsys.readouterr().out)] == [2, 2]
    assert cli.main(["transform", "--from", regions, "--to-many", out, "--by", "region"]) == 1
    assert cli.main(["transform", "--from", regions, "--to", f"{tmp_path}/x.vortex"]) == 1
    assert cli.main(["transform", "--from-many", f"{tmp_path}/c/*.parquet", "--to", f"{tmp_path}/m.arrow", "--arrow-format", "stream", "-s", "value:desc", "-e", "year"]) == 0
    assert sources.ArrowSource(f"{tmp_path}/m.arrow").row_count() == 4
    assert cli.main(["transform", "--from", regions, "--to", f"{tmp_path}/y.parquet", "--parquet-compression", "lz4", "--parquet-compression-level", "1"]) == 1
    assert cli.main(["transform", "--from", regions, "--to", f"{tmp_path}/y.parquet", "--parquet-bloom-column", "region", "--parquet-bloom-column-off", "region"]) == 1
    with pytest.warns(UserWarning):
        assert cli.main(["transform", "--from", regions, "--to", f"{tmp_path}/z.parquet", "--parquet-io-threads", "2"]) == 0
    assert cli.main(["inspect", "identify", f"{tmp_path}/m.arrow"]) == 0
    assert json.loads(capsys.readouterr().out.rpartition("}{")[2] or "{}") is not None
    assert not glob.glob(f"{tmp_path}/**/.tabulon*", recursive=True)


def test_bloom_filters_that_cannot_be_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    options = ParquetOptions("zstd", columns=Columns(bloom=BloomConfig(None, {"s": Bloom(0.01, 10)})), offset_index=True)
    with pytest.raises(Unsupported):
        sinks.write_single(df, f"{tmp_path}/x.parquet", options)
    assert not os.path.exists(f"{tmp_path}/x.parquet")
    sinks.write_single(df, f"{tmp_path}/x.parquet", ParquetOptions("zstd", offset_index=True))


def test_partitions_of_one_hash(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v long")
    clash = lambda *c: F.when(F.lit(len(c) > 1), F.xxhash64(*c)).otherwise(F.lit(7).cast("long"))
    rows, values = sinks._keyed(df, ["k"], clash)
    assert set(values.values()) == {(None,), ("a",), ("b",)}
    assert {r.v: values[r["__key"]] for r in rows.collect()} == {1: ("a",), 2: ("b",), 3: ("b",), 4: (None,)}


def test_inputs_by_uri(spark, sf_dir, tmp_path):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    for out in ("a.parquet", "b.parquet", "a.arrow"):
        tr.run(spark, tr.Transform(source=f"file://{sf_dir}/nation.parquet", to=f"file://{tmp_path}/{out}"))
    found = sources.expand([f"file://{tmp_path}/*.parquet"])
    assert len(found) == 2 and sources.total_rows([sources.open_source(p) for p in found]) == 2 * n
    assert sources.open_source(f"file://{tmp_path}/a.arrow").scan(spark).count() == n
    assert [f.rpartition("/")[2] for f in Files(spark).glob(f"file://{tmp_path}/*.parquet")] == ["a.parquet", "b.parquet"]
    with pytest.raises(FileNotFoundError):
        sources.open_source(f"file://{tmp_path}/none.parquet")
