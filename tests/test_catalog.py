"""Places in a sorted result that has several partitions, and the driver's entry without parts of the corpus operators."""

import builtins

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tabulon.plans import catalog


def test_places_over_several_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 40_000, 1, 6).select(F.xxhash64("id").alias("k")).orderBy("k")
        placed = [r.k for r in catalog._placed(rows).orderBy("place").collect()]
        places = [r.place for r in catalog._placed(rows).orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert placed == sorted(placed) and places == list(range(1, 40_001))


def test_rows_of_sorted_files_stay_on_the_executors(spark, tmp_path, monkeypatch):
    """Places come from the files by a scan; values that would make hidden files keep their rows."""
    from tabulon.plans import catalog_files

    rows = [(k, k, s, float(k % 3), None, "p") for k, s in enumerate([None, "_x", "a/b %", ".y", "F"] * 4)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(catalog_files.pq, "ParquetFile", lambda *a, **k: pytest.fail("read by the driver"))
    got = sorted((str(r.s), r.place, r.o_orderkey) for r in catalog_files.partition_sorted_files(spark, str(tmp_path)).collect())
    expected = []
    for s in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (-r[3], r[0]))
        expected += [(str(s), n + 1, r[0]) for n, r in enumerate(own)]
    assert got == sorted(expected)


def test_entry_without_what_the_corpus_operators_import(monkeypatch):
    import sys

    whole = builtins.__import__

    def without(name, *a, **k):
        if name.startswith(("public_tokenizers", "corpus_pipeline")) or (name == "tabulon.llm" and a[2:3] and "queries" in (a[2] or ())):
            raise ModuleNotFoundError(name, name="public_tokenizers")
        return whole(name, *a, **k)

    for name in [m for m in sys.modules if m.startswith(("tabulon.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    found = __spark_entry__.queries()
    assert set(found) == set(catalog.queries()) and "query_filter" in found
