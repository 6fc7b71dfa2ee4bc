"""Ranks in large groups: as the SQL has them, with ties, nulls and groups smaller than the tiles, and without a window that takes a group to one task."""

import random

from tabulon.operators import windows
from tabulon.plans import registry
from tabulon.plans import catalog


def test_ranks_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    rows = [(k, rng.choice([*range(40), None]), rng.choice(["F", "O", None]), rng.choice([1.5, 2.25, -0.0, 0.0, None, float(k)])) for k in range(4_001)]
    rows += [(5_000, 1, "one", 1.0), (5_001, 1, "three", 1.0), (5_002, None, "three", 1.0), (5_003, 2, "three", None), (5_004, 9, "", 3.0), (5_005, 9, "", 3.0)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["window_rank"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and got.dtypes == [("o_orderkey", "bigint"), ("r", "bigint"), ("d", "bigint"), ("q", "bigint"), ("p", "double"), ("c", "double")]
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    expected = c.sql(registry.SQL["window_rank"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_tiles_of_small_groups(spark):
    for n in range(1, 14):
        rows = windows.numbered(spark.range(n).selectExpr("id", "'g' AS g"), "g", ["id"])
        tiles = [r.t for r in rows.select("id", windows.tile(4).alias("t")).orderBy("id").collect()]
        assert tiles == [k + 1 for k in range(4) for _ in range(n // 4 + (k < n % 4))]
