"""Queries over the driver's tables that exercise the engine's operators, and DuckDB SQL for each."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fsio import local, scratch_dir
from ..inspection.inspect import ParquetInspector
from ..operators import core, windows
from ..sinks import files as sinks
from ..sinks.options import ArrowOptions, ParquetOptions
from ..sources import files as sources
from . import catalog_files, decisions, registry
from .decisions import Columns
from .options import SortSpec
from .paths import OutputFile
from .registry import Query
from .registry import query as _query
from .registry import table as _table

__all__ = ["catalog_files", "flagship", "oracle_sql", "queries"]


def _sql(name: str, table: str, text: str, oracle: str | None = None, dialect: str = "duckdb") -> None:
    """A query in SQL over the table `data`; the oracle is the same text where none is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return core.query(_table(spark, sf_dir, table), text, dialect)

    run.__name__ = name
    _query((oracle or text).replace(" data", f" {table}"))(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, query and sort: finished orders of some value, dearest first."""
    rows = core.query(_table(spark, sf_dir, "orders"), "SELECT * FROM data WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
    return core.sort(rows, SortSpec.parse("o_totalprice:desc,o_orderkey"))


@_query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def query_filter(spark, sf_dir):
    return flagship(spark, sf_dir)


@_query("SELECT * FROM orders")
def passthrough(spark, sf_dir):
    return _table(spark, sf_dir, "orders")


@_query("SELECT * FROM orders")
def merge_union_all(spark, sf_dir):
    """UNION ALL of the orders parted by status."""
    o = _table(spark, sf_dir, "orders")
    return core.union_all(*(o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")), o.where(~F.coalesce(F.col("o_orderstatus").isin("F", "O", "P"), F.lit(False))))


@_query("SELECT * EXCLUDE (o_totalprice, o_orderpriority) FROM orders")
def exclude_columns(spark, sf_dir):
    return core.exclude(_table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderpriority"])


@_query("SELECT o_totalprice, o_orderkey FROM orders")
def project_columns(spark, sf_dir):
    return core.project(_table(spark, sf_dir, "orders"), ["o_totalprice", 0])


_sql("query_select", "customer", "SELECT c_custkey, c_name FROM data WHERE c_acctbal >= 0 AND c_mktsegment != 'BUILDING'")
_sql("query_computed", "customer", "SELECT c_custkey, UPPER(c_name) AS name, c_nationkey * 2 AS doubled FROM data")
_sql("query_predicates", "orders", "SELECT o_orderkey FROM data WHERE (o_orderstatus IN ('F', 'O') OR NOT o_totalprice < 1000) AND o_totalprice BETWEEN 500 AND 200000 AND o_orderpriority LIKE '%U%' AND o_custkey IS NOT NULL AND o_orderstatus IS DISTINCT FROM 'P'")
_sql("query_case", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band, COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS status FROM data")
_sql("query_cast", "orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, TRY_CAST(o_orderstatus AS INT) AS bad, o_totalprice::DOUBLE AS price FROM data")
_sql("recast_date", "orders", "SELECT * EXCLUDE (o_orderdate), arrow_cast(o_orderdate, 'Date32') AS o_orderdate FROM data", "SELECT * EXCLUDE (o_orderdate), CAST(o_orderdate AS DATE) AS o_orderdate FROM data")
_sql("lpad_concat", "customer", "SELECT c_custkey, LPAD(CAST(c_custkey AS VARCHAR), 10, '0') AS padded, CONCAT(c_name, '-', c_mktsegment) AS label, c_name || '!' AS bang FROM data")
_sql("scalar_strings", "customer", "SELECT c_custkey, strpos(c_name, '#') AS at, btrim(c_mktsegment) AS seg, reverse(c_name) AS rev, substring(c_name, 2, 4) AS part, length(c_name) AS n, to_hex(c_custkey) AS h, md5(c_name) AS m FROM data", "SELECT c_custkey, CAST(instr(c_name, '#') AS INT) AS at, trim(c_mktsegment) AS seg, reverse(c_name) AS rev, substring(c_name, 2, 4) AS part, CAST(length(c_name) AS INT) AS n, lower(to_hex(c_custkey)) AS h, md5(c_name) AS m FROM data")
_sql("scalar_math", "lineitem", "SELECT l_orderkey, l_linenumber, abs(l_discount - 1) AS a, ceil(l_quantity / 7) AS c, power(l_linenumber, 2) AS p, greatest(l_tax, l_discount) AS g, l_orderkey % 7 AS m FROM data", "SELECT l_orderkey, l_linenumber, abs(l_discount - 1) AS a, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, power(l_linenumber, 2) AS p, greatest(l_tax, l_discount) AS g, l_orderkey % 7 AS m FROM data")
_sql("scalar_dates", "orders", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, date_part('year', o_orderdate) AS year, extract(day FROM o_orderdate) AS day FROM data", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(date_part('year', o_orderdate) AS INT) AS year, CAST(extract(day FROM o_orderdate) AS INT) AS day FROM data")
_sql("array_functions", "customer", "SELECT c_custkey, array_length(string_to_array(c_name, '#')) AS n, array_to_string(make_array(c_mktsegment, 'x'), '-') AS j, array_has(make_array(1, 2, c_nationkey), 7) AS has FROM data", "SELECT c_custkey, CAST(len(string_split(c_name, '#')) AS INT) AS n, array_to_string([c_mktsegment, 'x'], '-') AS j, list_contains([1, 2, c_nationkey], 7) AS has FROM data")
_sql("generate_series", "region", "SELECT r.r_regionkey, g.value FROM data r CROSS JOIN generate_series(1, 3) g", "SELECT r.r_regionkey, CAST(g.value AS INT) AS value FROM region r CROSS JOIN (SELECT unnest([1, 2, 3]) AS value) g")
_sql("count_rows", "orders", "SELECT COUNT(*) AS n FROM data")
_sql("group_sum_qty", "lineitem", "SELECT l_returnflag, SUM(l_quantity) AS sum_qty FROM data GROUP BY l_returnflag ORDER BY l_returnflag")
_sql("group_count_avg", "orders", "SELECT o_orderstatus, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean FROM data GROUP BY o_orderstatus")
_sql("group_having", "orders", "SELECT o_custkey, COUNT(*) AS n, COUNT(DISTINCT o_orderstatus) AS kinds, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM data GROUP BY o_custkey HAVING COUNT(*) > 5")
_sql("grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM data GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("rollup_cube", "lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM data GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("statistics", "lineitem", "SELECT l_returnflag, ROUND(stddev(l_quantity), 6) AS sd, ROUND(median(l_quantity), 6) AS med, ROUND(corr(l_quantity, l_extendedprice), 6) AS c, ROUND(var_pop(l_quantity), 5) AS v FROM data GROUP BY ALL")
_sql("bool_bit_aggregates", "lineitem", "SELECT l_linestatus, bool_and(l_quantity > 0) AS every, bool_or(l_discount > 0.09) AS some, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo, bit_xor(l_orderkey) AS bx FROM data GROUP BY 1")
_sql("window_lag", "orders", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS later, first_value(o_orderkey) OVER w AS f, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM data WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_sql("window_row_number", "orders", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS n FROM data")
_sql("topk", "orders", "SELECT o_orderkey, o_totalprice FROM data ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_sql("self_join", "orders", "SELECT a.o_orderkey, b.n FROM data a JOIN (SELECT o_custkey, COUNT(*) AS n FROM data GROUP BY o_custkey) b USING (o_custkey)")
_sql("left_join", "orders", "SELECT a.o_orderkey, b.o_orderkey AS later FROM data a LEFT JOIN data b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderstatus = 'P'")
_sql("semi_anti", "orders", "SELECT o_orderkey FROM data a WHERE EXISTS (SELECT 1 FROM data b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P') AND o_custkey NOT IN (SELECT o_custkey FROM data WHERE o_totalprice > 400000)")
_sql("correlated", "orders", "SELECT o_orderkey FROM data a WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM data b WHERE b.o_orderstatus = a.o_orderstatus)")
_sql("full_join", "orders", "SELECT f.o_custkey AS a, p.o_custkey AS b FROM (SELECT DISTINCT o_custkey FROM data WHERE o_orderstatus = 'F') f FULL JOIN (SELECT DISTINCT o_custkey FROM data WHERE o_orderstatus = 'P') p ON f.o_custkey = p.o_custkey")
_sql("set_operations", "orders", "SELECT o_custkey FROM data WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM data WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM data WHERE o_orderstatus = 'P' UNION SELECT CAST(-1 AS BIGINT)")
_sql("cte", "orders", "WITH big AS (SELECT * FROM data WHERE o_totalprice > 150000) SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus")
_sql("from_first", "orders", "FROM data SELECT o_orderkey WHERE o_totalprice > 200000")
_sql("right_join", "orders", "SELECT a.o_orderkey, b.k FROM (SELECT o_orderkey, o_custkey FROM data WHERE o_orderstatus = 'P') a RIGHT JOIN (SELECT DISTINCT o_custkey AS k FROM data) b ON a.o_custkey = b.k")
_sql("natural_join", "orders", "SELECT * FROM (SELECT o_custkey, COUNT(*) AS n FROM data GROUP BY o_custkey) a NATURAL JOIN (SELECT o_custkey, MAX(o_totalprice) AS hi FROM data GROUP BY o_custkey) b")
_sql("theta_join", "region", "SELECT a.r_name, b.r_name AS later FROM data a JOIN data b ON a.r_regionkey < b.r_regionkey")
_sql("cross_join", "region", "SELECT a.r_name, b.r_name AS other FROM data a CROSS JOIN data b")
_sql("lateral_join", "nation", "SELECT r.k, x.n, x.lo FROM (SELECT DISTINCT n_regionkey AS k FROM data) r, LATERAL (SELECT COUNT(*) AS n, MIN(n_name) AS lo FROM data s WHERE s.n_regionkey = r.k) x")
_sql("query_ilike", "customer", "SELECT c_custkey FROM data WHERE c_mktsegment ILIKE 'build%'")
_sql("grouping_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS g, COUNT(*) AS n FROM data GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("regression", "lineitem", "SELECT l_returnflag, ROUND(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity), 6) AS q, ROUND(covar_pop(l_quantity, l_extendedprice), 1) AS cp, ROUND(covar_samp(l_quantity, l_extendedprice), 1) AS cs, ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope, ROUND(regr_r2(l_extendedprice, l_quantity), 8) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM data GROUP BY l_returnflag")
_sql("list_aggregates", "orders", "SELECT o_custkey, array_to_string(array_agg(o_orderstatus ORDER BY o_orderkey), ',') AS statuses, string_agg(o_orderpriority, '|' ORDER BY o_orderkey DESC) AS priorities FROM data GROUP BY o_custkey")
_sql("window_range", "orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 5000 FOLLOWING) AS near, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS month FROM data")
_sql("window_values", "orders", "SELECT o_orderkey, last_value(o_orderkey) OVER w AS z, nth_value(o_orderkey, 2) OVER w AS second, lag(NULLIF(o_orderstatus, 'P')) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS known FROM data WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "SELECT o_orderkey, last_value(o_orderkey) OVER w AS z, nth_value(o_orderkey, 2) OVER w AS second, lag(NULLIF(o_orderstatus, 'P') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS known FROM data WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_sql("qualify", "orders", "SELECT o_custkey, o_orderkey FROM data QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_sql("date_bin", "orders", "SELECT date_bin(INTERVAL '7 days', CAST(o_orderdate AS TIMESTAMP)) AS bin, COUNT(*) AS n FROM data GROUP BY 1", "SELECT time_bucket(INTERVAL '7 days', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1970-01-01') AS bin, COUNT(*) AS n FROM data GROUP BY 1")
_sql("date_text", "orders", "SELECT o_orderkey, to_char(o_orderdate, '%Y/%m, day %j') AS d FROM data", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m, day %j') AS d FROM data")
_sql("regular_expressions", "customer", "SELECT c_custkey, regexp_like(c_name, '[1-5]$') AS m, regexp_replace(c_name, '#0*', '-') AS r, c_mktsegment ~ '^B' AS b, c_name !~ '7' AS x, c_name ~* 'CUSTOMER' AS i, array_to_string(regexp_match(c_name, '([A-Za-z]+)#0*([0-9]+)'), '|') AS g FROM data", "SELECT c_custkey, regexp_matches(c_name, '[1-5]$') AS m, regexp_replace(c_name, '#0*', '-') AS r, regexp_matches(c_mktsegment, '^B') AS b, NOT regexp_matches(c_name, '7') AS x, regexp_matches(c_name, '(?i)customer') AS i, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1) || '|' || regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS g FROM data")
_sql("map_struct_functions", "region", "SELECT r_regionkey, array_to_string(map_keys(make_map(['a', r_name], [1, 2])), ',') AS k, cardinality(map_extract(make_map([r_name], [r_regionkey]), 'ASIA')) AS found, struct_pack(k := r_regionkey, v := r_name).v AS v FROM data", "SELECT r_regionkey, 'a,' || r_name AS k, CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END AS found, r_name AS v FROM data")
_sql("array_slices", "customer", "SELECT c_custkey, array_to_string(array_slice(['a', 'b', c_mktsegment], -2, -1), '+') AS tail, c_custkey // 7 AS d, trunc(c_acctbal) AS t, log(100.0) AS l FROM data", "SELECT c_custkey, 'b+' || c_mktsegment AS tail, c_custkey // 7 AS d, trunc(c_acctbal) AS t, CAST(2 AS DOUBLE) AS l FROM data")
_sql("hashes", "customer", "SELECT c_custkey, sha256(c_name) AS h, md5(c_mktsegment) AS m FROM data")
_sql("dialect_mysql", "region", 'SELECT r_regionkey, "x y" AS s FROM data WHERE r_name <> "ASIA"', "SELECT r_regionkey, 'x y' AS s FROM data WHERE r_name <> 'ASIA'", dialect="mysql")
_sql("dialect_postgres", "region", 'SELECT "r_regionkey"::TEXT AS s FROM data', dialect="postgres")
_sql("quoted_names", "orders", 'SELECT "o_orderkey" AS "the key" FROM data WHERE "o_orderstatus" = \'P\'')


@_query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS q, ROUND(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS p, ROUND(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS c FROM orders")
def window_rank(spark, sf_dir):
    """Ranks in three groups that each hold a large share of the table."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    rows = windows.with_peers(windows.numbered(o, "o_orderstatus", ["o_totalprice", "o_orderkey"]), "o_orderstatus", "o_totalprice")
    rows = windows.with_dense_rank(rows, "o_orderstatus", "o_custkey", "d")
    n = F.col("__rows")
    share = F.when(n > 1, (F.col("__first") - 1) / (n - 1)).otherwise(F.lit(0.0))
    return rows.select("o_orderkey", F.col("__first").alias("r"), "d", windows.tile(4).cast("long").alias("q"), F.round(share, 9).alias("p"), F.round(F.col("__last") / n, 9).alias("c"))


@_query("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_rank_asc(spark, sf_dir):
    """Partition columns first, ascending, then the sort's others."""
    spec = SortSpec.parse("o_totalprice:desc,o_orderstatus:desc,o_orderkey").after(["o_orderstatus"])
    return _placed(core.sort(_table(spark, sf_dir, "orders"), spec).select("o_orderkey"))


_placed = windows.placed


@_query("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'P') ASC NULLS LAST, NULLIF(o_custkey % 3, 0) DESC NULLS FIRST, o_orderkey) AS place FROM orders")
def sort_nulls(spark, sf_dir):
    """Ascending has nulls last, descending first."""
    rows = core.query(_table(spark, sf_dir, "orders"), "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s, NULLIF(o_custkey % 3, 0) AS c FROM data")
    return _placed(core.sort(rows, SortSpec.parse("s,c:desc,o_orderkey")).select("o_orderkey"))


@_query("SELECT COUNT(*) AS n FROM ((SELECT * FROM orders EXCEPT ALL SELECT * FROM orders WHERE o_orderstatus <> 'P') UNION ALL (SELECT * FROM orders WHERE o_orderstatus <> 'P' EXCEPT ALL SELECT * FROM orders))")
def symdiff(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return core.symmetric_difference(o, o.where("o_orderstatus <> 'P'")).agg(F.count(F.lit(1)).alias("n"))


def _manifest(spark: SparkSession, base: str, found: list[OutputFile]) -> DataFrame:
    return spark.createDataFrame([(f.path.removeprefix(base + "/"), f.row_count) for f in found], "path string, row_count long")


def _partitioned(spark, df, template, by, options=None, **how) -> DataFrame:
    base = scratch_dir(spark, "partitions")
    return _manifest(spark, base, sinks.write_partitioned(df, f"{base}/{template}", by, options or ParquetOptions(), **how))


@_query("SELECT 'type=' || event_type || '/part.parquet' AS path, COUNT(*) AS row_count FROM events GROUP BY event_type")
def partition_manifest(spark, sf_dir):
    """Files really written, one for each value, with rows as their footers say."""
    return _partitioned(spark, _table(spark, sf_dir, "events"), "type={{event_type}}/part.parquet", ["event_type"], sort=SortSpec.parse("ts:desc"))


@_query("SELECT event_type || '.arrow' AS path, COUNT(*) AS row_count FROM events GROUP BY event_type")
def partition_manifest_arrow(spark, sf_dir):
    return _partitioned(spark, _table(spark, sf_dir, "events"), "{{event_type}}.arrow", ["event_type"], ArrowOptions("zstd"), strategy="nosort-multi")


@_query("SELECT 'm=' || replace(strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%S'), ':', '%3A') || '/s=' || o_orderstatus || '.parquet' AS path, COUNT(*) AS row_count FROM orders GROUP BY ALL")
def partition_manifest_ts(spark, sf_dir):
    rows = core.query(_table(spark, sf_dir, "orders"), "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, o_orderstatus AS s, o_orderkey FROM data")
    return _partitioned(spark, rows, "m={{m}}/s={{s}}.parquet", ["m", "s"])


@_query("SELECT coalesce(NULLIF(o_orderstatus, 'P'), '__HIVE_DEFAULT_PARTITION__') || '/x.parquet' AS path, COUNT(*) AS row_count FROM orders GROUP BY 1")
def hive_null(spark, sf_dir):
    rows = core.query(_table(spark, sf_dir, "orders"), "SELECT NULLIF(o_orderstatus, 'P') AS s, o_orderkey FROM data")
    return _partitioned(spark, rows, "{{s}}/x.parquet", ["s"], excluded=["s"])


@_query("SELECT r_name || x || '.parquet' AS path, CAST(1 AS BIGINT) AS row_count FROM region CROSS JOIN (VALUES (''), ('_1')) AS n(x)")
def partition_evict(spark, sf_dir):
    """At most two files open: a value that comes again gets a numbered file."""
    return _partitioned(spark, _table(spark, sf_dir, "region").unionAll(_table(spark, sf_dir, "region")), "{{r_name}}.parquet", ["r_name"], strategy="nosort-evict", cap=2)


_TYPES = ("l_returnflag", "l_shipdate", "l_suppkey", "l_orderkey", "l_linenumber")


@_query("SELECT 'l_orderkey' AS name, COUNT(DISTINCT l_orderkey) AS n, CAST(NULL AS DOUBLE) AS bytes FROM lineitem UNION ALL SELECT 'l_linenumber', COUNT(DISTINCT l_linenumber), NULL FROM lineitem UNION ALL SELECT 'l_returnflag', COUNT(DISTINCT l_returnflag), AVG(strlen(l_returnflag)) FROM lineitem")
def cardinality_exact(spark, sf_dir):
    """One pass over the table for all columns."""
    _, found = decisions.measure(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], exact=True)
    return spark.createDataFrame([(k, v.distinct, v.mean_bytes) for k, v in found.items()], "name string, n long, bytes double")


def _pays(spark, sf_dir, exact: bool) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    rows, found = decisions.measure(df, list(_TYPES), exact)
    got = decisions.decide(sinks.arrow_schema(df.select(*_TYPES)), Columns(), rows, found)
    return spark.createDataFrame([(d.name, d.dictionary) for d in got], "name string, dictionary boolean")


_PAYS = " UNION ALL ".join(f"SELECT '{c}' AS name, COUNT(DISTINCT {c}) / COUNT(*) < 0.2 AS dictionary FROM lineitem" for c in _TYPES)


@_query(_PAYS)
def dictionary_decision(spark, sf_dir):
    return _pays(spark, sf_dir, True)


@_query(_PAYS)
def dictionary_approx(spark, sf_dir):
    return _pays(spark, sf_dir, False)


@_query("SELECT 'o_orderkey' AS name, COUNT(*) AS rows, CAST(COUNT(*) - COUNT(o_orderkey) AS BIGINT) AS nulls, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders")
def inspect_nulls_minmax(spark, sf_dir):
    """From the footer of a file that the sink wrote."""
    base = scratch_dir(spark, "inspect")
    sinks.write_single(_table(spark, sf_dir, "orders").select("o_orderkey"), f"{base}/x.parquet", ParquetOptions())
    found = ParquetInspector(local(f"{base}/x.parquet")).document()
    s = pq.ParquetFile(local(f"{base}/x.parquet")).metadata
    stats = [s.row_group(g).column(0).statistics for g in range(s.num_row_groups)]
    return spark.createDataFrame([("o_orderkey", found["rows"], found["columns"][0]["total_null_count"], min(x.min for x in stats), max(x.max for x in stats))], "name string, rows long, nulls long, lo long, hi long")


@_query("SELECT * FROM orders")
def arrow_round_trip(spark, sf_dir):
    """Written as an Arrow stream, read back by the Arrow source."""
    base = scratch_dir(spark, "arrow")
    sinks.write_single(_table(spark, sf_dir, "orders"), f"{base}/x.arrow", ArrowOptions("lz4", "stream"))
    return sources.scan(spark, [sources.open_source(local(f"{base}/x.arrow"))])


@_query("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def split_merge(spark, sf_dir):
    """Split by a key with pyarrow's Parquet writer, merged again by a glob."""
    base = scratch_dir(spark, "split")
    sinks.write_partitioned(_table(spark, sf_dir, "customer"), f"{base}/{{{{c_mktsegment}}}}.parquet", ["c_mktsegment"], ParquetOptions("zstd", arrow_schema=True))
    merged = sources.scan(spark, [sources.open_source(p) for p in sources.expand([local(f"{base}/*.parquet")])])
    return merged.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
