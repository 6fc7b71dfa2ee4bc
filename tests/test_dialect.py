import pytest

from tabulon.errors import OptionError, Unsupported
from tabulon.functions.dialect import rewrite
from tabulon.operators import core


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT a FROM data ORDER BY a, b DESC", "SELECT a FROM data ORDER BY a NULLS LAST , b DESC NULLS FIRST"),
        ("SELECT a FROM data ORDER BY a NULLS FIRST LIMIT 3", "SELECT a FROM data ORDER BY a NULLS FIRST LIMIT 3"),
        ("SELECT a FROM data ORDER BY ALL", "SELECT a FROM data ORDER BY ALL"),
        ("SELECT row_number() OVER (ORDER BY x DESC ROWS UNBOUNDED PRECEDING) FROM data", "SELECT row_number ( ) OVER ( ORDER BY x DESC NULLS FIRST ROWS UNBOUNDED PRECEDING ) FROM data"),
        ("SELECT CAST(a AS VARCHAR), b::TEXT FROM data", "SELECT CAST ( a AS STRING ) , b::STRING FROM data"),
        ("SELECT CAST(a AS VARCHAR(3)) FROM data", "SELECT CAST ( a AS VARCHAR ( 3 ) ) FROM data"),
        ("SELECT arrow_cast(a, 'Int8') FROM data", "SELECT CAST ( a AS TINYINT ) FROM data"),
        ("SELECT * EXCLUDE (a) FROM data", "SELECT * EXCEPT ( a ) FROM data"),
        ("SELECT approx_distinct(a), unnest(b), to_hex(c) FROM data", "SELECT approx_count_distinct ( a ) , explode ( b ) , lower ( hex ( c ) ) FROM data"),
        ("SELECT 'unnest(x) \"y\"' AS s -- strpos(a)\nFROM data", "SELECT 'unnest(x) \"y\"' AS s FROM data"),
        ("SELECT log(a), log(2, a), ln(a) FROM data", "SELECT log10 ( a ) , log ( 2 , a ) , ln ( a ) FROM data"),
        ('SELECT "A b" FROM data;', "SELECT `A b` FROM data"),
    ],
)
def test_rewrite(text, want):
    assert " ".join(rewrite(text).split()) == want


@pytest.mark.parametrize("text", ["SELECT DISTINCT a FROM data QUALIFY row_number() OVER () = 1", "SELECT date_bin(INTERVAL '1 month', b) FROM data", "SELECT to_char(a, '%Q') FROM data", "SELECT s ~* t FROM data", "SELECT a[1:2] FROM data", "SELECT array_slice(a, 1, 3, 2) FROM data", "SELECT sum(a) OVER (ORDER BY b GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM data", "SELECT digest(a, 'md5') FROM data", "SELECT arrow_cast(a, 'Weird') FROM data"])
def test_unsupported(text):
    with pytest.raises(Unsupported):
        rewrite(text)


@pytest.mark.parametrize("text", ["DROP TABLE data", "INSERT INTO data VALUES (1)", "SELECT 1; SELECT 2", "CREATE TABLE x (a INT)", "SELECT (1"])
def test_refused(text):
    with pytest.raises(OptionError):
        rewrite(text)


def test_string_quotes():
    assert rewrite('SELECT "x" FROM data', "mysql") == "SELECT 'x' FROM data"
    with pytest.raises(OptionError):
        rewrite("SELECT 1", "klingon")


def test_runs(spark):
    df = spark.createDataFrame([(1, "b"), (None, "a"), (2, None)], "id int, name string")
    assert [r.id for r in core.query(df, "SELECT id FROM data ORDER BY id").collect()] == [1, 2, None]
    assert [r.id for r in core.query(df, "SELECT id FROM data ORDER BY id DESC").collect()] == [None, 2, 1]
    assert sorted(r.value for r in core.query(df, "SELECT g.value FROM generate_series(1, 3) g").collect()) == [1, 2, 3]
    assert core.query(df, "SELECT string_to_array(coalesce(name, 'x.y'), '.') AS p FROM data WHERE id = 2").first().p == ["x", "y"]
    assert core.query(df, "SELECT sha256('a') AS h, starts_with('abc', 'ab') AS s FROM data LIMIT 1").first().s


def test_forms_of_the_other_engine(spark):
    df = spark.createDataFrame([(1, "ab-12", [5, 6, 7]), (2, "x", []), (3, None, None)], "id int, s string, a array<int>").coalesce(1)
    one = lambda sql: [tuple(r) for r in core.query(df, sql).collect()]
    assert one("SELECT [1, 2] AS x, id // 2 AS h, a[1] AS f FROM data ORDER BY id") == [([1, 2], 0, 5), ([1, 2], 1, None), ([1, 2], 1, None)]
    assert one("SELECT array_slice(a, 2, 3) AS x, array_slice(a, -2, -1) AS y, array_slice(a, 2, -1) AS z, array_slice(a, 3, 1) AS w, array_slice(a, 0, 2) AS v FROM data WHERE id = 1") == [([6, 7], [6, 7], [6, 7], [], [5, 6])]
    assert one("SELECT id FROM data WHERE s ~ '^ab' OR s ~* '^X'") == [(1,), (2,)]
    assert one("SELECT id FROM data WHERE s !~ 'ab'") == [(2,)]
    assert one("SELECT regexp_match(s, '([a-z]+)-([0-9]+)') AS m, regexp_match(s, 'b.1') AS w FROM data ORDER BY id") == [(["ab", "12"], ["b-1"]), (None, None), (None, None)]
    assert one("SELECT struct_pack(x := id, y := s).y AS y, to_char(DATE '2024-03-05', 'on %Y/%m/%d at %H') AS d FROM data WHERE id = 1") == [("ab-12", "on 2024/03/05 at 00")]
    assert one("SELECT trunc(-1.75) AS t, trunc(1.239, 2) AS u FROM data WHERE id = 1") == [(-1.0, 1.23)]
    assert one("SELECT map_extract(make_map(['a'], [1]), 'a') AS m, map_extract(make_map(['a'], [1]), 'b') AS n FROM data WHERE id = 1") == [([1], [])]
    assert one("SELECT CAST(date_bin(INTERVAL '15 minutes', TIMESTAMP '2024-01-01 10:29:59') AS STRING) AS b FROM data WHERE id = 1") == [("2024-01-01 10:15:00",)]
    assert one("SELECT CAST(date_bin(INTERVAL '1 hour', TIMESTAMP '1969-12-31 23:10:00', TIMESTAMP '1970-01-01 00:30:00') AS STRING) AS b FROM data WHERE id = 1") == [("1969-12-31 22:30:00",)]


def test_qualify(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, g string")
    one = lambda sql: [tuple(r) for r in core.query(df, sql).collect()]
    assert one("SELECT id FROM data QUALIFY row_number() OVER (PARTITION BY g ORDER BY id DESC) = 1 ORDER BY id") == [(2,), (3,)]
    assert one("SELECT g, n FROM (SELECT g, row_number() OVER (PARTITION BY g ORDER BY id) AS n FROM data QUALIFY n = 2) x") == [("a", 2)]
    assert one("WITH q AS (SELECT id FROM data QUALIFY rank() OVER (ORDER BY id) < 3) SELECT count(*) AS n FROM q") == [(2,)]
    assert one("SELECT g, count(*) AS n FROM data GROUP BY g QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1") == [("a", 2)]


def test_ordered_aggregates(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, s string")
    one = lambda sql: core.query(df, sql).first()[0]
    assert one("SELECT array_agg(id ORDER BY s, id) FROM data") == [3, 1, 4, 2]
    assert one("SELECT array_agg(id ORDER BY s DESC) FROM data WHERE id > 1") == [2, 4, 3]
    assert one("SELECT string_agg(s, '+' ORDER BY id DESC) FROM data") == "b+a+b"
    assert sorted(one("SELECT array_agg(id) FROM data")) == [1, 2, 3, 4]
    with pytest.raises(Unsupported):
        rewrite("SELECT array_agg(id ORDER BY s, id DESC) FROM data")
