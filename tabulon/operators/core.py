"""The fixed dataflow's operators: each is DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OptionError
from ..functions.dialect import rewrite
from ..plans.options import SortSpec

VIEW = "data"


def named(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _known(df: DataFrame, names: Iterable[str], what: str) -> list[str]:
    names = list(names)
    for n in names:
        if n not in df.columns:
            raise OptionError(f"{what} column '{n}' is not among {', '.join(df.columns)}")
    return names


def query(df: DataFrame, sql: str, dialect: str = "duckdb") -> DataFrame:
    """A query over the one table `data`.  The view is a temporary one, bound to this DataFrame alone."""
    text = rewrite(sql, dialect)
    df.createOrReplaceTempView(VIEW)
    return df.sparkSession.sql(text)


def order(spec: SortSpec) -> list[Column]:
    """Ascending with nulls last, descending with nulls first."""
    return [named(n).desc_nulls_first() if down else named(n).asc_nulls_last() for n, down in spec.columns]


def sort(df: DataFrame, spec: SortSpec) -> DataFrame:
    _known(df, (n for n, _ in spec.columns), "sort")
    return df.orderBy(*order(spec)) if spec.columns else df


def exclude(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without some columns, the others in their order; an unknown one is an error, case counts."""
    gone = set(_known(df, names, "excluded"))
    return df.select(*[named(c) for c in df.columns if c not in gone])


def project(df: DataFrame, columns: Iterable[str | int]) -> DataFrame:
    """Columns by name or by number, in the order given."""
    names = []
    for c in columns:
        if isinstance(c, int):
            if not 0 <= c < len(df.columns):
                raise OptionError(f"column {c} is out of bounds: there are {len(df.columns)}")
            names.append(df.columns[c])
        else:
            names.append(c)
    return df.select(*[named(c) for c in _known(df, names, "projected")])


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        if [(x.name, x.dataType) for x in f.schema] != [(x.name, x.dataType) for x in out.schema]:
            raise OptionError("UNION ALL of different schemas")
        out = out.union(f)
    return out


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one but not the other, counted: empty if the two hold the same rows."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def null_safe_equal(a: list[Column], b: list[Column]) -> Column:
    """Equality of partition values: null equals null."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out
