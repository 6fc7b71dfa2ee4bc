"""Adaptive Parquet encoding: which columns get a dictionary and which a bloom filter.

Modes are resolved for each physical column from the options; where a mode depends on
cardinality, one aggregate over the data measures it for all such columns at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import types as t
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from . import types as T
from .options import Bloom, BloomConfig

#: A dictionary pays below this share of distinct values, up to this size.
DISTINCT_SHARE, DICTIONARY_BYTES = 0.20, 1 << 30
#: Bytes assumed for a value of unknown size.
UNKNOWN_TEXT, UNKNOWN_BINARY, UNKNOWN_OTHER = 32, 64, 16


@dataclass(frozen=True)
class Cardinality:
    distinct: int
    mean_bytes: float | None = None


@dataclass(frozen=True)
class Columns:
    """The user's wishes; all names are paths or prefixes of paths."""

    dictionary: bool = True
    always: tuple[str, ...] = ()
    analyze: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    bloom: BloomConfig | None = field(default_factory=BloomConfig)
    distinct: dict[str, int] = field(default_factory=dict)


def dictionary_mode(leaf: T.Leaf, c: Columns) -> str:
    """not-eligible, disabled, always or analyze; the first rule that fits decides."""
    if not T.can_have_dictionary(leaf.type):
        return "not-eligible"
    measurable = "analyze" if not leaf.nested and T.can_analyze(leaf.type) else "always"
    rules = ((c.never, "disabled"), (c.always, "always"), (c.analyze, measurable))
    for prefixes, mode in rules:
        if any(leaf.under(p) for p in prefixes):
            return mode
    return measurable if c.dictionary else "disabled"


def bloom_mode(leaf: T.Leaf, c: Columns) -> Bloom | None:
    """The filter wished for, its ndv None if it must be measured; None where there is none."""
    b = c.bloom
    if b is None or not T.can_have_bloom(leaf.type) or any(leaf.under(p) for p in b.off):
        return None
    known = c.distinct.get(leaf.name, c.distinct.get(leaf.path[0]))
    own = next((w for p, w in b.on.items() if leaf.under(p)), None)
    wish = own or b.everywhere
    if wish is None:
        return None
    ndv = wish.ndv or known
    if ndv is None and (not T.can_analyze(leaf.type) or leaf.nested):
        return None
    return Bloom(wish.fpp, ndv)


def dictionary_bytes(c: Cardinality, x: pa.DataType) -> int:
    size = T.fixed_width(x)
    if size is None:
        text, binary = t.is_string(x) or t.is_large_string(x), t.is_binary(x) or t.is_large_binary(x)
        size = round(c.mean_bytes) if c.mean_bytes is not None and (text or binary) else UNKNOWN_TEXT if text else UNKNOWN_BINARY if binary else UNKNOWN_OTHER
    return c.distinct * size


def dictionary_pays(c: Cardinality, rows: int, x: pa.DataType, limit: int = DICTIONARY_BYTES) -> bool:
    return rows > 0 and c.distinct / rows < DISTINCT_SHARE and dictionary_bytes(c, x) <= limit


def to_measure(schema: pa.Schema, c: Columns) -> list[str]:
    """Top-level columns whose cardinality decides something."""
    out = []
    for leaf in T.leaves(schema):
        bloom = bloom_mode(leaf, c)
        if not leaf.nested and (dictionary_mode(leaf, c) == "analyze" or (bloom and bloom.ndv is None)):
            out.append(leaf.path[0])
    return sorted(set(out))


def measure(df: DataFrame, names: list[str], exact: bool = False) -> tuple[int, dict[str, Cardinality]]:
    """Rows and cardinalities, in one pass."""
    count = F.count_distinct if exact else F.approx_count_distinct
    sized = [n for n in names if isinstance(df.schema[n].dataType, StringType | BinaryType)]
    quoted = {n: F.col(f"`{n}`") for n in names}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(count(quoted[n]).alias(f"d{i}") for i, n in enumerate(names)), *(F.avg(F.octet_length(quoted[n])).alias(f"b{i}") for i, n in enumerate(sized))).first()
    mean = {n: row[f"b{i}"] for i, n in enumerate(sized)}
    return row["rows"], {n: Cardinality(row[f"d{i}"], mean.get(n)) for i, n in enumerate(names)}


@dataclass(frozen=True)
class Decision:
    """What a physical column gets."""

    name: str
    dictionary: bool
    bloom: Bloom | None


def decide(schema: pa.Schema, c: Columns, rows: int, measured: dict[str, Cardinality], limit: int = DICTIONARY_BYTES, group_rows: int | None = None) -> list[Decision]:
    """A filter with a given ndv is always written; one of measured size only where the column keeps its dictionary.

    Each row group has its own filter, so a measured size is no more than the group's rows: filters that are
    sized for the whole table grow with the square of it, and writers hold them until the file is closed.
    """
    out = []
    for leaf in T.leaves(schema):
        mode, wish = dictionary_mode(leaf, c), bloom_mode(leaf, c)
        found = measured.get(leaf.path[0]) if not leaf.nested else None
        has = mode == "always" or mode == "analyze" and found is not None and dictionary_pays(found, rows, leaf.type, limit)
        if wish and wish.ndv is None:
            wish = Bloom(wish.fpp, max(1, min(found.distinct, group_rows or found.distinct))) if has and found else None
        out.append(Decision(leaf.name, has, wish))
    return out
