"""What the engine may do with each Arrow type."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyarrow import types as t

_INT = lambda x: t.is_integer(x)
_TEXT = lambda x: t.is_string(x) or t.is_large_string(x) or t.is_string_view(x)
_BYTES = lambda x: t.is_binary(x) or t.is_large_binary(x) or t.is_binary_view(x)
_TEMPORAL = lambda x: t.is_date(x) or t.is_time(x) or t.is_timestamp(x)


def is_nested(x: pa.DataType) -> bool:
    return t.is_nested(x)


def can_partition(x: pa.DataType) -> bool:
    return t.is_boolean(x) or _INT(x) or t.is_floating(x) or t.is_decimal128(x) or t.is_decimal256(x) or _TEXT(x) or _TEMPORAL(x) or t.is_duration(x)


def can_have_dictionary(x: pa.DataType) -> bool:
    """Neither booleans nor floats nor nested columns gain from a dictionary."""
    return _INT(x) or _TEXT(x) or _BYTES(x) or t.is_fixed_size_binary(x) or _TEMPORAL(x) or t.is_duration(x) or t.is_interval(x) or t.is_decimal(x)


can_have_bloom = can_have_dictionary


def can_analyze(x: pa.DataType) -> bool:
    return not (t.is_floating(x) or t.is_nested(x) or t.is_null(x) or t.is_run_end_encoded(x))


def fixed_width(x: pa.DataType) -> int | None:
    try:
        return max(1, x.bit_width // 8)
    except ValueError:
        return None


def default_encoding(x: pa.DataType) -> str | None:
    """Encoding of a top-level column in version 2 files."""
    if _INT(x):
        return "DELTA_BINARY_PACKED"
    if t.is_float32(x) or t.is_float64(x):
        return "BYTE_STREAM_SPLIT"
    if _TEXT(x) or _BYTES(x):
        return "DELTA_LENGTH_BYTE_ARRAY"
    return "PLAIN" if t.is_boolean(x) else None


def encoding_problem(encoding: str, x: pa.DataType) -> str | None:
    """Why a column of this type can't have the encoding, if so."""
    ok = {
        "plain": lambda: True,
        "rle": lambda: t.is_boolean(x),
        "delta-binary-packed": lambda: _INT(x) or _TEMPORAL(x) or t.is_duration(x),
        "delta-length-byte-array": lambda: _TEXT(x) or _BYTES(x),
        "delta-byte-array": lambda: _TEXT(x) or _BYTES(x),
        "byte-stream-split": lambda: t.is_floating(x) or _INT(x) or t.is_fixed_size_binary(x) or t.is_decimal128(x) or t.is_decimal256(x),
    }[encoding]()
    return None if ok else f"encoding {encoding} does not support {x}"


@dataclass(frozen=True)
class Leaf:
    """A physical Parquet column."""

    path: tuple[str, ...]
    type: pa.DataType

    @property
    def name(self) -> str:
        return ".".join(self.path)

    @property
    def nested(self) -> bool:
        return len(self.path) > 1

    def under(self, prefix: str) -> bool:
        parts = tuple(prefix.split("."))
        return self.path[: len(parts)] == parts


def leaves(schema: pa.Schema) -> list[Leaf]:
    """Physical columns in file order: tags.list.element, m.key_value.key, user.name."""

    def walk(path: tuple[str, ...], x: pa.DataType):
        if t.is_struct(x):
            for i in range(x.num_fields):
                yield from walk((*path, x.field(i).name), x.field(i).type)
        elif t.is_map(x):
            yield from walk((*path, "key_value", "key"), x.key_type)
            yield from walk((*path, "key_value", "value"), x.item_type)
        elif t.is_list(x) or t.is_large_list(x) or t.is_fixed_size_list(x) or t.is_list_view(x) or t.is_large_list_view(x):
            yield from walk((*path, "list", "element"), x.value_type)
        elif t.is_dictionary(x):
            yield from walk(path, x.value_type)
        else:
            yield Leaf(path, x)

    return [leaf for f in schema for leaf in walk((f.name,), f.type)]


def spark_readable(x: pa.DataType) -> pa.DataType:
    """The type that Spark has for this one: unsigned widened, ns cut to us, dictionaries and views plain."""
    if t.is_dictionary(x):
        return spark_readable(x.value_type)
    if t.is_run_end_encoded(x):
        return spark_readable(x.value_type)
    if t.is_uint8(x):
        return pa.int16()
    if t.is_uint16(x):
        return pa.int32()
    if t.is_uint32(x):
        return pa.int64()
    if t.is_uint64(x):
        return pa.decimal128(20, 0)
    if t.is_float16(x):
        return pa.float32()
    if _TEXT(x):
        return pa.string()
    if _BYTES(x) or t.is_fixed_size_binary(x):
        return pa.binary()
    if t.is_date(x):
        return pa.date32()
    if t.is_timestamp(x):
        return pa.timestamp("us", x.tz)
    if t.is_time(x) or t.is_duration(x):
        return pa.int64()
    if t.is_decimal(x):
        return pa.decimal128(min(38, x.precision), x.scale)
    if t.is_struct(x):
        return pa.struct([pa.field(x.field(i).name, spark_readable(x.field(i).type), x.field(i).nullable) for i in range(x.num_fields)])
    if t.is_map(x):
        return pa.map_(spark_readable(x.key_type), spark_readable(x.item_type))
    if t.is_nested(x) and hasattr(x, "value_type"):
        return pa.list_(spark_readable(x.value_type))
    return x
