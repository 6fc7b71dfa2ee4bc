"""Option grammars: sizes, budgets, sort, bloom filters, dictionaries, encodings, compression."""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, field

from ..errors import OptionError

#: Unit suffixes of byte sizes, in lower case.
UNITS = {"": 1, "b": 1, "k": 1000, "kb": 1000, "ki": 1024, "kib": 1024, "m": 1000**2, "mb": 1000**2, "mi": 1024**2, "mib": 1024**2, "g": 1000**3, "gb": 1000**3, "gi": 1024**3, "gib": 1024**3, "t": 1000**4, "tb": 1000**4, "ti": 1024**4, "tib": 1024**4, "p": 1000**5, "pb": 1000**5, "pi": 1024**5, "pib": 1024**5}
#: Choices of the command line.
STRATEGIES = ("sort-single", "nosort-multi", "nosort-evict")
FORMATS = ("arrow", "parquet", "vortex")
DIALECTS = ("generic", "mysql", "postgres", "hive", "sqlite", "snowflake", "redshift", "mssql", "clickhouse", "bigquery", "ansi", "duckdb", "databricks")
ENCODINGS = ("plain", "rle", "delta-binary-packed", "delta-length-byte-array", "delta-byte-array", "byte-stream-split")
COMPRESSIONS = ("none", "snappy", "gzip", "brotli", "zstd", "lz4")
#: Highest level of the codecs that have levels, and their defaults.
LEVELS = {"gzip": (0, 9, 6), "brotli": (0, 11, 1), "zstd": (1, 22, 1)}
DEFAULT_FPP = 0.01


def choice(text: str, allowed: tuple[str, ...], what: str) -> str:
    if text.lower() not in allowed:
        raise OptionError(f"invalid {what} '{text}': expected one of {', '.join(allowed)}")
    return text.lower()


def at_least_one(text: str) -> int:
    if not re.fullmatch(r"\+?\d+", text) or int(text) < 1:
        raise OptionError(f"invalid value '{text}': must be at least 1")
    return int(text)


def byte_size(text: str) -> int:
    """A size over 0, such as 512MB, 1.5 GiB or 4096."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise OptionError(f"invalid byte size '{text}': expected a form like '512MB', '2GB' or '1GiB'")
    n = int(float(m[1]) * UNITS[m[2].lower()])
    if n < 1:
        raise OptionError("a byte size must be greater than 0")
    return n


def cpus() -> int:
    return len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else os.cpu_count() or 4


@dataclass(frozen=True)
class ThreadBudget:
    """N, reserve:N or reserve:N:min:M."""

    fixed: int | None = None
    reserve: int = 0
    least: int = 1

    @classmethod
    def parse(cls, text: str) -> ThreadBudget:
        if m := re.fullmatch(r"\d+", text):
            return cls(fixed=at_least_one(text))
        if m := re.fullmatch(r"reserve:(\d+)(?::min:(\d+))?", text):
            least = int(m[2]) if m[2] is not None else 1
            if least < 1:
                raise OptionError("minimum must be at least 1")
            return cls(reserve=int(m[1]), least=least)
        raise OptionError(f"invalid thread budget '{text}': expected a number, 'reserve:N' or 'reserve:N:min:M'")

    def resolve(self, available: int | None = None) -> int:
        return self.fixed if self.fixed is not None else max((available or cpus()) - self.reserve, self.least)


def _read_int(path: str) -> int | None:
    try:
        with open(path) as f:
            text = f.read().strip()
    except OSError:
        return None
    return int(text) if text.isdigit() else None


def total_memory() -> int:
    """Bytes this process may use: the container's limit (cgroup v2, then v1) if below the machine's memory."""
    machine = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    limits = [_read_int("/sys/fs/cgroup/memory.max"), _read_int("/sys/fs/cgroup/memory/memory.limit_in_bytes")]
    return min([machine, *(x for x in limits if x)])


def available_memory() -> int:
    free = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_AVPHYS_PAGES")
    used = _read_int("/sys/fs/cgroup/memory.current")
    limit = _read_int("/sys/fs/cgroup/memory.max")
    return min(free, max(0, limit - used)) if used is not None and limit else free


@dataclass(frozen=True)
class MemoryBudget:
    """total[:pct[:min:SIZE]], available[...], reserve:SIZE[:min:SIZE] or SIZE."""

    kind: str = "total"
    amount: int = 80
    least: int = 0

    @classmethod
    def parse(cls, text: str) -> MemoryBudget:
        head, *rest = text.split(":")
        kind = head.lower()
        if kind in ("total", "available"):
            amount = cls._percent(rest.pop(0)) if rest else 80
        elif kind == "reserve":
            if not rest:
                raise OptionError("reserve requires a byte size, as in 'reserve:2GB'")
            amount = byte_size(rest.pop(0))
        elif rest:
            raise OptionError(f"unknown keyword '{head}': expected 'total', 'available', 'reserve' or a byte size")
        else:
            return cls("fixed", byte_size(text))
        if not rest:
            return cls(kind, amount)
        if rest[0] != "min" or len(rest) < 2:
            raise OptionError(f"unexpected '{':'.join(rest)}': expected 'min:SIZE'")
        return cls(kind, amount, byte_size(rest[1]))

    @staticmethod
    def _percent(text: str) -> int:
        digits = text.removesuffix("%")
        if not digits.isdigit() or not 1 <= int(digits) <= 100:
            raise OptionError(f"invalid percentage '{text}': expected 1-100")
        return int(digits)

    def resolve(self, total: int | None = None, available: int | None = None) -> int:
        if self.kind == "fixed":
            return self.amount
        if self.kind == "reserve":
            return max((total or total_memory()) - self.amount, 0, self.least)
        of = (total or total_memory()) if self.kind == "total" else (available if available is not None else available_memory())
        return max(of * self.amount // 100, self.least)


@dataclass(frozen=True)
class PoolReserve:
    """A percentage (1-99) or a byte size of a memory pool."""

    percent: int | None = None
    size: int = 0

    @classmethod
    def parse(cls, text: str) -> PoolReserve:
        digits = text.removesuffix("%")
        if digits.isdigit():
            if not 1 <= int(digits) <= 99:
                raise OptionError(f"reserve percentage must be between 1 and 99, got {digits}")
            return cls(percent=int(digits))
        return cls(size=byte_size(text))

    def resolve(self, pool: int) -> int:
        n = pool * self.percent // 100 if self.percent else self.size
        if not 0 < n < pool:
            raise OptionError(f"a reserve of {n} bytes does not fit a pool of {pool} bytes")
        return n


@dataclass(frozen=True)
class SortSpec:
    """Columns with direction; the first mention of a column wins."""

    columns: tuple[tuple[str, bool], ...] = ()  # (name, descending)

    @classmethod
    def parse(cls, text: str) -> SortSpec:
        out: dict[str, bool] = {}
        for item in filter(None, (p.strip() for p in text.split(","))):
            name, colon, how = item.partition(":")
            if colon and how.strip().lower() not in ("asc", "ascending", "desc", "descending"):
                raise OptionError(f"invalid sort direction '{how}' in '{item}'")
            if not name.strip():
                raise OptionError(f"no column in sort item '{item}'")
            out.setdefault(name.strip(), how.strip().lower().startswith("desc"))
        if not out:
            raise OptionError("a sort needs at least one column")
        return cls(tuple(out.items()))

    def without(self, names) -> SortSpec:
        return SortSpec(tuple(c for c in self.columns if c[0] not in set(names)))

    def after(self, partition_columns) -> SortSpec:
        """Partition columns, ascending, then the others of these."""
        return SortSpec((*((c, False) for c in partition_columns), *self.without(partition_columns).columns))


@dataclass(frozen=True)
class Bloom:
    fpp: float = DEFAULT_FPP
    ndv: int | None = None

    @classmethod
    def parse(cls, text: str) -> Bloom:
        found: dict[str, float | int] = {}
        for item in filter(None, (p.strip() for p in text.split(","))):
            key, eq, value = (x.strip() for x in item.partition("="))
            if not eq:
                raise OptionError(f"invalid parameter '{item}': expected 'key=value'")
            if key not in ("fpp", "ndv"):
                raise OptionError(f"unknown parameter '{key}': expected 'fpp' or 'ndv'")
            if key in found:
                raise OptionError(f"{key} is set twice: {text}")
            try:
                found[key] = float(value) if key == "fpp" else int(value)
            except ValueError:
                raise OptionError(f"invalid {key} value '{value}'") from None
            if key == "fpp" and not (math.isfinite(found[key]) and 0 < found[key] < 1):
                raise OptionError(f"invalid fpp value '{value}': must be between 0 and 1")
            if key == "ndv" and found[key] < 1:
                raise OptionError(f"invalid ndv value '{value}': must be greater than 0")
        return cls(**found)

    @classmethod
    def parse_column(cls, text: str) -> tuple[str, Bloom]:
        """COLUMN or COLUMN:fpp=..,ndv=.."""
        name, colon, rest = text.partition(":")
        if not name.strip():
            raise OptionError(f"no column in bloom filter '{text}'")
        return name.strip(), cls.parse(rest) if colon else cls()


@dataclass(frozen=True)
class BloomConfig:
    everywhere: Bloom | None = field(default_factory=Bloom)
    on: dict[str, Bloom] = field(default_factory=dict)
    off: tuple[str, ...] = ()

    @classmethod
    def build(cls, everywhere: Bloom | None, on: list[tuple[str, Bloom]], off: list[str]) -> BloomConfig:
        names = [n for n, _ in on]
        for group, word in ((names, "enabled"), (list(off), "disabled")):
            for n in group:
                if group.count(n) > 1:
                    raise OptionError(f"column '{n}' specified multiple times as {word}")
        for n in names:
            if n in off:
                raise OptionError(f"column '{n}' specified as both enabled and disabled")
        return cls(everywhere, dict(on), tuple(off))


def dictionary_column(text: str) -> tuple[str, str]:
    """COLUMN, COLUMN:always or COLUMN:analyze."""
    name, colon, mode = text.partition(":")
    mode = mode.strip().lower() if colon else "analyze"
    if not name.strip() or mode not in ("always", "analyze"):
        raise OptionError(f"invalid dictionary column '{text}': expected COLUMN[:always|analyze]")
    return name.strip(), mode


def column_encoding(text: str) -> tuple[str, str]:
    """COLUMN=ENCODING."""
    name, eq, enc = text.rpartition("=")
    if not eq or not name.strip():
        raise OptionError(f"invalid column encoding '{text}': expected COLUMN=ENCODING")
    return name.strip(), choice(enc.strip(), ENCODINGS, "encoding")


def compression(codec: str, level: int | None = None) -> tuple[str, int | None]:
    codec = choice(codec, COMPRESSIONS, "compression")
    if level is None:
        return codec, None
    if codec not in LEVELS:
        raise OptionError(f"compression '{codec}' has no levels")
    low, high, _ = LEVELS[codec]
    if not low <= level <= high:
        raise OptionError(f"compression level {level} of {codec} is out of range {low}-{high}")
    return codec, level
