"""One Parquet file made of parts that tasks wrote: bytes are copied as they are, footers and page indexes get the new places.

The tasks rewrite their parts' footers; on a file system with local paths each also copies its part into its place.
Elsewhere files have one writer, so one task copies all bytes there, a few MB at once.
"""

from __future__ import annotations

import contextlib
import os
import struct

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from ..fsio import local, remote
from ..inspection.pages import Compact

MAGIC = b"PAR1"
COPY_BYTES = 8 << 20
#: Fixed value of the format: row groups are numbered by 16 bits with a sign; the number may be left out.
LAST_ORDINAL = (1 << 15) - 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _list_head(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _varint(n)


def _field(last: int, field: int, kind: int) -> bytes:
    return bytes([field - last << 4 | kind]) if 0 < field - last < 16 else bytes([kind]) + _zigzag(field)


def _copied(r: Compact, change: dict) -> bytes:
    """A struct with some numbers changed: `change` has, by field, a function of the number (None drops the field) or the changes in a struct, or in a list's structs."""
    out, field, last = bytearray(), 0, 0
    while head := r.byte():
        kind = head & 15
        field = field + (head >> 4) if head >> 4 else r.integer()
        how, start = change.get(field), r.at
        if how is None:
            r.value(kind)
            body = r.buf[start : r.at]
        elif callable(how):
            n = how(r.integer())
            body = None if n is None else _zigzag(n)
        elif kind == 12:
            body = _copied(r, how)
        else:
            n = r.byte() >> 4
            n = n if n != 15 else r.varint()
            body = _list_head(n, 12) + b"".join(_copied(r, how) for _ in range(n))
        if body is not None:
            out += _field(last, field, kind) + body
            last = field
    return bytes(out) + b"\0"


class Part:
    """A part's footer and the place of its offset indexes, which the joined file has elsewhere."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as f:
            size = f.size()
            n, magic = struct.unpack("<I4s", f.read_at(8, size - 8))
            if magic != MAGIC:
                raise ValueError(f"{path} is no Parquet file")
            self.end = size - 8 - n
            self.footer = f.read_at(n, self.end)
            meta = Compact(self.footer).struct()
            self.rows, self.groups = meta[3], len(meta[4])
            self.indexes = [(c[4], c[5]) for g in meta[4] for c in g[1] if 4 in c]
            self.low = min((a for a, _ in self.indexes), default=self.end)
            self.high = max((a + n for a, n in self.indexes), default=self.end)
            if sum(n for _, n in self.indexes) != self.high - self.low:  # other things lie between them
                self.low = self.high = self.end
            self.index_bytes = [f.read_at(n, a) for a, n in self.indexes]

    @property
    def length(self) -> int:
        """Bytes that are copied."""
        return self.low - len(MAGIC) + self.end - self.high

    def _moved(self, to: int):
        return lambda x: x if x <= 0 else x + to - len(MAGIC) - (self.high - self.low if x >= self.high else 0)

    def offset_indexes(self, to: int) -> list[bytes]:
        """The offset indexes of the part when its bytes begin at `to`."""
        return [_copied(Compact(x), {1: {1: self._moved(to)}}) for x in self.index_bytes]

    def row_groups(self, to: int, indexes_at: int, before: int) -> bytes:
        """The row groups when the part's bytes begin at `to`, its offset indexes at `indexes_at`, after `before` other groups."""
        moved, places, at = self._moved(to), {}, indexes_at
        for (old, _), new in zip(self.indexes, self.offset_indexes(to), strict=True):
            places[old] = (at, len(new))
            at += len(new)
        held = []

        def place(old: int) -> int:
            held[:] = places[old]
            return held[0]

        count = iter(range(before, before + self.groups))

        def ordinal(_: int) -> int | None:
            n = next(count)
            return n if n <= LAST_ORDINAL else None

        column = {2: moved, 3: {9: moved, 10: moved, 11: moved, 14: moved}, 4: place, 5: lambda _: held[1], 6: moved}
        r, out = Compact(self.footer), b""
        field = 0
        while head := r.byte():
            field = field + (head >> 4) if head >> 4 else r.integer()
            if field != 4:
                r.value(head & 15)
                continue
            n = r.byte() >> 4
            n = n if n != 15 else r.varint()
            out = b"".join(_copied(r, {1: column, 5: moved, 7: ordinal}) for _ in range(n))
        return out


def _mapped(spark: SparkSession, jobs: list[tuple], f, names: list[str]) -> list:
    """f of each job, a task for each, in their order; f gives whole numbers."""

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (k, *f(*jobs[k]))], ["k", *names])

    found = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, ", ".join(f"{x} long" for x in ("k", *names))).collect()
    return sorted(found, key=lambda r: r["k"])


def _put(path: str, data: bytes) -> None:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_output_stream(at) as out:
        out.write(data)


def _survey(path: str) -> tuple[int, ...]:
    p = Part(path)
    return p.length, p.low, p.high, p.end, p.rows, p.groups


def _put_indexes(path: str, to: int) -> tuple[int]:
    data = b"".join(Part(path).offset_indexes(to))
    _put(f"{path}.indexes", data)
    return (len(data),)


def _put_groups(path: str, to: int, indexes_at: int, before: int) -> tuple[int]:
    _put(f"{path}.groups", Part(path).row_groups(to, indexes_at, before))
    return (0,)


def _copy(out, path: str, ranges: list[tuple[int, int | None]]) -> None:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        for a, z in ranges:
            z = f.size() if z is None else z
            while a < z:
                out.write(f.read_at(min(COPY_BYTES, z - a), a))
                a += COPY_BYTES


@contextlib.contextmanager
def _at(target: str, place: int):
    """The local file, open for writing at a place; other tasks may write elsewhere in it."""
    with os.fdopen(os.open(local(target), os.O_WRONLY | os.O_CREAT, 0o666), "wb") as out:
        out.seek(place)
        yield out


def _place(path: str, low: int, high: int, end: int, to: int, target: str) -> tuple[int]:
    with _at(target, to) as out:
        _copy(out, path, [(len(MAGIC), low), (high, end)])
    return (0,)


def _finish(paths: list[str], bodies: list[tuple[int, int, int]], rows: int, groups: int, target: str, at: int | None) -> tuple[int]:
    """The file's begin and, from `at`, its end around parts that are in their places, or without `at` the whole file."""
    if at is not None:
        with _at(target, 0) as out:
            out.write(MAGIC)
    store, name = fs.FileSystem.from_uri(target)
    with store.open_output_stream(name) if at is None else _at(target, at) as out:
        if at is None:
            out.write(MAGIC)
            for path, (low, high, end) in zip(paths, bodies, strict=True):
                _copy(out, path, [(len(MAGIC), low), (high, end)])
        for path in paths:
            _copy(out, f"{path}.indexes", [(0, None)])
        start = out.tell()
        r, field = Compact(Part(paths[0]).footer), 0
        while True:
            began = r.at
            head = r.byte()
            if not head:
                break
            field = field + (head >> 4) if head >> 4 else r.integer()
            value = r.at
            r.value(head & 15)
            if field == 3:
                out.write(r.buf[began:value] + _zigzag(rows))
            elif field == 4:
                out.write(r.buf[began:value] + _list_head(groups, 12))
                for path in paths:
                    _copy(out, f"{path}.groups", [(0, None)])
            else:
                out.write(r.buf[began : r.at])
        out.write(b"\0")
        out.write(struct.pack("<I", out.tell() - start) + MAGIC)
    return (0,)


def join(spark: SparkSession, paths: list[str], target: str) -> None:
    """Write the parts, which have one schema, as one file, in their order.  Beside each part, two files with its new indexes and row groups are left."""
    parts = _mapped(spark, [(p,) for p in paths], _survey, ["length", "low", "high", "end", "rows", "groups"])
    starts, at = [], len(MAGIC)
    for p in parts:
        starts.append(at)
        at += p["length"]
    sizes = _mapped(spark, list(zip(paths, starts, strict=True)), _put_indexes, ["size"])
    jobs, before = [], 0
    for path, start, p, size in zip(paths, starts, parts, sizes, strict=True):
        jobs.append((path, start, at, before))
        at += size["size"]
        before += p["groups"]
    _mapped(spark, jobs, _put_groups, ["done"])
    bodies, end = [(p["low"], p["high"], p["end"]) for p in parts], None
    if not remote(target):
        end = starts[-1] + parts[-1]["length"]
        _mapped(spark, [(p, *b, to, target) for p, b, to in zip(paths, bodies, starts, strict=True)], _place, ["done"])
    _mapped(spark, [(paths, bodies, sum(p["rows"] for p in parts), before, target, end)], _finish, ["done"])
