"""Media columns: content-addressed payloads in tar shards.

A payload is stored once per shard as an 8-bit grey PNG, ``WIDTH`` samples a line,
under its own SHA-256 as member name.  Rows carry digest, shard, offset and length;
metadata columns come from range reads of the 33 header bytes alone, and whole
payloads from range reads of one member.  A shard's name holds the task attempt that
wrote it, so a task that runs again never touches a file that rows refer to.

Null and empty texts give one line of padding.  Repeated rows give equal values.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_column
from .common import scratch, small_batches, table

WIDTH = 576
HEADER = 33
SHARD_BYTES = 256 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"
ROWS = "doc_id long, n_bytes long, shard string, digest string, offset long, length long"


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    """The text, and bytes 255 up to a positive multiple of `unit`."""
    return text + b"\xff" * (unit - len(text) % unit if len(text) % unit or not text else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG whose samples are the payload's bytes."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = np.zeros((len(lines), width + 1), np.uint8)
    body[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 3)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if first[:8] != _MAGIC or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", first[16:25])
    return width, height, depth


def decode(media: bytes) -> bytes:
    width, height, _ = header(media[:HEADER])
    at, parts = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            parts.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def pack(docs: DataFrame) -> DataFrame:
    """Write the payloads of docs (doc_id, text) to tar shards; returns the rows that point to them, as a table."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "media")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, out, n = TaskContext.get(), None, 0
        try:
            for b in batches:
                data, offsets = text_column(b)
                raw, o, rows = data.tobytes(), offsets.tolist(), []
                for a, z in zip(o[:-1], o[1:], strict=True):
                    payload = payload_of(raw[a:z])
                    digest = hashlib.sha256(payload).hexdigest()
                    if out is None or at > SHARD_BYTES:
                        if out is not None:
                            out.write(b"\0" * 1024)
                            out.close()
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.tar"
                        out, at, n, known = store.open_output_stream(f"{base}/{name}"), 0, n + 1, {}
                    if digest not in known:
                        media = encode(payload)
                        info = tarfile.TarInfo(digest)
                        info.size = len(media)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT))
                        out.write(media + b"\0" * (-len(media) % 512))
                        known[digest] = (at + 512, len(media))
                        at += 512 + len(media) + -len(media) % 512
                    rows.append((z - a, f"{folder}/{name}", digest, *known[digest]))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "shard", "digest", "offset", "length"])
        finally:
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()

    return table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS), "media-rows")


class Shards:
    """Range reads of members; the last shard stays open."""

    def __init__(self):
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            store, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, store.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = "", None


def _each(rows: DataFrame, columns: str, f, reads: tuple[str, ...] = ()) -> DataFrame:
    """rows with the columns that f makes of the shards, shard, offset, length and the columns it reads."""
    names = [x.split()[0] for x in columns.split(", ")]
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes)

    def run(batches):
        shards = Shards()
        for b in batches:
            got = [f(shards, *x) for x in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("shard", "offset", "length", *reads)), strict=True)]
            cols = list(zip(*got, strict=True)) or [()] * len(names)
            types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in columns.split(", ")]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*b.schema.names, *names])
        shards.close()

    return rows.mapInArrow(run, f"{schema}, {columns}")


def metadata(rows: DataFrame) -> DataFrame:
    """rows with width, height and depth, from header-only range reads."""
    return _each(rows, "width long, height long, depth long", lambda s, shard, offset, length: header(s.read(shard, offset, min(HEADER, length))))


def features(payload: bytes, width: int, height: int) -> str:
    """Lines and samples, mean, deviation and the shares of 8 equal value ranges."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    return f"{width}x{height};{x.mean():.4f};{x.std():.4f};" + ",".join(f"{s:.4f}" for s in shares)


def read_back(rows: DataFrame, tail: int = WIDTH) -> DataFrame:
    """rows of pack(), or of metadata(), with digests and features of the stored bytes; tail_crc32 is of the payload's last `tail` bytes."""
    if "width" not in rows.columns:
        rows = metadata(rows)

    def one(s, shard, offset, length, width, height):
        media = s.read(shard, offset, length)
        payload = decode(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, width, height)

    return _each(rows, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", one, ("width", "height"))
