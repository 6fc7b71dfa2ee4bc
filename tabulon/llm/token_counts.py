"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier one is a compact table (concatenated keys, offsets, lengths) of the most
frequent pieces, broadcast once; its size is bounded by ``frequent`` entries of
at most ``KEEP_BYTES``.  Tier two is a store in each worker: a piece that tier one lacks is
encoded once and its count kept.  Tier one is filled from a bounded sample of
the documents; it saves time only and changes no count.

Null and empty texts have no bytes and no tokens; repeated rows are counted
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, text_column
from .common import SLICE_BYTES, small_batches
from .tokens import KEEP_BYTES, Encoder, kind_of, worker_encoder


def pack(table: dict[bytes, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    keys = list(table)
    return b"".join(keys), np.cumsum([0, *map(len, keys)]).astype("<u4"), np.fromiter(table.values(), "<u2", len(keys))


def unpack(packed: tuple[bytes, np.ndarray, np.ndarray]) -> dict[bytes, int]:
    blob, offsets, lengths = packed
    o = offsets.tolist()
    return {blob[a:b]: n for a, b, n in zip(o[:-1], o[1:], lengths.tolist(), strict=True)}


def frequent_pieces(docs: DataFrame, path: str, frequent: int, sample_rows: int) -> dict[bytes, int]:
    """Token counts of the most frequent pieces of about `sample_rows` documents; at most `frequent` of them."""
    rows = docs.count()
    if not rows or not frequent or kind_of(path) == "whole":
        return {}

    def count(batches):
        enc, seen = Encoder(path, len), Counter()
        for b in batches:
            data, offsets = text_column(b)
            for i, j in slices(offsets, SLICE_BYTES):
                for p in enc.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    seen.update(p)
        top = [(k, n) for k, n in seen.most_common(frequent) if len(k) <= KEEP_BYTES]
        yield pa.record_batch([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    part = docs.select("text").sample(fraction=min(1.0, sample_rows / rows), seed=7)
    top = part.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(frequent).collect()
    keys = [bytes(r.piece) for r in top]
    enc = Encoder(path, len)
    return dict(zip(keys, enc.encode([enc.text_of(k) for k in keys]), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 512, frequent: int = 30_000, sample_rows: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    tag = uuid.uuid4().hex
    packed = spark.sparkContext.broadcast(pack(frequent_pieces(docs, path, frequent, sample_rows)))

    def run(batches):
        enc = worker_encoder(path, len, lambda: unpack(packed.value), tag)
        for b in batches:
            data, offsets = text_column(b)
            counts = []
            for i, j in slices(offsets, SLICE_BYTES):
                counts += map(sum, enc.values(enc.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            n = pa.array(counts, pa.int64())
            yield pa.record_batch([b.column(0), pa.array(np.diff(offsets)), n, pa.array(np.asarray(counts, np.int64) > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
