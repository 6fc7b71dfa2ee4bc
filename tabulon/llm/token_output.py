"""Token-id output with Re-Pair grammar compression.

Documents are range-partitioned and sorted by doc_id, encoded, and cut into
shards of whole documents.  In each shard, rounds of Re-Pair replace pairs of
neighbouring ids by nonterminals until no pair occurs twice; a pair never spans two
documents.  A shard stores its rules, the expansion length of every nonterminal, the
remaining symbols and where each document starts among them, so that any
document (or any range of ids in it) decodes without the others.

Shards are rows of a Parquet table in the folder that all executors share.
Null and empty texts give the end id alone.  Rows are ordered by doc_id (null
first), then by a hash of the text, or as they stand in a written table; repeated rows are written each.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, text_column
from .common import SLICE_BYTES, partitions, rest, scratch, small_batches
from .tokens import ids_bytes, worker_encoder

SHARD = "part int, shard int, start long, n_ids long, base long, doc_ids binary, doc_nulls binary, symbols_before binary, rules binary, lengths binary, symbols binary"


def repair(ids: np.ndarray, last: np.ndarray, base: int, rounds: int | None = None, most: int = 1 << 17, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs of symbols) and the kept `last` marks.

    A round replaces all pairs that occur `least` times or more (of more than `most`, the most frequent), and
    rounds go on until there are none, or to the given number; `last` marks ids that no pair may
    start with.  An occurrence that a round passes over is overlapped by one that it replaces,
    so after a whole round only pairs with a new symbol can be frequent.
    """
    rules, end = [], np.uint32(1 << 31)  # the highest bit of an id is its mark
    ids = np.where(last, ids | end, ids)
    at, new = np.flatnonzero(ids[:-1] < end), base
    for _ in itertools.count() if rounds is None else range(rounds):
        left, right = ids[at], ids[at + 1] & ~end
        wide, deep = int(new).bit_length(), len(at).bit_length()
        if 2 * wide + deep <= 64:  # pairs carry their places, so that values are sorted: that is much quicker than argsort
            pair = left.astype(np.uint64)
            pair <<= np.uint64(wide)
            pair |= right
            pair <<= np.uint64(deep)
            pair |= np.arange(len(at), dtype=np.uint64)
            pair.sort()
            order = (pair & np.uint64((1 << deep) - 1)).astype(np.int64)
            pair >>= np.uint64(deep)
        else:
            wide = 32
            pair = (left.astype(np.uint64) << np.uint64(wide)) | right
            order = np.argsort(pair)
            pair = pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else at
        count = np.diff(np.r_[first, len(pair)])
        keep = count >= least
        whole = int(keep.sum()) <= most
        if not whole:
            keep[np.argsort(-count, kind="stable")[most:]] = False
        if not keep.any():
            break
        number = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        rule = np.empty(len(at), np.int32)
        rule[order] = np.repeat(number, count)
        hit = np.flatnonzero(rule >= 0)
        where, rule = at[hit], rule[hit]
        head = np.r_[True, np.diff(where) > 1]
        if not head.all():  # of overlapping pairs every other one, from the left
            place = np.arange(len(where)) - np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
            where, rule = where[place % 2 == 0], rule[place % 2 == 0]
        ids[where] = (ids[where + 1] & end) | (new + rule).astype(np.uint32)
        stays = np.ones(len(ids), bool)
        stays[where + 1] = False
        ids = ids[stays]
        found = pair[first[keep]]
        rules.append(np.stack([found >> np.uint64(wide), found & np.uint64((1 << wide) - 1)], 1).astype(np.uint32))
        if whole:
            fresh, to = np.zeros(len(ids), bool), where - np.arange(len(where))
            fresh[to] = True
            fresh[np.maximum(to - 1, 0)] = True
            at = np.flatnonzero(fresh[:-1] & (ids[:-1] < end))
        else:
            at = np.flatnonzero(ids[:-1] < end)
        new += len(found)
    return ids & ~end, np.concatenate([np.zeros((0, 2), np.uint32), *rules]), ids >= end


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each nonterminal; rules only use earlier symbols."""
    out, latest, a = np.ones(len(rules), np.uint32), rules.max(1).astype(np.int64) - base if len(rules) else rules[:, 0], 0
    while a < len(rules):  # as far as rules only use symbols before the first of them
        later = np.flatnonzero(latest[a : a + (1 << 16)] >= a)
        z = a + int(later[0]) if len(later) else min(a + (1 << 16), len(rules))
        part = rules[a:z].astype(np.int64) - base
        out[a:z] = np.where(part < 0, 1, out[np.maximum(part, 0)]).sum(1)
        a = z
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for.  Rules that are used are expanded once; every nonterminal knows its place in the result, so each is handled once."""
    length = (lengths_of(rules, base) if lengths is None else lengths).astype(np.int64)
    number = np.where(symbols >= base, symbols.astype(np.int64) - base, -1)
    used = np.flatnonzero(np.bincount(number[number >= 0], minlength=len(rules)))
    start = np.zeros(len(rules), np.int64)
    start[used] = np.cumsum(length[used]) - length[used]
    texts = np.empty(int(length[used].sum()), np.uint32)
    rest, at = used, start[used]
    while len(rest):
        left, right = rules[rest, 0].astype(np.int64), rules[rest, 1].astype(np.int64)
        after = at + np.where(left < base, 1, length[np.maximum(left - base, 0)])
        both, places = np.concatenate([left, right]), np.concatenate([at, after])
        non = both >= base
        texts[places[~non]] = both[~non]
        rest, at = both[non] - base, places[non]
    plain = number < 0
    size, begin = np.ones(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    size[~plain], begin[~plain] = length[number[~plain]], start[number[~plain]]
    begin[plain] = len(texts) + np.arange(int(plain.sum()))
    where = np.repeat(begin - (np.cumsum(size) - size), size)
    where += np.arange(len(where))
    return np.concatenate([texts, symbols[plain].astype(np.uint32)])[where]


def decode(shard: dict, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of one document of a shard row; reads only the symbols that cover them."""
    before, base = np.frombuffer(shard["symbols_before"], "<i8"), shard["base"]
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    length = np.frombuffer(shard["lengths"], "<u4")
    symbols = np.frombuffer(shard["symbols"], "<u4")[before[document] : before[document + 1]]
    size = np.where(symbols < base, 1, length[np.maximum(symbols.astype(np.int64) - base, 0)] if len(length) else 1).astype(np.int64)
    ends = np.cumsum(size)
    stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
    i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[i - 1]) if i else 0
    return expand(symbols[i:j], rules, base, length)[start - skipped : stop - skipped]


def write_shards(docs: DataFrame, path: str, end_id: int = 1, slice_bytes: int = SLICE_BYTES, rows_per_partition: int = 8_000, as_written: bool = False) -> str:
    """Encode docs (doc_id, text) and write the shard table; returns its path.  Starts count ids within a part.

    With ``as_written``, docs must be a Parquet table that Spark wrote, read alone: rows keep the order of its part files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = scratch(spark, "token-shards")
    base = 1 << 20

    def run(batches):
        enc, part, shard, start = worker_encoder(path, ids_bytes), TaskContext.get().partitionId(), 0, 0
        for b in batches:
            data, offsets = text_column(b)
            for i, j in slices(offsets, slice_bytes):
                ids, n = enc.coded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                last = np.zeros(len(ids), bool)
                last[np.cumsum(n) - 1] = True
                symbols, rules, last = repair(ids, last, base)
                before = np.r_[0, np.flatnonzero(last) + 1].astype("<i8")
                key = b.column(0).slice(i, j - i)
                values = [part, shard, start, len(ids), base, np.asarray(key.fill_null(0)).astype("<i8").tobytes(), np.asarray(key.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes(), before.tobytes(), rules.astype("<u4").tobytes(), lengths_of(rules, base).astype("<u4").tobytes(), symbols.astype("<u4").tobytes()]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in SHARD.split(", ")])
                shard, start = shard + 1, start + len(ids)

    rest(spark)
    rows = docs.count()
    if as_written:
        # scans deal files out by size; their names hold the number of the part that wrote them
        keys = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("_part"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_i")]
        order = ["_part", "_file", "_i"]
    else:
        keys = [F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i")]
        order = ["doc_id", "_h", "_i"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys)
    n = partitions(spark, rows, rows_per_partition)
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(out)
    rest(spark)
    return out


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.  Only one number for each part reaches the driver."""
    shards = spark.read.schema(SHARD).parquet(path)
    total, before = 0, {}
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r.part] = total
        total += r.n

    def run(batches):
        for b in batches:
            for s in b.to_pylist():
                key = pa.array(np.frombuffer(s["doc_ids"], "<i8"), mask=np.frombuffer(s["doc_nulls"], np.uint8).astype(bool))
                symbols, base = np.frombuffer(s["symbols"], "<u4"), s["base"]
                length = np.frombuffer(s["lengths"], "<u4").astype(np.int64)
                size = np.ones(len(symbols), np.int64)
                non = symbols >= base
                size[non] = length[symbols[non].astype(np.int64) - base]
                at = np.r_[0, np.cumsum(size)][np.frombuffer(s["symbols_before"], "<i8")]
                ids = expand(symbols, np.frombuffer(s["rules"], "<u4").reshape(-1, 2), base, length)
                raw, o = ids.astype("<u4").tobytes(), (at * 4).tolist()
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(o[:-1], o[1:], strict=True)]
                yield pa.record_batch([key, pa.array(at[:-1] + before[s["part"]] + s["start"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, end_id: int = 1, as_written: bool = False) -> DataFrame:
    """Write all documents' ids and return the digest that the files give back."""
    return read_shards(docs.sparkSession, write_shards(docs, path, end_id, as_written=as_written))
