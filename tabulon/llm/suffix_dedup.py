"""Removal of long repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in
any document or the same one.

1. Sampling.  Every start p of a string of ``report`` bytes has an anchor: the leftmost of the
   smallest hashes of the ``report // 2``-grams within the string.  Equal strings have the same
   anchor gram at the same distance, so only starts whose anchor gram occurs again can repeat.
   An anchor's context is the text of all starts that it anchors, each with ``length`` bytes
   as far as the document has them.
2. Contexts that are equal as a whole repeat with all their starts; they are counted, and
   one of them stands for all.
3. Different contexts around the same gram are dealt into shards by gram.  Each shard's suffixes
   are sorted by Larsson-Sadakane refinement (eight bytes at first, then doubling the groups
   still equal), Kasai's walk gives the common prefixes of neighbours, and starts that share
   ``length`` bytes (or ``report``) with another start repeat.  Starts of strings whose hash comes
   once in their gram are left out beforehand.
4. Contexts of a gram that has more of them than ``shard_contexts`` are spread over several shards.
   Each shard hands on the sorted keys of its strings, once per shard and key range, and the
   runs of a range are merged by binary search of each in the others.

What is removed depends on ``length`` alone.  Shorter passages that repeat, of ``report`` bytes or
more, stay, but are counted.

Null and empty texts, and texts shorter than ``length``, lose nothing; repeated rows of
``length`` bytes or more lose all; an empty table gives an empty result; other columns are not
read.  Rows are told apart by their file and place in it; texts are read where they lie and never moved
but for the contexts that a shard compares.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, mix, prefix_hash, range_hash, release, slices, text_column, window_hash, window_min
from .common import numbered, partitions, scanned, small_batches, table
from .sides import Side, by_part

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 2 << 20

def anchors(data: np.ndarray, offsets: np.ndarray, length: int, report: int) -> tuple[np.ndarray, ...]:
    """Of each anchor of a slice: document, first and last start (bytes of the document), end of its context, hash of its gram, hash of its context."""
    gram = report // 2
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < report:
        return none
    c = prefix_hash(data)
    h = window_hash(c, gram)
    low = U64((1 << 30) - 1)  # a place; one width for all slices, so that equal strings have equal anchors
    best = (window_min((h & ~low) | np.arange(len(h), dtype=U64), report - gram + 1) & low).astype(np.int64)
    room = np.zeros(len(best), bool)
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if z - a >= report:
            room[a : z - report + 1] = True
    p = np.flatnonzero(room)
    if not len(p):
        return none
    a = best[p]
    new = np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]
    first = p[new]
    last = np.r_[p[np.flatnonzero(new)[1:] - 1], p[-1]]
    a = a[new]
    doc = np.searchsorted(offsets, first, "right") - 1
    end = np.minimum(last + length, offsets[doc + 1])
    context = range_hash(c, first, end) + (a - first).astype(U64) * U64(0x9E3779B97F4A7C15) + (last - first).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    return doc, first - offsets[doc], last - offsets[doc], end - offsets[doc], h[a].view(np.int64), context.view(np.int64)


def refine(key: np.ndarray, live: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: the suffixes at `live`, sorted.  `key` has eight bytes from each place, `end` the place after each one's context, where a mark of its own ends the suffix."""
    live = live.astype(np.int32)
    sa = live[np.argsort(key[live], kind="stable")]
    k = key[sa]
    new = np.r_[True, k[1:] != k[:-1]] if len(sa) else np.zeros(0, bool)
    rank = np.zeros(len(key), np.int32)
    mark = np.zeros(len(key), bool)
    mark[end[live]] = True
    marks = np.flatnonzero(mark)
    rank[marks] = np.arange(len(marks)) + len(sa) + 1  # an end sorts above all bytes, as the parting byte 255 does
    group = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    rank[sa] = group + 1
    slot = np.flatnonzero(~(new & np.r_[new[1:], True])) if len(sa) else sa
    h = 8
    while len(slot):
        at = sa[slot]
        both = (rank[at].astype(np.int64) << 32) | rank[np.minimum(at + h, end[at])]
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        sa[slot] = at
        new = np.r_[True, both[1:] != both[:-1]]
        group = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
        rank[at] = group + 1
        slot = slot[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


def kasai(data: np.ndarray, sa: np.ndarray, live: np.ndarray, end: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefixes: of each place, the bytes (`most` at most) that its suffix shares with the one before it in `sa`, within their contexts.

    All contexts walk at once, one place a step; a context's common prefix at a place is at least
    the one before, less one.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.zeros(n, np.int64)  # bytes from a place to its context's end
    left[live] = end[live] - live
    words = np.zeros(n + 8, np.uint8)
    words[:n] = data
    eight = np.zeros(n, U64)
    for k in range(8):
        eight |= words[k : k + n].astype(U64) << U64(8 * k)
    lcp = np.zeros(n, np.int64)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    h = np.zeros(len(start), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))
        p = start[:live] + step
        q = before[p]
        h = np.maximum(h[:live] - 1, 0)
        h[q < 0] = 0
        cap = np.minimum(np.minimum(left[p], left[q]), most)
        h = np.minimum(h, cap)
        go = np.flatnonzero((q >= 0) & (h < cap))
        while len(go):
            x = eight[p[go] + h[go]] ^ eight[q[go] + h[go]]
            # common low bytes of the two words
            low = x & (~x + U64(1))
            same = np.where(x == 0, 8, np.bitwise_count(low - U64(1)) // 8).astype(np.int64)
            h[go] = np.minimum(h[go] + same, cap[go])
            go = go[(same == 8) & (h[go] < cap[go])]
        lcp[p] = h
    return lcp


class Contexts:
    """A shard: the texts of contexts, with the starts that each of them owns.  Byte 255, which UTF-8 never has, parts the contexts."""

    def __init__(self, texts: list[bytes], owned: np.ndarray, length: int, report: int | None = None):
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size + 8) - size - 8
        data = np.frombuffer(b"".join(t + b"\xff" * 8 for t in texts), np.uint8)
        key = np.zeros(len(data), U64)
        padded = np.r_[data, np.full(8, 255, np.uint8)]
        for k in range(8):
            key |= padded[k : k + len(data)].astype(U64) << U64(56 - 8 * k)
        live = np.concatenate([np.arange(a, a + z) for a, z in zip(start, size, strict=True)])
        end = np.zeros(len(data), np.int32)
        end[live] = np.repeat(start + size, size)
        self.sa = refine(key, live, end)
        lcp = kasai(data, self.sa, live, end, start, size, length)
        self.own = np.concatenate([np.arange(a, a + n) for a, n in zip(start, owned, strict=True)])
        self.context = np.repeat(np.arange(len(texts)), owned)
        self.place = self.own - start[self.context]
        self.room = end[self.own] - self.own
        self.data = data
        self.repeats, self.short = (self._repeated(lcp, k) for k in (length, report or length))

    def _repeated(self, lcp: np.ndarray, length: int) -> np.ndarray:
        """Owned starts in a run of several whose suffixes share `length` bytes, each with the one before."""
        run = np.cumsum(lcp[self.sa] < length)
        at = np.zeros(len(self.data), np.int64)
        at[self.sa] = run
        return np.bincount(at[self.own], minlength=int(run[-1]) + 1)[at[self.own]] > 1


ANCHORS = "uid long, lo long, hi long, stop long, gram long, context long"


def _anchor_rows(docs: DataFrame, length: int, report: int) -> DataFrame:
    def run(batches):
        for b in batches:
            data, offsets = text_column(b)
            uid = np.asarray(b.column(0))
            for i, j in slices(offsets, SLICE_BYTES):
                doc, *rest = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, report)
                if len(doc):
                    yield pa.record_batch([pa.array(x) for x in (uid[i:j][doc], *rest)], [x.split()[0] for x in ANCHORS.split(", ")])
            release()

    return docs.select("uid", "text").where(F.octet_length("text") >= report).mapInArrow(run, ANCHORS)


_TEXTS = "uid long, lo long, hi long, gram long, shard long, ranges long, n long, body binary"


def _context_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted contexts (uid, lo, hi, stop, ...), cut from the documents where these are read."""
    names = [x.split()[0] for x in _TEXTS.split(", ")]
    path = by_part(wanted.select("uid", "lo", "hi", "stop", "gram", "shard", "ranges", "n"), "wanted")

    def run(batches):
        side = Side(path)
        for b in batches:
            for part in side.parts(b):
                asked = part.rows("uid")
                if not asked:
                    continue
                t = part.tables[0]
                pick = [(k, r) for k, u in enumerate(part.uid) for r in asked.get(u, ())]
                data, offsets = text_column(part.batch)
                raw, lo, stop = data.tobytes(), t.column("lo").to_numpy(), t.column("stop").to_numpy()
                for k in range(0, len(pick), 4000):
                    some = pick[k : k + 4000]
                    rows = t.take(pa.array([r for _, r in some])).combine_chunks()
                    body = pa.array([raw[offsets[d] + lo[r] : offsets[d] + stop[r]] for d, r in some], pa.binary())
                    yield pa.record_batch([*(rows.column(x).combine_chunks() for x in names[:-1]), body], names)
            release()

    return docs.select("uid", "text").mapInArrow(run, _TEXTS)


FOUND = "kind int, uid long, lo long, hi long, range long, gram long, keys binary, uids binary, places binary"


def _spans(uid: np.ndarray, at: np.ndarray):
    """(uid, first, last) of runs of consecutive starts."""
    if not len(uid):
        return
    new = np.r_[True, (uid[1:] != uid[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    for a, z in zip(first.tolist(), np.r_[first[1:] - 1, len(uid) - 1].tolist(), strict=True):
        yield int(uid[a]), int(at[a]), int(at[z])


def _likely(rows: list[dict], length: int, report: int) -> list[dict]:
    """Contexts cut to the starts, from first to last, whose string of `report` bytes has a hash that its gram has again: no other start can repeat.  Those of split grams stay whole."""
    own = np.array([r["hi"] - r["lo"] + 1 for r in rows], np.int64)
    size = np.array([len(r["body"]) for r in rows], np.int64)
    first = np.cumsum(own) - own
    at = np.arange(int(own.sum())) + np.repeat(np.cumsum(size) - size - first, own)
    h = range_hash(prefix_hash(np.frombuffer(b"".join(r["body"] for r in rows), np.uint8)), at, at + report)
    h ^= mix(np.repeat(np.array([r["gram"] for r in rows], np.int64).view(U64), own))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    hit = np.flatnonzero(again)
    i, j = np.searchsorted(hit, first), np.searchsorted(hit, first + own)
    out = []
    for k, r in enumerate(rows):
        if r["ranges"]:
            out.append(r)
        elif j[k] > i[k]:
            a, z = int(hit[i[k]] - first[k]), int(hit[j[k] - 1] - first[k])
            out.append({**r, "lo": r["lo"] + a, "hi": r["lo"] + z, "body": r["body"][a : z + length]})
    return out


def _shard_rows(texts: DataFrame, length: int, report: int, n_parts: int, shard_bytes: int) -> DataFrame:
    """Kind 0 or 2: repeated starts [lo, hi] of uid, found within a shard, of `length` or `report` bytes.  Kind 1 or 3: likewise the sorted string keys of a split gram's shard, by key range."""

    def solve(rows):
        rows = _likely(rows, length, report)
        if not rows:
            return []
        c = Contexts([r["body"] for r in rows], np.array([r["hi"] - r["lo"] + 1 for r in rows], np.int64), length, report)
        of = lambda k: np.array([r[k] for r in rows])[c.context]
        uid, at, whole, ranges, gram = of("uid"), of("lo") + c.place, of("n") > 1, of("ranges"), of("gram")
        out = []
        for kind, size, repeats in ((0, length, c.repeats), (2, report, c.short)):
            hit = np.flatnonzero(repeats & ~whole)
            out += [(kind, *x, None, None, None, None, None) for x in _spans(uid[hit], at[hit])]
            rest = np.flatnonzero((ranges > 0) & (c.room >= size))
            if not len(rest):
                continue
            h = range_hash(prefix_hash(c.data), c.own[rest], c.own[rest] + size)
            part = (h >> U64(40)).astype(np.int64) % ranges[rest]
            marks = np.where(~(repeats | whole)[rest], uid[rest], -1)
            for g in np.unique(gram[rest]).tolist():
                for q in np.unique(part[gram[rest] == g]).tolist():
                    k = np.flatnonzero((gram[rest] == g) & (part == q))
                    k = k[np.argsort(h[k], kind="stable")]
                    out.append((kind + 1, None, None, None, q, g, h[k].astype("<u8").tobytes(), marks[k].astype("<i8").tobytes(), at[rest][k].astype("<i8").tobytes()))
        return out

    def emit(out):
        if out:
            types = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 3]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    def run(batches):
        rows, size, key = [], 0, None
        for b in batches:
            for r in b.to_pylist():
                new = (r["gram"], r["shard"])
                if rows and new != key and size >= shard_bytes:
                    yield from emit(solve(rows))
                    rows, size = [], 0
                    release()
                rows.append(r)
                size += len(r["body"])
                key = new
        if rows:
            yield from emit(solve(rows))
        release()

    dealt = texts.repartition(n_parts, "gram", "shard").sortWithinPartitions("gram", "shard")
    return dealt.mapInArrow(run, FOUND)


def _merged(found: DataFrame, n_parts: int) -> DataFrame:
    """Cross-shard merging: the runs of a split gram's key range, each binary-searched in the others.  Column `long` tells `length` from `report`."""

    def run(batches):
        group, key = [], None
        for b in batches:
            for r in b.to_pylist():
                if key != (r["gram"], r["range"], r["kind"]) and group:
                    yield from merge(group)
                    group = []
                key = (r["gram"], r["range"], r["kind"])
                group.append(r)
        if group:
            yield from merge(group)

    def merge(group):
        runs = [np.frombuffer(r["keys"], "<u8") for r in group]
        for i, r in enumerate(group):
            uid, at, mine = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["places"], "<i8"), runs[i]
            hit = np.zeros(len(mine), bool)
            for j, other in enumerate(runs):
                if i != j:
                    k = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                    hit |= other[k] == mine
            hit &= uid >= 0
            if hit.any():
                yield pa.record_batch([pa.array(uid[hit]), pa.array(at[hit]), pa.array(at[hit]), pa.array([r["kind"] == 1] * int(hit.sum()))], ["uid", "lo", "hi", "long"])

    rows = found.where("kind in (1, 3)").repartition(n_parts, "gram", "range", "kind").sortWithinPartitions("gram", "range", "kind")
    return rows.mapInArrow(run, "uid long, lo long, hi long, long boolean")


def repeated_starts(docs: DataFrame, length: int = 400, report: int = 256, shard_bytes: int = 512 << 10, shard_contexts: int = 1_500) -> DataFrame:
    """uid, lo, hi, long: first and last of consecutive starts of strings of `length` bytes (long) or else of `report` that occur elsewhere too, of docs (uid, text).

    Starts of whole contexts are long, also those for which their document has no `length` bytes left.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = table(_anchor_rows(docs, length, report), "anchors")
    again = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("all")).where("all > 1").select("gram")
    rows = table(rows.join(again, "gram", "left_semi"), "again")
    classes = rows.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "lo", "hi", "stop")).alias("one"))
    grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"))
    known = table(classes.join(grams, "gram"), "contexts")
    whole = rows.join(known.where("n > 1").select("gram", "context"), ["gram", "context"]).select("uid", "lo", "hi", F.lit(True).alias("long"))
    shards = F.ceil(F.col("kinds") / shard_contexts)
    shard = F.when(shards > 1, F.pmod(F.col("context"), shards)).otherwise(F.lit(0)).cast("long")
    ranges = F.when(shards > 1, F.greatest(shards, F.lit(16))).otherwise(0)  # of a split gram's string keys: about a shard's contexts each
    wanted = known.where("kinds > 1").select("one.*", "gram", shard.alias("shard"), ranges.cast("long").alias("ranges"), "n")
    n_parts = partitions(spark, known.where("kinds > 1").count(), 20_000)
    found = table(_shard_rows(_context_texts(docs, wanted), length, report, n_parts, shard_bytes), "repeats")
    inner = found.where("kind in (0, 2)").select("uid", "lo", "hi", (F.col("kind") == 0).alias("long"))
    return whole.unionByName(inner).unionByName(_merged(found, n_parts))


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, removed array<struct<start: long, end: long>>"


def _covered(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes within strings of `length` bytes that start at lo to hi; runs that touch are one."""
    spans: list[tuple[int, int]] = []
    for a, z in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], z + length))
        else:
            spans.append((a, z + length))
    return spans


def dedup(docs: DataFrame, length: int = 400, report: int | None = None, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans), and n_repeated (bytes within strings of `report` bytes that start elsewhere too; `report` is at most `length`, 16/25 of it unless given) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    report = report or max(2, length * 16 // 25)
    if not 2 <= report <= length:
        raise ValueError("report must be 2 to length")
    rows = numbered(scanned(docs), F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = by_part(repeated_starts(rows, length, report, **how), "starts")

    def one(text: bytes, starts):
        uid_lo, uid_hi, long = starts
        near = _covered(uid_lo, np.minimum(uid_hi, len(text) - report), report)
        fits = long & (uid_lo <= len(text) - length)
        spans = _covered(uid_lo[fits], np.minimum(uid_hi[fits], len(text) - length), length)
        edges = [0, *(x for span in spans for x in span), len(text)]
        digest = hashlib.sha256()
        for a, z in zip(edges[::2], edges[1::2], strict=True):
            digest.update(text[a:z])
        return len(text), sum(z - a for a, z in spans), len(spans), digest.hexdigest(), sum(z - a for a, z in near), [{"start": a, "end": z} for a, z in spans]

    def run(batches):
        side, none = Side(path), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        names = ["doc_id", *(x.split()[0] for x in OUT.split(", ")[:5]), "removed"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for b in batches:
            for part in side.parts(b):
                if "starts" not in part.memo:
                    t = part.tables[0]
                    order = np.argsort(t.column("uid").to_numpy(), kind="stable") if t is not None else None
                    part.memo["starts"] = None if t is None else [t.column(x).to_numpy()[order] for x in ("uid", "lo", "hi", "long")]
                starts = part.memo["starts"]
                data, offsets = text_column(part.batch)
                raw, out = data.tobytes(), []
                for u, a, z in zip(part.uid, offsets.tolist(), offsets.tolist()[1:], strict=False):
                    i, j = np.searchsorted(starts[0], [u, u + 1]) if starts is not None else (0, 0)
                    out.append(one(raw[a:z], [x[i:j] for x in starts[1:]] if j > i else none))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([part.batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)
            release()

    return rows.select("uid", "doc_id", "text").mapInArrow(run, f"doc_id long, {OUT}")
