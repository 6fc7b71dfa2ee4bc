"""Benchmark decontamination with training suffix arrays.

Each slice of documents is a training shard.  Its words become ids of the
benchmark's vocabulary (0: any other word, or a document's end), and the suffixes
that begin with a known word are sorted: first by as many ids as fit one 63-bit
key, then by Larsson-Sadakane doubling of the groups still equal, to the length of the
longest item.  Every suffix of every item is then binary-searched in the shard; its
neighbours give the longest verbatim match and where it is, and a second pair of
searches gives all places of each window.

A window is ``window`` consecutive words of an item; an item with fewer words, but not
none, is one window.  Words are compared by hash (two residues of 31 bits) and byte length.

The benchmark reaches the workers in blocks of at most ``block_bytes`` text, one
broadcast each, so no broadcast grows with it; a slice is searched for block after block, and
driver and workers hold one block at a time.

Null and empty texts have no words; an item without words has no window; an
item with a null id still hits words and is listed as the empty string; repeated items
and rows count as they are; an empty table or benchmark gives results without hits.
Columns other than doc_id and text, or item_id and text, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, prefix_hash, range_hash, release, slices, text_column, words
from .common import small_batches

#: Bytes of text of a shard.
SLICE_BYTES = 2 << 20


class Items:
    """Words of a block of benchmark items as ids, and their windows."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.names = [n for n, _ in rows]
        data = LOWER[np.frombuffer(b"".join(t for _, t in rows), np.uint8)]
        offsets = np.cumsum([0, *(len(t) for _, t in rows)])
        start, end, before = words(data, offsets, ALNUM)
        h = range_hash(prefix_hash(data), start, end)
        self.vocabulary, first, ids = np.unique(h, return_index=True, return_inverse=True)
        self.sizes = (end - start)[first]
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = 63 // self.bits
        n = np.diff(before)
        self.depth = int(n.max()) if len(n) else 0
        item = np.repeat(np.arange(len(n)), n)
        self.length = before[item + 1] - np.arange(len(start))  # of each word of each item, the words from there to the item's end
        self.key = np.zeros(len(start), np.int64)  # and as many of them as fit one key
        for k in range(self.per):
            has = np.flatnonzero(self.length > k)
            self.key[has] |= (ids[has + k] + 1) << (self.bits * (self.per - 1 - k))
        size = np.minimum(window, n)[item]
        self.window_of = np.flatnonzero((self.length >= size) & (size > 0))
        self.window_item, self.window_size = item[self.window_of], size[self.window_of]
        self.suffix_item = item

    def ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(start), np.int64)
        h = range_hash(prefix_hash(data), start, end)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where((self.vocabulary[at] == h) & (self.sizes[at] == end - start), at + 1, 0)


class Query:
    """Runs of words of the items, key by key, so that a run takes no more room than its place.  With `high`, all words may follow a run, else none."""

    def __init__(self, items: Items, at: np.ndarray, size: np.ndarray, high: bool = False):
        self.items, self.at, self.size, self.high = items, at, size, high
        self.blocks = -(-size // items.per)

    def key(self, b: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        it, size = self.items, self.size[rows]
        left = np.clip(size - b * it.per, 0, it.per)
        found = it.key[np.minimum(self.at[rows] + b * it.per, max(0, len(it.key) - 1))]
        free = it.bits * (it.per - left)
        found = np.where(left > 0, (found >> free) << free, 0)
        return found | ((1 << free) - 1) if self.high else found


class SuffixArray:
    """Sorted suffixes of one shard of word ids; `ids` ends with enough zeros."""

    def __init__(self, ids: np.ndarray, bits: int, per: int, depth: int):
        n = len(ids)
        key = np.zeros(n, np.int64)
        for k in range(per):
            key[: n - k] |= ids[k:] << (bits * (per - 1 - k))
        self.key, self.per, self.bits = key, per, bits
        sa = np.flatnonzero(ids)
        sa = sa[np.argsort(key[sa], kind="stable")]
        sorted_ = key[sa]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(sa) else np.zeros(0, bool)
        group = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
        rank = np.zeros(n, np.int64)  # 0 where no suffix begins; equal for suffixes not yet told apart
        rank[sa] = group + 1
        low = (1 << bits) - 1
        slot = np.flatnonzero((np.bincount(group, minlength=len(sa)) > 1)[group] & ((sorted_ & low) > 0)) if len(sa) else sa
        h = per
        while h < depth and len(slot):
            at = sa[slot]
            both = (rank[at] << 32) | rank[at + h]
            order = np.argsort(both, kind="stable")
            at, both = at[order], both[order]
            sa[slot] = at
            new = np.r_[True, both[1:] != both[:-1]]
            group = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
            more = (both & 0xFFFFFFFF) > 0
            rank[at] = group + 1
            last = np.r_[new[1:], True]
            slot = slot[~(new & last) & more]
            h *= 2
        self.sa = sa
        self.first = key[sa]

    def place(self, query: Query) -> np.ndarray:
        """For each run of the query, the slot of the first suffix not below it (with `high`: above it), by binary search."""
        first = query.key(0)
        lo = np.searchsorted(self.first, first, "left")
        hi = np.searchsorted(self.first, first, "right")
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            below = np.zeros(len(todo), bool)
            open_, b = np.arange(len(todo)), 1
            while len(open_ := open_[query.blocks[todo[open_]] > b]) or b == 1:
                mine, theirs = query.key(b, todo[open_]), self.key[self.sa[mid[open_]] + b * self.per]
                below[open_[theirs < mine]] = True
                if query.high:  # runs that end here, or that the suffix equals so far, are not above it
                    below[open_[(theirs == mine) & (query.blocks[todo[open_]] == b + 1)]] = True
                open_, b = open_[theirs == mine], b + 1
                if not len(open_):
                    break
            if query.high:
                below[query.blocks[todo] <= 1] = True
            lo[todo[below]], hi[todo[~below]] = mid[below] + 1, mid[~below]
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def common(self, query: Query, slot: np.ndarray) -> np.ndarray:
        """Ids that each run shares with the suffix in its slot (0 where there is no such slot)."""
        out = np.zeros(len(slot), np.int64)
        open_, b = np.flatnonzero((slot >= 0) & (slot < len(self.sa))), 0
        while len(open_ := open_[query.blocks[open_] > b]):
            differ = query.key(b, open_) ^ self.key[self.sa[slot[open_]] + b * self.per]
            same = np.full(len(open_), self.per)
            for k in range(self.per):
                same[(differ >> (self.bits * (self.per - 1 - k)) > 0) & (same == self.per)] = k
            out[open_] += same
            open_, b = open_[same == self.per], b + 1
        return np.minimum(out, query.size)


class Shard:
    """The suffix array of one slice of documents for one block of items."""

    def __init__(self, items: Items, data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray):
        self.items, self.before = items, before
        doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
        ids = np.zeros(len(start) + len(before) - 1 + (items.depth + items.per) * 2 + 2, np.int64)
        ids[np.arange(len(start)) + doc] = items.ids_of(data, start, end)
        self.array = SuffixArray(ids, items.bits, items.per, max(items.depth, 1))

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each item suffix, the length of its longest match and the word (counted with one end mark a document) where it begins."""
        query = Query(self.items, np.arange(len(self.items.length)), self.items.length)
        slot = self.array.place(query)
        above = self.array.common(query, slot - 1)
        below = self.array.common(query, slot)
        best = np.where(above > below, slot - 1, slot)
        size = np.maximum(above, below)
        at = np.where(size > 0, self.array.sa[np.clip(best, 0, max(0, len(self.array.sa) - 1))] if len(self.array.sa) else 0, 0)
        return size, at

    def document(self, at: np.ndarray) -> np.ndarray:
        """Documents of words counted with end marks."""
        return np.searchsorted(self.before + np.arange(len(self.before)), at, "right") - 1

    def windows(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows: word (with end marks), words, item."""
        it = self.items
        found = np.flatnonzero(size[it.window_of] >= it.window_size)
        if not len(found):
            return (np.zeros(0, np.int64),) * 3
        at, size = it.window_of[found], it.window_size[found]
        lo, hi = self.array.place(Query(it, at, size)), self.array.place(Query(it, at, size, high=True))
        n = hi - lo
        slot = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.array.sa[slot], np.repeat(it.window_size[found], n), np.repeat(it.window_item[found], n)


def _forget(block) -> None:
    """Drop a broadcast's value; it is read again from its file when it is asked for."""
    block.__dict__.pop("_value", None)


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of the benchmark's items; the driver holds one block at a time."""
    sc, out, rows, size = benchmark.sparkSession.sparkContext, [], [], 0

    def send():
        out.append(sc.broadcast(Items(rows, window)))
        _forget(out[-1])

    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        text = (r.text or "").encode()
        if rows and size + len(text) > block_bytes:
            send()
            rows, size = [], 0
        rows.append((r.item_id or "", text))
        size += len(text)
    if rows:
        send()
    return out


def _search(parts: list, data: np.ndarray, offsets: np.ndarray):
    """Of each document of a slice: words, hit words, items, longest match."""
    data = LOWER[data]
    start, end, before = words(data, offsets, ALNUM)
    n, n_words = len(offsets) - 1, np.diff(before)
    marks = np.zeros(len(start) + n + 1, np.int64)
    names: dict[int, set[str]] = {}
    longest = np.zeros(n, np.int64)
    for p in parts:
        items = p.value
        if not items.depth or not len(start):
            continue
        shard = Shard(items, data, start, end, before)
        size, at = shard.longest()
        found = size > 0
        np.maximum.at(longest, shard.document(at[found]), size[found])
        at, length, item = shard.windows(size)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        both = np.unique(shard.document(at) * len(items.names) + item)
        for d, i in zip((both // len(items.names)).tolist(), (both % len(items.names)).tolist(), strict=True):
            names.setdefault(d, set()).add(items.names[i])
        if len(parts) > 1:
            _forget(p)
    hit = np.r_[0, np.cumsum(np.cumsum(marks)[:-1] > 0)]
    edge = before + np.arange(n + 1)
    return n_words, hit[edge[1:]] - hit[edge[:-1]], names, longest


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated and longest_match (words) of every row of docs."""
    small_batches(docs.sparkSession)
    parts = blocks(benchmark, window, block_bytes)

    def run(batches):
        for b in batches:
            data, offsets = text_column(b)
            for i, j in slices(offsets, SLICE_BYTES):
                n_words, n_hit, names, longest = _search(parts, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = [sorted(names.get(k, ())) for k in range(j - i)]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
                cols = [b.column(0).slice(i, j - i), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(sha), pa.array(n_hit > 0), pa.array(longest)]
                yield pa.record_batch(cols, ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "longest_match"])

    columns = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, longest_match long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, columns)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs without any window of the benchmark, all columns as they are."""
    small_batches(docs.sparkSession)
    parts = blocks(benchmark, window, block_bytes)

    def run(batches):
        for b in batches:
            data, offsets = text_column(b)
            keep = [_search(parts, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1] == 0 for i, j in slices(offsets, SLICE_BYTES)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
            release()

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """Of each item that shares a word with any document: the longest match over all shards, and a document and word where it begins (of equal ones the smallest doc_id, then word)."""
    small_batches(docs.sparkSession)
    parts = blocks(benchmark, 1, block_bytes)

    def run(batches):
        for b in batches:
            data, offsets = text_column(b)
            for i, j in slices(offsets, SLICE_BYTES):
                low = LOWER[data[offsets[i] : offsets[j]]]
                start, end, before = words(low, offsets[i : j + 1] - offsets[i], ALNUM)
                for p in parts:
                    items = p.value
                    if not items.depth or not len(start):
                        continue
                    shard = Shard(items, low, start, end, before)
                    size, at = shard.longest()
                    f = np.flatnonzero(size)
                    doc = shard.document(at[f])
                    key = b.column(0).slice(i, j - i).take(pa.array(doc))
                    names = pa.array([items.names[k] for k in items.suffix_item[f]], pa.string())
                    yield pa.record_batch([names, pa.array(size[f]), key, pa.array(at[f] - before[doc] - doc)], ["item_id", "n_words", "doc_id", "word"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item_id string, n_words long, doc_id long, word long")
    best = F.max_by(F.struct("n_words", "doc_id", "word"), F.struct("n_words", -F.col("doc_id"), -F.col("word")))
    return found.groupBy("item_id").agg(best.alias("b")).select("item_id", "b.n_words", "b.doc_id", "b.word")
