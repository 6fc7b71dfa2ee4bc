"""N-gram Jaccard join by parity sketches.

A document's set are the distinct hashes of its shingles.  Two sets link when
100 |A&B| >= ``percent`` |A|B|; then |A^B| <= (|A|+|B|) (100-percent) / (100+percent), which for 75 is
a seventh.  A parity sketch XORs each member into one of p segments; a member of A^B
changes one segment, so the segments that differ, and the bits that differ, never exceed
|A^B|.  By the pigeonhole principle a linked pair agrees in a segment that is not empty
whenever the larger set fills more segments than the pair may differ in.

* Sizes fall into bands [2^k, 2^(k+1)).  A band has its own number of segments; a pair meets
  in the larger set's band, so a set also sends segments to the next band if its partner may
  be there.  Sets smaller than ``small`` send every shingle as a segment.  The rare set
  that fills too few segments is compared with all sets, in blocks.
* Segments travel as packed arrays, one row for each slice and bucket.  Equal sets are one node,
  however many documents have them; until the links are known it goes by the identity of its first document,
  of which a row writes the upper bits once.
* A key that more than ``hot`` nodes share is not worth much: a set that fills enough other
  segments finds all its partners by those.  The others (mostly members of large groups of
  near copies) probe only as many of their hot keys, the rarest first, as they need.
* Of each group that shares a key, all are first compared with one member of like size.  Links
  so found join components; then only pairs of different components are left to compare, and of
  those each has one member outside the group's largest component.
* Hot groups that are still of several components, and share members, are joined to one cluster,
  so that a node takes part once and not once a key.  A cluster is compared in blocks, by sketches and
  then sets; a pair that a block has already joined is passed over, so a block makes at most
  one row for each of its nodes.
* Other pairs are compared by sketches first (a lower bound of |A^B|), then by their sets, where the
  documents are read.

Sets are of 64-bit hashes and nodes 64-bit hashes of sets.  Null and empty texts have empty sets and
link with nothing; a text with fewer words than a shingle is one shingle; repeated rows are linked
with each other; rows with a null id are linked under each other's ids; an empty table gives an empty
result; other columns are not read.  Rows are told apart by their file and place in it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, NOT_SPACE, U64, mix, prefix_hash, range_hash, release, slices, text_column, words
from .common import kept, lacking, numbered, partitions, rest, scanned, small_batches
from .components import components
from .sides import PART_BITS, Side, by_part

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)
PERCENT, SHINGLE, SMALL, HOT = 75, 5, 64, 24
#: Bytes of text that a worker handles at once: hashes take many times that.
SLICE_BYTES = 1 << 20
#: Segments of a band are 2^k / LOAD: a set fills them 1.25 to 2.5 times over in its own band.
LOAD = 1.25


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    data = LOWER[data]
    start, end, before = words(data, offsets, NOT_SPACE)
    h = range_hash(prefix_hash(data), start, end)
    m = len(h)
    s = np.zeros(m, U64)
    for k in range(n):
        s[: max(m - k, 0)] += h[k:] * _FACTORS[k % 5] ** U64(1 + k // 5)
    s = mix(s)
    out = []
    for a, z in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(s[a : z - n + 1]))
        elif z > a:
            short = (h[a:z] * _FACTORS[: z - a]).sum(dtype=U64) + U64(z - a)
            out.append(mix(np.array([short], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def node_of(s: np.ndarray) -> int:
    return int(mix(np.array([s.sum(dtype=U64) ^ U64(len(s) << 40)], U64)).view(np.int64)[0])


def may_differ(a, b):
    """The most members that a linked pair of these sizes may differ in."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def segments(s: np.ndarray, band: int) -> np.ndarray:
    """Keys of the segments that the set fills in a band."""
    if (2 << band) <= SMALL:
        return mix(s ^ U64(0x5851F42D4C957F2D))
    p = int((1 << band) / LOAD)
    at = ((s >> U64(40)) % U64(p)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, codes = at[order], mix(s[order] * _FACTORS[2])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return mix(np.bitwise_xor.reduceat(codes, first) ^ mix(at[first].astype(U64) * _FACTORS[3] + U64(band)))


def bands_of(n: int) -> list[int]:
    own = int(n).bit_length() - 1
    return [own, own + 1] if n * 100 >= PERCENT * (2 << own) else [own]


def sketch(s: np.ndarray) -> bytes:
    """A parity sketch of 1 to 2 bits for each member, 64 at least; sketches of different widths compare after folding."""
    return _parity(s, max(64, 1 << len(s).bit_length()))


def _parity(s: np.ndarray, width: int) -> bytes:
    bits = np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; at most the size of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


SETS = "doc_id long, uid long, n long, node long, filled long, sketch binary"


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            data, offsets = text_column(b)
            for i, j in slices(offsets, SLICE_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = [len(s) for s in sets]
                filled = [len(segments(s, bands_of(len(s))[0])) if len(s) else 0 for s in sets]
                cols = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(filled, pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
                yield pa.record_batch(cols, [x.split()[0] for x in SETS.split(", ")])
            release()

    return kept(docs.select("doc_id", "uid", "text"), "sets", run, SETS)


def _segments(docs: DataFrame, nodes: str, buckets: int) -> DataFrame:
    """Packed segments of one document for each node (the side table `nodes`): of each slice and bucket the keys (5 bytes) set by set, and of each set and band the number of keys, the place of its document in the part, its size and whether the band is its own."""
    columns = "bucket int, part long, keys binary, counts binary, nodes binary, sizes binary, own binary"

    def run(batches):
        side = Side(nodes)
        for b in batches:
            for part in side.parts(b):
                rows = part.rows("uid")
                b_ = part.batch.filter(pa.array([u in rows for u in part.uid], pa.bool_()))
                if b_.num_rows:
                    yield from solve(b_, part.number)
            release()

    def solve(b, part):
        data, offsets = text_column(b)
        place = np.asarray(b.column(0)) & ((1 << PART_BITS) - 1)
        for i, j in slices(offsets, SLICE_BYTES):
            key, which, own, nodes, sizes = [], [], [], [], []
            for doc, s in zip(place[i:j], shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                for band in bands_of(len(s)):
                    k = segments(s, band)
                    key.append(k)
                    which.append(np.full(len(k), len(nodes), np.uint32))
                    nodes.append(doc)
                    sizes.append(len(s))
                    own.append(band == len(s).bit_length() - 1)
            key, which = np.concatenate(key), np.concatenate(which)
            to = (key % U64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(buckets + 1))
            node, size, own, out = np.array(nodes, "<u2"), np.array(sizes, np.int64), np.array(own), []
            for q in np.flatnonzero(np.diff(edge)).tolist():
                k = order[edge[q] : edge[q + 1]]
                used, count = np.unique(which[k], return_counts=True)  # the order keeps the keys of a set together
                five = (key[k] // U64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                out.append((q, part << PART_BITS, five.tobytes(), _tight(count), node[used].tobytes(), _tight(size[used]), np.packbits(own[used]).tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], [x.split()[0] for x in columns.split(", ")])

    return docs.select("uid", "text").mapInArrow(run, columns)


def _tight(x: np.ndarray) -> bytes:
    """Numbers in 1, 2 or 4 bytes each, whichever holds them all."""
    return x.astype("<u1" if x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4").tobytes()


def _unpack(r: dict) -> tuple[np.ndarray, ...]:
    """Keys, nodes, sizes and whether the band is the set's own, of each segment of a row."""
    five = np.frombuffer(r["keys"], np.uint8).reshape(-1, 5)
    key = np.zeros((len(five), 8), np.uint8)
    key[:, :5] = five
    nodes = np.frombuffer(r["nodes"], "<u2") + np.int64(r["part"])
    wide = lambda x: np.frombuffer(x, f"<u{len(x) // len(nodes)}").astype(np.int64)
    which = np.repeat(np.arange(len(nodes)), wide(r["counts"]))
    return key.view("<u8").ravel(), nodes[which], wide(r["sizes"])[which], np.unpackbits(np.frombuffer(r["own"], np.uint8))[which].astype(bool)


GROUPS = "kind int, g long, a long, b long, n long, own boolean"


def _fits(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return small * 100 >= PERCENT * large


def _stars(group: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each group's members (sorted by group, then size) with a member of like size."""
    left, right = [], []
    live = np.arange(len(group))
    while len(live):
        first = np.r_[True, group[live][1:] != group[live][:-1]]
        head = live[np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))]
        ok = _fits(n[head], n[live])
        take = ok & ~first
        left.append(node[head[take]])
        right.append(node[live[take]])
        live = live[~ok]
    return np.concatenate(left) if left else node[:0], np.concatenate(right) if right else node[:0]


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return a[new], b[new]


def _groups(packed: DataFrame, buckets: int, hot: int) -> DataFrame:
    """Kind 0: star pairs (a, b).  Kind 1: members (g, a, n) of groups of three or more, each set of members once.  Kind 2: members of hot groups."""
    names = [x.split()[0] for x in GROUPS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def batch(kind, g, a, b, n, own):
        size = len(a)
        cols = [np.full(size, kind, np.int32), g, a, b, n, own]
        return pa.record_batch([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def solve(rows):
        key, node, n, own = (np.concatenate(x) for x in zip(*map(_unpack, rows), strict=True))
        order = np.argsort(key, kind="stable")
        key, node, n, own = key[order], node[order], n[order], own[order]
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        key, node, n, own, group = key[several], node[several], n[several], own[several], group[several]
        if not len(key):
            return
        order = np.lexsort((node, n, group))
        key, node, n, own, group = key[order], node[order], n[order], own[order], group[order]
        once = np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])]
        key, node, n, own, group = key[once], node[once], n[once], own[once], group[once]
        size = np.bincount(group)[group]
        cool = (size > 1) & (size <= hot)
        a, b = _unique_pairs(*_stars(group[cool], node[cool], n[cool]))
        for k in range(0, len(a), 50_000):
            yield batch(0, None, a[k : k + 50_000], b[k : k + 50_000], None, None)
        some = cool & (size > 2)
        g, m, c = group[some], node[some], n[some]
        if len(g):
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            name = np.add.reduceat(mix(m.view(U64) * _FACTORS[4]), first).view(np.int64)
            _, keep = np.unique(name, return_index=True)
            chosen = np.zeros(len(first), bool)
            chosen[keep] = True
            which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(g)]))
            sel = chosen[which]
            for k in range(0, int(sel.sum()), 50_000):
                part = np.flatnonzero(sel)[k : k + 50_000]
                yield batch(1, name[which[part]], m[part], None, c[part], None)
        warm = np.flatnonzero(size > hot)
        for k in range(0, len(warm), 50_000):
            part = warm[k : k + 50_000]
            yield batch(2, mix(key[part] * U64(buckets) + U64(rows[0]["bucket"])).view(np.int64), node[part], None, n[part], own[part])

    def run(batches):
        rows, at = [], None
        for b in batches:
            for r in b.to_pylist():
                if rows and r["bucket"] != at:
                    yield from solve(rows)
                    rows = []
                    release()
                at = r["bucket"]
                rows.append(r)
        if rows:
            yield from solve(rows)
        release()

    return kept(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket"), "groups", run, GROUPS)


def _sets_of(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """node, members: the sets of the wanted (uid, node), computed where the documents are read; no text is moved."""
    path = by_part(wanted.select("uid", "node"), f"{name}-wanted")

    def run(batches):
        side = Side(path)
        for b in batches:
            for part in side.parts(b):
                rows = part.rows("uid")
                node = [part.tables[0].column("node")[rows[u][0]].as_py() if u in rows else None for u in part.uid]
                pick = [k for k, x in enumerate(node) if x is not None]
                if not pick:
                    continue
                data, offsets = text_column(part.batch.take(pa.array(pick)))
                for i, j in slices(offsets, SLICE_BYTES):
                    found = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    yield pa.record_batch([pa.array([node[k] for k in pick[i:j]], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "members"])
            release()

    return kept(docs.select("uid", "text"), f"{name}-sets", run, "node long, members binary")


def _checked(docs: DataFrame, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b, uid of b) that link, with the sets (node, members) of all a; b's set is computed where its document is read, and a's goes once to each part that asks for it."""
    pairs = kept(pairs, f"{name}-asked")
    path = by_part(pairs, f"{name}-pairs")
    asked = pairs.select(F.shiftleft(F.shiftright("uid", PART_BITS), PART_BITS).alias("uid"), F.col("a").alias("node")).distinct()
    side_sets = by_part(asked.join(sets, "node"), f"{name}-with")

    def run(batches):
        side = Side(path, side_sets)
        for b in batches:
            for part in side.parts(b):
                rows = part.rows("uid")
                pick = [k for k, u in enumerate(part.uid) if u in rows]
                if not pick:
                    continue
                t, with_ = part.tables
                place = {n: k for k, n in enumerate(with_.column("node").to_pylist())}
                members, uid = with_.column("members"), part.uid
                data, offsets = text_column(part.batch.take(pa.array(pick)))
                out = []
                for i, j in slices(offsets, SLICE_BYTES):
                    for k, s in zip(pick[i:j], shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                        for r in rows[uid[k]]:
                            a = t.column("a")[r].as_py()
                            if links(np.frombuffer(members[place[a]].as_buffer(), U64), s):
                                out.append((a, t.column("b")[r].as_py()))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            release()

    return kept(docs.select("uid", "text"), f"{name}-links", run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that link: by wide sketches, then by the sets of one document of each node."""
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

    def near(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            keep = [100 * min(na, nb) >= PERCENT * max(na, nb) and distance(sa, sb) <= may_differ(na, nb) for _, _, na, sa, nb, sb in rows]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    left = kept(joined, f"{name}-near", near, "a long, b long")
    where = nodes.select("node", "uid")
    wanted = left.select(F.col("a").alias("node")).distinct().join(where, "node").select("uid", "node")
    sets = _sets_of(docs, wanted, name)
    asked = left.join(where.select(F.col("node").alias("b"), "uid"), "b").select("uid", "a", "b")
    return _checked(docs, asked, sets, name)


def _weak_links(docs: DataFrame, weak: DataFrame, block_bytes: int = 16 << 20) -> DataFrame | None:
    """Links of the sets that fill too few segments, with all sets: blocks of them are broadcast, one after the other."""
    spark, out, block, size = docs.sparkSession, None, [], 0

    def run_with(bc):
        def run(batches):
            for b in batches:
                data, offsets = text_column(b)
                for i, j in slices(offsets, SLICE_BYTES):
                    found = [(min(x, y), max(x, y)) for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for x, t in bc.value if len(s) and len(s) * 100 >= PERCENT * len(t) and len(t) * 100 >= PERCENT * len(s) and links(s, t) and (y := node_of(s)) != x]
                    if found:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        return docs.select("text").mapInArrow(run, "a long, b long")

    def flush():
        nonlocal out, block, size
        if block:
            part = run_with(spark.sparkContext.broadcast(block))
            out = part if out is None else out.unionByName(part)
            block, size = [], 0

    for r in docs.select("uid", "text").join(weak.select("uid"), "uid").select("text").toLocalIterator():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        s = shingle_sets(raw, np.array([0, len(raw)]))[0]
        block.append((node_of(s), s))
        size += len(s) * 8
        if size > block_bytes:
            flush()
    flush()
    return out


def _labels(link_tables: list[DataFrame]) -> DataFrame:
    rest(link_tables[0].sparkSession)  # the step that found the last links is done
    edges = link_tables[0]
    for t in link_tables[1:]:
        edges = edges.unionByName(t)
    return components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l_{k}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Members (g, node, n, ...) of the groups that hold more than one component, with their label and the group's largest (main)."""
    m = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = m.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("parts"), F.max_by("label", F.struct("c", "label")).alias("main")).where("parts > 1")
    return kept(m.join(main.select("g", "main"), "g"), name)


def _cross(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of members (g, node, n) of one small group in different components.  Rows may be repeated; they move once to their node's label and once to their group."""
    m = members.repartition("node").distinct().join(labels, "node", "left").select("g", "node", "n", F.coalesce("label", "node").alias("label"))

    def solve(g, node, n, label):
        for d in itertools.count(1):
            same = g[d:] == g[:-d]
            if not same.any():
                return
            small, large = np.minimum(n[d:], n[:-d]), np.maximum(n[d:], n[:-d])
            found = same & (label[d:] != label[:-d]) & _fits(small, large)
            a, b = _unique_pairs(node[:-d][found], node[d:][found])
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            held = [np.concatenate([x, np.asarray(y)]) for x, y in zip(held, b.columns, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1:], "left")[0]) if len(held[0]) else 0
            yield from solve(*(x[:last] for x in held))
            held = [x[last:] for x in held]
        yield from solve(*held)

    return m.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long").distinct()


class _Block:
    """Sets of a block of nodes by size, with the components known so far."""

    def __init__(self, node: np.ndarray, label: np.ndarray, home: np.ndarray, sets: list[np.ndarray]):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.node, self.home, self.sets = node[order], home[order], [sets[k] for k in order]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.root = np.unique(label[order], return_inverse=True)[1]

    def sketches(self, first: int, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(_parity(s, width) for s in self.sets[first:]), U64).reshape(-1, width // 64)

    def joined(self, across: bool) -> list[tuple[int, int]]:
        """Links that join components, as (a, b); with `across`, only nodes of different homes are compared."""
        n, out, width, first, held = self.n, [], 0, 0, None
        for y in range(1, len(n)):
            low = int(np.searchsorted(n * 100, PERCENT * n[y], "left"))
            need = min(8192, 64 << max(0, int(4 * n[y] - 1).bit_length() - 6))
            if need != width:
                width, first = need, low
                held = self.sketches(first, width)
            may = self.root[low:y] != self.root[y]
            if across:
                may &= self.home[low:y] != self.home[y]
            x = np.flatnonzero(may) + low
            if not len(x):
                continue
            apart = np.bitwise_count(held[x - first] ^ held[y - first]).sum(1, dtype=np.int64)
            near = apart <= may_differ(n[x], n[y])
            x, apart = x[near], apart[near]
            for k in x[np.argsort(apart, kind="stable")].tolist():
                if self.root[k] != self.root[y] and links(self.sets[k], self.sets[y]):
                    a, b = sorted((int(self.node[k]), int(self.node[y])))
                    out.append((a, b))
                    self.root[self.root == self.root[k]] = self.root[y]
        return out


def _hot_links(docs: DataFrame, warm: DataFrame, labels: DataFrame, nodes: DataFrame, block_bytes: int = 24 << 20) -> DataFrame:
    """Links that join the components within hot groups: of clusters of groups, in pairs of blocks."""
    m = _mixed(warm, labels, "hot")
    hubs = m.groupBy("g").agg(F.min("node").alias("v"))
    edges = m.join(hubs, "g").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    cluster = components(edges, "clusters").select("node", F.col("label").alias("cluster"))
    members = m.select("node", "label").distinct().join(cluster, "node").join(nodes.select("node", "uid", "n"), "node")
    members = kept(members, "clustered")
    sets = _sets_of(docs, members, "hot")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") * 8 / block_bytes).cast("int").alias("blocks"))
    rows = members.join(sizes, "cluster").withColumn("home", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "node", "label", "home").join(sets, "node")

    def solve(found):
        t = pa.Table.from_batches(found)
        sets = [np.frombuffer(x.as_buffer(), U64) for x in t.column("members")]
        node, label, home = (np.asarray(t.column(c)) for c in ("node", "label", "home"))
        out = _Block(node, label, home, sets).joined(across=t.column("i")[0].as_py() != t.column("j")[0].as_py())
        release()
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), ()))], ["a", "b"])

    def run(batches):
        held, last = [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(b.schema.get_field_index(c))) for c in ("cluster", "i", "j")], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]) if len(keys) else np.zeros(0, int)
            for a, z in itertools.pairwise(edges.tolist()):
                key = tuple(keys[a])
                if held and key != last:
                    yield solve(held)
                    held = []
                last = key
                held.append(b.slice(a, z - a))
        if held:
            yield solve(held)

    n = partitions(docs.sparkSession, members.count(), 2_000)
    return kept(rows.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), "hot-links", run, "a long, b long")


def join(docs: DataFrame, hot: int = HOT, keys_per_bucket: int = 1_200_000) -> DataFrame:
    """doc_id, n_shingles, component_id and node of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered(scanned(docs), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _sets(rows)
    nodes = kept(sets.where("n > 0").groupBy("node").agg(F.min(F.struct("uid", "n", "filled", "sketch")).alias("x")).select("node", "x.*"), "nodes")
    total, by_hash = nodes.agg(F.sum("n")).first()[0] or 0, nodes
    nodes = by_hash.withColumn("node", F.col("uid"))
    buckets = partitions(spark, int(total * 0.7), keys_per_bucket)
    first = by_part(nodes.select("uid"), "firsts")
    found = _groups(_segments(rows, first, buckets), buckets, hot)
    rest(spark)
    links_found = []

    most = F.floor(2 * F.col("n") * (100 - PERCENT) / (100 + PERCENT))
    weak = nodes.where(F.col("filled") <= most)
    if weak.limit(1).count():
        named = lambda k: by_hash.select(F.col("node").alias(k), F.col("uid").alias(f"u_{k}"))
        links_found.append(kept(_weak_links(rows, weak).join(named("a"), "a").join(named("b"), "b").select(F.col("u_a").alias("a"), F.col("u_b").alias("b")), "weak"))

    # hot groups: members, and the sets that need them, each with the rarest hot keys it needs
    members = found.where("kind = 2").select("g", F.col("a").alias("node"), "n", "own")
    sized = members.join(members.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "g")
    mine = sized.where("own").join(nodes.select("node", "filled"), "node")
    by_node = Window.partitionBy("node")
    mine = mine.withColumn("others", F.col("filled") - F.count(F.lit(1)).over(by_node)).withColumn("rank", F.row_number().over(by_node.orderBy("c", "g")))
    probes = kept(mine.where(F.col("rank") <= most + 1 - F.col("others")).select("g", "node", "n"), "probes")
    warm = kept(members.select("g", "node", "n").join(probes.select("g").distinct(), "g", "left_semi"), "warm")
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))
    classes = probes.withColumn("level", level)
    heads = classes.groupBy("g", "level").agg(F.min(F.struct("node", "n")).alias("h"))
    stars = classes.join(heads, ["g", "level"]).select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"))
    next_ = heads.select("g", (F.col("level") + 1).alias("level"), F.col("h").alias("k"))
    stars = stars.unionByName(heads.join(next_, ["g", "level"]).select(F.least("h.node", "k.node").alias("a"), F.greatest("h.node", "k.node").alias("b")))

    pairs = kept(found.where("kind = 0").select("a", "b").unionByName(stars).where("a <> b").distinct(), "pairs")
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links_found.append(_verified(one, nodes, rows, "first"))
    labels = _labels(links_found)
    links_found.append(_verified(_apart(pairs.join(one, ["a", "b"], "left_anti"), labels), nodes, rows, "second"))
    labels = _labels(links_found)
    cool = found.where("kind = 1").select("g", F.col("a").alias("node"), "n")
    links_found.append(_hot_links(rows, warm, labels, nodes))
    labels = _labels(links_found)
    left = kept(_cross(cool, labels).join(pairs, ["a", "b"], "left_anti"), "left")
    links_found.append(_verified(left, nodes, rows, "third"))
    labels = _labels(links_found)
    rest(spark)
    hashed = lambda k: by_hash.select(F.col("uid").alias(k), F.col("node").alias(f"h_{k}"))
    labels = labels.join(hashed("node"), "node").join(hashed("label"), "label").select(F.col("h_node").alias("node"), F.col("h_label").alias("label"))
    named = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node", "uid")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest id (of equal ids the first), and every row without words; all columns as they are."""
    docs = scanned(docs)
    out = join(docs, **how)
    first = out.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("node")).alias("_o")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("_z"), "doc_id", "uid")).alias("f")).select("f.uid")
    path = by_part(first.unionByName(out.where("n_shingles = 0").select("uid")), "kept")
    rest(docs.sparkSession)
    name = lacking(docs, "_uid")

    def run(batches):
        side = Side(path)
        for b in batches:
            for part in side.parts(b):
                rows = part.rows("uid")
                yield part.batch.filter(pa.array([u in rows for u in part.uid], pa.bool_())).select(range(1, b.num_columns))

    return numbered(docs, *[docs[f"`{c}`"] for c in docs.columns], name=name).select(name, *[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, docs.schema)
