"""Quality classifier: a byte-level convolutional network in numpy.

Each byte enters as a learned vector and one channel that says whether the eight
bytes from here also began within the last 96 bytes.  Learned filters over
``TAPS`` bytes, one every ``STEP`` bytes, are rectified and averaged over overlapping
chunks of ``CHUNK`` filter positions, half a chunk apart, which cover the whole
document; the chunks' features are max-pooled, and a small dense layer combines
them into one probability.

It is fitted on the driver on at most ``sample_rows`` labelled rows whose crc32(doc_id)
mod 5 is not 0 and at most ``sample_bytes`` of text; scoring reads the text alone.
Null and empty texts are scored as one chunk of padding; repeated rows score
alike; an empty table gives an empty result; where no labels exist, the untrained
prior of 0.5 is the score of all.  Other columns are not inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, mix, slices, text_column
from .common import small_batches

TAPS, STEP, CHUNK, VECTOR, FILTERS, HIDDEN = 8, 8, 32, 7, 12, 8
HELD_OUT = 5


def echo(data: np.ndarray, offsets: np.ndarray, gram: int = 8, back: int = 96) -> np.ndarray:
    """1 where the next `gram` bytes also began at one of the last `back` positions of the document."""
    n = len(data)
    out = np.zeros(n, np.float32)
    if n <= gram:
        return out
    m = n - gram + 1
    h = np.zeros(m, U64)
    for k in range(8):
        h |= data[k : k + m].astype(U64) << U64(8 * k)
    bits = max(1, int(m).bit_length())
    key = np.sort((mix(h) >> U64(bits) << U64(bits)) | np.arange(m, dtype=U64))
    at = (key & U64((1 << bits) - 1)).astype(np.int64)
    same = (key[1:] >> U64(bits)) == (key[:-1] >> U64(bits))
    near = same & (at[1:] - at[:-1] <= back)
    later = at[1:][near]
    doc = np.searchsorted(offsets, later, "right") - 1
    out[later[at[:-1][near] >= offsets[doc]]] = 1
    return out


def layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts (in filter positions of the padded slice) and chunks before each document.  A document of n bytes has padded room for whole chunks."""
    n = np.diff(offsets)
    half = CHUNK // 2
    positions = np.maximum(-(-np.maximum(n - TAPS, 0) // STEP) + 1, 1)
    chunks = np.maximum(-(-(positions - half) // half), 1)
    return positions, np.r_[0, np.cumsum(chunks)]


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.RandomState(seed)
        inputs = TAPS * (VECTOR + 1)
        self.p = {
            "e": r.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
            "w": r.normal(0, (2 / inputs) ** 0.5, (inputs, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32),
            "c": np.zeros(HIDDEN, np.float32),
            "u": r.normal(0, 0.1, HIDDEN).astype(np.float32),
            "a": np.zeros(1, np.float32),
        }

    def forward(self, data: np.ndarray, offsets: np.ndarray, keep: bool = False):
        """Probability of each document of a slice."""
        p, half = self.p, CHUNK // 2
        positions, before = layout(offsets)
        # each document gets room for its chunks, padded with byte 32
        room = (np.diff(before) + 1) * half * STEP + TAPS
        start = np.r_[0, np.cumsum(room)]
        x = np.full(start[-1], 32, np.uint8)
        rep = np.zeros(start[-1], np.float32)
        to = np.arange(len(data)) + np.repeat(start[:-1] - offsets[:-1], np.diff(offsets))
        x[to], rep[to] = data, echo(data, offsets)
        first = np.concatenate([s + np.arange(c) * half * STEP for s, c in zip(start[:-1], np.diff(before), strict=True)]) if len(before) > 1 else np.zeros(0, np.int64)
        at = (first[:, None] + np.arange(half)[None, :] * STEP).ravel()
        tail = start[1:] - TAPS - half * STEP  # the last half chunk of each document
        tail_at = (tail[:, None] + np.arange(half)[None, :] * STEP).ravel()
        all_at = np.r_[at, tail_at]
        taps = x[all_at[:, None] + np.arange(TAPS)[None, :]]
        z = np.empty((len(all_at), TAPS, VECTOR + 1), np.float32)
        z[:, :, :VECTOR] = p["e"][taps]
        z[:, :, VECTOR] = rep[all_at[:, None] + np.arange(TAPS)[None, :]]
        z = z.reshape(len(all_at), -1)
        y = np.maximum(z @ p["w"] + p["b"], 0)
        halves = y.reshape(-1, half, FILTERS).mean(axis=1)
        n_first = len(first)
        doc_of = np.repeat(np.arange(len(before) - 1), np.diff(before))
        nxt = np.arange(n_first) + 1
        ends = before[1:] - 1
        nxt[ends] = n_first + np.arange(len(ends))
        chunk = (halves[:n_first] + halves[nxt]) / 2
        pooled = np.maximum.reduceat(chunk, before[:-1], axis=0)
        h = np.maximum(pooled @ p["v"] + p["c"], 0)
        s = 1 / (1 + np.exp(-np.clip(h @ p["u"] + p["a"], -30, 30).astype(np.float64)))
        return (s, (taps, z, y, chunk, pooled, h, doc_of, nxt, n_first)) if keep else s

    def gradient(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray):
        p, half = self.p, CHUNK // 2
        s, (taps, z, y, chunk, pooled, h, doc_of, nxt, n_first) = self.forward(data, offsets, True)
        d = ((s - label) * weight / len(label)).astype(np.float32)
        g = {"u": h.T @ d, "a": d.sum(keepdims=True)}
        dh = np.outer(d, p["u"]) * (h > 0)
        g["v"], g["c"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["v"].T
        top = chunk == pooled[doc_of]
        dc = dp[doc_of] * top
        dhalf = np.zeros((len(y) // half, FILTERS), np.float32)
        dhalf[:n_first] += dc / 2
        np.add.at(dhalf, nxt, dc / 2)
        used = np.flatnonzero(np.abs(dhalf).sum(1))
        rows = (used[:, None] * half + np.arange(half)[None, :]).ravel()
        dy = np.repeat(dhalf[used] / half, half, axis=0) * (y[rows] > 0)
        g["w"], g["b"] = z[rows].T @ dy, dy.sum(0)
        dz = (dy @ p["w"].T).reshape(-1, TAPS, VECTOR + 1)[:, :, :VECTOR]
        g["e"] = np.stack([np.bincount(taps[rows].ravel(), dz[:, :, k].ravel(), 256) for k in range(VECTOR)], 1).astype(np.float32)
        return g, s

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 600, batch: int = 16, rate: float = 0.01, seed: int = 3) -> Net:
        r, m, v, t = np.random.RandomState(seed), {}, {}, 0
        epochs = max(4, -(-steps * batch // len(texts)))
        share = np.clip(labels.mean(), 0.02, 0.98)
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            step = rate * (1 if epoch < epochs * 2 // 3 else 0.2)
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                part = [texts[k] for k in pick]
                offsets = np.cumsum([0, *map(len, part)])
                g, _ = self.gradient(np.frombuffer(b"".join(part), np.uint8), offsets, labels[pick], weights[pick])
                t += 1
                for k, x in g.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def bucket(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 5; 0 is held out.  Null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1_000, sample_bytes: int = 4 << 20, seed: int = 5) -> Net:
    """Fit on a bounded sample: the labelled doc_ids with the smallest hashes, of which half may be of either label."""
    ok = labels.where("quality in (0, 1) and doc_id is not null").where(bucket(F.col("doc_id")) != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("_q"))
    halves = [ok.where(F.col("_q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for q in (0, 1)]
    ids = {r.doc_id: r._q for h in halves for r in h.collect()}
    if len(set(ids.values())) < 2:
        net = Net(seed)
        net.p["u"][:] = 0
        return net
    spark = docs.sparkSession
    picked = spark.createDataFrame(list(ids.items()), "doc_id long, _q int")
    size = F.octet_length("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(size <= sample_bytes // 16).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toLocalIterator()
    texts, marks, total = [], [], 0
    for r in rows:
        text = r.text.encode()
        if total + len(text) > sample_bytes:
            break
        total += len(text)
        texts.append(text)
        marks.append(r._q)
    if len(set(marks)) < 2:
        net = Net(seed)
        net.p["u"][:] = 0
        return net
    return Net(seed).fit(texts, np.asarray(marks, np.float64))


def scored(net: Net, batch: pa.RecordBatch, slice_bytes: int = 256 << 10) -> np.ndarray:
    data, offsets = text_column(batch)
    out = [net.forward(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, slice_bytes)]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            s = scored(model.value, b)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score `threshold` or more, all columns as they are."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scored(model.value, b) >= threshold))

    return docs.mapInArrow(run, docs.schema)
