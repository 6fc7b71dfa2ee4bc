"""Each operator on odd rows and against a brute-force version."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabulon.llm import components, decontam, jaccard_join, licenses, media, mixing, pii, quality, queries, suffix_dedup, token_counts, token_output
from tabulon.llm.common import numbered
from tabulon.llm.sides import by_part

from . import helpers as H


@pytest.fixture(scope="module")
def odd(spark):
    return H.odd_documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return H.stored(spark, [], H.SCHEMA, 1)


def by_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_decontamination(spark, odd, none):
    items = [(1, "the same words again and again in two rows of this table"), (2, "one"), (3, None), (None, "W5X w6x"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = H.contamination([t for _, t, _ in H.ODD], [("" if k is None else str(k), t) for k, t in items], 10)
    got = by_rows(decontam.annotate(odd, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((k, w, h, len(n), hashlib.sha256(",".join(n).encode()).hexdigest(), h > 0) for (k, _, _), (w, h, n) in zip(H.ODD, want, strict=True)), key=repr)
    small = by_rows(decontam.annotate(odd, bench, block_bytes=10), "doc_id", "n_hit", "items_sha256")
    assert small == [(r[0], r[2], r[4]) for r in got]
    kept = decontam.remove(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(h == 0 for _, h, _ in want)
    assert decontam.annotate(none, bench).count() == 0
    assert by_rows(decontam.annotate(odd, bench.where("false")), "n_hit") == [(0,)] * len(H.ODD)
    longest = {r.item_id: (r.n_words, r.doc_id, r.word) for r in decontam.longest_matches(odd, bench).collect()}
    assert longest["1"][0] == 12 and longest["1"][1:] == (6, 0) and longest["2"] == (1, 4, 0) and longest[""][0] == 2


PERSONAL = ["a@b", "a@b.c@d.e x", "a@b.c.@x.y", "..a..@b..c", "a.b@c.d.", "x1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.00.1", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111", "79927398713 4532015112830366", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+1 (555) 010-2030 +1", "+12--- 34567890", "é中 a@b.cc 😀 +49 30 1234567 10.0.0.1", "a@bc", None, "", "1.2.3", "5555555555554444 378282246310005 6011111111111117"]


def test_personal_base_spans(spark):
    rng = random.Random(5)
    letters = list("a1.@+-() 4\n%é") + ["10.0.0.1", "a@b.c", "+1555", "4111111111111111", "..", "@", " "]
    texts = PERSONAL + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["1 " * 20_000, "a." * 20_000 + "@x.y", "9" * 50_000, "a@" + "b." * 20_000 + "c", "+1" * 5_000, " ".join(f"u{i}@h.org" for i in range(1_500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], H.personal(t)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == want[:4], t
        assert r.base_sha256 == hashlib.sha256(want[4].encode()).hexdigest(), t
        assert set(filter(None, want[4].split(","))) <= set(filter(None, r.spans.split(","))), t


def test_personal_method_adds_spans(spark, odd, none):
    rows = [(i, f"call me by phone: (212) 555-{1000 + i} today, not item 123-456-{i:04d}; card 4111.1111.1111.1111, mail joe [at] example [dot] com or x{i}@mail.com") for i in range(20)]
    r = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 3").first()
    added = [x for x in r.found if not x.base]
    assert any(x.kind == "phone" for x in added) and r.n_phone == 0 and r.n_email == 1
    assert r.spans.split(",") == [f"{x.kind}:{x.start}:{x.end}" for x in r.found]
    assert pii.detect(odd).count() == len(H.ODD) and pii.detect(none).count() == 0


def test_personal_secrets(spark):
    key = "4dbebab91ab85687d33eeaaf9ac699e1188f9620"
    texts = [
        f'Thstorti token = "{key}" thhantou',
        f"TOKEN={key.upper()}",
        f"é api_key: AKIA{key[:16].upper()}; password = {key[:18]}",
        f"the commit {key} of a file",
        f"mail a@b.cc, secret {key}, token {'x' * 30} token {'9' * 30}",
        "token " + "a1" * 200,
        "token",
        "",
        None,
    ]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    secrets = lambda k: [texts[k][x.start : x.end] for x in got[k].found if x.kind == "secret"]
    assert [secrets(k) for k in range(9)] == [[key], [key.upper()], [f"AKIA{key[:16].upper()}"], [], [key], [], [], [], []]
    assert [got[k].n_secret for k in range(9)] == [1, 1, 1, 0, 1, 0, 0, 0, 0]
    assert got[4].spans.startswith("email:5:11,secret:") and got[4].n_added == 1 and got[4].private
    assert not got[3].private and not got[8].private


def test_estimation_trusts_agreeing_labelers():
    counts = {"phone|1|1|1|2": 80, "phone|1|1|0|2": 40, "phone|-1|-1|-1|2": 60, "phone|-1|1|0|2": 5, "phone|1|-1|0|2": 3}
    posterior, models = pii.estimate(counts)
    assert posterior["phone|1|1|1|2"] > 0.9 and posterior["phone|-1|-1|-1|2"] < 0.1 and models["phone"]["reliability"]["shape"] > 0.8
    p = pii.train(counts, posterior)
    assert p["phone|1|1|1|2"] > 0.5 > p["phone|-1|-1|-1|2"]
    assert pii.estimate({}) == ({}, {}) and pii.train({}, {}) == {}


def test_media_round_trip(spark, odd, none):
    rows = media.pack(odd)
    got = {}
    for r in media.read_back(rows).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t, _ in H.ODD:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        for r in got[k]:
            if r.n_bytes == len(raw):
                assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-576:]))
    assert len({(r.media_sha256, r.feature) for r in got[7] + got[6]}) == 1
    meta = media.metadata(rows).where("doc_id = 9").first()
    assert (meta.width, meta.height, meta.depth) == (576, 6, 8)
    assert media.read_back(media.pack(none)).count() == 0
    import tarfile

    r = rows.where("doc_id = 8").first()
    with tarfile.open(r.shard.removeprefix("file://")) as t:
        m = t.getmember(r.digest)
        assert (m.offset_data, m.size) == (r.offset, r.length) and hashlib.sha256(media.decode(t.extractfile(m).read())).hexdigest() == r.digest


def test_media_columns_come_from_headers(spark, odd, monkeypatch):
    """The query's size columns are those of the header-only reads: no other code may parse a header in it."""
    filled = []
    whole = media.metadata
    monkeypatch.setattr(media, "metadata", lambda rows: filled.append(1) or whole(rows).withColumn("width", F.lit(7).cast("long")))
    monkeypatch.setattr(queries, "documents", lambda spark, sf_dir: odd)
    got = queries.op3_media_columns(spark, "").collect()
    assert filled == [1] and len(got) == len(H.ODD) and all(r.feature.startswith("7x") for r in got)


def test_media_query_keeps_its_contract(spark, monkeypatch):
    """The exact columns by brute force, the checksum of the payload's last 32 bytes, on texts that end near the padding's edges."""
    texts = [None, "", "x", "é" * 288, "中\x00🙂 end", *(("0123456789" * 130)[:n] for n in (543, 544, 545, 575, 576, 577, 1151, 1152, 1153))]
    monkeypatch.setattr(queries, "documents", lambda spark, sf_dir: H.stored(spark, [(k, t, "s") for k, t in enumerate(texts)]))
    got = {r.doc_id: r for r in queries.op3_media_columns(spark, "").collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def near_rows(rng, groups, size, words, edits, common):
    rows, k = [], 0
    for _ in range(groups):
        base = [f"{rng.randint(0, 10**6)}" for _ in range(words)]
        for _ in range(size):
            w = base[:]
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            if rng.random() < 0.7:
                at = rng.randrange(len(w))
                w[at:at] = common
            rows.append((k, " ".join(w), "s"))
            k += 1
    return rows


@pytest.mark.parametrize("hot", [64, 3])
def test_jaccard_join(spark, odd, hot):
    """With a low limit of hot keys, most links go the way of hot groups."""
    rng = random.Random(hot)
    common = [f"c{i}" for i in range(40)]
    rows = near_rows(rng, 6, 12, 130, 12, common) + near_rows(rng, 12, 3, 30, 3, common[:12]) + near_rows(rng, 30, 1, 60, 0, common)
    rows += [(0, "", "s"), (0, "a b", "s"), (0, "a b", "s"), (0, "A b", "s"), (0, None, "s"), (0, "a b c d e f", "s"), (0, "a b c d e f g", "s"), (0, "a b c d e", "s")]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    rng.shuffle(rows)
    df = H.stored(spark, rows)
    got = by_rows(jaccard_join.join(df, hot=hot, keys_per_bucket=500), "doc_id", "n_shingles", "component_id")
    assert got == sorted(H.near([r[0] for r in rows], [r[1] for r in rows]), key=repr)
    if hot == 64:
        kept = jaccard_join.keep_one(df)
        empty = {r[0] for r in rows if not H.shingle_set(r[1])}
        assert {r.doc_id for r in kept.collect()} == {c for _, _, c in got} | empty
        out = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join(odd).collect()}
        assert out[7, 9] == 6 and out[6, 9] == 6 and out[1, 0] == 1 and out[3, 0] == 3
        one = jaccard_join.keep_one(odd)
        assert one.columns == odd.columns and one.where("doc_id in (6, 7)").count() == 1 and one.count() == len(H.ODD) - 2


def test_jaccard_weak_sets_are_compared_with_all(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(near_rows(rng, 3, 4, 100, 5, ["z"] * 3))]
    monkeypatch.setattr(jaccard_join, "may_differ", lambda a, b: (a + b) * 25 // 175)
    df = H.stored(spark, rows).withColumn("uid", F.monotonically_increasing_id())
    found = jaccard_join._weak_links(df, df.select("uid"), block_bytes=2_000)
    linked = {(r.a, r.b) for r in found.collect()}
    sets = {jaccard_join.node_of(s): s for s in jaccard_join.shingle_sets(*_packed([t for _, t, _ in rows]))}
    assert linked == {(a, b) for a in sets for b in sets if a < b and jaccard_join.links(sets[a], sets[b])} and linked


def test_jaccard_join_names_weak_sets_as_the_others(spark, monkeypatch):
    rng, whole = random.Random(10), jaccard_join._sets
    rows = [(i, t, s) for i, (_, t, s) in enumerate(near_rows(rng, 4, 4, 100, 5, ["z"] * 3))]
    monkeypatch.setattr(jaccard_join, "_sets", lambda docs: whole(docs).withColumn("filled", F.lit(0).cast("long")))
    got = by_rows(jaccard_join.join(H.stored(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(H.near([r[0] for r in rows], [r[1] for r in rows]), key=repr)


def test_segments_take_few_bytes_in_many_buckets(spark):
    """With few keys of a set in a bucket, what names the set must not outweigh the keys."""
    rng, buckets = random.Random(11), 200
    texts = [" ".join(str(rng.randint(0, 10**9)) for _ in range(n)) for n in (300,) * 38 + (8, 400)]
    docs = numbered(H.stored(spark, [(i, t, "s") for i, t in enumerate(texts)], parts=1), "text").select("uid", "text").cache()
    packed = [r.asDict() for r in jaccard_join._segments(docs, by_part(docs.select("uid"), "few"), buckets).collect()]
    want, keys = set(), 0
    for uid, text in docs.collect():
        (s,) = jaccard_join.shingle_sets(*_packed([text]))
        for band in jaccard_join.bands_of(len(s)):
            for k in jaccard_join.segments(s, band).tolist():
                want.add((k % buckets, k // buckets & (1 << 40) - 1, uid, len(s), band == len(s).bit_length() - 1))
                keys += 1
    assert want == {(r["bucket"], *x) for r in packed for x in zip(*(c.tolist() for c in jaccard_join._unpack(r)), strict=True)}
    size = sum(len(x) if isinstance(x, bytes | bytearray) else 8 for r in packed for x in r.values())
    assert size < 12 * keys


def _packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_slices_of_few_words(spark):
    for n in range(6):
        for texts in (["a b c d e f"[: 2 * n]], ["", *"abcdef"[:n], ""]):
            got = jaccard_join.shingle_sets(*_packed(texts))
            assert [len(s) for s in got] == [len(H.shingle_set(t)) for t in texts]
    joined = jaccard_join.join(H.stored(spark, [(1, "a b", "s"), (2, "A  b", "s")], parts=1))
    assert by_rows(joined, "doc_id", "n_shingles", "component_id") == [(1, 1, 1), (2, 1, 1)]
    assert jaccard_join.keep_one(H.stored(spark, [(1, "a b", "s")], parts=1)).count() == 1


def test_sketches_bound_the_difference():
    rng = np.random.RandomState(2)
    for _ in range(200):
        pool = rng.randint(0, 2**62, 400).astype(np.uint64)
        a, b = np.unique(pool[: rng.randint(1, 300)]), np.unique(pool[rng.randint(0, 200) :])
        assert jaccard_join.distance(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(np.setxor1d(a, b))
        assert jaccard_join.distance(jaccard_join.sketch(a), jaccard_join.sketch(a)) == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {n: find(n) for n in up}


@pytest.mark.parametrize("contexts", [4_000, 3])
def test_suffix_dedup(spark, odd, contexts):
    """With a low limit of contexts, grams are split over shards and merged by binary search."""
    rng = random.Random(contexts)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(30, 90))) for _ in range(6)]
    texts = []
    for _ in range(80):
        texts.append("".join(rng.choice([*passages, "".join(rng.choice("xyzé ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 5))))
    texts += ["ab" * 100, "q" * 90, texts[3], texts[3], None, ""]
    once = lambda: "".join(rng.choice("ijklmnop") for _ in range(50))
    texts += [once() + passages[0][:30] + once() + "rstuv" * 6 + once(), once() + "rstuv" * 6]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = by_rows(suffix_dedup.dedup(H.stored(spark, rows), length=40, report=26, shard_contexts=contexts, shard_bytes=5_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
    short = H.repeats(texts, 26)
    assert got == sorted(((i, *w, short[i][1]) for i, w in enumerate(H.repeats(texts, 40))), key=repr)
    assert any(r[2] < r[5] for r in got)
    if contexts == 3:
        assert suffix_dedup.dedup(H.stored(spark, [], H.SCHEMA, 1)).count() == 0
        want = H.repeats([t for _, t, _ in H.ODD], 400)
        assert by_rows(suffix_dedup.dedup(odd), "doc_id", "n_removed", "kept_sha256") == sorted(((k, w[1], w[3]) for (k, _, _), w in zip(H.ODD, want, strict=True)), key=repr)


def test_key_ranges_grow_with_the_contexts_of_a_gram(spark):
    """A gram of 64 kinds of contexts in 32 shards: its keys are merged in more than 16 ranges, with the right result."""
    rng = random.Random(2)
    common = "".join(rng.choice("abcdefgh") for _ in range(50))
    texts = ["".join(rng.choice("uvwxyz") for _ in range(60)) + common + "".join(rng.choice("uvwxyz") for _ in range(60)) for _ in range(64)]
    df = H.stored(spark, [(i, t, "s") for i, t in enumerate(texts)])
    seen = []
    merged = suffix_dedup._merged
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_dedup, "_merged", lambda found, n: seen.append(found) or merged(found, n))
        got = by_rows(suffix_dedup.dedup(df, length=40, shard_contexts=2), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *w) for i, w in enumerate(H.repeats(texts, 40))), key=repr)
    assert seen[0].where("kind in (1, 3)").agg(F.max("range")).first()[0] >= 16


def test_token_counts(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted(((k, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x, _ in H.ODD), key=repr)
    for frequent in (1_000, 0):
        got = token_counts.token_counts(odd, path, frequent=frequent)
        assert by_rows(got, "doc_id", "n_bytes", "n_tokens") == want
        assert got.where("over_limit != (n_tokens > 512)").count() == 0
    assert token_counts.token_counts(none, path).count() == 0


def test_token_output(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(token_output.token_output(odd, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([k for k, _, _ in H.ODD], key=lambda k: (k is not None, k))
    ids = {}
    for k, x, _ in H.ODD:
        ids.setdefault(k, []).append(np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))
    at = 0
    for r in got:
        assert r.start == at
        match = [x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(x.tobytes()) == r.ids_crc32]
        assert match
        at += r.n_tokens
    assert token_output.token_output(none, path).count() == 0


def test_targets_and_mix(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), s) for i, s in enumerate(["a"] * 5 + ["b"] * 40 + ["c"] * 60 + [None] * 7 + ["z"] * 2)]
    df = H.stored(spark, rows)
    got = mixing.mix(df, rows_per_bucket=5).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = 3 * size[s]
            free.remove(s)
    source = {k: s for k, _, s in rows}
    taken = {}
    for r in got:
        assert r.source_size == size[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert got == mixing.mix(df, rows_per_bucket=50).collect()
    copies = {r.doc_id: r.copies for r in got}
    out = mixing.mixed(df)
    assert out.columns == df.columns and {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: c for k, c in copies.items() if c}
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() == len(H.ODD) and mixing.mixed(odd).columns == odd.columns


def test_curriculum_inverts_the_integral(spark):
    for knots in mixing.SCHEDULES:
        u = [k / 50 for k in range(51)]
        got = [r.t for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.inverse(F.col("u"), knots).alias("t")).collect()]
        whole = np.trapezoid([w for _, w in knots], [t for t, _ in knots])
        for x, t in zip(u, got, strict=True):
            grid = np.linspace(0, t, 2001)
            assert abs(np.trapezoid(np.interp(grid, *zip(*knots, strict=True)), grid) / whole - x) < 1e-5


def test_quality(spark, odd, none):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "under", "walked", "the", "a"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["###", "$$$", "%%%"]) + str(rng.randint(0, 9)) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), "s") for i in range(300)]
    df = H.stored(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(df, labels)
    got = quality.score(df, net).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(df, net)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(odd, net).count() == len(H.ODD) and quality.score(none, net).count() == 0
    assert {r.score for r in quality.score(odd, quality.fit(none, labels)).collect()} == {0.5}


def test_quality_gradient():
    net, texts = quality.Net(1), [b"hello world " * 20, b"x", b"### $$$ " * 30]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    label, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    loss = lambda: float(-np.mean(np.log(np.where(label == 1, s := net.forward(data, offsets), 1 - s))))  # noqa: E731, F841
    g, _ = net.gradient(data, offsets, label, weight)
    for name, at in (("u", (0,)), ("a", (0,)), ("v", (1, 2)), ("c", (3,)), ("b", (4,))):
        keep = net.p[name][at]
        found = []
        for d in (1e-2, -1e-2):
            net.p[name][at] = keep + d
            found.append(loss())
        net.p[name][at] = keep
        assert abs((found[0] - found[1]) / 2e-2 - g[name][at]) < 2e-3, name
    assert abs(net.forward(data, offsets)[1] - net.forward(np.frombuffer(b"x", np.uint8), np.array([0, 1]))[0]) < 1e-6


def test_licenses(spark, odd, none):
    rows = [(1, "intro\nReleased under the MIT License\nmore", "s"), (2, "Licensed under the Apache License, Version 2.0. It says so here today", "s"), (3, "nothing", "s"), (4, licenses.TEMPLATES["gpl-3.0-header"].replace(",", "\n"), "s"), (5, None, "s")]
    got = {r.doc_id: r for r in licenses.scan(H.stored(spark, rows)).collect()}
    assert got[1].licenses == "mit" and got[1].best_dice == 1.0 and got[3].licenses == "" and got[5].best_license is None and got[4].best_license == "gpl-3.0-header"
    m = max(got[1].matches, key=lambda m: m.dice)
    assert rows[0][1].encode()[m.start : m.end] == b"Released under the MIT License"
    assert got[2].licenses == ""  # 2 * 6 / (6 + 11) is below the threshold
    found = {r.doc_id: r.licenses for r in licenses.scan(odd).collect()}
    assert found[10] == "all-rights-reserved,apache-2.0" and licenses.scan(none).count() == 0


def test_license_windows(spark, odd, none):
    mpl = "This Source Code Form is subject to the\nterms of the Mozilla Public License, v. 2.0."
    apache = licenses.TEMPLATES["apache-2.0-header"].replace("; ", ";\n#\n# ").replace(". ", ".\n#\n# ")
    rows = [
        (1, "This project is released under the MIT License.", "mit"),
        (2, "Copyright 2020 The Foo Authors. Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        (3, "code();\r\n\r\n" + mpl.replace("\n", "\r\n") + "\r\n\r\nmore();", "mpl-2.0"),
        (4, f"#!/bin/sh\n# {apache}\n#\necho of the License", "apache-2.0,apache-2.0-header"),
        (5, "licensed rights and reserved works of the public domain under a version of the license", ""),
        (6, "x Released under the MIT License, y. " * 3, "mit"),
        (7, "w " * 5000 + "All rights reserved. " * 500, "all-rights-reserved"),
        (8, "released under", ""),
        (9, "the MIT License", ""),
    ]
    df = H.stored(spark, rows)
    got = {r.doc_id: r for r in licenses.scan(df, windows=True).collect()}
    assert {k: r.licenses for k, r in got.items()} == {k: w for k, _, w in rows}
    assert [rows[5][1].encode()[m.start : m.end] for m in got[6].matches] == [b"Released under the MIT License"] * 3
    assert got[7].n_matches == 500 and {m.dice for m in got[7].matches} == {1.0} and got[1].best_dice == 1.0
    assert licenses.scan(none, windows=True).count() == 0 and licenses.scan(odd, windows=True).count() == len(H.ODD)


def test_license_windows_are_the_best():
    """No window of any document has a higher Dice than the best that is found, and matches do not overlap."""
    rng = random.Random(3)
    for _ in range(150):
        body = [rng.choice("abcdef") for _ in range(rng.randint(2, 8))]
        w = [rng.choice("abcdefxy") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = body
        want, n = 0.0, {(x, y) for x, y in zip(body, body[1:], strict=False)}
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + int((len(body) - 1) * 1.5) + 1)):
                mine = {(x, y) for x, y in zip(w[i:j], w[i + 1 : j + 1], strict=True)}
                want = max(want, 2 * len(mine & n) / (len(mine) + len(n)))
        data, offsets = _packed([" ".join(w), "a b"])
        found = [m for m in licenses._scan(licenses.Templates({"t": " ".join(body)}), data, offsets, 0.8, windows=True) if m[0] == 0]
        if want >= 0.8:
            assert abs(max(m[2] for m in found) - want) < 1e-9, (body, w)
            spans = sorted(m[3:] for m in found)
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_whole_licenses(spark):
    """LICENSE files of released packages, and whole texts in comments, CRLF and edited."""
    real = sorted((Path(__file__).parent / "license_files").iterdir())
    rows = [(f"{f.name}-text", f.read_text()) for f in real]
    rows += [(k, "".join(f"// {x}\r\n" for x in licenses.WHOLE[k].split("\n"))) for k in ("gpl-3.0-text", "mpl-2.0-text", "lgpl-2.1-text")]
    rows += [("gpl-2.0-text", "import x\n" * 500 + licenses.WHOLE["gpl-2.0-text"].replace("Program", "Library") + "def f(): pass\n" * 500)]
    rows += [("mit-grant", "/* " + " ".join(licenses.WHOLE["mit-grant"].split()) + " */ x = 1")]
    got = {r.doc_id: r for r in licenses.scan(H.stored(spark, [(i, t, "s") for i, (_, t) in enumerate(rows)]), windows=True).collect()}
    assert len(real) == 4
    for i, (name, _) in enumerate(rows):
        assert name in got[i].licenses.split(","), name
        assert got[i].best_license.startswith(name.rsplit("-", 1)[0]), name
    plain = licenses.scan(H.stored(spark, [(1, licenses.WHOLE["mit-grant"], "s")])).first()
    assert plain.licenses == "mit-grant" and plain.best_dice == 1.0
