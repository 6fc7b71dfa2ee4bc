"""Rows are told apart however files are dealt to tasks, and words that defeat hashes modulo a power of two stay apart."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from tabulon.llm import arrays, common, components, jaccard_join, suffix_dedup, tokens
from tabulon.llm.decontam import Items, _search

from . import helpers as H
from .test_arrays_tokens import Held, packed
from .test_operators import by_rows, near_rows


def thue_morse(letters):
    word = "0"
    for _ in range(10):
        word += word.translate({48: 49, 49: 48})
    return word.translate({48: letters[0], 49: letters[1]})


def test_thue_morse_words_stay_apart():
    a, b = thue_morse("ab"), thue_morse("ba")
    assert len(a) == 1024 and a != b
    _, n_hit, names, _ = _search([Held(Items([("x", a.encode())], 10))], *packed([b, a]))
    assert n_hit.tolist() == [0, 1] and names == {1: {"x"}}
    first, second = jaccard_join.shingle_sets(*packed([" ".join([a] * 5), " ".join([b] * 5)]))
    assert not jaccard_join.links(first, second)


def test_window_hashes_are_range_hashes():
    data = np.random.RandomState(3).randint(0, 256, 100_000).astype(np.uint8)
    c = arrays.prefix_hash(data)
    at = np.arange(len(data) - 199)
    assert (arrays.window_hash(c, 200) == arrays.range_hash(c, at, at + 200)).all()
    again = arrays.prefix_hash(np.r_[data[50_000:], data[:50_000]])
    assert (arrays.range_hash(again, at[:1_000] + 50_000, at[:1_000] + 50_200) == arrays.range_hash(c, at[:1_000], at[:1_000] + 200)).all()


def test_long_items_take_little_room():
    words = [f"w{i}" for i in range(20_000)]
    items = Items([("long", " ".join(words).encode())], 10)
    assert sum(x.nbytes for x in vars(items).values() if isinstance(x, np.ndarray)) < 4 << 20
    n_words, n_hit, _, longest = _search([Held(items)], *packed([" ".join(["x", *words[500:19_000], "y"]), "w1 w3"]))
    assert n_words.tolist() == [18_502, 2] and n_hit.tolist() == [18_500, 0] and longest.tolist() == [18_500, 1]


@pytest.fixture
def dealing(spark):
    """Deals files anew at each call."""
    before, rng = spark.conf.get("spark.sql.files.maxPartitionBytes"), random.Random(4)
    yield lambda: spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.randint(3_000, 40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_identity_of_rows(spark, dealing):
    df = H.stored(spark, [(i, f"text {i}", "s") for i in range(500)], parts=7)
    rows = common.numbered(df, "doc_id")
    first = {r.uid: r.doc_id for r in rows.collect()}
    dealing()
    assert len(first) == 500 and {r.uid: r.doc_id for r in rows.collect()} == first
    twice = common.numbered(common.scanned(df.union(df)), "doc_id").collect()
    assert len({r.uid for r in twice}) == 1_000


def test_join_while_files_are_dealt_anew(spark, dealing, monkeypatch):
    rng = random.Random(11)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(near_rows(rng, 8, 6, 60, 6, ["c"] * 12))]
    rng.shuffle(rows)
    whole = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda *a: (dealing(), whole(*a))[1])
    got = by_rows(jaccard_join.join(H.stored(spark, rows, parts=5)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(H.near([r[0] for r in rows], [r[1] for r in rows]), key=repr)


def test_dedup_while_files_are_dealt_anew(spark, dealing, monkeypatch):
    rng = random.Random(12)
    passages = ["".join(rng.choice("abcdefgh") for _ in range(70)) for _ in range(4)]
    texts = ["".join(rng.choice([*passages, "".join(rng.choice("xyz") for _ in range(40))]) for _ in range(4)) for _ in range(60)]
    whole = suffix_dedup._shard_rows
    monkeypatch.setattr(suffix_dedup, "_shard_rows", lambda *a: (dealing(), whole(*a))[1])
    got = by_rows(suffix_dedup.dedup(H.stored(spark, [(i, t, "s") for i, t in enumerate(texts)], parts=5), length=40), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *w) for i, w in enumerate(H.repeats(texts, 40))), key=repr)


def test_idle_encoders_are_given_back():
    enc = tokens.worker_encoder(public_tokenizers.path("word_bpe_49k.json"), tokens.ids_bytes)
    assert enc.values([[b"some", b"words"]]) and tokens._encoders
    arrays.release()
    assert not tokens._encoders


def test_heaps_are_given_back_between_steps(spark, monkeypatch):
    done = []

    def noted(module, name):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **b: (done.append(name), f(*a, **b))[1])

    for name in ("_groups", "_verified", "_hot_links"):
        noted(jaccard_join, name)
    noted(jaccard_join, "rest")
    noted(components, "_star")
    monkeypatch.setattr(components, "rest", lambda spark: done.append("rest"), raising=False)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(near_rows(random.Random(9), 4, 6, 100, 6, ["z"] * 3))]
    jaccard_join.join(H.stored(spark, rows), hot=3).collect()
    steps = [k for k in done if k != "_star"]
    assert {"_groups", "_verified", "_hot_links"} < set(steps)
    assert all("rest" in pair for pair in itertools.pairwise(steps))
    rounds = "".join("s" if k == "_star" else " " for k in done).split()
    assert max(map(len, rounds)) <= 2 * components.REST
