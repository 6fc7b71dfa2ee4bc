import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tabulon.llm import arrays as A
from tabulon.llm import token_output as R
from tabulon.llm.decontam import Items, _search
from tabulon.llm.suffix_dedup import Contexts
from tabulon.llm.tokens import Encoder, careful

from . import helpers as H


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_text_column_and_slices():
    b = pa.record_batch([pa.array(["ab", None, "", "é"])], ["text"]).slice(0, 4)
    data, offsets = A.text_column(b)
    assert data.tobytes() == "abé".encode() and offsets.tolist() == [0, 2, 2, 2, 4]
    data, offsets = A.text_column(b.slice(3, 1))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 2]
    assert list(A.slices(np.array([0, 5, 5, 9, 30]), 9)) == [(0, 3), (3, 4)]
    assert list(A.slices(np.array([0]), 9)) == []


def test_words_stay_in_documents():
    data, offsets = packed(["ab", "cd e", "", " f"])
    start, end, before = A.words(data, offsets, A.NOT_SPACE)
    assert [data[a:z].tobytes() for a, z in zip(start, end, strict=True)] == [b"ab", b"cd", b"e", b"f"] and before.tolist() == [0, 1, 3, 3, 4]


def test_window_min():
    x = np.array([5, 3, 4, 1, 9, 2], np.uint64)
    assert A.window_min(x, 3).tolist() == [3, 1, 1, 1] and A.window_min(x, 9).tolist() == []


LETTERS = ["a", "b", " ", " ", "Z", "9", "'", "!", ".", "\n", "\t", "é", "ñ", "ß", "中", "\x1c", "́", "  ", " s", "'re", "\r", "\x85", "İ", "　", " ", "ſ", "\0", "Σ", "<|endoftext|>", "word"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_pieces_encode_as_whole_texts(name):
    rng, enc = random.Random(3), Encoder(public_tokenizers.path(name), list)
    for _ in range(60):
        texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(40)]
        got = enc.values(enc.split(*packed(texts)))
        assert [[i for p in v for i in p] for v in got] == enc._encode(texts)
        assert all(b"".join(careful(t.encode())) == t.encode() for t in texts)


def test_store_halves(monkeypatch):
    from tabulon.llm import tokens

    monkeypatch.setattr(tokens, "KEEP", 4)
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"), len)
    texts = [f"word{i} common thing" for i in range(12)]
    for t in texts:
        assert sum(enc.values(enc.split(*packed([t])))[0]) == len(enc._encode([t])[0])


def test_repair_round_trip_and_random_access():
    rng = np.random.RandomState(0)
    for _ in range(60):
        n = rng.randint(1, 120, rng.randint(1, 12))
        ids = rng.randint(0, rng.randint(2, 30), n.sum()).astype(np.uint32)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(n) - 1] = True
        symbols, rules, ends = R.repair(ids, last, 1000, rounds=5, least=2)
        assert (R.expand(symbols, rules, 1000) == ids).all() and ends.sum() == len(n)
        lengths = R.lengths_of(rules, 1000)
        assert all(len(R.expand(np.array([1000 + k], np.uint32), rules, 1000)) == lengths[k] for k in range(len(rules)))
        shard = {"symbols_before": np.r_[0, np.flatnonzero(ends) + 1].astype("<i8").tobytes(), "base": 1000, "rules": rules.tobytes(), "lengths": lengths.tobytes(), "symbols": symbols.tobytes()}
        d, o = rng.randint(len(n)), np.r_[0, np.cumsum(n)]
        a = rng.randint(0, n[d])
        z = rng.randint(a, n[d] + 1)
        assert (R.decode(shard, d, a, z) == ids[o[d] : o[d + 1]][a:z]).all() and (R.decode(shard, d) == ids[o[d] : o[d + 1]]).all()


def test_repair_goes_on_until_no_pair_is_left():
    """With production values: a long passage that occurs in a few documents becomes a few symbols."""
    rng = np.random.RandomState(1)
    passage = rng.randint(0, 40_000, 3_000).astype(np.uint32)
    docs = [np.r_[rng.randint(0, 40_000, 50).astype(np.uint32), passage, rng.randint(0, 40_000, 50).astype(np.uint32)] for _ in range(3)]
    docs += [np.full(1_000, 7, np.uint32), np.array([1], np.uint32)]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbols, rules, last = R.repair(ids, last, 1 << 20)
    pairs = ((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:])[~last[:-1]]
    assert np.unique(pairs, return_counts=True)[1].max() == 1
    assert R.lengths_of(rules, 1 << 20).max() > 16 and (R.expand(symbols, rules, 1 << 20) == ids).all() and len(symbols) < 600


class Held:
    def __init__(self, value):
        self.value = value


def test_suffix_array_search_against_brute_force():
    rng = random.Random(1)
    for _ in range(120):
        letters = ["a", "b", "C", "é", "d9", "Ff"][: rng.randint(1, 6)]
        make = lambda m: rng.choice([" ", ". ", "\n"]).join(rng.choice(letters) for _ in range(rng.randint(0, m)))  # noqa: B023, E731
        docs, items = [make(60) for _ in range(rng.randint(1, 8))], [(str(i), make(40)) for i in range(rng.randint(0, 6))]
        window, half = rng.choice([2, 3, 5, 10]), len(items) // 2
        parts = [Held(Items([(n, t.encode()) for n, t in x], window)) for x in (items[:half], items[half:]) if x]
        n_words, n_hit, names, _ = _search(parts, *packed(docs))
        assert [(int(n_words[k]), int(n_hit[k]), sorted(names.get(k, ()))) for k in range(len(docs))] == H.contamination(docs, items, window)


def test_contexts_against_brute_force():
    from collections import Counter

    rng = random.Random(3)
    for k in range(100):
        n, letters = rng.choice([8, 12, 20]), b"ab" if k % 2 else b"abcdefg"
        base = bytes(rng.choice(letters) for _ in range(60))
        texts = []
        for _ in range(rng.randint(1, 12)):
            at = rng.randint(0, 59)
            texts.append((base[at:] + bytes(rng.choice(letters + b"\xf0\x00") for _ in range(60)))[: rng.randint(n, n + 25)])
        own = np.array([len(t) - n + 1 for t in texts])
        seen = Counter(t[p : p + n] for t, o in zip(texts, own, strict=True) for p in range(o))
        assert Contexts(texts, own, n).repeats.tolist() == [seen[t[p : p + n]] > 1 for t, o in zip(texts, own, strict=True) for p in range(o)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_each_distinct_piece_of_a_slice_is_looked_up_once(name):
    texts = ["", "the cat and The cat\tand\x0bthe cat", " ", "x", "café café 中文 İx\r\n the", "<|endoftext|> the", "\0 a\0", "it's 1999"] * 3
    enc = Encoder(public_tokenizers.path(name), R.ids_bytes)
    asked, look_up = [], enc.look_up
    enc.look_up = lambda keys: asked.extend(keys) or look_up(keys)
    ids, n = enc.coded(*packed(texts), 1)
    want = [[*enc.model.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(asked) == len(set(asked))
    ids, n = enc.coded(*packed([]), 1)
    assert len(ids) == len(n) == 0


def test_repair_of_symbols_too_wide_to_be_packed():
    rng = np.random.RandomState(8)
    ids = np.tile(rng.randint(0, 5, 400), 3).astype(np.uint32)
    last = rng.rand(len(ids)) < 0.02
    last[-1] = True
    got = [R.repair(ids, last, base) for base in (1 << 20, 1 << 30)]
    lower = lambda x, base: np.where(x >= base, x - base + 5, x).tolist()
    assert [lower(x, 1 << 20) for x in got[0][:2]] == [lower(x, 1 << 30) for x in got[1][:2]] and (got[0][2] == got[1][2]).all()
    assert all((R.expand(s, rules, base) == ids).all() for (s, rules, _), base in zip(got, (1 << 20, 1 << 30), strict=True))


def test_plain_pieces_are_looked_up_by_pre_tokens():
    """The same words beside other signs and in other case are nothing new."""
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"), R.ids_bytes)
    asked, look_up = [], enc.look_up
    enc.look_up = lambda keys: asked.extend(keys) or look_up(keys)
    texts = ["It's the cat, the Cat! (THE CAT) 'cat'", "cat's-cat\tcat?! café", "<|endoftext|>cat"]
    ids, n = enc.coded(*packed(texts), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*enc.model.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert sorted(asked) == [b"<|endoftext|>cat", "café".encode()]
    assert set(enc.plain) == {b"it", b"'s", b"the", b"cat", b",", b"!", b"(", b")", b"'", b"-", b"?!"}


def test_pre_tokens_are_those_of_the_library():
    rng = random.Random(12)
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"), R.ids_bytes)
    bits = ["'", "'s", "'S", "'re", "'VE", "'ll", "'d", "''", "s", "re", "a", "Word", "12", "_", "?!", '"', " ", "  ", "\n", "\t"]
    odd = ["\x0b", "\x1c", "\0", "\x7f", " ", "é", "中", "İ", "'ſ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "٣"]
    for k in range(300):
        texts = ["".join(rng.choice(bits + odd * (k % 2)) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        ids, n = enc.coded(*packed(texts), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*enc.model.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_pieces_that_are_all_in_the_older_half(monkeypatch):
    monkeypatch.setattr("tabulon.llm.tokens.KEEP", 2)
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"), R.ids_bytes)
    first = "café naïve déjà the cat"
    want = [*enc.model.encode(first, add_special_tokens=False).ids, 1]
    for _ in range(3):
        ids, n = enc.coded(*packed([first]), 1)
        assert ids.tolist() == want and n.tolist() == [len(want)]
    pieces = enc.split(*packed([first]))
    for _ in range(3):
        assert b"".join(enc.values(pieces)[0]) == R.ids_bytes(want[:-1])
