"""Encoding of whole texts by cached pieces, for token counts and token-id output.

Most texts can be cut where the tokenizer surely starts a new pre-token, so that
the pieces encode independently and a worker encodes each distinct piece once:

* ``spaced`` (byte-level BPE): before each single space that follows a printable
  ASCII character or a two-byte letter U+00C0..U+00FF and precedes no white
  space.  A text with any other space is cut more carefully, by ``careful``.
* ``words`` (white space is dropped): at ASCII white space; where ids alone are wanted, pieces of printable
  ASCII further into their lower-case pre-tokens, of which there are far fewer.
* ``whole`` (any other tokenizer): not at all.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .arrays import LOWER, NOT_SPACE, stores, words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CAREFUL = re.compile(rb"(?:[^ \t\n]|(?<![!-~])(?<!\xc3[\x80-\xbf])[ \t\n])+|[ \t\n](?:[^ \t\n]|(?<![!-~])(?<!\xc3[\x80-\xbf])[ \t\n])*")
#: Fixed value: the pre-token pattern of word-end vocabularies, as their files state it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over printable ASCII and the letters U+00C0..U+00FF, where normalising is lower case alone.
_SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SIMPLE_LINES = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SIMPLE_WORDS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: How byte-level tokenizers write the bytes of such letters, as a decoding table; line ends stay, other bytes have no place.
_AS_BYTES = "".join(chr(b) if b == 10 or 33 <= b <= 126 or 0xA1 <= b != 0xAD else chr(0x143) if b == 0xAD else chr(0x100 + 33 + b - 0x7F) if b > 126 else "\ufffe" for b in range(256))
#: Pieces longer than this are encoded anew each time.
KEEP_BYTES = 48
#: Pieces that a worker keeps.  The store has two halves; a full one becomes the older, and what is found there moves on.
KEEP = 1_000_000
#: Pre-tokens whose ids a worker keeps, for the same word before other punctuation or in other case.
WORDS = 150_000
#: Missing pieces that are encoded as one text.
JOIN = 2_048


def careful(text: bytes) -> list[bytes]:
    """Cut before a space, tab or line end after a character that is surely no white space; joined, the pieces are the text."""
    return _CAREFUL.findall(text)


def uneasy(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with a space at which a plain split on single spaces could differ from the tokenizer's own cuts."""
    at = np.flatnonzero(data == 32)
    n = len(data)
    out = np.zeros(len(offsets) - 1, bool)
    if not len(at):
        return out
    get = lambda k: data[np.clip(at + k, 0, n - 1)]
    before, before2, after = get(-1), get(-2), get(1)
    good = (before >= 33) & (before <= 126) | (before >= 128) & (before2 == 0xC3)
    good &= (after > 32) & (after < 127) | (after == 0xC3)
    doc = np.searchsorted(offsets, at, "right") - 1
    good &= (at > offsets[doc]) & (at < offsets[doc + 1] - 1)
    out[doc[~good]] = True
    return out


def kind_of(path: str) -> str:
    if not path.endswith(".json"):
        return "whole"
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre, norm = t.get("pre_tokenizer") or {}, t.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "spaced"
    first = (pre.get("pretokenizers") or [{}])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    plain = all(x["type"] in ("NFC", "Lowercase", "Replace") for x in (norm or {}).get("normalizers", []))
    return "words" if drops and plain else "whole"


#: Classes of WORD_PATTERN's characters in printable ASCII; 0: any other byte.
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = bytes(_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN if 33 <= b <= 126 else 0 for b in range(128)) + bytes(128)
_LOWER, _BLANKS = LOWER.tobytes(), b" \t\n\x0b\x0c\r"
#: Parts pieces among the ids of plain words.
_MARK = b"\xff\xff\xff\xff"


def ids_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _distinct(raw: bytes, edges: np.ndarray, only: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces between the edges, and which each is; of all or of some."""
    found = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64, copy=False)), pa.py_buffer(raw)])
    found = (found if only is None else found.filter(pa.array(only))).dictionary_encode()
    _, o, held = found.dictionary.buffers()
    held, o = held.to_pybytes() if held is not None else b"", np.frombuffer(o, np.int64)[: len(found.dictionary) + 1].tolist()
    return [held[a:z] for a, z in itertools.pairwise(o)], found.indices.to_numpy()


class Encoder:
    """A worker's tokenizer with its store of pieces; `value` turns a list of ids into what the operator needs."""

    def __init__(self, path: str, value: Callable[[list[int]], object], kind: str | None = None, frequent: dict | None = None):
        self.kind, self.value = kind or kind_of(path), value
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [list(model.encode(t, num_threads=1)) for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            pre = (json.loads(model.to_str())["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
            self.bpe = model.model if self.kind == "words" and pre[0].get("pattern", {}).get("Regex") == WORD_PATTERN else None
            self.specials = [t.content for t in model.get_added_tokens_decoder().values()]
            self._encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.model = model
        self.known: dict[bytes, object] = {}
        self.older: dict[bytes, object] = {}
        self.words: dict[str, bytes] = {}
        self.plain: dict[bytes, bytes] = {}
        self.older_plain: dict[bytes, bytes] = {}
        self.frequent = frequent or {}

    def encode(self, parts: list[bytes]) -> list[object]:
        return [self.value(x) for x in self._encode([p.decode("utf-8") for p in parts])]

    def _encode_keys(self, keys: list[bytes]) -> list[object]:
        """Values of keys that may be joined to one text, cut again by the tokens' places."""
        texts = [self.text_of(k).decode("utf-8") for k in keys]
        gap = " " if self.kind == "words" else ""
        got = self.model.encode(gap.join(texts), add_special_tokens=False)
        ids, at = got.ids, [o[0] for o in got.offsets]
        ends = np.cumsum([len(t) + len(gap) for t in texts])
        cut = [0, *np.searchsorted(np.asarray(at, np.int64), ends, "left").tolist()]
        return [self.value(ids[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]

    def _learn_simple(self, miss: list[bytes]) -> list[bytes]:
        """Give plain pieces, whose pre-tokens are known without the normalizer, to the library's BPE model at once; returns the others."""
        rest: list[bytes] = []
        text = b"\n".join(miss).decode("utf-8")
        if not _SIMPLE_LINES.fullmatch(text) or any(x in text for x in self.specials):
            plain = []
            for p, t in zip(miss, text.split("\n"), strict=True):
                (plain if _SIMPLE.fullmatch(t) and not any(x in t for x in self.specials) else rest).append(p)
            miss, text = plain, b"\n".join(plain).decode("utf-8")
        if not miss:
            return rest
        found = _SIMPLE_WORDS.findall(text.lower())
        words = self.words
        new = list(set(found).difference(words, "\n"))
        if len(words) + len(new) > WORDS:
            words = {w: words[w] for w in set(found).intersection(words)}
            if len(words) + len(new) <= WORDS:
                self.words = words
        bpe = self.bpe.tokenize
        written = charmap_decode("\n".join(new).encode(), "strict", _AS_BYTES)[0].split("\n") if new else new
        words.update(zip(new, [array("I", [t.id for t in bpe(w)]).tobytes() for w in written], strict=True))
        words["\n"] = _MARK  # no id is so high
        values = b"".join(map(words.__getitem__, found)).split(_MARK)
        if len(values) != len(miss):  # the mark's bytes across two ids
            values = b"".join(map(words.__getitem__, found))
            ids = np.frombuffer(values, "<u4")
            edge = np.flatnonzero(ids == 0xFFFFFFFF) * 4
            values = [values[a:z] for a, z in zip([0, *(edge + 4).tolist()], [*edge.tolist(), len(values)], strict=True)]
        if self.value is not ids_bytes:
            values = [self.value(array("I", v).tolist()) for v in values]
        self.known.update(zip(miss, values, strict=True))
        return rest

    def learn(self, miss: list[bytes]) -> None:
        if not miss:  # all were in the older half
            return
        known = self.known
        if self.kind == "words":
            alone: list[bytes] = []
            if self.bpe is not None:
                miss = self._learn_simple(miss)
        elif self.kind == "spaced":
            # joined, a piece must end in a character after which a space is a cut
            edge = lambda k: 33 <= k[-1] <= 126 and 33 <= k[0] <= 126 if k else False
            alone = [k for k in miss if not edge(k)]
            miss = [k for k in miss if edge(k)]
        else:
            alone, miss = miss, []
        for i in range(0, len(miss), JOIN):
            part = miss[i : i + JOIN]
            known.update(zip(part, self._encode_keys(part), strict=True))
        for i in range(0, len(alone), JOIN):
            part = alone[i : i + JOIN]
            known.update(zip(part, self.encode([self.text_of(p) for p in part]), strict=True))

    def split(self, data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
        """The pieces of each document as store keys.  In `spaced` texts, keys stand for a space and the piece, but for the first, whose key ends in a NUL mark, as do the keys of careful cuts."""
        raw, o = data.tobytes(), offsets.tolist()
        texts = [raw[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]
        if self.kind == "words":
            return [t.split() for t in texts]
        if self.kind == "whole":
            return [[t + b"\0"] if t else [] for t in texts]
        out = []
        for t, odd in zip(texts, uneasy(data, offsets).tolist(), strict=True):
            if odd or b"\0" in t:
                out.append([p + b"\0" for p in careful(t)])
            else:
                p = t.split(b" ") if t else []
                if p:
                    p[0] += b"\0"
                out.append(p)
        return out

    def text_of(self, key: bytes) -> bytes:
        return key if self.kind == "words" else key[:-1] if key.endswith(b"\0") else b" " + key

    def values(self, pieces: list[list[bytes]]) -> list[list[object]]:
        """The value of each piece of each document."""
        if len(self.known) > KEEP // 2:
            self.older, self.known = self.known, {}
        known, frequent, older = self.known, self.frequent, self.older
        flat = list(itertools.chain.from_iterable(pieces))
        got = list(map(known.get, flat))
        lacking = {p for p, v in zip(flat, got, strict=True) if v is None}
        if lacking:
            if frequent:
                lacking.difference_update(frequent)
            again = lacking.intersection(older) if older else set()
            known.update((p, older[p]) for p in again)
            miss = list(lacking - again)
            self.learn(miss)
            find = (lambda p: frequent[p] if p in frequent else known[p]) if frequent else known.__getitem__
            got = [find(p) if v is None else v for p, v in zip(flat, got, strict=True)]
            for p in miss:
                if len(p) > KEEP_BYTES:
                    del known[p]
        ends = list(itertools.accumulate(map(len, pieces), initial=0))
        return [got[a:z] for a, z in itertools.pairwise(ends)]

    def look_up(self, keys: list[bytes]) -> list[object]:
        """The values of distinct pieces."""
        if len(self.known) > KEEP // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        got = list(map(known.get, keys))
        miss = [p for p, v in zip(keys, got, strict=True) if v is None]
        if miss:
            for store in (older, self.frequent):
                if store and miss:
                    held = list(map(store.get, miss))
                    known.update((p, v) for p, v in zip(miss, held, strict=True) if v is not None)
                    miss = [p for p, v in zip(miss, held, strict=True) if v is None]
            self.learn(miss)
            got = [known[p] if v is None else v for p, v in zip(keys, got, strict=True)]
            for p in miss:
                if len(p) > KEEP_BYTES:
                    del known[p]
        return got

    def _numbered(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The slice's distinct pieces, which of them each place holds, and the places before each document."""
        if self.kind != "words":
            pieces = self.split(data, offsets)
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(p, len(number)) for p in itertools.chain.from_iterable(pieces)), np.int64)
            return list(number), which, np.cumsum([0, *map(len, pieces)])
        edges, before = self._edges(data, offsets)
        return *_distinct(data.tobytes().translate(None, _BLANKS), edges), before

    @staticmethod
    def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin in the slice without its white space, and its end; the pieces before each document."""
        start, end, before = words(data, offsets, NOT_SPACE)
        edges = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=edges[1:])
        return edges, before

    def _pre_tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
        """The slice's distinct lower-case pre-tokens of pieces of printable ASCII, its distinct other pieces, which of them (the others counted on) each place holds, and the places before each document."""
        raw = data.tobytes()
        edges, before = self._edges(data, offsets)
        packed, low = raw.translate(None, _BLANKS), raw.translate(_LOWER, _BLANKS)
        kind, n = np.frombuffer(packed.translate(_CLASS), np.uint8), len(packed)
        cut, piece = np.zeros(n + 3, bool), np.zeros(n + 3, bool)
        piece[edges] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1 : max(n, 1)])
        cut[:n] |= kind == _DIGIT
        cut |= piece
        letter = np.frombuffer(low + bytes(3), np.uint8)
        mark = np.flatnonzero(letter == 39)
        mark = mark[cut[mark] & ~piece[mark + 1]]
        one, two = letter[mark + 1], letter[mark + 2]
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)  # 's 't 'm 'd
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # 're 've 'll
        long &= ~piece[mark + 2]
        cut[mark[short | long] + 1] = False
        cut[mark[short] + 2] = True
        cut[mark[long] + 3] = True
        strange = np.flatnonzero(kind == 0)
        at = [np.searchsorted(edges, strange, "right") - 1]
        for x in map(str.encode, self.specials):
            for m in re.finditer(re.escape(x), packed):
                at.append(np.arange(np.searchsorted(edges, m.start(), "right") - 1, np.searchsorted(edges, m.end())))
        other = np.zeros(len(edges) - 1, bool)
        other[np.concatenate(at)] = True
        if other.any():
            cut[:n] &= ~np.repeat(other, np.diff(edges))
            cut |= piece
        cut = cut[:n]
        start = np.flatnonzero(cut)
        places = np.searchsorted(start, edges[before])
        ends = np.r_[start, n]
        if not other.any():
            keys, which = _distinct(low, ends)
            return keys, [], which, places
        whole = np.zeros(len(start), bool)
        whole[np.searchsorted(start, edges[:-1][other])] = True
        keys, found = _distinct(low, ends, ~whole)
        number: dict[bytes, int] = {}
        rest = [number.setdefault(packed[a:z], len(number)) for a, z in zip(edges[:-1][other].tolist(), edges[1:][other].tolist(), strict=True)]
        which = np.empty(len(start), np.int64)
        which[~whole], which[whole] = found, np.array(rest) + len(keys)
        return keys, list(number), which, places

    def _plain_values(self, keys: list[bytes]) -> list[bytes]:
        """The ids' bytes of distinct lower-case pre-tokens of printable ASCII."""
        if len(self.plain) > KEEP // 2:
            self.older_plain, self.plain = self.plain, {}
        known, older, bpe = self.plain, self.older_plain, self.bpe.tokenize
        got = list(map(known.get, keys))
        for k, v in enumerate(got):
            if v is None:
                p = keys[k]
                got[k] = v = older.get(p) or array("I", [t.id for t in bpe(p.decode())]).tobytes()
                if len(p) <= KEEP_BYTES:
                    known[p] = v
        return got

    def coded(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice, each followed by the end id, and how many each has; values must be the ids' bytes.  Each distinct piece of the slice is looked up once."""
        if self.kind == "words" and self.bpe is not None:
            plain, keys, which, before = self._pre_tokens(data, offsets)
            values = self._plain_values(plain) + self.look_up(keys)
        else:
            keys, which, before = self._numbered(data, offsets)
            values = self.look_up(keys)
        which = np.insert(which, before[1:], len(values))
        values.append(np.asarray([end_id], "<u4").tobytes())
        size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        count = size[which]
        end = np.cumsum(count)
        at = np.repeat((np.cumsum(size) - size)[which] - (end - count), count)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(values), "<u4")[at], np.diff(end[before[1:] + np.arange(len(before) - 1)], prepend=0)


_encoders: dict[tuple, Encoder] = {}
stores.append(_encoders)


def worker_encoder(path: str, value: Callable[[list[int]], object], frequent: Callable[[], dict] | None = None, tag: object = None) -> Encoder:
    """The encoder of this worker process: its store outlives the task, until another operator's release().  `frequent` is called once for each tag."""
    key = (path, value.__name__, tag)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, value, frequent=frequent() if frequent else None)
    return _encoders[key]
