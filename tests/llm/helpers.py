"""Brute-force versions of the corpus operators, and small documents with every odd case."""

import hashlib
import re
from collections import Counter

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items, window):
    """n_words, n_hit, sorted item ids of each text."""
    windows = []
    for name, text in items:
        w = ALNUM.findall(lower(text))
        k = min(window, len(w))
        windows += [(name, tuple(w[j : j + k])) for j in range(len(w) - k + 1) if k]
    out = []
    for text in docs:
        w, hit, names = ALNUM.findall(lower(text)), set(), set()
        for name, v in windows:
            for i in range(len(w) - len(v) + 1):
                if tuple(w[i : i + len(v)]) == v:
                    hit.update(range(i, i + len(v)))
                    names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    """Counts by kind and the joined base spans."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }
    return (*map(len, found.values()), ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans))


def shingle_set(text, n=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near(ids, texts):
    """(id, set size, smallest id reachable) of each document."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                up[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(sets[i]), least[find(i)]) for i, k in enumerate(ids)]


def repeats(texts, length):
    """n_bytes, n_removed, n_spans, sha256 of what stays."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
ODD = [
    (1, None, "s1"), (2, "", "s1"), (3, " \n\t ", None), (4, "one", "s2"), (5, "Mail a.b@c.de, or +1 (555) 010-2030 and 10.0.0.1.", "s2"),
    (6, "the same words again and again in two rows of this table here", "s3"), (7, "the same words again and again in two rows of this table here", "s3"), (7, "the same words again and again in two rows of this table here", "s3"),
    (8, LONG, "s1"), (None, "a row without an id but with words é ß 中", "s1"), (9, "x" * 3000, "s2"), (10, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "é"),
]
SCHEMA = "doc_id long, text string, source string"


def odd_documents(spark):
    """Null, empty, long, repeated and tied rows, with columns whose names operators use themselves, as a table that reads alike each time."""
    import uuid

    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in ODD], f"{SCHEMA}, lang string, uid long, n_words long")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{uuid.uuid4().hex}"
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def stored(spark, rows, schema=SCHEMA, parts=3):
    import uuid

    path = f"{spark.conf.get('spark.checkpoint.dir')}/rows-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)
