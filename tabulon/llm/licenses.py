"""License scans: Dice coefficient over word bigrams against licence templates.

The segments of a text are its lines and its paragraphs (parted by empty lines).  A
segment is normalised to lower-case words; two sets of word bigrams A and B have
Dice 2|A&B| / (|A|+|B|).  As |A&B| is at most the smaller size, a template whose
size is too far from the segment's cannot reach the threshold and is passed over, and a
segment without any template bigram is never compared.

With ``windows``, notices inside longer lines, or spread over lines of any ending or comment sign,
are found too: runs of words, up to as long as the size bound lets a template's match be, that begin and end with a
bigram of the template.  Of overlapping windows of one template the best counts; segments that overlap
one of its windows are left out.

Null and empty texts, and segments of fewer than two words, match nothing; repeated rows
give equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, U64, mix, prefix_hash, range_hash, slices, text_column, words
from .common import SLICE_BYTES, small_batches

#: Licence notices, as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-header": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: The grant paragraph by itself, and whole texts as their publishers word them: windows find them, the SQL does not know them.
WHOLE = {f.name.removesuffix(".txt") + "-text": f.read_text(encoding="utf-8") for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
WHOLE["mit-grant"] = WHOLE["mit-text"].split("\n\n")[0]


def _bigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word with the next (of the last with nothing)."""
    h = range_hash(prefix_hash(data), start, end)
    if not len(h):
        return h
    return mix(h * U64(3) + np.r_[h[1:], h[:1] * U64(0)] * U64(0x9E3779B97F4A7C15))


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sets = []
        self.lengths = []
        for n in self.names:
            data = LOWER[np.frombuffer(texts[n].encode(), np.uint8)]
            start, end, _ = words(data, np.array([0, len(data)]), ALNUM)
            self.sets.append(np.unique(_bigrams(data, start, end)[:-1]))
            self.lengths.append(max(len(start) - 1, 0))
        self.sizes = np.array([len(s) for s in self.sets])
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, U64)
        # the templates of each bigram of `all`, packed
        which = np.repeat(np.arange(len(self.sets)), self.sizes)
        gram = np.searchsorted(self.all, np.concatenate(self.sets)) if self.sets else which
        self.member = which[np.argsort(gram, kind="stable")]
        self.first = np.r_[0, np.cumsum(np.bincount(gram, minlength=len(self.all)))]


def _segments(data: np.ndarray, offsets: np.ndarray, paragraphs: bool) -> np.ndarray:
    """Segment number of each byte: it grows at every document and at every line end (or every second of two in a row)."""
    cut = data == 10
    if paragraphs:
        cut[1:] &= data[:-1] == 10
        cut[:1] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.cumsum(cut)


def _best(gram: np.ndarray, hit: np.ndarray, size: int, longest: int, threshold: float) -> list[tuple[int, int, float]]:
    """Windows (first bigram, last bigram, Dice) of one document that match a template of `size` bigrams, none overlapping; `hit` are the places of its bigrams."""
    order = np.argsort(gram, kind="stable")
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    before = np.full(len(gram), -1)
    before[order[same + 1]] = order[same]
    of_template = np.zeros(len(gram), bool)
    of_template[hit] = True
    out, todo = [], [(0, len(gram))]
    while todo:
        lo, hi = todo.pop()
        mine = hit[np.searchsorted(hit, lo) : np.searchsorted(hit, hi)]
        many = np.searchsorted(mine, np.minimum(mine + longest, hi)) - np.arange(len(mine))
        best, dropped, free = None, None, lo
        # a window of so few of the template's bigrams cannot reach the threshold
        for s in [*mine[2 * many >= threshold * (many + size)].tolist(), hi]:
            if best and s > best[1] + 1:
                out.append(best)
                free = best[1] + 2
                if dropped is not None:
                    todo.append((dropped, best[0] - 1))
                best, dropped = None, None
            if s == hi or s < free or (best and best[2] == 1):
                continue
            new = before[s : min(s + longest, hi)] < s
            dice = 2 * np.cumsum(new & of_template[s : s + len(new)]) / (np.cumsum(new) + size)
            e = int(np.argmax(dice))
            if dice[e] >= threshold and (best is None or dice[e] > best[2]):
                dropped = best[0] if best and dropped is None else dropped
                best = (s, s + e, float(dice[e]))
        if best:
            out.append(best)
            if dropped is not None:
                todo.append((dropped, best[0] - 1))
    return out


def _windows(t: Templates, gram: np.ndarray, known: np.ndarray, before: np.ndarray, threshold: float):
    """Rows (document, template, Dice, first word, last word) of the matching windows; `before` are the words before each document."""
    n_words = np.diff(before)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(known[:-1] & (doc[1:] == doc[:-1]))
    g = np.searchsorted(t.all, gram[at])
    times = t.first[g + 1] - t.first[g]
    row = np.repeat(np.arange(len(at)), times)
    k = t.member[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + t.first[g][row]]
    # neither a document of so few bigrams nor one with so few of the template's can reach the threshold
    least = threshold * t.sizes / (2 - threshold) - 1e-9
    row, k = (x[n_words[doc[at[row]]] - 1 >= least[k]] for x in (row, k))
    key = doc[at[row]] * len(t.sets) + k
    pair, count = np.unique(np.unique(key * len(t.all) + g[row]) // len(t.all), return_counts=True)
    pair = pair[count >= least[pair % len(t.sets)]]
    stays = np.isin(key, pair)
    key, place = key[stays], at[row[stays]]
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    for p in pair.tolist():
        d, k = divmod(p, len(t.sets))
        a, z = np.searchsorted(key, [p, p + 1])
        longest = int(t.lengths[k] * (2 - threshold) / threshold + 1e-9)
        for i, j, dice in _best(gram[before[d] : before[d + 1] - 1], place[a:z] - before[d], int(t.sizes[k]), longest, threshold):
            yield d, k, dice, before[d] + i, before[d] + j + 1


def _scan(t: Templates, data: np.ndarray, offsets: np.ndarray, threshold: float, windows: bool = False):
    """Rows (document, template, Dice, byte start, byte end) of the matching segments, and of windows if these are asked for."""
    data = LOWER[data]
    start, end, before = words(data, offsets, ALNUM)
    if not len(start) or not len(t.all):
        return []
    gram = _bigrams(data, start, end)
    known = t.all[np.minimum(np.searchsorted(t.all, gram), len(t.all) - 1)] == gram
    found = {}
    for paragraphs in (False, True):
        seg = _segments(data, offsets, paragraphs)[start]
        inner = np.r_[seg[1:] == seg[:-1], False]
        # at least t / (2 - t) of a matching segment's bigrams are known
        which, ours = seg[inner], known[inner]
        first = np.unique(mix(gram[inner] ^ mix(which.astype(U64))), return_index=True)[1]
        n, hits = np.bincount(which[first]), np.bincount(which[first], ours[first])
        for s in np.flatnonzero((hits > 0) & ((2 - threshold) * hits >= threshold * n - 1e-9)).tolist():
            a, z = np.searchsorted(seg, [s, s + 1])
            mine = np.unique(gram[a : z - 1])
            doc = int(np.searchsorted(offsets, start[a], "right")) - 1
            # Dice is at most 2 min / (sum): outside these sizes a template can't reach the threshold
            fits = np.flatnonzero(2 * np.minimum(t.sizes, len(mine)) >= threshold * (t.sizes + len(mine)))
            for k in fits.tolist():
                both = len(np.intersect1d(mine, t.sets[k], assume_unique=True))
                dice = 2 * both / (len(mine) + int(t.sizes[k]))
                if dice >= threshold:
                    found[(doc, k, int(start[a] - offsets[doc]), int(end[z - 1] - offsets[doc]))] = dice
    if windows:
        inside: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for d, k, dice, a, z in _windows(t, gram, known, before, threshold):
            inside.setdefault((d, k), []).append((int(start[a] - offsets[d]), int(end[z] - offsets[d]), dice))
        for v in inside.values():
            v.sort()

        def apart(x):
            v = inside.get(x[:2], [])
            k = bisect_left(v, (x[3],))  # the windows before k begin before the segment's end
            return not k or v[k - 1][1] <= x[2]

        found = {x: dice for x, dice in found.items() if apart(x)}
        found.update({(*x, a, z): dice for x, v in inside.items() for a, z, dice in v})
    return [(d, k, dice, a, z) for (d, k, a, z), dice in found.items()]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, windows: bool = False) -> DataFrame:
    """doc_id, n_matches (segments or windows, and templates), licenses (ids, sorted, comma-joined), best_license, best_dice and matches (license, dice, byte range) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(Templates(templates or {**TEMPLATES, **WHOLE}))
    columns = "doc_id long, n_matches long, licenses string, best_license string, best_dice double, matches array<struct<license: string, dice: double, start: long, end: long>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        t = held.value
        for b in batches:
            data, offsets = text_column(b)
            for i, j in slices(offsets, SLICE_BYTES):
                rows: list[list] = [[] for _ in range(j - i)]
                for d, k, dice, a, z in _scan(t, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], threshold, windows):
                    rows[d].append({"license": t.names[k], "dice": round(dice, 6), "start": a, "end": z})
                for r in rows:
                    r.sort(key=lambda m: (m["start"], m["end"], m["license"]))
                best = [min(((-m["dice"], m["license"]) for m in r), default=(0.0, None)) for r in rows]
                cols = [
                    b.column(0).slice(i, j - i),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([",".join(sorted({m["license"] for m in r})) for r in rows]),
                    pa.array([x[1] for x in best], pa.string()),
                    pa.array([abs(x[0]) for x in best], pa.float64()),
                    pa.array(rows, kind),
                ]
                yield pa.record_batch(cols, ["doc_id", "n_matches", "licenses", "best_license", "best_dice", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, columns)


def oracle_sql(templates: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """DuckDB SQL of scan()'s doc_id, licenses, best_license and best_dice."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (templates or TEMPLATES).items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = rf"""list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"""
    split = rf"""regexp_extract_all(translate({{}}, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return rf"""
WITH t AS (SELECT id, {grams} AS g FROM (SELECT id, {split.format("body")} AS w FROM (VALUES {rows}) v(id, body))),
known AS (SELECT DISTINCT unnest(g) AS x FROM t),
seg AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split(text, chr(10) || chr(10)))) AS s FROM documents WHERE text IS NOT NULL),
sg AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {split.format("s")} AS w FROM seg) WHERE len(w) > 1),
near AS (SELECT * FROM sg WHERE list_has_any(g, (SELECT list(x) FROM known))),
m AS (SELECT doc_id, id, round(2.0::DOUBLE * len(list_intersect(near.g, t.g)) / (len(near.g) + len(t.g)), 6) AS dice, 2.0::DOUBLE * len(list_intersect(near.g, t.g)) / (len(near.g) + len(t.g)) AS d FROM near JOIN t ON 2 * least(len(near.g), len(t.g)) >= {threshold} * (len(near.g) + len(t.g))),
k AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS licenses, arg_min(id, struct_pack(d := -dice, i := id)) AS best_license, max(dice) AS best_dice FROM m WHERE d >= {threshold} GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, best_license, coalesce(best_dice, 0) AS best_dice FROM documents LEFT JOIN k USING (doc_id)"""
