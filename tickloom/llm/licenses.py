"""Licence scans (operator 5): a trained paragraph classifier, confirmed by templates.

Every paragraph of every text is classified: each line with a word, each run of 2 to LINES lines of a block (lines up to
one without a word) of at most NARROW characters, and pieces of PIECE words, overlapping by half, of longer lines and of
blocks; so wrapped notices are seen whole and a notice in a long paragraph is not diluted. A paragraph's features are
its word 1-grams to 3-grams (letters, digits and dots, lower case), hashed and counted. As they add up, a text's prefix
sums of what each n-gram says for each class give any paragraph's logits by a few subtractions.

Multinomial logistic regression with the classes of FAMILIES and ``unknown`` is fitted on the driver with EXAMPLES
labelled paragraphs that are made by rule from the templates (words dropped, strange words around, parts of templates)
and, for ``unknown``, from other prose with and without licence words; none of the corpus is used and EXAMPLES is the
documented bound. The probabilities are calibrated by a temperature on held-out examples; a paragraph whose best family
is under LEAST there is unknown. What the classifier predicts is confirmed by comparison with the family's templates:
the paragraph has to hold CONTAINED percent of the words of one of them, in order, and its NAMES. The narrowest
paragraph with a family counts; wider ones that overlap it with the same family are left out.

One pass, no shuffle; the model is some hundred KB. A text of more than SEGMENT words is worked on in overlapping
segments. A null text is empty; empty tables give empty results; repeated rows are scanned one by one; other columns are
ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import batches, texts

DIMENSIONS, EXAMPLES, STEPS = 1 << 13, 4200, 120
LEAST, CONTAINED = 0.9, 75
LINES, NARROW, PIECE = 4, 800, 60
SEGMENT, OVERLAP = 1 << 16, 1 << 10  # words; no paragraph has more than OVERLAP
#: Sentences that the licences or the customary notices have.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "spdx-license-identifier mit", "this project is mit-licensed", "mit-license"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www.apache.org licenses license-2.0", "spdx-license-identifier apache-2.0", "released under the apache license", "apache license version 2.0"],
    "gpl": ["licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you should have received a copy of the gnu general public license along with this program", "spdx-license-identifier gpl-3.0-or-later", "spdx-license-identifier gpl-2.0-only", "released under the gpl version 2", "distributed under the gnu gpl"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "spdx-license-identifier lgpl-2.1-or-later", "licensed under the lgpl version 3"],
    "bsd": ["licensed under the bsd 3-clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "distributed under a bsd-style license", "spdx-license-identifier bsd-3-clause", "spdx-license-identifier bsd-2-clause", "licensed under the bsd 2-clause license", "released under the bsd license"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"],
    "cc-by": ["licensed under a creative commons attribution 4.0 international license", "this work is licensed under creative commons attribution sharealike", "available under cc by 4.0", "spdx-license-identifier cc-by-4.0"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier cc-by-nc-4.0"],
    "public-domain": ["this work has been dedicated to the public domain", "this is free and unencumbered software released into the public domain", "released under creative commons zero cc0 1.0 universal"],
    "proprietary": ["all rights reserved", "unauthorized copying of this file via any medium is strictly prohibited", "this software is proprietary and confidential"],
}
FAMILIES = tuple(TEMPLATES)
#: The words of templates that name a licence or that nothing stands for: a template with one needs it.
NAMES = {"mit-license", "mit-licensed", "spdx-license-identifier", "by-nc", "attribution-noncommercial", "apache", "gnu", "gpl", "lgpl", "lesser", "bsd", "bsd-style", "mozilla", "creative", "cc", "cc0", "domain", "proprietary", "reserved", "permission", "redistribution", "redistributions", "unauthorized", "compliance", "apache-2.0", "gpl-3.0-or-later", "gpl-2.0-only", "lgpl-2.1-or-later", "bsd-3-clause", "bsd-2-clause", "mpl-2.0", "cc-by-4.0", "cc-by-nc-4.0", "license-2.0"}
_WORD = re.compile(r"[^\W_](?:[\w.+-]*[^\W_])?")
#: "mit" alone is a common word of German: with what follows it is one word, the licence's name.
_JOINED = {"license": "mit-license", "licence": "mit-license", "licensed": "mit-licensed"}
_U = np.uint64


def words_in(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lower-case words of a text, and where each starts and ends."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    start, end = np.array(spans, np.int64).reshape(-1, 2).T
    if "mit" in words:
        gone = []
        for i in range(len(words) - 1):
            if words[i] == "mit" and words[i + 1] in _JOINED:
                words[i], end[i] = _JOINED[words[i + 1]], end[i + 1]
                gone.append(i + 1)
        words = [w for i, w in enumerate(words) if i not in set(gone)] if gone else words
        start, end = np.delete(start, gone), np.delete(end, gone)
    return words, start, end


def words_of(paragraph: str) -> list[str]:
    return words_in(paragraph)[0]


class Hashes(dict):
    """Words to 64-bit hashes; what was seen is kept, within bounds."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def ngrams(words: list[str]) -> list[np.ndarray]:
    """The features of the 1-grams, 2-grams and 3-grams that start at each word."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out, grown = [], h
    for n in range(3):
        if n:
            grown = grown[: max(0, len(h) - n)] * _U(0x9E3779B97F4A7C15) + h[n:]
            grown ^= grown >> _U(29)
            grown *= _U(0xBF58476D1CE4E5B9)
        out.append(((grown ^ (grown >> _U(32))) & _U(DIMENSIONS - 1)).astype(np.int64))
    return out


def examples(n: int = EXAMPLES) -> list[tuple[list[str], int]]:
    """Labelled paragraphs as words: class numbers of FAMILIES, and len(FAMILIES) for unknown."""
    r = random.Random(11)
    noise = lambda k: ["".join(r.choice("bcdfglmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(k)]
    unlike = ["driving license was renewed last year", "the license fee is paid every month", "a permission slip for the trip", "the public domain of knowledge", "no general rule was reserved for them", "a table was reserved for two", "copyright law is a field of study", "see the terms of service and the privacy policy", "software is sold under several terms", "the committee reserved its judgment", "mit der license wurde alles gut", "students at mit study there", "apache helicopters flew over", "the creative team met in common rooms", "all of the seats were taken", "the rights of all people", "version 2.0 was released in may", "he was granted leave free of charge"]
    out = []
    for i in range(n):
        k = i % (len(FAMILIES) + 4)
        if k < len(FAMILIES):
            words = words_of(r.choice(TEMPLATES[FAMILIES[k]]))
            if r.random() < 0.4 and len(words) > 5:
                drop = r.randrange(len(words))
                words = [w for j, w in enumerate(words) if j != drop or w in NAMES]
            words = noise(r.choice([0, 0, 1, 3, 8])) + words + noise(r.choice([0, 0, 1, 3, 8]))
            out.append((words, k))
        else:
            words = noise(r.randint(1, 30)) + (r.choice(unlike).split() if r.random() < 0.6 else []) + noise(r.randint(0, 10))
            if r.random() < 0.3:
                words += [w for w in words_of(r.choice(TEMPLATES[r.choice(FAMILIES)])) if w not in NAMES and r.random() < 0.4]
            out.append((words, len(FAMILIES)))
    return out


@cache
def fitted() -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (DIMENSIONS x classes), biases, and the temperature that held-out examples call for."""
    made = [(np.concatenate(ngrams(w)), y) for w, y in examples()]
    hold = np.arange(len(made)) % 5 == 0
    classes = len(FAMILIES) + 1
    sizes = np.array([len(x) for x, _ in made])
    rows, cols = np.repeat(np.arange(len(made)), sizes), np.concatenate([x for x, _ in made])
    y = np.array([k for _, k in made])
    goal, scale = np.eye(classes, dtype=np.float32)[y], (1 / np.sqrt(np.maximum(1, sizes)))[:, None].astype(np.float32)
    w, b = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    g2w, g2b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    order = np.argsort(cols, kind="stable")
    distinct, first = np.unique(cols[order], return_index=True)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])

    def logits():
        z = np.zeros((len(made), classes), np.float32)
        z[rows[starts]] = np.add.reduceat(w[cols], starts)
        return z * scale + b

    for _ in range(STEPS):
        z = logits()
        p = np.exp(z - z.max(1, keepdims=True))
        d = (goal - p / p.sum(1, keepdims=True)) / (~hold).sum()
        d[hold] = 0
        grad = np.add.reduceat((d * scale)[rows[order]], first) - np.float32(1e-5) * w[distinct]
        g2w[distinct] += grad**2
        w[distinct] += np.float32(0.5) * grad / np.sqrt(g2w[distinct])
        g2b += d.sum(0) ** 2
        b += np.float32(0.5) * d.sum(0) / np.sqrt(g2b)
    z, held = logits()[hold].astype(float), y[hold]

    def loss(t):
        q = z / t - (z / t).max(1, keepdims=True)
        return -(q[np.arange(len(q)), held] - np.log(np.exp(q).sum(1))).mean()

    return w, b, float(min(np.geomspace(0.25, 4, 33), key=loss))


@cache
def _phrases(family: str) -> list[list[str]]:
    return [words_of(x) for x in TEMPLATES[family]]


def confirmed(words: list[str], family: str) -> bool:
    """Whether the paragraph holds enough of one of the family's templates, in order, and its names."""
    has = set(words)
    for want in _phrases(family):
        if not all(w in has for w in want if w in NAMES):
            continue
        at, hits = 0, 0
        for w in want:
            try:
                at = words.index(w, at) + 1
                hits += 1
            except ValueError:
                continue
        if hits * 100 >= CONTAINED * len(want):
            return True
    return False


def families(words: list[str], begin: np.ndarray, stop: np.ndarray, model=None) -> tuple[np.ndarray, np.ndarray]:
    """Of the paragraphs words[begin:stop]: the best family's number and its calibrated probability."""
    w, b, temperature = model or fitted()
    n, grams = stop - begin, ngrams(words)
    said = [w[x] for x in grams]  # by the 1-gram, 2-gram and 3-gram that start at each word
    each = said[0].copy()
    for x in said[1:]:
        each[: len(x)] += x
    total = np.concatenate([np.zeros((1, len(b))), np.cumsum(each, 0, dtype=np.float64)])
    z = total[stop] - total[begin]
    for k, back in ((1, 1), (2, 1), (2, 2)):  # less the n-grams that start in the paragraph and end behind it
        at = np.flatnonzero((stop - back < len(said[k])) & (stop - back >= begin))
        z[at] -= said[k][stop[at] - back]
    features = np.maximum(1, 3 * n - 3 + (n < 2) + (n < 1))
    z = (z / np.sqrt(features)[:, None] + b) / temperature
    z = np.exp(z - z.max(1, keepdims=True))
    best = z[:, :-1].argmax(1)
    return best, z[np.arange(len(z)), best] / z.sum(1)


def classify(paragraph: str, model=None) -> tuple[str, float]:
    """(family or unknown, the calibrated probability of the best family)."""
    words = words_of(paragraph)
    if not words:
        return "unknown", 0.0
    best, p = families(words, np.array([0]), np.array([len(words)]), model)
    family = FAMILIES[best[0]]
    return (family if p[0] >= LEAST and confirmed(words, family) else "unknown"), float(p[0])


def _pieces(begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of words as they are up to PIECE words, longer ones in overlapping pieces."""
    n = stop - begin
    count = np.where(n > PIECE, -(-(n - PIECE) // (PIECE // 2)) + 1, 1)
    which = np.repeat(np.arange(len(begin)), count)
    a = begin[which] + (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * (PIECE // 2)
    return a, np.minimum(a + PIECE, stop[which])


def paragraphs(text: str, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The paragraphs of a text as ranges of its words, narrow ones first: lines, runs of 2, 3 ... LINES lines, pieces of blocks."""
    breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    line = np.searchsorted(breaks, start)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    last = np.r_[first[1:], len(start)]
    no = line[first]
    block = np.cumsum(np.r_[0, np.diff(no) > 1])  # lines without words end a block
    out = [_pieces(first, last)]
    for n in range(2, LINES + 1):
        a, b = np.arange(len(first) - n + 1), np.arange(n - 1, len(first))
        fit = (block[a] == block[b]) & (end[last[b] - 1] - start[first[a]] <= NARROW) & (last[b] - first[a] <= OVERLAP)
        out.append((first[a[fit]], last[b[fit]]))
    top = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    tail = np.r_[top[1:], len(first)]
    several = tail - top > 1
    out.append(_pieces(first[top[several]], last[tail[several] - 1]))
    return out


def scan(text: str, model=None) -> list[tuple[int, int, str, float]]:
    """(start, end, family, probability) of the paragraphs with a licence; touching pieces of one family are joined."""
    words, start, end = words_in(text)
    taken: dict[str, list[list]] = {}  # by family, in order and disjoint
    if not words:
        return []
    kinds = paragraphs(text, start, end)
    kind = np.repeat(np.arange(len(kinds)), [len(a) for a, _ in kinds])
    begin, stop = (np.concatenate(x) for x in zip(*kinds))
    found: list[list[tuple]] = [[] for _ in kinds]
    for low in range(0, len(words), SEGMENT):
        here = np.flatnonzero((begin >= low) & (begin < low + SEGMENT))
        best, p = families(words[low : low + SEGMENT + OVERLAP], begin[here] - low, stop[here] - low, model)
        for i in np.flatnonzero(p >= LEAST).tolist():
            a, b, family = begin[here[i]], stop[here[i]], FAMILIES[best[i]]
            if confirmed(words[a:b], family):
                x, y = text.rfind("\n", 0, start[a]) + 1, text.find("\n", end[b - 1])
                x = x if a == 0 or end[a - 1] <= x else int(start[a])  # whole lines, where they begin or end with the paragraph
                y = (y if y >= 0 else len(text)) if b == len(words) or 0 <= y <= start[b] else int(end[b - 1])
                found[kind[here[i]]].append((x, y, family, float(p[i])))
    for k, of_kind in enumerate(found):
        fresh: list[list] = []
        for x, y, family, sure in of_kind:
            own = taken.setdefault(family, [])
            at = bisect_left(own, [y])
            if at and fresh and own[at - 1] is fresh[-1] and x <= fresh[-1][1] and k in (0, LINES):
                fresh[-1][1], fresh[-1][3] = y, max(sure, fresh[-1][3])
            elif at == 0 or own[at - 1][1] <= x:
                fresh.append([x, y, family, sure])
                own.insert(at, fresh[-1])
    return sorted(tuple(x) for own in taken.values() for x in own)


SCHEMA = "doc_id long, n_licenses long, license string, families string, spans string"


def _scan_batches(model):
    def run(it):
        for batch in it:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = scan(text, model) if text else []
                best = max(found, key=lambda x: (x[3], -x[0]))[2] if found else "unknown"
                rows.append((i, len(found), best, ",".join(sorted({x[2] for x in found})), ",".join(f"{f}:{a}:{b}" for a, b, f, _ in found)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def find_licenses(docs: DataFrame) -> DataFrame:
    """The operator: per row doc_id, n_licenses, license (the surest family, or unknown), families (sorted, distinct) and spans."""
    return batches(texts(docs)).mapInArrow(_scan_batches(fitted()), SCHEMA)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
