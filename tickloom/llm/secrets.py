"""Secret scans (operator 9): formatted secrets by pattern, unformatted ones by sliding-window entropy.

Base spans are leftmost, non-overlapping matches of three patterns. The method then takes every run of 20 or more
characters that a credential may hold, cuts it at dots (which part names and versions), and slides a window of
WINDOW characters along it. Runs without a digit or without a letter are taken for words or numbers and not scored. The window's Shannon entropy is kept by counts: one character enters, one leaves, and the
sum of c * log2(c) changes by two table look-ups. Windows above their character class's threshold, and touching each
other, make one span, unless an allow-list rule takes the run for something public. A span that overlaps a base span is
that secret again and is left out.

One pass over the texts, no shuffle; a worker holds one Arrow batch. A null text is empty; empty tables give empty
results; repeated rows are scanned one by one; other columns are ignored. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, texts

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_PIECE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character a window needs, by class: what random strings of WINDOW characters of that class have at the least
#: in about 99 of 100 cases (16, 36 and 64 letters).
THRESHOLDS = {"hex": 2.85, "alnum": 3.45, "base64": 3.6}
_GAIN = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
#: Allow-list: runs that are public by their form. UUIDs; names joined by - _ / + without digits; versions and dates;
#: placeholders.
_ALLOWED = [
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]+([-_/+=]+[A-Za-z]+)*[-_/+=]*"),
    re.compile(r"[0-9]+([-_/+=]+[0-9]+)*"),
    re.compile(r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}"),
    re.compile(r".*(example|sample|placeholder|changeme|your[-_]).*", re.I),
    re.compile(r"(.{1,6}?)\1+.{0,5}"),
]


def _kind_of(run: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "alnum" if run.isalnum() and (run.islower() or run.isupper()) else "base64"


def entropies(run: str, window: int = WINDOW):
    """Each window's start and entropy in bits a character, by incremental counts."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += _GAIN[c + 1] - _GAIN[c]
        counts[ch] = c + 1
        if i >= window - 1:
            yield i - window + 1, math.log2(window) - total / window
            out = run[i - window + 1]
            c = counts[out]
            total += _GAIN[c - 1] - _GAIN[c]
            counts[out] = c - 1


def hot_spans(run: str) -> list[tuple[int, int]]:
    """Where windows of a run are above the threshold of its class, joined where they touch; allow-listed runs have none."""
    if any(p.fullmatch(run) for p in _ALLOWED) or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run):
        return []
    least, spans = THRESHOLDS[_kind_of(run)], []
    for start, bits in entropies(run):
        if bits >= least:
            if spans and start <= spans[-1][1]:
                spans[-1][1] = start + WINDOW
            else:
                spans.append([start, start + WINDOW])
    return [(a, b) for a, b in spans]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text, as (start, kind's number, end), each list sorted."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [m.span() for m in _RUN.finditer(text)]
    for a, b in runs:  # an access key or hex run that is long enough lies inside one of these
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b)]
    base.sort()
    added, taken, k = [], [], 0
    for start, _, end in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    for a, b in runs:
        for m in _PIECE.finditer(text, a, b):
            for x, y in hot_spans(m[0]):
                x, y = x + m.start(), y + m.start()
                while k < len(taken) and taken[k][1] <= x:
                    k += 1
                if k == len(taken) or y <= taken[k][0]:
                    added.append((x, 3, y))
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def _scan_batches(it):
    for batch in it:
        out = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, added = scan(text)
            n = [sum(k == kind for _, kind, _ in base) for k in range(3)]
            out.append((i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, _TYPES)], names=_NAMES)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]


def find_secrets(docs: DataFrame) -> DataFrame:
    """The operator: per row doc_id, the base counts, base_sha256, all spans, and n_entropy, the number of added ones."""
    return batches(texts(docs)).mapInArrow(_scan_batches, SCHEMA)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
