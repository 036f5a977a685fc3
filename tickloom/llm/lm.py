"""Language-model scoring (operator 1): a causal self-attention model over subword ids, in numpy.

Text to ids: words (lower-cased A-Z) are encoded by a public byte-level vocabulary, each with its leading space; an end
symbol closes a text and also opens it as context.

Symbols: the next one is drawn from one of COMPONENTS distributions over the whole vocabulary. The choice (the gate) is a
softmax of what the current symbol says and what one head of causal self-attention reads from the CONTEXT to
CONTEXT + BLOCK symbols at hand; attention has a learned bias for each distance. A symbol's probability is
sum_k gate_k * emit_k(symbol). Scores of keys and logits of gates are bounded (BOUND), the same in fitting and scoring.

Windows overlap: a window holds CONTEXT symbols that were scored before and BLOCK new ones, each of which attends to
what precedes it in the window. Every symbol is scored once; windows of many texts form one masked batch.

Words: rank-COMPONENTS emissions know little of how words go on, so a word is drawn, with fixed shares,
* symbol by symbol (the product of its symbols' probabilities),
* whole (WORD_SHARE) from the word counts of the state that attention is in where the word starts (the likeliest
  component), smoothed by the counts of all training words, or
* whole by a copy head that attends evenly to all earlier words of the text (COPY_SHARE, rising with their number).
Blocks of PHRASE words, counted from the text's start, are drawn whole (PHRASE_SHARE) from the blocks of the training
texts. A training text's own blocks are taken off the counts, so that what is left is what the rest of the corpus says of
it: texts that occur more than once score apart from those that occur once.

Fitting takes two distributed passes, each over all training texts; nothing is fitted on a sample. (1) Pairs of
neighbouring symbols are counted, the second by its bucket of BUCKETS (a hash of the id). From these counts alone the
driver makes the start, by EM of a mixture in which a symbol draws a component and the component the next bucket: gates and
bias, emissions (a bucket's share dealt by how frequent its ids are), and values and output of the head, such that what
attention reads is what the symbols at hand say of the component. (2) Each task sums the expected counts of (id,
component), the gradients of all weights under the start, and counts (word, state) and blocks; Spark adds them up, and the
driver sets the emissions and takes one adaptive step with every weight (a generalised EM step). Word counts, and so the
base score, come from the same pass.

Counts never go to one place: words are counted in each task (flushed at KEEP distinct words), then by a shuffle. The
words above a count, at most about HEAD of them, and the end are broadcast; a text's other words leave with what the
model says of them and meet their counts by a join, where both scores are completed by the same rules. The model has
some 60 numbers an id of the vocabulary. A long text is worked on in slices of ROWS windows.

Nulls: a null text is empty: one symbol, the end. A null doc_id hashes as the empty string. Repeated rows are scored
one by one and count as often in training. Empty tables give empty results; without training texts all counts are 0.
"""

from __future__ import annotations

import base64
import ctypes
import math
import pathlib
from collections import defaultdict
from functools import cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, discard, stash

#: Where the vocabulary is on the driver and all executors, unless the session's setting SETTING names another file.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.tickloom.vocabulary"
#: Fixed value: the pattern by which this vocabulary's makers cut text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_WORD = b"\n"  # no word holds a line break
WIDTH, COMPONENTS, BLOCK, CONTEXT = 8, 16, 16, 8
ROWS, BOUND = 512, 40.0
#: Training texts that make a sample: none. All that is fitted comes from all of them.
SAMPLE_DOCS = 0
#: Buckets of second symbols, rounds of the start's EM, counts that smooth a symbol's gate, and how much of the gates the
#: head says at the start.
BUCKETS, ROUNDS, GATE_SMOOTHING, HEAD_SCALE = 512, 60, 1.0, 0.5
#: The step with every weight after the pass over all training texts.
PASS_STEP = 0.015
#: Shares of whole words; words of a state are smoothed by so many words of the whole corpus.
WORD_SHARE, COPY_SHARE, COPY_HALF, STATE_SMOOTHING = 0.5, 0.1, 20.0, 300.0
PHRASE, PHRASE_SHARE = 32, 0.05
SMOOTHING = 200.0
HEAD, KEEP = 120_000, 200_000
#: Weights without ids, and tables by id with their widths; columns of the sums that a pass makes.
WHOLE, TABLES = ("out", "bias", "distance"), {"q": WIDTH, "k": WIDTH, "v": WIDTH, "gate": COMPONENTS}
SUMS = COMPONENTS + sum(TABLES.values())
#: The distance of (query, key) of a window, 0 for keys after the query.
FAR = np.maximum(np.arange(CONTEXT, CONTEXT + BLOCK)[:, None] - np.arange(CONTEXT + BLOCK)[None, :], 0).reshape(-1)
_LATER = np.arange(CONTEXT, CONTEXT + BLOCK)[:, None] < np.arange(CONTEXT + BLOCK)[None, :]
_F = np.float32


@cache
def one_thread() -> None:
    """One BLAS thread for this worker, where numpy's own OpenBLAS is found: products here are small, and threads that wait
    for each other take the cores of other tasks."""
    for path in pathlib.Path(np.__file__).parents[1].glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def give_back() -> None:
    """What this worker has freed goes back to the system: idle workers stay, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A kernel over a task's batches after which give_back is called."""

    def tidied(it):
        yield from run(it)
        give_back()

    return tidied


@cache
def encoder(path: str):
    """The encoding, the number of its ids, and how many bytes each stands for."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(len(ranks) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks), sizes


class Ids:
    """Words to subword ids; what was seen is kept, within bounds. A word's number indexes the arrays of this object; the end
    is word 0, its one symbol the vocabulary's first free id."""

    def __init__(self, path: str, keep: int = KEEP):
        self.encoding, self.end, self.bytes = encoder(path)
        self.keep = keep
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__, {})
        self.number[END_WORD]
        self.words: list[bytes] = [END_WORD]
        self.flat, self.start, self.size = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.hash = np.empty(0, np.uint64)
        self.flat[0], self.size[0], self.used = self.end, 1, 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number."""
        n = len(self.words)
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))  # numbers the new ones, in order
        if len(self.number) > n:
            new = list(islice(self.number, n, None))
            self.words += new
            # one call for all: the pattern never joins what a space parts, so the bytes of the ids tell where words end
            try:
                told = (b" " + b" ".join(new)).decode()
                lengths = np.fromiter(map(len, new), np.int64, len(new)) + 1
            except UnicodeDecodeError:
                parts = [" " + w.decode("utf-8", "replace") for w in new]
                told, lengths = "".join(parts), np.fromiter((len(x.encode()) for x in parts), np.int64, len(parts))
            ids = np.array(self.encoding.encode_ordinary(told), np.int32)
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(lengths)) + 1
            sizes = np.diff(ends, prepend=0)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while len(self.words) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[n : len(self.words)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : len(self.words)] = sizes
            self.used += len(ids)
        return found

    def hashes(self) -> np.ndarray:
        """A hash of each word, by number; made when it is first asked for."""
        new = self.words[len(self.hash) :]
        if new:
            self.hash = np.append(self.hash, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
        return self.hash

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The symbols of words (by number), one after another."""
        size = self.size[numbers]
        return self.flat[np.repeat(self.start[numbers] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, one after another, and how many each has."""
    return np.concatenate(texts), np.array([len(t) for t in texts])


class Model:
    """The weights: tables q, k, v (ids x WIDTH), gate (ids x COMPONENTS), out, bias, distance, and emit (ids x COMPONENTS)."""

    def __init__(self, n_ids: int, seed: int = 5):
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.3).astype(_F)
        self.end = n_ids - 1
        self.q, self.k, self.v, self.out = small(n_ids, WIDTH), small(n_ids, WIDTH), small(n_ids, WIDTH), small(WIDTH, COMPONENTS)
        self.gate, self.bias = np.zeros((n_ids, COMPONENTS), _F), np.zeros(COMPONENTS, _F)
        self.distance = np.zeros(BLOCK + CONTEXT, _F)
        self.emit = np.full((n_ids, COMPONENTS), 1 / n_ids, _F)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def windows(self, symbols: np.ndarray, sizes: np.ndarray):
        """(context ids, target ids, true where a target is, whether a window has a predecessor): rows of BLOCK. symbols are
        those of texts of the given sizes, each closed by an end."""
        per = -(-sizes // BLOCK)
        first, rows = np.cumsum(per) - per, int(per.sum())
        place = np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))
        given = np.full(rows * BLOCK + 1, self.end, np.int32)
        target, real, follows = np.full(rows * BLOCK, self.end, np.int32), np.zeros(rows * BLOCK, bool), np.ones(rows, bool)
        target[place], real[place], given[place + 1] = symbols, True, symbols  # the last of a text is an end, as is what opens the next
        follows[first] = False
        shaped = lambda x: x.reshape(rows, BLOCK)
        return shaped(given[:-1]), shaped(target), shaped(real), follows

    def slices(self, symbols: np.ndarray, sizes: np.ndarray):
        """The windows in slices of ROWS; each but the first has its predecessor in front, as context only (lead 1)."""
        given, target, real, follows = self.windows(symbols, sizes)
        for a in range(0, len(given), ROWS):
            lead, b = int(a > 0), a + ROWS
            own = real[a - lead : b].copy()
            own[:lead] = False
            yield lead, given[a - lead : b], target[a - lead : b], own, follows[a - lead : b]

    def attend(self, given: np.ndarray, follows: np.ndarray):
        """The gate (not divided by its sum) of each window's symbols, and what a gradient needs: q, k, v, the weights of
        attention before they are divided by their sums, the sums, and what is read."""
        q, own_k, own_v = (x.take(given, axis=0) for x in (self.q, self.k, self.v))  # several times as fast as x[given]
        k, v = np.empty((2, len(given), CONTEXT + BLOCK, WIDTH), _F)
        k[:, CONTEXT:], k[1:, :CONTEXT], k[:1, :CONTEXT] = own_k, own_k[:-1, BLOCK - CONTEXT :], 0
        v[:, CONTEXT:], v[1:, :CONTEXT], v[:1, :CONTEXT] = own_v, own_v[:-1, BLOCK - CONTEXT :], 0
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += np.where(_LATER, _F(-1e9), self.distance[FAR.reshape(_LATER.shape)])
        s[~follows, :, :CONTEXT] = -1e9
        if s.max(initial=0) > BOUND:
            np.minimum(s, BOUND, out=s)
        np.exp(s, out=s)
        total = _summed(s)
        a = np.matmul(s, v)
        a /= total
        z = (a.reshape(-1, WIDTH) @ self.out).reshape(*given.shape, COMPONENTS)
        z += self.bias
        z += self.gate.take(given, axis=0)
        np.clip(z, -BOUND, BOUND, out=z)
        np.exp(z, out=z)
        return z, (q, k, v, s, total, a)

    def symbol_logs(self, symbols: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None):
        """The log10 probability of every symbol of texts; and the states at the symbols that starts numbers."""
        logs, states, at = [], [], 0
        for _, given, target, real, follows in self.slices(symbols, sizes):
            z, _ = self.attend(given, follows)
            z, own = z.reshape(-1, COMPONENTS), np.flatnonzero(real)
            p = np.einsum("tk,tk->t", z, self.emit.take(target.reshape(-1), axis=0))
            p /= _summed(z)[:, 0]
            logs.append(np.log10(np.maximum(p[own], _F(1e-30))))
            if starts is not None:
                here = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(own))] - at
                states.append(z[own[here]].argmax(1))
                at += len(own)
        return (np.concatenate(logs), np.concatenate(states)) if starts is not None else np.concatenate(logs)

    def gradients(self, given: np.ndarray, target: np.ndarray, real: np.ndarray, follows: np.ndarray):
        """The share of components of each target, the gate, the gradient of the log probability by table, a row each context
        id, and by the other weights. Where there is no target, shares and gradients of the gate are 0."""
        gate, (q, k, v, s, total, a) = self.attend(given, follows)
        gate /= _summed(gate)
        share = self.emit.take(target, axis=0)
        share *= gate
        share /= np.maximum(_summed(share), _F(1e-30))
        dz = share - gate
        share[~real], dz[~real] = 0, 0
        da = (dz.reshape(-1, COMPONENTS) @ self.out.T).reshape(a.shape)
        da /= total  # not the weights, which are more
        ds = np.matmul(da, v.transpose(0, 2, 1))
        ds -= _summed(da * a)  # the mean of ds under the weights
        ds *= s
        dq, dk, dv = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(s.transpose(0, 2, 1), da)
        for d in (dk, dv):
            d[:-1, BLOCK:] += d[1:, :CONTEXT]
        flat = lambda x: x.reshape(-1, x.shape[-1])
        whole = {"out": flat(a).T @ flat(dz), "bias": _over_rows(flat(dz)), "distance": np.bincount(FAR, _over_rows(ds.reshape(len(ds), -1)), CONTEXT + BLOCK).astype(_F)}
        tables = {"q": flat(dq), "k": flat(dk[:, CONTEXT:]), "v": flat(dv[:, CONTEXT:]), "gate": flat(dz)}
        return flat(share), gate, tables, whole

    def step(self, name: str, rows: np.ndarray | None, grad: np.ndarray, rate: float = PASS_STEP) -> None:
        """An adaptive step with a weight, or with the rows of a table that have a gradient (each once)."""
        weight, seen = getattr(self, name), self.seen[name]
        if rows is None:
            seen += (grad**2).reshape(len(grad), -1).mean(1)
            weight += rate * grad / np.sqrt(seen).reshape(-1, *[1] * (grad.ndim - 1))
            return
        seen[rows] += (grad**2).mean(1)
        weight[rows] += rate * grad / np.sqrt(seen[rows])[:, None]

    def set_emissions(self, counts: np.ndarray, unigram: np.ndarray) -> None:
        """Emissions from expected counts, smoothed by a unigram distribution."""
        mass = counts.sum(0, keepdims=True)
        self.emit = ((counts + SMOOTHING * unigram[:, None]) / (mass + SMOOTHING)).astype(_F)


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept: a product with ones is several times as fast as sum."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


def _over_rows(x: np.ndarray) -> np.ndarray:
    """Sums over the rows of a table, by a product with ones, too."""
    return np.ones(len(x), x.dtype) @ x


def unigram(counts: np.ndarray) -> np.ndarray:
    """A distribution in which no id has probability 0."""
    return (counts + 0.5) / (counts.sum() + 0.5 * len(counts))


def by_id(given: np.ndarray, target: np.ndarray, share: np.ndarray, tables: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, a row of SUMS numbers each): expected counts of components, and gradients of the tables.

    A target is the context id of the next place (an end's next place has the end, too), so one ranking serves both."""
    every = np.append(given.reshape(-1), target.reshape(-1)[-1])
    here = np.zeros(int(every.max()) + 1, bool)
    here[every] = True
    ids = np.flatnonzero(here)
    rank = np.empty(len(here), np.int64)
    rank[ids] = np.arange(len(ids))
    place = rank[every]
    sums, at = np.empty((len(ids), SUMS), _F), 0
    for values, where in ((share, place[1:]), *((t, place[:-1]) for t in tables.values())):
        for column in np.ascontiguousarray(values.T, np.float64):
            sums[:, at] = np.bincount(where, column, len(ids))
            at += 1
    return ids, sums


def buckets(n_ids: int) -> np.ndarray:
    """The bucket of each id, by a hash."""
    h = np.arange(n_ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def pairs(symbols: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The cell (id * BUCKETS + bucket of the next) of neighbours; texts end with an end, which opens the next."""
    return np.append(len(of) - 1, symbols[:-1]).astype(np.int64) * BUCKETS + of[symbols]


def started(n_ids: int, cells: np.ndarray, n: np.ndarray, seed: int = 5) -> Model:
    """The weights that the counts of pairs (by cell, each once, in rising order) give."""
    model, r = Model(n_ids, seed), np.random.default_rng(seed)
    model.seen = {name: np.full(len(getattr(model, name)), 1e-3, _F) for name in (*WHOLE, *TABLES)}
    if not len(cells):
        return model
    of = buckets(n_ids)
    ids, row = np.unique(cells // BUCKETS, return_inverse=True)
    totals = np.bincount(row, n)[:, None]
    every = unigram(np.bincount(cells % BUCKETS, n, BUCKETS)).astype(_F)
    told = np.zeros((len(ids), BUCKETS), _F)
    told[row, cells % BUCKETS] = n
    emit = every * np.exp(r.standard_normal((COMPONENTS, BUCKETS))).astype(_F)
    emit /= _summed(emit)
    gate = np.exp(0.3 * r.standard_normal((len(ids), COMPONENTS))).astype(_F)
    gate /= _summed(gate)
    for _ in range(ROUNDS):
        chosen, drawn_by = np.empty(gate.shape), np.zeros(emit.shape)
        for a in range(0, len(ids), 4096):
            part = gate[a : a + 4096]
            ratio = told[a : a + 4096] / np.maximum(part @ emit, _F(1e-30))
            chosen[a : a + 4096] = part * (ratio @ emit.T)
            drawn_by += part.T @ ratio
        share = chosen.sum(0) / chosen.sum()
        gate = ((chosen + GATE_SMOOTHING * share) / (totals + GATE_SMOOTHING)).astype(_F)
        emit = (emit * drawn_by + 0.1 * every).astype(_F)
        emit /= _summed(emit)
    model.bias = np.log(share + 1e-6).astype(_F)
    model.gate[ids] = np.log(np.maximum(gate, 1e-6) / (share + 1e-6))
    frequent = np.zeros(n_ids)
    frequent[ids] = totals[:, 0]  # each symbol of a text is once the second of a pair, and once the first
    frequent = unigram(frequent)
    # in rows, as take needs it: it would copy the whole of a table in another order
    model.emit = np.ascontiguousarray(emit.T[of] * (frequent / np.bincount(of, frequent, BUCKETS)[of])[:, None], _F)
    # the gates' main directions, ids by their counts: the same numbers whatever the order of rows
    logits = model.gate[ids].astype(float)
    _, found = np.linalg.eigh((logits * (totals / totals.sum())).T @ logits)
    main = found[:, ::-1][:, :WIDTH] * math.sqrt(HEAD_SCALE)
    model.out = np.ascontiguousarray(main.T, _F)
    model.v[:] = 0
    model.v[ids] = logits @ main
    return model


def train(texts: list[np.ndarray], n_ids: int, seed: int = 5) -> Model:
    """What ``fit`` does, of texts at hand: the start from counts of pairs, then the step from sums over all windows."""
    if not texts:
        return started(n_ids, np.empty(0, np.int64), np.empty(0, np.int64), seed)
    symbols, sizes = joined(texts)
    model = started(n_ids, *np.unique(pairs(symbols, buckets(n_ids)), return_counts=True), seed)
    by, rest = np.zeros((n_ids, SUMS)), {name: np.zeros(getattr(model, name).shape) for name in WHOLE}
    for _, given, target, real, follows in model.slices(symbols, sizes):
        share, _, tables, whole = model.gradients(given, target, real, follows)
        ids, sums = by_id(given, target, share, tables)
        by[ids] += sums
        for name in WHOLE:
            rest[name] += whole[name]
    hit = np.flatnonzero(by.any(1))
    improve(model, np.append(hit, _REST), np.concatenate([by[hit], _rest_rows(rest)]).astype(_F))
    return model


#: The ids under which the gradients of weights without ids go: a row of ``out`` each, bias, distance.
_REST = -1 - np.arange(WIDTH + 2)


def _rest_rows(whole: dict[str, np.ndarray]) -> np.ndarray:
    """The gradients of weights without ids as rows of SUMS numbers, in the order of _REST."""
    rows = np.zeros((WIDTH + 2, SUMS), _F)
    rows[:WIDTH, :COMPONENTS], rows[WIDTH, :COMPONENTS], rows[WIDTH + 1, : CONTEXT + BLOCK] = whole["out"], whole["bias"], whole["distance"]
    return rows


def _parts(sums: np.ndarray):
    """The gradients of each table, from rows of SUMS numbers."""
    at = COMPONENTS
    for name, width in TABLES.items():
        yield name, sums[:, at : at + width]
        at += width


def improve(model: Model, ids: np.ndarray, sums: np.ndarray) -> None:
    """The step from the sums that ``_learn`` makes: emissions from expected counts, every weight by its gradient."""
    real = ids >= 0
    expected = np.zeros((len(model.emit), COMPONENTS))
    expected[ids[real]] = sums[real, :COMPONENTS]
    symbols = expected.sum()
    if not symbols:
        return
    rest = dict(zip(ids[~real], sums[~real]))
    whole = {"out": np.stack([rest[-1 - i][:COMPONENTS] for i in range(WIDTH)]), "bias": rest[-1 - WIDTH][:COMPONENTS], "distance": rest[-2 - WIDTH][: CONTEXT + BLOCK]}
    for name in WHOLE:
        model.step(name, None, whole[name] / _F(math.sqrt(symbols)), PASS_STEP)
    for name, part in _parts(sums[real]):
        model.step(name, ids[real], part, PASS_STEP)
    model.set_emissions(expected, unigram(expected.sum(1)))


def _listed(words: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls, several times as fast as to_pylist."""
    _, stops, data = words.buffers()
    if not len(words) or data is None:
        return [b""] * len(words)
    whole, stops = data.to_pybytes(), np.frombuffer(stops, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    return [whole[a:b] for a, b in zip(stops, stops[1:])]


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Piece:
    """Some texts as numbers of words, each text closed by the end (word 0)."""

    def __init__(self, other: list[pa.Array], text: pa.Array, ids: Ids):
        split = pc.ascii_split_whitespace(pc.ascii_lower(text))
        words = split.flatten()
        some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # blanks at either end leave empty ones
        own = split.value_lengths().to_numpy(zero_copy_only=False)
        full = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(own)])]
        coded = words.filter(pa.array(some)).dictionary_encode()
        self.spelt = coded.dictionary.cast(pa.binary())
        known = ids.numbers(_listed(self.spelt))
        at = coded.indices.to_numpy(zero_copy_only=False)
        self.spelling = np.insert(at, full[1:], -1)
        self.other, self.counts = other, np.diff(full) + 1
        self.first = np.cumsum(self.counts) - self.counts
        self.numbers = np.insert(known[at] if len(at) else np.empty(0, np.int64), full[1:], 0)
        self.sizes = ids.size[self.numbers]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.symbols, self.symbol_counts = ids.ids(self.numbers), np.add.reduceat(self.sizes, self.first)
        self.at = np.arange(len(self.numbers)) - np.repeat(self.first, self.counts)
        self.ids = ids

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each block of PHRASE words (the end is a text's last) begins, and a hash of its words and their order."""
        begin = np.flatnonzero(self.at % PHRASE == 0)
        h = self.ids.hashes()[self.numbers] + (self.at % PHRASE).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return begin, np.add.reduceat(h ^ (h >> np.uint64(29)), begin).view(np.int64)

    def texts_of(self, begin: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, begin, "right") - 1


def _pieces(it, ids: Ids, most: int = 1 << 20):
    """Batches, whose last column is a text, in pieces of about ``most`` bytes of it."""
    for batch in it:
        if not len(batch):
            continue
        place = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(batch)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            *other, text = batch.slice(a, b - a).columns
            yield Piece(other, text, ids)


def _count_pairs(path: str):
    """Each task's counts of pairs, by cell."""

    def run(it):
        ids = Ids(path)
        of = buckets(ids.end + 1)
        counts = np.zeros(len(of) * BUCKETS, np.int32)
        for piece in _pieces(it, ids):
            np.add.at(counts, pairs(piece.symbols, of), np.int32(1))
            if len(ids.words) > ids.keep:
                ids.clear()
        hit = np.flatnonzero(counts)
        for k in range(0, len(hit), 1 << 16):
            part = hit[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part], pa.int64())], names=["cell", "n"])

    return tidy(run)


_LEARNED = "id int, sums array<float>, word binary, state int, phrase long, n long"


def _learn(shared, path: str):
    """Each task's sums, rows of three sorts: ids with expected counts and gradients (id -1 to -1 - WIDTH - 2: the weights
    without ids, a row of ``out`` each, bias, distance); words with a state and their count; blocks with their count."""
    types = [pa.int32(), pa.list_(pa.float32()), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _LEARNED.split(", ")]

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def told(ids, sums):
        for k in range(0, len(ids), 4096):
            yield rows(id=ids[k : k + 4096], sums=list(sums[k : k + 4096]))

    def run(it):
        one_thread()
        ids, model = Ids(path), shared.value
        by = np.zeros((len(model.emit), SUMS), _F)
        whole = {name: np.zeros(getattr(model, name).shape) for name in WHOLE}
        seen, blocks, held = np.zeros((1 << 14, COMPONENTS), np.int64), [], 0

        def words():
            hit = np.flatnonzero(seen.reshape(-1))
            for k in range(0, len(hit), 1 << 16):
                part = hit[k : k + (1 << 16)]
                yield rows(word=[ids.words[w] for w in part // COMPONENTS], state=part % COMPONENTS, n=seen.reshape(-1)[part])

        def told_blocks():
            if blocks:
                which, n = np.unique(np.concatenate(blocks), return_counts=True)
                yield rows(phrase=which, n=n)
                blocks.clear()

        for piece in _pieces(it, ids):
            while len(ids.words) > len(seen):
                seen = np.concatenate([seen, np.zeros_like(seen)])
            at, flat = 0, seen.reshape(-1)
            for _, given, target, real, follows in model.slices(piece.symbols, piece.symbol_counts):
                share, gate, tables, rest = model.gradients(given, target, real, follows)
                hit, sums = by_id(given, target, share, tables)
                by[hit] += sums
                for name in WHOLE:
                    whole[name] += rest[name]
                own = np.flatnonzero(real)
                a, b = np.searchsorted(piece.starts, at), np.searchsorted(piece.starts, at + len(own))
                state = gate.reshape(-1, COMPONENTS)[own[piece.starts[a:b] - at]].argmax(1)
                place, n = np.unique(piece.numbers[a:b] * COMPONENTS + state, return_counts=True)
                flat[place] += n
                at += len(own)
            blocks.append(piece.blocks()[1])
            held += len(blocks[-1])
            if len(ids.words) > ids.keep:
                yield from words()
                ids.clear()
                seen[:] = 0
            if held > 1 << 20:
                yield from told_blocks()
                held = 0
        yield from words()
        yield from told_blocks()
        hit = np.flatnonzero(by.any(1))
        yield from told(hit, by[hit])
        yield from told(_REST, _rest_rows(whole))

    return tidy(run)


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, n_subwords long, blocks array<struct<hash:long,own:int,log:double>>, tail array<struct<word:binary,at:int,before:int,state:int,log:float>>"


def copied(at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The copy head's share at a place in a text, and its probability of a word that stands there so many times before."""
    return COPY_SHARE * at / (at + COPY_HALF), before / np.maximum(at, 1)


def earlier(numbers: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How many times each word of a text (by number) stands there before."""
    if not len(numbers):
        return np.empty(0, np.int64)
    key = texts * (int(numbers.max()) + 1) + numbers
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(numbers), np.int64)
    out[order] = np.arange(len(numbers)) - np.repeat(first, np.diff(np.append(first, len(numbers))))
    return out


def drawn(log: np.ndarray, at: np.ndarray, before: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The log10 probability of words: from that of their symbols, their place, how often they stand before, and their
    probability as whole words."""
    share, copy = copied(at, before)
    spelt = (1 - share) * (1 - WORD_SHARE)
    p = share * copy + (1 - share) * WORD_SHARE * whole + spelt * 10.0 ** np.maximum(log, -280)
    # a very long word's probability has no float of its own
    return np.where(p > 1e-270, np.log10(np.maximum(p, 1e-280)), log + np.log10(spelt))


class Words:
    """The frequent words' counts, by state too, as the broadcast has them; total and states are of all training words."""

    def __init__(self, words: list[bytes], n: np.ndarray, by_state: np.ndarray, total: int, norm: float, states: np.ndarray):
        self.place = {w: i for i, w in enumerate(words)}
        # the last row is that of every other word
        self.n, self.by_state = np.append(n, 0).astype(np.int64), np.concatenate([by_state, np.zeros((1, COMPONENTS), by_state.dtype)])
        self.total, self.norm, self.states = max(1, total), norm, states

    def whole(self, rows: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The probability of words (by row) in a state."""
        return (self.by_state[rows, state] + self.n[rows] * (STATE_SMOOTHING / self.total)) / (self.states[state] + STATE_SMOOTHING)


def _score(shared, heads, path: str):
    """Texts to base scores of frequent words, blocks with their scores so far, and the other words with what completes them."""

    def run(it):
        one_thread()
        ids, model, head = Ids(path), shared.value, heads.value
        rid = TaskContext.get().partitionId() << 40
        block = pa.struct([("hash", pa.int64()), ("own", pa.int32()), ("log", pa.float64())])
        rest = pa.struct([("word", pa.binary()), ("at", pa.int32()), ("before", pa.int32()), ("state", pa.int32()), ("log", pa.float32())])
        none, at_head = len(head.n) - 1, np.empty(0, np.int64)
        for piece in _pieces(it, ids):
            at_head = np.concatenate([at_head, np.array([head.place.get(w, none) for w in ids.words[len(at_head) :]], np.int64)])
            symbols, state = model.symbol_logs(piece.symbols, piece.symbol_counts, piece.starts)
            log = np.add.reduceat(symbols.astype(np.float64), piece.starts)
            row, at = at_head[piece.numbers], piece.at
            text = np.repeat(np.arange(len(piece.counts)), piece.counts)
            before = earlier(piece.numbers, text)
            is_tail = (row == none) & (piece.numbers > 0)  # the end is always broadcast
            full = drawn(log, at, before, head.whole(row, state))
            full[is_tail] = 0.0
            base = np.where(is_tail, 0.0, np.log10(head.n[row] + 0.5) - head.norm)
            begin, hashes = piece.blocks()
            block_log, of = np.add.reduceat(full, begin), piece.texts_of(begin)
            held = piece.other[1].to_numpy(zero_copy_only=False)
            _, same, times = np.unique(np.stack([of, hashes], 1), axis=0, return_inverse=True, return_counts=True)
            own = np.where(held[of], 0, times[same.reshape(-1)])
            per = -(-piece.counts // PHRASE)
            n = len(piece.counts)
            told = [np.arange(rid, rid + n), piece.counts, np.add.reduceat((head.n[row] > 0).astype(np.int64), piece.first), np.add.reduceat(base, piece.first), piece.symbol_counts]
            rid += n
            blocks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.StructArray.from_arrays([pa.array(hashes), pa.array(own, pa.int32()), pa.array(block_log)], fields=list(block)))
            hit = np.flatnonzero(is_tail)
            tails = pa.StructArray.from_arrays([piece.spelt.take(pa.array(piece.spelling[hit])), *(pa.array(x[hit], t) for x, t in ((at, pa.int32()), (before, pa.int32()), (state, pa.int32()), (log, pa.float32())))], fields=list(rest))
            tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(is_tail.astype(np.int64), piece.first))), pa.int32()), tails)
            rids, counts, known, sums, subwords = (pa.array(x) for x in told)
            yield pa.RecordBatch.from_arrays([rids, *piece.other, counts, known, sums, subwords, blocks, tail], names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "n_subwords", "blocks", "tail"])
            if len(ids.words) > ids.keep:
                ids.clear()
                at_head = np.empty(0, np.int64)

    return tidy(run)


def head_limit(counts: DataFrame, head: int = HEAD) -> int:
    """The least count at which at most ``head`` words are left, among powers of 2 ** (1/8); a few hundred rows are collected."""
    step = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, limit = 0, (1 << 62)
    for r in rows:
        total += r["words"]
        if total > head:
            break
        limit = r["least"]
    return limit


def vocabulary(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, VOCABULARY)


def score_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The operator: per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    spark = docs.sparkSession
    path = path or vocabulary(spark)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    raw = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model, counts, blocks = fit(raw.where(~F.col("held_out")), path)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    norm = math.log10(total["n"] + 0.5 * (total["v"] + 1))
    limit = head_limit(counts)
    shared = spark.sparkContext.broadcast(model)
    heads = spark.sparkContext.broadcast(_head(counts, limit, total["n"], norm))
    scored = stash(batches(raw).mapInArrow(_score(shared, heads, path), _SCORED), "lm-scored")
    return _completed(scored, counts.where(F.col("n") < limit), blocks, heads.value, total["n"])


def _head(counts: DataFrame, limit: int, total: int, norm: float) -> Words:
    """The words of at least limit, and the end: at most about HEAD words by COMPONENTS numbers come to the driver."""
    states = np.zeros(COMPONENTS)
    for r in counts.select(F.inline("by_state")).groupBy("state").agg(F.sum("times").alias("n")).collect():
        states[r["state"]] = r["n"]
    top = counts.where((F.col("n") >= limit) | (F.col("word") == F.lit(END_WORD))).select("word", "n", F.col("by_state.state").alias("s"), F.col("by_state.times").alias("t")).toArrow()
    s, t = (top.column(c).combine_chunks() for c in ("s", "t"))
    by_state = np.zeros((len(top), COMPONENTS), _F)
    rows = np.repeat(np.arange(len(top)), s.value_lengths().to_numpy(zero_copy_only=False)) if len(top) else np.empty(0, np.int64)
    by_state[rows, s.flatten().to_numpy(zero_copy_only=False)] = t.flatten().to_numpy(zero_copy_only=False)
    return Words([bytes(w) for w in top.column("word").to_pylist()], top.column("n").to_numpy(), by_state, total, norm, states)


def _completed(scored: DataFrame, rare: DataFrame, blocks: DataFrame, head: Words, total: int) -> DataFrame:
    """The rows of the operator: rare words with their counts, blocks with theirs."""
    states = F.array(*(F.lit(float(x)) for x in head.states))
    tail = scored.select("rid", F.inline("tail")).join(rare.select(F.col("word").alias("w"), "n", "by_state"), F.col("word") == F.col("w"), "left")
    n = F.coalesce("n", F.lit(0))
    here = F.coalesce(F.get("by_state.times", F.array_position("by_state.state", F.col("state")).cast("int") - 1), F.lit(0))  # a state is there once
    whole = (here + n * (STATE_SMOOTHING / max(1, total))) / (F.get(states, F.col("state")) + STATE_SMOOTHING)
    share = F.lit(COPY_SHARE) * F.col("at") / (F.col("at") + COPY_HALF)
    spelt = (1 - share) * (1 - WORD_SHARE)
    p = share * F.col("before") / F.greatest("at", F.lit(1)) + (1 - share) * WORD_SHARE * whole + spelt * F.pow(F.lit(10.0), F.greatest(F.col("log").cast("double"), F.lit(-280.0)))
    full = F.when(p > 1e-270, F.log10(p)).otherwise(F.col("log").cast("double") + F.log10(spelt))
    none = F.lit(None)
    words = tail.select("rid", F.floor(F.col("at") / PHRASE).cast("int").alias("block"), none.cast("long").alias("hash"), none.cast("int").alias("own"), full.alias("log"), F.col("n").isNotNull().cast("long").alias("more"), (F.log10(n + 0.5) - F.lit(head.norm)).alias("rest"))
    made = scored.select("rid", F.posexplode("blocks").alias("block", "b")).select("rid", "block", "b.*", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("rest"))
    # dealt before they are summed: words come in the order of their join, where no two of a block meet
    made = made.unionByName(words).repartition("rid", "block").groupBy("rid", "block").agg(F.max("hash").alias("hash"), F.max("own").alias("own"), *(F.sum(c).alias(c) for c in ("log", "more", "rest")))
    known = blocks.select(F.col("phrase").alias("h"), F.col("n").alias("times"))
    made = made.join(known, F.col("hash") == F.col("h"), "left")
    every = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    other = F.greatest(F.coalesce("times", F.lit(0)) - F.col("own"), F.lit(0)) / float(max(1, every))
    a, b = F.col("log") + math.log10(1 - PHRASE_SHARE), F.log10(other * PHRASE_SHARE)
    high, low = F.greatest(a, b), F.least(a, b)
    both = F.when(other > 0, high + F.log10(1 + F.pow(F.lit(10.0), low - high))).otherwise(a)
    made = made.withColumn("log", both).groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("log", "more", "rest")))
    return scored.drop("blocks", "tail").join(made, "rid").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest")).alias("base_score"), F.col("log").alias("score"), "n_subwords",
    )


def fit(learn: DataFrame, path: str) -> tuple[Model, DataFrame, DataFrame]:
    """Of training texts (doc_id, text): the model, their word counts (word, n, by_state), and their blocks (phrase, n)."""
    spark = learn.sparkSession
    context = spark.sparkContext
    # a task's sums are as large as the vocabulary, so a task takes several splits where there are more than the cluster works on at once
    raw = learn.select("text")
    parts = raw.rdd.getNumPartitions()
    raw = batches(raw.coalesce(max(1, min(parts, max(2 * context.defaultParallelism, -(-parts // 8))))))
    found = raw.mapInArrow(_count_pairs(path), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(found.column("cell").to_numpy())
    model = started(encoder(path)[1] + 1, found.column("cell").to_numpy()[order].astype(np.int64), found.column("n").to_numpy()[order])
    del found, order
    shared = context.broadcast(model)
    made = stash(raw.mapInArrow(_learn(shared, path), _LEARNED), "lm-learned")
    shared.unpersist()
    names = [f"c{c}" for c in range(SUMS)]
    sums = made.where("id is not null").select("id", *(F.get("sums", F.lit(c)).alias(f"c{c}") for c in range(SUMS)))
    found = sums.groupBy("id").agg(*(F.sum(c).cast("float").alias(c) for c in names)).toArrow()
    improve(model, found.column("id").to_numpy(), np.stack([found.column(c).to_numpy() for c in names], 1) if len(found) else np.zeros((0, SUMS), _F))
    # one sum a state: lists of states would be collected by a sort of all rows
    words = made.where("word is not null").select("word", "state", "n").repartition("word").groupBy("word")
    words = words.agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col("state") == k, F.col("n"))), F.lit(0)).alias(f"s{k}") for k in range(COMPONENTS)))
    by_state = F.array(*(F.struct(F.lit(k).alias("state"), F.col(f"s{k}").alias("times")) for k in range(COMPONENTS)))
    counts = stash(words.select("word", "n", F.filter(by_state, lambda x: x["times"] > 0).alias("by_state")), "lm-counts")
    blocks = stash(made.where("phrase is not null").groupBy("phrase").agg(F.sum("n").alias("n")), "lm-blocks")
    discard(made)
    return model, counts, blocks


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
