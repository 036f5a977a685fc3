"""Near-duplicate detection by b-bit MinHash (operator 4).

A document's set is that of its distinct ``words``-word shingles (lower-cased A-Z); a document with fewer words has one
shingle, its whole sequence; without words it has none and is linked with nothing. Two documents are linked if their
sets' Jaccard similarity is at least PERCENT / 100.

1. Band keys (numpy over Arrow batches): ROWS * BANDS minima of multiply-add hashes; each band's ROWS minima give a
   64-bit key.
2. Documents with equal sets, told by a 128-bit digest, are one class. Classes that share no bucket with another are
   done; the others are numbered, and everything below works on numbers.
3. The numbered classes' texts are read again for HASHES minima. These give FINE_BANDS keys of FINE_ROWS minima, which
   dissimilar texts seldom share even if they have a passage in common; and the low BITS bits of each (mixed) minimum
   are packed into longs: the b-bit signature. Every fine bucket names one of its classes its pivot, and each class is
   compared with the pivot with which it shares most buckets: one pair a class, not quadratic in a bucket's size.
4. A comparison first estimates the similarity from the packed bits: the share of equal BITS-bit groups, corrected for
   chance agreement, by counting bits. Only pairs that could be similar (within 4.5 standard errors) are confirmed on
   the full sets. Pairs are numbers until then; each gets its two signatures, and later its two sets, once.
5. Confirmed links are joined into components by label propagation with pointer jumping. Buckets whose classes still
   have different labels stay open. In them, the classes outside a bucket's largest label are compared by signature with
   all its classes of other labels, in blocks of at most BLOCK by BLOCK that spread over tasks; a pair counts in the
   first bucket that both share. First only each class's likeliest partner is confirmed; then, in the buckets that are
   still open after that, all likely pairs of different components. So no link that any band proposes is lost.

At a similarity of 0.8 a pair meets in no band with probability (1 - 0.8**4)**24 = 3e-6, in no fine band with
probability (1 - 0.8**8)**96 = 2e-8, and less above (chance agreement of bits only adds candidates).

Between steps, tables are written in the shared folder, and removed when they are no longer read. No group is gathered
in one task: buckets and classes are met by joins, which adaptive execution splits where a key is hot, components by
joins with a salt, and aggregates combine before the shuffle. What is broadcast are bitmaps of 2**FILTER_BITS bits,
whatever the number of rows: they keep sets and texts that no pair needs from being read or shuffled.

Nulls: a null text is empty. A null doc_id counts as a document of its own kind: it stays unlinked and kept. Rows with
one doc_id and different texts are separate rows of the graph that share an id; repeated rows are exact copies (equal
rows get equal results, so all copies of the smallest doc_id are kept). Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, stash, texts

PERCENT = 80
BANDS, ROWS, BITS = 24, 4, 4
FINE_BANDS, FINE_ROWS = 96, 8
HASHES = 2 * FINE_BANDS * FINE_ROWS
#: 4.5 standard errors below the threshold: 0.8 - 4.5 * sqrt(p * (1 - p) / HASHES) / (1 - 1/16), p = 0.8125.
LEAST_ESTIMATE = 0.752
BLOCK = 512
FILTER_BITS = 24
#: A component's members are spread over so many join keys.
SALTS = 16

_U = np.uint64
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) << _U(1)) | _U(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Shingler:
    """Texts (bytes) to sets of 64-bit shingle hashes; a word's hash is kept for later texts, within bounds."""

    def __init__(self, words: int, keep: int = 400_000):
        self.words, self.keep, self.seen = words, keep, {}

    def __call__(self, text: bytes) -> np.ndarray:
        found = text.lower().split()  # bytes: A-Z and the six blanks only
        if not found:
            return np.empty(0, np.uint64)
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > self.keep:
            seen.clear()
        for w in set(found).difference(seen):
            seen[w] = digest(w)
        h = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(h))
        out = h[: len(h) - n + 1]
        for k in range(1, n):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(_mix(out + _U(n)))


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The first n hashes' minima of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), n), np.uint64)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(flat * _MUL[i] + _ADD[i], starts)
    return out


def _keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), bands))
    for r in range(rows):
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + minima[:, r * bands : (r + 1) * bands])
    return keys.view(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """int64, sets x BANDS."""
    return _keys(_minima(sets, BANDS * ROWS), BANDS, ROWS)


def packed_bits(sets: list[np.ndarray]) -> np.ndarray:
    """The packed signature: int64, sets x HASHES * BITS / 64; its first 32-bit halves, low ones first, are the fine bands."""
    low = _mix(_minima(sets, HASHES) + _U(0x51ED27)) & _U((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per, dtype=np.uint64) * _U(BITS))[None, None, :]
    return np.bitwise_or.reduce(low.reshape(len(sets), HASHES // per, per) << shifts, axis=2).view(np.int64)


def _fine_keys(sig: Column) -> Column:
    """Of a packed signature: each 32-bit word under its place."""
    sig = F.slice(sig, 1, FINE_BANDS // 2)
    low = F.transform(sig, lambda x, i: x.bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftleft((i * 2).cast("long"), 32))
    high = F.transform(sig, lambda x, i: F.shiftrightunsigned(x, 32) + F.shiftleft((i * 2 + 1).cast("long"), 32))
    return F.concat(low, high)


_NIBBLE = _U(0x1111111111111111)


def _compare_blocks(best: bool):
    return lambda it: _compared(it, best)


def _compared(it, best: bool):
    """Rows (key, chunk, block, num, label, query, sig) sorted by the first three: likely pairs (a asks) with their estimates; of
    each asking row and block the likeliest one if best."""
    held: list = []
    for batch in it:
        held.append(batch)
        table = pa.Table.from_batches(held)
        k = [table.column(c).to_numpy() for c in range(3)]
        cut = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
        if len(cut):
            yield from _compare(table.slice(0, cut[-1]), np.concatenate([[0], cut]), best)
            held = table.slice(cut[-1]).to_batches()
    if held and sum(map(len, held)):
        table = pa.Table.from_batches(held)
        yield from _compare(table, np.array([0, len(table)]), best)


def _compare(table: pa.Table, bounds: np.ndarray, best: bool):
    key, num, label, query = (table.column(c).to_numpy() for c in (0, 3, 4, 5))
    sig = np.array(table.column(6).combine_chunks().flatten()).view(np.uint64).reshape(len(table), -1)
    words = sig[:, : FINE_BANDS // 2].copy().view(np.uint32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        ask = np.flatnonzero(query[a:b] == 1) + a
        rest = np.flatnonzero(query[a:b] != 1) + a
        if not len(ask) or not len(rest):
            continue
        band = int(key[a]) >> 32
        for q in ask:
            other = label[rest] != label[q]
            y = rest[other if best else other & ((query[rest] == 0) | (num[rest] > num[q]))]  # of two that ask, one
            y = y[(words[y] == words[q]).argmax(1) == band]
            if len(y):
                d = sig[y] ^ sig[q]
                d |= d >> _U(1)
                d |= d >> _U(2)
                about = ((HASHES - np.bitwise_count(d & _NIBBLE).sum(1)) / HASHES - 1 / 16) / (15 / 16)
                near = np.flatnonzero(about >= LEAST_ESTIMATE)
                if best and len(near):
                    near = np.array([about.argmax()])
                if len(near):
                    out.append((np.full(len(near), num[q]), num[y[near]], about[near]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b", "e"])


def _likely_pairs(members: DataFrame, sig: DataFrame, best: bool) -> DataFrame:
    """Of open buckets (key, num, label): every likely pair (a, b) of different labels, or each asking class's likeliest."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    sizes = sizes.select(F.col("key").alias("k"), F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("chunks"))
    df = members.join(sizes, F.col("key") == F.col("k"))
    asks = F.col("label") != F.col("main")
    own = F.xxhash64("num", F.lit(-1))
    places = lambda n, make: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), make)
    deal = lambda chunk, block, role: F.struct(chunk.alias("chunk"), block.alias("block"), role.alias("role"))
    # role 1 asks; roles 0 (of the main label) and 2 (that ask elsewhere) answer
    ask = places(F.col("blocks"), lambda k: deal(F.pmod(own, F.col("chunks")), k, F.lit(1)))
    answer = places(F.col("chunks"), lambda k: deal(k, F.pmod(own, F.col("blocks")), F.when(asks, 2).otherwise(0)))
    df = df.select("key", "num", "label", F.explode(F.when(asks, F.concat(ask, answer)).otherwise(answer)).alias("d"))
    df = df.join(sig.withColumnRenamed("num", "c"), F.col("num") == F.col("c"))
    dealt = df.select("key", "d.chunk", "d.block", "num", "label", "d.role", "sig").repartition("key", "chunk", "block").sortWithinPartitions("key", "chunk", "block")
    found = batches(dealt).mapInArrow(_compare_blocks(best), "a long, b long, e double")
    if best:
        found = found.groupBy("a").agg(F.max(F.struct("e", "b"))["b"].alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_SIGNATURE_SCHEMA = "doc_id long, n_shingles long, cls binary, bands array<long>"


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _pieces(it, most: int = 1 << 20):
    """(ids, texts) in pieces of about ``most`` bytes of text."""
    for batch in it:
        ids, found, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            found.append(t)
            size += len(t)
            if size >= most:
                yield ids, found
                ids, found, size = [], [], 0
        if ids:
            yield ids, found


def _sign(words: int):
    def run(it):
        shingler = Shingler(words)
        longs = pa.list_(pa.int64())
        for ids, found in _pieces(it):
            sets = [shingler(t) for t in found]
            full = [k for k, s in enumerate(sets) if len(s)]
            cls, bands = [None] * len(ids), [None] * len(ids)
            if full:
                for k, keys in zip(full, band_keys([sets[k] for k in full])):
                    cls[k], bands[k] = _digest(sets[k]), keys
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, longs)], names=["doc_id", "n_shingles", "cls", "bands"])

    return run


def _sets(words: int):
    longs = pa.list_(pa.int64())

    def run(it):
        shingler, seen = Shingler(words), set()
        for _, found in _pieces(it):
            sets = {_digest(s): s for s in map(shingler, found) if len(s)}
            sets = {d: s for d, s in sets.items() if d not in seen}  # copies in one task: once
            seen.update(sets)
            if len(seen) > 1 << 18:
                seen.clear()
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(list(packed_bits(list(sets.values()))), longs), pa.array([s.view(np.int64) for s in sets.values()], longs)], names=["cls", "sig", "shingles"])

    return run


def _confirm(it):
    """Of pairs with their sets, those that are similar enough."""
    for batch in it:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two packed signatures tell: equal BITS-bit groups, less those expected by chance."""

    def differ(x, y):
        d = x.bitwiseXOR(y)
        for shift in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    same = F.lit(HASHES) - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return (same / HASHES - chance) / (1 - chance)


def _salted(rows: DataFrame, key: str, by: str, small: DataFrame) -> DataFrame:
    """rows left-joined with small (k, and what it gives a key) on key = k; rows of one key are spread over SALTS places by the column by."""
    spread = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = rows.withColumn("_place", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, (F.col(key) == F.col("k")) & (F.col("_place") == F.col("_salt")), "left").drop("k", "_salt", "_place")


def components(edges: DataFrame) -> DataFrame:
    """(num, label) of every node of undirected edges (a, b): equal labels within a component, by the least node."""
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("num"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["num"]).groupBy("a").agg(F.min("label").alias("m"))
        new = stash(labels.join(near, labels["num"] == near["a"]).select("num", F.col("label").alias("old"), F.least("label", "m").alias("label")), "cc-near")
        # only labels that moved are asked for: where each of them points now
        asked = new.where("label <> old").groupBy("label").agg(F.count("*").alias("_n"))
        jump = new.select(F.col("num").alias("c"), F.col("label").alias("further"))
        jump = asked.join(jump, F.col("label") == F.col("c")).where("further < label").select(F.col("label").alias("k"), "further")
        after = stash(_salted(new, "label", "num", jump).select("num", "old", F.coalesce("further", "label").alias("label")), "cc-labels")
        changed = after.where("label <> old").limit(1).count()
        discard(labels, new)
        labels = after
        if not changed:
            discard(both)
            return labels.select("num", "label")


def near_duplicates(docs: DataFrame, words: int = 5, name: str = "minhash") -> DataFrame:
    """The operator: per row doc_id, n_shingles, component_id (the smallest doc_id of its component) and kept."""
    raw = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    signed = stash(batches(raw).mapInArrow(_sign(words), _SIGNATURE_SCHEMA), f"{name}-signed")
    real = signed.where("cls is not null and doc_id is not null")
    tag = F.xxhash64("cls")
    needed = _meeting(real.select(tag.alias("num"), F.explode("bands").alias("key"))).select(F.col("num").alias("tag")).distinct()
    first = real.groupBy("cls").agg(F.min("doc_id").alias("first"))
    info = stash(first.join(needed, tag == F.col("tag")).select("cls", "first", F.monotonically_increasing_id().alias("num")), f"{name}-classes")
    links = _links(docs, words, info, name)
    rows = real.select("doc_id", "n_shingles", "cls")
    if links is None:
        found = first
    else:
        linked = info.join(links, "num").select("cls", "num", "first", "label")
        least = linked.groupBy("label").agg(F.min("first").alias("least")).withColumnRenamed("label", "k")
        moved = _salted(linked, "label", "num", least).select(F.col("cls").alias("c"), F.col("least"))
        found = first.join(moved, F.col("cls") == F.col("c"), "left").select("cls", F.coalesce("least", "first").alias("first"))
    found = rows.join(found, "cls").select("doc_id", "n_shingles", F.col("first").alias("component_id"))
    alone = signed.where("cls is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _meeting(buckets: DataFrame) -> DataFrame:
    """Of (num, key), the distinct rows of keys that hold at least two numbers."""
    several = buckets.groupBy("key").agg(F.min("num").alias("lo"), F.max("num").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    return buckets.join(several, F.col("key") == F.col("k")).select("key", "num").distinct()


def _may_be_in(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the keys of wanted, and some more by chance, without a shuffle of rows.

    The keys are marked in a bitmap of 2**FILTER_BITS bits, whatever their number (at most 2**(FILTER_BITS - 6) rows of
    two longs are broadcast); rows that pass by chance cost time, not correctness.
    """
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    marks = wanted.select(place(key).alias("_q")).select(F.shiftrightunsigned("_q", 6).alias("_word"), bit("_q").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_marks"))
    placed = rows.withColumn("_p", place(column))
    hit = placed.join(F.broadcast(marks), F.shiftrightunsigned("_p", 6) == F.col("_word"))
    return hit.where(F.col("_marks").bitwiseAND(bit("_p")) != 0).select(*rows.columns)


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of both classes, as one and two; pairs is a written table."""
    side = lambda k, out: _may_be_in(sets.select("num", column), "num", pairs, k).select(F.col("num").alias(f"_{k}"), F.col(column).alias(out))
    return pairs.select("a", "b").join(side("a", "one"), F.col("a") == F.col("_a")).join(side("b", "two"), F.col("b") == F.col("_b")).select("a", "b", "one", "two")


def _links(docs: DataFrame, words: int, info: DataFrame, name: str) -> DataFrame | None:
    """(num, label) of all classes that have a link, or None if no bucket holds two classes; info: cls, first doc_id and num."""
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    made = batches(_may_be_in(rows, "doc_id", info, "first")).mapInArrow(_sets(words), "cls binary, sig array<long>, shingles array<long>")
    sets = stash(made.join(info.select("cls", "num"), "cls").dropDuplicates(["cls"]).select("num", "sig", "shingles"), f"{name}-sets")
    active = stash(_meeting(sets.select("num", F.explode(_fine_keys(F.col("sig"))).alias("key"))), f"{name}-active")
    if not active.limit(1).count():
        discard(sets, active)
        return None

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = stash(pairs, f"{name}-likely")
        found = stash(batches(_with_both(pairs, sets, "shingles")).mapInArrow(_confirm, "a long, b long"), f"{name}-links")
        discard(pairs)
        return found

    # round one: each class with the pivot that it shares most buckets with
    ends = active.groupBy("key").agg(F.min("num").alias("pivot")).withColumnRenamed("key", "k")
    met = active.join(ends, F.col("key") == F.col("k")).where("num <> pivot").groupBy("num", "pivot").agg(F.count("*").alias("n"))
    top = met.groupBy("num").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("pivot"))
    near = stash(top.select(F.least("num", "pivot").alias("a"), F.greatest("num", "pivot").alias("b")).distinct(), f"{name}-pivots")
    edges = confirmed(_with_both(near, sets, "sig").where(estimate(F.col("one"), F.col("two")) >= LEAST_ESTIMATE).select("a", "b"))

    def still_open(members: DataFrame, edges: DataFrame) -> DataFrame:
        labels = components(edges).withColumnRenamed("num", "c")
        labelled = members.join(labels, F.col("num") == F.col("c"), "left").select("key", "num", F.coalesce("label", "num").alias("label"))
        mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
        return stash(labelled.join(mixed, F.col("key") == F.col("k")).select("key", "num", "label"), f"{name}-open")

    sig = sets.select("num", "sig")
    opened = still_open(active, edges)
    more = confirmed(_likely_pairs(opened, sig, best=True))
    again = still_open(opened.select("key", "num"), edges.unionByName(more))
    rest = confirmed(_likely_pairs(again, sig, best=False))
    labels = components(edges.unionByName(more).unionByName(rest))
    discard(sets, active, near, opened, again, edges, more, rest)
    return labels


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


#: DuckDB SQL for op4_minhash: all pairs that share a shingle, confirmed, then the least doc_id that can be reached.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
f AS (SELECT * FROM e WHERE g IN (SELECT g FROM e GROUP BY g HAVING count(*) > 1)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM f x JOIN f y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n_shingles + y.n_shingles - both_n)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""
