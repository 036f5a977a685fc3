"""The pipeline against brute force, stage by stage, on a small table."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tickloom.llm import packing, quality
from tickloom.llm.common import stash


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(stash(f(spark, out[-1], sf), "test-stage"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_columns(stages):
    assert [name for name, _ in P.STAGES] and all(s.columns == P.COLUMNS for s in stages[:5])
    for s in stages[1:5]:
        assert s.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_cleaning_takes_effect(stages):
    kept = {r.doc_id: r.clean_text for r in quality.clean_lines(stages[0]).where("kept").collect()}
    assert texts(stages[1]) == kept and len(kept) < stages[0].count()


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {i: shingles(t) for i, t in before.items()}
    group = {i: i for i in before}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert set(after) == {i for i in before if root(i) == i} and all(after[i] == before[i] for i in after)


def test_redaction_keeps_documents(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after) and any("[" in after[i] and after[i] != before[i] for i in after)
    assert not any("@" in t and ".example.com" in t for t in after.values())


def test_mix_is_near_its_targets(stages):
    before, after = texts(stages[3]), stages[4].collect()
    assert all(r.text == before[r.doc_id] for r in after)
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    words, biggest = defaultdict(int), defaultdict(int)
    for r in after:
        words[r.source] += len(r.text.split())
    size = defaultdict(int)
    for r in stages[3].collect():
        size[r.source] += len(r.text.split())
        biggest[r.source] = max(biggest[r.source], len(r.text.split()))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    left, level, capped = dict(size), None, set()
    while level is None or any(level * weight[s] > 3 * size[s] for s in left if s not in capped):
        if level is not None:
            capped |= {s for s in left if level * weight[s] > 3 * size[s]}
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in left if s not in capped)
    for s in size:
        assert abs(words[s] - (3 * size[s] if s in capped else level * weight[s])) <= biggest[s] / 2 + 1


def test_every_copy_is_packed(stages):
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter(r.doc_id for r in stages[5].collect())
    assert stages[5].where("n_tokens > bucket_tokens").count() == 0 and stages[5].select("bucket").distinct().count() <= packing.BUCKETS


def test_odd_rows(spark, sf):
    """Null and empty texts go; a row without doc_id stays; of one doc_id with two texts one stays; a long text stays whole."""
    prose = "Words that stand here are many, more than twenty of them, so that this line is kept by the rules about length, as it should be, {}."
    long = " ".join(f"w{k}." for k in range(30_000))
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (None, prose.format("with no id"), "en", "s", 1), (4, long, None, "s", 2), (5, prose.format("of a kind") + " Here are more.", "en", None, 3), (5, prose.format("in another form") + " As it was.", "en", None, 4), (6, long, "en", "t", 5), (6, long, "en", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1))
    want = [Counter([None, 4, 5, 5, 6, 6]), Counter([None, 4, 5]), Counter([None, 4, 5])]
    d = docs
    for k, (_, f) in enumerate(P.STAGES):
        d = stash(f(spark, d, sf), "odd")
        got = Counter(r.doc_id for r in d.select("doc_id").collect())
        if k < 3:
            assert got == want[k], P.STAGES[k][0]
            assert {r.doc_id: r.text for r in d.collect()}[4] == long
        elif k == 3:  # copies of whole documents; one of which less than half is taken does not come
            assert got and set(got) <= {None, 4, 5} and max(got.values()) <= 3
            mixed = got
        else:
            assert got == mixed
    empty = docs.where("false")
    for k, (_, f) in enumerate(P.STAGES):
        empty = stash(f(spark, empty, sf), "odd")
        assert empty.count() == 0 and (k == 4 or empty.columns == P.COLUMNS)
