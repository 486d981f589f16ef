import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import interval_search as iv
from tests.llm.common import documents, empty, frame, odd, rows
from tests.oracle import compare, database

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k=20):
    found = [(r.doc_id, collections.Counter(terms_of(r.text))) for r in docs.select("doc_id", "text").collect()]
    n_docs, length = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    want = []
    for r in queries.select("item_id", "text").collect():
        asked, scored = collections.Counter(terms_of(r.text)), []
        for i, c in found:
            if not c:
                continue
            m, score = 100 - 25 + (25 * sum(c.values()) * n_docs) // length, 0
            for t, times in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        want += [(r.item_id, at, x[3], -x[0]) for at, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(want, key=repr)


def items(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "item_id long, text string")


@pytest.mark.parametrize("shard,leaf,block", [(1 << 18, 2048, 200_000), (500, 8, 200_000), (3000, 0, 700)])
def test_agrees_with_brute_force(spark, data, monkeypatch, shard, leaf, block):
    """Whatever the size of shards, intervals and blocks of queries."""
    monkeypatch.setattr(iv, "SHARD", shard)
    monkeypatch.setattr(iv.Shard.search, "__defaults__", (1, leaf))
    docs, queries = documents(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    got = iv.search(docs, queries, block_terms=block)
    assert rows(got, *got.columns) == brute(docs, queries)


def test_agrees_with_sql(spark, data):
    got = iv.search(documents(spark, data), spark.read.parquet(f"{data}/benchmark.parquet"))
    assert compare(got, database(data), iv.SQL) is None


def test_odd_rows(spark):
    docs = odd(spark)
    queries = items(spark, ["The of straße ÉTÉ", None, "", "the the THE word", "nothing-known", "common1 own words", "한글 漢字 '"], [1, 2, 3, 4, 5, None, 4])
    queries = queries.withColumn("q", F.lit(3)).withColumn("doc_id", F.lit("x"))
    got = iv.search(docs, queries)
    assert rows(got, *got.columns) == brute(docs, queries)
    assert iv.search(empty(spark), queries).count() == 0
    assert iv.search(docs, queries.limit(0)).count() == 0
    assert iv.search(docs, items(spark, [None, "-"])).count() == 0


def test_ties_and_copies(spark):
    """Equal scores go by id, within a shard, over shards and over tasks."""
    docs = frame(spark, ["alpha beta"] * 300 + ["alpha"], ids=[*range(300, 0, -1), 999]).repartition(7)
    queries = items(spark, ["beta beta alpha", "alpha"])
    got = iv.search(docs, queries, k=5)
    assert rows(got, *got.columns) == brute(docs, queries, 5)
    assert [r.doc_id for r in got.filter("item_id = 0").orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_string_keys(spark):
    docs = frame(spark, ["one two", "two", "three"]).withColumn("name", F.concat(F.lit("d"), "doc_id"))
    got = iv.search(docs, items(spark, ["two"]), keep="name").orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["d2", "d1"]


def test_range_maxima_and_bounds():
    """The table gives the largest impact of any range, and a search visits few documents if impacts differ."""
    rng = random.Random(4)
    term = np.sort(np.array([rng.randrange(6) for _ in range(4000)]))
    doc = np.concatenate([np.sort(rng.sample(range(5000), int((term == t).sum()))) for t in range(6)])
    impact = np.array([rng.randrange(1, 1000) ** 3 for _ in term])
    shard = iv.Shard(term, doc, impact, 6)
    for _ in range(300):
        t = rng.randrange(6)
        lo = rng.randrange(shard.first[t], shard.first[t + 1])
        hi = rng.randrange(lo + 1, shard.first[t + 1] + 1)
        assert impact[shard.largest(np.array([lo]), np.array([hi]))[0]] == impact[lo:hi].max()
    want = collections.Counter()
    for t, d, i in zip(term, doc, impact):
        if t in (1, 4):
            want[int(d)] += int(i) * (1 if t == 1 else 3)
    best = sorted(((s, d) for d, s in want.items()), key=lambda x: (-x[0], x[1]))[:7]
    taken = []
    inner, shard.largest = shard.largest, lambda lo, hi: taken.append(1) or inner(lo, hi)
    assert shard.search(np.array([1, 4]), np.array([1, 3]), 7, leaf=0) == best
    assert len(taken) < len(want) / 3


def test_terms_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(iv.spans, "span_hashes", lambda data, starts, ends, base=0: np.asarray(ends - starts, dtype=np.uint64))
    known = iv.Vocabulary(["ab", "xyz"])
    data, starts, ends, _ = iv._terms(iv.pa.array(["AB cd xyz xyy ab"]))
    where, term = known.find(data, starts, ends)
    assert where.tolist() == [0, 2, 4] and term.tolist() == [0, 1, 0]
