import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import weighted_minhash as wm
from rowloom.llm.components import components
from tests.llm.common import documents, empty, frame, odd, rows


def shingle_counts(text):
    w = (text or "").encode().split()
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(pairs_of, threshold=0.8):
    """Class id by id, links by id; ids are unique."""
    sets = {i: shingle_counts(t) for i, t in pairs_of}
    df = collections.Counter(s for c in sets.values() for s in c)
    weight = {i: {s: n * (1 + math.log(len(sets) / df[s])) for s, n in c.items()} for i, c in sets.items()}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(frozenset(sets[i].items()), i)
    rep = {i: first[frozenset(c.items())] if c else i for i, c in sets.items()}
    root, links = dict(rep), collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    reps = [i for i in sorted(set(rep.values())) if sets[i]]
    for k, a in enumerate(reps):
        for b in reps[:k]:
            both = sum(min(weight[a][s], weight[b][s]) for s in weight[a].keys() & weight[b].keys())
            if both and both / (sum(weight[a].values()) + sum(weight[b].values()) - both) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(rep[i]) for i in sets}, {i: links[rep[i]] for i in sets}


def test_agrees_with_all_pairs(spark, data):
    docs = documents(spark, data)
    got = wm.near_duplicates(docs)
    want, links = brute([(r.doc_id, r.text) for r in docs.collect()])
    size = collections.Counter(want.values())
    assert rows(got, "doc_id", "class_id", "class_size") == sorted(((i, c, size[c]) for i, c in want.items()), key=repr)
    assert all(n <= links[i] for i, n in rows(got, "doc_id", "n_links"))


def test_a_large_group_of_near_copies_is_one_class(spark):
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(90):
        w = list(base)
        for j in range(2):
            w[(i * 3 + j * 151) % 300] = f"new{i}x{j}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 40 + [" ".join(f"c{i}x{j}" for j in range(50)) for i in range(60)]
    docs = frame(spark, texts)
    got = dict(rows(wm.near_duplicates(docs), "doc_id", "class_id"))
    assert {got[i] for i in range(1, 131)} == {1}
    assert all(got[i] == i for i in range(131, 191))
    kept = wm.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, *range(131, 191)]


@pytest.mark.parametrize("block", [512, 20])
def test_clusters_and_chains_of_one_large_bucket(spark, monkeypatch, block):
    """All texts share a band: two clusters of over 32 texts, a chain in which only neighbours are alike, and others."""
    real = wm.signatures
    one_band = F.when(F.col("sig").isNotNull(), F.concat(F.array(*[F.lit(1).cast("long")] * wm.ROWS), F.slice("sig", wm.ROWS + 1, wm.SAMPLES)))
    monkeypatch.setattr(wm, "signatures", lambda *a: real(*a).withColumn("sig", one_band))
    monkeypatch.setattr(wm, "BLOCK", block, raising=False)

    def edited(name, i):
        w = [f"{name}{j}" for j in range(200)]
        w[i * 4 + 2] = f"{name}new{i}"
        return " ".join(w)

    texts = [edited("a", i) for i in range(40)] + [edited("b", i) for i in range(45)]
    texts += [" ".join(f"c{j}" for j in range(i * 18, i * 18 + 180)) for i in range(50)]
    texts += [" ".join(f"d{i}x{j}" for j in range(30)) for i in range(12)] + ["five words five words five words five words"]
    got = wm.near_duplicates(frame(spark, texts))
    want, links = brute(list(enumerate(texts, 1)))
    # the two ends of the chain stand alone: what only they hold weighs most
    assert len(set(want.values())) == 18 and max(links[i] for i in range(86, 136)) == 2
    assert rows(got, "doc_id", "class_id", "n_links") == sorted(((i, c, links[i]) for i, c in want.items()), key=repr)


def test_block_similarities_agree_with_pairs():
    texts = ["a b c d e " * 4, "a b c d e a b c d e x", "y", None, "a b c d e", "y z"]
    none = (np.zeros(0, np.uint64), np.zeros(0))
    got = wm.all_similarities(pa.array(texts), pa.array(texts[:4]), *none)
    left, right = [t for t in texts for _ in range(4)], texts[:4] * len(texts)
    assert np.allclose(got.reshape(-1), wm.similarity(pa.array(left), pa.array(right), *none))


def test_odd_rows(spark):
    docs = odd(spark)
    got = wm.near_duplicates(docs)
    assert got.count() == docs.count()
    by_id = collections.defaultdict(set)
    for i, c in rows(got, "doc_id", "class_id"):
        by_id[i].add(c)
    assert by_id[8] == by_id[9] == {8}  # 30,000 words and one more
    assert by_id[13] == by_id[14] == {10} and by_id[1] == {1} and by_id[2] == {2}
    out = wm.one_of_each(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert texts.count("same id") == 1 and texts.count(None) == 2 and texts.count("") == 1
    assert wm.near_duplicates(empty(spark)).count() == 0 and wm.one_of_each(empty(spark)).count() == 0


def test_samples_collide_as_often_as_weights_agree():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(1, 1 << 63, 60).astype(np.uint64))
    a, b = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    a[:15], b[-15:] = 1e-9, 1e-9
    n = 4000
    both = wm.sample(np.concatenate([h, h]), np.concatenate([a, b]), np.array([0, 60, 120]), n)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / n)


def test_every_shingle_is_counted_over_all_documents(spark, data, monkeypatch):
    monkeypatch.setattr(wm, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(wm, "BUCKET_BYTES", 50_000)
    docs = documents(spark, data).select("doc_id", "text").union(frame(spark, ["", None, "two words", "two words"]).select("doc_id", "text"))
    held, texts = collections.Counter(), collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(wm.shingles(pa.array([r.text], pa.string()))[0].tolist())
        held.update(texts[r.doc_id][-1])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    got = wm.signatures(docs, docs.count(), size, "text", "doc_id").select(F.col("doc").alias("doc_id"), "df").collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id].append(np.frombuffer(r.df, np.uint32).tolist())
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted([held[h] for h in x] for x in xs) for i, xs in texts.items()}
    assert len(set(held.values())) > 2


def test_rare_passages_weigh_more_than_common_ones(spark):
    """Two texts share two thirds of their shingles; whether these are common or their own decides."""
    banner = " ".join(f"common{j}" for j in range(204))
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    others = [f"{banner} {own(i, 3)}" for i in range(40)]
    pair = [f"{banner} {own('a', 18)}", f"{banner} {own('b', 18)}"]
    texts = others + pair
    got = wm.near_duplicates(frame(spark, texts))
    want, _ = brute(list(enumerate(texts, 1)))
    assert {i: c for i, c in rows(got, "doc_id", "class_id")} == want
    assert want[41] == 41 and want[42] == 42


def test_components(spark):
    chain = [(i, i + 1) for i in range(60) if i not in (20, 41)] + [(5, 5), (100, 90)]
    got = dict(rows(components(spark.createDataFrame(chain, "a long, b long")), "node", "root"))
    want = {i: 0 if i <= 20 else 21 if i <= 41 else 42 for i in range(61)} | {90: 90, 100: 90}
    assert {k: v for k, v in got.items() if v != k} == {k: v for k, v in want.items() if v != k}
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0
