"""File matching against brute force, small buckets and banded large ones."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.operators import align
from rowloom.plans import similarity
from rowloom.session import dealt

TOKEN = re.compile(r"[A-Za-z0-9_./\-]{2,64}")


def brute(a, b):
    def vec(t):
        return Counter(TOKEN.findall(t.lower()))

    out = []
    for bucket in {x[1] for x in a} | {x[1] for x in b}:
        left, right = [x for x in a if x[1] == bucket], [x for x in b if x[1] == bucket]
        pairs = []
        for i, _, t in left:
            for j, _, u in right:
                x, y = vec(t), vec(u)
                dot = sum(x[k] * y[k] for k in x)
                na, nb = (math.sqrt(sum(v * v for v in z.values())) for z in (x, y))
                pairs.append((-(dot / (na * nb) if dot else 0.0), i, j))
        used_a, used_b = set(), set()
        for s, i, j in sorted(pairs):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((i, j, round(-s, 9)))
    return sorted(out)


def make(n, seed, start):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    out = [(start + i, r.choice("xy"), " ".join(r.choices(words, k=r.randint(0, 9)))) for i in range(n)]
    return out + [(start + n + i, "x", "beta beta gamma") for i in range(8)]


@pytest.mark.parametrize("small_files,band_rows", [(200, 10), (2, 2_000_000), (2, 300), (2, 0)])
def test_cosine_matching_equals_brute_force(spark, small_files, band_rows, monkeypatch):
    """In bins, in one band, in bands that follow the candidates, and by mutually best pairs of small blocks."""
    monkeypatch.setattr(similarity.best_partners, "__defaults__", (40,))
    a, b = make(30, 1, 0), make(36, 2, 1000)
    frames = []
    for rows in (a, b):
        df = spark.createDataFrame(rows, "artifact_id long, bucket string, content string")
        frames.append(df.withColumn("sha256", F.sha2("content", 256)))
    got = align.match_cosine(*frames, small_files=small_files, band_rows=band_rows).collect()
    assert sorted((r.id_a, r.id_b, round(r.score, 9)) for r in got) == brute(a, b)


def test_band_thresholds_count_candidates(spark):
    """The next band reaches as far down as its candidates allow, each bucket for itself."""
    rng, rows = random.Random(8), []
    for bucket, n in (("x", 12), ("y", 5)):
        for i in range(n):
            words = Counter(rng.choices(["a1", "b2", "c3", "d4", "e5"], k=6))
            rows += [(rng.choice("ab"), bucket, f"{bucket}{i}", t, f, math.sqrt(sum(v * v for v in words.values()))) for t, f in words.items()]
    terms = spark.createDataFrame(rows, "side string, bucket string, cls string, term string, tf long, norm double")
    suffixes = similarity.term_suffixes(terms)
    got = suffixes.collect()

    def met(bucket, bar):
        n = Counter((r.term, r.side) for r in got if r.bucket == bucket and r.suffix >= bar)
        return sum(c * n[t, "b"] for (t, s), c in n.items() if s == "a")

    above = spark.createDataFrame([("x", 2.0), ("y", 2.0)], "bucket string, threshold double")
    for most in (5, 20, 60, 1000):
        bars = {r.bucket: r.threshold for r in similarity.band_thresholds(suffixes, above, most).collect()}
        for bucket in "xy":
            steps = [k / similarity.GRID for k in range(similarity.GRID + 1) if met(bucket, k / similarity.GRID) <= most]
            assert bars.get(bucket) == (min(steps) if steps else None)


def test_statuses(spark):
    schema = "artifact_id long, logical_path string, content string"
    a = spark.createDataFrame([(1, "G/1/f.csv", "h,i\n1,2"), (2, "G/2/f.csv", "h\nq"), (3, "H/x.csv", "h")], schema)
    b = spark.createDataFrame([(7, "G/9/f.csv", "h\nq"), (8, "G/8/f.csv", "h,i\n1,3"), (9, "K/x.csv", "h")], schema)
    arts = [align.artifacts(x, "artifact_id", F.col("logical_path"), "content") for x in (a, b)]
    got = {(r.status, r.path_a, r.path_b, r.rows_a, r.cols_b) for r in align.compare_files(*arts).collect()}
    assert got == {
        ("SAME", "G/2/f.csv", "G/9/f.csv", 1, 1),
        ("MODIFIED", "G/1/f.csv", "G/8/f.csv", 1, 2),
        ("REMOVED", "H/x.csv", "", 0, 0),
        ("ADDED", "", "K/x.csv", 0, 1),
    }


def test_fingerprint_tells_order_and_content(spark):
    def mark(rows):
        df = spark.createDataFrame([("t", i, s) for i, s in enumerate(rows)], "k string, i long, s string")
        return align.table_fingerprint(df, "k", "i", F.col("s"), fan_out=3).collect()[0].fingerprint

    base = [str(i) for i in range(40)]
    assert mark(base) == mark(list(base))
    assert len({mark(base), mark(base[::-1]), mark(base[:-1]), mark(base[:-1] + ["x"])}) == 4


def test_cosine_of_pairs_moves_vectors_not_terms(spark):
    texts = {1: "aa bb bb cc", 2: "bb cc dd", 3: "", 4: "zz", 5: "aa bb bb cc"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    asked = [(1, 2), (1, 5), (1, 3), (2, 4), (1, 9), (4, None), (5, 2), (5, 2)]
    pairs = spark.createDataFrame(asked, "id_a long, id_b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = align.cosine(align.term_counts(docs, "id", "text"), pairs, "id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.id_a, r.id_b or 0, r.similarity) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "term#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)

    def cos(i, j):
        x, y = (Counter(TOKEN.findall(texts.get(k) or "")) for k in (i, j))
        size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        return asked.count((i, j)) * sum(x[t] * y[t] for t in x) / size if size else 0.0

    assert got == [(i, j or 0, pytest.approx(cos(i, j))) for i, j in sorted(asked, key=lambda p: (p[0], p[1] or 0))]


def test_keys_are_dealt_by_rows(spark):
    a, b = dealt("key", spark.range(10).toDF("key"), spark.range(31).toDF("key"), rows=8)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 4
    assert [r.key for r in align.unmatched(a, b.distinct(), "key").orderBy("key").collect()] == list(range(10, 31))


def test_terms_of_a_large_file_are_counted_by_many_tasks(spark):
    lines = "\n".join(f"row{i % 9000} cell{i % 7}\r \u00e9 {'x' * (i % 70)}" for i in range(12000))
    files = [("one", lines), ("two", "no line end " * 9000 + "\u212aelvin"), ("three", None), ("four", ""), ("five", "\n" * 70000 + "ab")]
    df = spark.createDataFrame([("n", *f) for f in files], "bucket string, cls string, content string")
    found = align._dealt_terms(df, ["bucket", "cls"], 4).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found if r.cls == "one"}) == 4
    plain = {(r.cls, r.term): r.tf for r in align.term_counts(df, "cls", "content").collect()}
    assert {(r.cls, r.term): r.tf for r in found} == plain
    assert len(found) == len(plain) > 9000


def test_large_copies_and_pieces_match_as_whole_texts(spark):
    def text_of(i):
        return "\n".join(f"row{j * (i % 3 + 1)} of{i % 3} {j}" for j in range(6000))

    a = [(i, "k", f"s{i % 3}", text_of(i)) for i in range(4)]
    b = [(i + 10, "k", f"t{i}", text_of(i) + f"\nlast{i}") for i in range(3)]
    frame = lambda x: spark.createDataFrame(x, "artifact_id long, bucket string, sha256 string, content string")
    got = align.match_cosine(frame(a), frame(b), small_files=0).collect()
    want = brute([(i, k, t) for i, k, _, t in a], [(i, k, t) for i, k, _, t in b])
    assert sorted((r.id_a, r.id_b) for r in got) == sorted(x[:2] for x in want)
