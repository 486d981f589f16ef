"""The stages against plain Python, and the list of queries."""

import collections
import re

import corpus_pipeline
from rowloom.llm import handover, language_crf, line_rules, queries
from rowloom.llm.handover import hand_over
from tests.llm import test_line_rules, test_weighted_minhash
from tests.llm.common import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_stages_agree_with_plain_python(spark, data):
    docs = documents(spark, data)
    fields = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "language ID", "MinHash near-dedup", "substring dedup", "packing"]
    step = lambda name, d: hand_over(stage[name](spark, d, data), "test-stage")

    first = step("quality rules", docs)
    passed = set()
    for r in docs.collect():  # no line of these tables is common enough to deplete a document
        m = test_line_rules.measures(r.text)
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0]:
            passed.add(r.doc_id)
    assert {r.doc_id for r in first.collect()} == passed and first.columns == fields

    second = step("language ID", first)
    model = language_crf.fit(first)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    names, shares = model.texts([t for _, t in rows])
    clear = {i for (i, _), n, s in zip(rows, names, shares) if n != "und" and s >= corpus_pipeline.CLEAR_LANGUAGE}
    assert {r.doc_id for r in second.collect()} == clear and second.columns == fields

    third = step("MinHash near-dedup", second)
    classes, _ = test_weighted_minhash.brute([(r.doc_id, r.text) for r in second.collect()])
    assert {r.doc_id for r in third.collect()} == set(classes.values()) and third.columns == fields

    fourth = step("substring dedup", third)
    texts = {r.doc_id: r.text for r in third.collect()}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in map(WORD.findall, texts.values()) for i in range(len(w) - 34))
    want = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        gone = {j for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}
        if len(gone) < len(w):
            want[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    got = {r.doc_id: r for r in fourth.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert fourth.columns == fields

    last = step("packing", fourth)
    assert {r.doc_id for r in last.collect()} == set(want)
    assert corpus_pipeline.run(spark, data).count() == last.count()


def test_profiles_of_the_rules_hold_no_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "h", "a b"), (2, "h", " ".join(f"w{i}" for i in range(12))), (2, None, None)], "doc_id long, source string, text string")
    kept, write = [], line_rules.hand_over
    monkeypatch.setattr(line_rules, "hand_over", lambda df, label: kept.append(df) or write(df, label))
    assert [(r.doc_id, r.source) for r in line_rules.accepted(docs).collect()] == [(2, "h")]
    assert [df.schema["doc"].dataType.simpleString() for df in kept] == ["binary"]


def test_handing_over_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    shuffles = lambda: {x for x in files().splitlines() if "shuffle_" in x}
    before, kept = shuffles(), spark.conf.get(handover.CLEANUP)
    out = handover.hand_over(spark.range(1000).repartition("id").groupBy("id").count(), "sums")
    assert shuffles() <= before and out.count() == 1000 and spark.conf.get(handover.CLEANUP) == kept
