import collections
import hashlib
import math
import re

from pyspark.sql import functions as F

from rowloom.llm import weighted_fingerprints as wf
from tests.llm.common import documents, empty, frame, odd


def terms(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return collections.Counter(words or [text])


def jaccard(a, b):
    both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_edits_and_fingerprints_of_documents(spark, data):
    docs = documents(spark, data)
    got = {r.doc_id: r for r in wf.edited_fingerprints(docs).collect()}
    every = [(r.doc_id, r.text) for r in docs.orderBy(F.desc("doc_id")).collect()]
    seen, off = {}, []
    for (i, text), (j, following) in zip(every, every[1:] + every[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        pieces = [[f[k : k + 8] for k in range(0, len(f), 8)] for f in (r.fingerprint, r.edited_fingerprint, got[j].fingerprint)]
        assert r.near_edited == sum(a == b for a, b in zip(pieces[0], pieces[1])) / wf.SAMPLES
        assert r.near_next == sum(a == b for a, b in zip(pieces[0], pieces[2])) / wf.SAMPLES
        off.append(r.near_edited - jaccard(terms(text), terms(edited)))
    assert len(got) == len(every)
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 0.12 and abs(sum(off) / len(off)) < 0.04


def test_samples_collide_as_often_as_weights_agree(spark):
    a = " ".join(w for i in range(40) for w in [f"w{i}"] * (1 + i % 4))
    b = " ".join(w for i in range(15, 60) for w in [f"w{i}"] * (1 + (i * 3) % 5))
    rows = spark.createDataFrame([(1, a), (2, b)], "k long, text string")
    n, seen = 48, []
    for r in range(12):  # other words, other draws
        named = rows.withColumn("text", F.regexp_replace("text", "w", f"v{r}x"))
        got = {x.k: x.samples for x in wf.fingerprints(named, ["k"], "text", n).collect()}
        seen += [x == y for x, y in zip(got[1], got[2])]
    want = jaccard(terms(a), terms(b))
    assert abs(sum(seen) / len(seen) - want) < 4 * math.sqrt(want * (1 - want) / len(seen))


def test_odd_rows(spark):
    docs = odd(spark)
    got = wf.edited_fingerprints(docs).collect()
    assert len(got) == docs.count()
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 8 * wf.SAMPLES
    assert by_text[1] == by_text[2] and by_text[13] == by_text[14] == by_text[10]
    assert wf.edited_fingerprints(empty(spark)).count() == 0


def test_one_document_follows_itself(spark):
    (r,) = wf.edited_fingerprints(frame(spark, ["one two three"])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"one two" + b"one tw").hexdigest() and r.near_next == 1.0


def test_only_dataframe_functions(spark, data):
    docs = documents(spark, data)
    rows, _ = wf.neighbours(docs, "text", "doc_id")
    plan = wf.fingerprints(docs, ["doc_id"], "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and rows.count() == docs.count()
