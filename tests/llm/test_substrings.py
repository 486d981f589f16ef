import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rowloom.llm import substrings
from tests.llm.common import documents, empty, frame, odd, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    texts = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    want = []
    for i, w in texts:
        gone = {j for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for j in range(a, a + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(want, key=repr)


def test_levels():
    assert substrings.levels() == [9, 18, 35]
    assert substrings.levels(7, 9) == [7]


@pytest.mark.parametrize("window,smallest", [(35, 9), (6, 3), (4, 9)])
def test_agrees_with_brute_force(spark, data, window, smallest):
    docs = documents(spark, data)
    got = substrings.substring_dedup(docs, window=window, smallest=smallest)
    assert rows(got, *got.columns) == brute(docs, window)


def test_odd_rows(spark):
    docs = odd(spark)
    got = substrings.substring_dedup(docs)
    assert rows(got, *got.columns) == brute(docs, 35)
    assert substrings.substring_dedup(empty(spark)).count() == 0


def test_repeats_within_a_text_and_over_each_other(spark):
    phrase = [f"p{i}" for i in range(40)]
    texts = [" ".join(["a", *phrase, "b", *phrase, "c"]), "x " * 80, " ".join(phrase[3:39]), " ".join(phrase[:35]) + " z"]
    docs = frame(spark, texts)
    got = substrings.substring_dedup(docs)
    assert rows(got, *got.columns) == brute(docs, 35)


def test_deduplicated_keeps_columns_and_untouched_texts(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    texts = ["one  two\nthree", f"mine {shared} end", f"{shared}", f"other {shared}", None, ""]
    docs = frame(spark, texts).withColumn("kept_text", F.lit(1))
    out = {r.doc_id: r for r in substrings.deduplicated(docs).collect()}
    assert substrings.deduplicated(docs).columns == docs.columns
    assert out[1].text == "one  two\nthree" and out[1].n_chars == 14
    assert out[2].text == "mine end" and out[2].n_chars == 8 and out[4].text == "other"
    assert 3 not in out and out[5].text is None and out[6].text == ""
