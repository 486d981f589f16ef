import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import byte_bpe
from tests.llm.common import documents, empty, odd

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    pairs = [line.split() for line in open(PATH, "rb")]
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_of_any_kind(reference):
    table = byte_bpe.ranks(PATH)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text(alphabet="ab'stdmrevl  \n\t1.!é　\x85", max_size=30), st.text(max_size=20)), max_size=6))
    def run(texts):
        got = table.encode(texts)
        assert [np.frombuffer(p, "<u4").tolist() for p, _ in got] == [reference.encode_ordinary(t) for t in texts]
        for t, (packed, pieces) in zip(texts, got):
            assert table.decode(packed) == t.encode()
            if pieces:
                ids, ends = table.offsets(pieces)
                assert ends[-1] == len(t.encode()) and ids[-1] == len(packed) // 4
                assert [table.decode(p) for p in pieces] == [t.encode()[a:b] for a, b in zip([0, *ends], ends)]

    run()


def test_scan_states_follow_the_steps():
    scan, rng = byte_bpe._shared("scan", byte_bpe._Scan), np.random.default_rng(2)
    classes = rng.integers(0, 9, 3 * byte_bpe._BLOCK + 5).astype(np.uint8)
    state, want = byte_bpe.CLOSED, []
    for c in classes.tolist():
        want.append(state)
        state = byte_bpe._step(state, c)[0]
    assert scan.states(classes).tolist() == want


def test_long_runs_without_a_break(reference):
    """A slice of any length takes the same merges, in time near its length."""
    table, rng = byte_bpe.Ranks(PATH), np.random.default_rng(4)
    letters = list("aeinorstéñüßж語")
    texts = ["a" * 5000, "".join(rng.choice(letters, 3000)), "short " + "".join(rng.choice(letters, 40_000)) + " end", "!" * 2500]
    for t, (packed, pieces) in zip(texts, table.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(t)
        assert table.decode(packed) == t.encode()
    began = time.process_time()
    table.merge(["".join(rng.choice(letters, 300_000)).encode()])
    assert time.process_time() - began < 20


def test_the_cache_may_overflow(reference):
    table = byte_bpe.Ranks(PATH, kept=3)
    for t in ("one two three four five six", "six seven eight", "one two"):
        assert np.frombuffer(table.encode([t])[0][0], "<u4").tolist() == reference.encode_ordinary(t)


def check(docs, reference):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs, PATH).collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        packed = np.array(ids, dtype="<u4").tobytes()
        want.add((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want


def test_documents(spark, data, reference):
    check(documents(spark, data), reference)


def test_odd_rows(spark, reference):
    docs = odd(spark)
    check(docs, reference)
    encoded = byte_bpe.encode(docs, PATH)
    back = byte_bpe.decode(encoded, PATH)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r.text or "").encode() for r in docs.collect())
    assert encoded.filter("size(id_ends) != size(byte_ends)").count() == 0
    assert byte_bpe.digests(empty(spark), PATH).count() == 0
