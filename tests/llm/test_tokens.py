"""Word-wise encoding, indexed id shards and mixture packing."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import id_shards, mixture_packing, word_tokens
from rowloom.session import scratch_path
from tests.llm.common import documents, empty, frame, odd, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_words_give_the_ids_of_the_text(tokenizer):
    encoder = word_tokens.encoder(PATH)
    assert encoder.by_word

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text(alphabet="abAÉß .,'!\n\t\x1c\x85éı12<|endoftx>", max_size=30), st.text(max_size=20)), max_size=6))
    def run(texts):
        got = [np.frombuffer(p, encoder.dtype).tolist() for p in encoder.encode(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    run()


def _word_pieces(path):
    """A tokenizer of another kind: lower case without accents, words cut into pieces of a small vocabulary."""
    from tokenizers import models, normalizers, pre_tokenizers

    words = ["[UNK]", "some", "case", "mixed", "words", ",", ".", "'", "it", "s", "42", "ete", "##s", "!", "aop"]
    t = Tokenizer(models.WordPiece({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    t.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.Lowercase(), normalizers.StripAccents()])
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    t.save(path)
    return t


def test_other_tokenizers_get_whole_texts(tmp_path):
    path = str(tmp_path / "pieces.json")
    t = _word_pieces(path)
    encoder = word_tokens.WordEncoder(path)
    assert not encoder.by_word
    texts = ["été", "étés, some CASE. it's 42!", None, "mixed words", "ÀÖP"]
    got = [np.frombuffer(p, encoder.dtype).tolist() for p in encoder.encode(texts)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts] and got[0] == [11]


def test_keys_that_are_no_integers(spark, tokenizer):
    """They are stored without a key and read by position."""
    docs = frame(spark, ["one", "two words", "three"]).withColumn("doc_id", F.when(F.col("doc_id") == 2, "a-1").otherwise(F.col("doc_id").cast("string")))
    where, manifest = id_shards.write_shards(docs, PATH)
    got = {r.doc_id: r.n_tokens for r in id_shards.read_shards(where, manifest).collect()}
    assert got == {None: len(ids_of(tokenizer, "two words")), 1: len(ids_of(tokenizer, "one")), 3: len(ids_of(tokenizer, "three"))}


def test_the_word_cache_may_overflow(tokenizer):
    encoder = word_tokens.WordEncoder(PATH, kept=4)
    for t in ("one two, three! four", "four five six.", None, "one two,"):
        assert np.frombuffer(encoder.encode([t])[0], encoder.dtype).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_slots_are_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    table = id_shards.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))


def starts(docs, tokenizer):
    """Rows in key order, nulls first, with the ids before them."""
    got, at = [], 0
    every = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    for r in every:
        ids = ids_of(tokenizer, r.text)
        got.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return got


@pytest.mark.parametrize("shard_bytes", [1 << 25, 4000])
def test_shards_of_documents(spark, data, tokenizer, monkeypatch, shard_bytes):
    monkeypatch.setattr(id_shards, "SHARD_BYTES", shard_bytes)
    docs = documents(spark, data)
    folder, manifest = id_shards.write_shards(docs, PATH)
    got = id_shards.read_shards(folder, manifest)
    assert rows(got, *got.columns) == sorted(starts(docs, tokenizer), key=repr)


def test_lookup_by_key(spark, tokenizer):
    docs = odd(spark)
    folder, manifest = id_shards.write_shards(docs, PATH, folder=scratch_path(spark, "shards"))
    got = collections.Counter((r.key, tuple(r.ids)) for r in id_shards.lookup(folder, manifest, docs.union(frame_like(docs, spark))).collect())
    want = collections.Counter((r.doc_id, tuple(ids_of(tokenizer, r.text))) for r in docs.collect() if r.doc_id is not None)
    assert got == want


def frame_like(docs, spark):
    """Keys that are not there."""
    return docs.filter("doc_id = 7").limit(1).selectExpr("doc_id + 1000 AS doc_id", *docs.columns[1:])


def test_shards_of_odd_rows(spark, tokenizer):
    docs = odd(spark)
    folder, manifest = id_shards.write_shards(docs, PATH)
    got = id_shards.read_shards(folder, manifest)
    assert rows(got, *got.columns) == sorted(starts(docs, tokenizer), key=repr)
    folder, manifest = id_shards.write_shards(empty(spark), PATH)
    assert id_shards.read_shards(folder, manifest).count() == 0


def check_packing(docs, tokenizer, window=2048, **kw):
    pieces = mixture_packing.pack(docs, PATH, window=window, with_ids=True, **kw)
    got = pieces.collect()
    whole = collections.Counter((r.doc_id, tuple(ids_of(tokenizer, r.text))) for r in docs.select("doc_id", "text").collect())
    # ids in pieces put together by document; equal ids are told apart by their runs of pieces
    by_doc = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(ids) >= 1 and r.ids_crc32 == crc(ids)
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
    for i, parts in by_doc.items():
        assert sum(len(x) for _, x, _ in parts) == sum(len(t) * n for (d, t), n in whole.items() if d == i)
        if sum(n for (d, _), n in whole.items() if d == i) == 1:
            parts.sort()
            assert [s for s, _, _ in parts] == [0, *np.cumsum([len(x) for _, x, _ in parts])[:-1].tolist()]
            ids = tuple(v for _, x, _ in parts for v in x)
            assert (i, ids) in whole and all(n == len(ids) for _, _, n in parts)
    at, total = 0, sum(len(t) * n for (_, t), n in whole.items())
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * window + r.offset == at and r.offset + r.length <= window
        at += r.length
    assert at == total
    return pieces, got


def step_by_step(lengths, shares, window, min_piece):
    """Deficit round-robin as told: every round a queue earns its share, keeps less than a piece or a token, and sends the rest."""
    unit, total = 1 << 16, sum(shares)
    earned = [max(1, round(window * s / total * unit)) for s in shares]
    every = [-(-min_piece * unit // e) for e in earned]
    sent, deficit, out, turn = [0] * len(lengths), [0] * len(lengths), [], 0
    while any(s < n for s, n in zip(sent, lengths)):
        turn += 1
        for q, n in enumerate(lengths):
            deficit[q] += earned[q]
            if turn % every[q] == 0:
                give = min(n - sent[q], deficit[q] // unit)
                deficit[q] %= unit
                out += [(q, sent[q] + i) for i in range(give)]
                sent[q] += give
    return out


@pytest.mark.parametrize("seed", range(6))
def test_places_are_those_of_a_round_robin_step_by_step(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    lengths = [int(x) for x in rng.integers(0, 900, n)]
    lengths[0] += 1
    shares = [float(x) for x in rng.random(n) ** 3 + 0.001] if seed % 2 else [max(1.0, float(x)) for x in lengths]
    window, piece = int(rng.choice([32, 100, 257])), int(rng.choice([1, 7, 20]))
    want = {t: place for place, t in enumerate(step_by_step(lengths, shares, window, piece))}
    mixture = mixture_packing.Mixture(lengths, shares, window, piece)
    # documents of different sizes fill the queues
    queue, first, count = [], [], []
    for q, size in enumerate(lengths):
        at = 0
        while at < size:
            step = min(size - at, int(rng.integers(1, 200)))
            queue.append(q), first.append(at), count.append(step)
            at += step
    queue, first, count = (np.array(x, dtype=np.int64) for x in (queue, first, count))
    got = {}
    for run, start, length, place in zip(*(x.tolist() for x in mixture.places(queue, first, count))):
        assert place // window == (place + length - 1) // window
        for i in range(length):
            got[int(queue[run]), int(first[run]) + start + i] = place + i
    assert got == want


def test_packing_of_documents(spark, data, tokenizer):
    docs = documents(spark, data)
    pieces, got = check_packing(docs, tokenizer, window=512, min_piece=8)
    source = dict(rows(docs, "doc_id", "source"))
    tokens, held = collections.Counter(), collections.Counter()
    for r in got:
        tokens[source[r.doc_id]] += r.length
        held[r.sequence_id, source[r.doc_id]] += r.length
    total, last = sum(tokens.values()), max(r.sequence_id for r in got)
    for w in range(last - 1):
        for s, n in tokens.items():
            assert abs(held[w, s] - 512 * n / total) <= len(tokens) + 8
    packed = mixture_packing.sequences(pieces).collect()
    assert sorted(r.sequence_id for r in packed) == list(range(last + 1))
    assert all(len(r.ids) == 4 * r.length and (r.length == 512 or r.sequence_id == last) for r in packed)


def test_shares_and_shared_queues(spark, data, tokenizer, monkeypatch):
    docs = documents(spark, data)
    pieces, got = check_packing(docs, tokenizer, window=1024, shares={"src1": 0.5, "src2": 0.25})
    source = dict(rows(docs, "doc_id", "source"))
    early = collections.Counter()
    for r in got:
        if r.sequence_id < 3:
            early[source[r.doc_id]] += r.length
    assert early["src1"] > 1.5 * early["src2"] > 3 * early["src3"]
    totals = spark.createDataFrame([(p, f"s{i}", 10 + i) for i in range(9) for p in range(2)], "part int, source string, n long")
    found, bases = mixture_packing.queues(totals, 4)
    assert [q for q, _ in found] == ["s6", "s7", "s8", None] and sum(n for _, n in found) == sum(2 * (10 + i) for i in range(9))
    rest = sorted((r.source, r.part, r.base) for r in bases.filter("queue = 3").collect())
    assert [b for _, _, b in rest] == [0, *np.cumsum([10 + i for i in range(6) for _ in range(2)])[:-1].tolist()]


def test_every_one_of_many_sources_keeps_its_share(spark, tokenizer):
    """1123 sources: those without a queue of their own run along the windows too, and have targets."""
    names = [f"host{i:04}" for i in range(1123)]
    texts, sources = [f"text {i} " * (60 if i < 1000 else 40) for i in range(1123)], names
    docs = frame(spark, texts, sources)
    _, got = check_packing(docs, tokenizer, window=512, min_piece=4)
    last, by_source = max(r.sequence_id for r in got), collections.defaultdict(list)
    for r in got:
        by_source[r.doc_id].append((r.sequence_id, r.length))
    for i, pieces in by_source.items():
        early = sum(n for w, n in pieces if w < last / 2) / sum(n for _, n in pieces)
        assert 0.3 < early < 0.7, i
    _, got = check_packing(docs, tokenizer, window=512, min_piece=4, shares={"host1100": 0.3})
    assert sum(r.length for r in got if r.doc_id == 1101 and r.sequence_id == 0) > 60
    shares = {name: 2.0 if i == 1122 else 1e-3 for i, name in enumerate(names)}  # more targets than queues
    _, got = check_packing(docs, tokenizer, window=512, min_piece=4, shares=shares)
    assert sum(r.length for r in got if r.doc_id == 1123 and r.sequence_id < 2) > 70


def test_packing_of_odd_rows(spark, tokenizer):
    check_packing(odd(spark), tokenizer)
    check_packing(frame(spark, ["one long source " * 900], ["only"]), tokenizer, window=64)
    assert mixture_packing.pack(empty(spark), PATH).count() == 0
