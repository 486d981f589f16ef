"""Language of every word by a linear-chain conditional random field, and of whole texts from their words.

A word is a run of letters in lower case. Its features are prefixes, suffixes,
letter trigrams, the word itself and its entry in a lexicon of the training
words; each is hashed to a row of weights, one per language. Transitions
between languages are learned as well, from sequences put together of pieces of
texts in different languages. The posterior of every word's language comes from
forward-backward over the whole text, so that words in another language are
labelled as such, and a text gets the language with the most expected words.

All texts of a batch are one chain that forgets at the start of each text. The
chain is cut into blocks; products of the transition matrices of each block, all
blocks side by side, carry the state over the cuts, so that the posteriors are
exact for texts of any length.

The fit uses pieces of ``SAMPLE`` texts of each language at most, those with
the smallest hash of their id.

Defined cases: a null text and a text without a letter are ``und`` with score
0; so is every text when there is nothing to learn from. Ties go to the first
language by name. A null or empty language is no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import spans
from rowloom.llm.folds import held_out
from rowloom.llm.handover import hand_over
from rowloom.session import small_side

UNDETERMINED = "und"
#: texts of each language that the fit may use, pieces of each and words of a piece
SAMPLE = 400
PIECES, PIECE_WORDS = 5, 12
#: training sequences, and rounds over them
SEQUENCES, ROUNDS, BATCH = 2000, 6, 100
LEXICON = 20_000
_ROWS = 1 << 16
_BLOCK = 512

#: bytes of letters: ASCII ones in lower case and all parts of longer code points
WORD = spans._is([*range(0x61, 0x7B), *range(0x80, 0x100)])


def lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts in lower case."""
    return spans.flat(pa.array([t.lower() if t else "" for t in texts], pa.large_string()))


def _slots(values: np.ndarray, kind: int) -> np.ndarray:
    return (spans.mix(values + spans.salt(kind + 1)) >> np.uint64(48)).astype(np.int64)


@dataclass
class Features:
    """Feature rows of words: ``rows`` flat, with the bounds of each word in them."""

    rows: np.ndarray
    bounds: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> Features:
    """Affixes of up to four bytes, the word, its lexicon entry, and its trigrams."""
    n = len(starts)
    size = ends - starts
    padded = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)]).astype(np.uint64)
    fixed = []
    prefix, suffix = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(1, 5):
        inside = size >= k
        prefix = (prefix << np.uint64(8)) | np.where(inside, padded[starts + 3 + k], np.uint64(0))
        suffix = (suffix << np.uint64(8)) | np.where(inside, padded[ends + 4 - k], np.uint64(0))
        if k > 1:
            fixed += [_slots(prefix, k), _slots(suffix, 8 + k)]
    words = spans.span_hashes(data, starts, ends)
    fixed.append((spans.mix(words) >> np.uint64(48)).astype(np.int64))
    known, entry = lexicon
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    hit = known[at] == words if len(known) else np.zeros(n, dtype=bool)
    fixed.append(_ROWS + np.where(hit, entry[at] if len(known) else 0, 0))
    grams = np.maximum(size - 2, 0)
    owner = np.repeat(np.arange(n), grams)
    place = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + 4
    three = (padded[place] << np.uint64(16)) | (padded[place + 1] << np.uint64(8)) | padded[place + 2]
    width = len(fixed) + grams
    bounds = np.concatenate([[0], np.cumsum(width)])
    rows = np.empty(bounds[-1], dtype=np.int64)
    for i, f in enumerate(fixed):
        rows[bounds[:-1] + i] = f
    rows[place - 4 - starts[owner] + bounds[:-1][owner] + len(fixed)] = _slots(three, 20)
    return Features(rows, bounds)


@dataclass
class Model:
    """Languages, the lexicon (hashes and entries), weights per feature row and transition scores."""

    languages: list[str]
    lexicon: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        return np.add.reduceat(self.weights[f.rows], f.bounds[:-1], axis=0) if len(f.bounds) > 1 else np.zeros((0, len(self.languages)), np.float32)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of every word's language, and the bounds of each text in the words."""
        data, bounds = lowered(texts)
        starts, ends, wb = spans.runs(WORD[data], bounds)
        first = np.zeros(len(starts), dtype=bool)
        first[wb[:-1][np.diff(wb) > 0]] = True
        return posteriors(self.emissions(features(data, starts, ends, self.lexicon)), self.transitions, first), wb

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the expected words of every text."""
        post, wb = self.words(texts)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(post, axis=0, dtype=np.float64)])
        mass = sums[wb[1:]] - sums[wb[:-1]]
        best = mass.argmax(axis=1) if len(mass) else np.zeros(0, np.int64)
        n = np.diff(wb)
        share = np.divide(mass[np.arange(len(best)), best], n, out=np.zeros(len(best)), where=n > 0)
        some = [bool(t) and k > 0 and any(map(str.isalpha, t)) for t, k in zip(texts, n)]
        names = [self.languages[b] if s else UNDETERMINED for b, s in zip(best, some)]
        return names, np.where(some, np.clip(share, 0.0, 1.0), 0.0)


def posteriors(emissions: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over one chain that starts anew at every ``first``."""
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k))
    blocks = -(-n // _BLOCK)
    total = blocks * _BLOCK
    pot = np.ones((total, k))
    pot[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    new = np.ones(total, dtype=bool)
    new[:n] = first
    pot = pot.reshape(blocks, _BLOCK, k).transpose(1, 0, 2)
    new = new.reshape(blocks, _BLOCK).T[:, :, None]
    move = np.exp(transitions - transitions.max())

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    # what each block does to a state before it
    whole = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(_BLOCK):
        whole = np.where(new[t][:, None], whole.sum(axis=2, keepdims=True), whole @ move) * pot[t][:, None, :]
        whole = whole / whole.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    state = np.full(k, 1.0 / k)
    for b in range(blocks):
        into[b] = state
        state = state @ whole[b]
        state /= state.sum()
    state = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out[b] = state
        state = whole[b] @ state
        state /= state.sum()

    result = np.empty((_BLOCK, blocks, k))
    state = into
    for t in range(_BLOCK):
        state = scaled(np.where(new[t], state.sum(axis=1, keepdims=True), state @ move) * pot[t])
        result[t] = state
    state = out
    for t in range(_BLOCK - 1, -1, -1):
        result[t] *= state
        ahead = pot[t] * state
        state = scaled(np.where(new[t], ahead.sum(axis=1, keepdims=True), ahead @ move.T))
    return scaled(result).transpose(1, 0, 2).reshape(total, k)[:n]


def train(pieces: dict[str, list[str]], sequences: int = SEQUENCES, rounds: int = ROUNDS) -> Model:
    """A model from pieces of text by language; the same pieces give the same model."""
    languages = sorted(pieces)
    k = len(languages)
    rng = np.random.default_rng(20)
    found: dict[int, np.ndarray] = {}
    for i, lang in enumerate(languages):
        data, bounds = lowered(pieces[lang])
        starts, ends, _ = spans.runs(WORD[data], bounds)
        h, n = np.unique(spans.span_hashes(data, starts, ends), return_counts=True)
        for a, c in zip(h.tolist(), n.tolist()):
            found.setdefault(a, np.zeros(k))[i] = c
    often = sorted((a for a in found if found[a].sum() >= 3), key=lambda a: (-found[a].sum(), a))[:LEXICON]
    hashes = np.array(sorted(often), dtype=np.uint64)
    counts = np.array([found[int(a)] for a in hashes]).reshape(-1, k)
    share = counts.max(axis=1) / counts.sum(axis=1) if len(counts) else np.zeros(0)
    sure = np.digitize(share, [0.5, 0.75, 0.95])
    entries = 1 + counts.argmax(axis=1) * 4 + sure if len(counts) else np.zeros(0, np.int64)
    lexicon = (hashes, entries.astype(np.int64))

    # sequences of one to four pieces, each of a language of its own draw
    texts, lengths, langs = [], [], []
    for _ in range(sequences):
        drawn = [int(rng.integers(k)) for _ in range(int(rng.integers(1, 5)))]
        parts = [pieces[languages[i]][int(rng.integers(len(pieces[languages[i]])))] for i in drawn]
        texts += parts
        langs += drawn
        lengths.append(len(parts))
    data, bounds = lowered(texts)
    starts, ends, wb = spans.runs(WORD[data], bounds)
    f = features(data, starts, ends, lexicon)
    y = np.repeat(np.array(langs), np.diff(wb))
    seq = np.concatenate([[0], np.cumsum(lengths)])
    sb = wb[seq]

    rows = _ROWS + 1 + 4 * k
    model = Model(languages, lexicon, np.zeros((rows, k)), np.zeros((k, k)))
    past_w, past_t = np.full((rows, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(rounds):
        order = rng.permutation(len(lengths))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            grad_w, grad_t = _gradient(model, f, y, [(int(sb[s]), int(sb[s + 1])) for s in batch])
            for value, grad, past in ((model.weights, grad_w, past_w), (model.transitions, grad_t, past_t)):
                grad = grad / len(batch) + 1e-5 * value
                past += grad * grad
                value -= 0.3 * grad / np.sqrt(past)
    model.weights = model.weights.astype(np.float32)
    return model


def _gradient(model: Model, f: Features, y: np.ndarray, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts of features and transitions over some sequences."""
    k = len(model.languages)
    parts = [p for p in parts if p[1] > p[0]]
    longest = max(b - a for a, b in parts)
    at = np.array([a for a, _ in parts])[:, None] + np.arange(longest)
    there = np.arange(longest) < np.array([b - a for a, b in parts])[:, None]
    words = at[there]
    width = np.diff(f.bounds)[words]
    owner = np.repeat(np.arange(len(words)), width)
    rows = f.rows[np.repeat(f.bounds[words] - (np.cumsum(width) - width), width) + np.arange(len(owner))]
    emission = np.add.reduceat(model.weights[rows], np.cumsum(width) - width, axis=0)
    pot = np.ones((len(parts), longest, k))
    pot[there] = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(model.transitions)
    alpha, beta = np.empty_like(pot), np.ones_like(pot)
    state = pot[:, 0] / pot[:, 0].sum(axis=1, keepdims=True)
    alpha[:, 0] = state
    for t in range(1, longest):
        new = (state @ move) * pot[:, t]
        state = np.where(there[:, t, None], new / new.sum(axis=1, keepdims=True), state)
        alpha[:, t] = state
    grad_t = np.zeros((k, k))
    labels = np.zeros(there.shape, dtype=np.int64)
    labels[there] = y[words]
    for t in range(longest - 1, 0, -1):
        ahead = pot[:, t] * beta[:, t]
        joint = alpha[:, t - 1, :, None] * move * ahead[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        grad_t += joint[there[:, t]].sum(axis=0)
        np.subtract.at(grad_t, (labels[there[:, t], t - 1], labels[there[:, t], t]), 1.0)
        back = ahead @ move.T
        beta[:, t - 1] = np.where(there[:, t, None], back / back.sum(axis=1, keepdims=True), 1.0)
    post = alpha * beta
    post = (post / post.sum(axis=2, keepdims=True))[there]
    post[np.arange(len(words)), y[words]] -= 1.0
    grad_w = np.stack([np.bincount(rows, post[owner, j], len(model.weights)) for j in range(k)], axis=1)
    return grad_w, grad_t


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, fold: int = 2, sample: int = SAMPLE) -> Model | None:
    """A model from the labelled documents outside the held-out fold; None if there are none."""
    seen = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), held_out(doc_id, folds, fold).alias("out"))
    seen = seen.filter("NOT out AND id IS NOT NULL AND lang IS NOT NULL AND lang != ''").select("id", "lang", F.xxhash64("id").alias("h"))
    # hashes below a share of their range leave about four times the sample of a frequent language, however many rows or tasks it has
    # the few counts go to the rows, so that the share is taken before any row moves
    counts = small_side(hand_over(seen.groupBy("lang").agg(F.count(F.lit(1)).alias("all")), "language-counts"))
    low = F.pmod("h", F.lit(1 << 32)) / (1 << 32) * F.col("all") <= 4.0 * sample
    seen = seen.join(counts, "lang").filter(low)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = small_side(hand_over(seen.withColumn("n", rank).filter(F.col("n") <= sample).select("id", "lang"), "language-ids"))
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    # a sample of narrow rows for each language
    rows = hand_over(src.join(chosen, ["id", "lang"]).filter("text IS NOT NULL"), "language-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, got = [], [], []
            for i, lang, t in zip(batch.column("id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = t.split()
                stride = max(PIECE_WORDS, len(words) // PIECES)
                for at in range(0, min(len(words), stride * PIECES), stride):
                    ids.append(str(i))
                    langs.append(lang)
                    got.append(" ".join(words[at : at + PIECE_WORDS]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, langs, got)], names=["id", "lang", "piece"])

    got = rows.mapInArrow(cut, "id string, lang string, piece string").toArrow().to_pylist()
    pieces: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["id"], r["piece"])):
        if any(map(str.isalpha, r["piece"])):
            pieces.setdefault(r["lang"], []).append(r["piece"])
    return train(pieces) if pieces else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc"), held_out(doc_id, folds, fold).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return labelled(src, model).withColumnRenamed("doc", "doc_id")


def labelled(src: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``src`` without its text, with ``lang_pred`` and ``score``."""
    rest = [c for c in src.columns if c != text]
    if model is None:
        return src.select(*rest, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = src.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in rest) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, text):
                names, share = shared.value.texts(part.column(text).to_pylist())
                cols = [*[part.column(c) for c in rest], pa.array(names, pa.string()), pa.array(share, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, "lang_pred", "score"])

    return src.mapInArrow(run, fields)


def word_labels(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, labels``: the most likely language of each word of a text, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                post, wb = shared.value.words(part.column("text").to_pylist())
                names = np.array(shared.value.languages, dtype=object)[post.argmax(axis=1)] if len(post) else []
                labels = pa.ListArray.from_arrays(pa.array(wb.astype(np.int32)), pa.array(list(names), pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), labels], names=["doc_id", "labels"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, labels array<string>")


def accepted(docs: DataFrame, model: Model | None, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is clear: not ``und``, and at least ``min_score`` of the words in it.

    Without a model nothing is known of any text, and all rows with a letter stay.
    """
    if model is None:
        return docs.filter(F.col(f"`{text}`").rlike(r"\p{L}"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    out = labelled(docs.select(whole, F.col(f"`{text}`").alias("text")), model)
    out = out.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
