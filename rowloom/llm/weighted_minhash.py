"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight in a text is its count times its inverse
document frequency. Document frequencies are exact, for every shingle and over
all documents. No table of them is held anywhere: documents are dealt to slices
of bounded size, a slice sends its shingles to buckets by their hash, a bucket
adds up what all slices hold and answers each slice, and the slice weighs its
texts with the answers. A text takes its frequencies along to where it is
compared.

Texts with equal weights collapse to one class. Signatures are cut into bands;
classes that share a band are candidates, and all pairs of candidates are
verified by the exact weighted Jaccard similarity of their whole texts. Buckets
of up to ``SMALL`` classes emit their pairs. The classes of a larger one are
dealt to blocks of bounded size, and every block meets every block of its
bucket in a task of its own, which emits no pairs but the number of links of
each class and a forest that connects what is linked. A pair that shares
several buckets is tested in one of them. Classes of verified links are
connected components.

Defined cases: a text of fewer than five words is one shingle; a text without
words has no near-duplicate, not even an equal one; a null text is empty; ids
may repeat or be null, the class id is the smallest id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import spans
from rowloom.llm.components import components
from rowloom.llm.handover import discard, hand_over
from rowloom.llm.keys import wide_key

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 3, 8
#: bytes of text of a slice, and of the text whose shingles meet in a bucket, on average
SLICE_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: classes of a bucket whose pairs are emitted; larger ones are tested block against block
SMALL = 32
#: classes and bytes of text of such a block, on average
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: shingles that are laid out as columns at once when two blocks meet
COLUMNS = 4096

SAMPLES = ROWS * BANDS


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, their counts, and the texts' bounds in them."""
    data, bounds = spans.flat(texts)
    starts, ends, wb = spans.words(data, bounds)
    hashes = spans.span_hashes(data, starts, ends)
    at = spans.window_starts(wb, k)
    doc, h = spans.owner(wb)[at], spans.window_hashes(hashes, k)[at]
    n = np.diff(wb)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, spans.span_hashes(hashes, wb[short], wb[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(h)))
    return h[heads], counts, np.searchsorted(doc[heads], np.arange(len(bounds)))


def shingle_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """``(slice, bucket, df)``: how many documents of all slices hold each shingle of a slice, in ascending order of the hashes.

    ``texts`` has ``slice`` and ``text``. A bucket is a range of hashes; ``df``
    is an array of 32-bit numbers as bytes.
    """
    edges = np.array([-(-(i << 64) // buckets) for i in range(1, buckets)], dtype=np.uint64)

    def held(group: pa.Table) -> pa.Table:
        h = [shingles(part.column("text"))[0] for part in _parts(group)]
        h, n = np.unique(np.concatenate(h), return_counts=True)
        at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
        some = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "slice": pa.array(np.full(len(some), group.column("slice")[0].as_py(), np.int32)),
                "bucket": pa.array(some.astype(np.int32)),
                "h": pa.array([_packed(h[at[i] : at[i + 1]]) for i in some], pa.binary()),
                "n": pa.array([n[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in some], pa.binary()),
            }
        )

    def counted(group: pa.Table) -> pa.Table:
        h, n = (group.column(c).to_pylist() for c in ("h", "n"))
        at = np.cumsum([0] + [len(x) // 8 for x in h])
        _, place = np.unique(np.concatenate([_unpacked(x) for x in h]), return_inverse=True)
        df = np.bincount(place, np.frombuffer(b"".join(n), np.uint32))[place].astype(np.uint32)
        df = pa.array([df[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        return pa.table({"slice": group.column("slice"), "bucket": group.column("bucket"), "df": df})

    named = texts.groupBy("slice").applyInArrow(held, "slice int, bucket int, h binary, n binary")
    return named.groupBy("bucket").applyInArrow(counted, "slice int, bucket int, df binary")


def _packed(h: np.ndarray) -> bytes:
    """Ascending hashes as the steps between them, byte by byte of all: the upper bytes are zero and cost nothing once compressed."""
    return np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).reshape(-1), dtype=np.uint64)


def _parts(group: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in group.to_batches():
        yield from spans.slices(batch, "text")


def idf_table(texts: pa.Array, dfs: pa.Array, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of some texts, sorted, and their idf; ``dfs`` has the frequencies of each text's shingles."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    h = np.concatenate([np.zeros(0, np.uint64), *(shingles(part.column("text"))[0] for part in spans.slices(batch, "text"))])
    h, first = np.unique(h, return_index=True)
    return h, np.log(total / spans.flat(dfs)[0].view(np.uint32)[first]) + 1.0


def weigh(h: np.ndarray, counts: np.ndarray, known: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Count times ``1 + ln(documents / documents that hold it)``; the count alone for what is not in the table."""
    weight = np.ones(len(h))
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        weight[hit] = idf[at[hit]]
    return weight * counts


def _uniform(h: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from the upper bits."""
    return ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def sample(h: np.ndarray, weights: np.ndarray, bounds: np.ndarray, n_samples: int = SAMPLES) -> np.ndarray:
    """Signatures, one row per text: 64-bit names of the sampled (shingle, level) pairs; 0 without shingles.

    With r, c from Gamma(2, 1) and b uniform, all fixed by the shingle and the
    sample's number, a shingle of weight w reaches level t = floor(ln w / r + b)
    and the smallest ln c - r (t - b + 1) is sampled. Two texts share a sample
    with the chance of their generalised Jaccard similarity.
    """
    out = np.zeros((len(bounds) - 1, n_samples), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    log_w = np.log(weights).astype(np.float32)
    heads = bounds[:-1][full]
    sizes = np.diff(bounds)[full]
    for j in range(n_samples):
        x = spans.mix(h + spans.salt(j * 5 + 1))
        y = spans.mix(x)
        r = -np.log(_uniform(x) * _uniform(x << np.uint64(24)))
        c = -np.log(_uniform(y) * _uniform(y << np.uint64(24)))
        b = ((x ^ y) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b + 1)
        least = np.minimum.reduceat(a, heads)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, heads)]  # ties: the smallest hash
        out[full, j] = spans.mix(h[first] ^ spans.mix(t[first].astype(np.int64).view(np.uint64)))
    return out


def signatures(docs: DataFrame, total: int, size: int, text: str, doc_id: str, keep: Column | None = None) -> DataFrame:
    """``(doc, cls, key, sig, df)`` of every row; ``cls`` and ``sig`` are null without words.

    ``total`` documents hold ``size`` bytes of text. ``df`` has, as bytes, a
    32-bit number per shingle of the text: the documents that hold it.
    """
    slices, buckets = -(-size // SLICE_BYTES) or 1, -(-size // BUCKET_BYTES) or 1
    src = docs.select(
        (F.col(f"`{doc_id}`") if keep is None else keep).alias("doc"),
        wide_key(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key"),
        F.col(f"`{text}`").alias("text"),
    )
    # copies of a text differ in id and go to slices of their own
    src = src.withColumn("slice", F.pmod(F.xxhash64("key", "doc"), F.lit(slices)).cast("int"))
    kind = src.schema["doc"].dataType.simpleString()

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [(part, *shingles(part.column("text"))) for part in _parts(left)]
        _, place = np.unique(np.concatenate([h for _, h, _, _ in held]), return_inverse=True)
        answers = right.take(pa.array(np.argsort(right.column("bucket").to_numpy()))).column("df").to_pylist()
        df = np.frombuffer(b"".join(answers), np.uint32)[place]
        out, done = [], 0
        for part, h, counts, bounds in held:
            own = df[done : done + len(h)]
            done += len(h)
            sig = sample(h, counts * (np.log(total / own) + 1.0), bounds)
            full = np.diff(bounds) > 0
            # equal multisets of shingles, equal class
            sums = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(spans.mix(h ^ spans.mix(counts.astype(np.uint64))), out=sums[1:])
            cls = spans.mix(sums[bounds[1:]] - sums[bounds[:-1]])
            at = np.arange(len(full) + 1) * SAMPLES
            lists = spans.lists(spans.signed(np.ascontiguousarray(sig).reshape(-1)), at, pa.int64())
            cls = pa.array(spans.signed(cls), mask=~full)
            dfs = pa.array([own[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            out.append(pa.RecordBatch.from_arrays([part.column("doc"), cls, part.column("key"), lists, dfs], names=["doc", "cls", "key", "sig", "df"]))
        return pa.Table.from_batches(out)

    answers = shingle_counts(src, buckets).groupBy("slice")
    return src.groupBy("slice").cogroup(answers).applyInArrow(sign, f"doc {kind}, cls long, key binary, sig array<long>, df binary")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _band_hashes() -> list[Column]:
    return [F.xxhash64(F.slice("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)]


def candidates(sigs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a < b`` of classes that share a small bucket, and ``(band, h, cls)`` of the members of large buckets.

    ``sigs`` has ``(cls, sig)``, one row a class. Pairs are bounded by ``SMALL``
    a member and bucket.
    """
    bands = sigs.select("cls", F.posexplode(F.array(*_band_hashes())).alias("band", "h"))
    sizes = bands.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = hand_over(bands.join(sizes, ["band", "h"]), "buckets")
    few, many = held.filter(F.col("n") <= SMALL), held.filter(F.col("n") > SMALL).select("band", "h", "cls")
    other = few.select("band", "h", F.col("cls").alias("b"))
    pairs = few.select("band", "h", F.col("cls").alias("a")).join(other, ["band", "h"]).filter("a < b").select("a", "b")
    return hand_over(pairs.distinct(), "candidate-pairs"), many if many.limit(1).count() else None


def similarity(a: pa.Array, b: pa.Array, known: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of texts, pair by pair."""
    parts = []
    for texts in (a, b):
        h, counts, bounds = shingles(texts)
        parts.append((spans.owner(bounds), h, weigh(h, counts, known, idf)))
    doc, h, w = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    both = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), len(a))
    total = np.bincount(doc, w, len(a))
    return both / np.maximum(total - both, 1e-12)


def _weighted(texts: pa.Array, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of a text's shingles, the k-th copy of one named apart, with text and weight of one copy; total weights."""
    docs, names, weights, done = [], [], [], 0
    for part in spans.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        h, counts, bounds = shingles(part.column("text"))
        at = np.repeat(np.arange(len(h)), counts)
        copy = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        docs.append(done + spans.owner(bounds)[at])
        names.append(np.where(copy == 0, h[at], spans.mix(h[at] ^ spans.mix(copy.astype(np.uint64)))))
        weights.append(weigh(h, np.ones(len(h)), known, idf)[at])
        done += len(part)
    doc, name, w = np.concatenate(docs), np.concatenate(names), np.concatenate(weights)
    return doc, name, w, np.bincount(doc, w, len(texts))


def all_similarities(a: pa.Array, b: pa.Array, known: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every text of ``a`` (row) to every text of ``b`` (column).

    The smaller of two counts is the number of copies both hold, so shared
    weight is a product of matrices over the names that occur on both sides.
    """
    doc_a, name_a, w, total_a = _weighted(a, known, idf)
    doc_b, name_b, _, total_b = _weighted(b, known, idf)
    shared = np.intersect1d(name_a, name_b)
    both = np.zeros((len(a), len(b)))

    def columns(doc, name, values):
        at = np.minimum(np.searchsorted(shared, name), max(0, len(shared) - 1))
        hit = np.flatnonzero(shared[at] == name) if len(shared) else np.zeros(0, np.int64)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return doc[hit], at[hit], values[hit]

    doc_a, at_a, w = columns(doc_a, name_a, w)
    doc_b, at_b, one = columns(doc_b, name_b, np.ones(len(name_b)))
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        sides = []
        for doc, at, values, n in ((doc_a, at_a, w, len(a)), (doc_b, at_b, one, len(b))):
            x, y = np.searchsorted(at, [low, low + width])
            side = np.zeros((n, width))
            side[doc[x:y], at[x:y] - low] = values[x:y]
            sides.append(side)
        both += sides[0] @ sides[1].T
    return both / np.maximum(total_a[:, None] + total_b[None, :] - both, 1e-12)


def _texts(needed: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``(cls, text, df)`` of the classes ``needed``; copies of a text are dropped on the map side already."""
    needed = needed.distinct().join(classes.select("cls", "key"), "cls")
    src = docs.select(wide_key(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key"), F.col(f"`{text}`").alias("text"))
    once = src.join(needed, "key").groupBy("cls").agg(F.first("text").alias("text"))
    return hand_over(once.join(classes.select("cls", "df"), "cls"), "candidate-texts")


def _similarities(pairs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """``(a, b, similarity)`` of pairs, by their whole texts; computed once and handed over."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"), F.col("df").alias(f"df_{c}")), c)
    both = both.select("a", "b", "text_a", "text_b", "df_a", "df_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text_a"):
                for small in spans.slices(part, "text_b"):
                    text_a, text_b, df_a, df_b = (small.column(c) for c in ("text_a", "text_b", "df_a", "df_b"))
                    known = idf_table(pa.concat_arrays([text_a, text_b]), pa.concat_arrays([df_a, df_b]), total)
                    s = similarity(text_a, text_b, *known)
                    yield pa.RecordBatch.from_arrays([small.column("a"), small.column("b"), pa.array(s)], names=["a", "b", "similarity"])

    return hand_over(both.mapInArrow(run, "a long, b long, similarity double"), "similarities")


def _block_links(many: DataFrame, sigs: DataFrame, texts: DataFrame, total: int, threshold: float) -> DataFrame:
    """``(cls, root, n)`` per two blocks of a large bucket: links of a class there, and a class it is connected with.

    A pair counts in the first large bucket that holds it, and not at all if a
    small one does.
    """
    members = many.join(texts.select("cls", F.octet_length("text").alias("bytes")), "cls")
    blocks = members.groupBy("band", "h").agg(F.ceil(F.count(F.lit(1)) / BLOCK + F.sum("bytes") / BLOCK_BYTES).cast("long").alias("k"))
    dealt = hand_over(many.join(blocks, ["band", "h"]), "large-buckets")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), "k"))
    met = dealt.select("band", "h", "cls", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    met = met.select("band", "h", "cls", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    where = many.groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1, band)")).alias("large"))
    known = sigs.select("cls", F.array(*_band_hashes()).alias("hashes")).join(where, "cls").join(texts, "cls")
    met = met.join(known, "cls").select("band", "h", "lo", "hi", "block", "cls", "hashes", "large", "text", "df")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        band, lo, hi = (group.column(c)[0].as_py() for c in ("band", "lo", "hi"))
        cls, block, large = (group.column(c).to_numpy() for c in ("cls", "block", "large"))
        hashes = pa.concat_arrays(group.column("hashes").chunks).flatten().to_numpy().reshape(len(cls), -1)
        rows, cols = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        open_ = rows[:, None] < cols[None, :] if lo == hi else np.ones((len(rows), len(cols)), dtype=bool)
        for i in range(hashes.shape[1]):
            if i != band:
                same = hashes[rows, i][:, None] == hashes[cols, i][None, :]
                open_ &= ~(same if i < band else same & ((large[rows] >> i) & 1 == 0)[:, None])
        some, any_ = open_.any(axis=1), open_.any(axis=0)
        rows, cols, open_ = rows[some], cols[any_], open_[some][:, any_]
        linked = np.zeros((len(cls), len(cls)), dtype=bool)
        if len(rows):
            texts, dfs = (pa.concat_arrays(group.column(c).chunks) for c in ("text", "df"))
            alike = all_similarities(texts.take(pa.array(rows)), texts.take(pa.array(cols)), *idf_table(texts, dfs, total))
            linked[np.ix_(rows, cols)] = open_ & (alike >= threshold - 1e-9)
        linked |= linked.T
        n, root = linked.sum(axis=1), np.arange(len(cls))
        hit = np.flatnonzero(n)
        linked = linked[np.ix_(hit, hit)]
        while len(hit):
            least = np.minimum(root[hit], np.where(linked, root[hit][None, :], len(cls)).min(axis=1))
            if (least == root[hit]).all():
                break
            root[hit] = least
        return pa.table({"cls": cls[hit], "root": cls[root[hit]], "n": n[hit].astype(np.int64)})

    return hand_over(met.groupBy("band", "h", "lo", "hi").applyInArrow(run, "cls long, root long, n long"), "block-links")


def verified(sigs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, total: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b)`` that connect what candidates with a similarity of ``threshold`` connect, and ``(cls, n_links)``.

    The edges are the links themselves where buckets are small, and a forest
    for every two blocks of a large bucket. Links are counted over all pairs.
    """
    pairs, many = candidates(sigs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    texts = _texts(needed if many is None else needed.union(many.select("cls")), classes, docs, text)
    links = _similarities(pairs, texts, total).filter(F.col("similarity") >= threshold - 1e-9).select("a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("n"))
    if many is not None:
        found = _block_links(many, sigs, texts, total, threshold)
        links = hand_over(links.union(found.filter("cls != root").select(*_ordered("cls", "root"))).distinct(), "links")
        degree = degree.union(found.select("cls", "n"))
    discard(texts, pairs)
    return links, degree.groupBy("cls").agg(F.sum("n").alias("n_links"))


def _classes(docs: DataFrame, text: str, doc_id: str, threshold: float, keep: Column | None):
    """The rows with their ``cls``, the links of every class, and the root class of every class with a link."""
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()
    signed = hand_over(signatures(docs, total, size, text, doc_id, keep), "signatures")
    classes = signed.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("sig").alias("sig"), F.min("key").alias("key"), F.first("df").alias("df"))
    classes = hand_over(classes, "classes")
    links, degree = verified(classes.select("cls", "sig"), classes, docs, text, total, threshold)
    return signed, degree, components(links)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, n_links`` of every document.

    ``class_id`` is the smallest id of the class, ``class_size`` its documents
    and ``n_links`` how many different texts the document is linked to.
    """
    signed, degree, roots = _classes(docs, text, doc_id, threshold, None)
    per_cls = signed.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    per_cls = per_cls.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
    per_cls = per_cls.withColumn("root", F.coalesce("root", "cls"))
    whole = per_cls.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    per_cls = per_cls.join(whole, "root").select("cls", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    found = signed.filter("cls IS NOT NULL").join(per_cls, "cls").select(F.col("doc").alias("doc_id"), "class_id", "class_size", "n_links")
    none = signed.filter("cls IS NULL").select(
        F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links")
    )
    return found.unionByName(none)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate class, the one with the smallest id.

    Of rows that agree in id and class one stays; rows without words all stay.
    """
    row = wide_key(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    signed, _, roots = _classes(docs, text, doc_id, threshold, F.struct(F.col(f"`{doc_id}`").alias("id"), row.alias("row")))
    rank = F.struct(F.col("doc.id").isNull(), "doc.id", "doc.row")
    per_cls = signed.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(rank).alias("first"))
    per_cls = per_cls.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    chosen = per_cls.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("one"))
    empty = signed.filter("cls IS NULL").select("doc.row", F.lit(False).alias("one")).distinct()
    chosen = hand_over(chosen.union(empty), "chosen")
    discard(signed)
    rows = docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).join(chosen, "row")
    once = rows.filter("one").groupBy("row").agg(F.first("doc").alias("doc"))
    out = once.select("doc").union(rows.filter("NOT one").select("doc"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
