"""Ranked lexical search by document intervals and range maxima.

A table of queries is answered against all documents. Queries travel to the
documents in blocks of at most ``BLOCK_TERMS`` terms (one query at least), one
pass over the documents each; only the terms of a block are counted. Counted
documents are handed over, document frequencies and lengths are aggregated over
all of them, and every task then takes the documents it reads in shards of about
``SHARD`` postings. A term that most documents hold is spread over all shards.

Within a shard every term has a posting list by document with the impact of each
posting and a sparse table of range maxima over it. A query starts with the
interval of all documents. An interval's bound is the sum of the largest impact
of each term in it, two table look-ups a term. The interval of the highest bound
is taken first: the document of its largest impact is scored and splits it in
two, each with a bound of its own. Intervals of at most ``LEAF`` postings are
scored as a whole. Nothing is left to find once the highest bound is below the
``k``-th score, that of earlier shards of the task included. The best ``k`` of
each task meet in one top-k per query, cut before the shuffle.

Scores are integers. A term is a maximal run of ASCII letters, digits and all
code points from 128 up; only A to Z are lower-cased. With N documents that hold
a term, L terms in them, ``n`` terms in one document, document frequency ``df``
and ``tf`` occurrences, a term adds ``w * (10**9 * tf // (1000 * tf + 12 * m))``
for each time the query has it, where ``w = floor(1000 * ln((2N + 2) / (2df +
1)))`` and ``m = 75 + 25 * n * N // L``.

Defined cases: a null or empty text has no terms, is no candidate and as a query
has no rows; every row of either table counts for itself, so equal query ids get
a ranking each and equal document ids may both appear; equal scores go by
ascending document id, null first. Candidates are told apart by a 64-bit hash
and then compared byte by byte.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import spans
from rowloom.llm.handover import hand_over
from rowloom.plans.ranking import number_rows, top_rows

#: terms of the queries that travel together
BLOCK_TERMS = 200_000
#: postings of a shard, one document at least
SHARD = 1 << 18
#: postings of an interval that is scored as a whole
LEAF = 2048

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of their terms, and each text's bounds in these."""
    data, bounds = spans.flat(texts)
    data = _LOWER[data]
    return data, *spans.runs(_TERM[data], bounds)


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """``(q, term, times)``: the terms of every query; ``queries`` has a column ``q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends, bounds = _terms(batch.column("text"))
            body = data.tobytes()
            for i, q in enumerate(batch.column("q").to_pylist()):
                found: dict[bytes, int] = {}
                for a, b in zip(starts[bounds[i] : bounds[i + 1]].tolist(), ends[bounds[i] : bounds[i + 1]].tolist()):
                    found[body[a:b]] = found.get(body[a:b], 0) + 1
                yield pa.RecordBatch.from_pydict(
                    {"q": pa.array([q] * len(found), pa.int64()), "term": pa.array([t.decode() for t in found], pa.string()), "times": pa.array(list(found.values()), pa.int64())}
                )

    return queries.select("q", F.col(f"`{text}`").alias("text")).mapInArrow(run, "q long, term string, times long")


class Vocabulary:
    """The terms of a block of queries, found among the terms of texts."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.size = np.array([len(t) for t in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        hashes = spans.span_hashes(self.data, self.start, self.start + self.size) if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given terms are in the vocabulary, and their numbers there."""
        if not len(self.hashes) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = spans.span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        where = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[where]]
        same = (ends - starts)[where] == self.size[term]
        where, term = where[same], term[same]
        same = np.ones(len(where), dtype=bool)
        size = self.size[term]
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            step = np.arange(n)
            a, b = data[starts[where[rows]][:, None] + step], self.data[self.start[term[rows]][:, None] + step]
            same[rows] = (a == b).all(axis=1)
        return where[same], term[same]


COUNTED = "n long, terms array<int>, times array<int>"


def count_terms(docs: DataFrame, terms: list[str], text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``(doc_id, n, terms, times)`` of every document: all its terms counted, and the given ones among them by number."""
    src = docs.select(F.col(f"`{keep}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = Vocabulary(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                data, starts, ends, bounds = _terms(part.column("text"))
                where, term = known.find(data, starts, ends)
                doc = np.searchsorted(bounds, where, side="right") - 1
                pair, times = np.unique(doc * max(1, len(terms)) + term, return_counts=True)
                edges = np.searchsorted(pair, np.arange(len(bounds)) * max(1, len(terms)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(bounds), pa.int64()),
                        spans.lists((pair % max(1, len(terms))).astype(np.int32), edges, pa.int32()),
                        spans.lists(times.astype(np.int32), edges, pa.int32()),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {COUNTED}")


class Shard:
    """Posting lists of some documents, one after the other, with a sparse table of range maxima over each."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        """``term`` and ``doc`` ascend together; ``doc`` counts from 0."""
        self.doc, self.impact, self.n_docs = doc, impact, int(doc.max()) + 1 if len(doc) else 0
        self.key = term * self.n_docs + doc
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        longest = int(np.diff(self.first).max()) if len(doc) else 0
        # where the largest impact of 2**j postings from i on lies; look-ups stay within one list
        levels = [np.arange(len(doc), dtype=np.int32)]
        while 1 << len(levels) <= longest:
            below, step = levels[-1], 1 << (len(levels) - 1)
            ahead = np.concatenate([below[step:], below[len(below) - step :]])
            levels.append(np.where(impact[below] >= impact[ahead], below, ahead))
        self.table = np.stack(levels)
        self.log = np.zeros(longest + 1, dtype=np.int64)
        for j in range(1, len(levels)):
            self.log[1 << j :] = j

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the largest impact of each range lies; ranges are not empty."""
        j = self.log[hi - lo]
        a, b = self.table[j, lo], self.table[j, hi - (1 << j)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def whole(self, lo: np.ndarray, hi: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the ranges and their scores."""
        size = hi - lo
        at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        docs, back = np.unique(self.doc[at], return_inverse=True)
        scores = np.zeros(len(docs), dtype=np.int64)
        np.add.at(scores, back, self.impact[at] * np.repeat(times, size))
        return docs, scores

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, least: int = 1, leaf: int = LEAF) -> list[tuple[int, int]]:
        """``(score, doc)`` of the ``k`` best documents from ``least`` up, equal scores by ascending doc, and perhaps a few more."""
        lo, hi = self.first[terms], self.first[terms + 1]
        has = hi > lo
        lo, hi, terms, times = lo[has], hi[has], terms[has], times[has]
        best: list[tuple[int, int]] = []  # a heap of (score, -doc)
        queue: list[tuple] = []
        made = 0

        def offer(score: int, doc: int) -> None:
            nonlocal least
            if score >= least:
                heapq.heappush(best, (score, -doc))
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    least = max(least, best[0][0])

        def add(lo: np.ndarray, hi: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
            nonlocal made
            has = np.flatnonzero(hi > lo)
            if not len(has):
                return
            lo, hi, terms, times = lo[has], hi[has], terms[has], times[has]
            top = self.largest(lo, hi)
            impact = self.impact[top] * times
            bound = int(impact.sum())
            if bound >= least:
                made += 1
                heapq.heappush(queue, (-bound, made, lo, hi, terms, times, int(self.doc[top[impact.argmax()]])))

        add(lo, hi, terms, times)
        while queue and -queue[0][0] >= least:
            _, _, lo, hi, terms, times, split = heapq.heappop(queue)
            if int((hi - lo).sum()) <= leaf:
                docs, scores = self.whole(lo, hi, times)
                good = np.flatnonzero(scores >= least)
                for d, s in zip(docs[good].tolist(), scores[good].tolist()):
                    offer(s, d)
                continue
            at = np.searchsorted(self.key, terms * self.n_docs + split)
            hit = (at < hi) & (self.doc[np.minimum(at, len(self.doc) - 1)] == split)
            offer(int((self.impact[at[hit]] * times[hit]).sum()), split)
            add(lo, at, terms, times)
            add(at + hit, hi, terms, times)
        return [(s, -d) for s, d in sorted(best, reverse=True)]


def weights(frequencies: dict[int, int], n_docs: int, n_terms: int) -> np.ndarray:
    """The weight of each term number; 0 where no document has it."""
    out = np.zeros(n_terms, dtype=np.int64)
    for term, df in frequencies.items():
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


def _before(score: int, key) -> tuple:
    """Sorts higher scores first, then smaller keys, null before any."""
    return (-score, key is not None, key if key is not None else 0)


def best_documents(counted: DataFrame, wanted: dict[int, tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """``(q, doc_id, score)``: the best ``k`` documents of every task for every query."""
    n_terms = len(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {q: [] for q in wanted}

        def search(parts: list[pa.RecordBatch]) -> None:
            docs = pa.Table.from_batches(parts).combine_chunks()
            # documents of a shard ascend by id, so that equal scores are taken in order
            docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
            terms, times = (docs.column(c).combine_chunks() for c in ("terms", "times"))
            size = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            n = docs.column("n").to_numpy().astype(np.int64)
            m = 75 + 25 * n * n_docs // length
            tf = times.flatten().to_numpy().astype(np.int64)
            term = terms.flatten().to_numpy().astype(np.int64)
            order = np.argsort(term, kind="stable")
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            shard = Shard(term[order], doc[order], impact[order], n_terms)
            ids = docs.column("doc_id")
            for q, (its, often) in wanted.items():
                have = found[q]
                hits = shard.search(its, often, k, have[-1][0] if len(have) == k else 1)
                if hits:
                    have += [(s, ids[d].as_py()) for s, d in hits]
                    have.sort(key=lambda x: _before(*x))
                    del have[k:]

        waiting, postings = [], 0
        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(size):
                gone = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, gone + SHARD - postings, side="right")))
                waiting.append(batch.slice(start, stop - start))
                postings += int(size[stop - 1] - gone)
                start = stop
                if postings >= SHARD or start < len(size):
                    search(waiting)
                    waiting, postings = [], 0
        if waiting:
            search(waiting)
        out = [(q, key, score) for q, have in found.items() for score, key in have]
        kind = counted_type
        for at in range(0, len(out), 10_000):
            cols = list(zip(*out[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64())], names=["q", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    counted_type = to_arrow_type(counted.schema["doc_id"].dataType)
    kept = counted.filter(F.size("terms") > 0)
    return kept.mapInArrow(run, f"q long, doc_id {counted.schema['doc_id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, text: str = "text", keep: str = "doc_id", query_text: str = "text", item: str = "item_id",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every query with a score above 0."""
    asked = queries.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{query_text}`").alias("text"))
    asked = hand_over(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    wanted = hand_over(query_terms(asked), "query-terms")
    sizes = wanted.groupBy("q").agg(F.count(F.lit(1)).alias("size"))
    blocks = number_rows(sizes, [], ["q"], number=None, sums={"upto": F.col("size")})
    blocks = hand_over(blocks.select("q", F.expr(f"(upto - size) div {block_terms}").alias("block")), "query-blocks")
    last = blocks.agg(F.max("block")).first()[0]
    results = []
    for block in range(last + 1 if last is not None else 0):
        # bounded: block_terms rows and those of the query that reaches beyond
        rows = wanted.join(blocks.filter(F.col("block") == block).select("q"), "q").collect()
        if not rows:
            continue
        terms = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        by_query: dict[int, tuple[list, list]] = {}
        for r in rows:
            its = by_query.setdefault(r.q, ([], []))
            its[0].append(number[r.term])
            its[1].append(r.times)
        arrays = {q: (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for q, (a, b) in sorted(by_query.items())}
        counted = hand_over(count_terms(docs, terms, text, keep), "counted")
        total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        weight = weights({r.term: r.df for r in frequency}, total.docs, len(terms))
        results.append(hand_over(best_documents(counted, arrays, weight, total.docs, max(1, total.terms), k), "found"))
    if not results:
        found = docs.select(F.lit(0).cast("long").alias("q"), F.col(f"`{keep}`").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    else:
        found = results[0]
        for more in results[1:]:
            found = found.union(more)
    ranked = top_rows(found, ["q"], [F.desc("score"), F.asc_nulls_first("doc_id")], k, "rank")
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: the 20 best of ``documents`` for every row of ``benchmark`` in DuckDB
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count_if(len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS length FROM d),
m AS (SELECT r, doc_id, (75 + (25 * len(t) * n_docs) // length)::BIGINT AS m FROM d, s WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
x AS (SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 20
"""
