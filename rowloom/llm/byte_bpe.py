"""Byte-level BPE with vectorised pre-tokenisation: texts to ids and back.

Pre-tokens are found without a regular expression. Every code point of a batch
of texts has a class; where a match depends on what follows (the end of a run
of white space, a contraction), the class says so. What a class does to the
state of the matcher is a function from states to states, and functions compose
associatively: the few that can arise are numbered, their products tabled, and
a scan over blocks of the batch, all blocks side by side, gives the state before
every code point. State and class tell where a pre-token starts.

The slices are encoded from a table of those seen before; new ones are merged
together, the pair of lowest rank first, in all slices at once, very long ones
by a heap. Ends of
the pre-tokens in ids and bytes are kept, so that ids can be cut and decoded at them.

Defined cases: a null text is an empty one; the pattern is the one of the rank
files, contractions in lower case only; every byte has an id, so that every
text is encoded and decoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import spans

#: slices whose ids a task keeps
KEPT_SLICES = 1_000_000
#: slices longer than this are merged by a heap of their pairs, shorter ones all side by side
HEAP_BYTES = 1024
#: scan blocks of a batch
_BLOCK = 1 << 10

# classes of code points, some told apart by what follows
LETTER, NUMBER, MARK, SHORT, LONG, GAP, LAST_BLANK, LAST_GAP, START = range(9)
# states of the matcher: nothing open, in a run, after a blank that may lead a run, one or two letters of a contraction to come
CLOSED, IN_LETTERS, IN_NUMBER, IN_MARKS, IN_GAP, LED, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The state after a code point and whether it starts a pre-token."""
    if cls == START:
        return CLOSED, False
    if cls == LETTER and state in (ONE_MORE, TWO_MORE):
        return (CLOSED if state == ONE_MORE else ONE_MORE), False
    if cls in (LETTER, NUMBER):
        run = IN_LETTERS if cls == LETTER else IN_NUMBER
        return run, state not in (run, LED)
    if cls in (MARK, SHORT, LONG):
        inside = state in (IN_MARKS, LED)
        if inside or cls == MARK:
            return IN_MARKS, not inside
        return (ONE_MORE if cls == SHORT else TWO_MORE), True
    if cls == GAP:
        return IN_GAP, state != IN_GAP
    return (LED if cls == LAST_BLANK else CLOSED), True


class _Scan:
    """The functions that classes make of states, closed under composition."""

    def __init__(self):
        n_states = 8
        moves = [tuple(_step(s, c)[0] for s in range(n_states)) for c in range(9)]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(n_states)), *moves]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in moves:
                fg = tuple(g[s] for s in f)
                if fg not in known:
                    known[fg] = len(known)
                    todo.append(fg)
        funcs = list(known)
        self.of_class = np.array([known[m] for m in moves], dtype=np.int32)
        self.apply = np.array(funcs, dtype=np.uint8)
        self.product = np.array([[known[tuple(g[s] for s in f)] for g in funcs] for f in funcs], dtype=np.int32)
        self.starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(n_states)])

    def states(self, classes: np.ndarray) -> np.ndarray:
        """The state before every code point, beginning closed."""
        n = len(classes)
        blocks = max(1, -(-n // _BLOCK))
        padded = np.full(blocks * _BLOCK, START, dtype=np.uint8)
        padded[:n] = classes
        steps = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
        n_funcs = np.int32(len(self.apply))
        product = self.product.ravel()
        whole = self.of_class[steps[0]]
        for t in range(1, _BLOCK):
            whole = product[whole * n_funcs + self.of_class[steps[t]]]
        # products of blocks before each block, by doubling
        upto, shift = whole.copy(), 1
        while shift < blocks:
            upto[shift:] = product[upto[:-shift] * n_funcs + upto[shift:]]
            shift *= 2
        state = np.zeros(blocks, dtype=np.uint8)
        state[1:] = self.apply[upto[:-1], CLOSED]
        moves = self.apply[self.of_class].astype(np.uint8)  # class, state -> state
        flat = moves.ravel()
        out = np.empty((_BLOCK, blocks), dtype=np.uint8)
        for t in range(_BLOCK):
            out[t] = state
            state = flat[steps[t].astype(np.int32) * 8 + state]
        return out.T.reshape(-1)[:n]


def _class_table() -> np.ndarray:
    """The class of every code point by its general category and the white-space property."""
    by_kind = np.full(128, MARK, dtype=np.uint8)
    by_kind[ord("L")], by_kind[ord("N")] = LETTER, NUMBER
    kinds = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table = by_kind[kinds]
    for c in np.flatnonzero(kinds == ord("Z")):
        table[c] = GAP
    table[[*range(0x09, 0x0E), 0x85]] = GAP
    return table


_tables: dict[str, object] = {}


def _shared(name: str, make):
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def pretokens(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of documents with these bounds."""
    scan, table = _shared("scan", _Scan), _shared("classes", _class_table)
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    # each document is led by a start mark, which also ends the one before
    docs = len(bounds) - 1
    place = np.arange(len(points)) + np.repeat(np.arange(1, docs + 1), np.diff(bounds))
    cls = np.full(len(points) + docs + 2, START, dtype=np.uint8)
    cls[place] = table[points]
    full = np.zeros(len(cls), dtype=np.int32)
    full[place] = points
    body = cls[:-2]
    following = cls[1:-1]
    gap = body == GAP
    last = gap & (following != GAP) & (following != START)
    body[last] = np.where(full[:-2][last] == 0x20, LAST_BLANK, LAST_GAP)
    quote = np.flatnonzero(full[:-2] == 0x27)
    one, two = full[quote + 1], full[quote + 2]
    body[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
    body[quote[np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])]] = LONG
    state = scan.states(body)
    starts = scan.starts[state, body]
    return np.flatnonzero(starts[place])


class Ranks:
    """A rank file: merges of byte strings, and their cached application."""

    def __init__(self, path: str, kept: int = KEPT_SLICES):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ids.values()) + 1
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        # every way to write a token as two tokens: when both lie side by side they merge into it
        left, right, made = [], [], []
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        self.size = size
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.merged = np.array(made, dtype=np.int64)[order]
        self.slots = self._hash_table()
        self.kept = kept
        self.known: dict[str, bytes] = {}

    def _hash_table(self):
        """Open addressing over the pairs, so that most lookups take one step."""
        self.bits = 20
        n = 1 << self.bits
        table = np.full(n, -1, dtype=np.int64)
        left = np.arange(len(self.pairs))
        at = self._place(self.pairs)
        while len(left):
            free = table[at] < 0
            table[at[free]] = left[free]
            lost = table[at] != left
            left, at = left[lost], (at[lost] + 1) & (n - 1)
        return table

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, ``size`` where it does not."""
        keys = left * self.size + right
        out = np.full(len(keys), self.size, dtype=np.int64)
        at = self._place(keys)
        open_ = np.arange(len(keys))
        while len(open_):
            slot = self.slots[at]
            used = slot >= 0
            open_, at, slot = open_[used], at[used], slot[used]
            hit = self.pairs[slot] == keys[open_]
            out[open_[hit]] = self.merged[slot[hit]]
            open_, at = open_[~hit], (at[~hit] + 1) & (len(self.slots) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of byte strings: in each the leftmost pair of lowest rank merges until none is left."""
        long = {i: self._merge_long(p) for i, p in enumerate(pieces) if len(p) > HEAP_BYTES}
        if long:
            rest = iter(self._merge_side_by_side([p for i, p in enumerate(pieces) if i not in long]))
            return [long[i] if i in long else next(rest) for i in range(len(pieces))]
        return self._merge_side_by_side(pieces)

    def _merge_long(self, piece: bytes) -> bytes:
        """One long byte string, its pairs in a heap by rank and place: time grows with its length, times the logarithm."""
        symbols = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self._rank(symbols[:-1], symbols[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < self.size]
        heapq.heapify(heap)
        symbols, ranks, n = symbols.tolist(), [*ranks.tolist(), self.size], len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ids = self.tokens, self.ids
        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue
            gone = after[i]
            symbols[i], ranks[gone], symbols[gone] = rank, self.size, -1
            after[i] = following = after[gone]
            if following < n:
                before[following] = i
            for at in (before[i], i):
                if at >= 0:
                    ranks[at] = self.size
                    if after[at] < n:
                        made = ids.get(tokens[symbols[at]] + tokens[symbols[after[at]]], self.size)
                        ranks[at] = made
                        if made < self.size:
                            heapq.heappush(heap, (made, at))
        return np.array([x for x in symbols if x >= 0], dtype="<u4").tobytes()

    def _merge_side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces at once, one merge each in a pass."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        symbols = self.single[data]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done_owner: list[np.ndarray] = []
        done_symbols: list[np.ndarray] = []
        ranks = np.full(len(symbols), self.size, dtype=np.int64)
        if len(symbols) > 1:
            inner = owner[1:] == owner[:-1]
            ranks[:-1][inner] = self._rank(symbols[:-1][inner], symbols[1:][inner])
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(symbols)))
            best = np.minimum.reduceat(ranks, heads)
            live = best < self.size
            if not live.all():
                rest = np.repeat(live, sizes)
                done_owner.append(owner[~rest])
                done_symbols.append(symbols[~rest])
                symbols, owner, ranks = symbols[rest], owner[rest], ranks[rest]
                if not len(symbols):
                    break
                sizes, best = sizes[live], best[live]
                heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            at = hits[np.searchsorted(hits, heads)]
            symbols[at] = best
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            at = moved[at]
            for spot in (at, at - 1):
                spot = spot[spot >= 0]
                ranks[spot] = self.size
                ok = spot[spot + 1 < len(symbols)]
                ok = ok[owner[ok] == owner[ok + 1]]
                ranks[ok] = self._rank(symbols[ok], symbols[ok + 1])
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        packed = symbols[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, slices: set[str]) -> None:
        new = slices - self.known.keys()
        if len(self.known) + len(new) > self.kept:
            self.known, new = {}, slices
        pieces, texts = [], []
        for s in new:
            b = s.encode()
            i = self.ids.get(b)
            if i is not None:
                self.known[s] = i.to_bytes(4, "little")
            else:
                pieces.append(b)
                texts.append(s)
        if pieces:
            self.known.update(zip(texts, self.merge(pieces)))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, list[bytes]]]:
        """Per text its packed ids and those of each pre-token."""
        texts = [t or "" for t in texts]
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts = pretokens(points, bounds)
        first = np.searchsorted(starts, bounds).tolist()
        at = starts.tolist()
        slices = [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])]
        self.learn(set(slices))
        ids = list(map(self.known.__getitem__, slices))
        return [(b"".join(ids[a:b]), ids[a:b]) for a, b in zip(first, first[1:])]

    def decode(self, packed: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each pre-token of a text ends: in ids, and in bytes."""
        ends = np.cumsum([len(p) // 4 for p in pieces])
        ids = np.frombuffer(b"".join(pieces), "<u4")
        upto = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        return ends, upto[ends]


_ranks: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """The rank file of this Python worker."""
    if path not in _ranks:
        _ranks[path] = Ranks(path)
    return _ranks[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep, ids, id_ends, byte_ends`` of every document: packed ids, and the ends of its pre-tokens in ids and bytes."""
    src = docs.select(F.col(f"`{keep}`").alias("keep"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            for part in spans.slices(batch, "text"):
                got = table.encode(part.column("text").to_pylist())
                at = [table.offsets(pieces) if pieces else ([], []) for _, pieces in got]
                cols = [
                    part.column("keep"),
                    pa.array([packed for packed, _ in got], pa.binary()),
                    pa.array([a for a, _ in at], pa.list_(pa.int64())),
                    pa.array([b for _, b in at], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["keep", "ids", "id_ends", "byte_ends"])

    kind = src.schema["keep"].dataType.simpleString()
    out = src.mapInArrow(run, f"keep {kind}, ids binary, id_ends array<long>, byte_ends array<long>")
    return out.withColumnRenamed("keep", keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: str = "doc_id") -> DataFrame:
    """``keep, bytes`` of packed ids; a null stays null."""
    src = encoded.select(F.col(f"`{keep}`").alias("keep"), F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            done = [None if x is None else table.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("keep"), pa.array(done, pa.binary())], names=["keep", "bytes"])

    kind = src.schema["keep"].dataType.simpleString()
    return src.mapInArrow(run, f"keep {kind}, bytes binary").withColumnRenamed("keep", keep)


def digests(docs: DataFrame, path: str, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep, n_tokens, ids_sha256, decoded_sha256``: encoded, decoded from the ids alone, and digested in one pass."""
    src = docs.select(F.col(f"`{keep}`").alias("keep"), F.col(f"`{text}`").alias("text"))
    names = ["keep", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            for part in spans.slices(batch, "text"):
                packed = [p for p, _ in table.encode(part.column("text").to_pylist())]
                cols = [
                    part.column("keep"),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(table.decode(p)).hexdigest() for p in packed], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = src.schema["keep"].dataType.simpleString()
    out = src.mapInArrow(run, f"keep {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("keep", keep)
