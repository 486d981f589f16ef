"""Token ids of whole texts by a tokenizer file of the tokenizers library, word by word.

A tokenizer whose own description says that it drops white space, splits into
runs of letters, digits or marks and writes them byte by byte (``BYTE_WORDS``)
never merges over white space, so the ids of a text are those of its words in
order. The words of a batch of texts are told apart by their hashes; each
different one is looked up once among the words that the task has seen, up to a
bound, or given to the library, and the ids are then laid out for all words at
once. All other tokenizers are given whole texts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa

from rowloom.llm import spans

#: words whose ids a Python worker keeps
KEPT_WORDS = 1_200_000

# The description of a tokenizer of byte-level words, as its file has it.
BYTE_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: Latin letters and closing marks, the apostrophe aside: two pieces for the tokenizer
_LATIN_WORD = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
def _folded(text: str | None) -> str | None:
    """Latin text in lower case, which the tokenizer would make of it too; other text as it is, and special tokens."""
    if not text or "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordEncoder:
    """Encodes texts with the tokenizer file at ``path``, without special tokens.

    Ids are packed little-endian, two bytes each if the vocabulary allows it.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept = kept
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.by_word = self._words_suffice()
        # bytes as the characters that a byte-level vocabulary writes them with
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _words_suffice(self) -> bool:
        """The file describes byte-level words in lower case, and nothing else that would look beyond a word."""
        told = json.loads(self.tokenizer.to_str())
        own = all(told[k] == v for k, v in BYTE_WORDS.items()) and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        return own and all(t["special"] and t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in told["added_tokens"])

    def _pack(self, ids) -> bytes:
        packed = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _latin(self, word: str) -> bytes:
        """A run of Latin letters: one piece for the model, lower case, written byte by byte."""
        low = word.lower()
        if not low.isascii():
            low = "".join([self.shown[b] for b in low.encode()])
        return self._pack([t.id for t in self.model.tokenize(low)])

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not seen yet. Letters and the marks behind them are separate pieces."""
        got, odd, cores = {}, [], {}
        parts = _LATIN_WORD.fullmatch
        for w in words:
            m = parts(w.decode())
            if m:
                core, tail = m.groups()
                ids = cores.get(core)
                if ids is None:
                    ids = cores[core] = self.known.get(core.encode()) or self._latin(core)
                got[w] = ids + self._tail(tail) if tail else ids
            else:
                odd.append(w)
        for w, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
            got[w] = self._pack(e.ids)
        return got

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self.tails[tail] = self._pack(self.tokenizer.encode(tail, add_special_tokens=False).ids)
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of every text; a null text is an empty one."""
        if not self.by_word:
            return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        folded = pa.array([_folded(t) for t in texts], pa.large_string())
        data, bounds = spans.flat(folded)
        starts, ends, wb = spans.words(data, bounds)
        code, _ = pd.factorize(spans.span_hashes(data, starts, ends))
        n = int(code.max()) + 1 if len(code) else 0
        first = np.empty(n, dtype=np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        body = data.tobytes()
        words = [body[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.kept:
            new, self.known, self.tails = words, {}, {}
        self.known.update(self._learn(new))
        packed = [self.known[w] for w in words]
        # ids of the different words side by side, then of all words
        size = np.array([len(p) for p in packed], dtype=np.int64) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(packed), self.dtype)
        begin = np.cumsum(size) - size
        count = size[code]
        upto = np.concatenate([[0], np.cumsum(count)])
        laid = ids[np.repeat(begin[code] - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        cut = (upto[wb] * self.dtype.itemsize).tolist()
        return [laid[a:b] for a, b in zip(cut, cut[1:])]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """The encoder of this Python worker."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = WordEncoder(path, kept)
    return _encoders[path, kept]
