"""Text vectors: a default embedding by feature hashing and a batch hook for any other."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.text import TOKEN

BATCH = 16
TEXTS = 256  # texts that the default embedding takes at once


def hashed_vectors(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Token counts hashed to ``dim`` slots and scaled to length 1."""
    pattern = re.compile(TOKEN)
    slots: dict[str, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for token in pattern.findall((t or "").lower()):
                slot = slots.get(token)
                if slot is None:
                    slot = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
                    if len(slots) < 200_000:
                        slots[token] = slot
                out[i, slot] += 1
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1, norms)

    return embed


def in_steps(parts: Iterator[pa.Array], call: Callable[[list[str]], object], step: int) -> Iterator[pa.Array]:
    """The vectors of every part, worked out for ``step`` texts at once."""
    kind = pa.list_(pa.float64())
    for part in parts:
        found = [pa.array(list(call(part[i : i + step].to_pylist())), kind) for i in range(0, len(part), step)]
        yield pa.concat_arrays(found) if found else pa.array([], kind)


def embed(text: Column, fn: Callable[[list[str]], object] | None = None, batch: int = BATCH, dim: int = 64) -> Column:
    """``array<double>`` per text; ``fn`` maps a list of at most ``batch`` texts to their vectors.

    Texts stay in their Arrow batch until their turn: as Python strings only those of one call are held.
    """
    @F.arrow_udf("array<double>")
    def vectorise(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_steps(parts, fn or hashed_vectors(dim), batch if fn else TEXTS)

    return vectorise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors clamped to [0, 1]; 0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.least(F.greatest(F.try_divide(dot(a, b), norms), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
