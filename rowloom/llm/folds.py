"""Held-out folds by document id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id counts as an empty text."""
    text = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)) == fold
