"""Keys of whole rows and texts, wide enough that no two of any corpus collide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide_key(*values: Column) -> Column:
    """A 128-bit key of the values; null differs from every value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.md5(F.concat(*parts)))
