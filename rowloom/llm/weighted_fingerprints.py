"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The terms of a text are its words in lower case, weighted by their counts. For
each sample a term gets r and c from Gamma(2, 1) and a uniform b, all drawn from
hashes of the term and the sample's number. A term of weight w lies on level
t = floor(ln w / r + b), and the term and level with the smallest
ln c - r (t - b + 1) are the sample. Two texts share a sample with the chance of
the generalised Jaccard similarity of their weights, the sum of the smaller over
the sum of the larger weights, so the share of equal samples estimates it.

A fingerprint is ``SAMPLES`` pieces of eight hex digits. Term counts and
samples are two aggregations keyed by document over rows that stay where the
text is; a text is never collected.

Defined cases: a null text is an empty one; a text without a letter or digit is
one term, itself; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.handover import hand_over
from rowloom.llm.keys import wide_key
from rowloom.plans.ranking import number_rows

SAMPLES = 32


def _uniform(h: Column, shift: int) -> Column:
    """A number in (0, 1) from 32 bits of a hash."""
    bits = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFFFFFF)) if shift else h.bitwiseAND(F.lit(0xFFFFFFFF))
    return (bits.cast("double") + 0.5) * (2.0**-32)


def _sample(term: Column, log_weight: Column, j: int) -> Column:
    """One sample's value of a term as a long that orders as the value does and names term and level.

    The value takes the upper 32 bits, in steps of 2**-23 over a range of 256;
    the lower ones are a hash of the term and its level.
    """
    x, y, z = (F.xxhash64(term, F.lit(3 * j + i)) for i in range(3))
    r = -F.ln(_uniform(x, 0) * _uniform(x, 32))
    c = -F.ln(_uniform(y, 0) * _uniform(y, 32))
    b = _uniform(z, 0)
    level = F.floor(log_weight / r + b)
    value = F.ln(c) - r * (level.cast("double") - b + 1)
    steps = F.floor((F.least(F.greatest(value, F.lit(-127.0)), F.lit(127.0))) * float(1 << 23))
    return F.shiftleft(steps, 32).bitwiseOR(F.hash(term, level).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``(keys..., samples)``: an integer per sample, for rows with keys of their own."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    terms = F.when(F.size(words) > 0, words).otherwise(F.array(F.col(text)))
    rows = texts.select(*keys, F.explode(terms).alias("term")).select(*keys, F.xxhash64("term").alias("term"))
    counts = rows.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*keys, "term", F.ln(F.col("n").cast("double")).alias("w"))
    least = counts.groupBy(*keys).agg(*[F.min(_sample(F.col("term"), F.col("w"), j)).alias(f"s{j}") for j in range(samples)])
    return least.select(*keys, F.array(*[F.hash(f"s{j}") for j in range(samples)]).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same.cast("double") / F.size(a)


def as_string(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def neighbours(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, bool]:
    """``(row, id, k, n_chars, next_k)`` in descending order of the id, and whether equal rows occur.

    ``k`` names a row's id and text; the row after the last is the first. Only
    narrow rows are ordered, by ranges.
    """
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        wide_key(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("k"),
        F.char_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n_chars"),
    )
    rows = hand_over(number_rows(narrow, [], [F.desc_nulls_last("id"), F.col("k")], number="row"), "rows")
    total = rows.count()
    after = rows.select((F.when(F.col("row") == 1, F.lit(total)).otherwise(F.col("row") - 1)).alias("row"), F.col("k").alias("next_k"))
    equal = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    return hand_over(rows.join(after, "row"), "neighbours"), equal


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced by the start of the next document's.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Texts are dealt once by row; the start that a
    document needs of the next one travels, the whole next text does not.
    """
    rows, equal = neighbours(docs, text, doc_id)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(wide_key(F.col(f"`{doc_id}`"), whole).alias("k"), whole.alias("text"))
    if equal:
        texts = texts.groupBy("k").agg(F.first("text").alias("text"))
    half = F.expr("n_chars div 2")
    need = rows.select("row", F.col("k").alias("for_k"), "n_chars", F.col("next_k").alias("k"))
    starts = need.join(texts, "k").select("row", F.col("for_k").alias("k"), "n_chars", F.substring("text", F.lit(1), half.cast("int")).alias("start"))
    edited = starts.join(texts, "k").select(
        "k", "row", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("start")).alias("edited")
    )
    digests = edited.select("row", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    own = texts if equal else texts.repartition("k")
    own = hand_over(fingerprints(own, ["k"], "text", samples).withColumnRenamed("samples", "own"), "fingerprints")
    changed = fingerprints(edited, ["k", "row"], "edited", samples).select("row", F.col("samples").alias("changed"))
    out = rows.join(own, "k").join(own.select(F.col("k").alias("next_k"), F.col("own").alias("next")), "next_k")
    out = out.join(changed, "row").join(digests, "row")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
