"""Text columns: cell normalising, token sets, lexical scores, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
TOKEN = r"[A-Za-z0-9_./\-]{2,64}"
SPACE = r"[\s\x1c-\x1f]"  # under (?U), which adds the blanks beyond ASCII
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
INSTRUCTION = r"(?i)^\s*(system:|ignore|do this|instruction:|developer:|assistant:)\b"
INSTRUCTION_STRICT = r"(?i)^\s*(system:|ignore\b|do this\b|instruction:|developer:|assistant:)"
CITATION = r"\[(csv|xml|catalog|note):(\d+)\]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm_cell(c: Column, ignore_case: bool = False, trim_ws: bool = True) -> Column:
    """Null to empty, no NUL, one blank between words, optionally lower case."""
    s = F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\x00"), F.lit(""))
    if trim_ws:
        s = F.trim(F.regexp_replace(s, f"(?U){SPACE}+", " "))
    return F.lower(s) if ignore_case else s


def display_cell(c: Column, max_len: int | None = None) -> Column:
    """A normalised cell for a chunk line; ones longer than ``max_len`` are cut and marked with dots."""
    if max_len is None:
        return norm_cell(c)
    return F.regexp_replace(norm_cell(c), f"(?s)^(.{{{max_len}}}).+$", "$1...")


def tokens(c: Column) -> Column:
    """All tokens of the lower-cased text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        inter / (F.size(a) + F.size(b) - inter)
    )


def query_tokens(q: Column, top: int | None = None) -> Column:
    """Distinct query tokens in order of appearance, or the first ``top`` of them."""
    return token_set(q) if top is None else F.slice(token_set(q), 1, top)


def lexical_score(query: Column, doc: Column) -> Column:
    """Share of query tokens that occur as substrings of the document."""
    body = F.lower(F.coalesce(doc, F.lit("")))
    hits = let(body, lambda b: F.size(F.filter(query, lambda t: F.contains(b, t))))
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(hits / F.size(query))


def lines(c: Column) -> Column:
    """The lines of a text; a closing line break starts no further line."""
    s = F.coalesce(c, F.lit(""))
    return F.split(F.regexp_replace(s, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def strip_instructions(c: Column, strict: bool = False) -> Column:
    """Drop lines that look like instructions to a reader of the text."""
    pattern = INSTRUCTION_STRICT if strict else INSTRUCTION
    return F.array_join(F.filter(lines(c), lambda ln: ~F.rlike(ln, F.lit(pattern))), "\n")


def citations(c: Column) -> Column:
    """Distinct ``[source:number]`` marks of an answer."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(0)))
