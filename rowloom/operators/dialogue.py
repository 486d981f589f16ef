"""Conversations: recent turns and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.plans.ranking import top_rows

HISTORY = 50
CONTEXT_TURNS = 6


def last_turns(df: DataFrame, n: int = HISTORY, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` turns of every conversation."""
    return top_rows(df, [conv], [F.desc(turn)], n, rank="__n").drop("__n")


def transcript(
    df: DataFrame, form: str = "txt", stamp: str = "", n: int | None = None, ts: str | None = None, sources: str | None = None
) -> DataFrame:
    """One text per conversation ``(conv_id, turn, role, text)``: ``txt``, ``md`` or ``json``.

    A transcript shows all turns, or the last ``n``. ``ts`` names a column with
    each turn's own time instead of ``stamp``, ``sources`` one with the list of
    files that a turn rests on; ``md`` and ``json`` show them.
    """
    turns = df if n is None else last_turns(df, n)
    whole, own = F.lit(stamp), ts
    ts = F.lit(stamp) if own is None else F.coalesce(F.col(own).cast("string"), F.lit(""))
    listed = F.lit("")
    if sources is not None:
        lines = F.array_join(F.transform(F.col(sources), lambda s: F.concat(F.lit("- "), F.coalesce(s, F.lit("unknown")), F.lit("\n"))), "")
        listed = F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.concat(F.lit("**Sources:**\n"), lines, F.lit("\n"))).otherwise("")
    if form == "txt":
        piece = F.concat(F.lit("["), ts, F.lit("] "), F.upper("role"), F.lit(":\n"), F.col("text"), F.lit("\n"))
    elif form == "md":
        who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
        piece = F.concat(F.lit("## "), who, F.lit(" ("), ts, F.lit(")\n\n"), F.col("text"), F.lit("\n\n"), listed, F.lit("---\n"))
    else:
        extra = [] if own is None else [ts.alias("timestamp")]
        extra += [] if sources is None else [F.col(sources).alias("sources")]
        piece = F.to_json(F.struct("role", F.col("text").alias("content"), *extra))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("turn", piece.alias("p")))), lambda s: s["p"])
    joined = turns.groupBy("conv_id").agg(pieces.alias("p"))
    if form == "txt":
        out = F.array_join("p", "\n")
    elif form == "md":
        head = "# Chat Transcript\nSession: "
        out = F.concat(F.lit(head), F.col("conv_id").cast("string"), F.lit("\nExported: "), whole, F.lit("\n\n---\n\n"), F.array_join("p", "\n"))
    else:
        out = F.concat(F.lit("["), F.array_join("p", ","), F.lit("]"))
    return joined.select("conv_id", out.alias("transcript"))
