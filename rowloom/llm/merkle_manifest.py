"""Merkle dataset manifest with kept hash states.

Every row is a leaf, the SHA-256 of its columns. Rows are dealt to trees by a
column and ordered within; while several nodes remain, every ``arity``
consecutive ones become the SHA-256 of their digests as hex text. The roots of
the trees, ordered by the tree column, form one more tree whose top is the root
of the dataset.

A parent keeps a copy of its hash state from before each child slot. Folding a
leaf upwards resumes the state of its slot with the replacement and hashes only
the siblings to the right of it; what lies to the left is already in the state.

Trees are cut into blocks of ``BLOCK`` consecutive nodes, a power of the arity,
so that a block is a whole subtree and a tree of any size, one that holds most
of the rows included, is worked on by many tasks. A round lifts all blocks to
their tops, which are the nodes of the next round; rounds grow with the
logarithm of the rows. Then the paths from the root come down: one row per
block with the siblings above it, not one per leaf. A block makes the states of
the levels above it once and resumes them for each of its leaves. Only digests
and order keys are shuffled; texts are read once and never moved.

Defined cases: a null column counts as ``-``; rows without a value in the tree
column form the first tree; null order keys come first, equal ones are ordered
by their leaf; repeated rows are leaves of their own; a single leaf is its
tree's root and a single tree's root is the root; an empty table has no root and
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.handover import hand_over
from rowloom.plans.ranking import number_rows

#: nodes of a block, at most
BLOCK = 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


class Subtree:
    """The levels over some consecutive nodes, with the hash states that its parents keep."""

    def __init__(self, digests: Iterable[str], levels: int, arity: int):
        self.arity, self.levels, self.states = arity, [[d.encode() for d in digests]], []
        for _ in range(levels):
            below, parents, kept = self.levels[-1], [], []
            for first in range(0, len(below), arity):
                state, slots = hashlib.sha256(), []
                for child in below[first : first + arity]:
                    slots.append(state.copy())
                    state.update(child)
                kept.append(slots)
                parents.append(state.hexdigest().encode())
            self.levels.append(parents)
            self.states.append(kept)

    def fold(self, at: int, digest: bytes) -> bytes:
        """The top if the node at ``at`` had this digest."""
        for below, kept in zip(self.levels, self.states):
            parent, slot = divmod(at, self.arity)
            state = kept[parent][slot].copy()
            state.update(digest + b"".join(below[at + 1 : (parent + 1) * self.arity]))
            digest, at = state.hexdigest().encode(), parent
        return digest

    def siblings(self, at: int) -> list[tuple[list[bytes], list[bytes]]]:
        """Level by level the siblings to the left and to the right of the path."""
        out = []
        for below in self.levels[:-1]:
            parent = at // self.arity
            out.append((below[parent * self.arity : at], below[at + 1 : (parent + 1) * self.arity]))
            at = parent
        return out


class Above:
    """The path over a block: the states before its slots, made once and resumed for each leaf."""

    def __init__(self, path: Sequence):
        self.steps, self.joined = [], b""
        for step in path:
            left, right = ("".join(step[side]).encode() for side in ("left", "right"))
            self.steps.append((hashlib.sha256(left), right))
            self.joined += left + right

    def fold(self, digest: bytes) -> bytes:
        for state, right in self.steps:
            resumed = state.copy()
            resumed.update(digest + right)
            digest = resumed.hexdigest().encode()
        return digest


def leaf(values: dict[str, Column]) -> Column:
    """The leaf of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _height(n: Column, arity: int) -> Column:
    """Levels over ``n`` nodes."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(n.alias("n"), F.lit(0).alias("h")), lambda s, _: F.when(
        s["n"] > 1, F.struct((F.floor((s["n"] - 1) / arity) + 1).cast("long").alias("n"), (s["h"] + 1).alias("h"))).otherwise(s), lambda s: s["h"])


def _depth(arity: int, block: int) -> int:
    depth = 1
    while arity ** (depth + 1) <= block:
        depth += 1
    return depth


@dataclass
class Forest:
    """Trees over numbered nodes, built: the nodes of every round and the top of every tree.

    A round is ``(tree, pos, digest, height)``; the first one keeps further
    columns of the nodes it was built from. ``tops`` is ``(tree, digest)``.
    """

    arity: int
    depth: int
    rounds: list[DataFrame]
    tops: DataFrame

    def blocks(self, level: int) -> DataFrame:
        return self.rounds[level].withColumn("block", F.expr(f"pos div {self.arity**self.depth}"))


def build(nodes: DataFrame, arity: int = 2, block: int = BLOCK) -> Forest:
    """Trees over ``(tree, pos, digest, ...)``, ``pos`` counting from 0 within a tree; ``tree`` is never null."""
    depth = _depth(arity, block)
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).select(F.col("tree").alias("t"), _height(F.col("n"), arity).alias("height"))
    nodes = hand_over(nodes.join(sizes, F.col("tree") == F.col("t")).drop("t"), "nodes")
    highest = nodes.agg(F.max("height")).first()[0] or 0
    forest = Forest(arity, depth, [nodes], nodes)

    def lift(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        height = int(group["height"].iloc[0])
        top = Subtree(group["digest"], min(height, depth), arity).levels[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "digest": [top[0].decode()], "height": [max(0, height - depth)]})

    for level in range(max(1, -(-highest // depth))):
        lifted = forest.blocks(level).select("tree", "block", "pos", "digest", "height").groupBy("tree", "block").applyInPandas(lift, "tree string, pos long, digest string, height int")
        forest.rounds.append(hand_over(lifted, "tops"))
    forest.tops = forest.rounds.pop().select("tree", "digest")
    return forest


PATH = "array<struct<left:array<string>,right:array<string>>>"


def paths(forest: Forest, above: DataFrame, level: int) -> DataFrame:
    """``(tree, pos, path, root)`` of the nodes of a round: the siblings from each node up to the root.

    ``above`` is ``(tree, path, root)`` of the tops of the trees.
    """
    known = above.select("tree", F.lit(0).cast("long").alias("block"), "path", "root")
    depth, arity = forest.depth, forest.arity

    def down(key: tuple, group: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        subtree = Subtree(group["digest"], min(int(group["height"].iloc[0]), depth), arity)
        rest, root = list(top["path"].iloc[0]), top["root"].iloc[0]
        own = [[{"left": [x.decode() for x in a], "right": [x.decode() for x in b]} for a, b in subtree.siblings(i)] for i in range(len(group))]
        return pd.DataFrame({"tree": key[0], "pos": group["pos"].to_numpy(), "path": [p + rest for p in own], "root": root})

    for at in range(len(forest.rounds) - 1, level - 1, -1):
        nodes = forest.blocks(at).select("tree", "block", "pos", "digest", "height").groupBy("tree", "block")
        found = nodes.cogroup(known.groupBy("tree", "block")).applyInPandas(down, f"tree string, pos long, path {PATH}, root string")
        found = hand_over(found, "paths")
        known = found.select("tree", F.col("pos").alias("block"), "path", "root")
    return known.withColumnRenamed("block", "pos")


def fold(forest: Forest, above: DataFrame, replacement: str, columns: Sequence[str]) -> DataFrame:
    """``tree, digest, <columns>, proof_sha256, folded_root, root`` of every leaf.

    ``replacement`` names a column of the leaves; where it is null the leaf
    itself is folded. The proof is the digest of all siblings from leaf to root.
    """
    known = paths(forest, above, 1).select("tree", F.col("pos").alias("block"), "path", "root")
    depth, arity = forest.depth, forest.arity
    leaves = forest.blocks(0)
    kinds = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in columns)

    def run(key: tuple, group: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos").reset_index(drop=True)
        subtree = Subtree(group["digest"], min(int(group["height"].iloc[0]), depth), arity)
        above_ = Above(top["path"].iloc[0])
        proofs, folded = [], []
        for i, (digest, other) in enumerate(zip(group["digest"], group[replacement])):
            beside = b"".join(b"".join(a) + b"".join(b) for a, b in subtree.siblings(i))
            proofs.append(hashlib.sha256(beside + above_.joined).hexdigest())
            folded.append(above_.fold(subtree.fold(i, (other if isinstance(other, str) else digest).encode())).decode())
        out = group[["tree", "digest", *columns]].copy()
        return out.assign(proof_sha256=proofs, folded_root=folded, root=top["root"].iloc[0])

    schema = f"tree string, digest string, {kinds}, proof_sha256 string, folded_root string, root string"
    wanted = ["tree", "block", "pos", "digest", "height", *dict.fromkeys([replacement, *columns])]
    return leaves.select(*wanted).groupBy("tree", "block").cogroup(known.groupBy("tree", "block")).applyInPandas(run, schema)


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, tree: str = "lang", order: str = "doc_id", altered: dict[str, Column] | None = None,
             when: Column | None = None, arity: int = 2, block: int = BLOCK) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row; ``key`` is the ``order`` column.

    ``altered`` gives other values of some columns; rows for which ``when``
    holds are folded with the leaf that these would have.
    """
    col = lambda c: F.col(f"`{c}`")
    values = {c: col(c) for c in columns}
    changed = leaf(values | (altered or {})) if altered else F.lit(None).cast("string")
    named = F.when(col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col(tree).cast("string")))
    leaves = docs.select(named.alias("tree"), col(order).alias("key"), leaf(values).alias("digest"),
                         F.when(F.lit(True) if when is None else when, changed).alias("changed"))
    leaves = number_rows(hand_over(leaves, "leaves"), ["tree"], [F.asc_nulls_first("key"), F.col("digest")], number="pos")
    trees = build(leaves.withColumn("pos", F.col("pos") - 1), arity, block)

    tops = number_rows(trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["tree"], ["name"], number="pos")
    whole = build(tops.withColumn("pos", F.col("pos") - 1), arity, block)
    start = whole.tops.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    names = whole.rounds[0].select("tree", "pos", F.col("tree").alias("t"), "name", F.col("digest").alias("subroot")).drop("t")
    above = paths(whole, start, 0).join(names, ["tree", "pos"]).select(F.col("name").alias("tree"), "path", "root", "subroot")
    above = hand_over(above, "subroots")

    out = fold(trees, above.drop("subroot"), "changed", ["key"]).join(above.select("tree", "subroot"), "tree")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return out.select("key", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", verified)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language, every row proven; where 7 divides the id's crc32, against ``n_chars`` one too large."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, when=F.coalesce(chosen, F.lit(False)))
    return out.withColumnRenamed("key", "doc_id")


def _text(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


#: the same manifest over a table ``documents`` in DuckDB
SQL = f"""
WITH RECURSIVE c AS (SELECT i, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(i::VARCHAR, '')])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS crc
    FROM (SELECT DISTINCT doc_id AS i FROM documents)),
e AS (SELECT doc_id, lang, sha256({' || '.join(_text(x) for x in COLUMNS)}) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256({' || '.join(_text('(n_chars + 1)' if x == 'n_chars' else x) for x in COLUMNS)}) END AS changed
  FROM documents LEFT JOIN c ON doc_id = i),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM e),
t AS (SELECT lang, 0 AS level, pos, n, leaf AS digest FROM d
  UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
r AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS digest FROM r
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
f AS (SELECT doc_id, lang, leaf, 0 AS level, pos, n, coalesce(changed, leaf) AS digest, '' AS proof FROM d
  UNION ALL SELECT f.doc_id, f.lang, f.leaf, f.level + 1, f.pos // 2, (f.n + 1) // 2,
      sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN f.pos % 2 = 0 THEN f.digest || s.digest ELSE s.digest || f.digest END), f.proof || coalesce(s.digest, '')
    FROM f LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
g AS (SELECT f.doc_id, f.leaf, r.subroot, 0 AS level, r.pos, r.n, f.digest, f.proof FROM f JOIN r ON f.lang IS NOT DISTINCT FROM r.lang WHERE f.n = 1
  UNION ALL SELECT g.doc_id, g.leaf, g.subroot, g.level + 1, g.pos // 2, (g.n + 1) // 2,
      sha256(CASE WHEN s.digest IS NULL THEN g.digest WHEN g.pos % 2 = 0 THEN g.digest || s.digest ELSE s.digest || g.digest END), g.proof || coalesce(s.digest, '')
    FROM g LEFT JOIN u s ON s.level = g.level AND s.pos = xor(g.pos, 1) WHERE g.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, g.digest AS folded_root, g.digest = root AS verified
FROM g, (SELECT digest AS root FROM u WHERE n = 1) WHERE g.n = 1
"""
