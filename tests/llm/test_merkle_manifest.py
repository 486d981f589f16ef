import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rowloom.llm import merkle_manifest as mm
from tests.llm.common import documents, empty, frame, odd, rows
from tests.oracle import compare, database


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def brute(docs, arity=2):
    got = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    trees = {}
    for r in got:
        other = None
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0:
            other = leaf(r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + 1, r.text)
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(*r), other, r.doc_id))
    names = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        built[name] = climb([x[2] for x in trees[name]], arity)
    top = climb([built[n][-1][0] for n in names], arity)
    root, want = top[-1][0], []
    for t, name in enumerate(names):
        for i, (_, _, own, other, key) in enumerate(trees[name]):
            cur, proof = other or own, []
            for levels, at in ((built[name], i), (top, t)):
                for level in levels[:-1]:
                    run = level[at // arity * arity : (at // arity + 1) * arity]
                    slot = at % arity
                    proof += run[:slot] + run[slot + 1 :]
                    cur, at = H(*run[:slot], cur, *run[slot + 1 :]), at // arity
            want.append((key, own, built[name][-1][0], root, H(*proof), cur, cur == root))
    return sorted(want, key=repr)


@pytest.mark.parametrize("arity,block", [(2, 1024), (2, 4), (3, 9), (16, 16)])
def test_agrees_with_brute_force(spark, data, arity, block):
    docs = documents(spark, data)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = mm.manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, when=chosen, arity=arity, block=block)
    want = brute(docs, arity)
    assert rows(got, *got.columns) == want
    assert 0 < sum(not w[-1] for w in want) < len(want)


def test_agrees_with_sql(spark, data):
    assert compare(mm.document_manifest(documents(spark, data)), database(data), mm.SQL) is None


def test_odd_rows(spark):
    docs = odd(spark)
    got = mm.document_manifest(docs)
    assert rows(got, *got.columns) == brute(docs)
    got = mm.document_manifest(docs.withColumn("text", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long")))
    assert got.filter("verified").count() == docs.count()
    assert mm.document_manifest(empty(spark)).count() == 0


def test_single_leaves_and_trees(spark):
    one = frame(spark, ["only"])
    got = mm.document_manifest(one).collect()[0]
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == H()
    for n in (2, 3, 5, 8, 9):
        docs = frame(spark, [f"t{i}" for i in range(n)], langs=["é", "z", "", None, "Z"][: min(n, 5)] * 2 if n > 5 else None)
        got = mm.document_manifest(docs)
        assert rows(got, *got.columns) == brute(docs)


def test_states_resume_where_the_slot_begins():
    """A fold hashes the replacement and what is right of it, and gives what hashing all children gives."""
    nodes = [H(str(i)) for i in range(11)]
    tree = mm.Subtree(nodes, 3, 3)
    for i in range(11):
        other = nodes[:i] + [H("x")] + nodes[i + 1 :]
        levels = climb(other, 3)
        assert tree.fold(i, H("x").encode()).decode() == levels[-1][0]
        assert tree.fold(i, nodes[i].encode()) == tree.levels[-1][0]
        assert [len(x) for x in tree.states[0]] == [3, 3, 3, 2]
