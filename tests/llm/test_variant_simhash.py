import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from rowloom.llm import variant_simhash as vs
from tests.llm.common import documents, empty, frame, odd, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, shingle=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    """The component of every value, by all pairs."""
    nodes = sorted(set(prints))
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                parent[find(y)] = find(x)
    return {x: find(x) for x in nodes}


def brute(docs, distance=2):
    found = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    of = groups([p for _, p in found], distance)
    least = {}
    for i, p in found:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return sorted([(i, f"{p:016x}", least.get(of[p])) for i, p in found], key=repr)


def clustered(rng, centres, size, flips):
    """Values around some centres, up to ``flips`` bits away."""
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return out | {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2}


def test_agrees_with_brute_force(spark, data):
    docs = documents(spark, data)
    got = vs.near_duplicates(docs)
    assert rows(got, *got.columns) == brute(docs)


def test_odd_rows(spark):
    docs = odd(spark)
    got = vs.near_duplicates(docs)
    assert rows(got, *got.columns) == brute(docs)
    assert vs.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("distance,limit", [(1, 64), (2, 2), (2, 3), (2, 64)])
def test_links_connect_as_all_pairs_do(spark, distance, limit):
    """Every way of pairing, the one for large buckets included."""
    values = clustered(random.Random(11), 8, 60, 4)
    df = spark.createDataFrame([(vs._long(x),) for x in values], "print long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in vs.near_links(df, distance, limit).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in links)
    parent = {x: x for x in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = groups(values, distance)
    assert len({(find(x), want[x]) for x in values}) == len({find(x) for x in values}) == len(set(want.values()))


def test_index_rows_cover_every_pair():
    """Any two values two bits apart share an index row."""
    kinds = vs.masks(2)
    assert len(kinds) == 66
    for i in range(64):
        for j in range(64):
            d = 1 << i | (1 << j)
            assert any(d & (m % (1 << 64)) == 0 for m, _ in kinds)


def test_linear_in_a_large_group(spark):
    """A bucket of thousands yields links in proportion to its members."""
    rng, high = random.Random(3), 0xDEADBEEF << 32
    values = {high | rng.getrandbits(11) for _ in range(6000)}
    links = vs.near_links(spark.createDataFrame([(vs._long(x),) for x in values], "print long"), 2)
    assert links.count() <= 65 * len(values)


def test_half_is_not_over_half(spark):
    """A bit set in exactly half of the hashes is 0."""
    text = next(t for i in range(100) for t in [f"a{i} b{i} c{i} d{i}"] if fingerprint(t))
    got = vs.near_duplicates(frame(spark, [text, text.upper(), "x " * 5])).orderBy("doc_id").collect()
    assert [r.fingerprint for r in got] == [f"{fingerprint(t):016x}" for t in (text, text, "x " * 5)]
    assert got[0].component_id == got[1].component_id == 1


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(vs, "CHUNK", 100)
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(500)) for _ in range(5000))
    import pyarrow as pa

    texts = ["", text, None, "one", text + " more"]
    assert vs.text_fingerprints(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_native_hash_is_the_same(spark):
    """Spark's own hash of a string is the one used here."""
    words = ["a b c", "é ü ñ", "x" * 40, ""]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h"))
    assert [r.h % (1 << 64) for r in df.collect()] == [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
