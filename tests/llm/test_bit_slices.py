"""Bit-sliced distances and near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidepanel.llm import bit_slices as B

from tests.llm.test_joins import union_find


def flipped(rng, x, k):
    for b in rng.sample(range(64), k):
        x ^= 1 << b
    return x


def prints(seed, bases, steps):
    rng = random.Random(seed)
    found = set()
    for _ in range(bases):
        x = rng.getrandbits(64)
        found.add(x)
        for _ in range(rng.randint(0, steps)):
            x = flipped(rng, x, rng.randint(0, 6))
            found.add(x)
    return sorted(found)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7, 20])
def test_distances_equal_all_pairs(radius):
    p = np.array(prints(radius, 200, 5), np.uint64)
    for part in (p, p[:1], p[:64], p[:65]):
        query, lane = B.Slices(part).near(0, len(part), radius)
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ part[None]) <= radius)
        assert sorted(zip(query.tolist(), lane.tolist(), strict=True)) == sorted((a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a != b)


def test_links_connect_what_pairs_connect():
    p = np.array(prints(3, 30, 60), np.uint64)
    i, j = np.nonzero(np.bitwise_count(p[:, None] ^ p[None]) <= 3)
    links = B.Slices(p).links()
    mine, every = union_find(len(p), links), union_find(len(p), zip(i.tolist(), j.tolist(), strict=True))
    assert len(links) < len(p) and all(np.bitwise_count(p[a] ^ p[b]) <= 3 for a, b in links)
    assert len({*zip(mine, every, strict=True)}) == len(set(mine)) == len(set(every))


@pytest.mark.parametrize("piece", [4, 8192])
def test_tables_lose_no_link(spark, monkeypatch, piece):
    """A third of the fingerprints share 52 bits, so that with small pieces their buckets are cut."""
    monkeypatch.setattr(B, "PIECE", piece)
    rng = random.Random(5)
    p = sorted({*prints(4, 60, 8), *(0x5A5A5A5A5A5A5000 + rng.getrandbits(12) for _ in range(150))})
    points = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in p], "bits long").repartition(3)
    at = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(p)}
    links = [(at[a], at[b]) for a, b in B.near_links(points).collect()]
    q = np.array(p, np.uint64)
    i, j = np.nonzero(np.bitwise_count(q[:, None] ^ q[None]) <= 3)
    mine, every = union_find(len(p), links), union_find(len(p), zip(i.tolist(), j.tolist(), strict=True))
    assert len({*zip(mine, every, strict=True)}) == len(set(mine)) == len(set(every))


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents_equal_plain_code(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "A", "a", "\x1c", " x", "İ"]
    texts = [None, "", " \n", "one", "ONE\tone", "one two", "a b c", "a a a a a a a"]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(3, 400))
        for _ in range(rng.randint(1, 4)):
            base = list(base)
            if rng.random() < 0.7:
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\x0b"]).join(base))
    texts.append(" ".join(rng.choices(words, k=100_000)))
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(5, texts[20]), (5, texts[20])]
    p = [plain_print(t) for _, t in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (p[i] ^ p[j]).bit_count() <= 3])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{x:016x}", least.get(r)) for (i, _), x, r in zip(rows, p, root, strict=True)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bits": F.lit("clash"), "a.b": F.lit(1)}).repartition(3)
    got = B.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(c is not None and c != i for i, _, c in want)
    assert B.near_duplicates(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="differing bits"):
        B.near_duplicates(docs, radius=4)
