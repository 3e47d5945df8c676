"""Importance resampling against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidepanel.llm import resampling as R


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, least=20, percent=5):
    of = lambda text: Counter(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])
    s, t = Counter(), Counter()
    for _, text in docs:
        s += of(text)
    for text in target:
        t += of(text)
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + 10000) / ((s[b] + 1) * (small + 10000))))
    rows = []
    for doc_id, text in docs:
        counts = of(text)
        weight = sum(n * gain(b) for b, n in counts.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(text)[0])])
    eligible = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["É", "é", "Straße", "A1", "x_y", "日本", "İ", "don't", "\x00z"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(n)] + [None, "", "...", "WORD", " ".join(rng.choices(words, k=60_000))]
    docs = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (7, "other text " * 12)]
    return docs, [" ".join(rng.choices(words[:40], k=50)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("percent", [5, 40])
def test_equals_plain_code(spark, monkeypatch, percent):
    docs, target = corpus(percent, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("range", "rank", "gains", "a.b")}).repartition(5)
    monkeypatch.setattr(R.ranked, "__defaults__", (20, percent))
    got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, percent=percent)


def test_long_texts_by_pieces(monkeypatch):
    texts = [t for _, t in corpus(3, 60)[0] if t]
    with R._database() as db:
        for size in (1, 7, 300):
            monkeypatch.setattr(R, "AT_ONCE", size)
            for text in texts[:40]:
                row = R._whole(db, text).to_pylist()[0]
                words, found = features(text)
                assert (row["n_words"], row["n_features"]) == (len(words), len(found))
                assert dict(zip(row["buckets"], row["counts"], strict=True)) == Counter(zlib.crc32(f.encode()) % 10000 for f in found)


def test_nothing_and_no_target(spark):
    df = spark.createDataFrame(corpus(4, 30)[0], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert R.resample(df.where("false"), none).count() == 0
    assert sorted(map(tuple, R.resample(df, none).collect()), key=str) == plain(corpus(4, 30)[0], [])
