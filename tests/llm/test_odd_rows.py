"""Clashing names, null ids, repeated rows, empty tables and long texts through every text operator and pipeline stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepanel.llm import bpe, line_dedup, ngram_join, packing, pii, queries, secret_scan, simhash, toxicity
from tidepanel.llm.queries import pattern, vocabulary

CLASHES = ("grade", "Rejected", "severity", "p_mild", "kept", "n_lines", "n_dropped", "row", "_row", "id", "rep", "comp", "token", "tokens", "length", "piece", "entities", "findings", "shard", "n", "a.b", "t1", "place", "copies")
LONG = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta", "x1", "é"], k=170_000)) + " " + "q" * 70_000


def odd(spark):
    line = "a long line that is the same in all of these documents, so it goes"
    rows = [(1, LONG), (2, None), (3, ""), (None, "no id here"), (None, None), (4, "twice the same row"), (4, "twice the same row"), (5, "one id"), (5, "two texts")] + [(10 + i, f"{line}\nown {i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}).repartition(3), rows


def outputs(docs, labels):
    coder = (vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())
    return {
        "toxicity": toxicity.score(docs, toxicity.train(docs, labels)),
        "lines": line_dedup.dedup_lines(docs),
        "lines by shards": line_dedup.dedup_lines(docs, broadcast_bytes=0),
        "line digest": line_dedup.line_digest(docs),
        "join": ngram_join.components(docs),
        "fingerprints": simhash.digest(docs),
        "coding": bpe.round_trip_digest(docs, *coder),
        "secrets": secret_scan.secrets_digest(docs),
        "pii": pii.pii_digest(docs),
        "masked": pii.mask_pii(docs),
    }


def test_every_operator_keeps_every_row(spark):
    docs, rows = odd(spark)
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 1), (None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    for name, out in outputs(docs, labels).items():
        got = out.collect()
        assert len(got) == len(rows), name
        assert sorted(r["doc_id"] or -1 for r in got) == sorted(i or -1 for i, _ in rows), name
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())
    assert pieces.where("start = 0").count() == len(rows)
    for name, out in outputs(docs.where("false"), labels.where("false")).items():
        assert out.count() == 0, name


def test_every_stage_keeps_the_columns(spark, tmp_path):
    import corpus_pipeline as C

    docs, rows = odd(spark)
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for empty in (False, True):
        now = docs.where("false") if empty else docs
        for name, stage in C.STAGES:
            place = str(tmp_path / f"{name}{empty}")
            stage(spark, now, str(tmp_path)).write.parquet(place)
            now = spark.read.parquet(place)
            if name != "packing":
                assert now.columns == docs.columns, name
                assert [r[c] for r in now.select(*[f"`{c}`" for c in CLASHES]).distinct().collect() for c in CLASHES] == ([] if empty else [f"clash {c}" for c in CLASHES]), name
        assert (now.count() == 0) == empty


def test_one_row_of_a_component_stays(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "other words than those of all the rest")
    rows = [(5, a, "x"), (5, b, "x"), (3, b, "x"), (1, c, "x"), (1, c, "y"), (1, c, "y"), (7, "", "x"), (7, "", "x"), (8, None, "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(4)
    got = sorted(map(tuple, ngram_join.keep_one(docs).collect()), key=str)
    assert [r[:2] for r in got] == sorted([(5, a), (3, b), (1, c), (7, ""), (7, ""), (8, None), (None, a), (None, a)], key=str)
    assert got == sorted(map(tuple, ngram_join.keep_one(docs.repartition(2)).collect()), key=str)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_repeated_ids_count_as_rows(spark, bound):
    """A row is a document, by the operator and by its SQL alike."""
    import duckdb

    a, b = "a line of more than forty characters that repeats", "Another line of more than forty characters, here"
    rows = [(1, a), (1, a), (2, a), (2, f"{a}\n{b}"), (3, f" {a.upper()}\nx"), (4, b), (4, b), (5, f"{b}\n{b}"), (None, a), (None, f"{a}\n{b}"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    cur = con.execute(line_dedup.ORACLE_SQL)
    at = [c[0] for c in cur.description]
    want = sorted(([r[at.index(n)] for n in names] for r in cur.fetchall()), key=str)
    got = line_dedup.dedup_lines(docs, broadcast_bytes=bound).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
    assert sorted((list(r) for r in got.collect()), key=str) == want and sum(w[2] for w in want) == 4


def test_long_documents_train_all_features(spark):
    """A text of 9,000 distinct words keeps its features of all numbers, and what four documents share reaches the fit."""
    text = " ".join(f"word{i:05d}x" for i in range(9000))
    docs = spark.createDataFrame([(i, text if i < 4 else f"own{i} words") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "doc_id long, toxic int")
    whole = {f for w in toxicity.words(text) for f in toxicity.features(w)}
    rows = toxicity.sample(docs, labels)
    assert max((set(r["features"]) for r in rows.collect()), key=len) == whole and max(whole) > 250_000
    kept = [np.frombuffer(bytes(r["features"]), np.int32) for r in toxicity.supported(rows).collect() if r["toxic"]]
    assert all(set(k.tolist()) == whole for k in kept) and len(kept) == 4


def test_long_words_equal_the_library():
    import tiktoken

    ranks = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    library, coder, rng = tiktoken.Encoding("long", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={}), bpe.Coder(ranks), random.Random(2)
    words = ["a" * 700, "ab" * 900 + "b", "ha" * 3001, "=-" * 999, "".join(rng.choices("的一是不了人我", k=900))]
    words += ["".join(rng.choices(letters, k=rng.randint(400, 4000))) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "éüñ") for _ in range(15)]
    words.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)))
    for w, ids in zip(words, coder.encode_words([w.encode() for w in words]), strict=True):
        if w.isalpha():
            assert ids.tolist() == library.encode_ordinary(w)
        assert coder.decode([ids]) == [w.encode()]


def test_fit_against_plain_descent():
    """The fitted loss is that of a plain gradient descent with numeric slopes on the same small data."""
    rng = np.random.default_rng(1)
    toxic = np.repeat([0, 1], 30)
    rows = [np.unique(np.r_[rng.choice(6, 3), rng.choice(np.arange(10, 16), 2) if t else rng.choice(np.arange(20, 26), 2)]).astype(np.int32) for t in toxic]
    prior, penalty = 0.3, 3e-4
    grades, useful = toxicity.graded(toxic, rows)
    used = np.flatnonzero(useful)
    x = np.array([[f in r for f in used] for r in rows], float)
    weight = np.where(toxic == 1, prior / 0.5, (1 - prior) / 0.5) / len(rows)

    def loss(v):
        w, low, high = v[:-2], v[-2], v[-2] + np.exp(v[-1])
        over = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - [low, high], -40, 40)))
        chance = np.where(grades == 0, 1 - over[:, 0], np.where(grades == 1, over[:, 0] - over[:, 1], over[:, 1]))
        return -(weight * np.log(np.maximum(chance, 1e-9))).sum() + penalty / 2 * (w @ w)

    plain = np.zeros(len(used) + 2)
    plain[-2] = np.log((1 - prior) / prior)
    for _ in range(3000):
        slope = np.array([(loss(plain + e) - loss(plain - e)) / 2e-5 for e in np.eye(len(plain)) * 1e-5])
        plain -= 2.0 * slope
    model = toxicity.fit(toxic, rows, prior)
    mine = np.r_[model.weights[used].astype(float), model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])]
    assert loss(mine) <= loss(plain) * 1.05
    assert model.thresholds[0] < model.thresholds[1]


@pytest.mark.parametrize("name", [f"op{i}_" for i in range(1, 14)])
def test_every_query_is_described(name):
    (found,) = [f for n, f in queries.QUERIES.items() if n.startswith(name)]
    assert found.__doc__ and "null" in found.__doc__.lower()
