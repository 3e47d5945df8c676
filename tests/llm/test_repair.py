"""Conversation repair against plain code that tries every edit, and against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tidepanel.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conv_id, turn, role, text) after damage, in order within each conversation."""
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role = "user" if d == 4 else role
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out[conv] += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def judged(rows):
    seen, found = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Every way to insert at most two turns at each place and to keep, rerole or delete each row."""
    best = None
    empty = [("", ())] + [("I", (r,)) for r in ("user", "assistant")] + [("II", p) for p in itertools.product(("user", "assistant"), repeat=2)]
    own = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", role), ("R", "user"), ("R", "assistant")] for (_, role, _), f in zip(rows, found, strict=True)]
    for choice in itertools.product(*own):
        for inserted in itertools.product(empty, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i, (letters, roles) in enumerate(inserted):
                cost, audit = cost + 5 * len(letters), audit + letters
                lines += [f"{r}:" for r in roles]
                if i < len(rows):
                    letter, role = choice[i]
                    audit += letter
                    cost += {"D": 2, "K": 0, "R": 1}[letter] + (5 if found[i] == "truncated" and letter != "D" else 0)
                    lines += [f"{role}:{rows[i][2]}"] if letter != "D" else []
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines)):
                best = cost, audit, "\n".join(lines)
    return best


def plain(rows, solve=cheapest):
    out = []
    for conv, mine in damage(rows).items():
        found, turns = judged(mine), [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, text = solve(mine, found)
        out.append((conv, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def some(n, turns, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, turns)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, -7, 300]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "Stranger", None]), rng.choice(["Yes.", "No!", "why", " \n", "", None, "a?\x0b ", "é."])))
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_every_edit_tried(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = some(25, 3, 1)
    got = repair.repair_digest(spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit("clash")).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_sql_on_longer_conversations(spark, monkeypatch):
    rows = [r for r in some(80, 30, 2)]
    rows += [(1000, i, "user" if i % 3 else "assistant", "ok." if i % 5 == 0 else f"turn {i}.") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = sorted(repair.repair_digest(df).columns)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    cur = con.execute(repair.ORACLE_SQL)
    at = [c[0] for c in cur.description]
    want = sorted(([r[at.index(c)] for c in names] for r in cur.fetchall()), key=str)
    for chunk in (7, 256):
        monkeypatch.setattr(repair, "CHUNK", chunk)
        assert sorted((list(r) for r in repair.repair_digest(df).select(*names).collect()), key=str) == want


def test_texts_of_the_repair(spark):
    rows = [(1, 1, "user", "Hi.", 1), (1, 2, "user", "So?", 1), (1, 3, "user", "So?", 3), (2, 1, "system", "Be kind.", 1), (3, 1, "user", "x", 0)]
    got = {r["conv_id"]: (r["audit"], r["cost"], r["repaired"]) for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")).collect()}
    assert got == {1: ("KRDDD", 7, "user:Hi.\nassistant:So?"), 2: ("D", 2, ""), 3: ("", 0, "")}


def test_nothing(spark):
    assert repair.repair_digest(spark.createDataFrame([], SCHEMA)).count() == 0
