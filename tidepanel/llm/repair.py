"""Conversation structure: find faulty turns, and the cheapest edits that make roles alternate.

Turns are read in order. A conversation is well formed if its roles' initials are nothing, or an
optional s and then u and a in turn. Four states tell where a prefix of such a sequence ends:
nothing yet, after s, after u, after a. A fold over the sorted turns carries for each state the
cheapest (cost, audit), the audit being the edits' initials; ``least`` of these structs takes the
cheaper one, and of equal costs the audit that is first in byte order.

A fold never sees a whole conversation: turns are gathered by chunks of turn numbers, each chunk
is folded from each of the four states, and a second fold per conversation joins the chunks' four
by four results, which is exact because costs add up and equal costs exclude that one audit
begins the other. Equal rows of a turn travel once with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.common import ASCII_SPACE

#: Turn numbers that agree in their quotient by this are gathered together.
CHUNK = 256
KEY = ["conv", "absent"]
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: More than any conversation costs: the price of what can't be done.
NEVER = 1 << 40
LEGAL = ("su", "ua", "au")
_NO_TURN = -(2**62)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with the faults that their ids' checksums choose; nulls are one space.

    A dropped row stays with 0 copies, so that its conversation is still known.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
    d = F.col("_d")
    return rows.select(
        "conv_id",
        "turn",
        F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"),
    )


def chunked(rows: DataFrame) -> DataFrame:
    """(conv, absent, chunk, turns): the turns in order, as structs with what is known of each by itself.

    ``turns`` holds turn, role, text, n (equal rows), shape (blank, truncated or OK), one and two (a
    128-bit hash of role and text). Ties of a turn stand by role, then text. Equal rows are counted
    before anything is shuffled.
    """
    there = F.col("copies") > 0
    slim = rows.select(
        F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"),
        F.col("conv_id").isNull().alias("absent"),
        F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(_NO_TURN)).alias("chunk"),
        "turn",
        *[F.when(there, F.col(c)).otherwise("").alias(c) for c in ("role", "text")],
        "copies",
    )
    once = slim.groupBy(*KEY, "chunk", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("n"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(ASCII_SPACE)), -1, 1)
    shape = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    turn = F.struct("turn", "role", "text", "n", shape.alias("shape"), *[F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in ((3, "one"), (5, "two"))])
    gathered = once.groupBy(*KEY, "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.withColumn("turns", F.filter("turns", lambda t: t["n"] > 0))


def seen_before(chunks: DataFrame) -> DataFrame:
    """(conv, absent, chunk, known): the hashes of turns that an earlier chunk holds, for the chunks that have such.

    The window sees hashes only, each once a chunk.
    """
    said = chunks.select(*KEY, "chunk", F.explode(F.array_distinct(F.transform("turns", lambda t: F.struct(t["one"].alias("one"), t["two"].alias("two"))))).alias("said"))
    first = F.min("chunk").over(Window.partitionBy(*KEY, "said"))
    return said.withColumn("_first", first).where("chunk > _first").groupBy(*KEY, "chunk").agg(F.collect_list("said").alias("known"))


def faults(chunks: DataFrame) -> DataFrame:
    """The chunks with ``marked``: (n, initial, fault) of each turn; the fault is its first copy's, the other copies are duplicates."""
    key = lambda t: F.struct(t["one"].alias("one"), t["two"].alias("two"))
    keys = F.transform("turns", key)
    joined = chunks.join(seen_before(chunks), [*KEY, "chunk"], "left").withColumn("known", F.concat(F.coalesce("known", F.array().cast("array<struct<one: bigint, two: bigint>>")), keys))
    before = F.size("known") - F.size("turns")
    repeated = lambda t, i: F.array_position("known", key(t)) <= before + i
    mark = lambda t, i: F.struct(t["n"].alias("n"), F.substring(t["role"], 1, 1).alias("initial"), F.when((t["shape"] != BLANK) & repeated(t, i), DUPLICATE).otherwise(t["shape"]).alias("fault"))
    return joined.withColumn("marked", F.transform("turns", mark)).drop("known")


def _edits(t: Column) -> Column:
    """What may happen to a turn and its copies, as (cost, letters): all deleted, or the first kept or reroled in a place for s, u or a."""
    rest, deleted = F.repeat(F.lit("D"), (t["n"] - 1).cast("int")), DELETE * (t["n"] - 1)
    base = F.when(t["fault"].isin(BLANK, DUPLICATE), NEVER).when(t["fault"] == TRUNCATED, UNFINISHED).otherwise(0) + deleted
    kept = F.concat(F.lit("K"), rest)

    def place(role: str) -> Column:
        same = t["initial"] == role
        return F.struct((base + F.when(same, 0).otherwise(REROLE)).alias("cost"), F.when(same, kept).otherwise(F.concat(F.lit("R"), rest)).alias("audit"))

    return F.struct(
        F.struct((deleted + DELETE).alias("cost"), F.concat(F.lit("D"), rest).alias("audit")).alias("gone"),
        F.struct((base + F.when(t["initial"] == "s", 0).otherwise(NEVER)).alias("cost"), kept.alias("audit")).alias("s"),
        place("u").alias("u"),
        place("a").alias("a"),
    )


def _plus(q: Column, edit: Column) -> Column:
    return F.struct((q["cost"] + edit["cost"]).alias("cost"), F.concat(q["audit"], edit["audit"]).alias("audit"))


def _inserted(q: Column, times: int = 1) -> Column:
    return F.struct((q["cost"] + INSERT * times).alias("cost"), F.concat(q["audit"], F.lit("I" * times)).alias("audit"))


def _closed(q0: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """The four states with the inserts that may follow: a user turn, an assistant's, or one after the other."""
    return F.struct(
        q0.alias("q0"),
        q1.alias("q1"),
        F.least(q2, _inserted(q0), _inserted(q1), _inserted(q3)).alias("q2"),
        F.least(q3, _inserted(q2), _inserted(q0, 2), _inserted(q1, 2)).alias("q3"),
    )


def _step(q: Column, e: Column) -> Column:
    return _closed(
        _plus(q["q0"], e["gone"]),
        F.least(_plus(q["q1"], e["gone"]), _plus(q["q0"], e["s"])),
        F.least(_plus(q["q2"], e["gone"]), *[_plus(q[p], e["u"]) for p in ("q0", "q1", "q3")]),
        F.least(_plus(q["q3"], e["gone"]), _plus(q["q2"], e["a"])),
    )


def _from(state: int) -> Column:
    return F.struct(*[F.struct(F.lit(0 if k == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(f"q{k}") for k in range(4)])


def folded(chunks: DataFrame) -> DataFrame:
    """The chunks with ``ways``: for each of the four states before it, the four cheapest (cost, audit) after it."""
    edits = F.transform("marked", _edits)
    ways = F.array(*[F.aggregate("edits", _from(k), _step) for k in range(4)])
    return chunks.withColumn("edits", edits).withColumn("ways", ways).drop("edits")


def _counts(marked: Column) -> dict[str, Column]:
    total = lambda of: F.aggregate(marked, F.lit(0).cast("long"), lambda s, t: s + of(t))
    one = lambda condition: F.when(condition, 1).otherwise(0)
    pairs = F.zip_with(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), F.slice(marked, 1, F.greatest(F.size(marked) - 1, F.lit(0))), lambda b, a: F.concat(a["initial"], b["initial"]))
    return {
        "blank": total(lambda t: F.when(t["fault"] == BLANK, t["n"]).otherwise(0)),
        "duplicate": total(lambda t: F.when(t["fault"] == BLANK, 0).otherwise(t["n"] - one(t["fault"] != DUPLICATE))),
        "truncated": total(lambda t: one(t["fault"] == TRUNCATED)),
        "illegal": total(lambda t: t["n"] - 1) + F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))),
    }


def _joined(ways: Column) -> Column:
    """The cheapest (cost, audit, path) of a conversation from its chunks' ways, in order; a path names each chunk's entering state and edits."""
    path = "array<struct<chunk: bigint, enters: int, edits: string>>"
    start = lambda cost, audit: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"), F.array().cast(path).alias("path"))
    # before the first turn: nothing, or inserted turns
    zero = F.struct(start(0, "").alias("q0"), start(NEVER, "").alias("q1"), start(INSERT, "I").alias("q2"), start(2 * INSERT, "II").alias("q3"))

    def through(q: Column, c: Column) -> Column:
        def to(k: int) -> Column:
            after = lambda i: c["ways"][i][f"q{k}"]
            return F.least(*[
                F.struct(
                    (q[f"q{i}"]["cost"] + after(i)["cost"]).alias("cost"),
                    F.concat(q[f"q{i}"]["audit"], after(i)["audit"]).alias("audit"),
                    F.concat(q[f"q{i}"]["path"], F.array(F.struct(c["chunk"].alias("chunk"), F.lit(i).alias("enters"), after(i)["audit"].alias("edits")))).alias("path"),
                )
                for i in range(4)
            ])

        return F.struct(*[to(k).alias(f"q{k}") for k in range(4)])

    return F.aggregate(ways, zero, through, lambda q: F.least(q["q0"], q["q3"]))


def _lines(turns: Column, enters: Column, edits: Column) -> Column:
    """The repaired turns of a chunk as ``role:text``. The audit's letters are dealt to the turns, inserts before the turn they precede."""
    inserts = lambda assistant, n: F.slice(F.when(assistant, F.array(F.lit("assistant:"), F.lit("user:"))).otherwise(F.array(F.lit("user:"), F.lit("assistant:"))), F.lit(1), n)
    letters = F.regexp_extract_all(edits, F.lit("I*[KRD]"), 0)
    zero = F.struct((enters == 2).alias("assistant"), F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def deal(acc: Column, t: Column) -> Column:
        own = F.get(letters, acc["at"].cast("int"))
        ahead, letter = F.length(own) - 1, F.substring(own, -1, 1)
        assistant = acc["assistant"] != (ahead % 2 == 1)
        line = F.when(letter == "K", F.concat(t["role"], F.lit(":"), t["text"])).otherwise(F.concat(F.when(assistant, "assistant:").otherwise("user:"), t["text"]))
        system = (letter == "K") & (F.substring(t["role"], 1, 1) == "s")
        return F.struct(
            F.when((letter == "D") | system, assistant).otherwise(~assistant).alias("assistant"),
            (acc["at"] + t["n"]).alias("at"),
            F.concat(acc["out"], inserts(acc["assistant"], ahead), F.when(letter != "D", F.array(line)).otherwise(F.array().cast("array<string>"))).alias("out"),
        )

    return F.aggregate(turns, zero, deal, lambda acc: F.concat(acc["out"], inserts(acc["assistant"], F.length(F.regexp_extract(edits, "I*$", 0)))))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of rows (conv_id, turn, role, text, copies).

    ``repaired`` is the conversation after the cheapest edits, a line ``role:text`` for each turn. A
    null conv_id is a conversation of its own; null turns come first; rows of the same turn stand by
    role, then text; equal rows count as often as they occur. A role without a first letter can't be
    kept. A conversation whose rows have no copies has zeros and empty strings; no rows, no result.
    """
    chunks = faults(chunked(rows))
    turns = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    small = folded(chunks).select(
        *KEY,
        "chunk",
        F.array_min(turns).alias("low"),
        F.array_max(turns).alias("high"),
        F.size(F.array_distinct(turns)).alias("distinct"),
        *[c.alias(n) for n, c in _counts(F.col("marked")).items()],
        F.get("marked", F.lit(0))["initial"].alias("first"),
        F.try_element_at("marked", F.lit(-1))["initial"].alias("last"),
        (F.size("marked") > 0).alias("some"),
        "ways",
    )
    of = small.groupBy(*KEY).agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.array_sort(F.collect_list(F.when(F.col("some"), F.struct("chunk", "first", "last", "ways")))).alias("parts"),
    )
    seams = F.zip_with(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), lambda b, a: F.concat(a["last"], b["first"]))
    facts = F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    best = of.withColumn("illegal", F.col("illegal") + F.size(F.filter(seams, lambda p: ~p.isin(*LEGAL)))).withColumn("best", _joined(F.col("parts"))).select(*KEY, facts.alias("facts"), F.posexplode_outer("best.path").alias("at", "p"))
    # the facts, of which the audit may be long, go with a conversation's first chunk only
    found = best.select(*KEY, "p.*", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("facts")).alias("facts"))
    dealt = found.join(chunks.select(*KEY, "chunk", "turns"), [*KEY, "chunk"], "left").withColumn("lines", F.when(F.col("turns").isNotNull(), _lines(F.col("turns"), F.col("enters"), F.col("edits"))))
    text = F.when(F.size("lines") > 0, F.struct("chunk", F.array_join("lines", "\n").alias("text")))
    done = dealt.groupBy(*KEY).agg(F.first("facts", ignorenulls=True).alias("facts"), F.array_sort(F.collect_list(text)).alias("texts"))
    return done.select(F.when(~F.col("absent"), F.col("conv")).alias("conv_id"), *[F.col("facts")[c].cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], "facts.audit", F.array_join(F.transform("texts", lambda t: t["text"]), "\n").alias("repaired"))


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, with the repaired text's checksum in its place."""
    done = repair(damaged(conversations))
    return done.select(*[c for c in done.columns if c != "repaired"], F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


_EIGHT = "list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _candidate(before: str, cost: str, letters: str, line: str) -> str:
    text = f"{before}.t" if line == "" else f"list_append({before}.t, {line})"
    return f"{{'c': {before}.c + {cost}, 'a': {before}.a || {letters}, 't': {text}}}"


def _best(*candidates: str) -> str:
    return f"list_min([{', '.join(candidates)}])"


_PAY = "CASE WHEN gone THEN 1000000000 WHEN fault = 3 THEN 5 ELSE 0 END"


def _put(before: str, initial: str, role: str) -> str:
    return _candidate(before, f"{_PAY} + (init <> '{initial}')::INT", f"CASE WHEN init = '{initial}' THEN 'K' ELSE 'R' END", f"CASE WHEN init = '{initial}' THEN role ELSE '{role}' END || ':' || text")


def _stay(q: str) -> str:
    return _candidate(q, "2", "'D'", "")


_START = "{'c': %d::BIGINT, 'a': '', 't': []::VARCHAR[]}"
_I = lambda q, role: _candidate(q, "5", "'I'", f"'{role}:'")

# A recursive query in place of the fold: one turn a step, its candidates as sorted structs, with the repaired lines carried along.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {_EIGHT} AS v FROM range(256) r(i))),
original AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
codes AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS d
  FROM (SELECT DISTINCT k FROM original), crc),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM original JOIN codes USING (k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role[1] AS init FROM damaged),
judged AS (SELECT *, lag(init) OVER (PARTITION BY conv_id ORDER BY pos) AS previous,
  CASE WHEN rtrim(text, {_BLANKS}) = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN NOT contains('.!?', rtrim(text, {_BLANKS})[-1]) THEN 3 ELSE 0 END AS fault FROM placed),
turns AS (SELECT *, fault IN (1, 2) AS gone FROM judged),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE previous IS NOT NULL AND previous || init NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY 1),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {_START % 0} AS q0, {_START % 1000000000} AS q1, {_START % 1000000000} AS q2, {_START % 1000000000} AS q3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, t.pos, {_stay('p0')}, {_best(_stay('p1'), _candidate('p0', f"{_PAY} + CASE WHEN init = 's' THEN 0 ELSE 1000000000 END", "'K'", "role || ':' || text"))},
    {_best(_stay('p2'), _put('p0', 'u', 'user'), _put('p1', 'u', 'user'), _put('p3', 'u', 'user'))}, {_best(_stay('p3'), _put('p2', 'a', 'assistant'))}
  FROM (SELECT conv_id, pos, q0 AS p0, q1 AS p1, p2, {_best('q3', _I('p2', 'assistant'))} AS p3 FROM (SELECT *, {_best('q2', _I('q0', 'user'), _I('q1', 'user'), _I('q3', 'user'))} AS p2 FROM walk)) w
  JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1),
ends AS (SELECT conv_id, {_best('q0', 'p3')} AS e FROM (SELECT *, {_best('q3', _I('p2', 'assistant'))} AS p3 FROM (SELECT *, {_best('q2', _I('q0', 'user'), _I('q1', 'user'), _I('q3', 'user'))} AS p2 FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1))))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c AS cost, e.a AS audit, sha256(array_to_string(e.t, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
