"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from tidepanel.llm.common import map_documents

#: Kinds whose spans the patterns alone define; they stay whatever their score is.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_GROUPS = re.compile(r"(?: ?[A-Z0-9]){11,30}")
_GROUP_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTH = {
    c[:2]: int(c[2:])
    for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18
    FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
    MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23
    TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score before context, and the words nearby that raise it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
}
#: Score a method-added span needs, characters looked at on either side, and what one context adds.
KEEP_AT, REACH, BOOST = 0.6, 48, 0.35
_NEAR = {k: re.compile("|".join(v), re.IGNORECASE | re.ASCII) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters become 10 to 35, the remainder is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str):
    """Grow each @ to the left by hand: a pattern that starts with the local part rescans long runs."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _ibans(text: str):
    """Take the end of a group that gives the country's length, else the last one; a failed start doesn't use up the text behind it."""
    done = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        body = _GROUPS.match(text, m.end()) if start >= done else None
        if not body:
            continue
        ends = [e.start() for e in _GROUP_END.finditer(text, m.end() + 1, body.end() + 1) if e.start() <= body.end()]
        shown = {end: text[start:end].replace(" ", "") for end in ends}
        fitting = [end for end, c in shown.items() if len(c) == IBAN_LENGTH.get(c[:2])] + ends[-1:]
        end = next((end for end in fitting if 15 <= len(shown[end]) <= 34 and mod97(shown[end])), None)
        if end:
            done = end
            yield start, end


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and kind."""
    found = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    found += [("iban", s, e) for s, e in _ibans(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out = []
    for kind, start, end in sorted(found, key=lambda f: (f[1], _ORDER[f[0]])):
        score = PRIOR[kind] + BOOST * bool(_NEAR[kind].search(text, max(0, start - REACH), start) or _NEAR[kind].search(text, end, end + REACH))
        if kind in BASE_KINDS or score >= KEEP_AT:
            out.append((kind, start, end, round(min(score, 1.0), 2)))
    return out


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
SPAN_SQL = "array<struct<kind: string, start: int, end: int, score: double>>"


def as_structs(found: list) -> list:
    return [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in one] for one in found]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and its entities, an array of (kind, start, end, score), one row per input row.

    Null and empty texts have no entities; a null doc_id stays null; repeated rows each get
    their row. Long texts are scanned whole, in time linear in their length.
    """

    def work(ids, texts):
        return {"doc_id": pa.array(ids, pa.int64()), "entities": pa.array(as_structs([spans(t) for t in texts]), SPAN)}

    return map_documents(docs, work, f"doc_id long, entities {SPAN_SQL}")


def masked(text: str) -> str:
    """The text with each entity replaced by its kind; of overlapping ones the first stays, widened."""
    out, done = [], 0
    for kind, start, end, _ in spans(text):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:] if done else text


def mask_pii(docs: DataFrame) -> DataFrame:
    """The same rows and columns with ``text`` masked; a null text stays null."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            new = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=names)

    # positions, not names, tell the columns apart: a name may hold a dot
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, docs.schema)


def span_text(entities: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    kept = F.filter(entities, lambda e: e["kind"].isin(*kinds)) if kinds else entities
    return F.array_join(F.transform(kept, lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")


def count_of(entities: Column, kind: str) -> Column:
    return F.size(F.filter(entities, lambda e: e["kind"] == kind)).cast("long")


def pii_digest(docs: DataFrame) -> DataFrame:
    e = F.col("entities")
    return find_pii(docs).select(
        "doc_id",
        *[count_of(e, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(e, BASE_KINDS), 256).alias("base_sha256"),
        span_text(e).alias("spans"),
        "entities",
    )
