"""Secrets: patterns propose parts, an interval join within a scope links complementary ones."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import map_documents
from tidepanel.llm.pii import SPAN, SPAN_SQL, as_structs, count_of, span_text

#: Kinds whose spans the patterns alone define; they always stay.
BASE_KINDS = ("assign", "access", "hex")
#: Weak kinds: reported only beside a complementary part.
KINDS = (*BASE_KINDS, "identifier", "opaque", "endpoint")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"(?:user(?:name)?|client_?id|account|login)[\"']? {0,4}[:=] {0,4}[\"']?[A-Za-z0-9_.@-]{3,}", re.IGNORECASE | re.ASCII)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
_ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}")

#: The role each kind plays in a credential.
ROLE = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "endpoint"}
#: How far a part's scope reaches. A weak part needs a strong partner, an id a secret or a secret an id, or parts of both other roles.
SCOPE_CHARS = 400


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def _proposals(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)]
    found += [("opaque", *m.span()) for m in _OPAQUE.finditer(text) if _mixed(m[0])]
    found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return sorted(found, key=lambda f: (f[1], _ORDER[f[0]], f[2]))


def _reach(parts: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts in order, and for each the furthest end of the parts up to it."""
    return [start for _, start, _ in parts], list(accumulate((end for _, _, end in parts), max))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score): base spans, and weak ones whose scope holds a complementary part.

    A scope reaches SCOPE_CHARS from a part's ends, and a partner may lie in it with any of its
    characters. It is an interval semi-join over sorted starts with the furthest end up to each:
    each weak part probes the list of each other role with a binary search, so a text with very
    many parts costs n log n and emits each part once, however many partners it has.
    """
    found = _proposals(text)
    roles = ("id", "secret", "endpoint")
    every = {r: _reach([f for f in found if ROLE[f[0]] == r]) for r in roles}
    strong = {r: _reach([f for f in found if ROLE[f[0]] == r and f[0] in BASE_KINDS]) for r in roles}

    def near(parts: tuple[list[int], list[int]], low: int, high: int) -> bool:
        i = bisect_right(parts[0], high)
        return i > 0 and parts[1][i - 1] >= low

    out = []
    for kind, start, end in found:
        low, high, others = start - SCOPE_CHARS, end + SCOPE_CHARS, [r for r in every if r != ROLE[kind]]
        pair = {"id": "secret", "secret": "id"}.get(ROLE[kind])
        partners = sum(near(every[r], low, high) for r in others)
        sure = any(near(strong[r], low, high) for r in others)
        if kind in BASE_KINDS:
            out.append((kind, start, end, min(1.0, 0.7 + 0.15 * partners)))
        elif sure or partners == 2 or (pair and near(every[pair], low, high)):
            out.append((kind, start, end, 0.4 + 0.15 * partners + 0.2 * sure))
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its findings, an array of (kind, start, end, score), one row per input row.

    Null and empty texts have none; a null doc_id stays null; repeated rows each get their row.
    """

    def work(ids, texts):
        return {"doc_id": pa.array(ids, pa.int64()), "findings": pa.array(as_structs([spans(t) for t in texts]), SPAN)}

    return map_documents(docs, work, f"doc_id long, findings {SPAN_SQL}")


def secrets_digest(docs: DataFrame) -> DataFrame:
    e = F.col("findings")
    return find_secrets(docs).select(
        "doc_id",
        *[count_of(e, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(e, BASE_KINDS), 256).alias("base_sha256"),
        span_text(e).alias("spans"),
        "findings",
    )
