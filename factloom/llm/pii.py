"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, ``://`` schemes, digits, plus signs before digits, identifier
cues); each anchor is expanded by a deterministic local parser that looks at its neighbourhood only and
validates what it finds (octets, Luhn, numbers of digits). Text without anchors is read once, by the automaton.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (the base kinds, with the meaning of the four patterns of
``BASE``, leftmost and not overlapping within a kind), ``url_login`` (a URL with ``user:secret@``) and
``account`` (a cue such as ``iban`` or ``account no``, then an identifier with at least 8 letters or digits, 4
of them digits).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_clash, prepared, tidy

#: What the base kinds mean.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "url_login", "account")
#: Words that announce an identifier, found in any mixture of cases of the first letter.
CUES = ("iban", "IBAN", "Iban", "account no", "Account no", "account number", "Account number", "acct", "Acct", "passport no", "Passport no", "ssn", "SSN")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
# Local parsers: each is matched at one place, never searched for.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR_PARTS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"[ ().0-9-]*")
_LOGIN = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+")
_AFTER_CUE = re.compile(r"[ .:#=]{0,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9])*)")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for d in "0123456789":
        made.add_word(d, ("digit", 1))
        made.add_word(f"+{d}", ("plus", 2))
    made.add_word("@", ("at", 1))
    made.add_word("://", ("scheme", 3))
    for cue in CUES:
        made.add_word(cue, ("cue", len(cue)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind index, start, end)`` in code points, by kind, then start.

    ``next_at[kind]`` is where the kind's scan goes on: behind its last match, valid or not, as a leftmost
    non-overlapping search would.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    next_at = [0] * len(KINDS)
    for last, (what, length) in _automaton().iter(text):
        start = last - length + 1
        if what == "digit":
            if start >= next_at[1] and (start == 0 or start <= next_at[1] or text[start - 1] not in _DIGITS):
                if m := _FOUR_PARTS.match(text, start):
                    next_at[1] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                        found[1].append(m.span())
            if start >= next_at[2]:
                end = _GROUPS.match(text, start).end()
                next_at[2] = end
                if end - start >= 16:
                    digits = text[start:end].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found[2].append((start, end))
        elif what == "plus":
            if start >= next_at[3]:
                end = _DIALLED.match(text, start + 2).end()
                while end > start + 3 and text[end - 1] not in _DIGITS:
                    end -= 1
                if end > start + 3 and text[end - 1] in _DIGITS:
                    next_at[3] = end
                    if 8 <= sum(c in _DIGITS for c in text[start:end]) <= 15:
                        found[3].append((start, end))
        elif what == "at":
            begin = start
            while begin > next_at[0] and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < start and (m := _DOMAIN.match(text, start + 1)):
                next_at[0] = m.end()
                found[0].append((begin, m.end()))
        elif what == "scheme":
            begin = start
            while begin > next_at[4] and text[begin - 1] in _SCHEME:
                begin -= 1
            if begin < start and (m := _LOGIN.match(text, last + 1)):
                next_at[4] = m.end()
                found[4].append((begin, m.end()))
        elif start >= next_at[5] and (start == 0 or not text[start - 1].isalnum()) and (m := _AFTER_CUE.match(text, last + 1)):
            name = _account(m[1])
            if name:
                next_at[5] = m.start(1) + len(name)
                found[5].append((m.start(1), next_at[5]))
    return [(k, a, b) for k, spans in enumerate(found) for a, b in spans]


def _account(run: str) -> str:
    """Of what follows a cue: its leading groups that each hold a digit; empty if they don't make an identifier."""
    end = 0
    for m in re.finditer(r"[A-Za-z0-9]+", run):
        if not any(c in _DIGITS for c in m[0]):
            break
        end = m.end()
    name = run[:end]
    solid = re.sub(r"[ -]", "", name)
    return name if 8 <= len(solid) <= 34 and sum(c in _DIGITS for c in solid) >= 4 else ""


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by ``<kind>``; of overlapping spans the union goes, named by the first kind to start."""
    out, at, ends = [], 0, -1
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a < ends:
            if b > ends:
                at = ends = b
            continue
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = ends = b
    return "".join([*out, text[at:]])


SCHEMA = "spans array<struct<kind:string,start:int,end:int>>, redacted string"


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``spans array<struct<kind,start,end>>`` (code points, end exclusive), ``redacted string``.

    One row per input row, in one narrow pass without a shuffle; the columns of ``carry`` follow unchanged. Null
    texts count as empty: no spans, redacted is empty. Null and repeated keys are passed on; no other column is
    read. Carried columns must not bear the name of another column of the result.
    """
    no_clash((key, "spans", "redacted"), carry)
    names = ["_key", "_text", *(f"_c{i}" for i in range(len(carry)))]
    rows = prepared(df).select(F.col(key), F.coalesce(F.col(text), F.lit("")), *carry).toDF(*names)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(t) for t in texts]
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f] for f in found], spans_type)
            redacted = pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, redacted, *batch.columns[2:]], names=["_key", "spans", "redacted", *names[2:]])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"_key {kinds['_key']}", SCHEMA, *(f"{n} {kinds[n]}" for n in names[2:])])
    return rows.mapInArrow(tidy(scan), schema).toDF(key, "spans", "redacted", *carry)
