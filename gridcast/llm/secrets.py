"""Secret scan with multipart credential linking.

Base secrets stand for themselves: ``assign`` (a telling name, a sign, a value of 6 or more),
``access`` (``AKIA`` and 16 or more) and ``hex`` (24 or more digits). Weak candidates are common
in harmless text: ``id`` (a user name or the like), ``key`` (a vaguely named value, or a long
token of mixed case and digits) and ``endpoint`` (a host). A credential that can be used has
several of these parts beside each other, so a weak candidate is reported only where its
complement lies in the same scope: an ``id`` needs a secret (base secret or ``key``), a ``key``
needs an identifier (``access`` or ``id``), an ``endpoint`` needs both. A scope is a run of lines
without a blank line; parts link when disjoint and at most ``REACH`` code points apart.

The link is an interval join inside each text: the parts of a role are sorted, and the nearest
before and after each candidate, found by binary search, decide, as what lies farther is neither
closer nor more likely in the scope. No text meets another, so nothing is shuffled, and no pair
of parts is listed. Candidates that touch a base secret are part of it and dropped.

Defined results: a NULL or empty text has no spans; very long texts are scanned whole by
patterns that read each character a bounded number of times; spans of one start follow the
order of ``KINDS``; repeated rows are scanned each for itself; rows without ``doc_id`` like any
other; an empty table gives none. An input column named like a result gives way to it, in any
case of letters; other columns are carried as ``keep`` says.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridcast.llm.common import map_texts

# Fixed values of the contract: the base patterns and least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

REACH = 200
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ID = r"""(user|user_?name|user_?id|login|account|client_?id|access_?key_?id|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+/-]{3,}"""
KEY = r"""(pwd|pass|passphrase|auth|bearer|private_?key|credentials?|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
MIXED, MIXED_CHARS = r"[A-Za-z0-9+/_-]+", 20
ENDPOINT = r"(https?|ftps?|sftp|ssh|wss?|s3|postgresql|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%-]+"
HOST = r"""(host|host_?name|server|endpoint|domain)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,}"""

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))
FIELDS = T.StructType([T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
                       T.StructField("n_hex", T.LongType()), T.StructField("base", SPAN), T.StructField("spans", SPAN)])

_EITHER_CASE = re.ASCII | re.IGNORECASE
_assign = re.compile(ASSIGN, _EITHER_CASE)
_access, _hex = re.compile(ACCESS), re.compile(f"[0-9a-f]{{{HEX_CHARS},}}")
_named = {"id": re.compile(ID, _EITHER_CASE), "key": re.compile(KEY, _EITHER_CASE)}
_mixed = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIXED_CHARS)
_signs = re.compile(r"[:=]")
_endpoints = re.compile(ENDPOINT, _EITHER_CASE), re.compile(HOST, _EITHER_CASE)
_blank = re.compile(r"\n(?=[\x20\t\r]*\n)")
_classes = [re.compile(c) for c in ("[A-Z]", "[a-z]", "[0-9]")]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind."""
    found = []
    if _signs.search(text):
        found += [("assign", m.start(), m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _access.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return in_order(found)


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts that touch no base secret."""
    found = []
    if _signs.search(text):
        for kind, pattern in _named.items():
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
        for pattern in _endpoints:
            found += [("endpoint", m.start(), m.end()) for m in pattern.finditer(text)]
    found += [("key", m.start(), m.end()) for m in _mixed.finditer(text) if all(c.search(m[0]) for c in _classes)]
    if not (base and found):
        return found
    starts, reach, ends = [s for _, s, _ in base], 0, []
    for _, _, e in base:                                     # the furthest end among the spans so far
        ends.append(reach := max(reach, e))
    return [(k, a, b) for k, a, b in found if not (i := bisect_left(starts, b)) or ends[i - 1] <= a]


def linked(text: str, base: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """The weak parts whose complements lie in scope."""
    weak = candidates(text, base)
    if not weak or len({k for k, _, _ in (*base, *weak)}) < 2:
        return []
    cuts = [m.start() for m in _blank.finditer(text)]
    roles = {"identifier": ("access", "id"), "secret": ("assign", "hex", "key")}
    sides = {}
    for role, kinds in roles.items():
        own = [(a, b) for k, a, b in (*base, *weak) if k in kinds]
        sides[role] = sorted(a for a, _ in own), sorted(b for _, b in own)

    def beside(role: str, start: int, end: int) -> bool:
        starts, ends = sides[role]
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        return (before > 0 and near(ends[before - 1], start)) or (after < len(starts) and near(end, starts[after]))

    def near(a: int, b: int) -> bool:
        return b - a <= reach and bisect_left(cuts, a) == bisect_left(cuts, b)

    needs = {"id": ("secret",), "key": ("identifier",), "endpoint": ("identifier", "secret")}
    return [w for w in weak if all(beside(role, w[1], w[2]) for role in needs[w[0]])]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """``docs`` with counts of base secrets, their spans ``base`` and all ``spans``."""
    def run(batch):
        out = []
        for t in batch.column(text).to_pylist():
            base = base_spans(t or "")
            kinds = [k for k, _, _ in base]
            spans = in_order(base + linked(t or "", base, reach))
            out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                        *([{"kind": k, "start": a, "end": b} for k, a, b in s] for s in (base, spans))))
        return list(zip(*out))

    return map_texts(docs, run, FIELDS, keep, text=text)


def listed(spans: Column | str) -> Column:
    """``kind:start:end``, comma-joined."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
