"""Secret scans with multipart credential linking.

Some credentials are plain by their form (an assignment to a telling name, an access key id, a long hexadecimal string).
Others are weak on their own: a random-looking token, a user name, an endpoint.  The scan collects all parts of a text
with their places, joins the intervals of parts that lie within one scope (``reach`` code points apart at most) and
reports a weak part only when its complement is there: a token with an identifier or an endpoint beside it, an
identifier with a secret beside it, an endpoint with an identifier and a secret, which may also stand within it.  One
stretch of text is one part: tokens and identifiers that overlap a plain form aren't parts, and an identifier and a
secret that overlap each other don't complement each other.  A token looks random if it has a lower-case letter, an
upper-case letter and a digit, or if letters and digits change four times.  The join looks places up by bisection in
starts, ends and the largest ends so far, sorted once per text, so dense texts cost n log n; schemes of endpoints are read
from "://" to the left, so long runs of letters are read once.

Defined results: a null text is an empty one without spans; null ids and repeated rows are rows like others; extra
columns pass through, a clashing ``spans`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._shared import plain_columns, ready

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "token", "endpoint")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENTIFIER = re.compile(r"""(?ai:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""")
_IDENTIFIER_HINTS = ("user", "login", "client", "account")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_REST = re.compile(r"""(?a:[^\s"'<>]+)""")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each plain form that don't overlap; matches too short are passed over as matches."""
    low = text.lower()
    out: list[Span] = []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]  # a run of 32 or more is one match either way
    return out


def _random_looking(token: str) -> bool:
    if any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token):
        return True
    kinds = [c.isdigit() for c in token if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= 4


def endpoints(text: str) -> list[Span]:
    """Leftmost matches, that don't overlap, of ``[a-z][a-z0-9+.-]*://`` and what follows up to a space, quote or bracket."""
    out: list[Span] = []
    floor, at = 0, text.find("://")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _SCHEME:
            start -= 1
        while start < at and not "a" <= text[start] <= "z":
            start += 1
        rest = _REST.match(text, at + 3) if start < at else None
        if rest:
            out.append((start, 5, rest.end()))
            floor = rest.end()
        at = text.find("://", max(floor, at + 1))
    return out


class _Places:
    """Intervals of one class, sorted for lookups of what lies within reach."""

    def __init__(self, spans: list[Span]) -> None:
        found = sorted((s, e) for s, _, e in spans)
        self.starts = [s for s, _ in found]
        self.ends = sorted(e for _, e in found)
        self.furthest = list(accumulate((e for _, e in found), max))

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.furthest[i - 1] > start

    def beside(self, start: int, end: int, reach: int) -> bool:
        """One that doesn't overlap, within reach on either side."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return (i > 0 and self.ends[i - 1] >= start - reach) or (j < len(self.starts) and self.starts[j] <= end + reach)

    def near(self, start: int, end: int, reach: int) -> bool:
        return self.overlaps(start, end) or self.beside(start, end, reach)


def parts(text: str, base: list[Span]) -> tuple[list[Span], list[Span], list[Span]]:
    """The weak parts of a text: identifiers, tokens and endpoints."""
    taken = _Places(base)
    free = lambda m: not taken.overlaps(m.start(), m.end())
    low = text.lower()
    identifiers = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text) if free(m)] if any(h in low for h in _IDENTIFIER_HINTS) else []
    points = endpoints(text)
    if not base and not identifiers and not points:
        return [], [], []  # a token has nothing to go with
    return identifiers, [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if _random_looking(m[0]) and free(m)], points


def linked_spans(text: str, base: list[Span], reach: int) -> list[Span]:
    """Weak parts whose complement lies within ``reach``."""
    identifiers, tokens, points = parts(text, base)
    ids = _Places(identifiers + [s for s in base if s[1] == 1])
    secrets = _Places(tokens + [s for s in base if s[1] != 1])
    urls = _Places(points)
    out = [s for s in tokens if ids.beside(s[0], s[2], reach) or urls.beside(s[0], s[2], reach)]
    out += [s for s in identifiers if secrets.beside(s[0], s[2], reach)]
    out += [s for s in points if ids.near(s[0], s[2], reach) and secrets.near(s[0], s[2], reach)]
    return out


def find_spans(text: str, reach: int = 200) -> list[Span]:
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, reach))


@plain_columns(("spans",), ("text_col",))
def find_secrets(docs: DataFrame, text_col: str = "text", reach: int = 200) -> DataFrame:
    """``docs`` with ``spans``: kind, start and end (code points, end exclusive), by start and then kind."""
    ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "spans array<struct<kind:string,start:int,end:int>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t or "", reach)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return docs.mapInArrow(run, kinds)
