"""Tokens: words, numbers, strings with doubled quotes, symbols; ``--`` and ``/* */`` comments are skipped."""

from __future__ import annotations

import re
from typing import NamedTuple

from millrace.errors import ParseError

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>\d+\.\d+|\d+)
      | (?P<word>[^\W\d_]\w*)
      | (?P<string>'(?:[^']|'')*')
      | (?P<symbol><>|!=|>=|<=|[-+*/=<>(),.;])""",
    re.VERBOSE | re.DOTALL,
)


class Token(NamedTuple):
    kind: str  # word, number, string, symbol, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise ParseError(f"unexpected {sql[at : at + 20]!r} at {at}")
        if m.lastgroup != "skip":
            out.append(Token(str(m.lastgroup), m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]
