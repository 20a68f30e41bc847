"""How results look on a console; never part of a plan."""

from __future__ import annotations

import datetime as dt
from typing import Any


def format_value(value: Any, two_places: bool = False) -> str:
    """Whole numbers plain; others with up to six decimals, one at least (an average: none or two); NULL, TRUE, FALSE."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        if two_places:
            return str(int(value)) if value.is_integer() else f"{value:.2f}"
        if value != value or value in (float("inf"), float("-inf")):
            return str(value)
        text = f"{value:.6f}".rstrip("0")
        return text + "0" if text.endswith(".") else text
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def render(names: list[str], rows: list[tuple[Any, ...]]) -> str:
    if not rows:
        return "(0 rows)"
    text = [[format_value(v, n.startswith("AVG(")) for v, n in zip(r, names)] for r in rows]
    width = [max(len(n), *(len(r[i]) for r in text)) for i, n in enumerate(names)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, width)).rstrip()
    return "\n".join([line(names), "-+-".join("-" * w for w in width), *map(line, text), f"({len(rows)} row{'s' * (len(rows) != 1)})"])
