"""A console: ``python -m millrace [folder]``. Statements end at the line's end or at a semicolon."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from millrace.engine import Engine
from millrace.errors import EngineError

HELP = ".help  .tables  .schema TABLE  .quit  .exit; anything else is SQL"


def meta(engine: Engine, line: str) -> str | None:
    """The answer to a dot command; None ends the session."""
    word, *rest = line.split()
    if word in (".quit", ".exit"):
        return None
    if word == ".tables":
        return "\n".join(engine.tables()) or "no tables"
    if word == ".schema" and rest:
        out = []
        for c in engine.schema(rest[0]):
            how = [w for w, on in (("NOT NULL", c.not_null), ("UNIQUE", c.unique), ("AUTO_INCREMENT", c.auto_increment), ("PRIMARY KEY", c.primary_key)) if on]
            out.append(" ".join([c.name, c.type, *how, *([f"REFERENCES {c.references[0]}({c.references[1]})"] if c.references else [])]))
        return "\n".join(out)
    return HELP


def repl(engine: Engine, lines, say) -> None:
    for line in lines:
        line = line.strip()
        if not line:
            continue
        try:
            if line.startswith("."):
                answer = meta(engine, line)
                if answer is None:
                    return
                say(answer)
            else:
                for result in engine.script(line):
                    say(result.render())
        except EngineError as e:
            say(f"{type(e).__name__}: {e}")


if __name__ == "__main__":
    session = SparkSession.builder.appName("millrace").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    repl(Engine(session, sys.argv[1] if len(sys.argv) > 1 else "./data"), sys.stdin, print)
